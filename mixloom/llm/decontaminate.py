"""Passages of benchmark items found in documents by an FM-index per shard, and cut out of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.llm.wavelet import FMIndex

# A word is a run of ASCII digits and letters and of all characters beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_WORD_BYTES = re.compile(rb"[^ ]+")

# A shard is indexed when it holds this many words that could be in a window, or this many
# documents; benchmarks are searched for in pieces of about this many words. None changes a result.
SHARD_WORDS = 1_000_000
SHARD_DOCS = 50_000
PIECE_WORDS = 400_000
STRETCH_WORDS = 100_000
BLOCK_BYTES = 4_000_000


def item_words(text: Column) -> Column:
    """Words of a text with A to Z in lower case; NULL has none."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(ITEM_WORD), 0)
    return F.coalesce(words, F.array().cast("array<string>"))


@dataclass
class Phrases:
    """Windows of a piece of the benchmark, by length, and the items that hold each."""

    ids: dict[bytes, int]
    windows: dict[int, np.ndarray]
    holders: dict[int, list[tuple[str, ...]]]

    @property
    def shortest(self) -> int:
        return min(self.windows)


def _phrases(rows: list, width: int) -> Phrases:
    ids: dict[bytes, int] = {}
    held: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, words in rows:
        symbols = [ids.setdefault(w.encode(), len(ids) + 1) for w in words]
        length = min(width, len(symbols))
        windows = held.setdefault(length, {})
        for start in range(len(symbols) - length + 1):
            windows.setdefault(tuple(symbols[start:start + length]), set()).add(item)
    return Phrases(
        ids, {n: np.array(list(w), dtype=np.int32) for n, w in held.items()},
        {n: [tuple(sorted(s)) for s in w.values()] for n, w in held.items()},
    )


def _pieces(benchmark: DataFrame, item: str, text: str, width: int, piece_words: int) -> list[Phrases]:
    """The benchmark in pieces of bounded size; an item longer than a stretch gives several, alike in windows."""
    words = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), item_words(F.col(text)).alias("words")
    ).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    stretches = words.select("item", "words", F.explode(F.sequence(F.lit(0), last, F.lit(STRETCH_WORDS))).alias("at"))
    stretches = stretches.select("item", F.slice("words", F.col("at") + 1, STRETCH_WORDS + width - 1).alias("words"))
    total = stretches.agg(F.sum(F.size("words"))).first()[0] or 0
    count = int(total) // piece_words + 1
    piece = F.pmod(F.xxhash64("item", "words"), F.lit(count))
    found = (
        _phrases([(r["item"], r["words"]) for r in stretches.filter(piece == i).toLocalIterator()], width)
        for i in range(count)
    )
    return [phrases for phrases in found if phrases.windows]


def _runs(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of known words at least as long as the shortest window, each ended by a 0, and where each symbol stood.

    No window holds an unknown word, so none begins, ends or lies outside such a run.
    """
    known = np.concatenate([[False], symbols > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long_enough = ends - starts >= shortest
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return np.zeros(0, dtype=symbols.dtype), np.zeros(0, dtype=np.int64)
    sizes = ends - starts + 1
    offsets = np.cumsum(sizes) - sizes
    places = np.arange(sizes.sum()) - np.repeat(offsets - starts, sizes)
    runs = symbols[np.minimum(places, len(symbols) - 1)]
    runs[offsets + sizes - 1] = 0
    return runs, places


def _hits(symbols: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[tuple[str, ...]]]:
    """Start and length of all occurrences in a shard, and the items of each."""
    runs, places = _runs(symbols, phrases.shortest)
    starts, lengths, items = [], [], []
    if len(runs):
        index = FMIndex(runs, len(phrases.ids))
        for length, windows in phrases.windows.items():
            low, high = index.search(windows)
            found = np.repeat(np.arange(len(windows)), high - low)
            if len(found):
                rows = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - high, high - low)
                at = index.locate(rows)
                starts.append(places[at])
                lengths.append(np.full(len(at), length))
                items += [phrases.holders[length][i] for i in found]
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
    return np.concatenate(starts), np.concatenate(lengths), items


def _symbols(text: pa.Scalar, ids: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words, 0 for words that no item holds, taken block by block."""
    folded = text.as_buffer().to_pybytes().translate(_FOLDED) if text.is_valid else b""
    parts, at = [], 0
    while at < len(folded):
        end = folded.find(b" ", at + BLOCK_BYTES)
        end = len(folded) if end < 0 else end
        words = folded[at:end].split()
        parts.append(np.fromiter(map(ids.get, words, repeat(0)), dtype=np.int32, count=len(words)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, dtype=np.int32)])


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(start, end) for start, end in merged]


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """A text without the bytes from the first to the last word of each span of words."""
    kept, at, left = [], 0, iter(spans)
    start, end = next(left)
    for number, word in enumerate(_WORD_BYTES.finditer(text.translate(_FOLDED))):
        if number == start:
            kept.append(text[at:word.start()])
        if number == end - 1:
            at = word.end()
            start, end = next(left, (-1, -1))
    return b"".join([*kept, text[at:]]).decode()


class _Shard:
    """Batches of documents whose words are searched together."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.batches: list[pa.RecordBatch] = []
        self.parts: list[np.ndarray] = []
        self.counts: list[int] = []
        self.symbols = 0

    def add(self, batch: pa.RecordBatch) -> None:
        for text in batch.column("text"):
            symbols = _symbols(text, self.phrases.ids)
            runs, _ = _runs(symbols, self.phrases.shortest)
            self.counts.append(len(symbols))
            self.parts.append(symbols if len(runs) else symbols[:0])
            self.symbols += len(runs)
        self.batches.append(batch)

    @property
    def full(self) -> bool:
        return self.symbols >= SHARD_WORDS or len(self.counts) >= SHARD_DOCS

    def close(self) -> Iterator[tuple[pa.RecordBatch, list[int], list, list]]:
        """Every batch with the words, spans and items of its documents."""
        sizes = np.array([len(p) + 1 for p in self.parts], dtype=np.int64)
        ends = np.cumsum(sizes)
        stop = np.zeros(1, dtype=np.int32)
        symbols = np.concatenate([x for p in self.parts for x in (p, stop)]) if self.parts else stop
        starts, lengths, items = _hits(symbols, self.phrases)
        spans: dict[int, list[tuple[int, int]]] = {}
        held: dict[int, set[str]] = {}
        documents = np.searchsorted(ends, starts, side="right")
        locals_ = starts - (ends - sizes)[documents] if len(starts) else starts
        for document, start, length, names in zip(
            documents.tolist(), locals_.tolist(), lengths.tolist(), items, strict=True
        ):
            spans.setdefault(document, []).append((start, start + length))
            held.setdefault(document, set()).update(names)
        at = 0
        for batch in self.batches:
            rows = range(at, at + batch.num_rows)
            at += batch.num_rows
            yield (
                batch, self.counts[rows.start:rows.stop],
                [_merge(spans.get(i, [])) for i in rows], [held.get(i, set()) for i in rows],
            )
        self.clear()


def _search(phrases: Broadcast, clean: bool, carry: bool):
    """A function of batches that adds the findings of one piece to those of the pieces before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(phrases.value)

        def results() -> Iterator[pa.RecordBatch]:
            for batch, counts, spans, items in shard.close():
                if "spans" in batch.schema.names:
                    before = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                    spans = [_merge(s + [(x["start"], x["end"]) for x in b]) for s, b in zip(spans, before[0])]
                    items = [s | set(b) for s, b in zip(items, before[1])]
                columns = {"key": batch.column("key")}
                if carry:
                    columns["text"] = batch.column("text")
                columns["n_words"] = pa.array(counts, pa.int64())
                columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS)
                columns["items"] = pa.array([sorted(s) for s in items], pa.list_(pa.string()))
                if clean:
                    texts = zip(batch.column("text"), spans)
                    columns["cleaned"] = pa.array([
                        _without(t.as_buffer().to_pybytes(), s) if s else t.as_py() for t, s in texts
                    ], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            shard.add(batch)
            if shard.full:
                yield from results()
        yield from results()

    return run


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_passages(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = 10, clean: bool = False, piece_words: int | None = None,
) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item.

    A window is ``width`` consecutive words of an item, or all of a shorter one.
    Gives ``key``, ``n_words``, ``spans`` (merged ranges of hit words, from 0, end
    excluded), ``items`` (sorted ids, as text, of the items with a window in the
    document) and with ``clean`` the text without its spans, ``cleaned``.

    The documents are read once, without a shuffle: every task gathers words into
    shards, indexes each and searches all windows backwards in it. Words that no item
    holds are one symbol, and runs of others shorter than any window are left out
    of the index, since no window can lie there. A benchmark of more than
    ``piece_words`` (``PIECE_WORDS``) words is taken in pieces, each small enough to broadcast, one
    after another over the same rows. NULL and empty texts have no words, NULL item
    ids count as the empty text; repeated documents are independent rows, repeated
    items change nothing, other columns are not looked at.
    """
    spark = docs.sparkSession
    found = _pieces(benchmark, item, item_text, width, piece_words or PIECE_WORDS)
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if not found:
        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        empty = rows.select(
            "key", F.size(item_words(F.col("text"))).cast("bigint").alias("n_words"), none.alias("spans"),
            F.array().cast("array<string>").alias("items"), F.col("text").alias("cleaned"),
        )
        return (empty if clean else empty.drop("cleaned")).withColumnRenamed("key", key)
    for number, phrases in enumerate(found):
        last = number == len(found) - 1
        schema = f"key {key_type}, " + ("" if last else "text string, ")
        schema += "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
        schema += ", cleaned string" if last and clean else ""
        shared = spark.sparkContext.broadcast(phrases)
        rows = rows.mapInArrow(_search(shared, last and clean, not last), schema)
    return rows.withColumnRenamed("key", key)


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = 10,
) -> DataFrame:
    """Counts of hit words and items per document, with a checksum of the items' ids."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return find_passages(docs, benchmark, key, text, item, item_text, width).select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def remove_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with every benchmark passage cut out of their texts; all columns and rows stay."""
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(struct.alias("row"), F.col(f"`{text}`").alias("text"))
    found = find_passages(packed, benchmark, key="row", clean=True, **options)
    return found.select(*[
        F.col("cleaned").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns
    ])
