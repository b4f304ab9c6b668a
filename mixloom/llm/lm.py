"""Operator 6: scores of a bigram model held in Elias-Fano tries, one trie per part.

The word pairs of all texts are dealt once, by a hash of the context: pairs of
training texts to be counted, pairs of all texts to be looked up. A part counts its
training pairs, builds the trie of its contexts and looks up every distinct pair it
was sent. Contexts common enough to fill a part alone are dealt by the whole pair.
What a part sends on is a sum per text, and the words of pairs never seen, whose
probability is that of the unigram model. Unigrams are dealt by the word in the same
way; the common words are counted beforehand and need no dealing.

Pairs travel packed, as sorted numbers of many texts per row, and a part holds about
``PART_TOKENS`` of them whatever the corpus: more text makes more parts.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.llm.common import fold
from mixloom.llm.trie import BigramTrie
from mixloom.session import materialize

# Weight of the unigram model against the counts of a context.
PRIOR = 8.0
PART_TOKENS = 2_000_000
LEAST_PARTS = 24
# Tokens that one packed row set is made from.
PACK_TOKENS = 1_000_000
# Common words: looked for in about so many texts; at most so many, each at least this
# part of their tokens. They change where work is done, never a count or a score.
SAMPLE_TEXTS = 2_000
COMMON_WORDS = 1_000
COMMON_SHARE = 1 / 2_000

_END = b"\n"  # no word holds white space
_BEGIN_HASH = np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(_END))
_LOW = np.uint64(32)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _spread(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(29))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another; the lengths and kinds come first."""
    head = struct.pack("<B", len(arrays))
    for a in arrays:
        head += struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a))
    return head + b"".join(a.tobytes() for a in arrays)


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, at, kinds, out = raw[0], 1, [], []
    for _ in range(n):
        kinds.append(struct.unpack_from("<2sQ", raw, at))
        at += struct.calcsize("<2sQ")
    for kind, size in kinds:
        kind = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def _keyed(docs: DataFrame, train: Column) -> DataFrame:
    """A 64-bit key per document row, whether it trains, and the text as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.xxhash64("doc_id", text).alias("k"), F.col("doc_id").cast("bigint").alias("doc_id"),
        train.alias("train"), text.cast("binary").alias("text"),
    )


def _common_words(keyed: DataFrame) -> list[bytes]:
    """Words that are common in a sample of the texts; the end is always one."""
    rows = keyed.count()
    position = F.shiftrightunsigned("k", 11) / F.lit(float(1 << 53))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    sample = keyed.filter(position < SAMPLE_TEXTS / max(rows, 1)).select("text")
    counted = materialize(
        sample.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "sampled-words"
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.filter(F.col("n") >= total * COMMON_SHARE).orderBy(F.col("n").desc(), "word").limit(COMMON_WORDS)
    return sorted({bytes(r["word"]) for r in found.collect()} | {_END})


def _training_counts(keyed: DataFrame, common: list[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Tokens of all texts, of the training texts, and these texts' counts of the common words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, trained, counts = 0, 0, np.zeros(len(common), np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for text, train in zip(batch.column(0), batch.column(1).to_pylist()):
                words = words_of(text.as_py())
                every += len(words) + 1
                if train:
                    trained += len(words) + 1
                    seen.update(words)
                    seen[_END] += 1
            counts += np.array([seen[w] for w in common], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([every]), pa.array([trained]), pa.array([counts], pa.list_(pa.int64()))], ["every", "trained", "counts"]
        )

    # One row per task, added up before anything reaches the driver.
    rows = keyed.select("text", "train").mapInArrow(count, "every bigint, trained bigint, counts array<bigint>")
    sums = rows.agg(
        F.sum("every").alias("every"), F.sum("trained").alias("trained"),
        *[F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(len(common))],
    ).first()
    return sums["every"] or 0, sums["trained"] or 0, {w: sums[f"c{i}"] or 0 for i, w in enumerate(common)}


def _packs(batches: Iterator[pa.RecordBatch]):
    """Texts in groups of about ``PACK_TOKENS`` tokens: key, id, train, token hashes."""
    group, tokens = [], 0
    for batch in batches:
        columns = [batch.column(i) for i in range(3)]
        for k, doc_id, train, text in zip(*[c.to_pylist() for c in columns], batch.column(3)):
            words = words_of(text.as_py())
            group.append((k, doc_id, train, _hashes(words)))
            tokens += len(words) + 1
            if tokens >= PACK_TOKENS or len(group) >= 60_000:
                yield group
                group, tokens = [], 0
    if group:
        yield group


def _by_bucket(buckets: int, keys: np.ndarray, *columns: np.ndarray):
    """Bucket of a text's key, and the keys and columns of its texts, for every bucket."""
    bucket = (_spread(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    for number, start, end in _slices(bucket[order]):
        some = order[start:end]
        yield number, keys[some], *[c[some] for c in columns]


def _slices(part: np.ndarray):
    """Start and end of each part in a sorted array of parts."""
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, int)
    for start, end in zip(starts, np.append(starts[1:], len(part))):
        yield int(part[start]), start, end


def _deal_pairs(keyed: DataFrame, common: list[bytes], parts: int) -> DataFrame:
    """``part, payload``: the pairs of all texts, packed by the part of their context."""
    common_hashes = np.sort(np.append(_hashes(common), _BEGIN_HASH))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _packs(batches):
            context = np.concatenate([np.concatenate([[_BEGIN_HASH], h]) for *_, h in group])
            follower = np.concatenate([np.concatenate([h, [_END_HASH]]) for *_, h in group])
            doc = np.repeat(np.arange(len(group)), [len(h) + 1 for *_, h in group])
            at = np.minimum(np.searchsorted(common_hashes, context), len(common_hashes) - 1)
            salt = np.where(common_hashes[at] == context, _spread(follower), np.uint64(0))
            part = (_spread(context ^ salt) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((context, part))
            context, follower, doc, part = context[order], follower[order], doc[order], part[order]
            keys = np.array([g[0] for g in group], np.int64)
            trains = np.array([g[2] for g in group], np.uint8)
            numbers, payloads = [], []
            for number, start, end in _slices(part):
                present, place = np.unique(doc[start:end], return_inverse=True)
                names, sizes = np.unique(context[start:end], return_counts=True)
                held_out = trains[doc[start:end]] == 0
                numbers.append(number)
                payloads.append(_pack(
                    keys[present], trains[present], names, sizes.astype(np.uint32), place.astype(np.uint16),
                    (follower[start:end] >> _LOW).astype(np.uint32), follower[start:end][held_out].astype(np.uint32),
                ))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], ["part", "payload"])

    return keyed.mapInArrow(deal, "part int, payload binary")


def _score_pairs(
    dealt: DataFrame, common: dict[bytes, int], n_texts: int, parts: int, buckets: int, prior: float
) -> DataFrame:
    """Per part: sums of its texts, packed by bucket, and the unseen words, packed by their own part.

    ``kind`` 0: ``to`` is a bucket; 1: ``to`` is a part.
    """
    hashes = dict(zip(_hashes(list(common)).tolist(), common.values()))
    totals = hashes | {int(_BEGIN_HASH): n_texts}
    known = np.array(sorted(hashes), np.uint64)
    known_log = np.log10(np.array([hashes[int(h)] for h in known]) + 1.0)

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        keys, trains, contexts, followers, docs, lows, before = [], [], [], [], [], [], 0
        for raw in frame["payload"]:
            k, train, names, sizes, place, high, low = _unpack(raw)
            keys.append(k), trains.append(train)
            contexts.append(np.repeat(names, sizes)), followers.append(high)
            docs.append(place.astype(np.int64) + before)
            full = np.zeros(len(place), np.uint64)
            full[train[place] == 0] = low
            lows.append(full)
            before += len(k)
        keys, trains = np.concatenate(keys), np.concatenate(trains)
        a, b, doc = np.concatenate(contexts), np.concatenate(followers), np.concatenate(docs)
        order = np.lexsort((b, a))
        a, b, doc, low = a[order], b[order], doc[order], np.concatenate(lows)[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        firsts, pair = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        counts = np.bincount(pair, trains[doc], len(firsts)).astype(np.int64)
        a, b = a[firsts], b[firsts]
        trained = counts > 0
        trie = BigramTrie(a[trained], b[trained], counts[trained], totals, prior)
        log10, seen = trie.look_up(a, b)
        sums = np.bincount(doc, log10[pair], len(keys))
        unseen = ~seen[pair]
        word = (b[pair[unseen]].astype(np.uint64) << _LOW) | low[unseen]
        owner = doc[unseen]
        at = np.minimum(np.searchsorted(known, word), len(known) - 1)
        is_known = known[at] == word
        sums += np.bincount(owner[is_known], known_log[at[is_known]], len(keys))
        n_unseen = np.bincount(owner, minlength=len(keys))
        word, owner = word[~is_known], owner[~is_known]
        to = (_spread(word) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        rows = [
            (number, 0, _pack(*arrays)) for number, *arrays in _by_bucket(buckets, keys, sums, n_unseen)
        ]
        for number, start, end in _slices(to[order]):
            some = order[start:end]
            rows.append((number, 1, _pack(keys[owner[some]], word[some])))
        return pd.DataFrame(rows, columns=["to", "kind", "payload"])

    return dealt.groupBy("part").applyInPandas(score, "to int, kind int, payload binary")


def _deal_words(keyed: DataFrame, common: dict[bytes, int], parts: int) -> DataFrame:
    """The other words of all texts, packed by their part, and what each text has of common ones.

    Parts below 0 hold the texts themselves, to be handed on.
    """
    hashes = dict(zip(_hashes(list(common)).tolist(), common.values()))
    known = np.array(sorted(hashes), np.uint64)
    count = np.array([hashes[int(h)] for h in known], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _packs(batches):
            word = np.concatenate([np.append(h, _END_HASH) for *_, h in group])
            doc = np.repeat(np.arange(len(group)), [len(h) + 1 for *_, h in group])
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            is_known = known[at] == word
            log10 = np.bincount(doc[is_known], np.log10(count[at[is_known]] + 1.0), len(group))
            n_known = np.bincount(doc[is_known], count[at[is_known]] > 0, len(group)).astype(np.int64)
            keys = np.array([g[0] for g in group], np.int64)
            trains = np.array([g[2] for g in group], np.uint8)
            no_id = np.array([g[1] is None for g in group], np.uint8)
            ids = np.array([g[1] or 0 for g in group], np.int64)
            sizes = np.array([len(h) + 1 for *_, h in group], np.int64)
            numbers = [-1 - int(keys[0] % parts)]
            payloads = [_pack(keys, ids, no_id, trains, sizes, log10, n_known)]
            word, doc = word[~is_known], doc[~is_known]
            part = (_spread(word) % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((doc, word, part))
            word, doc, part = word[order], doc[order], part[order]
            for number, start, end in _slices(part):
                present, place = np.unique(doc[start:end], return_inverse=True)
                names, times = np.unique(word[start:end], return_counts=True)
                numbers.append(number)
                payloads.append(_pack(keys[present], trains[present], names, times.astype(np.uint32), place.astype(np.uint16)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array([0] * len(numbers), pa.int32()), pa.array(payloads, pa.binary())],
                ["part", "kind", "payload"],
            )

    return keyed.mapInArrow(deal, "part int, kind int, payload binary")


def _score_words(dealt: DataFrame, buckets: int) -> DataFrame:
    """Per part: its distinct training words, and sums of log10(count + 1) per text.

    The sums are packed by bucket: ``kind`` 0 with the number of known tokens, 1 for
    words that pairs handed on, 2 for the texts themselves.
    """

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if frame["part"].iloc[0] < 0:
            for raw in frame["payload"]:
                keys, *columns = _unpack(raw)
                rows += [(number, 2, _pack(*a), 0) for number, *a in _by_bucket(buckets, keys, *columns)]
            return pd.DataFrame(rows, columns=["to", "kind", "payload", "words"])
        names, times, docs, keys, trains, before = [], [], [], [], [], 0
        for raw in frame.loc[frame["kind"] == 0, "payload"]:
            k, train, n, t, place = _unpack(raw)
            names.append(n), times.append(t), docs.append(place.astype(np.int64) + before)
            keys.append(k), trains.append(train)
            before += len(k)
        join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.empty(0, kind)
        keys, trains, doc = join(keys, np.int64), join(trains, np.uint8), join(docs, np.int64)
        word = np.repeat(join(names, np.uint64), join(times, np.uint32))
        distinct, which = np.unique(word, return_inverse=True)
        counts = np.bincount(which, trains[doc], len(distinct)).astype(np.int64)
        log10 = np.log10(counts + 1.0)
        sums = np.bincount(doc, log10[which], len(keys))
        known = np.bincount(doc, counts[which] > 0, len(keys)).astype(np.int64)
        rows += [(number, 0, _pack(*a), 0) for number, *a in _by_bucket(buckets, keys, sums, known)]
        for raw in frame.loc[frame["kind"] == 1, "payload"]:
            k, w = _unpack(raw)
            owner, place = np.unique(k, return_inverse=True)
            value = np.bincount(place, log10[np.searchsorted(distinct, w)])
            rows += [(number, 1, _pack(*a), 0) for number, *a in _by_bucket(buckets, owner, value)]
        rows.append((-1, -1, b"", int((counts > 0).sum())))
        return pd.DataFrame(rows, columns=["to", "kind", "payload", "words"])

    return dealt.groupBy("part").applyInPandas(score, "to int, kind int, payload binary, words bigint")


def _totals(pairs: DataFrame, words: DataFrame, n_train: int, shift: float) -> DataFrame:
    """One row per document row from the packed sums of its bucket."""

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        def added(source: str, kind: int, n: int) -> tuple[np.ndarray, ...]:
            """Sums of the columns for every text, in the order of ``keys``."""
            found = [_unpack(raw) for raw in frame.loc[(frame["source"] == source) & (frame["kind"] == kind), "payload"]]
            if not found:
                return tuple(np.zeros(len(keys)) for _ in range(n))
            at = np.searchsorted(keys, np.concatenate([f[0] for f in found]))
            return tuple(np.bincount(at, np.concatenate([f[i] for f in found]), len(keys)) for i in range(1, n + 1))

        texts = [_unpack(raw) for raw in frame.loc[frame["kind"] == 2, "payload"]]
        k, ids, no_id, trains, sizes, common, n_common = (np.concatenate(c) for c in zip(*texts))
        # Rows alike in id and text share a key, and its sums hold all of them.
        keys, row, times = np.unique(k, return_inverse=True, return_counts=True)
        scores, unseen = added("pairs", 0, 2)
        base, known = added("words", 0, 2)
        (back,) = added("words", 1, 1)
        each = lambda sums: (sums / times)[row]
        return pd.DataFrame({
            "doc_id": pd.array([None if gone else int(i) for i, gone in zip(ids, no_id)], "Int64"),
            "trained": trains.astype(bool), "n_tokens": sizes,
            "n_known": np.rint(each(known)).astype(np.int64) + n_common, "train_tokens": n_train,
            "base_score": each(base) + common - sizes * shift,
            "score": each(scores) + each(back) - each(unseen) * shift,
        })

    schema = (
        "doc_id bigint, trained boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    packed = pairs.filter("kind = 0").select("to", "kind", "payload", F.lit("pairs").alias("source")).unionByName(
        words.filter("kind >= 0").select("to", "kind", "payload", F.lit("words").alias("source"))
    )
    return packed.groupBy("to").applyInPandas(total, schema)


def score_documents(docs: DataFrame, train: Column, prior: float = PRIOR) -> DataFrame:
    """Scores of every whole text under a bigram and a unigram model of the training texts.

    Gives ``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score``. Tokens are
    words, A-Z lower-cased, and one end per text; a NULL text is empty and has the end
    alone. ``base_score`` adds log10((c + 1) / (N + V + 1)) with the count c of the token, N
    tokens and V distinct ones in the rows that ``train`` admits; ``score`` is the
    bigram model's log10 probability, backing off to the same unigrams. Without training rows
    both fall back to the counts being 0. Repeated rows train as often as they occur and get
    equal results. ``doc_id`` must be a whole number or NULL; an empty table gives an empty
    result, and only ``doc_id``, ``text`` and what ``train`` needs are read.
    """
    keyed = _keyed(docs, train)
    common_words = _common_words(keyed)
    every, n_train, common = _training_counts(keyed, common_words)
    parts = max(LEAST_PARTS, math.ceil(every / PART_TOKENS))
    # Texts are added up in buckets of about as many tokens as were packed together.
    buckets = max(1, math.ceil(every / PACK_TOKENS))
    dealt_pairs = _deal_pairs(keyed, common_words, parts)
    pairs = materialize(_score_pairs(dealt_pairs, common, common[_END], parts, buckets, prior), "pair-scores")
    forwarded = pairs.filter("kind = 1").select(F.col("to").alias("part"), "kind", "payload")
    dealt_words = _deal_words(keyed, common, parts).unionByName(forwarded)
    words = materialize(_score_words(dealt_words, buckets), "word-scores")
    distinct = (words.agg(F.sum("words")).first()[0] or 0) + sum(n > 0 for n in common.values())
    return _totals(pairs, words, n_train, math.log10(n_train + distinct + 1))


def held_out(modulus: int = 7, remainder: int = 2) -> Column:
    """Whether a row is kept from training."""
    return fold(F.col("doc_id"), modulus) == remainder
