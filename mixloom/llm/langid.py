"""Operator 5: language identification by unigrams summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary of byte
strings. A word's probability is the sum over all ways to cut it into pieces, which
the forward algorithm gives in one pass; the pieces' probabilities are fitted by
expectation maximisation over the same sums, on a sample of stated size per language.
Every piece of the vocabulary counts, and a word of any length is one word: it is read
in stretches, and the sums as far back as the longest piece go on into the next one.
A text is scored whole, word by word; each batch computes a word type once, for all
languages and many words together.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.llm.common import fold, tokenizer_path
from mixloom.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Documents per language that the fit looks at, about; drawn by a hash of the id.
TRAINING_DOCS = 500
ROUNDS = 4
SMOOTHING = 0.1
# Bytes of the vocabulary's longest piece, and of a stretch looked up at once. Neither
# changes a result.
PIECE_BYTES = 33
STRETCH_BYTES = 48
UNKNOWN = "und"
# Words at once, and bytes of words whose sums are all kept during the fit.
_CHUNK = 4096
_CELLS = 1 << 18
_FILTER_BITS = 16
_TEXTS_AT_ONCE = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 400_000

_LETTER = regex.compile(r"\p{L}")


def read_pieces(path: str) -> list[bytes]:
    """All byte strings of the vocabulary, in rank order, and the single bytes it lacks."""
    with open(path, "rb") as file:
        known = [base64.b64decode(line.split()[0]) for line in file if line.strip()]
    single = {bytes([b]) for b in range(256)}
    return known + sorted(single - set(known))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _as_bytes(word: str) -> bytes:
    """A word with the space before it."""
    return (" " + word).encode("utf-8", "replace")


class Segmenter:
    """Finds the pieces at every place of many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # By length, whether a piece's hash may begin with these bits.
        self.likely: dict[int, np.ndarray] = {}
        self.shift = np.uint64(64 - _FILTER_BITS)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        for length, ids in by_length.items():
            table = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(len(ids), length)
            keys = self._prefixes(table)[:, -1]
            order = np.argsort(keys)
            self.tables[length] = (keys[order], np.array(ids, dtype=np.int64)[order])
            self.likely[length] = np.zeros(1 << _FILTER_BITS, dtype=bool)
            self.likely[length][keys >> self.shift] = True
        self.longest = max(self.tables)
        self.power = {n: np.uint64(pow(int(_BASE), n, 2**64)) for n in self.tables}

    @staticmethod
    def _prefixes(table: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes of every row."""
        out = np.zeros((table.shape[0], table.shape[1] + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for t in range(table.shape[1]):
                out[:, t + 1] = out[:, t] * _BASE + (table[:, t].astype(np.uint64) + np.uint64(1))
        return out

    def matches(self, words: list[bytes], start: int, stop: int) -> list[tuple[np.ndarray, ...]]:
        """The pieces that end after byte ``start`` and up to ``stop``, by their end.

        One entry for each end: words, in order, the places where the pieces begin, and
        the pieces. A piece may begin before the stretch.
        """
        lengths = np.array([len(w) for w in words])
        stop = min(stop, int(lengths.max()))
        base = max(0, start + 1 - self.longest)
        rows = b"".join(w[base:stop].ljust(stop - base, b"\0") for w in words)
        prefixes = self._prefixes(np.frombuffer(rows, np.uint8).reshape(len(words), stop - base)).T.copy()
        found = []
        for n, (keys, ids) in sorted(self.tables.items()):
            first, last = max(base, start + 1 - n) - base, stop - n - base
            if last < first:
                continue
            with np.errstate(over="ignore"):
                hashes = prefixes[first + n : last + n + 1] - prefixes[first : last + 1] * self.power[n]
            begin, word = np.nonzero(self.likely[n][hashes >> self.shift])
            hashes = hashes[begin, word]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            begin += first + base
            good = (keys[at] == hashes) & (begin + n <= lengths[word])
            found.append((begin[good] + n, word[good], begin[good], ids[at[good]]))
        end, word, begin, piece = (np.concatenate(part) for part in zip(*found))
        order = np.argsort(end * len(words) + word, kind="stable")
        bounds = np.searchsorted(end[order], np.arange(start + 1, stop + 2))
        columns = word[order], begin[order], piece[order]
        return [tuple(c[i:j] for c in columns) for i, j in zip(bounds[:-1], bounds[1:])]

    @staticmethod
    def forward(found, sums: np.ndarray, start: int, base: int, logs: np.ndarray) -> None:
        """Log sums over the segmentations of the prefixes that end in one stretch.

        ``sums`` has rows by prefix length from ``base`` on, words in order of their
        length, and languages; ``logs`` has pieces by languages.
        """
        for end, (word, begin, piece) in enumerate(found, start + 1):
            # Every single byte is a piece, so the words that reach this end are the last ones.
            value = sums[begin - base, word] + logs[piece]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            most = np.maximum.reduceat(value, first)
            total = np.add.reduceat(np.exp(value - most[word - word[0]]), first)
            sums[end - base, word[0] :] = most + np.log(total)

    def log_chance(self, words: list[bytes], chance: np.ndarray) -> np.ndarray:
        """Log probability of every word in every language."""
        out = np.zeros((len(words), chance.shape[1]))
        logs = _log(chance)
        order = np.argsort([len(w) for w in words], kind="stable")
        for chunk in range(0, len(words), _CHUNK):
            some = order[chunk : chunk + _CHUNK]
            lengths = np.array([len(words[i]) for i in some])
            some, lengths = some[lengths > 0], lengths[lengths > 0]
            sums, base, start = np.zeros((1, len(some), chance.shape[1])), 0, 0
            while len(some):
                stop = min(start + STRETCH_BYTES, int(lengths[-1]))
                # The rows as far back as a piece reaches, and those of this stretch.
                back = max(base, start + 1 - self.longest)
                sums = np.concatenate([sums[back - base :], np.zeros((stop - start, *sums.shape[1:]))])
                base = back
                self.forward(self.matches([words[i] for i in some], start, stop), sums, start, base, logs)
                done = int(np.searchsorted(lengths, stop, side="right"))
                out[some[:done]] = sums[lengths[:done] - base, np.arange(done)]
                some, lengths, sums, start = some[done:], lengths[done:], sums[:, done:], stop
        return out

    def _fit_chunks(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Places of words in order of length, few enough that all their sums are kept."""
        order = [i for i in sorted(range(len(words)), key=lambda i: len(words[i])) if words[i]]
        chunk: list[int] = []
        for i in order:
            if chunk and (len(chunk) == _CHUNK or (len(chunk) + 1) * len(words[i]) > _CELLS):
                yield np.array(chunk)
                chunk = []
            chunk.append(i)
        if chunk:
            yield np.array(chunk)

    def expected_counts(self, words: list[bytes], weights: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over all segmentations, for one language."""
        counts = np.zeros(self.size)
        logs = _log(chance)
        for some in self._fit_chunks(words):
            chunk, weight = [words[i] for i in some], weights[some]
            lengths, places = np.array([len(w) for w in chunk]), np.arange(len(chunk))
            width = int(lengths[-1])
            ahead = np.zeros((width + 1, len(chunk), 1))
            starts = range(0, width, STRETCH_BYTES)
            for start in starts:
                # A stretch is looked up for the words that reach it.
                from_word = int(np.searchsorted(lengths, start, side="right"))
                found = self.matches(chunk[from_word:], start, start + STRETCH_BYTES)
                self.forward(found, ahead[:, from_word:], start, 0, logs[:, None])
            ahead = ahead[:, :, 0]
            behind = np.full_like(ahead, -np.inf)
            behind[lengths, places] = 0.0
            whole = ahead[lengths, places]
            for start in reversed(starts):
                if start != starts[-1]:
                    from_word = int(np.searchsorted(lengths, start, side="right"))
                    found = self.matches(chunk[from_word:], start, start + STRETCH_BYTES)
                for end in range(start + len(found), start, -1):
                    word, begin, piece = found[end - start - 1]
                    word = word + from_word
                    value = behind[end, word] + logs[piece]
                    behind[begin, word] = np.logaddexp(behind[begin, word], value)
                word, begin, piece = (np.concatenate(part) for part in zip(*found))
                word = word + from_word
                end = np.repeat(np.arange(start + 1, start + len(found) + 1), [len(f[0]) for f in found])
                use = np.exp(ahead[begin, word] + logs[piece] + behind[end, word] - whole[word])
                counts += np.bincount(piece, use * weight[word], self.size)
        return counts


def _log(chance: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(chance)


def _fit_language(segmenter: Segmenter, words: Iterable[str], counts: Iterable[float]) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation."""
    uses_of: Counter = Counter()
    for word, n in zip(words, counts):
        uses_of[_as_bytes(word)] += n
    parts = sorted(uses_of)
    weights = np.array([uses_of[p] for p in parts], dtype=np.float64)
    chance = np.append(np.full(segmenter.size, 1.0 / segmenter.size), 0.0)
    for _ in range(ROUNDS if parts else 0):
        uses = segmenter.expected_counts(parts, weights, chance) + SMOOTHING
        chance[:-1] = uses / uses.sum()
    return chance[:-1]


def train(
    docs: DataFrame, usable: Column, lang: str = "lang", training_docs: int = TRAINING_DOCS,
    vocabulary_path: str | None = None,
) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from the rows that ``usable`` admits.

    Each language is fitted on about ``training_docs`` of its documents, drawn by a
    hash of the id; rows without a language or a text teach nothing.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(
        read_pieces(vocabulary_path or tokenizer_path(VOCABULARY))
    )
    known = docs.filter(usable & F.col(lang).isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", F.col(lang).cast("string").alias("lang")
    )
    position = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id"), 11) / F.lit(float(1 << 53))
    # One row per language.
    sizes = known.groupBy("lang").agg(F.count("*").alias("_n"))
    sample = known.join(F.broadcast(sizes), "lang").filter(position < training_docs / F.col("_n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, language in zip(batch.column(0), batch.column(1).to_pylist()):
                seen.setdefault(language, Counter()).update(words_of(text.as_py()))
            rows = [(lang, w, n) for lang, words in seen.items() for w, n in words.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
                ["lang", "word", "n"],
            )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        segmenter = Segmenter(pieces.value)
        frame = frame.sort_values("word")
        chance = _fit_language(segmenter, frame["word"], frame["n"])
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "chance": [chance.tobytes()]})

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint")
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = materialize(words.groupBy("lang").applyInPandas(fit, "lang string, chance binary"), "languages")
    rows = sorted(fitted.collect(), key=lambda r: r["lang"])
    if not rows:
        return [], np.zeros((len(pieces.value) + 1, 0))
    chance = np.column_stack([np.frombuffer(r["chance"], np.float64) for r in rows])
    return [r["lang"] for r in rows], np.vstack([chance, np.zeros((1, len(rows)))])


class Scorer:
    """Posterior languages of texts; remembers word types up to a bound."""

    def __init__(self, pieces: list[bytes], languages: list[str], chance: np.ndarray):
        self.segmenter, self.languages, self.chance = Segmenter(pieces), languages, chance
        self.row: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED, len(languages)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        logs = self.segmenter.log_chance([_as_bytes(word) for word in words], self.chance)
        # Only differences count; they are small where a long word's own logs are not.
        total = logs - logs.max(axis=1, keepdims=True)
        start = len(self.row)
        need = start + len(words)
        if need > len(self.table):
            self.table = np.vstack([self.table, np.zeros((need - len(self.table), self.table.shape[1]), np.float32)])
        self.table[start:need] = total
        for i, word in enumerate(words):
            self.row[word] = start + i

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Languages and scores; texts without a letter have neither."""
        languages, scores = [], []
        for start in range(0, len(texts), _TEXTS_AT_ONCE):
            some = [words_of(t) if t and _LETTER.search(t) else [] for t in texts[start : start + _TEXTS_AT_ONCE]]
            if self.languages:
                self._learn_new(some)
            for words in some:
                if not words or not self.languages:
                    languages.append(UNKNOWN), scores.append(0.0)
                    continue
                rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
                logs = self.table[rows].sum(axis=0, dtype=np.float64)
                odds = np.exp(logs - logs.max())
                best = int(odds.argmax())
                languages.append(self.languages[best]), scores.append(float(odds[best] / odds.sum()))
        return languages, scores

    def _learn_new(self, texts: list[list[str]]) -> None:
        """Know all words of these texts; forget the earlier ones when there are too many."""
        wanted = set().union(*texts)
        new = wanted.difference(self.row)
        if len(self.row) + len(new) > REMEMBERED:
            self.row.clear()
            new = wanted
        if new:
            self._learn(list(new))


def predict_language(docs: DataFrame, languages: list[str], chance: np.ndarray, vocabulary_path: str | None = None) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, every whole text read.

    ``lang_pred`` is ``und`` with score 0 for a NULL text, a text without a letter, or when no
    language was learned. The score is the posterior of the predicted language, all
    languages alike beforehand; ties go to the language first in order. Other columns
    are kept, repeated rows get equal results, columns of these two names are replaced.
    """
    context = docs.sparkSession.sparkContext
    model = context.broadcast((read_pieces(vocabulary_path or tokenizer_path(VOCABULARY)), languages, chance))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*model.value)
        for texts in batches:
            found, scores = scorer.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": found, "score": scores})

    own = docs.drop("lang_pred", "score")
    return own.withColumn("_predicted", predict("text")).select(*own.columns, "_predicted.*")


def held_out(modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept from the fit."""
    return fold(F.col("doc_id"), modulus) == remainder
