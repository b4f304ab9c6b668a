"""Operator 2: toxicity by boosted trees over dense features of the text, calibrated.

The lexicon is learned, not given: words and word beginnings that stand in many toxic
training documents and in hardly any other. An automaton finds them in a whole
text in one pass; the other features are densities counted over the text's bytes.
Trees and calibration are fitted on a sample of labelled rows of a stated size; every
text is read whole and scored where it lies, without a shuffle.

Training rows fall into three folds. A row's lexicon features use a lexicon from the
other two, so they are as honest as those of new texts; trees come from two folds and
the isotonic calibration from the third.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.llm.boosting import BoostedTrees, Isotonic, boost, isotonic
from mixloom.llm.common import fold
from mixloom.session import materialize

# Labelled rows that the fit looks at, about; the sample is drawn by a hash of the id.
TRAINING_ROWS = 8_000
LEXICON_ENTRIES = 2_000
LEAST_LOG_ODDS = 3.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
NEAR_CHARS = 40
FOLDS = 3

# Second-person pronouns of the larger European languages.
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros os"
).split()

FEATURES = (
    "lexicon_density lexicon_weight lexicon_kinds lexicon_hits near_second_person second_person capitals "
    "capital_runs exclamations questions punctuation punctuation_runs symbols_inside digits_inside "
    "letter_runs digits non_ascii mean_word log_words"
).split()

_WORD = re.compile(r"[^\W\d_]+")


def _byte_classes() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 white space, 6 non-ASCII."""
    table = np.zeros(256, dtype=np.uint8)
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
    table[[9, 10, 11, 12, 13, 32]] = 5
    table[128:] = 6
    return table


_CLASS = _byte_classes()


class Features:
    """Dense features of texts under one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        """``lexicon``: weights of words, and of word beginnings written with a final ``*``."""
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for entry, weight in lexicon.items():
            stem = entry.rstrip("*")
            entries.setdefault(stem, []).append((weight, entry.endswith("*")))
        for word in SECOND_PERSON:
            entries.setdefault(word, []).append((None, False))
        for stem, kinds in entries.items():
            self.automaton.add_word(stem, (len(stem), stem, kinds))
        self.automaton.make_automaton()

    def _matches(self, text: str) -> tuple[dict[int, float], set[str], list[int]]:
        hits: dict[int, float] = {}
        kinds_hit, second = set(), []
        end_of_text = len(text)
        for end, (size, stem, kinds) in self.automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha():
                continue
            ends_word = end + 1 == end_of_text or not text[end + 1].isalpha()
            for weight, is_prefix in kinds:
                if weight is None:
                    if ends_word:
                        second.append(start)
                elif is_prefix or ends_word:
                    hits[start] = max(weight, hits.get(start, 0.0))
                    kinds_hit.add(stem)
        return hits, kinds_hit, second

    def of(self, text: str) -> list[float]:
        raw = np.frombuffer(text.encode(), np.uint8)
        size = max(len(raw), 1)
        kind = _CLASS[raw]
        counts = np.bincount(kind, minlength=7)
        letter = (kind == 1) | (kind == 2) | (kind == 6)
        space = kind == 5
        words = int(len(raw) and (~space[0]) + np.count_nonzero(space[:-1] & ~space[1:]))
        per_word = max(words, 1)
        between = letter[:-2] & letter[2:]
        upper, mark = kind == 2, kind == 4
        hits, kinds, second = self._matches(text.lower())
        near = 0
        if hits and second:
            places = np.array(second)
            starts = np.fromiter(hits, dtype=np.int64)
            at = np.searchsorted(places, starts)
            before = starts - places[np.maximum(at - 1, 0)]
            after = places[np.minimum(at, len(places) - 1)] - starts
            near = np.count_nonzero((np.abs(before) <= NEAR_CHARS) | (np.abs(after) <= NEAR_CHARS))
        return [
            100 * len(hits) / per_word, 100 * sum(hits.values()) / per_word, float(len(kinds)), math.log1p(len(hits)),
            near / max(len(hits), 1), 100 * len(second) / per_word, counts[2] / size,
            np.count_nonzero(upper[:-1] & upper[1:]) / size,
            np.count_nonzero(raw == 33) / per_word, np.count_nonzero(raw == 63) / per_word,
            counts[4] / size, np.count_nonzero(mark[:-1] & mark[1:]) / size,
            np.count_nonzero(mark[1:-1] & between) / per_word, np.count_nonzero((kind[1:-1] == 3) & between) / per_word,
            np.count_nonzero((raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & letter[1:-1]) / per_word,
            counts[3] / size, counts[6] / size, (size - counts[5]) / per_word, math.log1p(words),
        ]

    def table(self, texts) -> np.ndarray:
        rows = [self.of(t or "") for t in texts]
        return np.array(rows, dtype=np.float64).reshape(len(rows), len(FEATURES))


@dataclass(frozen=True)
class Model:
    """Lexicon, trees and calibration; without a fit, the share of toxic training rows."""

    lexicon: dict[str, float]
    trees: BoostedTrees | None
    calibration: Isotonic | None
    share: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.share)
        raw = self.trees.probability(features)
        # The last hundredth keeps the order of texts that share a calibrated step.
        return 0.99 * self.calibration(raw) + 0.01 * raw


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """About ``rows`` labelled texts with ``y`` and ``part`` (fold), drawn by a hash of the id."""
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    total = known.count()
    position = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / F.lit(float(1 << 53))
    chosen = known.filter(position < rows / max(total, 1)).withColumn(
        "part", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    )
    # At most about ``rows`` ids and labels, whatever the corpus: small enough to send.
    return materialize(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y", "part"),
        "toxicity-sample",
    )


def _entry_counts(sample: DataFrame) -> DataFrame:
    """In how many toxic and other training documents of each fold an entry stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, y, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                entries = {w[:n] + "*" for w in words for n in PREFIXES if len(w) > n} | words
                seen.update((e, part, y) for e in entries)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())],
                ["entry", "part", "y", "n"],
            )

    return sample.select("text", "y", "part").mapInArrow(count, "entry string, part int, y int, n bigint")


def learn_lexicons(sample: DataFrame, folds: int = FOLDS) -> list[dict[str, float]]:
    """A lexicon without each fold, and last the one from all; each of bounded size."""
    sizes = {(r["part"], r["y"]): r["count"] for r in sample.groupBy("part", "y").count().collect()}
    counted = _entry_counts(sample).groupBy("entry", "part", "y").agg(F.sum("n").alias("n"))
    columns = [
        F.sum(F.when((F.col("part") == p) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{p}{y}")
        for p in range(folds) for y in (0, 1)
    ]
    table = materialize(counted.groupBy("entry").agg(*columns), "lexicon-counts")
    lexicons = []
    for left_out in [*range(folds), None]:
        parts = [p for p in range(folds) if p != left_out]
        toxic, other = (sum((F.col(f"n{p}{y}") for p in parts), F.lit(0)) for y in (1, 0))
        n_toxic, n_other = (sum(sizes.get((p, y), 0) for p in parts) for y in (1, 0))
        weight = F.log((toxic + 0.5) / F.lit(n_toxic + 1.0)) - F.log((other + 0.5) / F.lit(n_other + 1.0))
        best = (
            table.select("entry", toxic.alias("toxic"), weight.alias("weight"))
            .filter((F.col("toxic") >= max(3, 0.01 * n_toxic)) & (F.col("weight") >= LEAST_LOG_ODDS))
            .orderBy(F.col("toxic").desc(), F.col("weight").desc(), "entry")
            .limit(LEXICON_ENTRIES)
        )
        lexicons.append({r["entry"]: r["weight"] for r in best.collect()})
    return lexicons


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    """A model from about ``rows`` of the labelled rows that ``usable`` (over the labels) admits."""
    sample = training_sample(docs, labels, label, usable, rows)
    lexicons = learn_lexicons(sample)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part = [Features(x) for x in lexicons[:-1]]
        for batch in batches:
            parts = batch.column(2).to_pylist()
            rows = [by_part[p].of(t.as_py() or "") for t, p in zip(batch.column(0), parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["y", "part", "x"]
            )

    # Bounded by the sample size: a few numbers per training row.
    fitted = sample.select("text", "y", "part").mapInArrow(compute, "y int, part int, x array<double>").toPandas()
    fitted = fitted.sort_values(["part", "y", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c)
    y, part = fitted["y"].to_numpy(np.float64), fitted["part"].to_numpy()
    x = np.array(fitted["x"].tolist(), dtype=np.float64).reshape(len(y), len(FEATURES))
    trees_on, calibrated_on = part != FOLDS - 1, part == FOLDS - 1
    share = float(y.mean()) if len(y) else 0.0
    if len(np.unique(y[trees_on])) < 2:
        return Model(lexicons[-1], None, None, share)
    trees = boost(x[trees_on], y[trees_on])
    if len(np.unique(y[calibrated_on])) < 2:
        calibrated_on = trees_on
    return Model(lexicons[-1], trees, isotonic(trees.probability(x[calibrated_on]), y[calibrated_on]), share)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` for every whole text.

    A NULL text is scored as an empty one. Rows are independent, so repeated rows
    get equal scores; only ``doc_id`` and ``text`` are read. A model from no or one-sided
    labels gives every text the share of toxic training rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value.lexicon)
        for batch in batches:
            scores = shared.value.score(features.table(t.as_py() for t in batch.column(1)))
            scores = np.clip(scores, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {key}, score double, predicted int")


def held_out(modulus: int = 3, remainder: int = 1) -> Column:
    """Whether a row's label is kept from the fit."""
    return fold(F.col("doc_id"), modulus) == remainder
