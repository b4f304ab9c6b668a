"""Operator 3: shards and slots of a reproducible shuffle that can be computed.

Global row numbers run through a Feistel permutation of exactly 0 … n-1. The
permuted number modulo the shard count is the shard, its quotient the slot, so
shard sizes differ by one row at most, slots have no gap, and both directions
(row to place, place to row) are arithmetic: no shuffled copy has to exist.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.llm.common import number_rows

ROUNDS = 6
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def _mix(values: np.ndarray, key: int) -> np.ndarray:
    """A well-spread 64-bit function of the values under a round key."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + _GOLDEN * np.uint64(key % 2**64)
        z = (z ^ (z >> np.uint64(30))) * _MIX_A
        z = (z ^ (z >> np.uint64(27))) * _MIX_B
        return z ^ (z >> np.uint64(31))


def _round_keys(seed: int) -> list[int]:
    return [int(k) for k in _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64), seed * 2 + 1)]


def _halves(n: int) -> tuple[int, int]:
    """A grid of at least n cells whose excess is below its number of rows."""
    left = math.isqrt(max(n - 1, 0)) + 1
    return left, -(-n // left)


def _forward(x: np.ndarray, left: int, right: int, keys: list[int]) -> np.ndarray:
    a, b = x // right, x % right
    for i, key in enumerate(keys):
        if i % 2:
            b = (b + (_mix(a, key) % np.uint64(right)).astype(np.int64)) % right
        else:
            a = (a + (_mix(b, key) % np.uint64(left)).astype(np.int64)) % left
    return a * right + b


def _backward(x: np.ndarray, left: int, right: int, keys: list[int]) -> np.ndarray:
    a, b = x // right, x % right
    for i in reversed(range(len(keys))):
        if i % 2:
            b = (b - (_mix(a, keys[i]) % np.uint64(right)).astype(np.int64)) % right
        else:
            a = (a - (_mix(b, keys[i]) % np.uint64(left)).astype(np.int64)) % left
    return a * right + b


def _walk(step, x, n: int, seed: int) -> np.ndarray:
    """Apply the step until every value is below n again (cycle walking)."""
    out = np.array(x, dtype=np.int64)
    if n == 0 or not len(out):
        return out
    left, right = _halves(n)
    keys = _round_keys(seed)
    outside = np.ones(len(out), dtype=bool)
    while outside.any():
        out[outside] = step(out[outside], left, right, keys)
        outside = out >= n
    return out


def permute(numbers, n: int, seed: int = 0) -> np.ndarray:
    """Where the row numbers go in the shuffle of 0 … n-1."""
    return _walk(_forward, numbers, n, seed)


def unpermute(places, n: int, seed: int = 0) -> np.ndarray:
    """The row numbers at these places of the shuffle."""
    return _walk(_backward, places, n, seed)


def place_of(numbers, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    places = permute(numbers, n, seed)
    return places % shards, places // shards


def number_at(shard, slot, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The row number that sits in a slot of a shard."""
    return unpermute(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard), n, seed)


def permuted(number: Column, n: int, seed: int = 0) -> Column:
    """The permutation as a column."""

    @F.pandas_udf("bigint")
    def apply(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(np.int64), n, seed))

    return apply(number)


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Every row with its global ``number`` and its ``shard`` and ``slot``.

    Rows are numbered in the given order, NULLs first. Rows that are equal in all
    order columns are interchangeable: they take neighbouring numbers in any
    order, and the set of results is the same on every run. An empty table gives
    an empty result. Columns named ``number``, ``shard`` or ``slot`` are replaced.
    Only the columns given are moved, so pass keys and digests, not texts.
    """
    if shards < 1:
        raise ValueError(f"shards={shards} must be at least 1")
    own = df.drop("number", "shard", "slot")
    # The last column spreads rows that are equal in every other one.
    spread = own.withColumn("_tie", F.monotonically_increasing_id())
    numbered = number_rows(spread, *order, "_tie", name="shard-rows").drop("_tie")
    n = numbered.count()
    place = permuted(F.col("_number"), n, seed)
    return (
        numbered.withColumn("_place", place)
        .withColumns({
            "number": F.col("_number"),
            "shard": (F.col("_place") % shards).cast("int"),
            "slot": F.call_function("div", F.col("_place"), F.lit(shards).cast("bigint")),
        })
        .drop("_number", "_place")
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """What places a document: its id, size and checksum, without the text.

    The size is the text's UTF-8 bytes plus 16; a NULL text has no bytes and
    the checksum of the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
