"""Limits, seeded shuffle, exact train/test split and distributed ranks.

Nothing here ranks a whole table in one task. An exact cut (the first k rows of
an order) is found by counting into a bounded number of value ranges, so the
result is a plain filter on the order column; an exact rank is an offset per
bounded group plus the position inside the group.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from mixloom.session import materialize

HASH_DIGITS = 15
HASH_SPACE = 16**HASH_DIGITS

# Bounds of what a selection brings to the driver or a rank keeps in one group.
HISTOGRAM_BUCKETS = 65_536
DRIVER_ROWS = 10_000
GROUP_ROWS = 200_000
MAX_GROUPS = 50_000


def hash_order(key: Column, seed: int | str) -> Column:
    """A reproducible pseudo-random 60-bit position of a key under a seed.

    It depends on the key's text alone, never on partitions or cluster size. A NULL
    key has the position of an empty text.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Cut:
    """The value at a rank: rows below it, and rows equal to it."""

    value: int
    below: int
    equal: int


def _range_counts(values: DataFrame, low: int, high: int) -> tuple[list[tuple[int, int]], int]:
    """Row counts of at most ``HISTOGRAM_BUCKETS`` equal ranges of [low, high]."""
    width = (high - low) // HISTOGRAM_BUCKETS + 1
    wide = F.col("v").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    offset = wide if high - low >= 2**63 else F.col("v") - F.lit(low).cast("bigint")
    counts = (
        values.filter(F.col("v").between(low, high))
        .select(F.call_function("div", offset, F.lit(width)).alias("b"))
        .groupBy("b")
        .count()
        .collect()
    )
    return sorted((int(r["b"]), r["count"]) for r in counts), width


def find_cut(df: DataFrame, value: Column, k: int | None = None, fraction: float | None = None,
             low: int | None = None, high: int | None = None) -> tuple[Cut | None, int]:
    """The k-th smallest of a whole-number column, and the number of rows.

    ``fraction`` gives k as a share of the rows, rounded up. Each pass counts
    rows per value range; the range holding the k-th row is refined until it is
    small enough to read. k is checked by the caller against the row count.
    """
    values = df.select(value.cast("bigint").alias("v"))
    if low is None or high is None:
        bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        if bounds["lo"] is None:
            return None, 0
        low, high = bounds["lo"], bounds["hi"]
    total, below = None, 0
    while True:
        counts, width = _range_counts(values, low, high)
        if total is None:
            total = sum(c for _, c in counts)
            if fraction is not None:
                k = math.ceil(fraction * total)
            if k < 1 or k > total:
                return None, total
        for bucket, count in counts:
            if below + count >= k:
                break
            below += count
        low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
        if low == high:
            return Cut(low, below, count), total
        if count <= DRIVER_ROWS:
            found = sorted(r["v"] for r in values.filter(F.col("v").between(low, high)).collect())
            cut = found[k - below - 1]
            return Cut(cut, below + sum(v < cut for v in found), found.count(cut)), total


# Bytes of a text that make one whole number.
PREFIX_BYTES = 7


def _text_value(rest: DataFrame, key: str) -> Column | None:
    """A whole number in the order of the rows' text keys that tells some apart; None if all are alike.

    All keys begin with what the least and the greatest share; the bytes after that count.
    """
    raw = F.coalesce(F.col(key), F.lit("")).cast("binary")
    ends = rest.agg(F.min(raw).alias("low"), F.max(raw).alias("high")).first()
    if ends["low"] == ends["high"]:
        return None
    shared = len(os.path.commonprefix([bytes(ends["low"]), bytes(ends["high"])]))
    if shared == len(ends["low"]):
        return (F.octet_length(raw) > shared).cast("bigint")
    piece = F.rpad(F.hex(F.substring(raw, shared + 1, PREFIX_BYTES)), 2 * PREFIX_BYTES, "0")
    return F.conv(piece, 16, 10).cast("bigint")


def _cuts(df: DataFrame, key: str, k: int, last: bool = False) -> Iterator[tuple[Column, Cut | None]]:
    """Whole numbers, none of them NULL, and where the first or last k rows end in each.

    First NULL or not, then the number itself or bytes of the text, as often as rows on the
    cut still differ in their key. Each number is for the rows on all earlier cuts.
    """
    def values() -> Iterator[Column]:
        yield F.col(key).isNotNull().cast("bigint")
        if _is_whole(df, key):
            yield F.coalesce(F.col(key).cast("bigint"), F.lit(0))
        else:
            while (value := _text_value(rest, key)) is not None:
                yield value

    rest, wanted = df, k
    for value in values():
        turned = F.bitwise_not(value) if last else value
        cut, _ = find_cut(rest, turned, k=wanted)
        yield turned, cut
        if cut is None or wanted - cut.below == cut.equal:
            return
        rest, wanted = rest.filter(turned == cut.value), wanted - cut.below


def _row_hash(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*plain)


def _take(df: DataFrame, key: str, k: int, last: bool = False) -> DataFrame:
    """Exactly k rows: the first of the key order, NULLs in front, or the last.

    The order's numbers are cut one after another: rows below a cut are taken, those on
    it are looked at more closely, up to the whole key. Of rows with one key those with
    small hashes are taken; any of rows that are the same in all columns.
    """
    taken, rest, wanted = [], df, k

    def with_rows() -> Iterator[tuple[Column, Cut | None]]:
        yield from _cuts(df, key, k, last)
        yield _row_hash(df), find_cut(rest, _row_hash(df), k=wanted)[0]

    for value, cut in with_rows():
        if cut is None:
            # No row, or fewer than wanted.
            return reduce(DataFrame.unionByName, [*taken, rest if wanted > 0 else rest.limit(0)])
        taken.append(rest.filter(value < cut.value))
        rest, wanted = rest.filter(value == cut.value), wanted - cut.below
        if wanted == cut.equal:
            return reduce(DataFrame.unionByName, [*taken, rest])
    return reduce(DataFrame.unionByName, [*taken, rest.limit(wanted)])


def _take_ranged(df: DataFrame, key: str, k: int) -> DataFrame:
    """Exactly the first k rows in the order of a key of any type, NULLs in front.

    Rows are range partitioned by the whole key, and written with their place; rows with
    one key are spread by their hash. One number per partition comes to the driver.
    """
    order = [F.col(key), F.col("_row")]
    placed = df.withColumn("_row", _row_hash(df)).repartitionByRange(*order).sortWithinPartitions(*order)
    low_bits = F.lit((1 << 33) - 1)
    written = materialize(
        placed.withColumns({
            "_piece": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(low_bits),
        }).drop("_row"),
        "ordered-rows",
    )
    sizes = sorted((r["_piece"], r["count"]) for r in written.groupBy("_piece").count().collect())
    within, wanted = F.lit(True), k
    for piece, size in sizes:
        if wanted < size:
            within = (F.col("_piece") < piece) | ((F.col("_piece") == piece) & (F.col("_at") < wanted))
            break
        wanted -= size
    return written.filter(within).drop("_piece", "_at")


def _is_whole(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, T.IntegralType)


def head(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """The first n rows in key order, NULLs first; no limit when n is None or 0.

    Rows that share the key at the cut are taken up to n, which ones does not matter. A
    small n is a top-n; a large one becomes filters, so that no task holds n rows, for
    whole-number and text keys; by keys of other types the rows are range partitioned.
    """
    if not n:
        return df
    if n <= DRIVER_ROWS:
        return df.orderBy(key).limit(n)
    cut_by_numbers = _is_whole(df, key) or isinstance(df.schema[key].dataType, T.StringType)
    return _take(df, key, n) if cut_by_numbers else _take_ranged(df, key, n)


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a seeded order that is the same on every cluster (a range sort)."""
    return df.orderBy(hash_order(F.col(key), seed), F.col(key))


def shuffle_rank(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The position (from 0) of every row in the seeded order, as ``rank``."""
    hashed = df.withColumn("_h", hash_order(F.col(key), seed))
    rows = df.count()
    pieces = math.ceil(rows / _group_rows(rows))
    cut = hashed.withColumn("_g", _piece(F.lit(pieces)))
    return _ranked(cut, key, ["_g"], [] if pieces > 1 else ["_g"])


def rank_in_band(df: DataFrame, band: Column, key: str, seed: int = 42) -> DataFrame:
    """The position of every row inside its ``band``, in seeded order, as ``rank``.

    A band of any size is cut into groups of neighbouring hashes of about
    ``GROUP_ROWS`` rows; the exact sizes of all earlier groups of the band give
    the group's offset. Bands and groups are counted over the key column alone,
    and the groups table is bounded by the number of bands plus ``MAX_GROUPS``.
    """
    hashed = df.select(
        "*", band.cast("bigint").alias("band"), hash_order(F.col(key), seed).alias("_h")
    )
    sizes = materialize(hashed.groupBy("band").agg(F.count("*").alias("_n")), "band-sizes")
    rows = sizes.agg(F.sum("_n")).first()[0] or 0
    group_rows = _group_rows(rows)
    if rows <= group_rows:
        return _ranked(hashed.withColumn("_g", F.lit(0)), key, ["band"], ["band"])
    cuts = sizes.select(F.col("band").alias("_b"), F.ceil(F.col("_n") / group_rows).alias("_cuts"))
    joined = hashed.join(_small(cuts), F.col("band").eqNullSafe(F.col("_b")))
    cut = joined.withColumn("_g", _piece(F.col("_cuts"))).drop("_cuts", "_b")
    return _ranked(cut, key, ["band", "_g"], ["band"])


def _group_rows(rows: int) -> int:
    return max(GROUP_ROWS, rows // MAX_GROUPS)


def _piece(pieces: Column) -> Column:
    """Which of so many equal ranges of the hash a row falls into."""
    return F.floor(F.col("_h") / F.lit(float(HASH_SPACE)) * pieces).cast("bigint")


def _ranked(df: DataFrame, key: str, group: list[str], band: list[str]) -> DataFrame:
    """Rows numbered inside their group, after all rows of the band's earlier groups."""
    inside = F.row_number().over(Window.partitionBy(*group).orderBy("_h", key)) - 1
    if group == band:
        return df.withColumn("rank", inside.cast("bigint")).drop("_h", "_g")
    groups = materialize(df.groupBy(*group).agg(F.count("*").alias("_n")), "group-sizes")
    before = Window.partitionBy(*band).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    of_group = {c: f"_of_{c}" for c in group}
    offsets = groups.select(
        *[F.col(c).alias(of_group[c]) for c in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(of_group[c])) for c in group])
    placed = df.join(_small(offsets), same)
    return placed.withColumn("rank", F.col("_before") + inside).drop("_h", "_g", "_before", *of_group.values())


def split(
    df: DataFrame,
    key: str,
    test_size: float | int = 0.1,
    seed: int = 42,
    shuffle: bool = True,
) -> DataFrame:
    """Tag every row ``train`` or ``test`` in a ``split`` column, with exact sizes.

    A fraction gives ceil(fraction * rows) test rows, a whole number that many.
    Shuffled, the test rows are those first in a seeded order; unshuffled they
    are the last rows in key order. A size of 0 or less tags everything train.
    The tag is a comparison with one value found by counting over the key
    column alone, so rows are neither moved nor sorted. Of rows that share the key at the
    cut those with small row hashes come first; rows that are the same in all columns,
    should the cut fall between them, are numbered as they are written.
    """
    if test_size <= 0:
        return df.withColumn("split", F.lit("train"))
    is_fraction = isinstance(test_size, float)
    if is_fraction and test_size >= 1:
        raise ValueError(f"test_size={test_size} must be below 1 or a whole number of rows")
    ordered = _is_whole(df, key) or isinstance(df.schema[key].dataType, T.StringType)
    if not shuffle and not ordered:
        raise TypeError("an unshuffled split needs a whole-number or a text key")
    if shuffle:
        value, bounds = hash_order(F.col(key), f"{seed}:split"), {"low": 0, "high": HASH_SPACE - 1}
        size = {"fraction": test_size} if is_fraction else {"k": test_size}
        cut, total = find_cut(df, value, **size, **bounds)
    else:
        total = df.count()
    k = math.ceil(test_size * total) if is_fraction else test_size
    if total == 0:
        return df.withColumn("split", F.lit("train"))
    if k >= total:
        raise ValueError(f"test_size={test_size} leaves no train rows of {total}")

    def cuts() -> Iterator[tuple[Column, Cut | None]]:
        rest, wanted = df, k
        if shuffle:
            yield value, cut
            rest, wanted = df.filter(value == cut.value), k - cut.below
        for number, at in _cuts(rest, key, wanted, last=not shuffle) if ordered else ():
            yield number, at
            rest, wanted = rest.filter(number == at.value), wanted - at.below
        yield _row_hash(df), find_cut(rest, _row_hash(df), k=wanted)[0]

    is_test, at_cut, wanted = F.lit(False), F.lit(True), k
    for number, at in cuts():
        is_test, at_cut = is_test | (at_cut & (number < at.value)), at_cut & (number == at.value)
        wanted -= at.below
        if wanted == at.equal:
            return df.withColumn("split", F.when(is_test | at_cut, "test").otherwise("train"))
    tag = lambda test: F.when(test, "test").otherwise("train").alias("split")
    alike = materialize(df.filter(at_cut).withColumn("_n", F.monotonically_increasing_id()), "alike-rows")
    last, _ = find_cut(alike, F.col("_n"), k=wanted)
    return df.filter(~at_cut).select("*", tag(is_test)).unionByName(
        alike.select(*df.columns, tag(F.col("_n") <= last.value))
    )


def split_counts(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count("*").alias("rows"))


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast when within the bound, else left to the planner."""
    bound = HISTOGRAM_BUCKETS + MAX_GROUPS
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
