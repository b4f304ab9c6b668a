"""Limits, shuffles, ranks and splits: exact, reproducible and independent of partitioning."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mixloom.operators import sampling


def tags(df):
    return {r["id"]: r["split"] for r in df.collect()}


@pytest.mark.parametrize("n, size, expected", [(201, 0.1, 21), (200, 0.1, 20), (50, 7, 7), (3, 0.5, 2), (1000, 0.333, 333)])
def test_split_sizes(spark, n, size, expected):
    split = tags(sampling.split(spark.range(n), "id", size))
    assert len(split) == n
    assert sum(v == "test" for v in split.values()) == expected


@pytest.mark.parametrize("n, size", [(1, 0.5), (10, 1.0), (10, 10), (10, 11), (10, 0.99)])
def test_split_that_leaves_no_train_rows_raises(spark, n, size):
    with pytest.raises(ValueError):
        sampling.split(spark.range(n), "id", size)


@pytest.mark.parametrize("size", [0, 0.0, -1])
def test_no_split(spark, size):
    assert set(tags(sampling.split(spark.range(5), "id", size)).values()) == {"train"}


def test_unshuffled_split_is_the_tail(spark):
    split = tags(sampling.split(spark.range(100).repartition(7), "id", 0.25, shuffle=False))
    assert {k for k, v in split.items() if v == "test"} == set(range(75, 100))


def test_unshuffled_split_over_the_whole_long_range(spark):
    ids = [-(2**63), -5, 0, 7, 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    split = tags(sampling.split(df, "id", 2, shuffle=False))
    assert {k for k, v in split.items() if v == "test"} == {7, 2**63 - 1}


def test_split_does_not_depend_on_partitions_or_key_type(spark):
    base = tags(sampling.split(spark.range(500).repartition(1), "id", 0.2))
    assert tags(sampling.split(spark.range(500).repartition(13), "id", 0.2)) == base
    as_text = sampling.split(spark.range(500).select(F.col("id").cast("string").alias("id")), "id", 0.2)
    assert {int(k): v for k, v in tags(as_text).items()} == base


def test_seed_changes_the_split(spark):
    assert tags(sampling.split(spark.range(300), "id", 0.3, seed=1)) != tags(sampling.split(spark.range(300), "id", 0.3, seed=2))


def test_split_refines_large_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "HISTOGRAM_BUCKETS", 4)
    monkeypatch.setattr(sampling, "DRIVER_ROWS", 5)
    split = tags(sampling.split(spark.range(400), "id", 0.25))
    monkeypatch.undo()
    assert split == tags(sampling.split(spark.range(400), "id", 0.25))


def test_duplicate_keys_across_the_cut_are_cut_exactly(spark):
    same = spark.range(10).select(F.lit(1).alias("id"))
    assert sampling.split(same, "id", 3).filter("split = 'test'").count() == 3


def test_split_empty_table(spark):
    assert sampling.split(spark.range(0), "id", 0.1).collect() == []


@pytest.mark.parametrize("n, expected", [(0, 20), (None, 20), (21, 20), (5, 5)])
def test_head(spark, n, expected):
    rows = [r["id"] for r in sampling.head(spark.range(20).repartition(3), n, "id").collect()]
    assert sorted(rows) == list(range(expected))


def test_large_head_is_a_filter(spark, monkeypatch):
    monkeypatch.setattr(sampling, "DRIVER_ROWS", 5)
    df = spark.createDataFrame([(i * i,) for i in range(200)], "id bigint").repartition(4)
    assert sorted(r["id"] for r in sampling.head(df, 37, "id").collect()) == [i * i for i in range(37)]


def test_shuffle_is_a_permutation_and_matches_the_rank(spark):
    ordered = [r["id"] for r in sampling.shuffle(spark.range(300).repartition(5), "id").collect()]
    ranks = {r["id"]: r["rank"] for r in sampling.shuffle_rank(spark.range(300), "id").collect()}
    assert sorted(ordered) == list(range(300)) and ordered != list(range(300))
    assert [ranks[i] for i in ordered] == list(range(300))


def test_rank_is_the_same_when_bands_are_cut_into_groups(spark, monkeypatch):
    df = spark.range(2000).withColumn("b", F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 7))
    rank = lambda: {r["id"]: (r["band"], r["rank"]) for r in sampling.rank_in_band(df, F.col("b"), "id").collect()}
    whole = rank()
    monkeypatch.setattr(sampling, "GROUP_ROWS", 50)
    assert rank() == whole
    for band in {b for b, _ in whole.values()}:
        ranks = sorted(r for b, r in whole.values() if b == band)
        assert ranks == list(range(len(ranks)))


@settings(max_examples=8, deadline=None)
@given(ids=st.lists(st.integers(-(2**40), 2**40), unique=True, min_size=2, max_size=60),
       size=st.floats(0.05, 0.9), shuffle=st.booleans())
def test_split_property(spark, ids, size, shuffle):
    k = math.ceil(size * len(ids))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    if k >= len(ids):
        with pytest.raises(ValueError):
            sampling.split(df, "id", size, shuffle=shuffle)
        return
    split = tags(sampling.split(df, "id", size, shuffle=shuffle))
    assert set(split) == set(ids)
    assert sum(v == "test" for v in split.values()) == k
    if not shuffle:
        assert {i for i, v in split.items() if v == "test"} == set(sorted(ids)[-k:])


def with_null_keys(spark, rows=60, nulls=3):
    return spark.range(rows).select(F.when(F.col("id") >= nulls, F.col("id")).alias("id"), (F.col("id") % 4).alias("b"))


@pytest.mark.parametrize("group_rows", [200_000, 5])
def test_ranks_keep_null_keys_and_bands_at_any_size(spark, monkeypatch, group_rows):
    monkeypatch.setattr(sampling, "GROUP_ROWS", group_rows)
    df = with_null_keys(spark)
    ranked = sampling.shuffle_rank(df.select("id"), "id").collect()
    assert sorted(r["rank"] for r in ranked) == list(range(60))
    band = F.when(F.col("b") > 0, F.col("b"))
    found = sampling.rank_in_band(df, band, "id").groupBy("band").agg(
        F.count("*").alias("n"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks")
    ).collect()
    assert {r["band"]: (r["n"], r["last"], r["ranks"]) for r in found} == {k: (15, 14, 15) for k in (None, 1, 2, 3)}


@pytest.mark.parametrize("driver_rows", [10_000, 5])
@pytest.mark.parametrize("n", [2, 3, 10, 45, 70])
def test_head_takes_nulls_first_and_any_of_equal_rows(spark, monkeypatch, driver_rows, n):
    monkeypatch.setattr(sampling, "DRIVER_ROWS", driver_rows)
    keys = [None] * 3 + [1] * 40 + list(range(5, 22))
    numbers = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(4)
    assert [r["k"] for r in sorted(sampling.head(numbers, n, "k").collect(), key=lambda r: (r["k"] is not None, r["k"] or 0))] == keys[:n]
    texts = numbers.select(F.lpad(F.col("k").cast("string"), 9, "0").alias("k"))
    wanted = [None if k is None else f"{k:09d}" for k in keys][:n]
    assert sorted((r["k"] or "" for r in sampling.head(texts, n, "k").collect())) == sorted(k or "" for k in wanted)


def test_split_sizes_count_null_keys(spark):
    df = spark.range(60).select(F.when(F.col("id") >= 1, F.col("id")).alias("id"))
    for shuffle in (True, False):
        counts = {r["split"]: r["rows"] for r in sampling.split_counts(sampling.split(df, "id", 0.1, shuffle=shuffle)).collect()}
        assert counts == {"test": 6, "train": 54}


def test_text_keys_are_split_in_order(spark):
    df = spark.range(40).select(F.format_string("a-rather-long-name-%05d", "id").alias("k"))
    test = sampling.split(df, "k", 0.2, shuffle=False).filter("split = 'test'").collect()
    assert sorted(r["k"] for r in test) == [f"a-rather-long-name-{i:05d}" for i in range(32, 40)]


@pytest.mark.parametrize("n", [7, 23, 41])
def test_head_and_split_compare_whole_text_keys(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "DRIVER_ROWS", 5)
    shared = "http://example.org/" + "path/" * 120
    keys = [shared + "x" * (i // 9) + f"{i:03d}" for i in range(40)] + [shared, shared + "\0", shared + "\0\0"]
    df = spark.createDataFrame([(k, hash(k) % 97) for k in keys], "k string, v int").repartition(3)
    ordered = sorted(keys, key=str.encode)
    assert sorted((r["k"] for r in sampling.head(df, n, "k").collect()), key=str.encode) == ordered[:n]
    test = sampling.split(df, "k", n, shuffle=False).filter("split = 'test'").collect()
    assert sorted((r["k"] for r in test), key=str.encode) == ordered[-n:]


@pytest.mark.parametrize("kind", ["timestamp", "date", "double", "decimal(30,4)"])
def test_large_head_by_keys_of_other_types(spark, monkeypatch, kind):
    number = F.when(F.col("id") >= 3, F.col("id") * 7 % 100)
    key = {"timestamp": F.timestamp_seconds(number), "date": F.date_from_unix_date(number.cast("int"))}.get(kind, number.cast(kind))
    df = spark.range(100).select(key.alias("k"), "id").repartition(4)
    small = [r["k"] for r in sampling.head(df, 37, "k").collect()]
    monkeypatch.setattr(sampling, "DRIVER_ROWS", 5)
    large = sampling.head(df, 37, "k")
    assert large.columns == df.columns
    assert sorted(map(str, small)) == sorted(str(r["k"]) for r in large.collect())
    assert sampling.head(df, 1000, "k").count() == 100 and sampling.head(df.limit(0), 10, "k").count() == 0


@pytest.mark.parametrize("shuffle", [True, False])
@pytest.mark.parametrize("size", [1, 7, 0.25, 31, 59])
def test_split_of_repeated_keys_is_exact(spark, monkeypatch, shuffle, size):
    monkeypatch.setattr(sampling, "DRIVER_ROWS", 3)
    rows = [(13 if i < 30 else i % 4, f"row {i % 20}", {"m": i % 2}) for i in range(60)]
    for key in ("key", "name"):
        df = spark.createDataFrame(rows, "key long, name string, more map<string,int>")
        tagged = sampling.split(df, key, size, shuffle=shuffle)
        counts = {r["split"]: r["rows"] for r in sampling.split_counts(tagged).collect()}
        wanted = -(-60 * size // 1) if isinstance(size, float) else size
        assert counts == {"test": wanted, "train": 60 - wanted}
        assert sorted(map(str, tagged.drop("split").collect())) == sorted(map(str, df.collect()))
        if not shuffle:
            ends = {s: [r[key] for r in tagged.filter(F.col("split") == s).collect()] for s in ("test", "train")}
            assert max(ends["train"]) <= min(ends["test"])


def test_split_of_rows_all_alike(spark):
    df = spark.createDataFrame([(1, "same")] * 50, "key long, name string").repartition(5)
    for shuffle in (True, False):
        counts = {r["split"]: r["rows"] for r in sampling.split_counts(sampling.split(df, "key", 0.3, shuffle=shuffle)).collect()}
        assert counts == {"test": 15, "train": 35}
