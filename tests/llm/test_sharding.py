"""The permutation both ways, and shards over awkward tables."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mixloom.llm import sharding


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 3_000), seed=st.integers(0, 2**40), shards=st.integers(1, 50))
def test_permutation_is_reversible(n, seed, shards):
    places = sharding.permute(np.arange(n), n, seed)
    assert sorted(places) == list(range(n))
    assert (sharding.unpermute(places, n, seed) == np.arange(n)).all()
    shard, slot = sharding.place_of(np.arange(n), n, shards, seed)
    assert (sharding.number_at(shard, slot, n, shards, seed) == np.arange(n)).all()


def test_permutation_of_a_huge_range_stays_inside():
    n = 10**15 + 7
    numbers = np.random.default_rng(0).integers(0, n, 1_000)
    places = sharding.permute(numbers, n, 3)
    assert places.min() >= 0 and places.max() < n and (sharding.unpermute(places, n, 3) == numbers).all()
    assert np.corrcoef(numbers.astype(float), places.astype(float))[0, 1] < 0.2


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r["shard"], r["slot"]))


@pytest.mark.parametrize("partitions", [1, 7])
def test_shards_of_awkward_rows(spark, partitions):
    texts = [(i % 50 if i % 11 else None, None if i % 5 == 0 else "é" * (i % 4), "x") for i in range(203)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, shard string").repartition(partitions)
    placed = rows_of(sharding.shard_rows(sharding.document_rows(docs), 8, ["doc_id", "text_crc32", "size"]))
    sizes = np.bincount([r["shard"] for r in placed])
    assert len(placed) == 203 and sizes.max() - sizes.min() <= 1
    for shard in range(8):
        assert [r["slot"] for r in placed if r["shard"] == shard] == list(range(sizes[shard]))
    assert sorted(r["number"] for r in placed) == list(range(203))
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in texts)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in placed) == want


def test_reruns_agree_and_numbers_compute(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "string(id) as text")
    runs = [rows_of(sharding.shard_rows(sharding.document_rows(docs.repartition(p)), 40, ["doc_id"])) for p in (2, 9)]
    assert runs[0] == runs[1]
    for r in runs[0][:50]:
        shard, slot = sharding.place_of([r["number"]], 500, 40)
        assert (r["shard"], r["slot"]) == (shard[0], slot[0]) and r["number"] == r["doc_id"]


def test_empty_table(spark):
    rows = sharding.document_rows(spark.createDataFrame([], "doc_id long, text string"))
    assert sharding.shard_rows(rows, 4, ["doc_id"]).collect() == []
