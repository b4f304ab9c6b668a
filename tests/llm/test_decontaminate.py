"""Benchmark passages against a plain search, and the index against lists."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mixloom.llm import decontaminate as dc
from mixloom.llm.wavelet import FMIndex, WaveletMatrix, suffix_order


def words_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain(docs, items, width=10):
    rows = {}
    for doc, text in docs:
        words, hit, held = words_of(text), set(), set()
        for item, item_text in items:
            own = words_of(item_text)
            n = min(width, len(own))
            windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    held.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        rows.setdefault(doc, []).append((len(words), len(hit), len(held), digest, bool(hit)))
    return {k: sorted(v) for k, v in rows.items()}


def found(df):
    rows = {}
    for r in df.collect():
        rows.setdefault(r["doc_id"], []).append((r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]))
    return {k: sorted(v) for k, v in rows.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_index_counts_and_locates(runs, sample):
    symbols = np.array([x for run in runs for x in [*run, 0]], dtype=np.int32)
    index = FMIndex(symbols, 4, sample)
    for length in (1, 2, 3):
        phrases = np.array(np.meshgrid(*[range(1, 5)] * length)).reshape(length, -1).T.astype(np.int32)
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high):
            there = [i for i in range(len(symbols) - length + 1) if (symbols[i:i + length] == phrase).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == there


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=200))
def test_wavelet_ranks(values):
    matrix = WaveletMatrix(np.array(values, dtype=np.int64), 9)
    at = np.arange(len(values) + 1)
    for symbol in range(10):
        wanted = [values[:i].count(symbol) for i in at]
        assert matrix.rank(np.full(len(at), symbol), at).tolist() == wanted
    symbols, ranks = matrix.access(at[:-1])
    assert symbols.tolist() == values and ranks.tolist() == [values[:i].count(v) for i, v in enumerate(values)]
    ranked = np.array([*[v + 1 for v in values], 0])
    assert suffix_order(ranked).tolist() == sorted(range(len(ranked)), key=lambda i: ranked[i:].tolist())


ITEMS = [
    (1, "The Quick-brown fox jumps over the lazy dog and then it runs away home"), (2, "tiny item"), (2, "tiny item"),
    (3, None), (4, "... !!"), (None, "ünïcode wörds 12 x"), (10, "the quick brown fox jumps over the lazy dog and"),
    (5, "a a a a a a a a a a a a"),
]
DOCS = [
    (1, "before THE quick Brown fox jumps over the lazy dog and THEN more"), (2, "a tiny item, tiny  item tiny"),
    (3, None), (4, ""), (5, "ünïcode wörds 12 x y ÜNÏCODE"), (5, "nothing here"), (None, "tiny item"), (6, "a " * 500),
    (7, "the quick brown fox jumps over the lazy"), (8, "tiny"), (8, "x" * 200_000 + " tiny item"), (8, "tiny"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(i, t, "q") for i, t in ITEMS], "item_id long, text string, items string")


@pytest.mark.parametrize("piece, words, stretch", [(400_000, 1_000_000, 100_000), (15, 7, 4)])
def test_equal_to_plain_search(spark, benchmark, monkeypatch, piece, words, stretch):
    monkeypatch.setattr(dc, "SHARD_WORDS", words)
    monkeypatch.setattr(dc, "STRETCH_WORDS", stretch)
    monkeypatch.setattr(dc, "PIECE_WORDS", piece)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 5 if piece == 15 else 4_000_000)
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in DOCS], "doc_id long, text string, spans string, key int")
    assert found(dc.contamination(docs, benchmark)) == plain(DOCS, ITEMS)
    assert dc.contamination(docs.limit(0), benchmark).collect() == []
    none = found(dc.contamination(docs, benchmark.limit(0)))
    assert none == plain(DOCS, [])


def test_passages_are_cut(spark, benchmark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", dc.F.lit(7))
    cleaned = dc.remove_passages(docs, benchmark)
    assert cleaned.columns == docs.columns and cleaned.count() == len(DOCS)
    texts = {(r["doc_id"], r["text"]) for r in cleaned.collect()}
    assert {(1, "before  more"), (2, "a  tiny"), (3, None), (5, "nothing here"), (5, " y ÜNÏCODE"), (6, " ")} <= texts


def test_one_scan_without_shuffle(spark, benchmark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    plan = dc.contamination(spark.read.parquet(str(tmp_path / "d")), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1
