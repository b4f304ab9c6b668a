"""Elias-Fano levels, the trie, and scores against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mixloom.llm import lm
from mixloom.llm.trie import BigramTrie, EliasFano


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**20 - 1), max_size=200), st.lists(st.integers(0, 2**20 - 1), min_size=1, max_size=60))
def test_levels_equal_sorted_arrays(values, wanted):
    values, wanted = np.sort(np.array(values, np.uint64)), np.array(wanted, np.uint64)
    coded = EliasFano(values, 20)
    assert (coded[np.arange(len(values))] == values).all()
    assert (coded.successor(wanted) == np.searchsorted(values, wanted)).all()


def test_levels_of_whole_words_are_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 2**63, 5_000, dtype=np.uint64) * np.uint64(2))
    coded = EliasFano(values, 64)
    assert (coded[np.arange(5_000)] == values).all()
    dense = EliasFano(np.arange(100_000), 17)
    assert dense.nbytes < 100_000 * 17 / 8


def test_trie_equals_counts():
    rnd = np.random.default_rng(0)
    pairs = Counter(zip((rnd.integers(0, 40, 4_000) ** 9).tolist(), rnd.integers(0, 300, 4_000).tolist()))
    totals = Counter()
    for (a, _), n in pairs.items():
        totals[a] += n
    keys = sorted(pairs)
    whole = {keys[0][0]: 9_999, 12345: 77}
    trie = BigramTrie(np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint32),
                      np.array([pairs[k] for k in keys]), whole, 2.0)
    a, b = rnd.integers(0, 50, 3_000) ** 9, rnd.integers(0, 400, 3_000)
    a[:5] = 12345
    log10, seen = trie.look_up(a.astype(np.uint64), b.astype(np.uint32))
    for x, y, value, hit in zip(a.tolist(), b.tolist(), log10, seen):
        total = whole.get(x, totals[x])
        assert hit == ((x, y) in pairs)
        assert value == pytest.approx(math.log10((pairs[x, y] if hit else 2.0) / (total + 2.0)), abs=2e-4)


def plain(rows, trains, prior=lm.PRIOR):
    tokens = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    words, pairs, contexts = Counter(), Counter(), Counter()
    for w, train in zip(tokens, trains):
        if train:
            words.update(w)
            for a, b in zip([b"^", *w], w):
                pairs[a, b] += 1
                contexts[a] += 1
    n, v = sum(words.values()), len(words)
    base = lambda x: math.log10((words[x] + 1) / (n + v + 1))
    for w in tokens:
        score = sum(
            math.log10(pairs[a, b] / (contexts[a] + prior)) if pairs[a, b]
            else math.log10(prior / (contexts[a] + prior)) + base(b)
            for a, b in zip([b"^", *w], w)
        )
        yield len(w), sum(words[x] > 0 for x in w), n, sum(map(base, w)), score


@pytest.mark.parametrize("pack, part, common", [(1_000_000, 2_000_000, 1 / 2_000), (50, 200, 1 / 20), (1_000, 500, 1.1)])
def test_scores_equal_plain_counting(spark, monkeypatch, pack, part, common):
    monkeypatch.setattr(lm, "PACK_TOKENS", pack)
    monkeypatch.setattr(lm, "PART_TOKENS", part)
    monkeypatch.setattr(lm, "LEAST_PARTS", 5)
    monkeypatch.setattr(lm, "COMMON_SHARE", common)
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(f"W{x}" for x in rnd.zipf(1.5, rnd.integers(0, 40)) % 60)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n"), (7, rows[7][1]), (7, rows[7][1]), (None, "w1 w2 unseenword"),
             (103, "w1 " * 3_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    trains = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2 for i, _ in rows]
    found = sorted(tuple(r) for r in lm.score_documents(docs, ~lm.held_out()).select(
        F.coalesce("doc_id", F.lit(-1)), "n_tokens", "n_known", "train_tokens", "base_score", "score", "trained").collect())
    want = sorted((i if i is not None else -1, *p, t) for (i, _), p, t in zip(rows, plain(rows, trains), trains))
    assert len(found) == len(want)
    for f, w in zip(found, want):
        assert f[:4] == w[:4] and f[6] == w[6]
        assert f[4] == pytest.approx(w[4], abs=1e-6) and f[5] == pytest.approx(w[5], abs=2e-4 * f[1])


def test_nothing_to_learn_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.score_documents(docs, F.lit(False)).collect()}
    assert rows[1]["train_tokens"] == 0 and rows[1]["base_score"] == rows[1]["score"] == 0.0
    assert lm.score_documents(docs.limit(0), F.lit(True)).collect() == []
