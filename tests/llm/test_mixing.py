"""Targets against a plain water filling, and mixes of awkward tables."""

import re
from collections import defaultdict

import pytest

from mixloom.llm import mixing


def plain_targets(sizes):
    """Share 150 % by weight; cap at twice the size; share again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.fixture(scope="module")
def corpus():
    texts = []
    for i in range(400):
        source = [None, "a", "b", "é", "z", "a", "a"][i % 7]
        words = 1 + (i * 37) % 23 + (900 if i % 97 == 0 else 0)
        texts.append((i, " ".join(["w"] * words) if i % 29 else None, source, -1))
    return texts + [texts[5], texts[5], (None, "x y", "b", 0), (7, "", "a", 0), (8, " \n\t", "b", 0)]


def test_mix(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, source string, size long")
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(corpus)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(i), words(t)) for i, t, *_ in corpus) == sorted((str(r["doc_id"]), r["size"]) for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    want = plain_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.02 * sizes[source], 25)


def test_chances_are_kept_on_average(spark):
    units = spark.range(60).selectExpr("'s' as source", "id as key", "double(1 + id % 9) as size", "0.3 as p", "60L as n")
    total, ups = sum(1 + i % 9 for i in range(60)), 0
    for seed in range(6):
        rows = mixing.pivotal_rounding(units, seed).collect()
        assert sorted(r["key"] for r in rows) == list(range(60))
        assert abs(sum((1 + r["key"] % 9) * r["up"] for r in rows) - 0.3 * total) <= 9
        ups += sum(r["up"] for r in rows)
    assert 0.2 < ups / 360 < 0.4


def test_mixed_documents_and_empty_table(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string, source string, size long")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    assert mixing.mixed_documents(docs.limit(0)).collect() == []
