"""Components against the comparison of all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from mixloom.llm import components, neardup


def plain(rows, width):
    sets = {}
    for key, text in rows:
        words = (text or "").encode().lower().split()
        span = min(width, len(words))
        sets[key] = {tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def corpus(seed=0):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 400)}"
    rows = []
    for group in range(12):
        base = [word() for _ in range(rnd.choice([1, 3, 8, 40, 200]))]
        for _ in range(rnd.choice([1, 2, 3, 25])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 12))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), rnd.choice(["", " "]) + rnd.choice([" ", "\n", "\t "]).join(copy).title()))
    passage = " ".join(word() for _ in range(60))
    rows += [(len(rows) + i, passage + " " + " ".join(word() for _ in range(25))) for i in range(20)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, rows[4][1]), (1004, "One"), (1005, "one")]


@pytest.mark.parametrize("width, short, block", [(2, 64, 512), (2, 2, 8), (5, 64, 512)])
def test_components_equal_all_pairs(spark, monkeypatch, width, short, block):
    monkeypatch.setattr(neardup, "SHORT_LIST", short)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(width)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    found = {r["doc_id"]: r for r in neardup.near_duplicates(docs, width).collect()}
    want = plain(rows, width)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == want
    assert all(r["kept"] == (k == want[k][1]) for k, r in found.items())


def test_awkward_rows(spark):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert found == sorted([("None", "None", True), ("None", "3", False)] + [("5", "3", False)] * 2
                           + [("3", "3", True), ("9", "9", True)])
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("one text of its own " * 2, "another text that repeats here", "third text without any id at all")
    rows = [(5, a, 1), (5, b, 2), (3, b, 3), (3, b, 3), (3, b, 4), (None, c, 5), (None, c, 6), (7, "", 7), (7, None, 8), (7, "", 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone int, t1 string")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted(
        [("5", a), ("3", b), ("None", c), ("7", ""), ("7", ""), ("7", "")])
    assert neardup.drop_near_duplicates(docs.limit(0)).collect() == []


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (1, 0)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components.connected_components(df.limit(0)).collect() == []


def test_bounds_on_shared_values_hold_for_random_sets():
    rnd, missed = np.random.default_rng(0), 0
    for _ in range(400):
        common, extra = rnd.integers(0, 2**62, 800), rnd.integers(0, 2**62, 200)
        split = rnd.integers(0, 201)
        a, b = np.unique(np.append(common, extra[:split])), np.unique(np.append(common, extra[split:]))
        k = neardup.INDEXED
        missed += len(np.intersect1d(a[:k], b[:k])) < neardup.least_common(k)
        assert neardup._alike_sketches(a[: neardup.SKETCH], b[: neardup.SKETCH], neardup.SKETCH)
    assert missed == 0


def test_blocks_hand_on_fewer_links_than_rows_and_compare_full_sets(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**62, 300)
    sets = [np.unique(np.concatenate([base[:cut], rnd.integers(0, 2**62, 300 - cut)])) for cut in [297] * 20 + [255] * 20]
    rows = pd.DataFrame({"id": range(40), "n": [len(h) for h in sets], "label": range(40), "set": sets})
    links = neardup._links_of_blocks(rows, rows, 128)
    assert len(links) < 40 and all(neardup._alike_sets(sets[a], sets[b]) for a, b in links)
    wanted = {(a, b) for a in range(40) for b in range(a) if neardup._alike_sets(sets[a], sets[b])}
    assert len(wanted) > 150

    def groups(pairs):
        of = list(range(40))
        for a, b in pairs:
            of = [of[b] if g == of[a] else g for g in of]
        return {frozenset(i for i in range(40) if of[i] == g) for g in of}

    assert groups(links) == groups(wanted)
    joined = rows.assign(label=[0] * 20 + list(range(20, 40)))
    assert all(not (a < 20 and b < 20) for a, b in neardup._links_of_blocks(joined, joined, 128))


def test_a_group_of_near_copies_is_not_handed_on_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT_LIST", 4)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.choice([5, 9, 14])):
            copy[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    made, write = {}, neardup.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(neardup, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 2).collect()}
    assert found == plain(rows, 2)
    assert made["block-links"] < len(rows), made
