"""Deleted lines against a comparison of all pairs of positions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mixloom.llm import linededup


def words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def plain(rows, min_words):
    """Lines of runs that occur earlier, by the longest earlier match at every position."""
    seen, gone = [], {}
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [(i, x.strip(" \t\x0b\x0c\r")) for i, x in enumerate((text or "").split("\n"))]
        seen.append([(i, x) for i, x in lines if x])
        own = seen[-1]
        deleted = set()
        for p in range(len(own)):
            best = 0
            for q_doc, other in enumerate(seen):
                for q in range(len(other)):
                    if (q_doc, q) >= (len(seen) - 1, p):
                        break
                    n = 0
                    while p + n < len(own) and q + n < len(other) and own[p + n][1] == other[q + n][1]:
                        n += 1
                    best = max(best, n)
            if sum(words(x) for _, x in own[p : p + best]) >= min_words:
                deleted.update(own[p + n][0] for n in range(best))
        gone[key] = deleted
    return gone


@pytest.mark.parametrize("min_words, seed", [(1, 0), (4, 1), (9, 2)])
def test_equals_comparison_of_all_positions(spark, min_words, seed):
    rnd = random.Random(seed)
    lines = ["a", "b b", "c c c", " b b\t", "", "d d d d d", "e"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14)))) for i in range(14)]
    rows += [(20, rows[3][1]), (21, "\n".join(["z z z"] * 12)), (22, "unlike any other"), (23, None), (24, "")]
    docs = spark.createDataFrame([(*r, 3, "n") for r in rows], "doc_id long, text string, n_chars int, line string")
    cleaned = linededup.drop_repeated_lines(docs, min_words)
    assert cleaned.columns == [*docs.columns, "lines_deleted"]
    want = plain(rows, min_words)
    for r in cleaned.collect():
        text = dict(rows)[r["doc_id"]]
        if not want[r["doc_id"]]:
            assert r["text"] == text and r["lines_deleted"] == 0 and r["n_chars"] == 3
        else:
            kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want[r["doc_id"]])
            assert (r["text"], r["lines_deleted"], r["n_chars"]) == (kept, len(want[r["doc_id"]]), len(kept))


def test_repeated_rows_null_keys_and_empty_tables(spark):
    run = "one two\nthree four five"
    rows = [(None, run), (None, run), (1, "x\n" + run), (2, "y\n" + run + "\ny"), (2, "other text"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted((str(r["doc_id"]), str(r["text"])) for r in linededup.drop_repeated_lines(docs, 5).collect())
    assert texts == sorted([("None", run)] * 2 + [("1", "x"), ("2", "y\ny"), ("2", "other text"), ("3", "None")])
    assert linededup.drop_repeated_lines(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        linededup.repeated_lines(docs, 0)


@pytest.mark.parametrize("min_words, seed", [(4, 3), (8, 5)])
def test_passages_inside_lines(spark, min_words, seed):
    """Lines of several sentences against the comparison of all positions, a sentence a line."""
    rnd = random.Random(seed)
    sentences = ["a b. ", "c d e! ", "f?  ", 'g "h i." ', "j k", "\u4e00\u4e8c\u3002"]
    texts = []
    for i in range(20):
        lines = [[rnd.choice(sentences) for _ in range(rnd.randint(2, 14))] for _ in range(rnd.randint(1, 5))]
        texts.append((i, [line[: [*map(str.strip, line), "j k"].index("j k") + 1] for line in lines]))
    docs = spark.createDataFrame(
        [(i, "\n".join("".join(line) for line in lines)) for i, lines in texts], "doc_id long, text string"
    )
    flat = [(i, "\n".join(unit for line in lines for unit in line)) for i, lines in texts]
    gone = plain(flat, min_words)
    assert any(gone.values())
    cut_inside = False
    got = {r["doc_id"]: r for r in linededup.drop_repeated_lines(docs, min_words).collect()}
    for i, lines in texts:
        left, hit, at = [], 0, 0
        for line in lines:
            kept = [u for n, u in enumerate(line) if at + n not in gone[i]]
            at += len(line)
            hit += len(kept) < len(line)
            cut_inside |= 0 < len(kept) < len(line)
            left += ["".join(kept)] if kept else []
        assert (got[i]["text"], got[i]["lines_deleted"]) == ("\n".join(left), hit)
    assert cut_inside


def test_benchmark_passage_in_the_middle_of_a_line(spark):
    passage = " ".join(f"Sentence {i} has words in it." for i in range(12))
    rows = [(1, f"First here. {passage} Then more."), (2, f"Other start! {passage} Other end.\nlast line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: (r["text"], r["lines_deleted"]) for r in linededup.drop_repeated_lines(docs).collect()}
    assert texts == {1: (rows[0][1], 0), 2: ("Other start! Other end.\nlast line", 1)}


def test_both_ways_of_cutting_sentences_agree(spark):
    texts = ['A b. C d! "E?" f。g！\nh. \t i.  j.   k', "。！x？ y.) z.] \n. a .b … c…d… e.", " a  b\tc \r\n\x0b.", "", "3.5 e. g.\n\n\nx. y"]
    marked = [f"{t}\n{linededup.MARK}" for t in texts]
    df = spark.createDataFrame(list(zip(texts, marked)), "a string, b string")
    for r in df.select("a", linededup._units(F.col("a")).alias("u"), linededup._units(F.col("b")).alias("v")).collect():
        assert [tuple(x) for x in r["u"]] == [tuple(x) for x in r["v"]][:-1]
        lines = {}
        for x in r["u"]:
            lines.setdefault(x["line"], []).append(x["text"])
        assert "\n".join("".join(lines[i]) for i in sorted(lines)) == r["a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in linededup.document_units(docs).collect():
        assert r["words"] > 0
    counted = {r["doc_id"]: r["n"] for r in linededup.document_units(docs).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert counted[2] == words(texts[2]) and counted[4] == words(texts[4])


def test_runs_of_many_units_take_one_round_and_any_step_gives_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    lines = [rnd.choice("abcdefgh") for _ in range(60)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["z", *lines[5:58], "y"])), (3, "\n".join(lines[:20])), (4, "\n".join("ab" * 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written, found = [], []
    write = linededup.materialize
    monkeypatch.setattr(linededup, "materialize", lambda df, name: written.append(name) or write(df, name))
    for step in (8, 3):
        monkeypatch.setattr(linededup, "STEP", step)
        found.append({r["doc_id"]: r["lines_deleted"] for r in linededup.drop_repeated_lines(docs).collect()})
        if step == 8:
            assert written.count("suffix-ranks") == 1
    want = plain(rows, linededup.MIN_WORDS)
    assert found == [{k: len(gone) for k, gone in want.items()}] * 2 and found[0][2] == 53


def test_units_cut_in_one_go_are_those_of_the_lines(spark):
    texts = ["a b. c d\n\n e! f? g", "x。y z\n\t\n.  q。 r", "", "\n", 'say "so." Then\x1e. on\ntwo.  three']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(linededup._unit_texts(F.col("t")).alias("u"), linededup._units(F.col("t")).alias("v")).collect():
        assert r["u"] == [v["text"] for v in r["v"]]


def test_a_text_is_cut_once_for_all_columns(spark):
    run = "First of it all. " + " ".join(f"w{i}" for i in range(60)) + ".\nlast words"
    docs = spark.createDataFrame([(1, run, 9), (2, f"Alone here. {run}", 9)], "doc_id long, text string, n_chars int")
    cleaned = linededup.drop_repeated_lines(docs)
    # One pass over a text marks its sentence ends; finding repeated units is a plan of its own.
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    found = {r["doc_id"]: (r["text"], r["lines_deleted"], r["n_chars"]) for r in cleaned.collect()}
    assert found == {1: (run, 0, 9), 2: ("Alone here. ", 2, 12)}


def test_only_units_and_runs_move_and_no_text_is_sorted(spark, monkeypatch):
    run = "\n".join(f"w{i} x y z v" for i in range(14))
    rows = [(None, f"a\n{run}"), (5, run), (5, f"{run}\nb"), (1, "\n".join(run.split("\n")[:11]) + " c"), (7, "one. alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sorted_by = []
    number = linededup.number_rows
    monkeypatch.setattr(linededup, "number_rows", lambda df, *a, name: sorted_by.append(name) or number(df, *a, name=name))
    cleaned = linededup.drop_repeated_lines(docs)
    # Documents alone are put in order; units and tuples of them are named by hashes.
    assert sorted_by == ["document-order"]
    assert "shuffle_hash" in cleaned._jdf.queryExecution().optimizedPlan().toString()
    # NULL comes first; of equal ids either may, and then the other is a copy.
    found = sorted((str(r["doc_id"]), r["text"], r["lines_deleted"]) for r in cleaned.collect())
    assert found == sorted([
        ("None", rows[0][1], 0), ("5", "", 14), ("5", "b", 14), ("1", run.split("\n")[10] + " c", 10), ("7", "one. alone", 0),
    ])


def test_words_and_ends_without_the_marks_beyond_ascii(spark):
    texts = ["One two.  three\tfour! \"five\"", "été ß. x ü\r\n", "a  b. c d", "e.\u201d f? g… h", "x y\u00a0z. q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in df.select("text", linededup._unit_texts(F.col("text")).alias("u"), linededup._units(F.col("text")).alias("v")).collect():
        assert r["u"] == [v["text"] for v in r["v"]]
    counted = {r["doc_id"]: r["n"] for r in linededup.document_units(df).groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}
    assert counted == {i: words(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("min_words, seed", [(3, 0), (7, 1), (12, 2)])
def test_runs_looked_up_are_the_shortest_from_and_up_to_every_unit(spark, min_words, seed):
    rnd = random.Random(seed)
    units = [
        (key, nth, rnd.randint(1, 2 * min_words if rnd.random() < 0.2 else 4))
        for key in range(6) for nth in range(40) if rnd.random() < 0.85
    ]
    repeating = spark.createDataFrame([(nth, -nth, key, nth, n) for key, nth, n in units], "h1 long, h2 long, key long, nth int, words int")
    order = spark.createDataFrame([(key, 10 + key) for key in range(6)], "key long, doc long")
    stretches = linededup._stretches(repeating, order, min_words).collect()
    want, counts = set(), {(key, nth): n for key, nth, n in units}
    for key, nth in counts:
        for step in (1, -1):
            at, total = nth, 0
            while (key, at) in counts and total < min_words:
                total += counts[key, at]
                at += step
            if total >= min_words:
                want.add((key, nth, at - nth) if step == 1 else (key, at + 1, nth - at))
    found = [
        (r["key"], nth, length)
        for r in stretches for nth, least, most in zip(r["nth"], r["ahead"], r["upto"]) if least > 0
        for length in range(least, most + 1)
    ]
    assert len(found) == len(set(found)) and set(found) == want
    for r in stretches:
        assert r["doc"] == 10 + r["key"] and r["nth"] == sorted(r["nth"]) == r["h1_0"] == [-h for h in r["h2_0"]]


def test_units_are_sorted_twice_and_cut_without_a_function_for_each(spark, monkeypatch):
    run = "\n".join(f"w{i} x y z v" for i in range(14))
    docs = spark.createDataFrame([(1, run), (2, f"{run}\nb"), (3, f"c\n{run}")], "doc_id long, text string")
    assert "lambdafunction" not in linededup.document_units(docs)._jdf.queryExecution().optimizedPlan().toString()
    plans = {}
    write = linededup.materialize

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(linededup, "materialize", keep)
    gone = linededup.repeated_units(docs)
    # By place and by words; the arrays of a document meet its number unsorted.
    assert plans["line-stretches"].count("Sort [key") == 2 and "SortMergeJoin" not in plans["line-stretches"]
    assert sorted((r["nth"] for r in gone.collect())) == sorted([*range(14), *range(1, 15)])


def test_units_between_odd_blanks(spark):
    rnd = random.Random(3)
    parts = ["a", "b1", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c ", "\n \n", "c. ", "d!\t", "。", "e?  "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = docs.select("doc_id", F.posexplode(linededup._units(F.col("text"))).alias("i", "u"))
    want = {}
    for r in cut.orderBy("doc_id", "i").collect():
        if unit := r["u"]["text"].strip(" \t\x0b\x0c\r"):
            want.setdefault(r["doc_id"], []).append((unit, words(unit)))
    hashed = spark.createDataFrame([(u,) for units in want.values() for u, _ in units], "u string").distinct()
    names = {r["u"]: r["h"] for r in hashed.select("u", F.xxhash64("u").alias("h")).collect()}
    found = {}
    for r in linededup.document_units(docs).orderBy("doc_id", "nth").collect():
        assert r["nth"] == len(found.setdefault(r["doc_id"], []))
        found[r["doc_id"]].append((r["h1"], r["words"]))
    assert found == {doc: [(names[u], n) for u, n in units] for doc, units in want.items()}


def test_spans_of_later_copies_lie_apart(spark):
    run = [f"w{i} x y z v" for i in range(30)]
    docs = spark.createDataFrame([
        (1, "\n".join(run)), (2, "\n".join([*run[:12], "own", *run[10:30], "own two"])), (3, "\n".join([*run, *run])),
    ], "doc_id long, text string")
    spans = linededup._repeated_spans(docs, 50)
    keys = docs.select(linededup._key().alias("key"), "doc_id")
    found = sorted((r["doc_id"], r["from"], r["end"]) for r in spans.join(keys, "key").collect())
    assert found == [(2, 0, 12), (2, 13, 33), (3, 0, 60)]
    assert sorted(r["nth"] for r in linededup.repeated_units(docs).join(keys.filter("doc_id = 2"), "key").collect()) == [*range(12), *range(13, 33)]
