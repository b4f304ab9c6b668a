"""Corpus metrics against plain computations, run tables, batches and streams."""

import hashlib
import math
import random
import re
import subprocess
import sys
import warnings
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mixloom.operators import batching, metrics, render, runs
from mixloom.streaming import streams

WORDS = st.lists(st.sampled_from(["a", "b", "the", "Cat", "3,5", "x.", "-", "&amp;"]), max_size=12).map(" ".join)


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def mteval(text):
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    text = f" {text} "
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def plain_bleu(pairs):
    matches, total, np, nr = [0] * 4, [0] * 4, 0, 0
    for prediction, reference in pairs:
        p, r = mteval(prediction), mteval(reference)
        np, nr = np + len(p), nr + len(r)
        for n in range(1, 5):
            matches[n - 1] += sum((grams(p, n) & grams(r, n)).values())
            total[n - 1] += max(len(p) - n + 1, 0)
    if nr == 0:
        return None
    if np == 0 or min(matches) == 0:
        return 0.0
    mean = math.exp(sum(math.log(m / t) for m, t in zip(matches, total)) / 4)
    return mean * (1.0 if np > nr else math.exp(1 - nr / np))


def plain_rouge(p, r, kind):
    p, r = (re.findall("[a-z0-9]+", t.lower()) for t in (p, r))
    if kind == "rougeL":
        row = [0] * (len(r) + 1)
        for a in p:
            last = row
            row = [0]
            for j, b in enumerate(r):
                row.append(last[j] + 1 if a == b else max(last[j + 1], row[j]))
        hits, np, nr = row[-1], len(p), len(r)
    else:
        a, b = grams(p, int(kind[-1])), grams(r, int(kind[-1]))
        hits, np, nr = sum((a & b).values()), sum(a.values()), sum(b.values())
    return 0.0 if hits == 0 else 2 * (hits / np) * (hits / nr) / (hits / np + hits / nr)


def pair_table(spark, pairs):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "id int, prediction string, reference string")


@settings(max_examples=12, deadline=None)
@given(pairs=st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=6))
def test_bleu_and_rouge_equal_plain_python(spark, pairs):
    df = pair_table(spark, pairs)
    got, want = metrics.bleu(df).first()["bleu"], plain_bleu(pairs)
    assert (got is None) == (want is None)
    assert got is None or math.isclose(got, want, abs_tol=1e-9)
    scores = metrics.rouge_scores(df, keep=("id",)).orderBy("id").collect()
    alone = metrics.rouge_scores(df, kinds=("rougeL",), keep=("id",)).orderBy("id").collect()
    assert [r["rougeL"] for r in scores] == [r["rougeL"] for r in alone]
    for (p, r), row in zip(pairs, scores):
        for kind in ("rouge1", "rouge2", "rougeL"):
            assert math.isclose(row[kind], plain_rouge(p, r, kind), abs_tol=1e-9), (p, r, kind)


def test_bleu_of_equal_and_longer_predictions(spark):
    assert metrics.bleu(pair_table(spark, [("a b c d e", "a b c d e")])).first()["bleu"] == 1.0
    longer = metrics.bleu(pair_table(spark, [("a b c d e f", "a b c d e")])).first()
    assert longer["brevity_penalty"] == 1.0 and math.isclose(longer["bleu"], plain_bleu([("a b c d e f", "a b c d e")]))
    assert metrics.bleu(pair_table(spark, [(None, "a")])).first()["bleu"] == 0.0


def test_bleu_does_not_depend_on_chunks(spark, monkeypatch):
    pairs = [(" ".join(f"w{i * j % 7}" for j in range(i)), " ".join(f"w{i + j % 5}" for j in range(i + 2))) for i in range(40)]
    whole = metrics.bleu(pair_table(spark, pairs).coalesce(1)).first()
    assert math.isclose(whole["bleu"], plain_bleu(pairs))
    monkeypatch.setattr(metrics, "CHUNK_TOKENS", 30)
    assert metrics.bleu(pair_table(spark, pairs).coalesce(1)).first() == whole


def test_lcs_of_long_texts(spark):
    left = " ".join(str(i * 7 % 101) for i in range(400))
    right = " ".join(str(i * 11 % 97) for i in range(350))
    row = metrics.rouge_scores(pair_table(spark, [(left, right)]), kinds=("rougeL",)).first()
    assert math.isclose(row["rougeL"], plain_rouge(left, right, "rougeL"))


def test_rouge_is_the_mean(spark):
    row = metrics.rouge(pair_table(spark, [("a b", "a b"), ("", "x")])).first()
    assert (row["rouge1"], row["rouge2"], row["rougeL"]) == (0.5, 0.5, 0.5)


def test_perplexity(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("b", 5.0, 0)], "g string, loss double, n_tokens int")
    assert math.isclose(metrics.perplexity(df).first()[0], math.exp(5 / 4))
    rows = {r["g"]: r["perplexity"] for r in metrics.perplexity(df, by=("g",)).collect()}
    assert rows["b"] is None


def test_evaluate_and_user_metric(spark, monkeypatch):
    monkeypatch.setattr(metrics, "METRICS", dict(metrics.METRICS))
    metrics.register_metric("exact", lambda df: df.agg(F.avg((F.col("prediction") == F.col("reference")).cast("int")).alias("exact")))
    df = pair_table(spark, [("a", "a"), ("b", "c")])
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        values = {r["metric"]: r["value"] for r in metrics.evaluate(df, ["exact", "meteor", "rouge"]).collect()}
    assert values == {"exact": 0.5, "rouge1": 0.5, "rouge2": 0.0, "rougeL": 0.5}
    assert any("meteor" in str(w.message) for w in caught)
    with pytest.raises(ValueError):
        metrics.evaluate(None, ["rouge"])


def test_metrics_of_parts_equal_each_alone(spark, monkeypatch):
    monkeypatch.setattr(metrics, "METRICS", dict(metrics.METRICS))
    monkeypatch.setattr(metrics, "IN_ONE_PASS", dict(metrics.IN_ONE_PASS))
    df = pair_table(spark, [("the cat sat on the mat", "a cat sat on the mat"), ("b c d e f", "b c d e g"), (None, "x"), ("", "")])
    df = df.withColumns({"loss": F.lit(0.5), "n_tokens": F.lit(3)})
    metrics.register_parts("longest", lambda: metrics.MetricParts(
        (F.max("_longest_n").alias("_longest_all"),), (F.col("_longest_all").alias("longest"),), ({"_longest_n": F.length("prediction")},)
    ))
    values = {r["metric"]: r["value"] for r in metrics.evaluate(df, ["bleu", "longest", "rouge", "perplexity", "bleu"]).collect()}
    want = {"longest": 22.0, **metrics.rouge(df).first().asDict(), **metrics.perplexity(df).first().asDict()}
    assert values == {**want, "bleu": metrics.bleu(df).first()["bleu"]}
    metrics.register_metric("rouge", lambda df: df.agg(F.count("*").alias("rows")))
    assert [tuple(r) for r in metrics.evaluate(df, ["rouge"]).collect()] == [("rows", 4.0)]


def test_rouge_bootstrap(spark):
    def drawn(key, replicate, seed):
        digits = hashlib.md5(f"{seed}:{key}:{replicate // 8}".encode()).hexdigest()[4 * (replicate % 8):][:4]
        return sum(digits >= step for step in metrics.POISSON_STEPS)

    rows = [(i if i < 38 else None, "a b c d", " ".join("abcdxyz"[: i % 7 + 1])) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    scores = metrics.rouge_scores(df, kinds=("rouge1",), keep=("id",)).collect()
    found = metrics.rouge_bootstrap(df, "id", kinds=("rouge1", "rougeL"), replicates=50, level=0.9, seed=3)
    assert found.columns == ["metric", "low", "mid", "high"]
    by_metric = {r["metric"]: tuple(r)[1:] for r in found.collect()}
    means = []
    for replicate in range(50):
        weights = [drawn("" if r["id"] is None else r["id"], replicate, 3) for r in scores]
        means.append(sum(w * r["rouge1"] for w, r in zip(weights, scores)) / sum(weights))
    assert by_metric["rouge1"] == pytest.approx(tuple(np.percentile(means, [5, 50, 95])), abs=1e-9)
    # The same to the last digit however the rows lie.
    again = metrics.rouge_bootstrap(df.repartition(7, "reference"), "id", kinds=("rouge1", "rougeL"), replicates=50, level=0.9, seed=3)
    assert {r["metric"]: tuple(r)[1:] for r in again.collect()} == by_metric
    empty = metrics.rouge_bootstrap(df.limit(0), "id", kinds=("rouge2",), replicates=9)
    assert [tuple(r) for r in empty.collect()] == [("rouge2", None, None, None)]
    with pytest.raises(ValueError):
        metrics.rouge_bootstrap(df, "id", replicates=0)


@pytest.mark.parametrize("text", ["abcdé", "", "\t x   y\n", "x"])
def test_cut_and_strip_prompt(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    row = metrics.cut_prompt(df).first()
    assert row["prompt"] == text[:len(text) // 2] and row["target"] == text[len(text) // 2:].strip()
    echoed = spark.createDataFrame([(text, text + "  out \n")], "prompt string, output string")
    assert metrics.strip_prompt(echoed).first()["prediction"] == "out"


def test_planned_steps(spark):
    df = spark.createDataFrame([("a",)] * 17 + [("b",)] * 3, "dataset string")
    steps = lambda **o: {r["dataset"]: r["steps"] for r in runs.planned_steps(df, 2, 4, 3, **o).collect()}
    assert steps() == {"a": 6, "b": 0}
    assert steps(max_steps=7) == {"a": 7, "b": 7}


def test_run_metrics(spark):
    df = spark.createDataFrame([("r", 1, 3.0, None), ("r", 3, 2.5, 9.0), ("r", 2, 1.0, 4.0), ("r", 4, 2.0, 4.0)],
                               "run string, step int, loss double, eval double")
    row = runs.run_metrics(df, "run", "step", "loss", eval_metric="eval").first()
    assert (row["last_step"], row["last_loss"], row["mean_loss"], row["min_loss"]) == (4, 2.0, 2.125, 1.0)
    assert (row["best_value"], row["best_step"]) == (4.0, 2)


def test_latest_checkpoint_is_numeric(spark):
    df = spark.createDataFrame([("r", f"checkpoint-{n}") for n in (400, 1000, 90)] + [("r", "final")], "run string, name string")
    assert tuple(runs.latest_checkpoint(df, "run", "name").first()) == ("r", "checkpoint-1000", 1000)


@pytest.mark.parametrize("seconds, step, total", [(10.0, 3, 10), (7.000001, 2, 5), (3600, 7, 10_000), (90_000, 1, 2), (5, 0, 9), (200_000, 3, 4), (100, 10, 5)])
def test_eta_equals_timedelta_arithmetic(spark, seconds, step, total):
    start = datetime(2024, 1, 1)
    end = start + timedelta(seconds=seconds)
    df = spark.createDataFrame([("r", 0, start), ("r", step, end)], "run string, step int, ts timestamp_ntz")
    expected = "Unknown" if step == 0 else str((end - start) / step * (total - step)).split(".")[0]
    assert runs.run_eta(df, "run", "step", "ts", total).first()["remaining"] == expected


def test_truncate_tokens_with_both_tokenisers(spark):
    df = spark.createDataFrame([("a  b c\n",), ("",), (None,)], "text string")
    rows = batching.truncate_tokens(df, max_tokens=2).collect()
    assert [(r["n_tokens"], r["tokens"]) for r in rows] == [(3, ["a", "b"]), (0, []), (0, [])]
    letters = batching.truncate_tokens(df, max_tokens=3, tokenizer=lambda: list).collect()
    assert [(r["n_tokens"], r["tokens"]) for r in letters] == [(7, ["a", " ", " "]), (0, []), (0, [])]


def test_batch_predict(spark):
    def make():
        return lambda prompts: [p[::-1] + str(len(prompts)) for p in prompts]

    df = spark.createDataFrame([("ab",), ("cd",), ("ef",)], "prompt string").coalesce(1)
    assert [r["response"] for r in batching.batch_predict(df, "prompt", make, batch_size=2).collect()] == ["ba2", "dc2", "fe1"]


def test_length_batches(spark):
    df = spark.range(1000).withColumn("length", F.when(F.col("id") < 700, 40).otherwise(F.col("id") % 200))
    batched = batching.length_batches(df, "id", "length", batch=16).collect()
    groups = {}
    for r in batched:
        groups.setdefault((r["band"], r["batch"]), []).append(r["length"])
    assert len(batched) == 1000 and max(map(len, groups.values())) == 16
    assert all(max(g) - min(g) < batching.LENGTH_STEP for g in groups.values())
    report = batching.padding_report(batching.length_batches(df, "id", "length", batch=16), "length")
    assert {(r["band"], r["batch"]): r["padding"] for r in report.collect()} == {
        k: len(g) * max(g) - sum(g) for k, g in groups.items()
    }


def test_chat_stream_equals_batch(spark, tmp_path):
    schema = "id int, conversations array<struct<`from`:string,value:string>>"
    rows = [(i, [("human", f"q{i}"), ("tool", "t"), ("gpt", f"a{i}")]) for i in range(20)]
    df = spark.createDataFrame(rows, schema)
    run = lambda: streams.render_chat_stream(
        spark, str(tmp_path / "in"), schema, "conversations", None, ("id",), str(tmp_path / "out"), str(tmp_path / "state")
    ).awaitTermination()
    df.filter("id < 10").write.json(str(tmp_path / "in"))
    run()
    df.filter("id >= 10").write.mode("append").json(str(tmp_path / "in"))
    run()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in render.render_chat(df, keep=("id",)).collect()} and len(got) == 20


def test_metric_stream_continues_from_its_state(spark, tmp_path):
    schema = "run string, step int, loss double"
    rows = [("a", i, 1.0 / (i + 1)) for i in range(10)] + [("b", i, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, schema)
    for part in ("step < 3", "step >= 3"):
        df.filter(part).write.mode("append").json(str(tmp_path / "in"))
        streams.run_metrics_stream(
            spark, str(tmp_path / "in"), schema, "run", "step", "loss", str(tmp_path / "out"), str(tmp_path / "state")
        ).awaitTermination()
    got = {r["run"]: r.asDict() for r in streams.latest_summary(spark, str(tmp_path / "out")).collect()}
    want = {r["run"]: r.asDict() for r in runs.run_metrics(df, "run", "step", "loss").collect()}
    assert got.keys() == want.keys()
    for run, values in want.items():
        assert got[run] == pytest.approx(values)


@pytest.mark.parametrize("make, expected", [(lambda: metrics.matched_grams(2), "[[1,0]]"), (metrics.lcs_length, "[1]")])
def test_functions_travel_without_the_package(spark, tmp_path, make, expected):
    from pyspark import cloudpickle

    (tmp_path / "f").write_bytes(cloudpickle.dumps(make().func))
    script = (
        "import json, pickle, pyarrow as pa\n"
        "f = pickle.load(open('f', 'rb'))\n"
        "found = f(pa.array([['a', 'b']]), pa.array([['b', 'c']]))\n"
        "print(json.dumps(found.to_pylist(), separators=(',', ':')))"
    )
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == expected


def test_perplexity_leaves_out_tokens_of_unknown_losses(spark):
    df = spark.createDataFrame([(1.0, 10), (None, 90)], "loss double, n_tokens long")
    assert metrics.perplexity(df).first()["perplexity"] == pytest.approx(math.e)


def plain_lcs(left, right):
    row = [0] * (len(right) + 1)
    for a in left:
        above = row
        row = [0]
        for j, b in enumerate(right):
            row.append(above[j] + 1 if a == b else max(above[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("bounds", [(), (3, 50, 200)])
def test_batched_subsequences_equal_a_table_of_lengths(spark, bounds):
    draw = random.Random(4)
    words = lambda n, kinds: [f"w{draw.randrange(kinds)}" for _ in range(n)]
    rows = []
    for _ in range(80):
        left = words(draw.choice([0, 1, 5, 63, 64, 65, 130, 260]), draw.choice([1, 2, 9, 500]))
        right = [w for w in left if draw.random() < 0.8] if draw.random() < 0.5 else words(draw.choice([0, 1, 64, 200]), 5)
        rows.append((len(rows), left, right))
    df = spark.createDataFrame(rows, "id long, p array<string>, r array<string>")
    found = df.select("id", metrics.lcs_length(*bounds)("p", "r").alias("n"), metrics.lcs_length(*bounds)("r", "p").alias("m"))
    assert {r["id"]: (r["n"], r["m"]) for r in found.collect()} == {i: (plain_lcs(p, r),) * 2 for i, p, r in rows}


def test_subsequence_of_long_texts(spark):
    words = [f"w{i * i % 997}" for i in range(20_000)]
    kept = [w for i, w in enumerate(words) if i % 7]
    df = spark.createDataFrame([(words, kept), (kept, words), ([], words), (["w1"], words)], "p array<string>, r array<string>")
    assert [r[0] for r in df.select(metrics.lcs_length()("p", "r")).collect()] == [len(kept), len(kept), 0, 1]


def test_longest_common_subsequence_in_bounded_chunks(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    rnd = random.Random(3)
    make = lambda n, kinds: [str(rnd.randrange(kinds)) for _ in range(n)]

    pairs = [(make(rnd.randrange(0, n), 6), make(rnd.randrange(0, n), 6)) for n in [1, 3, 70, 130, 300] for _ in range(6)]
    pairs += [(None, ["a"]), (["a"], None), ([], ["a"]), (make(900, 40), make(700, 40))]
    lists = [pa.array([p[i] for p in pairs], pa.list_(pa.string())) for i in (0, 1)]
    want = [plain_lcs(a or [], b or []) for a, b in pairs]
    long = [pa.array([make(300, 50) for _ in range(500)], pa.list_(pa.string())) for _ in (0, 1)]
    peaks, results = [], []
    for tokens in (2_000_000, 20_000):
        monkeypatch.setattr(metrics, "CHUNK_TOKENS", tokens)
        length = metrics.lcs_length().func
        assert length(*lists).to_pylist() == want
        tracemalloc.start()
        results.append(length(*long).to_pylist())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert results[0] == results[1] and peaks[1] < peaks[0] / 3
