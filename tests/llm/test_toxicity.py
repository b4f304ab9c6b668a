"""Learners, features, and scores of awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.llm import boosting, toxicity


def test_trees_learn_a_rule_no_line_can():
    rnd = np.random.default_rng(0)
    x = rnd.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = boosting.boost(x[:400], y[:400])
    assert ((model.probability(x[400:]) > 0.5) == y[400:]).mean() > 0.95


def test_constant_features_and_one_row():
    model = boosting.boost(np.zeros((5, 3)), np.array([0, 1, 0, 0, 1.0]))
    assert np.allclose(model.probability(np.ones((2, 3))), model.probability(np.zeros((2, 3))))
    assert 0 < boosting.boost(np.zeros((1, 3)), np.ones(1)).probability(np.zeros((1, 3)))[0] < 1


def test_isotonic_rises_and_pools():
    score = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    fit = boosting.isotonic(score, np.array([0, 1, 0, 0, 1, 1.0]))
    values = fit(np.linspace(0, 1, 50))
    assert (np.diff(values) >= 0).all() and 0 <= values.min() and values.max() <= 1
    assert fit(np.array([0.2]))[0] < fit(np.array([0.6]))[0]
    assert boosting.isotonic(np.empty(0), np.empty(0))(np.array([0.4]))[0] == 0.4


def test_features():
    made = toxicity.Features({"clown": 4.0, "lowei*": 5.0})
    row = dict(zip(toxicity.FEATURES, made.of("You CLOWN! loweihr x l0ve ha**ha clowns aaa 12?")))
    assert row["lexicon_hits"] == pytest.approx(np.log1p(2)) and row["lexicon_kinds"] == 2
    assert row["lexicon_density"] == pytest.approx(200 / 9) and row["near_second_person"] == 1.0
    assert row["digits_inside"] == pytest.approx(1 / 9) and row["letter_runs"] > 0 and row["exclamations"] > 0
    assert np.isfinite(made.table([None, "", " \n", "x" * 100_000])).all()


def documents(spark):
    clean = ["the river runs past the old mill", "a table | of | figures", "IT RAINS!! AGAIN", "plain words and more words"]
    rows = [(i, clean[i % 4] + f" number {i}" + (" such a wretched fool, you" if i % 4 == 1 else "")) for i in range(400)]
    return spark.createDataFrame([(*r, 1) for r in rows + [(1000, None), (1001, ""), (None, "wretched fool")]],
                                 "doc_id long, text string, score int")


def test_scores(spark):
    docs = documents(spark)
    labels = docs.filter("doc_id < 400").select("doc_id", (F.col("text").contains("wretched")).cast("int").alias("toxic"))
    labels = labels.unionByName(labels.limit(3)).unionByName(
        spark.createDataFrame([(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    )
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    scored = toxicity.score_toxicity(docs, model)
    assert scored.columns == ["doc_id", "score", "predicted"] and scored.count() == 403
    found = scored.filter(toxicity.held_out() & (F.col("doc_id") < 400)).collect()
    assert len(found) > 50 and all(r["predicted"] == (r["doc_id"] % 4 == 1) for r in found)
    for r in scored.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_labels_that_teach_nothing(spark, toxic):
    docs = documents(spark).limit(20)
    labels = docs.select("doc_id", F.lit(toxic).cast("int").alias("toxic"))
    scores = {r["score"] for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels, F.lit(True))).collect()}
    assert scores == {float(toxic or 0)}
