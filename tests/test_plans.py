"""The physical plans hold what the operators promise for large tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

from mixloom.operators import metrics, mixture, render, sampling
from mixloom.plans import inputs
from mixloom.plans.queries import QUERIES
from mixloom.sources import catalogue, readers

SF_DIR = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"bleu", "rouge1", "rouge2", "rouge_l", "rouge_rows", "rouge_bootstrap", "batch_predict", "user_map",
                  "evaluate_metrics", "token_truncate_plugged"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def assert_bounded_single_partitions(plan):
    """Only partial aggregates and written tables of file pieces or groups meet in one task."""
    for below in re.findall(r"Exchange SinglePartition.*\n(.*(?:\n.*){2})", plan):
        written = r"FileScan parquet \[(_file|_g)#"
        assert re.search(rf"Aggregate\(.*partial_|{written}", below), below


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert bool(re.search("EvalPython|InPandas", plan)) == (name in PYTHON_QUERIES)
    assert_bounded_single_partitions(plan)


def test_metrics_of_parts_share_one_scan(spark):
    plan = plan_of(metrics.evaluate(inputs.prediction_pairs(spark, SF_DIR), ["rouge", "bleu"]))
    assert plan.count("FileScan") == 1 and "Union" not in plan
    assert plan.count("Exchange SinglePartition") == 1


def test_bootstrap_moves_one_row_a_block(spark):
    plan = plan_of(metrics.rouge_bootstrap(inputs.prediction_pairs(spark, SF_DIR), "doc_id"))
    assert plan.count("FileScan") == 1
    assert re.search(r"Exchange hashpartitioning\(_block.*\n.*HashAggregate\(.*partial_sum", plan)


def test_split_moves_no_rows(spark):
    docs = inputs.table(spark, SF_DIR, "documents")
    plan = plan_of(sampling.split(docs, "doc_id"))
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


def test_only_read_columns_reach_the_scan(spark):
    docs = inputs.table(spark, SF_DIR, "documents")
    plan = plan_of(render.project_text(docs, "text"))
    assert re.search(r"ReadSchema: struct<text:string>", plan)


def test_filter_reaches_the_scan(spark):
    docs = inputs.table(spark, SF_DIR, "documents")
    kept = sampling.split(docs, "doc_id", 0).filter(F.col("lang") == "en").select("doc_id")
    assert "EqualTo(lang,en)" in plan_of(kept)


def test_large_rank_uses_many_groups(spark, monkeypatch):
    monkeypatch.setattr(sampling, "GROUP_ROWS", 20)
    docs = inputs.table(spark, SF_DIR, "documents").select("doc_id")
    plan = plan_of(sampling.shuffle_rank(docs, "doc_id"))
    assert "hashpartitioning(_g" in plan and "NestedLoop" not in plan
    assert_bounded_single_partitions(plan)
    sized = inputs.table(spark, SF_DIR, "documents").select("doc_id", "n_chars")
    plan = plan_of(sampling.rank_in_band(sized, F.floor(F.col("n_chars") / 1000), "doc_id"))
    assert "hashpartitioning(band" in plan and "NestedLoop" not in plan


def test_mixture_joins_broadcast_the_catalogue_only_within_its_bound(spark, monkeypatch):
    declared = catalogue.catalogue_table(spark, inputs.entries())
    records = inputs.mixture(spark, SF_DIR)
    assert "BroadcastHashJoin" in plan_of(mixture.resolve_mixture(records, declared))
    monkeypatch.setattr(catalogue, "BROADCAST_ENTRIES", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(mixture.resolve_mixture(records, declared))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_leaves_large_tables_alone(spark):
    small = readers.spread(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id")
    assert "Exchange" in plan_of(small)
    assert "Exchange" not in plan_of(readers.spread(spark.range(0, 100, 1, 64).toDF("doc_id"), "doc_id"))


@pytest.mark.parametrize("metric", [metrics.bleu, metrics.rouge])
def test_text_metrics_shuffle_only_their_sums(spark, metric):
    pairs = spark.range(100).selectExpr("string(id) as prediction", "string(id + 1) as reference")
    plan = plan_of(metric(pairs))
    assert plan.count("Exchange SinglePartition") == 1 and plan.count("ArrowEvalPython") == 1
    assert plan.index("Exchange SinglePartition") < plan.index("ArrowEvalPython")
