"""Registered queries, and every stage of the pipeline on the smallest tables."""

import re

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from mixloom.llm import bpe, mixing
from mixloom.llm.common import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    numbers = {int(m[1]) for q in registered.queries() if (m := re.match(r"op(\d+)_", q))}
    assert numbers == set(range(1, 14)) and "pipeline" in registered.queries()


@pytest.fixture(scope="module")
def results(spark):
    """What every stage returns, on documents with some rows that each stage must handle."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = docs.orderBy("doc_id").first()["text"]
    extra = [(90_000, "1234 %%", "en", "s", 7), (90_001, None, None, None, None), (90_002, text, "fr", "s", len(text)),
             (90_003, "mot et " + " ".join(f"x{i}" for i in range(80)), "fr", None, 9),
             (90_004, "mot et " + " ".join(f"x{i}" for i in range(79)) + " y", "fr", None, 9)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF_DIR), f"test-{name}"))
    return dict(zip(["documents", *NAMES], out))


def is_part(text, whole):
    """Whether the sentences of a text are some of another's, in order."""
    units = lambda t: [u.strip() for u in re.split(r"\n|(?<=[.!?…])\s|(?<=[。！？])", t) if u.strip()]
    rest = iter(units(whole))
    return all(unit in rest for unit in units(text))


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_stages(results):
    for name in NAMES[:-1]:
        assert results[name].columns == results["documents"].columns
    kept = set(ids(results["language_id"]))
    assert set(ids(results["documents"])) - kept == {90_000, 90_001}
    lines = {r["doc_id"]: r["text"] for r in results["line_dedup"].collect()}
    before = {r["doc_id"]: r["text"] for r in results["language_id"].collect()}
    # What stays of a text are units of the input in their order: lines, or sentences of long lines.
    assert 90_002 not in lines and all(is_part(t, before[i]) for i, t in lines.items())
    near = set(ids(results["near_dedup"]))
    assert 90_003 in near and 90_004 not in near
    copies = {}
    for i in ids(results["mixing"]):
        copies[i] = copies.get(i, 0) + 1
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(results["near_dedup"]).collect() if r["copies"]}
    assert copies == want
    encoder = bpe.Encoder(bpe.read_vocabulary(tokenizer_path(bpe.VOCABULARY)))
    texts = {r["doc_id"]: r["text"] for r in results["mixing"].collect()}
    rows = results["bpe"].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids(results["mixing"]))
    assert all(encoder.decode(r["ids"]) == texts[r["doc_id"]] for r in rows)


def test_short_texts_of_close_languages_stay(spark):
    rows = [(i, f"radio taxi hotel {word}", lang) for i, (lang, word) in
            enumerate([("de", "und"), ("en", "and"), ("fr", "et")] * 3)]
    rows += [(20, "radio", None), (21, "hotel taxi", None), (22, "12 %%", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, SF_DIR)
    assert sorted(ids(kept)) == [*range(9), 20, 21]


def test_columns_named_like_results_stay(spark):
    rows = [(i, f"the house of the king number {i}\nand more words", "en", 0.5, "mine", 7) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, lines_deleted int")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.delete_repeated_lines):
        kept = stage(spark, docs, SF_DIR)
        assert kept.schema.simpleString() == docs.schema.simpleString()
        assert {(r["score"], r["lang_pred"], r["lines_deleted"]) for r in kept.collect()} == {(0.5, "mine", 7)}
