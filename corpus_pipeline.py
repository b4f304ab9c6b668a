"""From raw documents to token ids: the stages in order, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mixloom.llm import bpe, langid, linededup, mixing, neardup
from mixloom.llm.common import table
from mixloom.session import materialize


def _beside(docs: DataFrame, names: list[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stage's rows with the columns of its documents, also those named like its own results."""
    own = {c: f"_own_{c}" for c in names if c in docs.columns}
    back = [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]
    return stage(docs.withColumnsRenamed(own)).select(*back)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that the labelled ones teach, however close; ``und`` goes."""
    languages, chance = langid.train(docs, F.lit(True))

    def known(rows: DataFrame) -> DataFrame:
        return langid.predict_language(rows, languages, chance).filter(F.col("lang_pred") != langid.UNKNOWN)

    return _beside(docs, ["lang_pred", "score"], known)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of repeated passages.

    A document of which nothing is left was a copy as a whole, and goes.
    """
    copied = (F.col("lines_deleted") > 0) & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) == "")
    whole = ~F.coalesce(copied, F.lit(False))
    return _beside(docs, ["lines_deleted"], lambda rows: linededup.drop_repeated_lines(rows).filter(whole))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five words to the shingle."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with checksums of the ids and of the decoded text."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

# Learned probabilities and token ids have no SQL form; tests/llm holds every stage
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through every stage; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
