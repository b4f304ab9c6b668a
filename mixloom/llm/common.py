"""Helpers that several of the operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mixloom.session import materialize

# Fixed value: a word is a run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str, folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, name)


def word_count(text: Column) -> Column:
    """Number of words as a long; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a key's text modulo ``modulus``; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, inside higher-order functions too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number_rows(df: DataFrame, *order: str | Column, name: str = "numbered") -> DataFrame:
    """Rows numbered from 0 in a total order, as ``_number``, without one task seeing all.

    Rows are range partitioned and sorted, written with their place in the
    partition, and each partition's offset is the size of all earlier ones. The
    table of offsets has one row per partition, which bounds its broadcast.
    Rows equal in the order share a range; add columns until it identifies rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    low_bits = F.lit((1 << 33) - 1)
    written = materialize(
        placed.withColumns({
            "_piece": F.spark_partition_id(),
            "_at": F.monotonically_increasing_id().bitwiseAND(low_bits),
        }),
        name,
    )
    sizes = written.groupBy("_piece").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        written.join(F.broadcast(offsets), "_piece")
        .withColumn("_number", F.col("_before") + F.col("_at"))
        .drop("_piece", "_at", "_before")
    )
