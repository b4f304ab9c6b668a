"""Batch inference, token truncation and length-grouped batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mixloom.functions.text import as_text, words
from mixloom.operators.sampling import rank_in_band

LENGTH_STEP = 32


def batch_predict(
    df: DataFrame, prompt: str, make_predict_fn: Callable[[], Callable[[list], list]], batch_size: int = 64
) -> DataFrame:
    """A ``response`` per prompt from a user's batch function.

    ``make_predict_fn`` runs once per Python task (load the model there) and
    returns a function from a list of prompts to the list of their responses.
    """
    def respond(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for prompts in batches:
            responses: list = []
            for start in range(0, len(prompts), batch_size):
                responses.extend(predict(list(prompts[start:start + batch_size])))
            yield pd.Series(responses, dtype="object")

    return df.withColumn("response", F.pandas_udf(respond, "string")(F.col(prompt)))


def truncate_tokens(
    df: DataFrame, text: str = "text", max_tokens: int = 2048,
    tokenizer: Callable[[], Callable[[str], list[str]]] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Token count, and the first ``max_tokens`` tokens.

    Tokens are white-space separated words, split inside Spark. ``tokenizer``
    makes another splitter once per Python worker, applied to Arrow batches.
    """
    if tokenizer is None:
        tokens = words(as_text(F.col(text)))
    else:
        def split_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            split_one = tokenizer()
            for texts in batches:
                yield pd.Series([list(split_one(t or "")) for t in texts])

        tokens = F.pandas_udf(split_batches, "array<string>")(F.col(text))
    counted = df.select(*keep, tokens.alias("_tokens"))
    return counted.select(
        *keep,
        F.size("_tokens").alias("n_tokens"),
        F.slice("_tokens", 1, max_tokens).alias("tokens"),
    )


def length_batches(
    df: DataFrame, key: str, length: str, batch: int, step: int = LENGTH_STEP, seed: int = 42
) -> DataFrame:
    """Rows of similar length share a batch: adds ``band`` and ``batch``.

    Lengths within ``step`` of each other form a band; inside a band rows are
    numbered in a seeded order and cut into batches. Rows of unknown length are a
    band of their own, NULL.
    """
    band = F.floor(F.col(length) / step)
    ranked = rank_in_band(df, band, key, seed)
    return ranked.withColumn("batch", F.call_function("div", F.col("rank"), F.lit(batch))).drop("rank")


def padding_report(df: DataFrame, length: str) -> DataFrame:
    """Rows, tokens, longest row and padding of every batch made by ``length_batches``."""
    batches = df.groupBy("band", "batch").agg(
        F.count("*").alias("rows"), F.sum(length).alias("tokens"), F.max(length).alias("longest")
    )
    return batches.withColumn("padding", F.col("rows") * F.col("longest") - F.col("tokens"))
