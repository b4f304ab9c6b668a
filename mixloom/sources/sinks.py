"""Sinks: metric results, the run-metric log, and split tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric results as JSON, replacing earlier ones."""
    df.write.mode("overwrite").json(path)


def metric_lines(df: DataFrame, step: str = "step", timestamp: str | None = None) -> DataFrame:
    """Metric rows as lines ``{step, timestamp, …}``; without a timestamp column, the time of the write."""
    when = F.col(timestamp) if timestamp else F.current_timestamp()
    rest = [c for c in df.columns if c not in (step, timestamp)]
    return df.select(F.col(step).alias("step"), F.date_format(when, TIMESTAMP_FORMAT).alias("timestamp"), *rest)


def append_metrics(df: DataFrame, path: str, step: str = "step", timestamp: str | None = None) -> None:
    """Metric rows added to a JSON-lines log as ``{step, timestamp, …}``.

    Rows without a timestamp column are stamped with the time of the write.
    """
    metric_lines(df, step, timestamp).write.mode("append").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """A split table as Parquet, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
