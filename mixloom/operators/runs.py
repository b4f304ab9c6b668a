"""Training-run tables: planned steps, metric summaries, checkpoints, remaining time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DAY, HOUR, MINUTE = 86_400, 3_600, 60


def planned_steps(
    df: DataFrame, batch: int, accum: int, epochs: int, max_steps: int = -1, dataset: str = "dataset"
) -> DataFrame:
    """Training steps per dataset: ``max_steps`` when positive, else from the row count."""
    steps = F.call_function("div", F.count("*"), F.lit(batch * accum)) * epochs
    if max_steps > 0:
        steps = F.lit(max_steps).cast("bigint")
    return df.groupBy(dataset).agg(F.count("*").alias("rows"), steps.alias("steps"))


def run_metrics(
    df: DataFrame, run: str, step: str, metric: str, epoch: str | None = None, eval_metric: str | None = None
) -> DataFrame:
    """Last, mean, least and best value of a metric per run, or per run and epoch.

    The best row is the one of the least ``eval_metric`` (the metric itself
    unless given), the earliest of equals. All parts combine before the shuffle.
    """
    best = F.col(eval_metric or metric)
    keys = [run] + ([epoch] if epoch else [])
    return df.groupBy(*keys).agg(
        F.max(step).alias("last_step"),
        F.max_by(metric, step).alias(f"last_{metric}"),
        F.avg(metric).alias(f"mean_{metric}"),
        F.min(metric).alias(f"min_{metric}"),
        F.min(best).alias("best_value"),
        F.min_by(step, F.when(best.isNotNull(), F.struct(best, F.col(step)))).alias("best_step"),
    )


def latest_checkpoint(df: DataFrame, run: str, name: str) -> DataFrame:
    """The checkpoint with the greatest number per run, by value and not as text."""
    number = F.regexp_extract(F.col(name), r"(\d+)$", 1)
    numbered = F.when(number != "", number.cast("bigint"))
    return df.groupBy(run).agg(
        F.max_by(name, numbered).alias("checkpoint"), F.max(numbered).alias("number")
    )


def _duration_text(seconds: Column) -> Column:
    """Whole seconds as ``[d day[s], ]h:mm:ss``."""
    days = F.floor(seconds / DAY)
    rest = seconds - days * DAY
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / HOUR), F.floor(rest % HOUR / MINUTE), rest % MINUTE,
    )
    unit = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days != 0, F.concat(days.cast("string"), unit, clock)).otherwise(clock)


def run_eta(df: DataFrame, run: str, step: str, ts: str, total: int | Column) -> DataFrame:
    """Remaining time per run from its latest step: time per step times steps left.

    The clock starts with the run's first row. Time per step is rounded to
    microseconds, halves to even. Unknown (NULL seconds) at step 0.
    """
    total = F.lit(total).cast("bigint") if isinstance(total, int) else total
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    runs = df.groupBy(run).agg(
        F.max(step).cast("bigint").alias("step"),
        (F.max(micros) - F.min(micros)).alias("_elapsed"),
        F.max(total).alias("total"),
    )
    whole = F.call_function("div", F.col("_elapsed"), F.nullif(F.col("step"), F.lit(0)))
    twice = (F.col("_elapsed") - whole * F.col("step")) * 2
    up = (twice > F.col("step")) | ((twice == F.col("step")) & (whole % 2 == 1))
    per_step = whole + F.when(up, 1).otherwise(0)
    left = F.col("total") - F.col("step")
    seconds = F.floor(F.try_divide(per_step * left, F.lit(1_000_000)))
    known = F.col("seconds_left").isNotNull()
    return runs.select(run, "step", "total", seconds.alias("seconds_left")).withColumn(
        "remaining", F.when(known, _duration_text(F.col("seconds_left"))).otherwise("Unknown")
    )
