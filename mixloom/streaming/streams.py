"""Chat rendering and run-metric summaries over streams of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mixloom.operators.render import render_chat
from mixloom.operators.runs import run_metrics
from mixloom.sources.sinks import metric_lines


def render_chat_stream(
    spark: SparkSession, source: str, schema: str, messages: str, tags: dict[str, str] | None,
    keep: tuple[str, ...], sink: str, checkpoint: str,
) -> StreamingQuery:
    """Render JSON-lines chat records as they arrive into Parquet files.

    The rendering is stateless, so each file is read once and a restart
    continues from the checkpoint.
    """
    arriving = spark.readStream.schema(schema).json(source)
    rendered = render_chat(arriving, messages, tags, keep)
    return (
        rendered.writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def append_metrics_stream(
    arriving: DataFrame, path: str, checkpoint: str, step: str = "step", timestamp: str | None = None
) -> StreamingQuery:
    """Arriving metric rows added to a JSON-lines log, each once.

    A trigger writes the folder named by its number, and a trigger repeated after a failure
    writes that folder again, whatever the first attempt left there.
    """
    def publish(rows: DataFrame, batch: int) -> None:
        metric_lines(rows, step, timestamp).write.mode("overwrite").json(f"{path}/batch={batch}")

    return (
        arriving.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_metrics_stream(
    spark: SparkSession, source: str, schema: str, run: str, step: str, metric: str,
    sink: str, checkpoint: str, files_per_trigger: int = 1_000,
) -> StreamingQuery:
    """Keep the summary of every run in an appended metric log up to date.

    State is one row of partial aggregates per run. A trigger writes the runs that changed
    in it, and no others, under ``changes/batch=`` with its number, so a trigger repeated after
    a failure writes the same rows over themselves. :func:`latest_summary` is the current
    table; :func:`compact_summary` keeps what it reads small.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)

    def publish(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/changes/batch={batch}")

    return (
        run_metrics(reader.json(source), run, step, metric).writeStream.outputMode("update")
        .foreachBatch(publish).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _compacted(spark: SparkSession, sink: str) -> int | None:
    """The last trigger of the newest finished compaction."""
    try:
        return spark.read.parquet(f"{sink}/compacted").agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_summary(spark: SparkSession, sink: str, run: str = "run") -> DataFrame:
    """The current row of every run: that of the last trigger in which the run changed."""
    rows, upto = spark.read.parquet(f"{sink}/changes"), _compacted(spark, sink)
    if upto is not None:
        base = spark.read.parquet(f"{sink}/base").filter(F.col("batch") == upto)
        rows = base.unionByName(rows.filter(F.col("batch") > upto))
    columns = [c for c in rows.columns if c != "batch"]
    newest = rows.groupBy(run).agg(F.max_by(F.struct(*columns), "batch").alias("row"))
    return newest.select("row.*")


def compact_summary(spark: SparkSession, sink: str, run: str = "run") -> int:
    """Write the current table once, so that earlier changes are not read again; gives its last trigger.

    Readers turn to it only when it is complete. Repeating it changes nothing.
    """
    newest = spark.read.parquet(f"{sink}/changes").agg(F.max("batch")).first()[0]
    if _compacted(spark, sink) != newest:
        latest_summary(spark, sink, run).write.mode("overwrite").parquet(f"{sink}/base/batch={newest}")
        done = spark.range(1).select(F.lit(newest).alias("batch"))
        done.write.mode("append").parquet(f"{sink}/compacted")
    return newest
