"""Streams that are stopped, repeated and carried on."""

import os

from mixloom.sources import sinks
from mixloom.streaming import streams

SCHEMA = "step bigint, timestamp string, run bigint, loss double"


def add(spark, path, rows):
    sinks.append_metrics(spark.createDataFrame(rows, "run bigint, step bigint, loss double").coalesce(1), path)


def forget_last(checkpoint):
    """As if the process had died after the write and before the stream noted it."""
    commits = sorted((f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")


def test_summary_writes_only_changed_runs(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def carry_on():
        streams.run_metrics_stream(spark, source, SCHEMA, "run", "step", "loss", sink, state).awaitTermination()

    def current():
        return {r["run"]: (r["last_step"], r["min_loss"], r["best_step"]) for r in streams.latest_summary(spark, sink).collect()}

    changed = lambda n: {r["run"] for r in spark.read.parquet(f"{sink}/changes/batch={n}").collect()}
    add(spark, source, [(1, 1, 0.5), (2, 1, 0.7), (None, 4, 0.1)])
    carry_on()
    assert changed(0) == {1, 2, None} and current() == {1: (1, 0.5, 1), 2: (1, 0.7, 1), None: (4, 0.1, 4)}
    add(spark, source, [(2, 2, 0.6), (3, 9, 0.2)])
    carry_on()
    want = {1: (1, 0.5, 1), 2: (2, 0.6, 2), 3: (9, 0.2, 9), None: (4, 0.1, 4)}
    assert changed(1) == {2, 3} and current() == want
    forget_last(state)
    carry_on()
    assert changed(1) == {2, 3} and current() == want
    assert streams.compact_summary(spark, sink) == streams.compact_summary(spark, sink) == 1
    assert current() == want
    add(spark, source, [(3, 10, 0.1)])
    carry_on()
    assert current() == {**want, 3: (10, 0.1, 10)}
    assert streams.compact_summary(spark, sink) == 2 and current() == {**want, 3: (10, 0.1, 10)}


def test_lines_are_appended_once(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))

    def carry_on():
        arriving = spark.readStream.schema(SCHEMA).json(source)
        streams.append_metrics_stream(arriving.drop("timestamp"), log, state).awaitTermination()

    lines = lambda: sorted((r["run"], r["step"]) for r in spark.read.schema(SCHEMA).json(log).collect())
    add(spark, source, [(1, 1, 0.5), (1, 2, 0.4)])
    carry_on()
    add(spark, source, [(1, 3, 0.3)])
    carry_on()
    assert lines() == [(1, 1), (1, 2), (1, 3)]
    forget_last(state)
    carry_on()
    assert lines() == [(1, 1), (1, 2), (1, 3)]
