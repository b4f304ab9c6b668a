"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "mixloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for.

    AQE sizes the shuffles (coalescing small partitions, splitting skewed join
    partitions), so no fixed partition count is baked into the operators.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares between its machines.

    The folder comes from ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder of this machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="mixloom-")
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/mixloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A small derived table written once to the shared folder and read back.

    Later steps then neither recompute it nor lose it with an executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
