"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", app: str = "quantloom", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _set_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY, None)
    if not named and not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quantloom-ckpt-"))


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage: write Parquet to the shared folder the cluster names and read it back.

    Used where one result feeds several branches that must agree even when an executor is
    lost. The table keeps column pruning, pushdown and statistics. A temporary folder is
    chosen only in local runs that name none.
    """
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the series key into the session's shuffle partitions.

    Windows over the same key reuse this partitioning. The explicit count keeps the
    adaptive planner from merging many small but compute-heavy window partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *(keys or ("ticker",)))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh subfolder of the shared checkpoint folder for tables a plan writes and re-reads."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        _set_checkpoint_dir(spark)
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

