"""Session helpers. On a cluster the caller's session and settings are used as they are."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "8", app: str = "layerlog", **conf: str) -> SparkSession:
    """A local session for tests and the bench; UTC, ANSI, adaptive execution."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LAYERLOG_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only a local master may go without; then it is a temporary one."""
    ctx = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not ctx._jsc.sc().getCheckpointDir().isDefined():
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="layerlog-")
    if not ctx._jsc.sc().getCheckpointDir().isDefined():
        ctx.setCheckpointDir(shared)
    return shared or ctx._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder and cut its lineage (reliable; survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the checkpoint folder, for what is read several times by some of its columns. Gone when the driver ends."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())
