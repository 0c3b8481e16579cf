"""Session defaults and durable cut points."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "pedigraph", cores: str = "*") -> SparkSession:
    """A local session for the command line and tests; on a cluster pass your own."""
    return tuned(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        # no call-site lookup per column expression while plans are built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def tuned(spark: SparkSession) -> SparkSession:
    """Keep generated methods within what the JVM compiles.

    HotSpot never compiles a method above 8000 bytes of bytecode, so one oversized
    generated stage would run interpreted.  With this limit Spark runs such a stage
    operator by operator, each with split (and compiled) projections.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="pedigraph-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage at a checkpoint in the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it: a cut point of which later joins know the size."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(path: str) -> str:
    """Raise the usual error for a missing local input; other file systems are checked by Spark."""
    if "://" not in path and not os.path.exists(path):
        raise FileNotFoundError(2, "No such file or directory", path)
    return path
