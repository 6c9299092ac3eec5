"""Session builder and the working folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the operators assume; on a cluster the submitted session is used as it is."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g"} | extra
    builder = SparkSession.builder.master(master).appName("tabulary").config(map=conf)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (local tests) a temporary folder of our own."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tabulary-"))
        at = context.getCheckpointDir()
    return at.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when it is released or the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    pid = os.getpid()

    if not SCRATCH:
        atexit.register(lambda: os.getpid() == pid and release(spark))
    SCRATCH.append(path)
    return path


#: Paths of this application below the shared folder that have not been released yet.
SCRATCH: list[str] = []


def release(spark: SparkSession) -> None:
    """Removes all scratch tables written so far: for long sessions, between queries whose results have been stored."""
    while SCRATCH:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            return


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of df, 0 where it has none, to size files and partitions by; it never decides what is computed."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
