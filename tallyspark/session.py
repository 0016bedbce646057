"""Session settings and durable cut points."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job of this library relies on; sizes stay with the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local one is made only on a local master."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that its lineage is cut.

    Parquet with zstd takes a fraction of Spark's own checkpoints, which hold rows as they are in memory. The files
    go when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/durable-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Seconds between two collections of finished plans.
RELEASE_EVERY = 10.0
_RELEASED = [0.0]


def release(spark: SparkSession) -> None:
    """Let go of finished plans, so that Spark's cleaner deletes their shuffle files now and not some half hour later."""
    if time.monotonic() - _RELEASED[0] >= RELEASE_EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _RELEASED[0] = time.monotonic()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
