"""Tables and settings the operators share: cut points in the folder the cluster names."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch: bounds what a Python worker holds at once, also for long texts.
BATCH_ROWS = 500


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where none is set, on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length, and let workers import this package."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [known.get("PYTHONPATH"), root]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The table goes when the application ends, or earlier with drop(). "zstd" suits texts that lie there for long.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    fs, place = _path(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that saved() wrote and nothing reads any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        fs, place = _path(df.sparkSession, path)
        fs.delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Let go of finished plans, so that Spark's cleaner deletes their shuffle files now and not some half hour later."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
