"""Cut points take little disk."""

from pyspark.sql import functions as F

from tallyspark import session
from tallyspark.plans import fixtures as fx

DATA = "/root/testdata/sf0.001"


def test_cut_points_are_zstd(spark):
    rows = fx.ledger(spark, DATA).withColumn("pair", F.struct("ledger_id", F.lit(None).cast("string").alias("none")))
    cut = session.durable(rows)
    files = cut.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    assert cut.dtypes == rows.dtypes and cut.exceptAll(rows).isEmpty() and cut.count() == rows.count()
