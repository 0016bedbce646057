"""Labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """0 to 4 by the crc32 of the id as text; fold 0 is held out. A null id is fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled ids outside fold 0, drawn by hash.

    The ids are bounded by `limit`, so they are the broadcast side and no text is shuffled.
    Ids with a null or with contradicting labels are left out.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold() != 0))
        .groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("top")).where("label = top")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "label")
    )
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, int(r.label)) for r in known.collect()], "doc_id long, label int")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
