"""Landed state files: nested imports as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schemas import STATE_IMPORT

STATE_VERSION = 1
BIGINT_MARK = "__bigint__:"


def unmark(column: str):
    """'__bigint__:123' -> 123; anything else is null and fails the contract."""
    return F.when(
        F.col(column).startswith(BIGINT_MARK), F.substring(F.col(column), len(BIGINT_MARK) + 1, 40)
    ).try_cast("bigint")


def read_state(spark: SparkSession, path: str, version: int = STATE_VERSION) -> DataFrame:
    """Nested imports; a file written by a newer version is refused."""
    state = spark.read.schema(STATE_IMPORT).option("mode", "FAILFAST").json(path)
    newest = state.agg(F.max("version")).first()[0]
    if newest is not None and newest > version:
        raise ValueError(f"state version {newest} is newer than {version}; upgrade before loading it")
    return state


def state_rows(state: DataFrame) -> DataFrame:
    """Flat rows with money as bigint and the default status."""
    from tallyspark.operators.views import flatten

    return flatten(state).withColumns({
        "amount_minor": unmark("amount_minor"), "posted_date": F.col("posted_date").try_cast("date"),
        "status": F.coalesce("status", F.lit("posted")),
    })


def write_state(nested: DataFrame, path: str) -> None:
    """Write nested imports with marked money; field names repeat on every line, so files are compressed."""
    marked = nested.withColumn("version", F.lit(STATE_VERSION)).withColumn(
        "transactions",
        F.transform("transactions", lambda t: t.withField(
            "amount_minor", F.concat(F.lit(BIGINT_MARK), t["amount_minor"]))),
    )
    marked.write.mode("overwrite").option("compression", "gzip").json(path)
