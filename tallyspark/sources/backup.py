"""Versioned backup of all tables, and a restore that refuses anything partial."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators.quality import issues

BACKUP_VERSION = 1
MARKER = "tallyspark-backup"
REQUIRED = ["transactions", "statements", "annotations"]
# sections that older backups may lack, and their columns
OPTIONAL = {
    "links": "ledger_id bigint, bank_source_hash string, bank_txn_index bigint, cc_source_hash string, cc_txn_index bigint",
    "categories": "ledger_id bigint, category_id string, name string, parent_id string",
    "rules": "ledger_id bigint, rule_no int, rule_id string, category_id string, enabled boolean",
    "limits": "ledger_id bigint, category_id string, limit_minor bigint",
    "goals": "ledger_id bigint, id string, name string, target_minor bigint, saved_minor bigint, deadline string",
}


def contracts() -> dict[str, Column]:
    """What every row of a section must have to be stored again."""
    filled = lambda c: F.length(F.trim(c)) > 0
    given = lambda *names: [(f"{n}: missing", F.col(n).isNotNull()) for n in names]
    key = given("ledger_id", "source_hash", "txn_index")
    currency = ("currency: not three capitals", F.col("currency").rlike(r"^[A-Z]{3}\z"))
    return {
        "transactions": issues([
            *key, *given("amount_minor", "posted_date"), currency,
            ("transaction_type: unknown", F.col("transaction_type").isin(schemas.TRANSACTION_TYPES)),
        ]),
        "statements": issues([
            *given("ledger_id"), ("source_hash: empty", filled("source_hash")), ("bank_name: empty", filled("bank_name")),
            ("account_type: unknown", F.col("account_type").isin(schemas.ACCOUNT_TYPES)), currency,
        ]),
        "annotations": issues(key),
        "links": issues(given("ledger_id", "bank_source_hash", "bank_txn_index", "cc_source_hash", "cc_txn_index")),
        "categories": issues([
            *given("ledger_id"), ("category_id: empty", filled("category_id")), ("name: empty", filled("name")),
            ("parent_id: itself", F.col("parent_id").isNull() | (F.col("parent_id") != F.col("category_id"))),
        ]),
        "rules": issues([*given("ledger_id", "enabled"), ("rule_id: empty", filled("rule_id")), ("category_id: empty", filled("category_id"))]),
        "limits": issues([*given("ledger_id", "category_id"), ("limit_minor: negative", F.col("limit_minor") >= 0)]),
        "goals": issues([*given("ledger_id", "target_minor"), ("id: empty", filled("id"))]),
    }


def _write_all(tables: dict[str, DataFrame], path: str) -> None:
    """All tables at the same time; their jobs share the cluster."""
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(lambda item: item[1].write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{item[0]}"), tables.items()))


def _counted(spark: SparkSession, path: str, names: Iterable[str], contracts: dict[str, Column]) -> DataFrame:
    """(table, rows, broken) of all tables in one job."""
    broken = lambda name: F.size(contracts[name]) > 0 if name in contracts else F.lit(False)
    return reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{path}/{name}").agg(
            F.lit(name).alias("table"), F.count("*").alias("rows"), F.count_if(broken(name)).alias("broken"))
        for name in names
    ])


def write_backup(spark: SparkSession, path: str, tables: dict[str, DataFrame], exported_at: str) -> DataFrame:
    """One Parquet directory per table, then the manifest, which makes the backup valid."""
    _write_all(tables, path)
    manifest = _counted(spark, path, sorted(tables), {})
    manifest = manifest.select(
        F.lit(MARKER).alias("app"), F.lit(BACKUP_VERSION).alias("backup_version"),
        F.lit(exported_at).alias("exported_at"), "table", "rows",
    )
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_backup(spark: SparkSession, path: str, contracts: dict[str, Column]) -> dict[str, DataFrame]:
    """Checked tables of a backup; raises before anything is handed out.

    Checks marker, version, required tables, row counts and every table's contract. Tables
    an old backup lacks come back empty.
    """
    manifest = {r["table"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    if not manifest or any(r["app"] != MARKER for r in manifest.values()):
        raise ValueError("not a backup of this library")
    version = max(r["backup_version"] for r in manifest.values())
    if version > BACKUP_VERSION:
        raise ValueError(f"version {version} is newer than {BACKUP_VERSION}")
    missing = [name for name in REQUIRED if name not in manifest]
    if missing:
        raise ValueError(f"incomplete backup, without {missing}")
    found = {r["table"]: r for r in _counted(spark, path, manifest, contracts).collect()}
    for name in manifest:
        if found[name]["rows"] != manifest[name]["rows"]:
            raise ValueError(f"{name} has {found[name]['rows']} of {manifest[name]['rows']} rows")
        if found[name]["broken"]:
            raise ValueError(f"{found[name]['broken']} rows of {name} break their contract")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest}
    for name, schema in OPTIONAL.items():
        tables.setdefault(name, spark.createDataFrame([], schema))
    return tables


def restore(spark: SparkSession, backup: str, target: str, contracts: dict[str, Column]) -> dict[str, DataFrame]:
    """Check everything, then overwrite the target tables."""
    tables = read_backup(spark, backup, contracts)
    _write_all(tables, target)
    return {name: spark.read.parquet(f"{target}/{name}") for name in tables}
