"""Filters, lists, sorts and display projections over the unified rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import fixed
from tallyspark.functions.text import clean_description, trim_ws
from tallyspark.schemas import ROW_KEY


def flatten(imports: DataFrame) -> DataFrame:
    """Nested imports -> one row per transaction with the statement's context."""
    return imports.select(
        "ledger_id", "source_hash", "bank_name", "adapter_name", "adapter_version",
        F.col("statement.account_type").alias("account_type"),
        F.col("statement.account_last_4").alias("account_last_4"),
        F.coalesce("first_index", F.lit(0)).alias("first_index"),
        F.posexplode("transactions").alias("offset", "t"),
    ).select(
        "ledger_id", "source_hash", (F.col("first_index") + F.col("offset")).alias("txn_index"),
        "bank_name", "account_type", "account_last_4", "adapter_name", "adapter_version", "t.*",
    )


def account_key() -> Column:
    return F.concat_ws("::", "bank_name", "account_type", F.coalesce("account_last_4", F.lit("?")))


def _js_cents(amount: float) -> int:
    return int(amount * 100 + 0.5) if amount >= 0 else -int(-amount * 100 + 0.5)


def apply_filter(
    rows: DataFrame,
    account_keys: list[str] | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    amount_min: float | None = None,
    amount_max: float | None = None,
    search: str | None = None,
    types: list[str] | None = None,
) -> DataFrame:
    """All given constraints must hold; an empty one does not constrain."""
    tests: list[Column] = []
    if account_keys:
        tests.append(account_key().isin(account_keys))
    if date_from:
        tests.append(F.col("posted_date") >= F.lit(date_from).cast("date"))
    if date_to:
        tests.append(F.col("posted_date") <= F.lit(date_to).cast("date"))
    if amount_min is not None:
        tests.append(F.abs("amount_minor") >= _js_cents(amount_min))
    if amount_max is not None:
        tests.append(F.abs("amount_minor") <= _js_cents(amount_max))
    if types:
        tests.append(F.col("transaction_type").isin(types))
    for token in (search or "").lower().split():
        tests.append(F.contains(F.lower("description"), F.lit(token)))
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def month_range(rows: DataFrame, month: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows of one month; explicit dates override its ends."""
    first = F.to_date(F.lit(f"{month}-01"))
    low = F.lit(date_from).cast("date") if date_from else first
    high = F.lit(date_to).cast("date") if date_to else F.last_day(first)
    return rows.filter(F.col("posted_date").between(low, high))


def with_tag(overlaid: DataFrame, tag: str) -> DataFrame:
    return overlaid.filter(F.array_contains("tags", tag))


def tags(annotations: DataFrame) -> DataFrame:
    return annotations.select("ledger_id", F.explode("tags").alias("tag")).distinct().orderBy("ledger_id", "tag")


def accounts(rows: DataFrame) -> DataFrame:
    return rows.select("ledger_id", "bank_name", "account_type", "account_last_4").distinct().orderBy(
        "ledger_id", "bank_name", "account_type", "account_last_4"
    )


def account_names(headers: DataFrame, manual_names: DataFrame) -> DataFrame:
    """Display names: Cash, then statements, then names added by hand.

    Names that differ in case only count once, spelled as first seen.
    """
    last4 = F.col("account_last_4")
    shown = F.when(
        (F.col("adapter_name") != "manual") & last4.isNotNull() & (last4 != ""),
        F.concat_ws(" ", "bank_name", "account_last_4"),
    ).otherwise(F.col("bank_name"))
    from_statements = headers.select("ledger_id", shown.alias("name"), F.lit(1).alias("tier"), F.col("source_hash").alias("seen"))
    by_hand = manual_names.select("ledger_id", "name", F.lit(2).alias("tier"), F.lpad(F.col("name_no").cast("string"), 10, "0").alias("seen"))
    cash = headers.select("ledger_id").distinct().select(
        "ledger_id", F.lit("Cash").alias("name"), F.lit(0).alias("tier"), F.lit("").alias("seen")
    )
    every = cash.unionByName(from_statements).unionByName(by_hand).withColumn("name", trim_ws(F.col("name")))
    return (
        every.filter(F.col("name") != "")
        .groupBy("ledger_id", F.lower("name").alias("folded"))
        .agg(F.min(F.struct("tier", "seen", "name"))["name"].alias("name"))
        .select("ledger_id", "name")
        .orderBy("ledger_id", F.col("name") != "Cash", "name")
    )


def nicknames(accounts_table: DataFrame, nickname_table: DataFrame) -> DataFrame:
    """Nickname if one is set and not blank, else the raw name; reserved names keep theirs."""
    usable = nickname_table.filter(
        ~F.col("name").isin(fixed.RESERVED_ACCOUNT_NAMES) & (trim_ws(F.col("nickname")) != "")
    ).select("ledger_id", "name", trim_ws(F.col("nickname")).alias("nickname"))
    return accounts_table.join(usable, ["ledger_id", "name"], "left").withColumn(
        "display_name", F.coalesce("nickname", "name")
    )


def detailed(overlaid: DataFrame) -> DataFrame:
    """Rows for a drill-down list. A blank custom name is kept here, as the lists show it."""
    return overlaid.select(
        *ROW_KEY, "posted_date",
        F.coalesce("custom_name", clean_description(F.col("description"))).alias("description"),
        "amount_minor", "category_id", "bank_name", "ignored",
        F.when(F.col("refund_source_hash") != "", F.col("refund_source_hash")).alias("refund_source_hash"),
        F.when(F.col("refund_source_hash") != "", F.col("refund_txn_index")).alias("refund_txn_index"),
    )


def review_queue(overlaid: DataFrame) -> DataFrame:
    """Uncategorised rows that are not ignored, newest first."""
    return overlaid.filter(F.col("category_id").isNull() & ~F.col("ignored")).orderBy(
        F.desc("posted_date"), "ledger_id", "source_hash", "txn_index"
    )


def refund_candidates(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("amount_minor") < 0)


def statement_rows(rows: DataFrame, source_hash: str) -> DataFrame:
    return rows.filter(F.col("source_hash") == source_hash)


def category_drill(overlaid: DataFrame, category_id: str | None) -> DataFrame:
    return overlaid.filter((F.col("amount_minor") < 0) & F.col("category_id").eqNullSafe(F.lit(category_id)))


def month_navigation(month_table: DataFrame, current: str) -> DataFrame:
    """Months with data and the current one, each with its neighbours."""
    now = month_table.select("ledger_id").distinct().withColumn("month", F.lit(current))
    every = month_table.withColumn("has_data", F.lit(True)).unionByName(now.withColumn("has_data", F.lit(False)))
    merged = every.groupBy("ledger_id", "month").agg(F.max("has_data").alias("has_data"))
    order = Window.partitionBy("ledger_id").orderBy("month")
    return merged.withColumns({
        "previous_month": F.lag("month").over(order), "next_month": F.lead("month").over(order),
    })


def summary_lines(headers: DataFrame) -> DataFrame:
    """Printed summary lines, verbatim and in order; statements without lines stay."""
    return headers.select(
        "ledger_id", "source_hash", F.posexplode_outer("summary_lines").alias("line_no", "line")
    ).select("ledger_id", "source_hash", "line_no", "line.label", "line.amount_minor")


SORTS = {
    "date": lambda: F.col("posted_date"),
    "description": lambda: F.lower("description"),
    "amount": lambda: F.col("amount_minor"),
    "account": lambda: F.concat_ws("::", "bank_name", F.coalesce("account_last_4", F.lit(""))),
    "type": lambda: F.col("transaction_type"),
}


def sort_rows(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Sorted by one key; ties keep the order of date, statement and row."""
    column = SORTS[key]()
    return rows.orderBy(column.desc() if descending else column.asc(), "posted_date", "source_hash", "txn_index")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of each ledger's list, newest first, with the ledger's row count."""
    newest = Window.partitionBy("ledger_id").orderBy(
        F.desc("posted_date"), F.desc("source_hash"), F.desc("txn_index")
    )
    totals = rows.groupBy("ledger_id").agg(F.count("*").alias("total"))
    return (
        rows.withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= (number + 1) * size)
        .filter(F.col("rank") > number * size)
        .join(totals, "ledger_id")
    )


def category_names(usage: DataFrame, categories: DataFrame) -> DataFrame:
    """Name of the category, 'Uncategorized' without one, the id when it is unknown."""
    return usage.join(categories.select("category_id", "name"), "category_id", "left").withColumn(
        "category_name",
        F.when(F.col("category_id").isNull(), F.lit("Uncategorized")).otherwise(F.coalesce("name", "category_id")),
    ).drop("name")


def category_usage(annotations: DataFrame) -> DataFrame:
    return annotations.filter(F.col("category_id").isNotNull()).groupBy("ledger_id", "category_id").agg(
        F.count("*").alias("rows")
    )
