"""Checksum gate and row contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions.dates import is_iso_date
from tallyspark.functions.money import format_money

STATEMENT_KEY = ["ledger_id", "source_hash"]


def statement_sums(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Headers with the sums of their rows; a statement without rows sums to zero."""
    amount = F.col("amount_minor")
    sums = rows.groupBy(*STATEMENT_KEY).agg(
        F.sum(amount).alias("row_sum"),
        F.sum(F.when(amount < 0, -amount).otherwise(0)).alias("debit_sum"),
        F.sum(F.when(amount > 0, amount).otherwise(0)).alias("credit_sum"),
        F.count("*").alias("row_count"),
    )
    return headers.join(sums, STATEMENT_KEY, "left").fillna(
        0, ["row_sum", "debit_sum", "credit_sum", "row_count"]
    )


def _usd(amount: Column) -> Column:
    return format_money(amount, F.lit("USD"))


def _level(level: str, expected: Column, actual: Column, passed: Column, diff: Column, message: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"), passed.alias("passed"), expected.alias("expected_minor"),
        actual.alias("actual_minor"), diff.alias("diff_minor"), message.alias("message"),
    )


def _missing(level: str, fields: str) -> Column:
    none = F.lit(None).cast("bigint")
    return _level(level, none, none, F.lit(False), none, F.lit(f"{level} lacks {fields}"))


def _compared(printed: Column, found: Column) -> Column:
    return F.concat(
        F.lit("printed "), _usd(printed), F.lit(", rows give "), _usd(found), F.lit(", apart "), _usd(F.abs(found - printed))
    )


def _equation(level: str, expected: Column, actual: Column) -> Column:
    diff = expected - actual
    message = F.when(diff == 0, F.concat(F.lit(f"{level} holds at "), _usd(actual))).otherwise(
        F.concat(F.lit(f"{level} fails: "), _compared(actual, expected))
    )
    return _level(level, expected, actual, diff == 0, diff, message)


def _section(title: str, printed: Column, found: Column) -> Column:
    return F.when(found != printed, F.concat(F.lit(f"{title} "), _compared(printed, found)))


def level_a() -> Column:
    """opening + rows = closing."""
    opening, closing = F.col("opening_balance_minor"), F.col("closing_balance_minor")
    return F.when(opening.isNull() | closing.isNull(), _missing("A", "opening or closing")).otherwise(
        _equation("A", opening + F.col("row_sum"), closing)
    )


def level_b() -> Column:
    """debits and credits = their printed totals."""
    debits, credits = F.col("total_debits_minor"), F.col("total_credits_minor")
    found_d, found_c = F.col("debit_sum"), F.col("credit_sum")
    passed = (found_d == debits) & (found_c == credits)
    message = F.when(
        passed, F.concat(F.lit("B holds at debits "), _usd(debits), F.lit(", credits "), _usd(credits))
    ).otherwise(F.concat(F.lit("B fails: "), F.concat_ws(
        "; ", _section("debits", debits, found_d), _section("credits", credits, found_c)
    )))
    return F.when(debits.isNull() | credits.isNull(), _missing("B", "total debits or credits")).otherwise(_level(
        "B", debits + credits, found_d + found_c, passed,
        F.when(passed, F.lit(0)).otherwise(found_d - debits + found_c - credits).cast("bigint"), message,
    ))


def level_c() -> Column:
    """previous + charges - payments = new balance."""
    previous, balance = F.col("previous_balance_minor"), F.col("statement_balance_minor")
    return F.when(previous.isNull() | balance.isNull(), _missing("C", "previous or new balance")).otherwise(
        _equation("C", previous + F.col("debit_sum") - F.col("credit_sum"), balance)
    )


def level_d() -> Column:
    """row count = printed count."""
    printed, found = F.col("printed_transaction_count"), F.col("row_count")
    message = F.when(printed == found, F.concat(F.lit("D holds at "), printed.cast("string"))).otherwise(
        F.concat(F.lit("D fails: printed "), printed.cast("string"), F.lit(", rows "), found.cast("string"))
    )
    return F.when(printed.isNull(), _missing("D", "printed count")).otherwise(
        _level("D", printed, found, printed == found, printed - found, message)
    )


LEVELS = {"A": level_a, "B": level_b, "C": level_c, "D": level_d}


def level_results(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per statement and declared level, in declared order."""
    sums = statement_sums(headers, rows)
    declared = sums.select("*", F.posexplode("parser_provides").alias("level_no", "declared"))
    result = reduce(
        lambda acc, item: acc.when(F.col("declared") == item[0], item[1]()),
        list(LEVELS.items())[1:], F.when(F.col("declared") == "A", level_a()),
    )
    return declared.withColumn("r", result).select(*STATEMENT_KEY, "level_no", "r.*")


def checksum_gate(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Accept or refuse every statement.

    Nothing declared, or only the row count, refuses; otherwise every declared level must
    pass. All levels are evaluated in one pass over the statement sums.
    """
    sums = statement_sums(headers, rows)
    results = F.transform("parser_provides", lambda level: reduce(
        lambda acc, item: acc.when(level == item[0], item[1]()),
        list(LEVELS.items())[1:], F.when(level == "A", level_a()),
    ))
    checked = sums.withColumn("results", results)
    failed = F.filter("results", lambda r: ~r["passed"])
    provides = F.col("parser_provides")
    strong = F.size(F.filter(provides, lambda level: level != "D"))
    reason = (
        F.when(F.size(provides) == 0, F.lit("refused, no level declared"))
        .when(strong == 0, F.lit("refused, a count alone proves no sum"))
        .when(
            F.size(failed) > 0,
            F.concat(F.lit("refused, "), F.array_join(F.transform(failed, lambda r: r["message"]), "; ")),
        )
    )
    return checked.withColumn("reason", reason).withColumns({
        "ok": F.col("reason").isNull(),
        "strategy_used": F.when(F.col("reason").isNull(), F.array_join("parser_provides", "+")),
    })


def accepted_rows(rows: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of accepted statements; refused ones never reach the fact table."""
    return rows.join(gate.filter("ok").select(*STATEMENT_KEY), STATEMENT_KEY, "left_semi")


# ---- contracts -------------------------------------------------------------------------


def issues(checks: list[tuple[str, Column]]) -> Column:
    """Messages of all checks that do not hold; a null outcome counts as broken."""
    return F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in checks]),
        lambda message: message.isNotNull(),
    )


def row_contract() -> Column:
    text = lambda c: F.col(c).isNotNull()
    return issues([
        ("posted_date: not an ISO date", is_iso_date(F.col("posted_date"))),
        ("description: missing", text("description")),
        ("raw_text: missing", text("raw_text")),
        ("amount_minor: not an integer amount", F.col("amount_minor").isNotNull()),
        ("currency: not three capitals", F.col("currency").rlike(r"^[A-Z]{3}\z")),
        ("transaction_type: unknown", F.col("transaction_type").isin(schemas.TRANSACTION_TYPES)),
        ("status: unknown", F.col("status").isNull() | F.col("status").isin(schemas.STATUSES)),
    ])


def header_contract() -> Column:
    filled = lambda c: F.length(c) > 0
    return issues([
        ("bank_name: empty", filled("bank_name")),
        ("adapter_name: empty", filled("adapter_name")),
        ("source_hash: empty", filled("source_hash")),
        ("account_type: unknown", F.col("account_type").isin(schemas.ACCOUNT_TYPES)),
        ("account_last_4: not three to five digits",
         F.col("account_last_4").isNull() | F.col("account_last_4").rlike(r"^\d{3,5}\z")),
        ("currency: not three capitals", F.col("currency").rlike(r"^[A-Z]{3}\z")),
        ("printed_transaction_count: negative",
         F.col("printed_transaction_count").isNull() | (F.col("printed_transaction_count") >= 0)),
        ("parser_provides: empty or unknown",
         (F.size("parser_provides") > 0)
         & F.forall("parser_provides", lambda level: level.isin(schemas.CHECKSUM_LEVELS))),
        ("summary_lines: line without label", F.forall("summary_lines", lambda s: F.length(s["label"]) > 0)),
    ])


def goal_contract() -> Column:
    return issues([
        ("id: empty", F.length(F.trim("id")) > 0),
        ("name: empty", F.length(F.trim("name")) > 0),
        ("target: not positive", F.col("target_minor") > 0),
        ("saved: negative", F.coalesce("saved_minor", F.lit(0)) >= 0),
        ("deadline: not ISO YYYY-MM-DD",
         F.col("deadline").isNull() | F.col("deadline").rlike(r"^\d{4}-\d{2}-\d{2}\z")),
    ])


def broken(df: DataFrame, contract: Column, keys: list[str]) -> DataFrame:
    """One row per issue."""
    return df.select(*keys, F.explode(contract).alias("issue"))


def split_by_contract(df: DataFrame, contract: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, quarantined rows with their issues)."""
    checked = df.withColumn("issues", contract)
    return checked.filter(F.size("issues") == 0).drop("issues"), checked.filter(F.size("issues") > 0)
