"""Annotation overlay, refund categories, splits and flow intents."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import fixed
from tallyspark.functions.text import clean_description, first_match, rlike_any_case
from tallyspark.schemas import (
    INCOME_INTENTS, REFUND_INTENTS, ROW_KEY, SPEND_INTENTS,
)


def effective_categories(annotations: DataFrame) -> DataFrame:
    """Annotations plus effective_category: a linked refund takes its original's category.

    Only rows that carry a link take part in the second join, so rows without one never
    pile up on a null key.
    """
    link = (
        F.col("refund_source_hash").isNotNull()
        & (F.col("refund_source_hash") != "")
        & ~((F.col("refund_source_hash") == F.col("source_hash"))
            & (F.col("refund_txn_index") == F.col("txn_index")))
    )
    links = annotations.filter(link).select(*ROW_KEY, "refund_source_hash", "refund_txn_index")
    originals = annotations.select(
        F.col("ledger_id"),
        F.col("source_hash").alias("refund_source_hash"),
        F.col("txn_index").alias("refund_txn_index"),
        F.col("category_id").alias("original_category"),
    )
    inherited = links.join(
        originals, ["ledger_id", "refund_source_hash", "refund_txn_index"]
    ).select(*ROW_KEY, "original_category", F.lit(True).alias("has_original"))
    return annotations.join(inherited, ROW_KEY, "left").withColumn(
        "effective_category",
        F.when(F.col("has_original"), F.col("original_category")).otherwise(F.col("category_id")),
    ).drop("original_category", "has_original")


def overlay(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows LEFT JOIN annotations on the row key; ignored becomes a plain boolean."""
    edits = annotations.withColumn("annotated", F.lit(True)).withColumnRenamed(
        "flow_intent", "user_intent"
    )
    return rows.join(edits, ROW_KEY, "left").withColumns({
        "annotated": F.coalesce("annotated", F.lit(False)),
        "ignored": F.coalesce("ignored", F.lit(False)),
    })


def resolved_overlay(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """Overlay whose effective_category follows refund links one hop."""
    return overlay(rows, effective_categories(annotations))


def split_rows(overlaid: DataFrame) -> DataFrame:
    """Drop ignored rows; turn a split row into its parts plus a remainder.

    Adds part_no, part_intent and part_category; amount_minor becomes the part's amount,
    so the sum over a row's parts always equals the row.
    """
    part = lambda category, amount, intent, no: F.struct(
        category.alias("part_category"), amount.alias("part_amount"),
        intent.alias("part_intent"), no.alias("part_no"),
    )
    none = F.lit(None).cast("string")
    parts = F.transform(
        "split",
        lambda p, i: part(p["category_id"], p["amount_minor"], p["flow_intent"], (i + 1).cast("int")),
    )
    total = F.aggregate("split", F.lit(0).cast("bigint"), lambda acc, p: acc + p["amount_minor"])
    remainder = F.col("amount_minor") - total
    rest = F.array(part(F.col("effective_category"), remainder, none, (F.size("split") + 1).cast("int")))
    whole = F.array(part(F.col("effective_category"), F.col("amount_minor"), none, F.lit(0)))
    expanded = F.when(
        F.coalesce(F.size("split"), F.lit(-1)) > 0,
        F.when(remainder != 0, F.concat(parts, rest)).otherwise(parts),
    ).otherwise(whole)
    return (
        overlaid.filter(~F.col("ignored"))
        .withColumn("whole_minor", F.col("amount_minor"))
        # never empty; the outer form spares a derived non-empty test of the whole expression
        .withColumn("part", F.explode_outer(expanded))
        .select("*", "part.*")
        .drop("part")
        .withColumn("amount_minor", F.col("part_amount"))
        .drop("part_amount")
    )


def _pattern_cases(cleaned: Column, amount: Column, value: int) -> list[tuple[Column, Column]]:
    """One case per run of neighbouring patterns with the same outcome.

    Such a run is one alternation; order between runs keeps first-match semantics, and the
    shorter chain stays within one generated method.
    """
    cases = []
    for (intent, direction, label), run in groupby(fixed.FLOW_PATTERNS, key=lambda p: p[:3]):
        hit = rlike_any_case(cleaned, "|".join(f"(?:{p[3]})" for p in run))
        if direction == "in":
            hit = (amount >= 0) & hit
        elif direction == "out":
            hit = (amount < 0) & hit
        cases.append((hit, F.lit((intent, direction, label)[value])))
    return cases


def flow_pattern(rows: DataFrame) -> DataFrame:
    """First built-in pattern that fits the cleaned text and the direction of the row."""
    cleaned = rows.withColumn("cleaned", clean_description(F.col("description")))
    amount = F.col("amount_minor")
    return cleaned.withColumns({
        "pattern_intent": first_match(_pattern_cases(F.col("cleaned"), amount, 0)),
        "pattern_label": first_match(_pattern_cases(F.col("cleaned"), amount, 2)),
    })


def infer_flow(
    overlaid: DataFrame,
    reconciled: DataFrame | None = None,
    transfer_legs: DataFrame | None = None,
    paychecks: DataFrame | None = None,
) -> DataFrame:
    """Flow intent of every row that is not ignored.

    Order: user, reconciled card payment, transfer pair, paycheck inflow, pattern, sign.
    The three key sets are optional tables of row keys; without them patterns decide.
    """
    rows = flow_pattern(overlaid.filter(~F.col("ignored"))).drop("pattern_label")
    tiers: list[Column] = [F.col("user_intent")]
    drop = []
    for flag, keys, intent, guard in (
        ("is_reconciled", reconciled, "cc_payment", F.lit(True)),
        ("is_transfer", transfer_legs, "transfer_self", F.lit(True)),
        ("is_paycheck", paychecks, "salary", F.col("amount_minor") > 0),
    ):
        if keys is None:
            continue
        marks = keys.select(*ROW_KEY).distinct().withColumn(flag, F.lit(True))
        rows = rows.join(marks, ROW_KEY, "left")
        tiers.append(F.when(F.col(flag) & guard, F.lit(intent)))
        drop.append(flag)
    by_sign = F.when(
        F.col("amount_minor") < 0,
        F.when(F.col("account_type") == "credit_card", F.lit("purchase")).otherwise(F.lit("unknown")),
    ).otherwise(F.lit("gift_in"))
    intent = F.coalesce(*tiers, F.col("pattern_intent"), by_sign)
    # the outer form keeps a filter of the intent from working out every pattern and its text again
    return rows.withColumn("flow_intent", F.explode_outer(F.array(intent))).drop(*drop)


def bucket_of(intent: Column) -> Column:
    """spend (refunds included), income or movement."""
    return (
        F.when(intent.isin(SPEND_INTENTS + REFUND_INTENTS), F.lit("spend"))
        .when(intent.isin(INCOME_INTENTS), F.lit("income"))
        .otherwise(F.lit("movement"))
    )


def routed_parts(flowed: DataFrame) -> DataFrame:
    """Split parts routed to spend / income / movement by the part's or the row's intent."""
    parts = split_rows(flowed)
    intent = F.coalesce("part_intent", "flow_intent")
    return parts.withColumns({"final_intent": intent, "bucket": bucket_of(intent)})


def cap_income(rows: DataFrame, cap: Column, destination: Column) -> DataFrame:
    """Split that counts only `cap` of a deposit as income and moves the rest.

    A cap at or above the amount clears the split; a cap of zero leaves one moved part.
    """
    counted = F.greatest(cap, F.lit(0))
    part = lambda amount, intent: F.struct(
        F.lit(None).cast("string").alias("category_id"), amount.cast("bigint").alias("amount_minor"),
        intent.cast("string").alias("flow_intent"),
    )
    moved = part(F.col("amount_minor") - counted, destination)
    kept = part(counted, F.lit(None))
    return rows.withColumn(
        "split",
        F.when(counted >= F.col("amount_minor"), F.array().cast("array<struct<category_id:string,amount_minor:bigint,flow_intent:string>>"))
        .when(counted == 0, F.array(moved))
        .otherwise(F.array(kept, moved)),
    )
