"""Cash flow, spending, flow intents and splits over the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import cashflow as cf
from tallyspark.operators import flow

from . import fixtures as fx
from .registry import query
from .sqlbase import clean, flow_pattern, in_list, over

TODAY = "2001-06-15"
EVENT_DAY = "2024-01-10"
MONTH = "1998-03"


def rows(spark, sf_dir):
    return fx.ledger(spark, sf_dir)


def overlaid(spark, sf_dir):
    return flow.resolved_overlay(rows(spark, sf_dir), fx.edits(spark, sf_dir))


def flowed(spark, sf_dir):
    """Rows with their intent; no category, so refund links need not be followed."""
    return flow.infer_flow(flow.overlay(rows(spark, sf_dir), fx.edits(spark, sf_dir)))


def parts(spark, sf_dir):
    return flow.routed_parts(flow.infer_flow(overlaid(spark, sf_dir)))


def summary(spark, sf_dir):
    """Split rows with their effective category; every direction."""
    return flow.split_rows(overlaid(spark, sf_dir))


def spend_parts(spark, sf_dir):
    return parts(spark, sf_dir).filter(F.col("bucket") == "spend")


_FLOWS = (
    "CAST(sum(CASE WHEN amount_minor > 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS inflow_minor,"
    " CAST(sum(CASE WHEN amount_minor < 0 THEN -amount_minor ELSE 0 END) AS BIGINT) AS outflow_minor,"
    " CAST(sum(amount_minor) AS BIGINT) AS net_minor"
)
_M = "strftime(posted_date, '%Y-%m')"


@query("agg_cash_flow", over("sp", f"SELECT ledger_id, {_FLOWS} FROM sp GROUP BY ledger_id"))
def agg_cash_flow(spark, sf_dir):
    return cf.cash_flow(summary(spark, sf_dir))


@query("agg_net_month", over("sp", f"SELECT ledger_id, {_M} AS month, {_FLOWS} FROM sp GROUP BY ALL"))
def agg_net_month(spark, sf_dir):
    return cf.net_by_month(summary(spark, sf_dir))


@query(
    "agg_spend_category",
    over("sp", "SELECT ledger_id, category_id, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor"
         " FROM sp WHERE amount_minor < 0 GROUP BY ALL"),
)
def agg_spend_category(spark, sf_dir):
    return cf.spending(summary(spark, sf_dir))


@query(
    "agg_spend_category_month",
    over("sp", f"SELECT ledger_id, {_M} AS month, category_id, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor"
         " FROM sp WHERE amount_minor < 0 GROUP BY ALL"),
)
def agg_spend_category_month(spark, sf_dir):
    return cf.spending(cf.with_month(summary(spark, sf_dir)), "month")


@query(
    "agg_months",
    over("t", "SELECT ledger_id, max(month) AS current_month, min(month) AS previous_month FROM ("
         f"SELECT DISTINCT ledger_id, {_M} AS month, dense_rank() OVER (PARTITION BY ledger_id ORDER BY {_M} DESC) AS r FROM t)"
         " WHERE r <= 2 GROUP BY ledger_id HAVING count(*) = 2"),
)
def agg_months(spark, sf_dir):
    return cf.latest_two_months(cf.months(rows(spark, sf_dir)))


@query(
    "agg_net_category",
    over("sp", "SELECT ledger_id, category_id, CAST(greatest(0, -sum(amount_minor)) AS BIGINT) AS spent_minor FROM sp GROUP BY ALL"),
)
def agg_net_category(spark, sf_dir):
    return cf.net_by_category(summary(spark, sf_dir))


@query(
    "agg_flow_projection",
    over("rt", f"SELECT ledger_id, {_M} AS month, bucket, count(*) AS rows, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM rt GROUP BY ALL"),
)
def agg_flow_projection(spark, sf_dir):
    return cf.flow_projection(parts(spark, sf_dir))


@query("agg_spendable_month", over("cash", "SELECT *, inflow_minor - outflow_minor AS net_minor FROM cash"))
def agg_spendable_month(spark, sf_dir):
    return cf.spendable_by_month(parts(spark, sf_dir))


@query(
    "agg_dashboard_totals",
    over("rt", "SELECT *, inflow_minor - outflow_minor AS net_minor FROM (SELECT ledger_id,"
         " CAST(coalesce(sum(amount_minor) FILTER (bucket = 'income' AND amount_minor > 0), 0) AS BIGINT) AS inflow_minor,"
         " CAST(greatest(0, coalesce(-sum(amount_minor) FILTER (bucket = 'spend'), 0)) AS BIGINT) AS outflow_minor FROM rt GROUP BY ledger_id)"),
)
def agg_dashboard_totals(spark, sf_dir):
    return cf.dashboard_totals(parts(spark, sf_dir))


@query(
    "agg_income_rows",
    over("fl",
         "SELECT ledger_id, source_hash, txn_index, CAST(posted_date AS VARCHAR) AS posted_date,"
         " CASE WHEN trim(custom_name) <> '' THEN custom_name ELSE cleaned END AS description, amount_minor,"
         # a split keeps its halves and remainder as income, its quarter is moved away
         " CASE WHEN has_split THEN amount_minor - amount_minor // 4 ELSE amount_minor END AS income_minor, intent AS flow_intent"
         f" FROM fl WHERE intent IN {in_list(schemas.INCOME_INTENTS)} AND amount_minor > 0"),
)
def agg_income_rows(spark, sf_dir):
    return cf.income_rows(flowed(spark, sf_dir))


_DAY = "CASE WHEN month = '2001-06' THEN 15 WHEN month < '2001-06' THEN last_day ELSE 0 END"


@query(
    "agg_month_budget",
    over("cash",
         "SELECT ledger_id, month, inflow_minor AS income_minor, outflow_minor AS spent_minor, rem AS remaining_minor,"
         " CAST(CASE WHEN inflow_minor > 0 THEN floor((outflow_minor * 1000 // inflow_minor) / 10 + 0.5) ELSE 0 END AS BIGINT) AS pct_spent,"
         " CAST(CASE WHEN inflow_minor > 0 THEN floor(sign(rem) * (abs(rem) * 1000 // inflow_minor) / 10 + 0.5) ELSE 0 END AS BIGINT) AS pct_left,"
         " CAST(greatest(0, last_day - d) AS BIGINT) AS days_left, CAST(CASE WHEN d > 0 THEN outflow_minor // d ELSE 0 END AS BIGINT) AS daily_pace_minor,"
         " inflow_minor > 0 AND outflow_minor * last_day > inflow_minor * greatest(1, d) AS over_pace FROM ("
         f"SELECT *, {_DAY} AS d, inflow_minor - outflow_minor AS rem FROM (SELECT *, day(last_day(CAST(month || '-01' AS DATE))) AS last_day FROM cash))"),
)
def agg_month_budget(spark, sf_dir):
    return cf.month_budget(cf.spendable_by_month(parts(spark, sf_dir)), TODAY)


@query(
    "agg_today",
    over("ov", "SELECT ledger_id, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor, count(*) AS rows FROM ov"
         f" WHERE posted_date = DATE '{EVENT_DAY}' AND amount_minor < 0 AND NOT ignored GROUP BY ledger_id"),
)
def agg_today(spark, sf_dir):
    return cf.today_spend(overlaid(spark, sf_dir), EVENT_DAY)


@query(
    "agg_stacked_grid",
    over("cash", "SELECT g.ledger_id, g.month, g.category_id, CAST(coalesce(s.v, 0) AS BIGINT) AS spent_minor FROM"
         " (SELECT m.ledger_id, m.month, c.category_id FROM (SELECT DISTINCT ledger_id, month FROM cash) m JOIN"
         " (SELECT DISTINCT ledger_id, category_id FROM rt WHERE bucket = 'spend' AND amount_minor < 0) c USING (ledger_id)) g"
         f" LEFT JOIN (SELECT ledger_id, {_M} AS month, category_id, sum(-amount_minor) AS v FROM rt WHERE bucket = 'spend' AND amount_minor < 0 GROUP BY ALL) s"
         " ON s.ledger_id = g.ledger_id AND s.month = g.month AND s.category_id IS NOT DISTINCT FROM g.category_id"),
)
def agg_stacked_grid(spark, sf_dir):
    return cf.stacked_grid(parts(spark, sf_dir))


@query(
    "agg_fees",
    over("ov", "SELECT ledger_id, count(*) AS rows, CAST(sum(abs(amount_minor)) AS BIGINT) AS total_minor FROM ("
         "SELECT *, max(posted_date) OVER (PARTITION BY ledger_id) AS anchor FROM ov WHERE NOT ignored)"
         " WHERE transaction_type IN ('fee', 'interest') AND posted_date >= anchor - 365 GROUP BY ledger_id"),
)
def agg_fees(spark, sf_dir):
    kept = overlaid(spark, sf_dir).filter(~F.col("ignored"))
    return cf.fees(cf.since_anchor(kept, 365))


@query(
    "flt_since_anchor",
    over("t", "SELECT ledger_id, source_hash, txn_index, CAST(posted_date AS VARCHAR) AS posted_date, amount_minor FROM ("
         "SELECT *, max(posted_date) OVER (PARTITION BY ledger_id) AS anchor FROM t) WHERE posted_date >= anchor - 90"),
)
def flt_since_anchor(spark, sf_dir):
    return cf.since_anchor(rows(spark, sf_dir), 90).select(*schemas.ROW_KEY, "posted_date", "amount_minor")


@query(
    "jn_overlay",
    over("ov", "SELECT ledger_id, source_hash, txn_index, amount_minor, annotated, ignored, own_category AS category_id, custom_name, user_intent FROM ov"),
)
def jn_overlay(spark, sf_dir):
    return flow.overlay(rows(spark, sf_dir), fx.edits(spark, sf_dir)).select(
        *schemas.ROW_KEY, "amount_minor", "annotated", "ignored", "category_id", "custom_name", "user_intent"
    )


@query(
    "jn_refund_category",
    over("ov", "SELECT ledger_id, source_hash, txn_index, own_category, category_id AS effective_category FROM ov WHERE annotated"),
)
def jn_refund_category(spark, sf_dir):
    return flow.effective_categories(fx.edits(spark, sf_dir)).select(
        *schemas.ROW_KEY, F.col("category_id").alias("own_category"), "effective_category"
    )


@query(
    "win_splits",
    over("sp", "SELECT ledger_id, source_hash, txn_index, CAST(part AS BIGINT) AS part_no, amount_minor, category_id, part_intent, whole_minor FROM sp"),
)
def win_splits(spark, sf_dir):
    return summary(spark, sf_dir).select(
        *schemas.ROW_KEY, "part_no", "amount_minor", F.col("part_category").alias("category_id"),
        "part_intent", "whole_minor",
    )


@query(
    "win_cap_income",
    over("fl",
         "SELECT ledger_id, source_hash, txn_index, p AS part_no, CAST(CASE WHEN p = 0 AND cap > 0 THEN cap ELSE amount_minor - cap END AS BIGINT) AS amount_minor,"
         " CASE WHEN p = 0 AND cap > 0 THEN NULL ELSE 'investment_out' END AS flow_intent FROM ("
         "SELECT *, unnest(CASE WHEN cap >= amount_minor THEN CAST([] AS BIGINT[]) WHEN cap = 0 THEN CAST([0] AS BIGINT[]) ELSE CAST([0, 1] AS BIGINT[]) END) AS p FROM ("
         "SELECT *, (ledger_id % 4) * 70000 AS cap FROM fl WHERE intent = 'salary'))"),
)
def win_cap_income(spark, sf_dir):
    deposits = flowed(spark, sf_dir).filter(F.col("flow_intent") == "salary").drop("split")
    capped = flow.cap_income(deposits, F.col("ledger_id") % 4 * 70000, F.lit("investment_out"))
    return capped.select(*schemas.ROW_KEY, F.posexplode("split").alias("part_no", "p")).select(
        *schemas.ROW_KEY, "part_no", "p.amount_minor", "p.flow_intent"
    )


@query(
    "flow_pattern",
    over("t", "SELECT ledger_id, source_hash, txn_index, cleaned,"
         f" CASE WHEN cleaned <> '' THEN {flow_pattern('cleaned', 'amount_minor', 0)} END AS pattern_intent,"
         f" CASE WHEN cleaned <> '' THEN {flow_pattern('cleaned', 'amount_minor', 1)} END AS pattern_label"
         f" FROM (SELECT *, {clean('description')} AS cleaned FROM t)"),
)
def flow_pattern_rows(spark, sf_dir):
    return flow.flow_pattern(rows(spark, sf_dir)).select(
        *schemas.ROW_KEY, "cleaned", "pattern_intent", "pattern_label"
    )


@query("flow_infer", over("fl", "SELECT ledger_id, source_hash, txn_index, intent AS flow_intent FROM fl"))
def flow_infer(spark, sf_dir):
    return flowed(spark, sf_dir).select(*schemas.ROW_KEY, "flow_intent")


@query(
    "flow_sets",
    over("fl", f"SELECT intent AS flow_intent, CASE WHEN intent IN {in_list(schemas.SPEND_INTENTS + schemas.REFUND_INTENTS)} THEN 'spend'"
         f" WHEN intent IN {in_list(schemas.INCOME_INTENTS)} THEN 'income' ELSE 'movement' END AS bucket, count(*) AS rows FROM fl GROUP BY ALL"),
)
def flow_sets(spark, sf_dir):
    return (
        flowed(spark, sf_dir).groupBy("flow_intent").agg(F.count("*").alias("rows"))
        .withColumn("bucket", flow.bucket_of(F.col("flow_intent")))
    )
