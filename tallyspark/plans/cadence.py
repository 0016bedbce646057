"""Recurring streams, paychecks, budget windows, merchants, budgets and goals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import budgets, cadence, cashflow, merchants
from tallyspark.session import durable

from . import fixtures as fx
from . import reports
from .registry import query
from .sqlbase import clean, in_list, normalize, over

TODAY = "1998-01-20"
_M = "strftime(posted_date, '%Y-%m')"


def categories(spark):
    return spark.createDataFrame(fx.CATEGORIES, "category_id string, name string, parent_id string")


def _kept(spark, sf_dir):
    return reports.overlaid(spark, sf_dir).filter(~F.col("ignored"))


# ---- recurring -------------------------------------------------------------------------

_REC = {
    "r0": f"SELECT ledger_id, posted_date, amount_minor, description, {normalize('cleaned')} AS stream_key FROM"
    f" (SELECT *, {clean('description')} AS cleaned FROM t WHERE amount_minor <> 0)",
    "r1": "SELECT *, posted_date - lag(posted_date) OVER (PARTITION BY ledger_id, stream_key ORDER BY posted_date, description, amount_minor) AS gap"
    " FROM r0 WHERE stream_key <> ''",
    "r2": "SELECT ledger_id, stream_key, count(*) AS occurrences, count(*) FILTER (amount_minor > 0) AS positives, max(posted_date) AS last_date,"
    " max({'d': posted_date, 'x': description, 'a': amount_minor}).x AS display_name, CAST(floor(median(abs(amount_minor))) AS BIGINT) AS typ,"
    " min(abs(amount_minor)) AS lo, max(abs(amount_minor)) AS hi, median(gap) AS med, min(gap) AS gmin, max(gap) AS gmax"
    " FROM r1 GROUP BY ALL HAVING count(*) >= 4 AND median(gap) > 0",
    "r3": "SELECT *, hi <= typ * 135 // 100 AND lo >= typ * 65 // 100 AS stable, greatest(gmax - med, med - gmin) <= greatest(4, med * 0.25) AS regular FROM r2",
    "r4": "SELECT *, CASE WHEN NOT stable THEN 'irregular' WHEN med BETWEEN 6 AND 8 THEN 'weekly' WHEN med BETWEEN 12 AND 16 THEN 'biweekly'"
    " WHEN med BETWEEN 26 AND 33 THEN 'monthly' ELSE 'irregular' END AS cadence FROM r3",
    "rec": "SELECT ledger_id, stream_key, display_name, CASE WHEN positives * 2 > occurrences THEN 'inflow' ELSE 'outflow' END AS direction, cadence, occurrences,"
    " last_date, CASE WHEN cadence <> 'irregular' THEN last_date + CAST(floor(med + 0.5) AS INTEGER) END AS next_due, typ AS typical_amount_minor,"
    " CASE WHEN cadence <> 'irregular' AND regular THEN 'high' ELSE 'low' END AS confidence FROM r4",
}
_REC_TEXT = "* REPLACE (CAST(last_date AS VARCHAR) AS last_date, CAST(next_due AS VARCHAR) AS next_due)"


def _streams(spark, sf_dir):
    return cadence.recurring(fx.ledger(spark, sf_dir))


@query("win_recurring", over("t", f"SELECT {_REC_TEXT} FROM rec", **_REC))
def win_recurring(spark, sf_dir):
    return _streams(spark, sf_dir)


@query(
    "top_upcoming",
    over("t", "SELECT ledger_id, stream_key, CAST(next_due AS VARCHAR) AS next_due, rank FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id"
         " ORDER BY next_due, stream_key) AS rank FROM rec WHERE next_due IS NOT NULL) WHERE rank <= 6", **_REC),
)
def top_upcoming(spark, sf_dir):
    return cadence.upcoming(_streams(spark, sf_dir)).select("ledger_id", "stream_key", "next_due", "rank")


@query(
    "agg_bills_year",
    over("t", "SELECT ledger_id, count(*) AS bills, CAST(sum(typical_amount_minor * CASE cadence WHEN 'weekly' THEN 52 WHEN 'biweekly' THEN 26 ELSE 12 END) AS BIGINT)"
         " AS yearly_minor FROM rec WHERE direction = 'outflow' GROUP BY ledger_id", **_REC),
)
def agg_bills_year(spark, sf_dir):
    return cadence.bills_per_year(_streams(spark, sf_dir))


@query(
    "prj_overdue_label",
    over("t", "SELECT ledger_id, stream_key, CAST(next_due AS VARCHAR) AS next_due, CASE WHEN next_due IS NULL THEN 'irregular' WHEN d < 0 THEN 'overdue'"
         " WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' ELSE 'in ' || d || ' days' END AS due_label"
         f" FROM (SELECT *, next_due - DATE '{TODAY}' AS d FROM rec)", **_REC),
)
def prj_overdue_label(spark, sf_dir):
    return cadence.overdue_label(_streams(spark, sf_dir), TODAY).select(
        "ledger_id", "stream_key", "next_due", "due_label"
    )


# ---- paychecks and budget windows ------------------------------------------------------

_PAY = {
    "dep": f"SELECT *, {normalize('description')} AS stream_key FROM t WHERE account_type IN ('checking', 'savings') AND transaction_type = 'deposit' AND amount_minor > 0",
    "dg": "SELECT *, posted_date - lag(posted_date) OVER (PARTITION BY ledger_id, stream_key ORDER BY posted_date) AS gap FROM dep",
    "ps": "SELECT ledger_id, stream_key, count(*) AS occurrences, median(gap) AS median_gap, CASE WHEN count(*) >= 3 AND min(gap) >= 12 AND max(gap) <= 17"
    " AND median(gap) BETWEEN 12 AND 16 THEN 'high' WHEN median(gap) BETWEEN 12 AND 16 THEN 'medium' ELSE 'low' END AS confidence"
    " FROM dg GROUP BY ALL HAVING median(gap) BETWEEN 12 AND 17",
    "pc": "SELECT dep.*, confidence FROM dep LEFT JOIN ps USING (ledger_id, stream_key)",
    "cad": "SELECT ledger_id, CAST(median(median_gap) AS DOUBLE) AS cadence_days, count(*) AS streams FROM ps GROUP BY ledger_id",
    "anc": "SELECT ledger_id, date_trunc('month', min(posted_date)) AS m FROM pc WHERE confidence IS NOT NULL GROUP BY ledger_id",
    "w0": "SELECT *, (row_number() OVER (PARTITION BY ledger_id ORDER BY posted_date, source_hash, txn_index) - 1) // 2 AS window_no FROM pc WHERE confidence IS NOT NULL",
    "w1": "SELECT ledger_id, window_no, min(posted_date) AS start_date, count(*) AS paychecks, CAST(sum(amount_minor) AS BIGINT) AS income_minor FROM w0 GROUP BY ALL",
    "w2": "SELECT *, lead(start_date) OVER (PARTITION BY ledger_id ORDER BY window_no) AS nxt FROM w1",
    "win": "SELECT ledger_id, window_no, strftime(anc.m + to_months(CAST(window_no AS INTEGER)), '%Y-%m') AS budget_month, start_date, CASE WHEN nxt IS NOT NULL THEN greatest(nxt - 1, start_date) END AS end_date,"
    " paychecks, income_minor, paychecks = 2 AS complete FROM w2 JOIN anc USING (ledger_id)",
}
_WIN_TEXT = "* REPLACE (CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date)"


def _paychecks(spark, sf_dir):
    return cadence.label_deposits(fx.ledger(spark, sf_dir)).filter("is_paycheck")


def _windows(spark, sf_dir):
    paychecks = durable(_paychecks(spark, sf_dir).select(*schemas.ROW_KEY, "posted_date", "amount_minor"))  # read for both
    return durable(cadence.budget_windows(paychecks, cadence.default_anchor(paychecks)))


@query(
    "win_paychecks",
    over("t", "SELECT ledger_id, source_hash, txn_index, CAST(posted_date AS VARCHAR) AS posted_date, amount_minor, description, stream_key, confidence,"
         " confidence IS NOT NULL AS is_paycheck FROM pc", **_PAY),
)
def win_paychecks(spark, sf_dir):
    return cadence.label_deposits(fx.ledger(spark, sf_dir))


@query("win_biweekly_flag", over("t", "SELECT *, cadence_days BETWEEN 13 AND 16 AS biweekly FROM cad", **_PAY))
def win_biweekly_flag(spark, sf_dir):
    return cadence.biweekly_flag(cadence.detected_cadence(cadence.paycheck_streams(fx.ledger(spark, sf_dir))))


@query("win_default_anchor", over("t", "SELECT ledger_id, strftime(m + INTERVAL 2 MONTH, '%Y-%m') AS anchor_month FROM anc", **_PAY))
def win_default_anchor(spark, sf_dir):
    return cadence.default_anchor(_paychecks(spark, sf_dir), shift=2)


@query("win_budget_windows", over("t", f"SELECT {_WIN_TEXT} FROM win", **_PAY))
def win_budget_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


_SPENT = {
    "bank": f"SELECT * FROM fl WHERE account_type IN ('checking', 'savings') AND intent IN {in_list(schemas.SPEND_INTENTS + schemas.REFUND_INTENTS)}",
}


def _bank_spend(spark, sf_dir):
    flowed = reports.flowed(spark, sf_dir)
    return flowed.filter(
        F.col("account_type").isin("checking", "savings")
        & F.col("flow_intent").isin(schemas.SPEND_INTENTS + schemas.REFUND_INTENTS)
    )


@query(
    "agg_window_summary",
    over("fl", f"SELECT {_WIN_TEXT}, income_minor - spending_minor AS remaining_minor FROM (SELECT win.*, CAST(coalesce((SELECT sum(-amount_minor) FROM bank"
         " WHERE bank.ledger_id = win.ledger_id AND amount_minor < 0 AND posted_date >= start_date AND (end_date IS NULL OR posted_date <= end_date)), 0) AS BIGINT) AS spending_minor FROM win)",
         **_PAY, **_SPENT),
)
def agg_window_summary(spark, sf_dir):
    return cadence.window_summary(_windows(spark, sf_dir), _bank_spend(spark, sf_dir))


@query(
    "jn_window_range",
    over("fl", "SELECT win.ledger_id, window_no, source_hash, txn_index FROM win JOIN bank ON bank.ledger_id = win.ledger_id AND posted_date >= start_date"
         " AND (end_date IS NULL OR posted_date <= end_date)", **_PAY, **_SPENT),
)
def jn_window_range(spark, sf_dir):
    spend = durable(_bank_spend(spark, sf_dir).select(*schemas.ROW_KEY, "posted_date"))  # read for days and for rows
    return cadence.rows_in_windows(_windows(spark, sf_dir), spend).select(
        "ledger_id", "window_no", "source_hash", "txn_index"
    )


# ---- merchants -------------------------------------------------------------------------

_MERCH = {
    "m0": f"SELECT *, -amount_minor AS v, {normalize('description')} AS merchant_key FROM ov WHERE NOT ignored AND amount_minor < 0",
    "m1": "SELECT *, row_number() OVER (PARTITION BY ledger_id, merchant_key ORDER BY posted_date DESC, amount_minor DESC, description DESC) AS rn FROM m0 WHERE merchant_key <> ''",
    "m2": "SELECT ledger_id, merchant_key, max(CASE WHEN rn = 1 THEN description END) AS display_name, count(*) AS occurrences, CAST(sum(v) AS BIGINT) AS total_spent_minor,"
    " CAST((sum(v) + count(*) // 2) // count(*) AS BIGINT) AS average_amount_minor, CAST(min(posted_date) AS VARCHAR) AS first_date, CAST(max(posted_date) AS VARCHAR) AS last_date,"
    " arg_max(v, rn) AS first_amount_minor, max(CASE WHEN rn = 1 THEN v END) AS last_amount_minor, max(CASE WHEN rn = 2 THEN v END) AS previous_amount_minor"
    " FROM m1 GROUP BY ALL HAVING count(*) >= 2",
    "mt": "SELECT *, last_amount_minor - previous_amount_minor AS jump_minor, CASE WHEN previous_amount_minor <> 0 THEN"
    " (last_amount_minor - previous_amount_minor) / previous_amount_minor * 100 END AS jump_pct FROM m2",
}


def _trends(spark, sf_dir):
    return merchants.merchant_trends(_kept(spark, sf_dir))


@query("agg_merchant_trends", over("ov", "SELECT * FROM mt", **_MERCH))
def agg_merchant_trends(spark, sf_dir):
    return _trends(spark, sf_dir)


@query("agg_price_jumps", over("ov", "SELECT * FROM mt WHERE jump_minor <> 0", **_MERCH))
def agg_price_jumps(spark, sf_dir):
    return merchants.price_jumps(_trends(spark, sf_dir))


@query(
    "agg_frequent",
    over("ov", "SELECT ledger_id, merchant_key, occurrences, total_spent_minor, rank FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY occurrences DESC,"
         " total_spent_minor DESC, merchant_key) AS rank FROM mt) WHERE rank <= 12", **_MERCH),
)
def agg_frequent(spark, sf_dir):
    return merchants.frequent(_trends(spark, sf_dir), limit=12).select(
        "ledger_id", "merchant_key", "occurrences", "total_spent_minor", "rank"
    )


@query(
    "top_largest",
    over("ov", "SELECT ledger_id, rank, CAST(posted_date AS VARCHAR) AS posted_date, description, v AS spent_minor FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id"
         " ORDER BY v DESC, posted_date DESC, description, source_hash, txn_index) AS rank FROM m0) WHERE rank <= 10", **_MERCH),
)
def top_largest(spark, sf_dir):
    return merchants.largest(_kept(spark, sf_dir))


# ---- budgets ---------------------------------------------------------------------------

_LIMITS = (
    "SELECT c_custkey AS ledger_id, unnest(['c-ring', 'c-bolt', 'c-food', 'c-gear']) AS category_id,"
    " unnest([(c_custkey % 10 + 1) * 1500000, (c_custkey % 10 + 1) * 1500000, (c_custkey % 10 + 1) * 1500000, 0]) AS limit_minor FROM customer"
)
_BUD = {
    "lim": _LIMITS,
    "last": "SELECT * FROM (SELECT *, max(month) OVER (PARTITION BY ledger_id) AS mm FROM (SELECT *, "
    f"{_M} AS month FROM sp)) WHERE month = mm",
    "net": "SELECT ledger_id, category_id, CAST(greatest(0, -sum(amount_minor)) AS BIGINT) AS spent FROM last GROUP BY ALL",
    "bud": "SELECT lim.ledger_id, lim.category_id, limit_minor, coalesce(spent, 0) AS spent_minor, limit_minor - coalesce(spent, 0) AS remaining_minor,"
    " coalesce(spent, 0) / limit_minor * 100 AS pct, coalesce(spent, 0) > limit_minor AS over FROM lim LEFT JOIN net USING (ledger_id, category_id) WHERE limit_minor > 0",
    "sbm": f"SELECT ledger_id, {_M} AS month, category_id, CAST(sum(-amount_minor) AS BIGINT) AS spent FROM rt WHERE bucket = 'spend' AND amount_minor < 0 GROUP BY ALL",
    "two": "SELECT ledger_id, max(month) AS current_month, min(month) AS previous_month FROM (SELECT DISTINCT ledger_id, month, dense_rank() OVER"
    " (PARTITION BY ledger_id ORDER BY month DESC) AS r FROM sbm) WHERE r <= 2 GROUP BY ledger_id HAVING count(*) = 2",
    "cur": "SELECT sbm.ledger_id, category_id, spent FROM sbm JOIN two ON two.ledger_id = sbm.ledger_id AND month = current_month",
    "prv": "SELECT sbm.ledger_id, category_id, spent FROM sbm JOIN two ON two.ledger_id = sbm.ledger_id AND month = previous_month",
    "dl": "SELECT coalesce(cur.ledger_id, prv.ledger_id) AS ledger_id, CASE WHEN cur.ledger_id IS NULL THEN prv.category_id ELSE cur.category_id END AS category_id,"
    " coalesce(cur.spent, 0) AS current_minor, coalesce(prv.spent, 0) AS previous_minor FROM cur FULL JOIN prv ON cur.ledger_id = prv.ledger_id"
    " AND cur.category_id IS NOT DISTINCT FROM prv.category_id",
    "mom": "SELECT ledger_id, current_month, previous_month, category_id, current_minor, previous_minor, current_minor - previous_minor AS delta_minor,"
    " CASE WHEN previous_minor <> 0 THEN (current_minor - previous_minor) / previous_minor * 100 END AS pct_change FROM dl JOIN two USING (ledger_id)",
}


def _budgets(spark, sf_dir):
    latest = budgets.latest_month_rows(reports.summary(spark, sf_dir))
    return budgets.category_budgets(latest, fx.limits(spark, sf_dir))


def _spent_by_month(spark, sf_dir):
    return cashflow.spending(cashflow.with_month(reports.spend_parts(spark, sf_dir)), "month")


def _deltas(spark, sf_dir):
    return budgets.compare_months(_spent_by_month(spark, sf_dir))


@query("agg_budget", over("sp", "SELECT * FROM bud", **{k: _BUD[k] for k in ("lim", "last", "net", "bud")}))
def agg_budget(spark, sf_dir):
    return _budgets(spark, sf_dir)


@query(
    "agg_budget_totals",
    over("sp", "SELECT ledger_id, CAST(sum(limit_minor) AS BIGINT) AS limit_minor, CAST(sum(spent_minor) AS BIGINT) AS spent_minor,"
         " CAST(sum(remaining_minor) AS BIGINT) AS remaining_minor FROM bud GROUP BY ledger_id", **{k: _BUD[k] for k in ("lim", "last", "net", "bud")}),
)
def agg_budget_totals(spark, sf_dir):
    return budgets.budget_totals(_budgets(spark, sf_dir))


_MOM = {k: _BUD[k] for k in ("sbm", "two", "cur", "prv", "dl", "mom")}


@query("agg_mom", over("rt", "SELECT * FROM mom", **_MOM))
def agg_mom(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query("jn_mom_full", over("rt", "SELECT * FROM dl", **_MOM))
def jn_mom_full(spark, sf_dir):
    spent = _spent_by_month(spark, sf_dir)
    two = cashflow.latest_two_months(spent)
    side = lambda m: spent.join(two, "ledger_id").filter(F.col("month") == F.col(m))
    return budgets.join_months(side("current_month"), side("previous_month"))


@query(
    "top_movers",
    over("rt", "SELECT ledger_id, category_id, direction, delta_minor, rank FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, direction"
         " ORDER BY abs(delta_minor) DESC, category_id NULLS LAST) AS rank FROM (SELECT *, CASE WHEN delta_minor > 0 THEN 'increased' ELSE 'decreased' END AS direction"
         " FROM mom WHERE delta_minor <> 0)) WHERE rank <= 3", **_MOM),
)
def top_movers(spark, sf_dir):
    return budgets.top_movers(_deltas(spark, sf_dir), 3).select(
        "ledger_id", "category_id", "direction", "delta_minor", "rank"
    )


@query(
    "top_categories",
    over("rt", "SELECT ledger_id, month, category_id, spent AS spent_minor, rank FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, month"
         " ORDER BY spent DESC, category_id NULLS LAST) AS rank FROM sbm) WHERE rank <= 3", sbm=_BUD["sbm"]),
)
def top_categories(spark, sf_dir):
    return budgets.top_categories(_spent_by_month(spark, sf_dir), ["month"], 3)


_PARENTS = "(VALUES " + ", ".join(f"('{c}', {'NULL' if p is None else repr(p)})" for c, _, p in fx.CATEGORIES) + ") k(category_id, parent_id)"


@query(
    "agg_parent_rollup",
    over("rt", "SELECT ledger_id, 'category' AS level, category_id, CAST(sum(spent) AS BIGINT) AS spent_minor FROM sbm GROUP BY ALL UNION ALL"
         " SELECT ledger_id, 'parent' AS level, coalesce(k.parent_id, sbm.category_id) AS category_id, CAST(sum(spent) AS BIGINT) AS spent_minor FROM sbm"
         f" LEFT JOIN {_PARENTS} ON k.category_id = sbm.category_id GROUP BY ALL", sbm=_BUD["sbm"]),
)
def agg_parent_rollup(spark, sf_dir):
    spent = cashflow.spending(reports.spend_parts(spark, sf_dir))
    return budgets.parent_rollup(spent, categories(spark))


# ---- goals -----------------------------------------------------------------------------

_GOALS = (
    "SELECT c_custkey AS ledger_id, 'g' || c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN '  ' ELSE c_name END AS name, (c_custkey % 11) * 50000 AS target_minor,"
    " CAST(round(c_acctbal * 100) AS BIGINT) AS saved_minor, CASE WHEN c_custkey % 4 = 0 THEN '2026-12-31' WHEN c_custkey % 29 = 0 THEN 'soon' END AS deadline FROM customer"
)


@query(
    "agg_goal",
    "SELECT ledger_id, id, least(100.0, raw_pct) AS pct, raw_pct, CASE WHEN target_minor > 0 THEN greatest(0, target_minor - s) ELSE 0 END AS remaining_minor,"
    " target_minor > 0 AND s >= target_minor AS complete FROM (SELECT *, CASE WHEN target_minor > 0 THEN s / target_minor * 100 ELSE CAST(0 AS DOUBLE) END AS raw_pct"
    f" FROM (SELECT *, greatest(0, saved_minor) AS s FROM ({_GOALS})))",
)
def agg_goal(spark, sf_dir):
    return budgets.goal_progress(fx.goals(spark, sf_dir))


@query(
    "agg_goal_totals",
    f"SELECT ledger_id, CAST(sum(target_minor) AS BIGINT) AS target_minor, CAST(sum(greatest(0, saved_minor)) AS BIGINT) AS saved_minor,"
    f" CAST(greatest(0, sum(target_minor) - sum(greatest(0, saved_minor))) AS BIGINT) AS remaining_minor FROM ({_GOALS}) GROUP BY ledger_id",
)
def agg_goal_totals(spark, sf_dir):
    return budgets.goal_totals(fx.goals(spark, sf_dir))
