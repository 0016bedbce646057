"""Card streams, first-in-first-out attributions, links and payment drill-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions.text import issuer_of_bank
from tallyspark.operators import cards, links

from . import fixtures as fx
from .registry import query
from .sqlbase import card_issuer, card_last4, issuer_of_bank as issuer_sql, over

_DAY = "CAST({0} AS VARCHAR) AS {0}"
_RANK = (
    "CASE WHEN transaction_type IN ('purchase', 'fee', 'interest') THEN 0"
    " WHEN transaction_type IN ('payment_to_card', 'refund') THEN 1 ELSE 2 END"
)
_ORDER = f"posted_date, {_RANK}, amount_minor, description, source_hash, txn_index"
_CARD = "ledger_id, bank_name, account_last_4"
_CARDS = "FROM t WHERE account_type IN ('credit_card', 'loan') AND account_last_4 IS NOT NULL"
# running charges D, payments P and lost excess U; intervals (lo, hi] of charges and payments
_STEPS = {
    "c0": f"SELECT *, CASE WHEN {_RANK} = 0 AND amount_minor < 0 THEN -amount_minor ELSE 0 END AS debit,"
    f" CASE WHEN {_RANK} = 1 AND amount_minor > 0 THEN amount_minor ELSE 0 END AS credit,"
    f" row_number() OVER (PARTITION BY {_CARD} ORDER BY {_ORDER}) AS pos {_CARDS}",
    "c1": f"SELECT *, sum(debit) OVER w AS d, sum(credit) OVER w AS p FROM c0 WINDOW w AS (PARTITION BY {_CARD} ORDER BY pos)",
    "c2": f"SELECT *, greatest(0, coalesce(max(CASE WHEN credit > 0 THEN p - d END) OVER (PARTITION BY {_CARD} ORDER BY pos), 0)) AS u,"
    f" greatest(0, coalesce(max(CASE WHEN credit > 0 THEN p - d END) OVER (PARTITION BY {_CARD} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS u0 FROM c1",
    "pay": "SELECT *, p - u AS hi, p - u - (credit - (u - u0)) AS lo FROM c2 WHERE credit > 0",
    "chg": "SELECT *, d AS hi, d - debit AS lo FROM c2 WHERE debit > 0",
    "att": "SELECT pay.ledger_id, pay.bank_name, pay.account_last_4, pay.source_hash AS payment_hash, pay.txn_index AS payment_index,"
    " chg.source_hash AS charge_hash, chg.txn_index AS charge_index, CAST(least(pay.hi, chg.hi) - greatest(pay.lo, chg.lo) AS BIGINT) AS covered_minor"
    f" FROM pay JOIN chg USING ({_CARD}) WHERE least(pay.hi, chg.hi) > greatest(pay.lo, chg.lo)",
}
_LINKS = {
    "bank": "SELECT ledger_id, source_hash AS bank_source_hash, txn_index AS bank_txn_index, posted_date AS matched_date, abs(amount_minor) AS matched_amount_minor,"
    f" {card_issuer('description')} AS issuer, {card_last4('description')} AS named FROM {{t}} WHERE account_type <> 'credit_card' AND transaction_type = 'payment_to_card'",
    "cc": f"SELECT *, source_hash AS cc_source_hash, txn_index AS cc_txn_index, {issuer_sql('bank_name')} AS issuer, last_day(posted_date) AS period_end"
    " FROM {t} WHERE account_type = 'credit_card' AND transaction_type = 'payment_to_card'",
    "cand": "SELECT ledger_id, bank_source_hash, bank_txn_index, matched_amount_minor, matched_date, named, count(*) AS candidates,"
    " min({'h': cc_source_hash, 'i': cc_txn_index}) AS cc FROM bank JOIN cc USING (ledger_id, issuer)"
    " WHERE abs(cc.amount_minor) = matched_amount_minor AND abs(matched_date - period_end) <= 30"
    " AND (named IS NULL OR named = account_last_4) GROUP BY ALL",
    "lnk": "SELECT ledger_id, bank_source_hash, bank_txn_index, cc.h AS cc_source_hash, cc.i AS cc_txn_index, 'auto' AS link_type,"
    " CAST(CASE WHEN named IS NULL THEN 0.85 ELSE 1 END AS DOUBLE) AS confidence_score, matched_amount_minor, matched_date FROM cand WHERE candidates = 1",
}


def link_steps(table: str) -> dict[str, str]:
    return {name: sql.replace('{t}', table) for name, sql in _LINKS.items()}


def ledger_links(spark, sf_dir):
    return links.reconcile(fx.ledger(spark, sf_dir), fx.headers(spark, sf_dir))


def _repeats(spark, sf_dir):
    rows = fx.staged(spark, sf_dir, "ledger_repeats", lambda: fx.ledger_with_repeats(spark, sf_dir))
    return rows, fx.statements(rows)


def _attributions(spark, sf_dir):
    return cards.fifo_attributions(cards.fifo_ledger(fx.ledger(spark, sf_dir)))


@query("win_card_stream", over("t", f"SELECT {_CARD}, source_hash, txn_index, pos - 1 AS position FROM c0", **_STEPS))
def win_card_stream(spark, sf_dir):
    return cards.card_stream(fx.ledger(spark, sf_dir)).select(
        *schemas.CARD_KEY, "source_hash", "txn_index", "position"
    )


@query("win_fifo", over("t", "SELECT * FROM att", **_STEPS))
def win_fifo(spark, sf_dir):
    return _attributions(spark, sf_dir)


@query(
    "win_fifo_payments",
    over("t", f"SELECT {_CARD}, source_hash, txn_index, {_DAY.format('posted_date')}, credit AS magnitude_minor,"
         " CAST(u - u0 AS BIGINT) AS uncovered_minor FROM pay", **_STEPS),
)
def win_fifo_payments(spark, sf_dir):
    return cards.payments(cards.fifo_ledger(fx.ledger(spark, sf_dir)))


@query(
    "win_attribution_at",
    over("t", "SELECT pay.ledger_id, pay.source_hash AS payment_hash, pay.txn_index AS payment_index, credit AS paid_minor,"
         " count(att.charge_hash) AS charges, CAST(coalesce(sum(covered_minor), 0) AS BIGINT) AS covered_minor, CAST(u - u0 AS BIGINT) AS uncovered_minor"
         " FROM pay LEFT JOIN att ON att.ledger_id = pay.ledger_id AND att.payment_hash = pay.source_hash AND att.payment_index = pay.txn_index"
         " GROUP BY pay.ledger_id, pay.source_hash, pay.txn_index, credit, u, u0", **_STEPS),
)
def win_attribution_at(spark, sf_dir):
    axis = cards.fifo_ledger(fx.ledger(spark, sf_dir))
    covered = cards.fifo_attributions(axis).groupBy("ledger_id", "payment_hash", "payment_index").agg(
        F.count("*").alias("charges"), F.sum("covered_minor").alias("covered_minor")
    )
    paid = cards.payments(axis).select(
        "ledger_id", F.col("source_hash").alias("payment_hash"), F.col("txn_index").alias("payment_index"),
        F.col("magnitude_minor").alias("paid_minor"), "uncovered_minor",
    )
    return paid.join(covered, ["ledger_id", "payment_hash", "payment_index"], "left").fillna(
        0, ["charges", "covered_minor"]
    )


@query("win_unpaid", over("t", f"SELECT {_CARD}, CAST(sum(debit) - (sum(credit) - max(u)) AS BIGINT) AS unpaid_minor FROM c2"
                          f" WHERE debit > 0 OR credit > 0 GROUP BY {_CARD}", **_STEPS))
def win_unpaid(spark, sf_dir):
    return cards.unpaid_balance(fx.ledger(spark, sf_dir))


@query("jn_reconcile", over("t_repeats", f"SELECT * REPLACE (CAST(matched_date AS VARCHAR) AS matched_date) FROM lnk", **link_steps("t_repeats")))
def jn_reconcile(spark, sf_dir):
    return links.reconcile(*_repeats(spark, sf_dir))


@query(
    "jn_ambiguous",
    over("t_repeats", "SELECT ledger_id, bank_source_hash, bank_txn_index, matched_amount_minor, CAST(matched_date AS VARCHAR) AS matched_date,"
         " candidates, cc.h AS first_cc_source_hash, cc.i AS first_cc_txn_index FROM cand WHERE candidates > 1", **link_steps("t_repeats")),
)
def jn_ambiguous(spark, sf_dir):
    return links.ambiguous(*_repeats(spark, sf_dir))


_BANK_ROWS = "t WHERE account_type <> 'credit_card' AND transaction_type = 'payment_to_card'"


@query(
    "jn_find_link",
    over("t", "SELECT b.ledger_id, b.source_hash AS bank_source_hash, b.txn_index AS bank_txn_index, CAST(b.posted_date AS VARCHAR) AS posted_date, b.amount_minor,"
         f" l.cc_source_hash, l.cc_txn_index, l.confidence_score FROM (SELECT * FROM {_BANK_ROWS}) b LEFT JOIN lnk l ON l.ledger_id = b.ledger_id"
         " AND l.bank_source_hash = b.source_hash AND l.bank_txn_index = b.txn_index", **link_steps("t")),
)
def jn_find_link(spark, sf_dir):
    return links.with_link(fx.ledger(spark, sf_dir), ledger_links(spark, sf_dir))


@query(
    "jn_unlinked",
    over("t", f"SELECT ledger_id, source_hash AS bank_source_hash, txn_index AS bank_txn_index, amount_minor FROM {_BANK_ROWS}"
         " AND (ledger_id, source_hash, txn_index) NOT IN (SELECT (ledger_id, bank_source_hash, bank_txn_index) FROM lnk)", **link_steps("t")),
)
def jn_unlinked(spark, sf_dir):
    return links.unlinked(fx.ledger(spark, sf_dir), ledger_links(spark, sf_dir)).select(
        *links.BANK_KEY, "amount_minor"
    )


@query("jn_issuer_alias", over("t", f"SELECT DISTINCT bank_name, {issuer_sql('bank_name')} AS issuer FROM t"))
def jn_issuer_alias(spark, sf_dir):
    return fx.headers(spark, sf_dir).select("bank_name").distinct().withColumn(
        "issuer", issuer_of_bank(F.col("bank_name"))
    )


_DRILL = {
    **link_steps("t"), **_STEPS,
    "drill": "SELECT l.*, att.charge_hash, att.charge_index, att.covered_minor, t.posted_date AS charge_date, t.description AS charge_description,"
    " t.amount_minor AS charge_minor FROM lnk l JOIN att ON att.ledger_id = l.ledger_id AND att.payment_hash = l.cc_source_hash AND att.payment_index = l.cc_txn_index"
    " JOIN t ON t.ledger_id = l.ledger_id AND t.source_hash = att.charge_hash AND t.txn_index = att.charge_index",
}
_DRILL_COLS = "ledger_id, bank_source_hash, bank_txn_index, cc_source_hash, cc_txn_index, charge_hash, charge_index, covered_minor, charge_description, charge_minor"


@query("jn_drill", over("t", f"SELECT {_DRILL_COLS}, CAST(charge_date AS VARCHAR) AS charge_date FROM drill", **_DRILL))
def jn_drill(spark, sf_dir):
    drill = links.payment_drill(
        ledger_links(spark, sf_dir), _attributions(spark, sf_dir), fx.ledger(spark, sf_dir)
    )
    return drill.select(*[c.strip() for c in _DRILL_COLS.split(",")], "charge_date")


@query(
    "jn_drill_sections",
    over("st2", "SELECT d.ledger_id, bank_source_hash, bank_txn_index, charge_hash, count(*) AS items, CAST(sum(covered_minor) AS BIGINT) AS section_total_minor,"
         " any_value(st2.bank_name) AS bank_name, CAST(any_value(period_start) AS VARCHAR) AS period_start, CAST(any_value(period_end) AS VARCHAR) AS period_end"
         " FROM drill d JOIN st2 ON st2.ledger_id = d.ledger_id AND st2.source_hash = d.charge_hash GROUP BY d.ledger_id, bank_source_hash, bank_txn_index, charge_hash", **_DRILL),
)
def jn_drill_sections(spark, sf_dir):
    # every attribution's charge is a row of the same ledger, so the rows themselves are not read
    drill = links.paid_parts(ledger_links(spark, sf_dir), _attributions(spark, sf_dir))
    return links.drill_sections(drill, fx.headers(spark, sf_dir))


@query(
    "dq_link_contract",
    over("t", "SELECT ledger_id, bank_source_hash, bank_txn_index, cc_source_hash, CAST(CASE f WHEN 1 THEN -1 ELSE cc_txn_index END AS BIGINT) AS cc_txn_index,"
         " CASE f WHEN 1 THEN 'card row is missing' ELSE 'bank row is linked more than once' END AS reason FROM ("
         " SELECT *, unnest(CASE WHEN matched_amount_minor % 11 = 0 THEN [1] WHEN matched_amount_minor % 11 = 1 THEN [2, 2] ELSE CAST([] AS INTEGER[]) END) AS f FROM lnk)",
         **link_steps("t")),
)
def dq_link_contract(spark, sf_dir):
    """Links with planted faults: a missing card row, and a link stored twice."""
    good = ledger_links(spark, sf_dir)
    fault = F.col("matched_amount_minor") % 11
    planted = good.withColumn("cc_txn_index", F.when(fault == 0, F.lit(-1)).otherwise(F.col("cc_txn_index")))
    planted = planted.unionByName(good.filter(fault == 1))
    return links.broken_links(planted, fx.ledger(spark, sf_dir))


@query(
    "agg_counts",
    over("st2", "SELECT ledger_id, count(*) FILTER (card) AS card_statements, count(*) FILTER (NOT card) AS bank_statements,"
         " (SELECT count(*) FROM lnk WHERE lnk.ledger_id = st2.ledger_id) AS links FROM st2 GROUP BY ledger_id", **link_steps("t")),
)
def agg_counts(spark, sf_dir):
    return links.link_counts(ledger_links(spark, sf_dir), fx.headers(spark, sf_dir))
