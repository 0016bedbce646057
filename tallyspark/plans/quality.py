"""Checksum gate, contracts, ingest and merge over the derived ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions import fixed
from tallyspark.operators import ingest, merge, quality

from . import cards, cadence
from . import fixtures as fx
from .registry import query
from .sqlbase import card_issuer, lit, over


def _fmt(x: str) -> str:
    return (
        f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', abs({x}) // 100) || '.' ||"
        f" lpad(CAST(abs({x}) % 100 AS VARCHAR), 2, '0'))"
    )


def _eq(level: str, expected: str, actual: str) -> str:
    return (
        f"CASE WHEN {expected} = {actual} THEN '{level} holds at ' || {_fmt(actual)} ELSE '{level} fails: printed ' || {_fmt(actual)}"
        f" || ', rows give ' || {_fmt(expected)} || ', apart ' || {_fmt(f'abs({expected} - {actual})')} END"
    )


_EXP_A, _EXP_C = "(opening_balance_minor + total)", "(previous_balance_minor + debits - credits)"
# the fixture never breaks level B, so its oracle only has the passing and the missing message
_LEVELS = {
    "A": (_EXP_A, "closing_balance_minor", f"coalesce({_eq('A', _EXP_A, 'closing_balance_minor')}, 'A lacks opening or closing')"),
    "B": ("(total_debits_minor + total_credits_minor)", "(debits + credits)",
          f"'B holds at debits ' || {_fmt('total_debits_minor')} || ', credits ' || {_fmt('total_credits_minor')}"),
    "C": (_EXP_C, "statement_balance_minor", f"coalesce({_eq('C', _EXP_C, 'statement_balance_minor')}, 'C lacks previous or new balance')"),
    "D": ("printed_transaction_count", "n",
          "CASE WHEN printed_transaction_count = n THEN 'D holds at ' || n ELSE 'D fails: printed '"
          " || printed_transaction_count || ', rows ' || n END"),
}
_MISSING = {"A": "opening_balance_minor IS NULL", "B": "FALSE", "C": "previous_balance_minor IS NULL", "D": "FALSE"}


def _level_sql(level: str) -> str:
    expected, actual, message = _LEVELS[level]
    gone = _MISSING[level]
    return (
        f"SELECT ledger_id, source_hash, CAST(instr(replace(provides, '+', ''), '{level}') - 1 AS BIGINT) AS level_no, '{level}' AS level,"
        f" NOT {gone} AND coalesce({expected} = {actual}, false) AS passed, CASE WHEN NOT ({gone}) THEN {expected} END AS expected_minor,"
        f" CASE WHEN NOT ({gone}) THEN {actual} END AS actual_minor, CASE WHEN NOT ({gone}) THEN {expected} - {actual} END AS diff_minor,"
        f" {message} AS message FROM st2 WHERE contains(provides, '{level}')"
    )


LEVEL_ROWS = " UNION ALL ".join(_level_sql(level) for level in "ABCD")


def _level_query(level: str):
    def build(spark, sf_dir):
        results = quality.level_results(fx.headers(spark, sf_dir), fx.ledger(spark, sf_dir))
        return results.filter(F.col("level") == level)

    return build


for _level in "ABCD":
    query(f"dq_checksum_{_level.lower()}", over("st2", _level_sql(_level)))(_level_query(_level))


def _gate(spark, sf_dir):
    return quality.checksum_gate(fx.headers(spark, sf_dir), fx.ledger(spark, sf_dir))


@query(
    "dq_gate",
    over("st2", "SELECT st2.ledger_id, st2.source_hash, reason IS NULL AS ok, CASE WHEN reason IS NULL THEN provides END AS strategy_used, reason FROM ("
         "SELECT ledger_id, source_hash, provides, CASE provides WHEN '' THEN 'refused, no level declared'"
         " WHEN 'D' THEN 'refused, a count alone proves no sum' ELSE (SELECT 'refused, ' ||"
         " string_agg(message, '; ' ORDER BY level_no) FROM lv WHERE NOT passed AND lv.ledger_id = st2.ledger_id AND lv.source_hash = st2.source_hash) END AS reason FROM st2) st2",
         lv=LEVEL_ROWS),
)
def dq_gate(spark, sf_dir):
    return _gate(spark, sf_dir).select("ledger_id", "source_hash", "ok", "strategy_used", "reason")


# ---- contracts -------------------------------------------------------------------------

_FAULTS = {
    1: ("posted_date", "'1998-02-30'", "posted_date: not an ISO date"),
    2: ("currency", "'usd'", "currency: not three capitals"),
    3: ("transaction_type", "'gift'", "transaction_type: unknown"),
    4: ("status", "'lost'", "status: unknown"),
    5: ("description", "CAST(NULL AS STRING)", "description: missing"),
}


@query(
    "dq_contract",
    over("t", "SELECT ledger_id, source_hash, txn_index, CASE abs(amount_minor) % 101 "
         + " ".join(f"WHEN {k} THEN {lit(m)}" for k, (_, _, m) in _FAULTS.items())
         + " END AS issue FROM t WHERE abs(amount_minor) % 101 BETWEEN 1 AND 5"),
)
def dq_contract(spark, sf_dir):
    """Row contract over rows with planted faults."""
    rows = fx.ledger(spark, sf_dir).withColumn("posted_date", F.col("posted_date").cast("string"))
    fault = F.abs("amount_minor") % 101
    for number, (column, value, _) in _FAULTS.items():
        rows = rows.withColumn(column, F.when(fault == number, F.expr(value)).otherwise(F.col(column)))
    return quality.broken(rows, quality.row_contract(), schemas.ROW_KEY)


@query(
    "dq_header_contract",
    over("st2", "SELECT ledger_id, source_hash, unnest(string_split(faults, '|')) AS issue FROM (SELECT *, concat_ws('|', CASE WHEN ledger_id % 19 = 2 THEN"
         " 'account_last_4: not three to five digits' END, CASE WHEN provides = '' THEN 'parser_provides: empty or unknown' END) AS faults FROM st2) WHERE faults <> ''"),
)
def dq_header_contract(spark, sf_dir):
    headers = fx.headers(spark, sf_dir).withColumn(
        "account_last_4", F.when(F.col("ledger_id") % 19 == 2, F.lit("12")).otherwise(F.col("account_last_4"))
    )
    return quality.broken(headers, quality.header_contract(), quality.STATEMENT_KEY)


@query(
    "dq_goal_limits",
    "SELECT ledger_id, id, unnest(string_split(faults, '|')) AS issue FROM (SELECT *, concat_ws('|', CASE WHEN trim(name) = '' THEN 'name: empty' END,"
    " CASE WHEN target_minor <= 0 THEN 'target: not positive' END, CASE WHEN saved_minor < 0 THEN 'saved: negative' END, CASE WHEN deadline = 'soon' THEN 'deadline: not ISO YYYY-MM-DD' END) AS faults"
    f" FROM ({cadence._GOALS})) WHERE faults <> '' UNION ALL SELECT ledger_id, category_id AS id, 'limit: not positive' AS issue FROM ({cadence._LIMITS}) WHERE limit_minor <= 0",
)
def dq_goal_limits(spark, sf_dir):
    goals = quality.broken(fx.goals(spark, sf_dir), quality.goal_contract(), ["ledger_id", "id"])
    limits = fx.limits(spark, sf_dir).withColumnRenamed("category_id", "id")
    positive = quality.issues([("limit: not positive", F.col("limit_minor") > 0)])
    return goals.unionByName(quality.broken(limits, positive, ["ledger_id", "id"]))


# ---- ingest ----------------------------------------------------------------------------

_ROW = "ledger_id, source_hash, txn_index, amount_minor"


def _rows(spark, sf_dir):
    return fx.ledger(spark, sf_dir).select(*[c.strip() for c in _ROW.split(",")], "posted_date")


def _late(spark, sf_dir):
    """Corrected statements of 1999 and later: amounts are one cent higher."""
    late = _rows(spark, sf_dir).filter(F.substring("source_hash", -7, 4) >= "1999")
    return late.withColumn("amount_minor", F.col("amount_minor") + 1)


@query("ing_upsert", over("t", "SELECT ledger_id, source_hash, txn_index, CASE WHEN right(source_hash, 7)[1:4] >= '1999' THEN amount_minor + 1 ELSE amount_minor END AS amount_minor FROM t"))
def ing_upsert(spark, sf_dir):
    return ingest.upsert(_rows(spark, sf_dir), _late(spark, sf_dir)).drop("posted_date")


@query(
    "ing_skip_dup",
    over("st2", "SELECT ledger_id, source_hash, CAST(1 AS BIGINT) AS file_no FROM st2 WHERE right(source_hash, 7)[1:4] >= '1998'"),
)
def ing_skip_dup(spark, sf_dir):
    """Every statement arrives twice; those before 1998 are stored already."""
    headers = fx.headers(spark, sf_dir).select("ledger_id", "source_hash")
    batch = headers.withColumn("file_no", F.explode(F.array(F.lit(2), F.lit(1))))
    stored = headers.filter(F.substring("source_hash", -7, 4) < "1998")
    return ingest.skip_duplicates(stored, batch)


_HASHED = (
    r"sha256(trim(regexp_replace(regexp_replace(upper(description), '\s+', ' ', 'g'), "
    r"'\s+(?:\d\d[/-]\d\d[/-]\d{2,4}|REF[\s#]?[A-Z0-9]+|ID[\s#]?[A-Z0-9]+|AUTH[\s#]?[A-Z0-9]+|TRACE[\s#]?[A-Z0-9]+)\s*$', ''))) AS description_hash"
)
_DEDUP = "ledger_id, bank_name, account_type, account_last_4, posted_date, amount_minor, description_hash"


@query(
    "ing_dedup_rows",
    over("t", f"SELECT * REPLACE (CAST(posted_date AS VARCHAR) AS posted_date) FROM (SELECT {_DEDUP}, min({{'h': source_hash, 'i': txn_index}}).h AS source_hash,"
         f" min({{'h': source_hash, 'i': txn_index}}).i AS txn_index, count(*) - 1 AS duplicates FROM (SELECT *, {_HASHED} FROM (SELECT * FROM t UNION ALL SELECT * REPLACE (source_hash || '-again' AS source_hash) FROM t)) GROUP BY {_DEDUP})"),
)
def ing_dedup_rows(spark, sf_dir):
    """Every statement was imported a second time under another hash."""
    rows = fx.ledger(spark, sf_dir)
    again = rows.withColumn("source_hash", F.concat("source_hash", F.lit("-again")))
    return ingest.dedup_rows(rows.unionByName(again))


@query(
    "ing_remove",
    over("t", "SELECT 'row' AS what, ledger_id, source_hash AS h, txn_index AS i FROM t WHERE right(source_hash, 4) <> '7-03' UNION ALL"
         " SELECT 'link' AS what, ledger_id, bank_source_hash AS h, bank_txn_index AS i FROM lnk WHERE right(bank_source_hash, 4) <> '7-03' AND right(cc_source_hash, 4) <> '7-03'",
         **cards.link_steps("t")),
)
def ing_remove(spark, sf_dir):
    """Remove the statements of March 1997 and the links that touch them."""
    removed = ingest.hashes(_rows(spark, sf_dir).filter(F.col("source_hash").endswith("7-03")))
    rows = ingest.remove_statements(_rows(spark, sf_dir), removed).select(
        F.lit("row").alias("what"), "ledger_id", F.col("source_hash").alias("h"), F.col("txn_index").alias("i")
    )
    kept = ingest.remove_links(cards.ledger_links(spark, sf_dir), removed).select(
        F.lit("link").alias("what"), "ledger_id", F.col("bank_source_hash").alias("h"), F.col("bank_txn_index").alias("i")
    )
    return rows.unionByName(kept)


def _entries(spark, sf_dir):
    """Hand-entered rows, one per event, some of them faulty."""
    e = F.col("event_id")
    return fx.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ledger_id"),
        F.when(e % 23 == 0, F.lit(" ")).otherwise(e.cast("string")).alias("id"),
        F.when(e % 23 == 1, F.lit("2024-13-01")).otherwise(F.to_date("ts").cast("string")).alias("posted_date"),
        F.when(e % 23 == 2, F.lit("")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("description"),
        F.when(e % 23 == 3, F.lit(0)).otherwise((F.round(F.col("value") * 100) * F.when(e % 2 == 0, 1).otherwise(-1))).cast("bigint").alias("amount_minor"),
        F.when(e % 23 == 4, F.lit("rupee")).when(e % 5 == 0, F.lit("inr")).alias("currency"),
        F.when(e % 7 == 0, F.lit("Wallet ")).when(e % 7 == 1, F.lit("  ")).alias("account_nickname"),
        F.lit(None).cast("string").alias("transaction_type"),
    )


@query(
    "ing_manual",
    "SELECT ledger_id, 'manual-' || CASE WHEN e % 23 = 0 THEN ' ' ELSE CAST(e AS VARCHAR) END AS source_hash, CAST(0 AS BIGINT) AS txn_index,"
    " CASE e % 7 WHEN 0 THEN 'Wallet' ELSE 'Cash' END AS bank_name, CASE WHEN e % 23 = 2 THEN '' ELSE event_type END AS description, amount_minor,"
    " upper(CASE WHEN e % 23 = 4 THEN 'rupee' WHEN e % 5 = 0 THEN 'inr' ELSE 'USD' END) AS currency, CASE WHEN amount_minor < 0 THEN 'purchase' ELSE 'deposit' END AS transaction_type,"
    " concat_ws('; ', CASE WHEN e % 23 = 0 THEN 'id: empty' END, CASE WHEN e % 23 = 1 THEN 'posted_date: not a real ISO date' END, CASE WHEN e % 23 = 2 THEN 'description: empty' END,"
    " CASE WHEN amount_minor = 0 THEN 'amount: zero or missing' END, CASE WHEN e % 23 = 4 THEN 'currency: not ISO 4217' END) AS issues FROM (SELECT user_id AS ledger_id, event_id AS e, event_type,"
    " CASE WHEN event_id % 23 = 3 THEN 0 ELSE CAST(round(value * 100) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) END AS amount_minor FROM events)",
)
def ing_manual(spark, sf_dir):
    return ingest.manual_imports(_entries(spark, sf_dir)).select(
        "ledger_id", "source_hash", "txn_index", "bank_name", "description", "amount_minor", "currency",
        "transaction_type", F.array_join("issues", "; ").alias("issues"),
    )


@query(
    "ing_partition_manual",
    over("st2", "SELECT * FROM (SELECT 'parsed' AS kind, count(*) AS n FROM st2 UNION ALL SELECT 'manual' AS kind, count(*) AS n FROM events)"),
)
def ing_partition_manual(spark, sf_dir):
    manual = ingest.manual_imports(_entries(spark, sf_dir)).select("ledger_id", "source_hash", "adapter_name")
    headers = fx.headers(spark, sf_dir).select("ledger_id", "source_hash", "adapter_name")
    parsed, by_hand = ingest.partition_manual(headers.unionByName(manual))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(parsed, "parsed").unionByName(count(by_hand, "manual"))


# heading of each bank's statements; the last kind is unknown, one kind carries two marks
_HEADS = [
    "Chase Card Services\nACCOUNT SUMMARY Credit Limit $5,000", "DISCOVER IT Cashback Bonus statement",
    "visit bankofamerica.com for details", "American Express Card Blue Cash Everyday",
    "Robinhood Money Account Number: XXXX 85 Willow Road", "JPMorgan Chase Bank, N.A. CHECKING SUMMARY",
    "Some Credit Union statement", "DISCOVER IT and bankofamerica.com",
]
_FAMILIES = ["chase-credit-card", "discover-credit-card", "bofa-credit-card", "amex", "robinhood-credit-card", "chase-checking", None, None]


def _files(spark, sf_dir):
    kind = F.col("ledger_id") % 8
    return fx.headers(spark, sf_dir).withColumn(
        "text", F.concat(fx._pick(kind, _HEADS), F.lit("\nledger "), F.col("ledger_id").cast("string"))
    )


@query(
    "ing_route",
    over("st2", "SELECT ledger_id, source_hash, CASE ledger_id % 8 WHEN 6 THEN 'unsupported' WHEN 7 THEN 'ambiguous' ELSE 'routed' END AS status, CASE ledger_id % 8 "
         + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAMILIES) if f) + " END AS family FROM st2"),
)
def ing_route(spark, sf_dir):
    return ingest.route(_files(spark, sf_dir)).select("ledger_id", "source_hash", "status", "family")


@query(
    "ing_outcomes",
    over("st2", "SELECT ledger_id, outcome, count(*) AS files FROM (SELECT ledger_id, CASE WHEN ledger_id % 8 = 6 THEN 'no_adapter' WHEN ledger_id % 8 = 7 OR provides = '' THEN 'parse'"
         " WHEN provides = 'D' OR EXISTS (SELECT 1 FROM lv WHERE NOT passed AND lv.ledger_id = st2.ledger_id AND lv.source_hash = st2.source_hash) THEN 'checksum'"
         " WHEN right(source_hash, 7)[1:4] < '1996' THEN 'duplicate' ELSE 'success' END AS outcome FROM st2) GROUP BY ALL", lv=LEVEL_ROWS),
)
def ing_outcomes(spark, sf_dir):
    files = ingest.route(_files(spark, sf_dir)).withColumns({
        "issues": quality.header_contract(),
        "already_stored": F.substring("source_hash", -7, 4) < "1996",
    })
    gate = _gate(spark, sf_dir).select("ledger_id", "source_hash", F.col("ok").alias("gate_ok"))
    return ingest.outcome_counts(files.join(gate, quality.STATEMENT_KEY))


@query(
    "ing_year_infer",
    over("t", "SELECT ledger_id, source_hash, txn_index, CAST(posted_date AS VARCHAR) AS posted_date FROM t"),
)
def ing_year_infer(spark, sf_dir):
    """Years of MM/DD rows in statements whose period runs over New Year."""
    rows = fx.ledger(spark, sf_dir).select(
        *schemas.ROW_KEY, F.date_format("posted_date", "MM/dd").alias("mmdd"),
        F.add_months(F.trunc("posted_date", "month"), -1).alias("before"), F.last_day("posted_date").alias("after"),
    )
    # December rows sit in a December-January statement, January rows in the same one
    december = F.substring("mmdd", 1, 2) == "12"
    period = rows.withColumns({
        "period_start": F.when(december, F.add_months("before", 1)).otherwise(F.col("before")),
        "period_end": F.when(december, F.last_day(F.add_months("after", 1))).otherwise(F.col("after")),
    })
    return ingest.infer_year(period).select(*schemas.ROW_KEY, "posted_date")


def _type_case() -> str:
    arms = " ".join(f"WHEN regexp_matches(description, '(?i){p}') THEN '{t}'" for t, p in fixed.TYPE_PATTERNS)
    return f"CASE WHEN {card_issuer('description')} IS NOT NULL THEN 'payment_to_card' {arms} ELSE 'other' END"


@query(
    "ing_type_infer",
    over("t", f"SELECT ledger_id, source_hash, txn_index, CASE WHEN account_type = 'credit_card' THEN CASE WHEN transaction_type = 'fee' THEN 'fee'"
         f" WHEN amount_minor < 0 THEN 'purchase' WHEN regexp_matches(description, '(?i){fixed.CARD_CREDIT_PAYMENT}') THEN 'payment_to_card' ELSE 'refund' END"
         f" ELSE {_type_case()} END AS inferred FROM t"),
)
def ing_type_infer(spark, sf_dir):
    from tallyspark.functions.text import bank_transaction_type, card_transaction_type

    text = F.col("description")
    section = (
        F.when(F.col("transaction_type") == "fee", F.lit("fees"))
        .when(F.col("amount_minor") < 0, F.lit("purchase")).otherwise(F.lit("payments_credits"))
    )
    return fx.ledger(spark, sf_dir).select(
        *schemas.ROW_KEY,
        F.when(F.col("account_type") == "credit_card", card_transaction_type(section, text))
        .otherwise(bank_transaction_type(text)).alias("inferred"),
    )


# ---- merge -----------------------------------------------------------------------------


@query(
    "set_merge_state",
    over("t", "SELECT 'row' AS what, ledger_id, source_hash AS h, txn_index AS i, CASE WHEN right(source_hash, 7)[1:4] > '1999' THEN amount_minor + 1 ELSE amount_minor END AS v FROM t UNION ALL"
         " SELECT 'link' AS what, ledger_id, bank_source_hash AS h, bank_txn_index AS i, matched_amount_minor AS v FROM lnk", **cards.link_steps("t")),
)
def set_merge_state(spark, sf_dir):
    """Left state: statements to 1999; right state: corrected statements from 1999 on."""
    left = _rows(spark, sf_dir).filter(F.substring("source_hash", -7, 4) <= "1999")
    right = _late(spark, sf_dir)
    rows = merge.merge_rows(left, right)
    found = cards.ledger_links(spark, sf_dir)
    year = F.substring("bank_source_hash", -7, 4)
    merged = merge.merge_links(found.filter(year <= "1999"), found.filter(year >= "1999"), rows)
    return rows.select(
        F.lit("row").alias("what"), "ledger_id", F.col("source_hash").alias("h"), F.col("txn_index").alias("i"),
        F.col("amount_minor").alias("v"),
    ).unionByName(merged.select(
        F.lit("link").alias("what"), "ledger_id", F.col("bank_source_hash").alias("h"),
        F.col("bank_txn_index").alias("i"), F.col("matched_amount_minor").alias("v"),
    ))


_EXTRA = "(m IN (0, 1, 4, 5, 6, 8, 9, 10, 11) OR refund_source_hash IS NOT NULL)"
_ANN = "ledger_id, source_hash, txn_index, category_id, source, rule_id"
_ANN_COLS = [c.strip() for c in _ANN.split(",")]


@query(
    "set_delete_category",
    over("ann", "SELECT ledger_id, source_hash, txn_index, CASE WHEN category_id = 'c-ring' THEN NULL ELSE category_id END AS category_id,"
         " CASE WHEN category_id = 'c-ring' THEN 'manual' ELSE source END AS source, CASE WHEN category_id = 'c-ring' THEN NULL ELSE rule_id END AS rule_id FROM ann"
         f" WHERE category_id IS DISTINCT FROM 'c-ring' OR source = 'manual' OR {_EXTRA}"),
)
def set_delete_category(spark, sf_dir):
    return merge.delete_category(fx.edits(spark, sf_dir), "c-ring").select(*_ANN_COLS)


# ledgers of remainder 0 delete a category with two below it, those of remainder 1 a single one and one they do not have
_GONE = (
    "SELECT ledger_id, category_id FROM (SELECT DISTINCT ledger_id FROM t), (VALUES (0, 'c-hardware'), (0, 'c-bolt'), (0, 'c-rod'), (1, 'c-ring'), (1, 'c-none')) g(k, category_id)"
    " WHERE ledger_id % 3 = k"
)
_GONE_HERE = "(ledger_id, category_id) IN (SELECT (ledger_id, category_id) FROM gone)"


def _after_deletion(spark, sf_dir):
    categories, ledger = fx.ledger_categories(spark, sf_dir), F.col("ledger_id")
    deletions = categories.select("ledger_id").distinct().select("ledger_id", F.explode(
        F.when(ledger % 3 == 0, F.array(F.lit("c-hardware"))).when(ledger % 3 == 1, F.array(F.lit("c-ring"), F.lit("c-none")))
    ).alias("category_id"))
    gone = merge.deletion_closure(deletions, categories)
    return merge.delete_categories(gone, categories, fx.ledger_rules(spark, sf_dir), fx.limits(spark, sf_dir), fx.edits(spark, sf_dir))


@query(
    "set_delete_tree_list",
    over("t", "SELECT ledger_id, category_id, name, parent_id FROM (SELECT DISTINCT ledger_id FROM t), (VALUES "
         + ", ".join(f"('{c}', '{n}', {'NULL' if p is None else repr(p)})" for c, n, p in fx.CATEGORIES)
         + f") k(category_id, name, parent_id) WHERE NOT {_GONE_HERE}", gone=_GONE),
)
def set_delete_tree_list(spark, sf_dir):
    return _after_deletion(spark, sf_dir)["categories"]


@query(
    "set_delete_tree_rules",
    over("t", "SELECT ledger_id, CAST(rule_no AS BIGINT) AS rule_no, rule_id, category_id FROM (SELECT DISTINCT ledger_id FROM t), (VALUES "
         + ", ".join(f"({r[0]}, '{r[1]}', '{r[5]}')" for r in fx.RULES) + f") k(rule_no, rule_id, category_id) WHERE NOT {_GONE_HERE}", gone=_GONE),
)
def set_delete_tree_rules(spark, sf_dir):
    return _after_deletion(spark, sf_dir)["rules"].select("ledger_id", F.col("rule_no").cast("bigint").alias("rule_no"), "rule_id", "category_id")


@query(
    "set_delete_tree_limits",
    over("t", "SELECT ledger_id, category_id, limit_minor FROM (SELECT c_custkey AS ledger_id, category_id, CAST(CASE WHEN category_id = 'c-gear' THEN 0"
         " ELSE (c_custkey % 10 + 1) * 1500000 END AS BIGINT) AS limit_minor FROM customer, (VALUES ('c-ring'), ('c-bolt'), ('c-food'), ('c-gear')) k(category_id))"
         f" WHERE NOT {_GONE_HERE}", gone=_GONE),
)
def set_delete_tree_limits(spark, sf_dir):
    return _after_deletion(spark, sf_dir)["limits"]


@query(
    "set_delete_tree_annotations",
    over(["t", "ann"], "SELECT ledger_id, source_hash, txn_index, CASE WHEN NOT g THEN category_id END AS category_id, CASE WHEN g THEN 'manual' ELSE source END AS source,"
         f" CASE WHEN NOT g THEN rule_id END AS rule_id FROM (SELECT *, coalesce({_GONE_HERE}, false) AS g FROM ann)"
         f" WHERE NOT g OR source = 'manual' OR {_EXTRA}", gone=_GONE),
)
def set_delete_tree_annotations(spark, sf_dir):
    return _after_deletion(spark, sf_dir)["annotations"].select(*_ANN_COLS)


@query(
    "set_changed",
    over("ann", "SELECT ledger_id, source_hash, txn_index, CASE WHEN source = 'rule' AND NOT " + _EXTRA + " THEN 'removed' ELSE 'changed' END AS change"
         " FROM ann WHERE category_id = 'c-ring'"),
)
def set_changed(spark, sf_dir):
    before = fx.edits(spark, sf_dir)
    return merge.changed(before, merge.delete_category(before, "c-ring"))


@query(
    "cat_set_manual",
    over(["t", "ann"], "SELECT ledger_id, source_hash, txn_index, CASE WHEN e THEN 'c-food' ELSE category_id END AS category_id, CASE WHEN e THEN 'manual' ELSE source END AS source,"
         " CASE WHEN NOT e THEN rule_id END AS rule_id FROM (SELECT ledger_id, source_hash, txn_index, abs(t.amount_minor) % 31 = 0 AS e, ann.category_id, ann.source, ann.rule_id,"
         " ann.source IS NOT NULL AS has FROM t LEFT JOIN ann USING (ledger_id, source_hash, txn_index)) WHERE e OR has"),
)
def cat_set_manual(spark, sf_dir):
    """Two edits for some rows; the later one wins."""
    picked = fx.ledger(spark, sf_dir).filter(F.abs("amount_minor") % 31 == 0).select(*schemas.ROW_KEY)
    edits = picked.withColumn("e", F.explode(F.array(
        F.struct(F.lit(1).alias("edit_no"), F.lit("c-travel").alias("category_id")),
        F.struct(F.lit(2).alias("edit_no"), F.lit("c-food").alias("category_id")),
    ))).select(*schemas.ROW_KEY, "e.*")
    return merge.set_manual(fx.edits(spark, sf_dir), edits).select(*_ANN_COLS)


@query(
    "cat_patch",
    over(["t", "ann"], "SELECT ledger_id, source_hash, txn_index, category_id, coalesce(source, 'manual') AS source, CASE WHEN e THEN 'patched' ELSE note END AS note, custom_name FROM ("
         "SELECT ledger_id, source_hash, txn_index, abs(t.amount_minor) % 37 = 0 AS e, ann.category_id, ann.source, ann.note, ann.custom_name, ann.source IS NOT NULL AS has"
         " FROM t LEFT JOIN ann USING (ledger_id, source_hash, txn_index)) WHERE e OR has"),
)
def cat_patch(spark, sf_dir):
    picked = fx.ledger(spark, sf_dir).filter(F.abs("amount_minor") % 37 == 0)
    patches = picked.select(
        *schemas.ROW_KEY, F.lit(1).alias("edit_no"), F.lit("patched").alias("note"), F.lit(None).cast("string").alias("custom_name")
    )
    return merge.patch(fx.edits(spark, sf_dir), patches, ["note", "custom_name"]).select(
        *schemas.ROW_KEY, "category_id", "source", "note", "custom_name"
    )


@query(
    "cat_prune",
    over("ann", "SELECT ledger_id, source_hash, txn_index, category_id, source, nullif(custom_name, '') AS custom_name FROM ann"
         " WHERE category_id IS NOT NULL OR source <> 'manual' OR m IN (0, 1, 4, 5, 6, 8, 9, 11) OR refund_source_hash IS NOT NULL"),
)
def cat_prune(spark, sf_dir):
    return merge.prune(fx.edits(spark, sf_dir)).select(
        *schemas.ROW_KEY, "category_id", "source", "custom_name"
    )
