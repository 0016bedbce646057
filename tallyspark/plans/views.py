"""Filters, lists, sorts, display projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions import dates, money, text
from tallyspark.operators import cashflow, views

from . import cadence, reports
from . import fixtures as fx
from .registry import query
from .sqlbase import CENTS, card_issuer, card_last4, clean, lit, normalize, over
from .quality import _HASHED, _fmt

_KEY = "ledger_id, source_hash, txn_index"
_KEYS = schemas.ROW_KEY


def _rows(spark, sf_dir):
    return fx.ledger(spark, sf_dir)


# ---- filters ---------------------------------------------------------------------------

_ACCOUNTS = ["Chase::credit_card::1000", "Wells Fargo::checking::5151", "Discover::credit_card::1001"] + [
    f"Discover::credit_card::{1000 + c}" for c in range(6, 200, 5)
]


@query(
    "flt_unified",
    over("t", f"SELECT {_KEY}, CAST(posted_date AS VARCHAR) AS posted_date, description, amount_minor FROM t WHERE bank_name || '::' || account_type || '::' || account_last_4 IN ("
         + ", ".join(lit(a) for a in _ACCOUNTS)
         + ") AND posted_date BETWEEN DATE '1996-02-01' AND DATE '2000-11-30' AND abs(amount_minor) BETWEEN 100025 AND 9000050 AND transaction_type IN ('purchase', 'refund')"
         " AND contains(lower(description), 'r') AND contains(lower(description), '#1')"),
)
def flt_unified(spark, sf_dir):
    return views.apply_filter(
        _rows(spark, sf_dir), _ACCOUNTS, "1996-02-01", "2000-11-30", 1000.25, 90000.5, " R  #1 ", ["purchase", "refund"]
    ).select(*_KEYS, "posted_date", "description", "amount_minor")


@query("flt_month_range", over("t", f"SELECT {_KEY}, amount_minor FROM t WHERE posted_date BETWEEN DATE '1998-02-01' AND DATE '1998-02-20'"))
def flt_month_range(spark, sf_dir):
    return views.month_range(_rows(spark, sf_dir), "1998-02", date_to="1998-02-20").select(*_KEYS, "amount_minor")


@query("flt_tag", over("ov", f"SELECT {_KEY}, amount_minor FROM ov WHERE list_contains(tags, 'x')"))
def flt_tag(spark, sf_dir):
    return views.with_tag(reports.overlaid(spark, sf_dir), "x").select(*_KEYS, "amount_minor")


@query("lst_tags", over("ann", "SELECT DISTINCT ledger_id, unnest(tags) AS tag FROM ann"))
def lst_tags(spark, sf_dir):
    return views.tags(fx.edits(spark, sf_dir))


@query("lst_accounts", over("t", "SELECT DISTINCT ledger_id, bank_name, account_type, account_last_4 FROM t"))
def lst_accounts(spark, sf_dir):
    return views.accounts(_rows(spark, sf_dir))


def _manual_names(spark, sf_dir):
    """Names added by hand: one new, one that repeats 'Cash', per customer."""
    cust = F.col("c_custkey")
    return fx.table(spark, sf_dir, "customer").select(
        cust.alias("ledger_id"),
        F.explode(F.array(F.lit(" CASH "), F.concat(F.lit("Jar "), cust.cast("string")))).alias("name"),
    ).withColumn("name_no", F.length("name"))


_NAMES = (
    "SELECT ledger_id, bank_name || ' ' || account_last_4 AS name FROM st2 UNION SELECT ledger_id, 'Cash' FROM (SELECT DISTINCT ledger_id FROM st2)"
    " UNION SELECT c_custkey, 'Jar ' || c_custkey FROM customer UNION SELECT c_custkey, 'CASH' FROM customer WHERE c_custkey NOT IN (SELECT ledger_id FROM st2)"
)


def _account_names(spark, sf_dir):
    return views.account_names(fx.headers(spark, sf_dir), _manual_names(spark, sf_dir))


@query("lst_account_names", over("st2", _NAMES))
def lst_account_names(spark, sf_dir):
    return _account_names(spark, sf_dir)


@query(
    "prj_nickname",
    over("st2", "SELECT ledger_id, name, CASE WHEN name <> 'Cash' AND ledger_id % 3 = 0 AND name LIKE 'Jar%' THEN 'Piggy' ELSE name END AS display_name FROM nm", nm=_NAMES),
)
def prj_nickname(spark, sf_dir):
    names = _account_names(spark, sf_dir)
    jars = names.filter(F.col("name").startswith("Jar") | (F.col("name") == "Cash")).select(
        "ledger_id", "name", F.when(F.col("ledger_id") % 3 == 0, F.lit(" Piggy ")).otherwise(F.lit("  ")).alias("nickname")
    )
    return views.nicknames(names, jars).select("ledger_id", "name", "display_name")


@query(
    "prj_detailed",
    over("ov", f"SELECT {_KEY}, CAST(posted_date AS VARCHAR) AS posted_date, coalesce(custom_name, {clean('description')}) AS description, amount_minor, own_category AS category_id,"
         " bank_name, ignored, refund_source_hash, refund_txn_index FROM ov"),
)
def prj_detailed(spark, sf_dir):
    return views.detailed(reports.overlaid(spark, sf_dir))


@query("flt_review_queue", over("ov", f"SELECT {_KEY}, amount_minor FROM ov WHERE own_category IS NULL AND NOT ignored"))
def flt_review_queue(spark, sf_dir):
    return views.review_queue(reports.overlaid(spark, sf_dir)).select(*_KEYS, "amount_minor")


@query("flt_refund_candidates", over("t", f"SELECT {_KEY}, amount_minor FROM t WHERE amount_minor < 0"))
def flt_refund_candidates(spark, sf_dir):
    return views.refund_candidates(_rows(spark, sf_dir)).select(*_KEYS, "amount_minor")


@query("flt_statement", over("t", f"SELECT {_KEY}, amount_minor FROM t WHERE source_hash = 'checking-Wells Fargo-5151-7-2024-01'"))
def flt_statement(spark, sf_dir):
    return views.statement_rows(_rows(spark, sf_dir), "checking-Wells Fargo-5151-7-2024-01").select(*_KEYS, "amount_minor")


@query("flt_category_drill", over("ov", f"SELECT {_KEY}, amount_minor FROM ov WHERE own_category = 'c-gear' AND amount_minor < 0"))
def flt_category_drill(spark, sf_dir):
    return views.category_drill(reports.overlaid(spark, sf_dir), "c-gear").select(*_KEYS, "amount_minor")


@query("flt_ignored", over("ov", f"SELECT {_KEY}, amount_minor FROM ov WHERE NOT ignored"))
def flt_ignored(spark, sf_dir):
    return reports.overlaid(spark, sf_dir).filter(~F.col("ignored")).select(*_KEYS, "amount_minor")


@query(
    "lst_months_nav",
    over("t", "SELECT ledger_id, month, has_data, lag(month) OVER w AS previous_month, lead(month) OVER w AS next_month FROM (SELECT ledger_id, month, max(h) AS has_data FROM ("
         "SELECT DISTINCT ledger_id, strftime(posted_date, '%Y-%m') AS month, true AS h FROM t UNION ALL SELECT DISTINCT ledger_id, '2001-12', false FROM t) GROUP BY ALL)"
         " WINDOW w AS (PARTITION BY ledger_id ORDER BY month)"),
)
def lst_months_nav(spark, sf_dir):
    return views.month_navigation(cashflow.months(_rows(spark, sf_dir)), "2001-12")


@query(
    "prj_summary_lines",
    over("st2", "SELECT ledger_id, source_hash, CAST(i AS BIGINT) AS line_no, CASE i WHEN 0 THEN 'Purchases' ELSE 'Payments' END AS label, CASE i WHEN 0 THEN debits ELSE credits END AS amount_minor"
         " FROM st2, (VALUES (0), (1)) v(i)"),
)
def prj_summary_lines(spark, sf_dir):
    return views.summary_lines(fx.headers(spark, sf_dir))


@query("srt_unified", over("t", f"SELECT {_KEY}, description, amount_minor FROM t ORDER BY lower(description) DESC, posted_date, source_hash, txn_index"))
def srt_unified(spark, sf_dir):
    return views.sort_rows(_rows(spark, sf_dir), "description", descending=True).select(*_KEYS, "description", "amount_minor")


@query(
    "page_list",
    over("t", f"SELECT {_KEY}, amount_minor, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY posted_date DESC, source_hash DESC, txn_index DESC) AS rank,"
         " count(*) OVER (PARTITION BY ledger_id) AS total FROM t) WHERE rank > 20 AND rank <= 40"),
)
def page_list(spark, sf_dir):
    return views.page(_rows(spark, sf_dir), 1, 20).select(*_KEYS, "amount_minor", "rank", "total")


_NAME_CASE = "CASE " + " ".join(f"WHEN category_id = '{c}' THEN '{n}'" for c, n, _ in fx.CATEGORIES[1:]) + " WHEN category_id IS NULL THEN 'Uncategorized' ELSE category_id END"


@query(
    "jn_category_names",
    over("sp", f"SELECT *, {_NAME_CASE} AS category_name FROM (SELECT ledger_id, category_id, CAST(sum(-amount_minor) AS BIGINT) AS spent_minor FROM sp WHERE amount_minor < 0 GROUP BY ALL)"),
)
def jn_category_names(spark, sf_dir):
    """The first category is left out of the name table, so its id shows."""
    names = cadence.categories(spark).filter(F.col("category_id") != fx.CATEGORIES[0][0])
    return views.category_names(cashflow.spending(reports.summary(spark, sf_dir)), names)


@query("agg_category_usage", over("ann", "SELECT ledger_id, category_id, count(*) AS rows FROM ann WHERE category_id IS NOT NULL GROUP BY ALL"))
def agg_category_usage(spark, sf_dir):
    return views.category_usage(fx.edits(spark, sf_dir))


# ---- source flattening -----------------------------------------------------------------


@query("src_flatten", over("t", f"SELECT {_KEY}, account_type, account_last_4, description, amount_minor FROM t"))
def src_flatten(spark, sf_dir):
    """Nested imports of at most a few hundred rows per part, flattened again.

    Fixture row numbers have gaps, so a part holds one contiguous number only.
    """
    nested = fx.nested_imports(_rows(spark, sf_dir))
    return views.flatten(nested).select(
        *_KEYS, "account_type", "account_last_4", "description", F.col("amount_minor").cast("bigint").alias("amount_minor")
    )


# ---- scalar functions ------------------------------------------------------------------

_MESSY = (
    "CASE {i} % 6 WHEN 0 THEN description WHEN 1 THEN '01/02 ' || description || '  Web ID: 12345' WHEN 2 THEN description || ' PPD ID: 99 REF 7'"
    " WHEN 3 THEN description || ' abc1d2e3f9' WHEN 4 THEN description || ' Transaction#: Q-1 1234567' ELSE 'Reference#: 5 ' || description || ' 12/31/24' END"
)


def _messy(spark, sf_dir):
    return _rows(spark, sf_dir).select(*_KEYS, F.expr(_MESSY.format(i="txn_index")).alias("raw"))


_MESSY_SQL = f"(SELECT {_KEY}, {_MESSY.format(i='txn_index')} AS raw FROM t)"


@query("fn_clean_desc", over("t", f"SELECT *, {clean('raw')} AS cleaned FROM {_MESSY_SQL}"))
def fn_clean_desc(spark, sf_dir):
    return _messy(spark, sf_dir).withColumn("cleaned", text.clean_description(F.col("raw")))


@query("fn_descriptor_key", over("t", f"SELECT *, upper({clean('raw')}) AS descriptor_key FROM {_MESSY_SQL}"))
def fn_descriptor_key(spark, sf_dir):
    return _messy(spark, sf_dir).withColumn("descriptor_key", text.descriptor_key(F.col("raw")))


@query("fn_normalize_desc", over("t", f"SELECT *, {normalize('raw')} AS of_raw, {normalize('cleaned')} AS of_cleaned FROM (SELECT *, {clean('raw')} AS cleaned FROM {_MESSY_SQL})").replace("SELECT *, " + normalize("raw"), "SELECT * EXCLUDE (cleaned), " + normalize("raw")))
def fn_normalize_desc(spark, sf_dir):
    return _messy(spark, sf_dir).withColumns({
        "of_raw": text.normalize_descriptor(F.col("raw")), "of_cleaned": text.stream_key(F.col("raw")),
    })


@query("fn_desc_hash", over("t", f"SELECT {_KEY}, {_HASHED.replace('upper(description)', 'upper(raw)')} FROM {_MESSY_SQL}"))
def fn_desc_hash(spark, sf_dir):
    return _messy(spark, sf_dir).select(*_KEYS, text.description_hash(F.col("raw")).alias("description_hash"))


@query("fn_card_payment", over("t", f"SELECT {_KEY}, {card_issuer('description')} AS issuer, {card_last4('description')} AS card_last_4 FROM t"))
def fn_card_payment(spark, sf_dir):
    return _rows(spark, sf_dir).select(*_KEYS, text.card_payment(F.col("description")).alias("c")).select(
        *_KEYS, "c.issuer", "c.card_last_4"
    )


def _printed(spark, sf_dir):
    """Order totals in eight spellings, two of them unreadable."""
    whole = F.format_number(F.expr("cents div 100"), 0)
    part = F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    plain = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), part)
    k = F.col("o_orderkey") % 8
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", money.cents(F.col("o_totalprice")).alias("cents")
    ).withColumn(
        "printed",
        F.when(k == 0, F.concat(F.lit("$"), whole, F.lit("."), part))
        .when(k == 1, F.concat(F.lit("("), whole, F.lit("."), part, F.lit(")")))
        .when(k == 2, F.concat(F.lit(" -$"), plain, F.lit(" ")))
        .when(k == 3, F.concat(F.lit("."), part))
        .when(k == 4, F.concat(plain, F.lit("x")))
        .when(k == 5, F.concat(F.lit("(("), plain, F.lit("))")))
        .when(k == 6, F.expr("cents div 100").cast("string"))
        .otherwise(plain),
    )


_PRINTED_VALUE = (
    "CASE o_orderkey % 8 WHEN 0 THEN c WHEN 1 THEN -c WHEN 2 THEN -c WHEN 3 THEN c % 100 WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN c // 100 * 100 ELSE c END"
)
_C = f"(SELECT *, {CENTS.format('o_totalprice')} AS c FROM orders)"


@query("fn_parse_money", f"SELECT o_orderkey, {_PRINTED_VALUE} AS amount_minor FROM {_C}")
def fn_parse_money(spark, sf_dir):
    return _printed(spark, sf_dir).select("o_orderkey", money.parse_money(F.col("printed")).alias("amount_minor"))


@query(
    "fn_parse_amount",
    # a third digit of 5 or more rounds the magnitude up
    f"SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN c + CASE WHEN o_orderkey % 10 >= 5 THEN 1 ELSE 0 END WHEN 1 THEN -(c + CASE WHEN o_orderkey % 10 >= 5 THEN 1 ELSE 0 END)"
    f" WHEN 2 THEN c WHEN 3 THEN -c ELSE NULL END AS amount_minor FROM {_C}",
)
def fn_parse_amount(spark, sf_dir):
    part = F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    plain = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), part)
    third = (F.col("o_orderkey") % 10).cast("string")
    k = F.col("o_orderkey") % 5
    printed = (
        F.when(k == 0, F.concat(F.lit("₹"), plain, third, F.lit("9")))
        .when(k == 1, F.concat(F.lit("-€ "), plain, third))
        .when(k == 2, F.concat(F.lit("(-"), plain, F.lit(")")))
        .when(k == 3, F.concat(F.lit("(£"), plain, F.lit(")")))
        .otherwise(F.concat(plain, F.lit("-")))
    )
    rows = _printed(spark, sf_dir).withColumn("printed", printed)
    return rows.select("o_orderkey", money.parse_amount(F.col("printed")).alias("amount_minor"))


@query("fn_trailing_minus", f"SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN '-' ELSE '' END || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS moved FROM {_C}")
def fn_trailing_minus(spark, sf_dir):
    part = F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    plain = F.concat(F.expr("cents div 100").cast("string"), F.lit("."), part)
    printed = F.concat(F.lit(" "), plain, F.when(F.col("o_orderkey") % 2 == 0, F.lit("-")).otherwise(F.lit("")))
    return _printed(spark, sf_dir).select("o_orderkey", money.move_trailing_minus(printed).alias("moved"))


_INR = (
    "CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || '₹' || CASE WHEN w > 999 THEN ltrim(reverse(regexp_replace(reverse(CAST(w // 1000 AS VARCHAR)), '(\\d\\d)', '\\1,', 'g')), ',')"
    " || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END || '.' || lpad(CAST(abs(amount_minor) % 100 AS VARCHAR), 2, '0')"
)


@query("fn_format_money", over("t", f"SELECT {_KEY}, {_fmt('amount_minor')} AS usd, {_INR} AS inr FROM (SELECT *, abs(amount_minor) // 100 AS w FROM t)"))
def fn_format_money(spark, sf_dir):
    amount = F.col("amount_minor")
    return _rows(spark, sf_dir).select(
        *_KEYS, money.format_money(amount, F.lit("USD")).alias("usd"), money.format_money(amount, F.lit("INR")).alias("inr")
    )


@query("fn_cents_decimal", over("t", f"SELECT {_KEY}, CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || abs(amount_minor) // 100 || '.' || lpad(CAST(abs(amount_minor) % 100 AS VARCHAR), 2, '0') AS amount FROM t"))
def fn_cents_decimal(spark, sf_dir):
    return _rows(spark, sf_dir).select(*_KEYS, money.cents_to_decimal(F.col("amount_minor")).alias("amount"))


@query("fn_sum_abs", over("t", "SELECT ledger_id, CAST(sum(amount_minor) AS BIGINT) AS sum_minor, CAST(sum(abs(amount_minor)) AS BIGINT) AS magnitude_minor FROM t GROUP BY ledger_id"))
def fn_sum_abs(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("ledger_id").agg(
        F.sum("amount_minor").alias("sum_minor"), F.sum(F.abs("amount_minor")).alias("magnitude_minor")
    )


@query(
    "fn_norm_date",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders",
)
def fn_norm_date(spark, sf_dir):
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    printed = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "M/d/yyyy"))
        .when(k == 2, F.date_format(day, "M/d/yy")).when(k == 3, F.date_format(day, "yyyy/M/dd"))
        .otherwise(F.date_format(day, "dd.MM.yyyy"))
    )
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", dates.normalize_date(printed).alias("iso"))


@query(
    "fn_days",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days, abs(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) <= 30 AS within_30"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def fn_days(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"))
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", dates.days_between(F.col("ordered"), F.col("shipped")).alias("days"),
        dates.within_days(F.col("ordered"), F.col("shipped"), 30).alias("within_30"),
    )


@query(
    "fn_month",
    over("t", f"SELECT {_KEY}, strftime(posted_date, '%Y-%m') AS month, CAST(day(last_day(posted_date)) AS BIGINT) AS days_in_month,"
         " strftime(date_trunc('month', posted_date) - INTERVAL 14 MONTH, '%Y-%m') AS shifted FROM t"),
)
def fn_month(spark, sf_dir):
    month = dates.month_key(F.col("posted_date"))
    return _rows(spark, sf_dir).select(
        *_KEYS, month.alias("month"), dates.days_in_month(month).alias("days_in_month"),
        dates.add_months_key(month, F.lit(-14)).alias("shifted"),
    )


@query("fn_days_in_month", over("t", f"SELECT {_KEY}, CAST(day(last_day(posted_date)) AS BIGINT) AS days_in_month FROM t"))
def fn_days_in_month(spark, sf_dir):
    month = dates.month_key(F.col("posted_date"))
    return _rows(spark, sf_dir).select(*_KEYS, dates.days_in_month(month).alias("days_in_month"))


@query("fn_add_months", over("t", f"SELECT {_KEY}, strftime(date_trunc('month', posted_date) + INTERVAL 5 MONTH, '%Y-%m') AS shifted FROM t"))
def fn_add_months(spark, sf_dir):
    month = dates.month_key(F.col("posted_date"))
    return _rows(spark, sf_dir).select(*_KEYS, dates.add_months_key(month, F.lit(5)).alias("shifted"))
