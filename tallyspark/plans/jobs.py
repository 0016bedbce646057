"""CSV, state, backup, streaming, redaction, layout and transfer queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.functions import fixed, redact
from tallyspark.operators import flow, layout, merge, quality, transfers
from tallyspark.sources import backup, csv, files, state
from tallyspark.streaming import jobs

from . import cadence, cards, reports
from . import fixtures as fx
from .quality import LEVEL_ROWS
from .registry import query
from .sqlbase import ctes, over

_KEY = "ledger_id, source_hash, txn_index"
_KEYS = schemas.ROW_KEY

# ---- CSV -------------------------------------------------------------------------------

_TEXT = "description || CASE txn_index % 3 WHEN 0 THEN ', \"quoted\"' WHEN 1 THEN ' line' || chr(10) || 'break' ELSE '' END"
_AMOUNT = "CASE WHEN amount_minor < 0 THEN '-' ELSE '' END || abs(amount_minor) // 100 || '.' || lpad(CAST(abs(amount_minor) % 100 AS VARCHAR), 2, '0')"
_EXPORT = (
    f"SELECT CAST(posted_date AS VARCHAR) AS date, {_TEXT} AS description, {_AMOUNT} AS amount, 'USD' AS currency, bank_name || ' ' || account_last_4 AS account,"
    " transaction_type AS category FROM t"
)


def _export(spark, sf_dir):
    return fx.ledger(spark, sf_dir).withColumns({
        "description": F.expr(_TEXT), "account": F.concat_ws(" ", "bank_name", "account_last_4"),
        "category": F.col("transaction_type"),
    })


def _csv_path(spark, sf_dir):
    return fx.staged_files(spark, sf_dir, "export_csv", lambda path: csv.write_csv(_export(spark, sf_dir), path))


@query("src_csv_export", over("t", _EXPORT))
def src_csv_export(spark, sf_dir):
    return csv.export_rows(_export(spark, sf_dir))


@query("src_csv_read", over("t", _EXPORT))
def src_csv_read(spark, sf_dir):
    """The exported files, read back."""
    return csv.read_csv(spark, _csv_path(spark, sf_dir), csv.EXPORT_COLUMNS).drop("source_id")


_BANK_HEADER = ["Trans Date", " Payee ", "Money Out", "Money In", "CCY", "Memo"]


def bank_csv(rows):
    """A bank's CSV layout with faulty rows planted by the amount; a zero amount is printed as $0.00."""
    m = F.abs("amount_minor") % 41
    amount = F.abs("amount_minor")
    text = F.concat(F.lit("$"), F.format_number(F.expr("abs(amount_minor) div 100"), 0), F.lit("."), F.lpad((amount % 100).cast("string"), 2, "0"))
    out = F.when(F.col("amount_minor") < 0, text).otherwise(F.lit(""))
    into = F.when(F.col("amount_minor") >= 0, text).otherwise(F.lit(""))
    return rows.select(
        F.lit("bank.csv").alias("source_id"),
        F.when(m == 1, F.lit("1998/01/05")).otherwise(F.col("posted_date").cast("string")).alias(_BANK_HEADER[0]),
        F.when(m == 2, F.lit("  ")).otherwise(F.col("description")).alias(_BANK_HEADER[1]),
        F.when(m == 3, text).when(m == 4, F.lit("")).otherwise(out).alias(_BANK_HEADER[2]),
        F.when(m == 3, text).when(m == 4, F.lit("")).otherwise(into).alias(_BANK_HEADER[3]),
        F.when(m == 5, F.lit("dollars")).when(m == 6, F.lit("eur")).otherwise(F.lit("")).alias(_BANK_HEADER[4]),
        F.lit("unused").alias(_BANK_HEADER[5]),
    )


def _bank_csv(spark, sf_dir):
    return bank_csv(fx.ledger(spark, sf_dir))


@query(
    "src_csv_headers",
    over("t", "SELECT CASE WHEN m = 1 THEN '1998/01/05' ELSE CAST(posted_date AS VARCHAR) END AS date, CASE WHEN m = 2 THEN '  ' ELSE description END AS description"
         " FROM (SELECT *, abs(amount_minor) % 41 AS m FROM t)"),
)
def src_csv_headers(spark, sf_dir):
    rows = _bank_csv(spark, sf_dir)
    fields = csv.map_headers([c for c in rows.columns if c != "source_id"])
    return rows.select(F.col(f"`{fields['date']}`").alias("date"), F.col(f"`{fields['description']}`").alias("description"))


@query(
    "src_csv_import",
    over("t", "SELECT CASE WHEN m = 1 THEN '1998/01/05' ELSE CAST(posted_date AS VARCHAR) END AS posted_date, CASE WHEN m = 2 THEN '' ELSE trim(description) END AS description,"
         " CASE m WHEN 3 THEN -abs(amount_minor) WHEN 4 THEN NULL ELSE amount_minor END AS amount_minor, CASE m WHEN 5 THEN 'DOLLARS' WHEN 6 THEN 'EUR' ELSE 'USD' END AS currency,"
         " CASE WHEN m <> 4 AND (m = 3 OR amount_minor < 0) THEN 'purchase' ELSE 'deposit' END AS transaction_type, CASE m WHEN 1 THEN 'bad_date' WHEN 2 THEN 'no_description'"
         " WHEN 3 THEN 'two_amounts' WHEN 4 THEN 'no_amount' WHEN 5 THEN 'bad_currency' ELSE '' END AS errors"
         " FROM (SELECT *, abs(amount_minor) % 41 AS m FROM t)"),
)
def src_csv_import(spark, sf_dir):
    return csv.parse_rows(_bank_csv(spark, sf_dir)).select(
        "posted_date", "description", "amount_minor", "currency", "transaction_type",
        F.array_join("errors", "; ").alias("errors"),
    )


@query(
    "src_csv_statement",
    over("t", "SELECT 'csv-bank.csv' AS source_hash, 'My Bank' AS bank_name, CAST(min(posted_date) AS VARCHAR) AS period_start, CAST(max(posted_date) AS VARCHAR) AS period_end,"
         " count(*) AS printed_transaction_count FROM t WHERE abs(amount_minor) % 41 NOT BETWEEN 1 AND 5"),
)
def src_csv_statement(spark, sf_dir):
    return csv.csv_statements(csv.parse_rows(_bank_csv(spark, sf_dir)), " My Bank ").select(
        "source_hash", "bank_name", "period_start", "period_end", "printed_transaction_count"
    )


# ---- state and backup ------------------------------------------------------------------


def _state_path(spark, sf_dir):
    return fx.staged_files(
        spark, sf_dir, "state_json",
        lambda path: state.write_state(fx.nested_imports(fx.ledger(spark, sf_dir)), path),
    )


@query("src_state_read", over("t", f"SELECT {_KEY}, CAST(posted_date AS VARCHAR) AS posted_date, amount_minor, transaction_type, 'posted' AS status FROM t"))
def src_state_read(spark, sf_dir):
    return state.state_rows(state.read_state(spark, _state_path(spark, sf_dir))).select(
        *_KEYS, "posted_date", "amount_minor", "transaction_type", "status"
    )


def _tables(spark, sf_dir, links: bool = True):
    found = {"links": cards.ledger_links(spark, sf_dir)} if links else {}
    return found | {
        "transactions": fx.ledger(spark, sf_dir), "statements": fx.headers(spark, sf_dir), "annotations": fx.edits(spark, sf_dir),
        "categories": fx.ledger_categories(spark, sf_dir),
        "rules": fx.ledger_rules(spark, sf_dir), "limits": fx.limits(spark, sf_dir), "goals": fx.goals(spark, sf_dir),
    }


def _backup_path(spark, sf_dir):
    return fx.staged_files(
        spark, sf_dir, "backup",
        lambda path: backup.write_backup(spark, path, _tables(spark, sf_dir), "2026-01-01T00:00:00Z"),
    )


_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", {rows} AS rows" for name, rows in {
        "transactions": "(SELECT count(*) FROM t)", "statements": "(SELECT count(*) FROM st2)", "annotations": "(SELECT count(*) FROM ann)",
        "links": "(SELECT count(*) FROM lnk)", "categories": f"(SELECT {len(fx.CATEGORIES)} * count(DISTINCT ledger_id) FROM t)",
        "rules": f"(SELECT {len(fx.RULES)} * count(DISTINCT ledger_id) FROM t)",
        "limits": "(SELECT 4 * count(*) FROM customer)", "goals": "(SELECT count(*) FROM customer)",
    }.items()
)


@query("sink_backup", over(["t", "ann", "st2"], f"SELECT 'tallyspark-backup' AS app, CAST(1 AS BIGINT) AS backup_version, \"table\", rows FROM ({_COUNTS})", **cards.link_steps("t")))
def sink_backup(spark, sf_dir):
    """Every section of the backup, counted as it is read back."""
    path = _backup_path(spark, sf_dir)
    manifest = spark.read.parquet(f"{path}/manifest").select("app", "backup_version", "table")
    counted = [
        spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        for name in [*backup.REQUIRED, *backup.OPTIONAL]
    ]
    return manifest.join(reduce(DataFrame.unionByName, counted), "table")


@query("src_restore", over(["t", "ann"], f"SELECT {_KEY}, amount_minor, category_id FROM t LEFT JOIN ann USING ({_KEY})"))
def src_restore(spark, sf_dir):
    """The restored transactions with their restored annotations; the backup is one without links, which are optional."""
    source = fx.staged_files(
        spark, sf_dir, "backup_without_links",
        lambda path: backup.write_backup(spark, path, _tables(spark, sf_dir, links=False), "2026-01-01T00:00:00Z"),
    )
    target = fx.staged_files(spark, sf_dir, "restored", lambda path: backup.restore(spark, source, path, backup.contracts()))
    rows = spark.read.parquet(f"{target}/transactions")
    edits = spark.read.parquet(f"{target}/annotations").select(*_KEYS, "category_id")
    return rows.join(edits, _KEYS, "left").select(*_KEYS, "amount_minor", "category_id")



# ---- transfers -------------------------------------------------------------------------


# The greedy choice as SQL: each step serves the next outflow of every (ledger, amount).
_ACCOUNT = "bank_name || ':' || account_type || ':' || account_last_4"
_GREEDY = {
    "legs": f"SELECT ledger_id, abs(amount_minor) AS mag, amount_minor < 0 AS is_out, posted_date AS d, {_ACCOUNT} AS acc, source_hash || '#' || txn_index AS k,"
    " source_hash AS h, txn_index AS i, regexp_matches(description, '(?i)" + fixed.TRANSFER_HINT + "') AS hint FROM t WHERE amount_minor <> 0",
    "outs": "SELECT *, row_number() OVER (PARTITION BY ledger_id, mag ORDER BY d, k) AS rn FROM legs WHERE is_out AND (ledger_id, mag) IN (SELECT (ledger_id, mag) FROM legs WHERE NOT is_out)",
    "ins": "SELECT * FROM legs WHERE NOT is_out",
}
_CHOICE = (
    "ch AS (SELECT DISTINCT ledger_id, mag, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS ok, CAST(NULL AS VARCHAR) AS ik, CAST([] AS VARCHAR[]) AS used FROM outs UNION ALL"
    " SELECT ledger_id, mag, n, ok, b AS ik, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END AS used FROM (SELECT ch.ledger_id, ch.mag, ch.n + 1 AS n, o.k AS ok, ch.used,"
    " min({'g': abs(i.d - o.d), 'k': i.k}).k AS b FROM ch JOIN outs o ON o.ledger_id = ch.ledger_id AND o.mag = ch.mag AND o.rn = ch.n + 1"
    " LEFT JOIN ins i ON i.ledger_id = ch.ledger_id AND i.mag = ch.mag AND i.acc <> o.acc AND abs(i.d - o.d) <= 5 AND NOT list_contains(ch.used, i.k)"
    " GROUP BY ch.ledger_id, ch.mag, ch.n, o.k, ch.used))"
)
_PAIRS = (
    "pairs AS (SELECT ch.ledger_id, o.h AS out_hash, o.i AS out_index, i.h AS in_hash, i.i AS in_index, ch.mag AS amount_minor, o.acc AS out_account_id, i.acc AS in_account_id,"
    " CAST(o.d AS VARCHAR) AS out_date, CAST(i.d AS VARCHAR) AS in_date, CAST(abs(i.d - o.d) AS BIGINT) AS gap_days, CASE WHEN o.hint OR i.hint THEN 'high' ELSE 'medium' END AS confidence"
    " FROM ch JOIN outs o ON o.ledger_id = ch.ledger_id AND o.k = ch.ok JOIN ins i ON i.ledger_id = ch.ledger_id AND i.k = ch.ik)"
)


def _with_pairs(names: list[str], select: str, **extra: str) -> str:
    base = ctes(*names, extra=_GREEDY | extra).rstrip()
    return base.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_CHOICE}, {_PAIRS} " + select


def _pairs(spark, sf_dir):
    return transfers.detect_transfers(fx.ledger(spark, sf_dir))


@query("jn_transfers", _with_pairs(["t"], "SELECT * FROM pairs"))
def jn_transfers(spark, sf_dir):
    return _pairs(spark, sf_dir)


_IGNORED = "(SELECT (ledger_id, source_hash, txn_index) FROM ann WHERE ignored)"


@query(
    "jn_transfer_open",
    _with_pairs(["ann"], f"SELECT * FROM pairs WHERE NOT ((ledger_id, out_hash, out_index) IN {_IGNORED} AND (ledger_id, in_hash, in_index) IN {_IGNORED})"),
)
def jn_transfer_open(spark, sf_dir):
    return transfers.open_pairs(_pairs(spark, sf_dir), fx.edits(spark, sf_dir))


_LEGS = "(SELECT ledger_id, out_hash AS source_hash, out_index AS txn_index FROM pairs UNION ALL SELECT ledger_id, in_hash, in_index FROM pairs)"


@query(
    "jn_transfer_exclude",
    _with_pairs(["ann"], f"SELECT {_KEY}, category_id, coalesce(source, 'manual') AS source, true AS ignored FROM ann FULL JOIN (SELECT *, true AS leg FROM {_LEGS}) l"
                f" USING ({_KEY}) WHERE ignored OR leg"),
)
def jn_transfer_exclude(spark, sf_dir):
    """Annotations after every pair is confirmed: both legs ignored."""
    patches = merge.transfer_exclusions(_pairs(spark, sf_dir))
    edited = merge.patch(fx.edits(spark, sf_dir), patches, ["ignored"])
    return edited.filter("ignored").select(*_KEYS, "category_id", "source", "ignored")


@query(
    "flow_infer_detectors",
    _with_pairs(["fl"], f"SELECT {_KEY}, coalesce(user_intent, CASE WHEN ({_KEY}) IN (SELECT (ledger_id, bank_source_hash, bank_txn_index) FROM lnk) THEN 'cc_payment'"
                f" WHEN ({_KEY}) IN (SELECT ({_KEY}) FROM {_LEGS}) THEN 'transfer_self' WHEN ({_KEY}) IN (SELECT ({_KEY}) FROM pc WHERE confidence IS NOT NULL) THEN 'salary' ELSE intent END)"
                " AS flow_intent FROM fl", **cards.link_steps("t"), **cadence._PAY),
)
def flow_infer_detectors(spark, sf_dir):
    """Flow intents sharpened by links, transfer pairs and paychecks."""
    found = cards.ledger_links(spark, sf_dir).select(
        "ledger_id", F.col("bank_source_hash").alias("source_hash"), F.col("bank_txn_index").alias("txn_index")
    )
    return flow.infer_flow(
        flow.overlay(fx.ledger(spark, sf_dir), fx.edits(spark, sf_dir)), found, transfers.leg_keys(_pairs(spark, sf_dir)),
        cadence._paychecks(spark, sf_dir),
    ).select(*_KEYS, "flow_intent")


# ---- text ------------------------------------------------------------------------------

_NAMES = ["que", "the house"]
_CONFIG = redact.RedactConfig(names=_NAMES, addresses=["le de"], emails=["info@example.com"], phones=["555-0100"])


def _redacted(spark, sf_dir):
    return redact.redact(fx.documents(spark, sf_dir), _CONFIG)


# Word edges that consume a character need a second run for neighbours that share it.
def _twice(text: str, pattern: str, replacement: str) -> str:
    once = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"regexp_replace({once}, '{pattern}', '{replacement}', 'g')"


# A mark before every character that may follow a match, so that a match need not take that character itself.
def _marked(text: str, inner: str) -> str:
    return f"(regexp_replace({text}, '([^{inner}])', chr(1) || '\\1', 'g') || chr(1))"


_GAP = r"(?:\x01[\s\x0B.]|-)?"
_PHONE = rf"(?:(?:\x01\+)?1{_GAP})?(?:\x01\()?[2-9]\d{{2}}(?:\x01\))?{_GAP}\d{{3}}{_GAP}\d{{4}}"
_ACCOUNT = r"(?:Account|Acct\.?|A/C)[\s\x0B]*(?:Number|No\.?|#)?[\s\x0B]*[#:]?[\s\x0B]*"


def _masked_accounts(text: str) -> str:
    for n in range(12, 8, -1):
        text = f"regexp_replace({text}, '(?i)(^|[^0-9A-Za-z_])({_ACCOUNT})\\d{{{n - 4}}}(\\d{{4}})\\b', '\\1\\2{'X' * (n - 4)}\\3', 'g')"
    return text


# (category, mark of a replacement, SQL of the pass over x)
_STAGES = [
    ("name", "ACCOUNT HOLDER", _twice("x", "(?i)(^|[^A-Za-z0-9])the house([^A-Za-z0-9]|$)", r"\1ACCOUNT HOLDER\2")),
    ("name", "ACCOUNT HOLDER", _twice("x", "(?i)(^|[^A-Za-z0-9])que([^A-Za-z0-9]|$)", r"\1ACCOUNT HOLDER\2")),
    ("address", "ADDRESS REDACTED", "regexp_replace(x, '(?i)le de', 'ADDRESS REDACTED', 'g')"),
    ("phone", "PHONE REDACTED", "replace(x, '555-0100', 'PHONE REDACTED')"),
    ("email", "EMAIL REDACTED", r"regexp_replace(x, '(?i)info@example\.com', 'EMAIL REDACTED', 'g')"),
    ("credit_card_number", "XXXX-XXXX-XXXX-", _twice(
        "x", r"(^|[^0-9A-Za-z_-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?(\d{4})([^0-9A-Za-z_-]|$)", r"\1XXXX-XXXX-XXXX-\2\3")),
    ("account_number", "XXXXX", _masked_accounts("x")),
    ("ssn", "SSN REDACTED", r"regexp_replace(x, '\b\d{3}-\d\d-\d{4}\b', 'SSN REDACTED', 'g')"),
    ("email_auto", "EMAIL REDACTED", r"regexp_replace(x, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', 'EMAIL REDACTED', 'g')"),
    ("phone_auto", "PHONE REDACTED",
     f"replace(regexp_replace({_marked('x', '0-9-')}, '(^|[^\\d.\\x01-]){_PHONE}\\x01', '\\1PHONE REDACTED', 'g'), chr(1), '')"),
]
_PASSES = "WITH s0 AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x FROM documents)" + "".join(
    f", s{n + 1} AS MATERIALIZED (SELECT doc_id, {sql} AS x FROM s{n})" for n, (_, _, sql) in enumerate(_STAGES)
)


def _marks(n: int, mark: str) -> str:
    return f"(SELECT sum((length(x) - length(replace(x, '{mark}', ''))) // {len(mark)}) FROM s{n})"


@query("redact_text", f"{_PASSES} SELECT doc_id, x AS redacted FROM s{len(_STAGES)}")
def redact_text(spark, sf_dir):
    return _redacted(spark, sf_dir).select("doc_id", "redacted")


@query(
    "redact_summary",
    _PASSES + " SELECT category, CAST(sum(n) AS BIGINT) AS redactions FROM (" + " UNION ALL ".join(
        f"SELECT '{category}' AS category, {_marks(n + 1, mark)} - {_marks(n, mark)} AS n" for n, (category, mark, _) in enumerate(_STAGES)
    ) + ") GROUP BY category HAVING sum(n) > 0",
)
def redact_summary(spark, sf_dir):
    return redact.redaction_summary(_redacted(spark, sf_dir))


def _extracted(n: int) -> str:
    """Originals of one pass; doubled separators, or marks, let neighbours share none."""
    category, _, _ = _STAGES[n]
    doubled = "regexp_replace(x, '([^A-Za-z0-9])', '\\1\\1', 'g')"
    x, pattern, group = {
        0: (doubled, "(?i)(?:^|[^A-Za-z0-9])(the  house)(?:[^A-Za-z0-9]|$)", 1),
        1: (doubled, "(?i)(?:^|[^A-Za-z0-9])(que)(?:[^A-Za-z0-9]|$)", 1),
        2: ("x", "(?i)le de", 0), 3: ("x", "555-0100", 0), 4: ("x", r"(?i)info@example\.com", 0),
        5: (_marked("x", "0-9A-Za-z_-"), r"(?:^|[^0-9A-Za-z_\x01-])(\d{4}(?:\x01 |-)?\d{4}(?:\x01 |-)?\d{4}(?:\x01 |-)?\d{4})\x01", 1),
        6: ("x", rf"(?i)(?:^|[^0-9A-Za-z_])({_ACCOUNT}\d{{9,12}})\b", 1),
        7: ("x", r"\b\d{3}-\d\d-\d{4}\b", 0),
        8: ("x", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0),
        9: (_marked("x", "0-9-"), rf"(?:^|[^\d.\x01-])({_PHONE})\x01", 1),
    }[n]
    original = f"unnest(regexp_extract_all({x}, '{pattern}', {group}))"
    plain = f"replace({original}, '  ', ' ')" if n < 2 else f"replace({original}, chr(1), '')"
    return f"SELECT doc_id, CAST({n} AS BIGINT) AS pass_no, '{category}' AS category, {plain} AS original FROM s{n}"


@query("redact_report", _PASSES + " " + " UNION ALL ".join(_extracted(n) for n in range(len(_STAGES))))
def redact_report(spark, sf_dir):
    return redact.redactions(_redacted(spark, sf_dir), "doc_id")


@query(
    "fn_source_hash",
    "SELECT doc_id, sha256(text) AS source_hash FROM documents",
)
def fn_source_hash(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("source_hash"))


# eight words a line, sixty lines a page, the line's words slightly out of level
_WORDS = (
    r"SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM documents WHERE text IS NOT NULL)"
)


def text_items(spark, sf_dir):
    words = fx.documents(spark, sf_dir).select(
        "doc_id", F.posexplode_outer(F.split("text", r"\s+")).alias("pos", "text")
    ).filter(F.col("text").isNotNull())
    pos = F.col("pos")
    return words.select(
        "doc_id", F.expr("pos div 480").alias("page"),
        (F.lit(50.0) + pos % 8 * 60).alias("x"),
        (F.lit(800.0) - F.expr("(pos div 8) % 60") * 10 - pos % 3 * 0.5).alias("y"),
        pos.cast("bigint").alias("item_no"), "text",
    )


def _lines(spark, sf_dir):
    return layout.line_texts(layout.assign_lines(text_items(spark, sf_dir)))


@query(
    "ing_layout_rows",
    "SELECT doc_id, pos // 480 AS page, (pos // 8) % 60 AS line_no, count(*) AS items, trim(regexp_replace(string_agg(w, ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS text"
    f" FROM ({_WORDS}) GROUP BY ALL",
)
def ing_layout_rows(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "page", "line_no", "items", "text")


@query(
    "ing_layout_columns",
    "SELECT doc_id, pos // 480 AS page, (pos // 8) % 60 AS line_no, coalesce(trim(regexp_replace(string_agg(w, ' ' ORDER BY pos) FILTER (pos % 8 < 2), '\\s+', ' ', 'g')), '') AS \"left\","
    " coalesce(trim(regexp_replace(string_agg(w, ' ' ORDER BY pos) FILTER (pos % 8 >= 2 AND pos % 8 < 6), '\\s+', ' ', 'g')), '') AS middle"
    f" FROM ({_WORDS}) GROUP BY ALL",
)
def ing_layout_columns(spark, sf_dir):
    return layout.column_texts(
        layout.assign_lines(text_items(spark, sf_dir)), [("left", 0.0, 170.0), ("middle", 170.0, 410.0)]
    )


@query(
    "ing_layout_header",
    "SELECT doc_id, page, CAST(coalesce(min(line_no) FILTER (regexp_matches(text, '(?i)\\bthe\\b')), -1) AS BIGINT) AS header_line FROM ("
    "SELECT doc_id, pos // 480 AS page, (pos // 8) % 60 AS line_no, trim(regexp_replace(string_agg(w, ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS text"
    f" FROM ({_WORDS}) GROUP BY ALL) GROUP BY ALL",
)
def ing_layout_header(spark, sf_dir):
    return layout.header_line(_lines(spark, sf_dir), r"(?i)(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])")


# ---- streaming -------------------------------------------------------------------------

_NET = (
    "SELECT ledger_id, strftime(posted_date, '%Y-%m') AS month, CAST(sum(CASE WHEN amount_minor > 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS inflow_minor,"
    " CAST(sum(CASE WHEN amount_minor < 0 THEN -amount_minor ELSE 0 END) AS BIGINT) AS outflow_minor, CAST(sum(amount_minor) AS BIGINT) AS net_minor FROM t GROUP BY ALL"
)


def _arrivals(spark, sf_dir):
    """The ledger as arriving files."""
    return fx.staged_files(spark, sf_dir, "arrivals", lambda path: fx.ledger(spark, sf_dir).drop("origin_hash", "origin_index").write.mode("overwrite").option("compression", "zstd").parquet(path))


# statements that are complete and pass the gate
_GOOD = (
    "SELECT t.* FROM t JOIN st2 USING (ledger_id, source_hash) WHERE st2.n >= st2.printed_transaction_count AND provides NOT IN ('', 'D') AND NOT EXISTS ("
    "SELECT 1 FROM lv WHERE NOT passed AND lv.ledger_id = t.ledger_id AND lv.source_hash = t.source_hash)"
)


@query("strm_ingest", over(["t", "st2"], _NET.replace("FROM t ", f"FROM ({_GOOD}) "), lv=LEVEL_ROWS))
def strm_ingest(spark, sf_dir):
    """Every file arrives twice and statements spread over batches; only whole, sound statements count, once."""
    arrivals = spark.read.parquet(_arrivals(spark, sf_dir))
    work = fx.fresh_folder(spark, "strm_ingest")
    headers = fx.headers_path(spark, sf_dir)
    for _ in range(2):
        arrivals.write.mode("append").option("compression", "zstd").parquet(f"{work}/inbox")
        files = -(-len(spark.read.parquet(f"{work}/inbox").inputFiles()) // 2)
        jobs.ingest_stream(
            spark, f"{work}/inbox", arrivals.schema, headers, f"{work}/store", f"{work}/offsets", files
        ).awaitTermination()
    return jobs.net_report(spark.read.parquet(f"{work}/store/report"))


@query("strm_month", over("t", _NET))
def strm_month(spark, sf_dir):
    source = _arrivals(spark, sf_dir)
    work = fx.fresh_folder(spark, "strm_month")
    jobs.month_stream(
        spark, source, spark.read.parquet(source).schema, f"{work}/report", f"{work}/offsets"
    ).awaitTermination()
    return jobs.latest_months(spark.read.parquet(f"{work}/report"))


# ---- files as bytes --------------------------------------------------------------------

# one file per source of the documents, and copies of two of them under other names
_FILES = (
    "SELECT source AS name, sha256(content) AS source_hash, CAST(octet_length(encode(content)) AS BIGINT) AS n_bytes"
    " FROM (SELECT source, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY source)"
)


def _statement_folder(spark, sf_dir):
    def write(path):
        docs = fx.table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        for copy, part in (("first", docs), ("again", docs.filter(F.col("source") < "src15"))):
            part.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(f"{path}/{copy}")

    return fx.staged_files(spark, sf_dir, "statement_files", write)


def _files(spark, sf_dir):
    found = files.statement_files(spark, _statement_folder(spark, sf_dir)).filter(F.col("path").endswith(".txt"))
    return found.withColumns({
        "name": F.regexp_extract("path", "source=([^/]*)/", 1), "copy": F.regexp_extract("path", "/(first|again)/source=", 1),
    })


@query(
    "src_files",
    f"SELECT name, copy, source_hash, n_bytes, 'ok' AS status FROM ({_FILES}), (VALUES ('first'), ('again')) c(copy)"
    " WHERE copy = 'first' OR name < 'src15'",
)
def src_files(spark, sf_dir):
    """Hash of the bytes of every written file."""
    return _files(spark, sf_dir).select("name", "copy", "source_hash", "n_bytes", "status")


@query("src_files_new", f"SELECT name, source_hash, n_bytes FROM ({_FILES}) WHERE n_bytes % 2 = 1")
def src_files_new(spark, sf_dir):
    """Files of even size were imported before; of equal files one stays."""
    found = _files(spark, sf_dir)
    known = found.filter(F.col("n_bytes") % 2 == 0)
    fresh = files.new_files(found, known)
    return fresh.join(found.select("path", "name"), "path").select("name", "source_hash", "n_bytes")
