"""The fixture rules and shared steps as SQL, for checking against another engine."""

from __future__ import annotations

from tallyspark import schemas
from tallyspark.functions import fixed

from . import fixtures as fx


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def case(index: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {v if isinstance(v, int) else lit(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


CENTS = "CAST(round({} * 100) AS BIGINT)"
MONTH = "strftime({}, '%Y-%m')"


def _family(source: str, **cols: str) -> str:
    """SELECT of one row family; source_hash is computed from the other columns."""
    inner = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return (
        f"SELECT *, account_type || '-' || bank_name || '-' || account_last_4 || '-' || ledger_id"
        f" || '-' || strftime(posted_date, '%Y-%m') AS source_hash FROM (SELECT {inner} FROM {source})"
    )


_CARD = dict(
    ledger_id="o_custkey",
    bank_name=case("o_custkey % 5", fx.BANKS),
    account_type="'credit_card'",
    account_last_4="CAST(1000 + o_custkey % 9000 AS VARCHAR)",
)
_PAY_DAY = "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER)"
_TOTAL = CENTS.format("o_totalprice")

_CARD_PAYMENTS = _family(
    "orders WHERE o_orderstatus = 'F'", **_CARD,
    posted_date=_PAY_DAY, description="'PAYMENT - THANK YOU'", amount_minor=_TOTAL,
    transaction_type="'payment_to_card'", txn_index="o_orderkey * 256 + 255",
    origin_hash="CAST(NULL AS VARCHAR)", origin_index="CAST(NULL AS BIGINT)",
)
_BANK_PAYMENTS = _family(
    "orders WHERE o_orderstatus = 'F'",
    ledger_id="o_custkey", bank_name="'Chase'", account_type="'checking'",
    account_last_4="CAST(1000 + (o_custkey + 4500) % 9000 AS VARCHAR)",
    posted_date="CAST(o_orderdate AS DATE)",
    description="CASE o_custkey % 5 WHEN 0 THEN 'Payment To Chase Card Ending IN ' || (1000 + o_custkey % 9000)"
    " WHEN 1 THEN 'Discover E-Payment ' || (1000 + o_custkey % 9000)"
    " WHEN 2 THEN 'Bank of America Payment Web ID: 12345'"
    " WHEN 3 THEN 'American Express ACH Pmt M1234' ELSE 'Robinhood Card Payment' END",
    amount_minor=f"-{_TOTAL}", transaction_type="'payment_to_card'",
    txn_index="o_orderkey * 256 + 250",
    origin_hash="CAST(NULL AS VARCHAR)", origin_index="CAST(NULL AS BIGINT)",
)
_PURCHASES = _family(
    "(SELECT l.*, o.*, p.p_name, (l_orderkey + l_partkey + l_suppkey) % 249 AS bucket,"
    f" {CENTS.format('l_extendedprice')} AS price FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey"
    " JOIN part p ON l_partkey = p_partkey)",
    **_CARD,
    posted_date="CAST(l_shipdate AS DATE)", description="p_name || ' #' || l_orderkey",
    amount_minor="CASE WHEN l_returnflag = 'R' THEN price ELSE -price END",
    transaction_type="CASE WHEN l_returnflag = 'R' THEN 'refund' WHEN l_linenumber = 7 THEN 'fee' ELSE 'purchase' END",
    l_orderkey="l_orderkey", l_linenumber="l_linenumber", l_partkey="l_partkey", price="price",
    l_returnflag="l_returnflag", l_suppkey="l_suppkey", bucket="bucket",
    origin_hash="CASE WHEN l_returnflag = 'R' THEN CASE WHEN o_orderstatus = 'F' THEN"
    f" 'credit_card-' || {case('o_custkey % 5', fx.BANKS)} || '-' || (1000 + o_custkey % 9000) || '-' || o_custkey"
    f" || '-' || strftime({_PAY_DAY}, '%Y-%m') ELSE 'gone' END END",
    origin_index="CASE WHEN l_returnflag = 'R' THEN CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 256 + 255 ELSE 0 END END",
)
_PAYCHECKS = _family(
    "customer, generate_series(0, 11) g(n) WHERE c_custkey % 3 = 0",
    ledger_id="c_custkey", bank_name="'Chase'", account_type="'checking'", account_last_4="'4242'",
    posted_date=f"DATE '1997-01-02' + CAST(n * {case('c_custkey % 5', fx.PAY_STEPS)} + (c_custkey + n * 3) % 2 AS INTEGER)",
    description="'PAYROLL ' || c_mktsegment || ' ' || (c_custkey * 100 + n)",
    amount_minor="CAST(200000 + n % 5 * 100 AS BIGINT)", transaction_type="'deposit'",
    txn_index="CAST(n * 256 + 251 AS BIGINT)",
    origin_hash="CAST(NULL AS VARCHAR)", origin_index="CAST(NULL AS BIGINT)",
)
_TRANSFERS = _family(
    "orders, (VALUES (0), (1)) v(leg) WHERE o_orderstatus = 'P'",
    ledger_id="o_custkey // 40", bank_name="CASE leg WHEN 0 THEN 'Chase' ELSE 'Ally' END",
    account_type="CASE leg WHEN 0 THEN 'checking' ELSE 'savings' END",
    account_last_4="CASE leg WHEN 0 THEN '4242' ELSE '7777' END",
    posted_date="CAST(o_orderdate AS DATE) + CAST(CASE leg WHEN 0 THEN 0 ELSE o_orderkey % 8 END AS INTEGER)",
    description="CASE WHEN o_orderkey % 3 = 0 THEN 'Online Banking Transfer ' ELSE 'Move ' END || o_orderkey",
    amount_minor=f"CASE leg WHEN 0 THEN -1 ELSE 1 END * (1 + {_TOTAL} // 2000000) * 100000",
    transaction_type="'transfer'", txn_index="o_orderkey * 256 + 252",
    origin_hash="CAST(NULL AS VARCHAR)", origin_index="CAST(NULL AS BIGINT)",
)
_N = len(fx.EVERYDAY)
_EVERYDAY = _family(
    "events",
    ledger_id="user_id", bank_name="'Wells Fargo'", account_type="'checking'", account_last_4="'5151'",
    posted_date="CAST(ts AS DATE)",
    description=case(f"event_id % {_N}", [d for d, _, _ in fx.EVERYDAY]),
    amount_minor=f"{CENTS.format('value')} * {case(f'event_id % {_N}', [s for _, s, _ in fx.EVERYDAY])}",
    transaction_type=case(f"event_id % {_N}", [t for _, _, t in fx.EVERYDAY]),
    txn_index="event_id * 256 + 253",
    origin_hash="CAST(NULL AS VARCHAR)", origin_index="CAST(NULL AS BIGINT)",
)

_COLS = (
    "ledger_id, source_hash, CAST(txn_index AS BIGINT) AS txn_index, bank_name, account_type, account_last_4,"
    " posted_date, description, amount_minor, transaction_type, origin_hash, origin_index"
)


def _noun(text: str) -> str:
    arms = " ".join(f"WHEN contains({text}, '{n}') THEN 'c-{n}'" for n in fx.NOUNS)
    return f"CASE {arms} ELSE 'c-other' END"


def clean(text: str) -> str:
    """Description cleaning; the look-ahead step is stated on the last token."""
    s = f"coalesce({text}, '')"
    for pattern in (r"\s*Web ID:\s*\d+\b", r"\s*PPD ID:\s*\d+\b", r"\s*Transaction#:\s*\S*", r"\s*Reference#:\s*\S*"):
        s = f"regexp_replace({s}, '{pattern}', '', 'gi')"
    s = rf"regexp_replace({s}, '^\s*\d\d/\d\d\s+', '')"
    return (
        rf"(SELECT trim(regexp_replace(regexp_replace(b, '\s+\d{{6,}}\s*$', ''), '\s+', ' ', 'g')) FROM ("
        rf"SELECT CASE WHEN regexp_matches(a, '\s+\S{{9,}}\s*$') AND length(regexp_replace(regexp_extract(a, '(\S+)\s*$', 1), '[^0-9]', '', 'g')) >= 3"
        rf" THEN regexp_replace(a, '\s+\S+\s*$', '') ELSE a END AS b FROM (SELECT {s} AS a)))"
    )


def normalize(text: str) -> str:
    noise = "|".join(fixed.DESCRIPTOR_NOISE)
    s = rf"regexp_replace(upper({text}), '\b({noise})\b', ' ', 'g')"
    s = rf"regexp_replace({s}, '\d+', ' ', 'g')"
    s = rf"regexp_replace({s}, '[#*:/\\|-]+', ' ', 'g')"
    return rf"trim(regexp_replace({s}, '\s+', ' ', 'g'))"


def flow_pattern(text: str, amount: str, what: int) -> str:
    arms = []
    for intent, direction, label, pattern in fixed.FLOW_PATTERNS:
        sign = {"in": f"{amount} >= 0 AND ", "out": f"{amount} < 0 AND ", None: ""}[direction]
        arms.append(f"WHEN {sign}regexp_matches({text}, '(?i){pattern}') THEN {lit((intent, label)[what])}")
    return "CASE " + " ".join(arms) + " END"


def card_issuer(text: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({text}, '(?i){p}') THEN '{i}'" for i, p, _ in fixed.CARD_PAYMENT_PATTERNS
    )
    return f"CASE {arms} END"


def card_last4(text: str) -> str:
    arms = " ".join(
        f"WHEN regexp_matches({text}, '(?i){p}') THEN "
        + (f"lpad(regexp_extract({text}, '(?i){p}', 1), 4, '0')" if has else "NULL")
        for _, p, has in fixed.CARD_PAYMENT_PATTERNS
    )
    return f"CASE {arms} END"


def issuer_of_bank(name: str) -> str:
    arms = " ".join(
        f"WHEN lower(trim({name})) IN {in_list([a.lower() for a in names])} THEN '{issuer}'"
        for issuer, names in fixed.ISSUER_BANK_NAMES.items()
    )
    return f"CASE {arms} END"


# name -> (names it needs, SQL)
CTES: dict[str, tuple[list[str], str]] = {
    "t": (
        [],
        f"SELECT {_COLS} FROM (SELECT *, (row_number() OVER (PARTITION BY source_hash, bucket ORDER BY posted_date,"
        f" l_orderkey, l_linenumber, l_partkey, price, l_returnflag, l_suppkey) - 1) * 256 + bucket AS txn_index FROM ({_PURCHASES}))"
        + "".join(
            f" UNION ALL SELECT {_COLS} FROM ({s})"
            for s in (_CARD_PAYMENTS, _BANK_PAYMENTS, _PAYCHECKS, _TRANSFERS, _EVERYDAY)
        ),
    ),
    "t_repeats": (
        ["t"],
        f"SELECT {_COLS} FROM t UNION ALL "
        f"SELECT {_COLS} FROM (SELECT ledger_id, account_type || '-' || bank_name || '-' || account_last_4 || '-' || ledger_id || '-'"
        " || strftime(posted_date + 1, '%Y-%m') AS source_hash, txn_index - 1 AS txn_index, bank_name, account_type,"
        " account_last_4, posted_date + 1 AS posted_date, description, amount_minor, transaction_type, origin_hash,"
        f" origin_index FROM ({_CARD_PAYMENTS}) WHERE (txn_index // 256) % 50 = 0)",
    ),
    "st": (
        ["t"],
        "SELECT ledger_id, source_hash, bank_name, account_type, account_last_4,"
        " CAST(date_trunc('month', min(posted_date)) AS DATE) AS period_start, last_day(min(posted_date)) AS period_end,"
        " ledger_id % 17 AS fault, account_type = 'credit_card' AS card,"
        " CAST(sum(amount_minor) AS BIGINT) AS total, CAST(sum(CASE WHEN amount_minor < 0 THEN -amount_minor ELSE 0 END) AS BIGINT) AS debits,"
        " CAST(sum(CASE WHEN amount_minor > 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS credits, count(*) AS n FROM t GROUP BY ALL",
    ),
    "st2": (
        ["st"],
        "SELECT *, CASE WHEN NOT card AND fault <> 7 THEN CAST(0 AS BIGINT) END AS opening_balance_minor,"
        " CASE WHEN NOT card THEN total + CASE WHEN fault = 3 THEN 1 ELSE 0 END END AS closing_balance_minor,"
        " CASE WHEN NOT card THEN debits END AS total_debits_minor, CASE WHEN NOT card THEN credits END AS total_credits_minor,"
        " CASE WHEN card AND fault <> 7 THEN CAST(0 AS BIGINT) END AS previous_balance_minor,"
        " CASE WHEN card THEN -total + CASE WHEN fault = 3 THEN 1 ELSE 0 END END AS statement_balance_minor,"
        " n + CASE WHEN fault = 9 THEN 1 ELSE 0 END AS printed_transaction_count,"
        " CASE WHEN fault = 11 THEN '' WHEN fault = 5 THEN 'D' WHEN card THEN 'C+D' ELSE 'A+B' END AS provides FROM st",
    ),
    "ann": (
        ["t"],
        "SELECT ledger_id, source_hash, txn_index, category_id, CASE WHEN a % 7 = 0 THEN 'manual' ELSE 'rule' END AS source,"
        " CASE WHEN a % 7 <> 0 AND category_id IS NOT NULL THEN 'rule-' || category_id END AS rule_id,"
        " CASE WHEN m = 8 THEN 'checked' END AS note, CASE m WHEN 6 THEN ['x', 'y'] WHEN 9 THEN ['y'] END AS tags,"
        " m = 0 AS ignored, CASE m WHEN 4 THEN 'Renamed ' || (a % 10) WHEN 10 THEN '' END AS custom_name, m = 11 AS is_recurring,"
        " CASE WHEN linked THEN origin_hash WHEN itself THEN source_hash END AS refund_source_hash,"
        " CASE WHEN linked THEN origin_index WHEN itself THEN txn_index END AS refund_txn_index, m = 1 AS has_split,"
        " CASE WHEN m = 5 THEN 'transfer_self' END AS flow_intent, a, m"
        " FROM (SELECT *, transaction_type = 'refund' AND m IN (2, 3) AS linked, transaction_type = 'refund' AND m = 7 AS itself,"
        f" CASE WHEN a % 5 < 3 THEN {_noun('description')} END AS category_id"
        " FROM (SELECT *, abs(amount_minor) AS a, abs(amount_minor) % 97 AS m FROM t)) WHERE category_id IS NOT NULL OR m <= 11",
    ),
    # rows with their overlay and the category a refund inherits
    "ov": (
        ["t", "ann"],
        "SELECT t.*, ann.source_hash IS NOT NULL AS annotated, ann.category_id AS own_category, coalesce(ann.ignored, false) AS ignored,"
        " ann.custom_name, ann.tags, coalesce(ann.has_split, false) AS has_split, ann.flow_intent AS user_intent, ann.source AS ann_source,"
        " ann.refund_source_hash, ann.refund_txn_index,"
        " CASE WHEN o.source_hash IS NOT NULL AND NOT (o.source_hash = t.source_hash AND o.txn_index = t.txn_index)"
        " THEN o.category_id ELSE ann.category_id END AS category_id"
        " FROM t LEFT JOIN ann USING (ledger_id, source_hash, txn_index)"
        " LEFT JOIN ann o ON o.ledger_id = t.ledger_id AND o.source_hash = ann.refund_source_hash AND o.txn_index = ann.refund_txn_index",
    ),
    # split parts plus remainder, ignored rows dropped; intents are null unless overridden
    "sp": (
        ["ov"],
        "SELECT * REPLACE (CASE part WHEN 1 THEN h WHEN 2 THEN q WHEN 3 THEN amount_minor - h - q ELSE amount_minor END AS amount_minor,"
        " CASE part WHEN 1 THEN 'c-food' WHEN 2 THEN 'c-travel' ELSE category_id END AS category_id),"
        " CASE WHEN part = 2 THEN 'investment_out' END AS part_intent, amount_minor AS whole_minor FROM ("
        " SELECT *, CAST(sign(amount_minor) * (abs(amount_minor) // 2) AS BIGINT) AS h, CAST(sign(amount_minor) * (abs(amount_minor) // 4) AS BIGINT) AS q,"
        " unnest(CASE WHEN has_split THEN [1, 2, 3] ELSE [0] END) AS part FROM ov WHERE NOT ignored)"
        " WHERE part <> 3 OR amount_minor - h - q <> 0",
    ),
    # intent of every row that is not ignored (patterns only)
    "fl": (
        ["ov"],
        "SELECT *, coalesce(user_intent, pattern_intent, CASE WHEN amount_minor < 0 THEN CASE WHEN account_type = 'credit_card'"
        " THEN 'purchase' ELSE 'unknown' END ELSE 'gift_in' END) AS intent FROM (SELECT *, "
        f"CASE WHEN cleaned <> '' THEN {flow_pattern('cleaned', 'amount_minor', 0)} END AS pattern_intent"
        f" FROM (SELECT *, {clean('description')} AS cleaned FROM ov WHERE NOT ignored))",
    ),
    # routed parts: one row per part with its bucket
    "rt": (
        ["sp", "fl"],
        f"SELECT *, CASE WHEN final_intent IN {in_list(schemas.SPEND_INTENTS + schemas.REFUND_INTENTS)} THEN 'spend'"
        f" WHEN final_intent IN {in_list(schemas.INCOME_INTENTS)} THEN 'income' ELSE 'movement' END AS bucket FROM ("
        " SELECT sp.*, fl.intent AS parent_intent, coalesce(sp.part_intent, fl.intent) AS final_intent"
        " FROM sp JOIN fl USING (ledger_id, source_hash, txn_index))",
    ),
    "cash": (
        ["rt"],
        "SELECT ledger_id, strftime(posted_date, '%Y-%m') AS month,"
        " CAST(sum(CASE WHEN bucket = 'income' AND amount_minor > 0 THEN amount_minor ELSE 0 END) AS BIGINT) AS inflow_minor,"
        " CAST(greatest(0, sum(CASE WHEN bucket = 'spend' THEN -amount_minor ELSE 0 END)) AS BIGINT) AS outflow_minor"
        " FROM rt WHERE bucket = 'spend' OR (bucket = 'income' AND amount_minor > 0) GROUP BY ALL",
    ),
}


def ctes(*names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause of the named steps and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered]
    parts += [f"{n} AS MATERIALIZED ({s})" for n, s in (extra or {}).items()]
    return "WITH " + ", ".join(parts) + " "


def over(names, select: str, **extra: str) -> str:
    names = [names] if isinstance(names, str) else names
    return ctes(*names, extra=extra) + select
