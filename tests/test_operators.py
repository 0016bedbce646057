import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import cadence, cashflow, flow, labels, layout, merge, quality
from tallyspark.sources import backup, csv, state

ANNOTATIONS = (
    "ledger_id bigint, source_hash string, txn_index bigint, category_id string, source string, rule_id string, note string,"
    " tags array<string>, ignored boolean, custom_name string, is_recurring boolean, refund_source_hash string, refund_txn_index bigint,"
    " split array<struct<category_id:string,amount_minor:bigint,flow_intent:string>>, flow_intent string"
)


def annotate(spark, *rows):
    full = []
    for source_hash, index, values in rows:
        row = dict.fromkeys(
            ["category_id", "rule_id", "note", "tags", "custom_name", "refund_source_hash", "refund_txn_index", "split", "flow_intent"]
        ) | {"ledger_id": 1, "source_hash": source_hash, "txn_index": index, "source": "manual", "ignored": False, "is_recurring": False}
        row |= values
        full.append(tuple(row[f.split()[0]] for f in ANNOTATIONS.replace("bigint,flow", "bigint;flow").replace("string,amount", "string;amount").split(", ")))
    return spark.createDataFrame(full, ANNOTATIONS)


def test_splits_conserve_and_refunds_follow_their_original(spark, ledger):
    rows = ledger([
        ("a", 0, "2024-01-05", "shoes", -1000, "purchase"), ("a", 1, "2024-01-09", "shoes back", 400, "refund"),
        ("a", 2, "2024-01-10", "ignored", -77, "purchase"), ("a", 3, "2024-01-11", "odd", 5, "refund"),
    ])
    edits = annotate(
        spark,
        ("a", 0, {"category_id": "c1", "split": [("food", -300, None), ("fun", -200, "transfer_self")]}),
        ("a", 1, {"category_id": "c9", "refund_source_hash": "a", "refund_txn_index": 0}),
        ("a", 2, {"ignored": True}),
        ("a", 3, {"category_id": "c5", "refund_source_hash": "a", "refund_txn_index": 3}),
    )
    parts = flow.split_rows(flow.resolved_overlay(rows, edits)).collect()
    assert sorted((p.txn_index, p.part_category, p.amount_minor) for p in parts) == [
        (0, "c1", -500), (0, "food", -300), (0, "fun", -200), (1, "c1", 400), (3, "c5", 5),
    ]
    routed = flow.routed_parts(flow.infer_flow(flow.resolved_overlay(rows, edits)))
    assert {(r.txn_index, r.part_category): r.bucket for r in routed.collect()}[(0, "fun")] == "movement"


def test_flow_order_of_evidence(spark, ledger):
    rows = ledger([
        ("b", 0, "2024-01-05", "NETFLIX", -10, "other"), ("b", 1, "2024-01-05", "PAYROLL", 10, "deposit"),
        ("b", 2, "2024-01-05", "??", -10, "other"), ("b", 3, "2024-01-05", "??", 10, "other"),
    ], account="checking")
    overlaid = flow.resolved_overlay(rows, annotate(spark, ("b", 0, {"flow_intent": "fees"})))
    keys = lambda *i: rows.filter(F.col("txn_index").isin(*i))
    plain = {r.txn_index: r.flow_intent for r in flow.infer_flow(overlaid).collect()}
    assert plain == {0: "fees", 1: "salary", 2: "unknown", 3: "gift_in"}
    sharp = flow.infer_flow(overlaid, keys(0, 1), keys(2), keys(3))
    assert {r.txn_index: r.flow_intent for r in sharp.collect()} == {0: "fees", 1: "cc_payment", 2: "transfer_self", 3: "salary"}


def test_month_budget_rounds_half_up_and_paces(spark):
    flows = spark.createDataFrame([(1, "2024-02", 1000, 85), (1, "2024-03", 1000, 1085), (1, "2024-01", 0, 5)],
                                  "ledger_id bigint, month string, inflow_minor bigint, outflow_minor bigint")
    got = {r.month: r for r in cashflow.month_budget(flows, "2024-02-10").collect()}
    assert (got["2024-02"].pct_spent, got["2024-02"].days_left, got["2024-02"].daily_pace_minor) == (9, 19, 8)
    assert (got["2024-03"].pct_left, got["2024-03"].days_left, got["2024-03"].daily_pace_minor) == (-8, 31, 0)
    assert got["2024-01"].pct_spent == 0 and not got["2024-01"].over_pace


def test_recurring_and_paychecks(ledger):
    day = lambda i, step: (datetime.date(2024, 1, 5) + datetime.timedelta(days=i * step)).isoformat()
    rows = ledger(
        [("s", i, day(i, 14), f"ACME PAYROLL {i}", 200000 + i, "deposit") for i in range(5)]
        + [("s", 10 + i, day(i, 30), "GYM", -5000, "other") for i in range(4)]
        + [("s", 20 + i, day(i, 30), "SHOP", -100 * (i + 1), "other") for i in range(4)]
        + [("s", 30 + i, day(0, 1), "SAME DAY", -1, "other") for i in range(4)],
        account="checking",
    )
    found = {r.stream_key: r for r in cadence.recurring(rows).collect()}
    assert (found["ACME PAYROLL"].cadence, found["ACME PAYROLL"].direction) == ("biweekly", "inflow")
    assert (found["GYM"].cadence, str(found["GYM"].next_due)) == ("monthly", "2024-05-04")
    assert found["SHOP"].cadence == "irregular" and "SAME DAY" not in found
    checks = cadence.label_deposits(rows).filter("is_paycheck")
    assert {r.confidence for r in checks.collect()} == {"high"}
    windows = cadence.budget_windows(checks, cadence.default_anchor(checks)).orderBy("window_no").collect()
    assert [(w.budget_month, w.complete, str(w.end_date)) for w in windows] == [
        ("2024-01", True, "2024-02-01"), ("2024-02", True, "2024-02-29"), ("2024-03", False, "None"),
    ]


def test_gate_golden_checking_statement(spark, ledger):
    amounts = [50000, 300000, -100000, -20000, -30000, 5000, -250050, -50]
    rows = ledger([("h", i, "2024-01-05", "x", a, "other") for i, a in enumerate(amounts)], account="checking")

    def verdict(**changes):
        header = {"opening": 500000, "closing": 454900, "debits": 400100, "credits": 355000, "n": 8, "levels": ["A", "B"]} | changes
        df = spark.createDataFrame([(1, "h", header["opening"], header["closing"], header["debits"], header["credits"], None, None, header["n"], header["levels"])],
            "ledger_id bigint, source_hash string, opening_balance_minor bigint, closing_balance_minor bigint, total_debits_minor bigint, total_credits_minor bigint,"
            " previous_balance_minor bigint, statement_balance_minor bigint, printed_transaction_count bigint, parser_provides array<string>")
        return quality.checksum_gate(df, rows).first()

    assert verdict()["ok"] and verdict()["strategy_used"] == "A+B"
    assert "A fails: printed $4,548.99, rows give $4,549.00, apart $0.01" in verdict(closing=454899)["reason"]
    assert "debits printed $4,001.01" in verdict(debits=400101)["reason"]
    assert "a count alone" in verdict(levels=["D"])["reason"]
    assert "no level declared" in verdict(levels=[])["reason"]
    assert "C lacks" in verdict(levels=["A", "C"])["reason"]
    assert "D fails: printed 9, rows 8" in verdict(levels=["A", "D"], n=9)["reason"]


def test_merge_is_idempotent(ledger):
    left = ledger([("a", 0, "2024-01-01", "x", 1, "other"), ("b", 0, "2024-01-01", "x", 2, "other")])
    right = ledger([("b", 0, "2024-01-01", "x", 9, "other"), ("c", 0, "2024-01-01", "x", 3, "other")])
    once = merge.merge_rows(left, right)
    assert sorted(r.amount_minor for r in once.collect()) == [1, 2, 3]
    assert sorted(merge.merge_rows(once, right).collect()) == sorted(once.collect())


RULES = [labels.Rule(0, "r0", "COFFEE", None, False, "c-cafe"), labels.Rule(1, "r1", None, "([", False, "c-bad"), labels.Rule(2, "r2", "", "", False, "c-none")]
CATS = [labels.Category("c-cafe", "Cafe"), labels.Category("c-food", "Food"), labels.Category("c-ice", "Ice cream", "c-food")]


def test_rules_respect_manual_and_extras(spark, ledger):
    rows = ledger([("a", i, "2024-01-01", t, -1, "purchase") for i, t in enumerate(["coffee", "coffee", "tea", "tea"])])
    before = annotate(spark, ("a", 0, {"category_id": "mine"}), ("a", 2, {"category_id": "old", "source": "rule", "note": "n"}),
                      ("a", 3, {"category_id": "old", "source": "rule"}), ("z", 0, {"category_id": "old", "source": "rule"}))
    got = {(r.source_hash, r.txn_index): (r.category_id, r.source) for r in labels.apply_rules(rows, before, RULES).collect()}
    assert got == {("a", 0): ("mine", "manual"), ("a", 1): ("c-cafe", "rule"), ("a", 2): (None, "manual")}


def test_guess_tiers(spark):
    texts = ["ice cream at home", "my coffee", "the food court", "biryani!", "$pizza", "pizza$", "xyz", " "]
    df = spark.createDataFrame([(t,) for t in texts], "description string")
    got = {r.description: r.guess for r in labels.guess_category(df, CATS, RULES).collect()}
    assert got == {"ice cream at home": "c-ice", "my coffee": "c-cafe", "the food court": "c-food", "biryani!": "c-food",
                   "$pizza": "c-food", "pizza$": None, "xyz": None, " ": None}


def test_rule_pattern(spark):
    df = spark.createDataFrame([("I ate at the Place on",), ("at for",), ("we",), ("Paid rent for",)], "t string")
    got = [r.p for r in df.select(labels.rule_pattern(F.col("t")).alias("p")).collect()]
    assert got == ["the place", None, None, "rent"]


def test_link_accounts(spark):
    accounts = spark.createDataFrame([(1, "Chase Bank 1797", 0), (1, "C++ Card", 1), (1, "Amex Gold", 2)], "ledger_id bigint, account string, account_ord int")
    rows = spark.createDataFrame([(1, t) for t in ["Biryani Chase Bank 1797", "via gold today", "use C++ card now", "bank card", "golden"]], "ledger_id bigint, description string")
    got = {r.text: (r.account, r.rest) for r in labels.link_accounts(rows, accounts).collect()}
    assert got == {"Biryani Chase Bank 1797": ("Chase Bank 1797", "Biryani"), "via gold today": ("Amex Gold", "via today"), "use C++ card now": ("C++ Card", "use now")}


def model_lines(ys, tolerance=3.0):
    lines, current, total, count = [], [], 0.0, 0
    for y in sorted(ys, reverse=True):
        if count and abs(y - total / count) > tolerance:
            lines.append(current)
            current, total, count = [], 0.0, 0
        current.append(y)
        total, count = total + y, count + 1
    return lines + [current]


@pytest.mark.parametrize("ys", [[100, 98, 96, 94, 92, 90], [10, 10, 7, 7, 7, 4, 1, 1], [50, 47.5, 45, 44.5, 30]])
def test_layout_follows_the_running_mean(spark, ys):
    items = spark.createDataFrame([(1, 0, 5.0, float(y), i, "w") for i, y in enumerate(ys)], "doc_id bigint, page int, x double, y double, item_no bigint, text string")
    got = {}
    for r in layout.assign_lines(items).collect():
        got.setdefault(r.line_no, []).append(r.y)
    assert [sorted(v, reverse=True) for _, v in sorted(got.items())] == [[float(y) for y in line] for line in model_lines(ys)]


def test_csv_round_trip_and_errors(spark, tmp_path):
    text = 'date,description,amount,currency,account,category\r\n2024-01-05,"a ""b"", c",-1.00,USD,x,\r\n\r\n2024-01-06,"two\nlines",2.00,USD,x,y\r\n'
    (tmp_path / "in.csv").write_bytes(text.encode())
    rows = csv.read_csv(spark, str(tmp_path / "in.csv"), csv.EXPORT_COLUMNS)
    assert [r.description for r in rows.orderBy("date").collect()] == ['a "b", c', "two\nlines"]
    (tmp_path / "bad.csv").write_text('date,description,amount,currency,account,category\n2024-01-05,"open,1\n')
    with pytest.raises(Exception):
        csv.read_csv(spark, str(tmp_path / "bad.csv"), csv.EXPORT_COLUMNS).collect()
    faulty = csv.parse_rows(rows.withColumn("amount", F.lit("x")))
    with pytest.raises(ValueError, match="2 faulty rows|1 faulty row"):
        csv.require_clean(faulty, str(tmp_path / "faulty"))
    with pytest.raises(ValueError, match="nothing that holds amounts|no date"):
        csv.check_headers(["date", "amount"])


def test_state_and_backup_refuse_newer_or_partial(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"version": 9, "ledger_id": 1}\n')
    with pytest.raises(ValueError, match="newer"):
        state.read_state(spark, str(tmp_path / "s.json"))
    tables = {"transactions": spark.range(3).toDF("amount_minor"), "annotations": spark.range(1), "statements": spark.range(2)}
    path = str(tmp_path / "b")
    backup.write_backup(spark, path, tables, "now")
    restored = backup.read_backup(spark, path, {})
    assert restored["goals"].isEmpty() and restored["links"].isEmpty() and restored["transactions"].count() == 3
    spark.range(2).toDF("amount_minor").write.mode("overwrite").parquet(f"{path}/transactions")
    with pytest.raises(ValueError, match="2 of 3 rows"):
        backup.read_backup(spark, path, {})
    backup.write_backup(spark, path, {"transactions": spark.range(3), "annotations": spark.range(1)}, "now")
    with pytest.raises(ValueError, match="statements"):
        backup.read_backup(spark, path, {})


GOOD_SECTIONS = {
    "transactions": "1L AS ledger_id, 'h' AS source_hash, 0L AS txn_index, 5L AS amount_minor, date'2024-01-01' AS posted_date, 'USD' AS currency, 'deposit' AS transaction_type",
    "statements": "1L AS ledger_id, 'h' AS source_hash, 'B' AS bank_name, 'checking' AS account_type, 'USD' AS currency",
    "annotations": "1L AS ledger_id, 'h' AS source_hash, 0L AS txn_index",
    "links": "1L AS ledger_id, 'h' AS bank_source_hash, 0L AS bank_txn_index, 'c' AS cc_source_hash, 0L AS cc_txn_index",
    "categories": "1L AS ledger_id, 'c-a' AS category_id, 'A' AS name, string(null) AS parent_id",
    "rules": "1L AS ledger_id, 0 AS rule_no, 'r' AS rule_id, 'c-a' AS category_id, true AS enabled",
    "limits": "1L AS ledger_id, 'c-a' AS category_id, 5L AS limit_minor",
    "goals": "1L AS ledger_id, 'g' AS id, 'G' AS name, 5L AS target_minor, 0L AS saved_minor, string(null) AS deadline",
}
FAULTS = {
    "transactions": ("currency", "'usd'"), "statements": ("bank_name", "' '"), "annotations": ("source_hash", "string(null)"),
    "links": ("cc_txn_index", "bigint(null)"), "categories": ("parent_id", "'c-a'"), "rules": ("rule_id", "''"),
    "limits": ("limit_minor", "-1L"), "goals": ("id", "''"),
}


def test_backup_refuses_a_fault_in_any_section(spark, tmp_path):
    path = str(tmp_path / "b")
    tables = {name: spark.sql(f"SELECT {columns}") for name, columns in GOOD_SECTIONS.items()}
    backup.write_backup(spark, path, tables, "now")
    assert {n: t.count() for n, t in backup.read_backup(spark, path, backup.contracts()).items()} == dict.fromkeys(tables, 1)
    for name, (column, value) in FAULTS.items():
        tables[name].withColumn(column, F.expr(value)).write.mode("overwrite").parquet(f"{path}/{name}")
        with pytest.raises(ValueError, match=f"1 rows of {name} break"):
            backup.read_backup(spark, path, backup.contracts())
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def test_recurring_reads_the_rows_once(spark, ledger):
    rows = ledger([("s", i, f"2024-{1 + i // 2:02d}-{5 + i % 2:02d}", f"GYM {i} CLUB" if i % 2 else f"CAFE {'ABCDEFGHIJ'[i // 2]}", -1000 - i % 3, "purchase")
                   for i in range(20)])
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    (found,) = cadence.recurring(rows.mapInArrow(counted, rows.schema)).collect()
    assert (found.stream_key, found.occurrences, found.cadence, found.display_name) == ("GYM CLUB", 10, "monthly", "GYM 19 CLUB")
    assert seen.value == 20
