"""A sample of registered queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
SAMPLE = [
    "agg_spendable_month", "agg_mom", "win_fifo", "jn_reconcile", "win_recurring", "agg_window_summary",
    "dq_gate", "cat_apply", "set_merge_state", "src_csv_read", "redact_text", "strm_ingest",
    "ing_outcomes", "jn_transfers", "jn_transfer_open", "src_csv_import", "src_restore", "dq_checksum_a", "dq_checksum_b",
    "dq_checksum_c", "dq_checksum_d", "redact_report", "sink_backup", "flow_infer_detectors",
    "cat_nb_predict", "cat_auto", "set_delete_tree_list", "set_delete_tree_rules", "set_delete_tree_limits",
    "set_delete_tree_annotations", "src_files", "src_files_new", "cat_rename", "jn_ambiguous", "jn_window_range", "win_biweekly_flag",
]


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    if not DATA.exists():
        pytest.skip("test tables are not here")
    assert entry.entry(spark).columns == ["ledger_id", "month", "inflow_minor", "outflow_minor", "net_minor"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    result = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(result.fetchall(), names)


def test_bayes_deals_rows_out_by_ledger_alone(spark, duck):
    found = entry.QUERIES["cat_nb_predict"](spark, str(DATA))
    assert found.count() > 0
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [line for line in final.splitlines() if "hashpartitioning" in line]
    assert dealt and not any("token#" in line or "category_id#" in line for line in dealt)


def test_mined_patterns_are_worked_out_once(spark, duck):
    plan = entry.QUERIES["cat_rule_dedup"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|drinking|") == 1  # a word of the first pattern


@pytest.mark.parametrize("name", ["agg_income_rows", "win_cap_income"])
def test_intents_are_worked_out_once_and_without_refund_links(spark, duck, name):
    plan = entry.QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("KITSAP") == 1  # a word of the flow patterns
    assert plan.count("Web ID") <= 2  # a word of the cleaning, which the income rows show as well
    assert "refund_source_hash" not in plan.split("Relation")[0] and plan.count("LeftOuter") == 1


@pytest.mark.parametrize("name", ["agg_income_rows", "win_cap_income", "agg_stacked_grid"])
def test_flow_query_equals_sql(spark, duck, name):
    test_query_equals_sql(spark, duck, name)


def test_rows_of_windows_are_worked_out_once(spark, duck):
    plan = entry.QUERIES["jn_window_range"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("KITSAP") == 0  # days and rows come from the stored keys


def test_grid_reads_the_parts_once(spark, duck):
    plan = entry.QUERIES["agg_stacked_grid"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("KITSAP") <= 1 and plan.count("LogicalRDD") == 2  # both uses read the stored cells
