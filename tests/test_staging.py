"""What the derived ledger costs to store."""

import re

from pyspark.sql import functions as F

from tallyspark.plans import fixtures as fx
from tallyspark.plans import jobs
from tallyspark.sources import state

DATA = "/root/testdata/sf0.001"


def test_no_text_is_shuffled_and_the_numbering_shares_the_ranges(spark):
    plan = fx.card_purchases(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"rangepartitioning", plan)) == 1 and "hashpartitioning(source_hash" not in plan
    above = plan[:plan.index("rangepartitioning")]
    assert "hashpartitioning" not in above
    for family in (fx.card_payments, fx.bank_payments, fx.transfers, fx.everyday):
        plan = family(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "PAYMENT" not in plan[plan.index("rangepartitioning"):]


def test_raw_text_is_stored_once(spark):
    rows = fx.ledger(spark, DATA)
    assert rows.columns == fx.COLUMNS
    assert rows.filter(~F.col("raw_text").eqNullSafe(F.col("description"))).count() == 0


def test_landed_state_is_compressed(spark, tmp_path):
    rows = fx.ledger(spark, DATA).limit(50)
    state.write_state(fx.nested_imports(rows), str(tmp_path / "state"))
    files = [f.name for f in (tmp_path / "state").glob("part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert state.state_rows(state.read_state(spark, str(tmp_path / "state"))).count() == 50


def test_headers_group_by_account_and_month(spark):
    rows = fx.ledger(spark, DATA)
    plan = fx.statements(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(ledger_id" in plan
    assert not any("source_hash" in line for line in plan.splitlines() if "hashpartitioning" in line)
    named = rows.groupBy("ledger_id", "source_hash", "bank_name", "account_type", "account_last_4").agg(
        F.count("*").alias("n"), F.min("posted_date").alias("day"))
    made = fx.statements(rows).join(named, ["ledger_id", "source_hash", "bank_name", "account_type", "account_last_4"])
    assert made.filter("period_start = trunc(day, 'month') AND printed_transaction_count - n IN (0, 1)").count() == named.count()
    assert fx.statements(rows).count() == named.count()


def test_backup_and_arrivals_are_zstd(spark):
    backed, arrived = (jobs._backup_path(spark, DATA), jobs._arrivals(spark, DATA))
    for folder in (f"{backed}/transactions", f"{backed}/statements", arrived):
        files = spark.read.parquet(folder).inputFiles()
        assert files and all(f.endswith(".zstd.parquet") for f in files)
