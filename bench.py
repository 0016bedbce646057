"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then $BENCH_RUNS times (default 1); the median counts.
Results go to the noop sink, so every row is computed and none is collected.
`stage` is the time to derive the ledger tables once.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tallyspark.plans import catalog
from tallyspark.plans import fixtures as fx
from tallyspark.session import configure

HEADLINE = [
    "agg_spendable_month", "agg_cash_flow", "agg_net_month", "agg_spend_category_month", "agg_flow_projection",
    "agg_income_rows", "agg_month_budget", "agg_budget", "agg_mom", "agg_merchant_trends", "top_largest",
    "flow_infer", "flow_pattern", "win_splits", "jn_overlay", "jn_refund_category",
    "win_card_stream", "win_fifo", "win_unpaid", "jn_reconcile", "jn_drill", "jn_transfers",
    "win_recurring", "win_paychecks", "win_budget_windows", "agg_window_summary",
    "dq_gate", "dq_contract", "ing_upsert", "ing_dedup_rows", "set_merge_state",
    "cat_first_rule", "cat_apply", "cat_guess", "cat_nb_train", "cat_nb_predict", "acct_link",
    "flt_unified", "srt_unified", "fn_clean_desc", "redact_text", "ing_layout_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    for table in (fx.ledger, fx.edits, fx.headers):
        table(spark, sf_dir)
    stage = time.perf_counter() - start
    times: dict[str, float] = {}
    for name in names:
        spent = []
        for turn in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if turn:
                spent.append(time.perf_counter() - start)
        times[name] = round(statistics.median(spent), 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
        "stage": round(stage, 3), "cpus": cpus, "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
