"""Middle values, window starts and transfer pairs across blocks, against plain Python."""

import datetime
import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from tallyspark.operators import cadence, ordered


def test_middle_values(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, *range(-9, 40)]), rng.choice([0, 1, 1, 2, 7])) for _ in range(900)]
    rows += [("one", 5, 1), ("two", 1, 1), ("two", 2, 1), ("half", 1, 3), ("half", 9, 3), ("none", None, 2), ("zero", 4, 0)]
    want = defaultdict(list)
    for k, v, n in rows:
        if v is not None:
            want[k] += [v] * n
    df = spark.createDataFrame(rows, "k string, v long, n long").repartition(5)
    got = {r.k: (r.low, r.high) for r in ordered.middle_values(df, ["k"], "v", "n").collect()}
    assert got == {k: (statistics.median_low(v), statistics.median_high(v)) for k, v in want.items() if v}
    assert ordered.middle_values(df.limit(0), ["k"], "v", "n").count() == 0


def test_one_key_of_a_million_values(spark):
    df = spark.range(1_000_001, numPartitions=8).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 1_000_003).alias("v"), F.lit(1).alias("n"))
    values = sorted(i * 7919 % 1_000_003 for i in range(1_000_001))
    (row,) = ordered.middle_values(df, ["k"], "v", "n").collect()
    assert (row.low, row.high) == (values[500_000],) * 2


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_rows_and_sums_of_windows(spark):
    rng = random.Random(6)
    windows, rows = [], []
    for ledger in range(6):
        starts = sorted(rng.choices(range(0, 300), k=rng.randint(1, 12)))
        for i, s in enumerate(starts):
            nxt = starts[i + 1] if i + 1 < len(starts) else None
            windows.append((ledger, i, day(s), None if nxt is None else day(max(nxt - 1, s)), 1000))
        for j in range(80):
            rows.append((ledger, f"s{j}", j, day(rng.randint(-40, 400)), rng.randint(-90, 30)))
    rows.append((99, "x", 0, day(3), -5))  # a ledger without windows
    rows.append((0, "far", 0, datetime.date(9998, 12, 31), -7))  # an open window costs nothing
    w = spark.createDataFrame(windows, "ledger_id long, window_no long, start_date date, end_date date, income_minor long").repartition(3)
    r = spark.createDataFrame(rows, "ledger_id long, source_hash string, txn_index long, posted_date date, amount_minor long").repartition(3)
    inside = [(a, b) for a in windows for b in rows if a[0] == b[0] and a[2] <= b[3] and (a[3] is None or b[3] <= a[3])]
    got = cadence.rows_in_windows(w, r).select("ledger_id", "window_no", "source_hash", "txn_index").collect()
    assert sorted(map(tuple, got)) == sorted((a[0], a[1], b[1], b[2]) for a, b in inside)
    spent = defaultdict(int)
    for a, b in inside:
        spent[a[0], a[1]] += max(-b[4], 0)
    got = cadence.window_summary(w, r).collect()
    assert len(got) == len(windows)
    for x in got:
        assert (x.spending_minor, x.remaining_minor) == (spent[x.ledger_id, x.window_no], 1000 - spent[x.ledger_id, x.window_no])
