"""What the lines of pages shuffle."""

import re

from tallyspark.operators import layout
from tallyspark.plans import jobs as plans

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_page_are_dealt_out_once(spark):
    texts = layout.column_texts(layout.assign_lines(plans.text_items(spark, DATA)), [("left", 0.0, 170.0)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(texts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(dealt) == 3, plan  # words once, heights once to be counted and once by page
    assert sum("y#" not in keys for keys in dealt) == 2
