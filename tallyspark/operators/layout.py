"""Lines of text from positioned items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]


def assign_lines(items: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Adds line_no (top to bottom within a page) and line_y to every item.

    An item joins the current line while its height differs from the line's running mean by
    at most `tolerance`. Items of equal height always share a line and a step larger than
    the tolerance always starts one, so only the distinct heights between two such steps are
    folded in order; the fold runs inside Spark on (height, count) pairs.
    """
    # pages are dealt out once; Spark would deal them out anew for a join by page and height without this
    items.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    heights = items.groupBy(*PAGE, "y").agg(F.count("*").alias("n"))
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y"))
    step = F.coalesce(F.lag("y").over(down) - F.col("y") > tolerance, F.lit(False))
    bands = heights.withColumn("step", step.cast("int")).withColumn("band", F.sum("step").over(down))
    folded = bands.groupBy(*PAGE, "band").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("neg"), "n"))).alias("ys")
    )
    start = F.struct(
        F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("count"), F.lit(0).alias("line"),
        F.array().cast("array<struct<y:double,n:bigint,line:int>>").alias("out"),
    )

    def add(state, item):
        y = -item["neg"]
        first = state["count"] == 0
        joins = first | (F.abs(y - state["total"] / F.greatest(state["count"], F.lit(1))) <= tolerance)
        line = F.when(joins, state["line"]).otherwise(state["line"] + 1)
        return F.struct(
            F.when(joins, state["total"] + y * item["n"]).otherwise(y * item["n"]).alias("total"),
            F.when(joins, state["count"] + item["n"]).otherwise(item["n"]).alias("count"),
            line.alias("line"),
            F.concat(state["out"], F.array(F.struct(y.alias("y"), item["n"].alias("n"), line.alias("line")))).alias("out"),
        )

    lines = folded.select(*PAGE, "band", F.inline(F.aggregate("ys", start, add)["out"]))
    # bands run downwards and lines run downwards within a band
    line = Window.partitionBy(*PAGE, "band", "line")
    placed = lines.select(
        *PAGE, "y", (F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("band", "line")) - 1).alias("line_no"),
        (F.sum(F.col("y") * F.col("n")).over(line) / F.sum("n").over(line)).alias("line_y"),
    )
    return items.repartition(*PAGE).join(placed, [*PAGE, "y"])


def _joined(items):
    """Texts by x, then item order, as one line with single blanks."""
    words = F.transform(F.sort_array(F.collect_list(items)), lambda w: w["text"])
    return F.trim(F.regexp_replace(F.array_join(words, " "), r"\s+", " "))


def line_texts(placed: DataFrame) -> DataFrame:
    return placed.groupBy(*PAGE, "line_no", "line_y").agg(
        F.count("*").alias("items"), _joined(F.struct("x", "item_no", "text")).alias("text")
    )


def column_texts(placed: DataFrame, columns: list[tuple[str, float, float]]) -> DataFrame:
    """Text per column of every line; an item belongs to the first column whose range holds x."""
    which = reduce(
        lambda acc, c: F.when((F.col("x") >= c[1]) & (F.col("x") < c[2]), F.lit(c[0])).otherwise(acc),
        reversed(columns), F.lit(None).cast("string"),
    )
    return placed.withColumn("column", which).groupBy(*PAGE, "line_no").agg(*[
        F.coalesce(_joined(F.when(F.col("column") == name, F.struct("x", "item_no", "text"))), F.lit("")).alias(name)
        for name, _, _ in columns
    ])


def header_line(lines: DataFrame, pattern: str) -> DataFrame:
    """First line of every page that matches the pattern, -1 if there is none."""
    hit = F.when(F.col("text").rlike(pattern), F.col("line_no"))
    return lines.groupBy(*PAGE).agg(F.coalesce(F.min(hit), F.lit(-1)).alias("header_line"))
