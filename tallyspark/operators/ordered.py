"""Ordered computations over groups of any size.

A window over a whole group runs in one task. Here the rows are range-partitioned by
(keys, order) instead, so that a large group spreads over many partitions ("blocks"), each
block is computed on its own, and a small carry table brings in what came before or after.
A block boundary cuts at most one group, so the carry table has fewer rows than there are
blocks; that is the bound which makes broadcasting it safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import durable

BLOCK = "block_no"


def ordered_blocks(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Range-partition by (keys, order) and tag every row with its block.

    The result is written to the checkpoint folder: block numbers come from sampled range
    bounds, so they have to be fixed before anything is computed from them.
    """
    return durable(df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id()))


def numbered_blocks(df: DataFrame, keys: list[str], order: list[Column | str], keep: list[str]) -> DataFrame:
    """Blocks that hold keys, the columns to keep and `order_no`, which stands for the order: its columns need not go on.

    order has to be total; the numbers rise within a block.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return durable(ranged.select(
        *dict.fromkeys([*keys, *keep]), F.spark_partition_id().alias(BLOCK), F.monotonically_increasing_id().alias("order_no")))


def within(keys: list[str], order: list[Column | str]):
    """Window over one group's rows inside one block."""
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def earlier_blocks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def later_blocks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(1, Window.unboundedFollowing)


def attach(blocked: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Left join the carry table; groups inside one block have no carry row.

    Carry rows are kept only for groups that continue over a block boundary: at most one
    per block, whatever the size of the data.
    """
    return blocked.join(F.broadcast(carry), [*keys, BLOCK], "left")


def positions(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """0-based position of every row within its group."""
    blocked = ordered_blocks(df, keys, order)
    carry = (
        blocked.groupBy(*keys, BLOCK).agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(earlier_blocks(keys)))
        .filter(F.col("before").isNotNull())
        .drop("n")
    )
    local = F.row_number().over(within(keys, order)).cast("bigint") - 1
    return (
        attach(blocked.withColumn(name, local), carry, keys)
        .withColumn(name, F.col(name) + F.coalesce("before", F.lit(0)))
        .drop("before", BLOCK)
    )


def middle_values(rows: DataFrame, keys: list[str], value: Column | str, weight: Column | str) -> DataFrame:
    """The two middle values of each key, `low` and `high` (equal for odd totals), with weights counted exactly.

    Equal values of a key are one cell with their weight; cells are ordered in blocks, and cumulative weights say
    which cells hold the middle ranks. No key's values are gathered anywhere. Null values and weights below 1 do not count.
    """
    value, weight = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    cells = rows.select(*keys, value.alias("value"), weight.alias("weight")).filter(
        F.col("value").isNotNull() & (F.col("weight") > 0)
    ).groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    blocked = ordered_blocks(cells, keys, ["value"])
    parts = blocked.groupBy(*keys, BLOCK).agg(F.sum("weight").alias("part"))
    carry = parts.withColumns({
        "before": F.coalesce(F.sum("part").over(earlier_blocks(keys)), F.lit(0)),
        "whole": F.sum("part").over(Window.partitionBy(*keys)),
    }).filter(F.col("part") != F.col("whole")).drop("part")
    ranked = attach(blocked.withColumns({
        "last": F.sum("weight").over(within(keys, ["value"])), "own": F.sum("weight").over(Window.partitionBy(*keys, BLOCK)),
    }), carry, keys).withColumns({
        "last": F.col("last") + F.coalesce("before", F.lit(0)), "total": F.coalesce("whole", "own"),
    })
    holds = lambda rank: F.expr(f"last - weight < {rank} AND {rank} <= last")
    low, high = holds("(total + 1) div 2"), holds("total div 2 + 1")
    return ranked.filter(low | high).groupBy(*keys).agg(
        F.max(F.when(low, F.col("value"))).alias("low"), F.max(F.when(high, F.col("value"))).alias("high")
    )
