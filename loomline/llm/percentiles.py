"""Exact percentiles per group from cumulative frequencies, that can be combined over periods.

1. Reduce: rows become counts of (period, group, value), combined on the map side. These counts are the summary
   that is kept; summaries of separate periods are combined by adding the counts.
2. Sort by range of (group, value): a group with very many values spreads over several partitions.
3. Running sums inside a partition, plus the offset of the partition: what earlier partitions hold of the group.
4. The percentile q of n values is the smallest value whose running sum reaches rank ceil(q * n).
The error bound is 0: the result is an element of the data with exactly that rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import written


def frequencies(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Counts of (group, value); null values and null groups don't count."""
    return rows.where(" and ".join(f"`{c}` is not null" for c in (*group, value))).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def combine(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Add the counts of several periods."""
    return counts.groupBy(group, value).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, group: str, value: str, percents: Sequence[int]) -> DataFrame:
    """(group, n, and p<percent> for each percent) from counts of (group, value), each pair once.

    An empty table gives an empty result.
    """
    spread = counts.select(F.col(group).alias("__g"), F.col(value).alias("__v"), F.col("n").alias("__n")).repartitionByRange("__g", "__v")
    placed = written(spread.select("*", F.spark_partition_id().alias("__part")), "sorted-counts")
    per_part = placed.groupBy("__g", "__part").agg(F.sum("__n").alias("__held"))
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__g")
    offsets = per_part.select("__g", "__part", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__offset"), F.sum("__held").over(whole).alias("__total"))
    inside = Window.partitionBy("__g", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.select("__g", "__part", "__v", F.sum("__n").over(inside).alias("__upto"))
    reach = running.join(offsets, ["__g", "__part"]).select("__g", "__v", "__total", (F.col("__offset") + F.col("__upto")).alias("__reach"))
    rank = lambda p: F.expr(f"(__total * {int(p)} + 99) div 100")
    found = reach.groupBy("__g").agg(F.max("__total").alias("n"), *[F.min(F.when(F.col("__reach") >= rank(p), F.col("__v"))).alias(f"p{p}") for p in percents])
    return found.withColumnRenamed("__g", group)
