"""Top N items within every group, with a safe threshold from per-group score histograms.

1. One pass finds the range of scores and the number of rows of each group, a table of one row per group.
2. Rows and ranges are brought together by group; a group with more than 1/parts of all rows is split into parts in
   proportion to its count, by the hash of the item. A histogram over `bins` equal parts of the group's own range is
   aggregated on the map side. A cell holds bitmaps of hashed items; the number of their bits never exceeds the number
   of different items in the cell, so repeated rows can't raise it. From the top down, the first cell at which the
   sum reaches N gives a lower threshold with at least N different items at or above it.
3. Rows below their group's threshold go, by the same partitioning. The rest, N and a cell's content at least for a
   group, loses its repeated rows and is ranked exactly with the tie keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.skew import PARTS, copied, salted
from loomline.session import written


def ranges(rows: DataFrame) -> DataFrame:
    """(__g, __low, __high, __n): the range of scores of each group, and its rows."""
    return rows.groupBy("__g").agg(F.min("__s").cast("double").alias("__low"), F.max("__s").cast("double").alias("__high"), F.count(F.lit(1)).alias("__n"))


def candidates(rows: DataFrame, item: list[str], n: int, bins: int, parts: int) -> DataFrame:
    """The different rows at or above the threshold of their group, at least n of each group that has as many.

    rows: __g, __s (long) and the columns of item, without nulls.
    """
    known = written(ranges(rows), "ranges")
    total = max(1, known.agg(F.sum("__n")).first()[0] or 0)
    many = F.least(F.ceil(F.col("__n") * F.lit(parts) / F.lit(total)), F.col("__n")).cast("int")
    hot = known.where(F.col("__n") > max(1, total // parts)).select("__g", many.alias("__salts"))  # fewer than `parts` groups
    placed = salted(rows, hot, ["__g"], item, parts)
    # in doubles, which can't overflow and keep the order of scores: a cell is never above that of a higher score
    cell = F.when(F.col("__high") > F.col("__low"), F.floor((F.col("__s").cast("double") - F.col("__low")) * bins / (F.col("__high") - F.col("__low")))).otherwise(F.lit(0)).cast("int")
    sign = F.xxhash64(F.lit(1), *item)
    words = max(1, -(-n // 16))  # enough bits for n items in one cell
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(sign, F.lit(64)).cast("int"))
    cells = (
        placed.join(copied(known, hot, ["__g"]), ["__g", "__salt"])
        .groupBy("__g", cell.alias("__cell"), F.pmod(F.shiftright(sign, 6), F.lit(words)).alias("__word"))
        .agg(F.bit_or(bit).alias("__bits"))
        .groupBy("__g", "__cell")
        .agg(F.sum(F.bit_count("__bits")).alias("__least"))
    )
    down = Window.partitionBy("__g").orderBy(F.desc("__cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most bins + 1 cells
    reached = cells.select("__g", "__cell", F.sum("__least").over(down).alias("__so_far")).where(F.col("__so_far") >= n)
    floors = known.join(reached.groupBy("__g").agg(F.max("__cell").alias("__floor")), "__g", "left")
    above = placed.join(copied(floors, hot, ["__g"]), ["__g", "__salt"]).where(F.col("__floor").isNull() | (cell >= F.col("__floor")))
    return above.select("__g", "__s", *item).distinct()


def top_n(rows: DataFrame, group: str, score: str, item: list[str], n: int, bins: int = 1024, parts: int = PARTS) -> DataFrame:
    """(group, score, item, rank): the n items of each group with the highest score, ties by ascending item; rank
    counts from 1.

    score: an integer column. Rows with a null group, score or item are no candidates. Repeated rows count once.
    Other columns of rows are dropped, whatever their names. An empty table gives an empty result.
    """
    rows = rows.select(F.col(group).alias("__g"), F.col(score).cast("long").alias("__s"), *item).where(" and ".join(f"`{c}` is not null" for c in ("__g", "__s", *item)))
    order = Window.partitionBy("__g").orderBy(F.desc("__s"), *[F.asc(c) for c in item])
    ranked = candidates(rows, item, n, bins, parts).select("*", F.row_number().over(order).alias("__rank")).where(F.col("__rank") <= n)
    return ranked.select(F.col("__g").alias(group), F.col("__s").alias(score), *item, F.col("__rank").alias("rank"))
