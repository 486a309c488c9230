"""Joins that Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], inner: bool = False, bucket: str | None = None) -> DataFrame:
    """For each row of left the values of the last right row with the same keys at or before its time.

    One sort instead of a join: both sides are put in one stream per key and order, and the last right row seen is
    carried on; of right rows with equal times the greatest in `values` counts. Rows of left without a match have
    nulls, or go with inner=True; null keys and null times match nothing. Repeated left rows stay. bucket: a column
    that both sides have and that splits hot keys, where matches never cross its values.
    """
    keys = [*on, *([bucket] if bucket else [])]
    carried = F.struct(*[F.col(v) for v in values])
    payload = F.struct(*[F.col(c) for c in left.columns])
    a = left.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), payload.alias("__row"), F.lit(None).cast(right.select(carried.alias("s")).schema["s"].dataType).alias("__value"))
    b = right.where(F.col(right_time).isNotNull()).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(payload.alias("s")).schema["s"].dataType).alias("__row"), carried.alias("__value")
    )
    w = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__t", "__side", "__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = a.unionByName(b).withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    matched = F.col("__t").isNotNull()
    for i in range(len(keys)):
        matched = matched & F.col(f"__k{i}").isNotNull()
    out = seen.select("__row.*", *[F.when(matched, F.col(f"__last.`{v}`")).alias(v if v not in left.columns else f"{v}_right") for v in values], (matched & F.col("__last").isNotNull()).alias("__hit"))
    return (out.where("__hit") if inner else out).drop("__hit")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point <= high, numbers all: ranges are spread over cells of `width`, points fall in one cell
    each, and an equality join on the cell finds the candidates. Null bounds and points match nothing."""
    cell = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    p = points.where(F.col(point).isNotNull()).withColumn("__cell", cell(point))
    return p.join(r, "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__cell")
