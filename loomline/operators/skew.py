"""Joins whose keys may be very unevenly used.

A key with more than 1/parts of all rows is split into salted parts in proportion to its count, so that no part holds
more than about 1/parts of the rows, whatever the size of the table. There are fewer than `parts` such keys, and
together they have at most 2 * parts salts: the list of them is broadcast, and the other side is copied at most
that often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest share of all rows that one part may hold is 1/PARTS.
PARTS = 10_000


def hot_keys(rows: DataFrame, on: list[str], parts: int = PARTS) -> DataFrame:
    """(on, __salts) of the keys with more than 1/parts of all rows; null keys are none of them."""
    total = max(1, rows.count())
    counts = rows.where(" and ".join(f"`{k}` is not null" for k in on)).groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    salts = F.least(F.ceil(F.col("__n") * F.lit(parts) / F.lit(total)), F.col("__n")).cast("int")
    return counts.where(F.col("__n") > max(1, total // parts)).select(*on, salts.alias("__salts"))


def salted(rows: DataFrame, hot: DataFrame, on: list[str], by: list[str], parts: int = PARTS) -> DataFrame:
    """rows with __salt, which spreads those of hot and of null keys by the hash of the columns `by`."""
    null = " or ".join(f"`{k}` is null" for k in on)
    many = F.coalesce("__salts", F.when(F.expr(null), F.lit(parts)), F.lit(1))
    spread = F.when(many > 1, F.pmod(F.xxhash64(*by), many)).otherwise(F.lit(0)).cast("int")
    return rows.join(F.broadcast(hot), on, "left").withColumn("__salt", spread).drop("__salts")


def copied(rows: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    """rows with __salt, once for each part of their key."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))
    return rows.join(F.broadcast(hot), on, "left").withColumn("__salt", every).drop("__salts")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "inner", parts: int = PARTS) -> DataFrame:
    """big joined with small on equal columns `on`, which no other columns of theirs share names with. Keys of big
    may be as hot as they like; rows of small are copied for those."""
    hot = hot_keys(big, on, parts)
    return salted(big, hot, on, by, parts).join(copied(small, hot, on), [*on, "__salt"], how).drop("__salt")
