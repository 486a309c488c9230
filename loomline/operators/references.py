"""References to records that do not exist, by a linear merge of sorted references and parent intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.skew import PARTS, copied, hot_keys, salted

#: Ends of time, in microseconds.
ALWAYS, NEVER_ENDS = -(2**63) + 1, 2**63 - 1


def orphans(refs: DataFrame, parents: DataFrame, parts: int = PARTS) -> DataFrame:
    """References without a valid parent at their time.

    refs: space, key, at (microseconds; null: any time) and any other columns; null keys refer to nothing.
    parents: space, key, valid_from, valid_to (microseconds; null: since ever, for ever); several intervals of a
    key may overlap, repeated ones count once. A parent is valid from valid_from up to, not with, valid_to.
    Returns the columns of refs and reason: "missing" (no such parent at any time), "deleted" (it had ended),
    "late" (it comes later). A reference with a null time is an orphan only if its key has no parent.

    Both sides are hashed to the same partitions by key, sorted by time with parents first, and merged in one
    forward pass: each parent has a mark at the beginning of time, by which later references know that it exists at
    some time, and the greatest end of the intervals begun so far tells whether one is open. A key with more than
    1/parts of all references is split in proportion to its count, and the parent's intervals are copied to its
    parts, so that the references of one task are at most about 1/parts of all.
    """
    on = ["space", "key"]
    other = [c for c in refs.columns if c not in (*on, "at")]
    payload = F.struct(*[F.col(c) for c in other]) if other else F.struct(F.lit(1).alias("_"))
    r = refs.where(F.col("key").isNotNull()).select(*on, "at", payload.alias("ref"))
    hot = hot_keys(r, on, parts)
    r = salted(r, hot, on, ["ref", "at"], parts).select(
        *on, "__salt", F.coalesce("at", F.lit(NEVER_ENDS)).alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("until"), "at", "ref",
    )
    p = parents.where(F.col("key").isNotNull()).select(*on, F.coalesce("valid_from", F.lit(ALWAYS)).alias("t"), F.coalesce("valid_to", F.lit(NEVER_ENDS)).alias("until"))
    # one interval for each beginning: the longest; and the mark of existence, which is open at no time
    p = p.groupBy(*on, "t").agg(F.max("until").alias("until"))
    p = p.unionByName(p.select(*on).distinct().select(*on, F.lit(ALWAYS - 1).alias("t"), F.lit(None).cast("long").alias("until")))
    p = copied(p, hot, on).select(*on, "__salt", "t", F.lit(0).alias("side"), "until")
    both = r.unionByName(p, allowMissingColumns=True)
    so_far = Window.partitionBy(*on, "__salt").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.select("*", F.max("until").over(so_far).alias("open_until"), F.min("side").over(so_far).alias("known")).where("side = 1")
    reason: Column = (
        F.when(F.col("known") == 1, "missing")
        .when(F.col("at").isNull(), None)
        .when(F.col("open_until") > F.col("at"), None)
        .when(F.col("open_until").isNotNull(), "deleted")
        .otherwise("late")
    )
    return merged.withColumn("reason", reason).where("reason is not null").select(*on, "at", *[F.col(f"ref.`{c}`").alias(c) for c in other], "reason")
