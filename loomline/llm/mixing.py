"""Mixing sources to target weights.

The records of a source, in a fixed pseudo-random order, form a tape that is read up to max_repeats times. Where
a record begins on its tape comes from running sums within hashed buckets and the sums of the buckets before, so
a source of any size is spread over many tasks. The tapes are cut into blocks of equal size.

The schedule decides what the mixture holds. Block k of a source with weight w is released at slot floor(k / w) and
due at slot ceil((k + 1) / w); in each slot the released block that is due first goes out (earliest deadline first,
Pfair), so that at every slot each source is less than one block away from its share. The mixture ends with the first
block that its source can't give: at the greatest size at which every source that has records holds its share (shares
of sources without records go to the others in proportion). Where a total is asked for, a source that is used up
leaves, the others go on with the weights that remain, and the mixture ends with the block that reaches the total.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most blocks of all tapes together, which the driver schedules, and rows aimed at in a bucket.
BLOCKS, BUCKET_ROWS = 50_000, 20_000


@dataclass(frozen=True)
class Source:
    name: str
    weight: float
    blocks: int


def live_sources(tokens: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, tuple[float, int]]:
    """(weight, tokens of all repeats) of each source that has tokens, a positive target and repeats."""
    live = {s: (w, tokens.get(s, 0) * r) for s, w, r in targets if s is not None and w and w > 0 and r and r > 0 and tokens.get(s, 0) > 0}
    whole = sum(w for w, _ in live.values())
    return {s: (w / whole, cap) for s, (w, cap) in live.items()}


def pfair(sources: list[Source], slots: int | None = None) -> list[tuple[int, str, int]]:
    """(slot, source, block) by earliest deadline among the released blocks.

    slots None: until a block is due that its source doesn't have. Otherwise until so many slots are filled or no
    source has blocks left; a source without further blocks leaves, and at that slot the others begin anew with the
    weights that remain.
    """
    out: list[tuple[int, str, int]] = []
    used = dict.fromkeys((s.name for s in sources), 0)
    open_ = [s for s in sources if s.blocks]
    while open_:
        whole, start = sum(s.weight for s in open_), len(out)
        waiting = [(0, i, 0) for i in range(len(open_))]
        ready: list[tuple[int, str, int, int]] = []
        gone = None
        while gone is None:
            if slots is not None and len(out) >= slots:
                return out
            now = len(out) - start
            while waiting and (waiting[0][0] <= now or not ready):
                _, i, k = heapq.heappop(waiting)
                heapq.heappush(ready, (math.ceil((k + 1) * whole / open_[i].weight - 1e-9), open_[i].name, i, k))
            _, name, i, k = heapq.heappop(ready)
            if used[name] >= open_[i].blocks:
                gone = name
                continue
            out.append((len(out), name, used[name]))
            used[name] += 1
            heapq.heappush(waiting, (math.floor((k + 1) * whole / open_[i].weight + 1e-9), i, k + 1))
        if slots is None:
            return out
        open_ = [s for s in open_ if s.name != gone]
    return out


def copies(docs: DataFrame, targets: DataFrame, blocks: int = BLOCKS, total: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, pass_no, block, slot): every copy of a record in the mixture.

    docs: doc_id, source, n_tokens, written (it is read several times). Records without tokens, without a source
    or of sources that targets doesn't name can't add to a share and stay out. targets: source, target_share,
    max_repeats, a short list. A copy is in if the block in which it begins is scheduled. A block has the mean size of a
    record, or more where the tapes would have more than `blocks` blocks.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", "n_tokens").where("source is not null and n_tokens > 0")
    wanted = [(r.source, r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").collect()]
    names = [s for s, _, _ in wanted if s is not None]
    docs = docs.where(F.col("source").isin(names)) if names else docs.where("false")
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    have, rows = {r.source: r.t for r in sums}, sum(r.n for r in sums)
    live = live_sources(have, wanted)
    size = max(1.0, sum(have.values()) / max(1, rows), sum(cap for _, cap in live.values()) / blocks)
    sources = [Source(s, w, math.ceil(cap / size)) for s, (w, cap) in sorted(live.items())]
    repeats = {s: r for s, _, r in wanted}
    order = pfair(sources, None if total is None else math.ceil(total / size))  # at most `blocks` and one for each source
    slots = spark.createDataFrame(order, "slot long, source string, block long")
    facts = spark.createDataFrame([(s.name, have[s.name], repeats[s.name]) for s in sources], "s string, tape long, most int")
    buckets = max(1, -(-rows // BUCKET_ROWS))
    turn = F.xxhash64("doc_id")
    spread = docs.withColumn("turn", turn).withColumn("bucket", F.pmod(F.shiftright("turn", 7), F.lit(buckets)))
    held = spread.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("source").alias("hs"), F.col("bucket").alias("hb"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("lead"))
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.join(held, (F.col("source") == F.col("hs")) & (F.col("bucket") == F.col("hb")))
    placed = placed.join(F.broadcast(facts), F.col("source") == F.col("s"))  # one row per target
    copy = placed.select(
        "doc_id", "source", "n_tokens", "tape", (F.col("lead") + F.col("inside")).alias("at"), F.explode(F.expr("sequence(0, most - 1)")).alias("pass_no")
    )
    copy = copy.withColumn("block", F.floor((F.col("at") + F.col("pass_no") * F.col("tape")) / F.lit(size)).cast("long"))
    return copy.join(F.broadcast(slots), ["source", "block"]).select("doc_id", "source", "n_tokens", "pass_no", "block", "slot")


def mixture(placed: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of copies()."""
    return placed.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).cast("int").alias("repeats"))


def shares(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, tokens, actual_share) for each target, sources without records included."""
    got = placed.groupBy(F.col("source").alias("g")).agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    whole = Window.partitionBy()  # one row per source: the short list of targets
    got = got.withColumn("size", F.sum("tokens").over(whole))
    joined = targets.select("source", "target_share", "max_repeats").join(got, F.col("source") == F.col("g"), "left")
    return joined.select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("size"), F.lit(0.0)).alias("actual_share"),
    )
