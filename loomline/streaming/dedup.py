"""Messages delivered more than once: exactly one copy of each stays.

A stream of deliveries is taken in micro-batches. The state holds, for each message, the delivery that stays: the one
received first, of equal ones that with the smallest id. A batch is merged with what the state holds of its messages
by a partial and a final aggregation on the message, so a message with very many copies is reduced before it is shuffled.

State has a hot part, a list of segments that each batch adds to, and an archive in folders by span of the event time.
Segments are merged when there are SEGMENTS of them or when the batch is no smaller than half of them: then messages
older than the watermark leave for the archive. Deliveries older than what has left are looked up there, in the spans
that they name. State, archive, output and watermark of a batch become visible together, by the swap of one pointer file
that also holds the number of the batch: a batch that is run again after a failure changes nothing twice.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomline.functions.names import micros
from loomline.sources.files import is_folder, read_text, remove, swap_text

_ROW = ["k", "t", "received", "id"]
DAY = 86_400_000_000
#: Segments of the hot part that are merged at the latest; length of a span of the archive; spans that a look-up names one by
#: one, beyond which it reads them all.
SEGMENTS, SPAN, NAMED_SPANS = 8, 30 * DAY, 1000
#: The folder of what stays hot, beside those of spans.
HOT = -(2**62)


def _first(rows: DataFrame) -> DataFrame:
    """Of each message the copy received first, of equal ones that with the smallest id; a null time comes last."""
    first = F.min(F.struct(F.col("received").isNull().alias("n"), "received", "id")).alias("f")
    return rows.groupBy("k", "t").agg(first).select("k", "t", "f.received", "f.id")


def _span() -> Column:
    return F.floor(F.col("t") / SPAN).cast("long")


class SeenMessages:
    """Store of seen messages in a folder that all executors share.

    delay_us: how much older than the newest event a message may be before it leaves the hot part. An event time counts
    as new only up to slack_us after its delivery was received, so that a time far in the future can't move the watermark
    past everything.
    """

    def __init__(self, spark: SparkSession, path: str, delay_us: int = 7 * DAY, slack_us: int = DAY):
        self.spark, self.path, self.delay, self.slack = spark, path.rstrip("/"), delay_us, slack_us

    def pointer(self) -> dict:
        """batch: the last one merged; watermark; left: event times before this are in the archive; hot: [segment, rows];
        late: deliveries so far that were looked up in the archive."""
        text = read_text(self.spark, f"{self.path}/pointer.json")
        return json.loads(text) if text else {"batch": -1, "watermark": None, "left": None, "hot": [], "late": 0}

    def _hot(self, at: dict, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n, _ in at["hot"]]) if at["hot"] else None

    def _archive(self, at: dict, schema: str) -> DataFrame:
        """All that has left the hot part, with span."""
        every = self.spark.read.schema(f"{schema}, span long, batch long").parquet(f"{self.path}/merged")
        return every.where((F.col("batch") <= at["batch"]) & (F.col("span") != HOT))

    def _late(self, rows: DataFrame, at: dict, schema: str) -> tuple[DataFrame | None, int]:
        """What the archive holds of the spans of late rows, and how many of these there are."""
        if at["left"] is None:
            return None, 0
        spans = rows.where(F.col("t") < at["left"]).groupBy(_span().alias("span")).count().limit(NAMED_SPANS + 1).collect()
        if not spans:
            return None, 0
        archive = self._archive(at, schema)
        if len(spans) <= NAMED_SPANS:
            archive = archive.where(F.col("span").isin([r.span for r in spans]))
        return archive.select(*_ROW), sum(r["count"] for r in spans)

    def add(self, deliveries: DataFrame, batch: int) -> None:
        """Merge one batch. deliveries: k (identity of the message), t (event time, microseconds), received, id.

        Rows where k, t or id is null are no messages and are left alone.
        """
        at = self.pointer()
        if batch <= at["batch"]:
            return
        spark = self.spark
        rows = deliveries.select(*_ROW).where("k is not null and t is not null and id is not null")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        hot = self._hot(at, schema)
        late, n_late = self._late(rows, at, schema)
        past = [p for p in (hot, late) if p is not None]
        received = F.col("received") if isinstance(rows.schema["received"].dataType, LongType) else micros("received")
        seen, made = Observation(), Observation()
        known = observed = rows.observe(seen, F.max(F.when(received.isNotNull(), F.least("t", received + self.slack))).alias("newest"))
        if past:
            # the copy that stays so far, of the messages that this batch holds
            mine = _first(reduce(DataFrame.unionByName, past).join(rows.select("k", "t").distinct(), ["k", "t"], "left_semi"))
            known, observed = rows.unionByName(mine), observed.unionByName(mine)
        kept_at = f"{self.path}/kept/b{batch}"
        kept = _first(observed)
        kept.observe(made, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(kept_at)
        kept = spark.read.schema(schema).parquet(kept_at)
        known.select("id").join(kept.select("id"), "id", "left_anti").distinct().write.mode("overwrite").parquet(f"{self.path}/dropped/batch={batch}")

        newest, fresh, held = seen.get["newest"], made.get["n"], sum(n for _, n in at["hot"])
        mark = max((x for x in (at["watermark"], None if newest is None else newest - self.delay) if x is not None), default=None)
        left, segments = at["left"], [*at["hot"], [f"kept/b{batch}", fresh]]
        if mark is not None and (len(segments) >= SEGMENTS or 2 * fresh >= held):
            whole, stays = _first(hot.unionByName(kept)) if hot is not None else kept, Observation()
            span = F.when(F.col("t") >= mark, F.lit(HOT)).otherwise(_span())
            whole = whole.observe(stays, F.count_if(F.col("t") >= mark).alias("n")).withColumn("span", span)
            whole.write.mode("overwrite").partitionBy("span").parquet(f"{self.path}/merged/batch={batch}")
            n = stays.get["n"]
            segments, left = [[f"merged/batch={batch}/span={HOT}", n]] if n else [], mark
        swap_text(spark, f"{self.path}/pointer.json", json.dumps({"batch": batch, "watermark": mark, "left": left, "hot": segments, "late": at["late"] + n_late}))
        for n in {n for n, _ in [*at["hot"], (f"kept/b{batch}", 0)]} - {n for n, _ in segments}:
            remove(spark, f"{self.path}/{n}")

    def dropped(self) -> DataFrame:
        """(id) of every delivery that a better copy of its message has replaced."""
        done = self.pointer()["batch"]
        if done < 0:
            return self.spark.createDataFrame([], "id long")
        return self.spark.read.schema("id long, batch long").parquet(f"{self.path}/dropped").where(F.col("batch") <= done).select("id")

    def kept(self) -> DataFrame:
        """(k, t, received, id): the copy of each message that stays."""
        at = self.pointer()
        if at["batch"] < 0:
            return self.spark.createDataFrame([], "k string, t long, received timestamp_ntz, id long")
        parts = [self.spark.read.parquet(f"{self.path}/{n}").select(*_ROW) for n, _ in at["hot"]]
        if at["left"] is not None:
            every = self.spark.read.parquet(f"{self.path}/merged")
            parts.append(every.where((F.col("batch") <= at["batch"]) & (F.col("span") != HOT)).select(*_ROW))
        return _first(reduce(DataFrame.unionByName, parts))


def drop_repeats(stream: DataFrame, store: SeenMessages) -> None:
    """Run all that the stream has now through the store; again after a failure, it goes on where it stopped."""
    (
        stream.writeStream.foreachBatch(lambda df, n: store.add(df, n))
        .option("checkpointLocation", f"{store.path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def parquet_stream(spark: SparkSession, path: str, max_bytes: int = 1 << 30) -> DataFrame:
    """A parquet table, in a file or a folder, as a stream of micro-batches of at most max_bytes."""
    # a stream's path must be a folder or a pattern; the pattern for a single file matches that file alone
    source = path if is_folder(spark, path) else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", max_bytes).parquet(source)
