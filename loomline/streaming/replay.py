"""A table at rest as a stream: its rows in order of a column, in a given number of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.session import scratch_path
from loomline.sources.files import move, names_in, set_time


class Replay:
    """rows are written once, in ranges of `by`; `release` hands the next micro-batches to the stream.

    A file source can't split files and takes them by their times, so each micro-batch is as many files as tasks can
    run at once, and gets a time of its own. Where a file system keeps no times that are set, batches may mix; then
    more deliveries are late, and the result is the same.
    """

    def __init__(self, rows: DataFrame, by: str, batches: int):
        self.spark: SparkSession = rows.sparkSession
        self.schema, self.batches = rows.schema, batches
        self.files = max(1, self.spark.sparkContext.defaultParallelism)
        self.store, self.source = scratch_path(self.spark, "replay"), scratch_path(self.spark, "stream")
        rows.repartitionByRange(batches * self.files, by).write.parquet(self.store)
        self.waiting = [n for n in names_in(self.spark, self.store) if n.startswith("part-")]
        self.given = 0

    def release(self, batches: int) -> None:
        """Move the files of the next batches to the folder that the stream reads."""
        for n in self.waiting[: batches * self.files]:
            move(self.spark, f"{self.store}/{n}", f"{self.source}/{n}")
            set_time(self.spark, f"{self.source}/{n}", 1_000_000_000_000 + self.given // self.files * 60_000)
            self.given += 1
        self.waiting = self.waiting[batches * self.files :]

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files).parquet(self.source)
