"""Processing only new or changed records.

State is a table of (key, content hash), one row for each record that a successful run has processed. A run hashes
the current rows, joins them with the state, takes the rows that are new or whose hash differs, and writes its output
and what it adds to the state to folders of its own. It then publishes the next version: a small file that names
all folders which count. A version file is never replaced, so of two runs that began at the same version one
publishes and the other fails and leaves no trace; a run that dies before it leaves none either, and the next run takes
the same rows again. Nothing is skipped and nothing counts twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.files import names_in, publish_text, read_text, remove

#: Added parts of the state that are read together before a run writes them as one.
SEGMENTS = 8


def content_hash(*columns: str) -> Column:
    """A 64-bit hash of the columns that tells nulls apart by position."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def changes(current: DataFrame, state: DataFrame, keys: list[str], hash_column: str = "content_hash") -> DataFrame:
    """The rows of current that are new or changed against state, with `change` "new" or "changed".

    state: keys and the hash column. Null keys compare equal. Repeated rows of current come out as often as
    they come in (a later distinct costs only the changed rows); state must hold a key once.
    """
    past = state.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col(hash_column).alias("__s_hash"), F.lit(True).alias("__s_known"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys))
    joined = current.join(past, same, "left")
    return joined.where(F.col("__s_known").isNull() | ~F.col(hash_column).eqNullSafe(F.col("__s_hash"))).select(
        *current.columns, F.when(F.col("__s_known").isNull(), F.lit("new")).otherwise(F.lit("changed")).alias("change")
    )


class StateMoved(RuntimeError):
    """Another run has published the version that this one was about to."""


class IncrementalState:
    """Versions of the state in one folder; the greatest file in `versions` names the folders that count."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def version(self) -> int:
        return max((int(n[1:9]) for n in names_in(self.spark, f"{self.path}/versions") if n.endswith(".json")), default=0)

    def _at(self, version: int) -> dict:
        text = read_text(self.spark, f"{self.path}/versions/v{version:08d}.json") if version else None
        return json.loads(text) if text else {"state": [], "output": []}

    def read(self, version: int | None = None) -> DataFrame | None:
        """(keys, content_hash): of a key in several parts the hash of the latest counts."""
        parts = self._at(self.version() if version is None else version)["state"]
        if not parts:
            return None
        read = [self.spark.read.parquet(f"{self.path}/state/{p}") for p in parts]
        if len(read) == 1:
            return read[0]
        every = reduce(DataFrame.unionByName, (df.withColumn("__part", F.lit(i)) for i, df in enumerate(read)))
        return every.groupBy(*self.keys).agg(F.max_by("content_hash", "__part").alias("content_hash"))

    def commit(self, state: DataFrame, after: int, output: str | None = None) -> int:
        """Add state (keys and content_hash, a key once) to version `after` and publish the next version.

        Raises StateMoved if another run has published it; what that run wrote is left as it is.
        """
        at, mine = self._at(after), uuid.uuid4().hex
        merge = len(at["state"]) >= SEGMENTS
        added = state.select(*self.keys, "content_hash")
        if merge:
            old = self.read(after)
            every = old.withColumn("__part", F.lit(0)).unionByName(added.withColumn("__part", F.lit(1)))
            added = every.groupBy(*self.keys).agg(F.max_by("content_hash", "__part").alias("content_hash"))
        added.write.parquet(f"{self.path}/state/{mine}")
        after_this = {"state": [mine] if merge else [*at["state"], mine], "output": [*at["output"], output]}
        if not publish_text(self.spark, f"{self.path}/versions/v{after + 1:08d}.json", json.dumps(after_this)):
            remove(self.spark, f"{self.path}/state/{mine}")
            raise StateMoved(f"state moved on from version {after}")
        return after + 1

    def pending(self, current: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of current (keys, content_hash and any others) that no successful run has covered."""
        state = self.read(version)
        if state is None:
            return current.withColumn("change", F.lit("new"))
        return changes(current, state, self.keys)

    def run(self, current: DataFrame, content: list[str], process: Callable[[DataFrame], DataFrame]) -> int:
        """One run: process(new or changed rows) is written as this version's output; state and output become visible
        together. Keys that left current keep their state.

        Of several rows with the same key and different content the one with the greatest hash counts. Keys and
        hashes alone are joined with the state; whole rows are fetched only for the keys that differ.
        """
        before, mine = self.version(), uuid.uuid4().hex
        rows = current.withColumn("content_hash", content_hash(*content))
        now = rows.groupBy(*self.keys).agg(F.max("content_hash").alias("content_hash"))
        todo, output = f"{self.path}/todo/{mine}", f"{self.path}/output/{mine}"
        try:
            self.pending(now, before).write.parquet(todo)
            due = self.spark.read.parquet(todo)
            wanted = due.select(*[F.col(k).alias(f"__d_{k}") for k in self.keys], F.col("content_hash").alias("__d_hash"), "change")
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__d_{k}")) for k in self.keys)) & (F.col("content_hash") == F.col("__d_hash"))
            picked = rows.join(wanted, same).select(*rows.columns, "change").dropDuplicates([*self.keys, "content_hash"])
            process(picked).write.parquet(output)
            return self.commit(due, before, mine)
        except BaseException:
            remove(self.spark, output)
            raise
        finally:
            remove(self.spark, todo)

    def output(self, since: int = 0) -> DataFrame | None:
        """All rows that runs after version `since` have put out."""
        names = [n for n in self._at(self.version())["output"][since:] if n]
        return self.spark.read.parquet(*[f"{self.path}/output/{n}" for n in names]) if names else None

    def vacuum(self) -> list[str]:
        """Remove folders of state and output that the latest version doesn't name, such as those of runs that died.
        Only for times when no run is under way."""
        at, gone = self._at(self.version()), []
        for kind in ("state", "output", "todo"):
            keep = set(at.get(kind, ()))
            for n in names_in(self.spark, f"{self.path}/{kind}"):
                if n not in keep:
                    remove(self.spark, f"{self.path}/{kind}/{n}")
                    gone.append(f"{kind}/{n}")
        return gone
