"""Queries p1, p3, p5 and p6 with their SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.names import canonical, micros, uuid_key
from loomline.operators import hierarchy as H
from loomline.operators.incremental import IncrementalState, content_hash
from loomline.operators.references import orphans
from loomline.operators.skew import salted_join
from loomline.session import scratch_path, written
from loomline.sources.tables import table
from loomline.streaming.dedup import SeenMessages, drop_repeats
from loomline.streaming.replay import Replay

TIME_COLUMNS = ("event_time", "updated_at", "loaded_at")


# 1. hierarchies


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineage_edges").select(canonical("src_dataset").alias("src"), canonical("dst_dataset").alias("dst"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = H.hierarchy(_edges(spark, d), "src", "dst")
    return found.select(F.col("node").alias("dataset"), "root", "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.paths(_edges(spark, d), "src", "dst").select(F.col("node").alias("dataset"), F.concat_ws(" > ", "path").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    up = H.ancestors(_edges(spark, d), "src", "dst")
    return up.select(F.col("ancestor").alias("dataset"), F.col("node").alias("descendant"), "distance")


# 3. new or changed rows


def _current(spark: SparkSession, d: str) -> DataFrame:
    """(task_name, by, row_id, t, since, mark, first_mark, body): rows of each incremental task's inputs, with the time the
    task goes by, the time since which the row exists, and the least and the greatest mark of the task's runs."""
    tasks = table(spark, d, "tasks").select(canonical("name").alias("task_name"), canonical("incremental_by").alias("by"), "inputs")
    tasks = tasks.where(F.col("by").isin(*TIME_COLUMNS) & F.col("task_name").isNotNull())
    reads = tasks.select("task_name", "by", F.explode("inputs").alias("i")).select("task_name", "by", canonical("i").alias("dataset")).where("dataset is not null").distinct()
    runs = table(spark, d, "runs").where(canonical("status") == "success")
    at = micros("last_processed_at")
    marks = runs.groupBy(canonical("task_name").alias("task_name")).agg(F.max(at).alias("mark"), F.min(at).alias("first_mark"))
    reads = reads.join(marks, "task_name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mark", "first_mark")})
    rows = table(spark, d, "source_rows").select(
        "row_id", canonical("dataset").alias("dataset"), *[micros(c).alias(c) for c in TIME_COLUMNS], content_hash("row_key", "op", "event_time", "amount").alias("body")
    )
    when = F.when(F.col("by") == TIME_COLUMNS[0], F.col(TIME_COLUMNS[0])).when(F.col("by") == TIME_COLUMNS[1], F.col(TIME_COLUMNS[1])).otherwise(F.col(TIME_COLUMNS[2]))
    read = salted_join(rows.where("dataset is not null"), reads, ["dataset"], ["row_id"])
    return read.select("task_name", "by", "row_id", when.alias("t"), F.coalesce("event_time", when).alias("since"), "mark", "first_mark", "body").where("t is not null")


class _Lost(Exception):
    """A failure between runs."""


def _lost(rows: DataFrame) -> DataFrame:
    raise _Lost


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The history of each task is run again, then the next run is made; its output is the result.

    The source is put back to what it was at a mark: a row is there if it existed by then (event_time), as it is now if
    the task's column isn't later than the mark, else in its earlier form, with that column as it was at first. A
    run at the tasks' first marks, a failed one, and one at their last marks leave their state of keys and content
    hashes; the run over the rows as they are takes those that the state lacks (new) or holds in another form
    (changed), which are those later than the mark.
    """
    current = written(_current(spark, d), "current")
    store = IncrementalState(spark, scratch_path(spark, "p3"), ["task_name", "by", "row_id"])

    def as_of(mark: str) -> DataFrame:
        return current.where(F.least("t", "since") <= F.col(mark)).withColumn("t", F.when(F.col("t") <= F.col(mark), F.col("t")).otherwise(F.col("since")))

    def take(rows: DataFrame) -> DataFrame:
        return rows.select("task_name", "row_id", "change")

    store.run(as_of("first_mark"), ["t", "body"], take)
    try:
        store.run(as_of("mark"), ["t", "body"], _lost)
    except _Lost:
        pass
    past = store.run(as_of("mark"), ["t", "body"], take)
    store.run(current, ["t", "body"], take)
    return store.output(since=past).select("task_name", "row_id").distinct()


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, change) put out by two runs over all rows with a failed one in between.

    The first sees two rows of three, half of them in an older form; the others see all rows as they are.
    """
    now = table(spark, d, "source_rows")
    older = F.when(F.col("row_id") % 3 == 1, F.concat(F.coalesce("op", F.lit("")), F.lit("-"))).otherwise(F.col("op"))
    store, content = IncrementalState(spark, scratch_path(spark, "p3"), ["row_id"]), ["dataset", "row_key", "op", *TIME_COLUMNS, "amount"]

    out = lambda rows: rows.select("row_id", "change")
    store.run(now.where("row_id % 3 <> 0").withColumn("op", older), content, out)
    try:
        store.run(now, content, _lost)
    except _Lost:
        pass
    store.run(now, content, out)
    return store.output()


# 5. orphan references


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks = table(spark, d, "tasks").select(canonical("name").alias("name"), "inputs", "outputs", "depends_on", micros("registered_at").alias("registered"))
    runs = table(spark, d, "runs").select("run_id", canonical("task_name").alias("target"), micros("started_at").alias("started"))

    def refs(field: str, space: str, rows: DataFrame, key: str, target: str, at: str, month: str) -> DataFrame:
        return rows.select(F.lit(field).alias("ref_field"), F.lit(space).alias("space"), F.col(key).alias("ref_key"), F.col(target).alias("key"), F.col(at).cast("long").alias("at"), F.col(month).alias("month_us"))

    def exploded(column: str) -> DataFrame:
        rows = tasks.select("name", "registered", F.explode(column).alias("x"))
        return rows.select("name", "registered", canonical("x").alias("target"), F.lit(None).alias("any"), F.coalesce("registered", F.lit(-(2**62))).alias("reg"))

    every = (
        refs("tasks.depends_on", "name", exploded("depends_on"), "name", "target", "any", "registered")
        .unionByName(refs("tasks.inputs", "dataset", exploded("inputs"), "name", "target", "reg", "registered"))
        .unionByName(refs("runs.task_name", "task", runs, "run_id", "target", "started", "started"))
    )

    def parents(space: str, rows: DataFrame, key: str, start: str | None = None, until: str | None = None) -> DataFrame:
        c = lambda x: F.lit(None).cast("long") if x is None else F.col(x)
        return rows.select(F.lit(space).alias("space"), F.col(key).alias("key"), c(start).alias("valid_from"), c(until).alias("valid_to"))

    outputs = tasks.select(F.explode("outputs").alias("o")).select(canonical("o").alias("o")).distinct()
    catalogue = table(spark, d, "datasets").where("created_at is not null").select(canonical("dataset").alias("dataset"), micros("created_at").alias("created"), micros("dropped_at").alias("dropped"))
    exist = (
        parents("name", tasks, "name")
        .unionByName(parents("dataset", outputs, "o"))
        .unionByName(parents("dataset", catalogue, "dataset", "created", "dropped"))
        .unionByName(parents("task", tasks, "name", "registered"))
    )
    return every, exist


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs, exist = _references(spark, d)
    return orphans(refs, exist).select("ref_field", "ref_key", F.col("key").alias("target"), "month_us", "reason")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "ref_key", "target").distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_format(F.timestamp_micros("month_us"), "yyyy-MM")
    cases = _orphans(spark, d).distinct()
    return cases.groupBy("ref_field", month.alias("month")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "late")]
    )


# 6. messages delivered more than once


def _deliveries(rows: DataFrame) -> DataFrame:
    when = F.btrim("event_time", F.lit(" \t\r\n"))
    return rows.select(
        F.concat_ws("|", uuid_key("run_id"), canonical("event_type")).alias("k"),
        F.unix_micros(F.try_to_timestamp(when)).alias("t"),
        F.col("received_at").alias("received"), F.col("delivery_id").alias("id"),
        (F.col("run_id").isNull() | F.col("event_type").isNull()).alias("no"),
    ).where("not no").drop("no")


#: Micro-batches in which the table is streamed.
MICRO_BATCHES = 5


def _seen(spark: SparkSession, d: str) -> SeenMessages:
    """All deliveries streamed in the order in which they were received, in micro-batches, the second half after a
    restart: state, watermark and place in the stream are then taken from the shared folder."""
    rows = _deliveries(table(spark, d, "ol_events")).where("k is not null and t is not null").withColumn("received", micros("received"))
    replay, path = Replay(rows, "received", MICRO_BATCHES), scratch_path(spark, "p6")
    for batches in (MICRO_BATCHES // 2, MICRO_BATCHES):
        replay.release(batches)
        drop_repeats(replay.stream(), SeenMessages(spark, path))
    return SeenMessages(spark, path)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).dropped().select(F.col("id").alias("delivery_id"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """(delivery_id, streamed): the copy of each message that stays, and whether several micro-batches and an expired
    watermark were met on the way."""
    store = _seen(spark, d)
    at = store.pointer()
    return store.kept().select(F.col("id").alias("delivery_id"), F.lit(at["batch"] > 1 and at["left"] is not None).alias("streamed"))


QUERIES = {
    "p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p3_found": p3_found, "p3_runs": p3_runs,
    "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p6_kept": p6_kept,
}

_NAME = "nullif(lower(trim({}, ' \t\r\n')), '')"


def _n(x: str) -> str:
    return _NAME.format(x)


_FOREST = f"""
e AS (SELECT {_n('src_dataset')} AS p, {_n('dst_dataset')} AS c FROM lineage_edges),
n AS (SELECT p AS x FROM e WHERE p IS NOT NULL UNION SELECT c FROM e WHERE c IS NOT NULL),
up AS (SELECT c, min(p) AS p FROM e WHERE p <> c GROUP BY c),
walk(x, root, depth) AS (
  SELECT x, x, 0 FROM n WHERE x NOT IN (SELECT c FROM up)
  UNION ALL SELECT up.c, walk.root, walk.depth + 1 FROM walk JOIN up ON up.p = walk.x),
off AS (SELECT c, p FROM up WHERE c NOT IN (SELECT x FROM walk)),
hop(x, y) AS (SELECT c, p FROM off UNION SELECT hop.x, off.p FROM hop JOIN off ON off.c = hop.y),
ring AS (SELECT x FROM hop WHERE x = y),
lap AS (SELECT hop.x, min(hop.y) AS root FROM hop JOIN ring ON ring.x = hop.y GROUP BY hop.x)"""

ORACLE = {
    "p3_runs": "SELECT DISTINCT row_id, 'new' AS change FROM source_rows UNION ALL SELECT DISTINCT row_id, 'changed' FROM source_rows WHERE row_id % 3 = 1",
    "p1_found": f"""WITH RECURSIVE {_FOREST}
SELECT x AS dataset, root, CAST(depth AS INTEGER) AS depth FROM walk
UNION ALL SELECT x, root, CASE WHEN x IN (SELECT x FROM ring) THEN -1 ELSE -2 END FROM lap""",
    "p1_paths": f"""WITH RECURSIVE {_FOREST},
cut AS (SELECT c, p FROM up WHERE c NOT IN (SELECT x FROM ring)),
line(x, path) AS (
  SELECT x, x FROM n WHERE x NOT IN (SELECT c FROM cut)
  UNION ALL SELECT cut.c, line.path || ' > ' || cut.c FROM line JOIN cut ON cut.p = line.x)
SELECT x AS dataset, path FROM line""",
    "p1_descendants": f"""WITH RECURSIVE {_FOREST},
cut AS (SELECT c, p FROM up WHERE c NOT IN (SELECT x FROM ring)),
pair(a, x, k) AS (
  SELECT p, c, 1 FROM cut
  UNION ALL SELECT pair.a, cut.c, pair.k + 1 FROM pair JOIN cut ON cut.p = pair.x)
SELECT a AS dataset, x AS descendant, CAST(k AS INTEGER) AS distance FROM pair""",
    "p3_found": f"""WITH t AS (SELECT {_n('name')} AS task_name, {_n('incremental_by')} AS inc, inputs FROM tasks),
r AS (SELECT DISTINCT task_name, inc, {_n('u.i')} AS dataset FROM t, unnest(t.inputs) AS u(i)),
m AS (SELECT {_n('task_name')} AS task_name, max(last_processed_at) AS mark FROM runs WHERE {_n('status')} = 'success' GROUP BY 1)
SELECT DISTINCT r.task_name, s.row_id FROM r
JOIN source_rows s ON {_n('s.dataset')} = r.dataset LEFT JOIN m ON m.task_name = r.task_name
WHERE r.inc IN ('event_time', 'updated_at', 'loaded_at')
AND CASE r.inc WHEN 'event_time' THEN s.event_time WHEN 'updated_at' THEN s.updated_at ELSE s.loaded_at END > coalesce(m.mark, TIMESTAMP '1970-01-01')""",
    "p6_found": r"""WITH e AS (
  SELECT delivery_id, received_at, lower(trim(event_type, E' \t\r\n')) AS ty,
         translate(regexp_replace(lower(trim(run_id, E' \t\r\n')), '^urn:uuid:', ''), '{}-', '') AS ru,
         CAST(regexp_replace(trim(event_time), '([+-][0-9]{2})([0-9]{2})$', '\1:\2') AS TIMESTAMPTZ) AS ts
  FROM ol_events WHERE run_id IS NOT NULL AND event_type IS NOT NULL AND event_time IS NOT NULL)
SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY ru, ty, ts ORDER BY received_at, delivery_id) AS k FROM e) WHERE k > 1""",
}
ORACLE["p6_kept"] = ORACLE["p6_found"].replace("SELECT delivery_id FROM (SELECT", "SELECT delivery_id, true AS streamed FROM (SELECT").replace("k > 1", "k = 1")

_CASES = f"""
t AS (SELECT {_n('name')} AS name, inputs, outputs, depends_on, registered_at FROM tasks),
o AS (SELECT DISTINCT {_n('u.i')} AS x FROM t, unnest(t.outputs) AS u(i)),
d AS (SELECT {_n('dataset')} AS x, created_at, dropped_at FROM datasets),
known AS (SELECT name, min(registered_at) AS registered_at FROM t GROUP BY name),
ins AS (SELECT DISTINCT name, registered_at, {_n('u.i')} AS x FROM t, unnest(t.inputs) AS u(i)),
r AS (SELECT DISTINCT run_id, started_at, {_n('task_name')} AS x FROM runs),
cases AS (
  SELECT DISTINCT 'tasks.depends_on' AS ref_field, name AS ref_key, x AS target, registered_at AS happened, 'missing' AS reason
  FROM (SELECT t.name, t.registered_at, {_n('u.i')} AS x FROM t, unnest(t.depends_on) AS u(i)) WHERE x IS NOT NULL AND x NOT IN (SELECT name FROM known WHERE name IS NOT NULL)
  UNION ALL
  SELECT 'tasks.inputs', name, x, registered_at,
    CASE WHEN NOT EXISTS (SELECT 1 FROM d WHERE d.x = ins.x) THEN 'missing'
         WHEN EXISTS (SELECT 1 FROM d WHERE d.x = ins.x AND d.created_at <= ins.registered_at) THEN 'deleted' ELSE 'late' END
  FROM ins WHERE x IS NOT NULL AND x NOT IN (SELECT x FROM o WHERE x IS NOT NULL)
  AND NOT EXISTS (SELECT 1 FROM d WHERE d.x = ins.x AND d.created_at <= ins.registered_at AND (d.dropped_at IS NULL OR d.dropped_at > ins.registered_at))
  UNION ALL
  SELECT 'runs.task_name', run_id, r.x, started_at, CASE WHEN k.name IS NULL THEN 'missing' ELSE 'late' END
  FROM r LEFT JOIN known k ON k.name = r.x WHERE r.x IS NOT NULL AND (k.name IS NULL OR k.registered_at > r.started_at))"""

ORACLE |= {
    "p5_found": f"WITH {_CASES} SELECT DISTINCT ref_field, ref_key, target FROM cases",
    "p5_counts": f"""WITH {_CASES} SELECT ref_field, strftime(happened, '%Y-%m') AS month, count(*) AS n,
count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) FILTER (reason = 'late') AS n_late
FROM cases GROUP BY 1, 2""",
}
