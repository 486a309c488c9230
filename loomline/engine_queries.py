"""Queries on the engine's own surface: task files, commands, settings, events, schedules, layouts of tables, functions in SQL.

Task files and the state of the command line are the driver's own files, here in a temporary folder of the driver.
"""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomline.cli import main
from loomline.engine.cron import Cron
from loomline.engine.dag import CycleError, build_dag
from loomline.engine.engine import Engine, EngineConfig
from loomline.engine.model import Task, TaskTest
from loomline.engine.openlineage import Emitter
from loomline.engine.taskfile import parse_task
from loomline.engine.templating import substitute
from loomline.operators import graph
from loomline.pipeline_queries import Bench, Query, _values
from loomline.sources.tables import table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(columns: str, rows: list[tuple] | None = None, sql: str | None = None):
    """Register a function of (spark, folder) that gives a DataFrame or tuples, with the rows or the SQL it must equal."""

    def register(f: Callable) -> Callable:
        def query(spark: SparkSession, d: str) -> DataFrame:
            found = f(spark, d)
            return found if isinstance(found, DataFrame) else spark.createDataFrame(found, ", ".join(f"{c} string" for c in columns.split()))

        QUERIES[f.__name__] = query
        if rows is not None or sql is not None:
            ORACLE[f.__name__] = sql or _values(columns, rows)
        return f

    return register


_FULL = """-- @task name=daily
-- @owner data_team
-- @description Revenue of a day
-- @incremental_by ordered_at
-- @inputs raw.a, raw.b
-- @outputs an.x
-- @depends_on first, second
-- @tags money,daily
-- @schedule "0 6 * * *"
-- @retries 2
-- @timeout 30
-- @test "SELECT 1" expect 1
SELECT 1
"""


@_query("field value", [
    ("name", "daily"), ("owner", "data_team"), ("description", "Revenue of a day"), ("incremental_by", "ordered_at"), ("inputs", "raw.a,raw.b"), ("outputs", "an.x"), ("depends_on", "first,second"),
    ("tags", "money,daily"), ("schedule", "0 6 * * *"), ("retries", "2"), ("timeout_seconds", "30"), ("tests", "SELECT 1 => expect 1"), ("sql", "SELECT 1"), ("fallback", "orders_clean"),
])
def taskfile_header(spark, d):
    """Every header of a task file, and the name of a file without any."""
    t = parse_task(_FULL, "tasks/other.sql").to_dict()
    text = lambda v: ",".join(v) if isinstance(v, (list, tuple)) else str(v).strip()
    tests = [f"{x['query']} => {x['assertion']}" for x in t.pop("tests")]
    keys = ("name", "owner", "description", "incremental_by", "inputs", "outputs", "depends_on", "tags", "schedule", "retries", "timeout_seconds", "sql")
    return [(k, text(t[k])) for k in keys] + [("tests", tests[0]), ("fallback", parse_task("SELECT 1", "a/b/orders_clean.sql").name)]


def _files(b: Bench, folder: str) -> None:
    at = Path(folder)
    (at / "deep" / "er").mkdir(parents=True)
    (at / "regions.sql").write_text(b.text("-- @task name=regions\nCREATE OR REPLACE TABLE {db}.regions AS SELECT r_regionkey AS k, r_name AS n FROM raw.region;"), encoding="utf-8")
    (at / "deep" / "er" / "nations.sql").write_text(
        b.text('-- @task name=nations\n-- @test "SELECT count(*) FROM {db}.nations" expect 25\n-- @test "SELECT 1" expect 2\nCREATE OR REPLACE TABLE {db}.nations AS SELECT n_name AS n, r.n AS r FROM raw.nation JOIN {db}.regions r ON r.k = n_regionkey'), encoding="utf-8")
    (at / "deep" / "broken.sql").write_text("-- @task name=broken\n-- @retries many\nSELECT 1", encoding="utf-8")
    (at / "notes.txt").write_text("no task", encoding="utf-8")


@_query("kind name detail", [("task", "nations", "{db}.regions -> {db}.nations"), ("task", "regions", "region -> {db}.regions"), ("error", "broken.sql", "1"), ("tests", "nations", "2"), ("gone", "regions", "nations")])
def register_folder(spark, d):
    """A folder with folders below it: tasks with inputs and outputs from their SQL, errors per file; and again after a file went."""
    b = Bench(spark, d)
    with tempfile.TemporaryDirectory() as folder:
        _files(b, folder)
        errors = b.engine.register(folder)
        short = lambda n: "region" if "region.parquet" in n else n.replace(b.db, "{db}")
        rows = [("task", t.name, f"{','.join(sorted(short(i) for i in t.inputs if 'nation.parquet' not in i))} -> {','.join(map(short, t.outputs))}") for t in b.engine.tasks()]
        rows += [("error", Path(x["file"]).name, str(len(errors))) for x in errors]
        rows.append(("tests", "nations", str(len(b.engine.state.rows("tests")))))
        (Path(folder) / "regions.sql").unlink()
        b.engine.register(folder)
    return [*rows, ("gone", "regions", ",".join(t.name for t in b.engine.tasks()))]


@_query("step result", [("init", "0"), ("register", "broken.sql"), ("run", "nations:success:25,regions:success:5"), ("test", "0:true,1:false"), ("visualize", "graph LR"), ("state", "2")])
def pragma_commands(spark, d):
    """PRAGMA orch_init, orch_register, orch_run, orch_test and orch_visualize, and state tables read by SQL."""
    b = Bench(spark, d)
    e = b.engine
    with tempfile.TemporaryDirectory() as folder:
        _files(b, folder)
        e.sql("PRAGMA orch_init")
        out = [("init", str(e.sql("SELECT count(*) AS n FROM __orch__.tasks").first().n))]
        out.append(("register", ",".join(Path(r.file).name for r in e.sql(f"PRAGMA orch_register('{folder}')").collect())))
        out.append(("run", ",".join(sorted(f"{r.task_name}:{r.status}:{r.rows_count}" for r in e.sql("PRAGMA orch_run").collect()))))
        out.append(("test", ",".join(f"{r.test_idx}:{str(r.passed).lower()}" for r in e.sql("PRAGMA orch_test").collect())))
        out.append(("visualize", e.sql("PRAGMA orch_visualize('dag')").first()[0].splitlines()[0]))
        out.append(("state", str(e.sql("SELECT count(*) AS n FROM __orch__.runs WHERE status = 'success'").first().n)))
    return out


@_query("command code said", [
    ("validate", "0", "daily"), ("register", "1", "nations regions"), ("run", "0", "nations regions"), ("status", "0", "nations regions"), ("graph dag", "0", "graph LR"), ("test", "1", "nations"), ("impact", "0", "nations"),
    ("lineage", "0", "nations regions"), ("schedule add", "0", ""), ("schedule add bad", "2", ""), ("schedule list", "0", "nations"), ("schedule run-due", "0", "nations"), ("unregister", "0", ""), ("unregister again", "2", ""),
])
def command_line(spark, d):
    """Every command with its exit code and the tasks that its output names."""
    b = Bench(spark, d)
    with tempfile.TemporaryDirectory() as folder:
        _files(b, folder)
        single = Path(folder) / "single.txt"
        single.write_text(_FULL, encoding="utf-8")

        def call(label: str, *args: str) -> tuple[str, str, str]:
            out = io.StringIO()
            with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
                code = main(["--json", *args], b.engine)
            text = out.getvalue()
            names = "daily" if label == "validate" else text.split("\n")[0] if label.startswith("graph") else " ".join(n for n in ("nations", "regions") if f'"{n}"' in text or text.strip() == n)
            return label, str(code), names

        return [
            call("validate", "validate", str(single)), call("register", "register", folder), call("run", "run"), call("status", "status"), call("graph dag", "graph", "dag"), call("test", "test"),
            call("impact", "impact", f"{b.db}.regions"), call("lineage", "lineage", f"{b.db}.nations"), call("schedule add", "schedule", "add", "nations", "0 6 * * *"), call("schedule add bad", "schedule", "add", "nations", "61 * * * *"),
            call("schedule list", "schedule", "list"), call("schedule run-due", "schedule", "run-due"), call("unregister", "unregister", "nations"), call("unregister again", "unregister", "nations"),
        ]


@_query("setting value", [("capture_interactive", "True"), ("max_parallel", "3"), ("namespace", "prod"), ("openlineage_api_key", "k"), ("openlineage_debug", "True"), ("openlineage_url", "http://x"), ("emitter", "http://x k True"), ("unknown", "ValueError")])
def settings(spark, d):
    """SET orch_<setting> = value."""
    e = Engine(spark, EngineConfig())
    for text in ("openlineage_url = 'http://x'", "openlineage_api_key = 'k'", "openlineage_debug = true", "namespace = 'prod'", "max_parallel = 3", "capture_interactive = true"):
        e.sql(f"SET orch_{text}")
    try:
        e.sql("SET orch_no_such = 1")
        unknown = "taken"
    except ValueError as x:
        unknown = type(x).__name__
    out = [(k, str(getattr(e.config, k))) for k in ("capture_interactive", "max_parallel", "namespace", "openlineage_api_key", "openlineage_debug", "openlineage_url")]
    return [*out, ("emitter", f"{e.emitter.url} {e.emitter.api_key} {e.emitter.debug}"), ("unknown", unknown)]


@_query("src_column dst_column kind subtype", [("n_name", "name", "DIRECT", "IDENTITY"), ("n_regionkey", "name", "INDIRECT", "FILTER"), ("n_regionkey", "twice", "DIRECT", "TRANSFORMATION")])
def capture_interactive(spark, d):
    """Ad-hoc statements leave their column lineage; queries and short texts leave none."""
    b = Bench(spark, d, capture_interactive=True)
    b.engine.sql(b.text("CREATE TABLE {db}.src AS SELECT n_name, n_regionkey FROM raw.nation"))
    b.engine.state.delete("column_lineage", lambda r: True)
    b.engine.sql(b.text("CREATE TABLE {db}.t AS SELECT n_name AS name, n_regionkey * 2 AS twice FROM {db}.src WHERE n_regionkey > 1"))
    b.engine.sql(b.text("SELECT n_name FROM {db}.src WHERE n_regionkey > 1"))
    return b.engine.frame("column_lineage").selectExpr("src_column", "dst_column", "transform_kind AS kind", "subtype")


@_query("src_column dst_column kind subtype", [("k", "k", "DIRECT", "IDENTITY"), ("", "one", "INDIRECT", "TRANSFORMATION")])
def column_lineage_stored(spark, d):
    """A run keeps the lineage of its columns; a column that no input explains has a placeholder."""
    b = Bench(spark, d)
    b.add("first", "CREATE OR REPLACE TABLE {db}.a AS SELECT r_regionkey AS k FROM raw.region", ("{db}.a",))
    b.add("second", "CREATE OR REPLACE TABLE {db}.b AS SELECT k, 1 AS one FROM {db}.a", ("{db}.b",))
    b.engine.run()
    return b.engine.frame("column_lineage").where("via_task = 'second'").selectExpr("src_column", "dst_column", "transform_kind AS kind", "subtype")


@_query("job event inputs outputs parent error columns", [
    ("good", "START", "1", "1", "true", "false", "0"), ("good", "COMPLETE", "1", "1", "true", "false", "2"), ("bad", "START", "1", "1", "true", "false", "0"), ("bad", "FAIL", "1", "1", "true", "true", "0"),
])
def openlineage_events(spark, d):
    """The events of two runs, caught where they would be posted."""
    b, caught = Bench(spark, d), []
    b.engine.emitter = Emitter("memory:", send=lambda url, key, body: caught.append(json.loads(body)))
    b.add("good", "CREATE OR REPLACE TABLE {db}.a AS SELECT r_regionkey AS k, r_name AS n FROM raw.region", ("{db}.a",), inputs=("raw_region",))
    b.add("bad", "CREATE OR REPLACE TABLE {db}.b AS SELECT no_such FROM {db}.a", ("{db}.b",))
    b.engine.run()
    b.engine.emitter.flush()
    flag = lambda x: str(bool(x)).lower()
    out = []
    for x in caught:
        facets = x["run"]["facets"]
        columns = x["outputs"][0].get("facets", {}).get("columnLineage", {}).get("fields", {})
        out.append((x["job"]["name"], x["eventType"], str(len(x["inputs"])), str(len(x["outputs"])), flag("parent" in facets), flag("errorMessage" in facets), str(len(columns))))
    return out


@_query("state detail", [("no url", "1"), ("attempts", "3"), ("full", "dropped"), ("namespace", "s3://lake")])
def openlineage_transport(spark, d):
    """Nothing is queued without an address; three attempts; a full queue drops; a database's data_path is the namespace."""
    tries: list[str] = []

    def refuse(url, key, body):
        tries.append(url)
        raise OSError("refused")

    out = [("no url", str(Emitter().emit({})))]
    e = Emitter("memory:", send=refuse, pause=0.0)
    e.emit({"a": 1})
    e.flush()
    out.append(("attempts", str(len(tries))))
    full = Emitter("memory:", send=lambda *a: __import__("time").sleep(0.5), capacity=1)
    out.append(("full", "dropped" if max(full.emit({"n": n}) for n in range(5)) else "kept"))
    b = Bench(spark, d)
    spark.sql(f"ALTER DATABASE {b.db} SET DBPROPERTIES ('data_path' = 's3://lake/')")
    return [*out, ("namespace", b.engine._namespace(f"{b.db}.t"))]


@_query("cron next", [
    ("*/15 * * * *", "2024-02-28 23:45:00"), ("0 6 * * *", "2024-02-29 06:00:00"), ("0 0 1 * *", "2024-03-01 00:00:00"), ("30 4 * * 1-5", "2024-02-29 04:30:00"), ("0 12 29 2 *", "2024-02-29 12:00:00"), ("5,10 23 * * 0", "2024-03-03 23:05:00"),
])
def cron_next(spark, d):
    """The next time of an expression after 2024-02-28 23:31:10."""
    at = datetime(2024, 2, 28, 23, 31, 10)
    return [(x, str(Cron(x).next_after(at, "UTC").replace(tzinfo=None))) for x in ("*/15 * * * *", "0 6 * * *", "0 0 1 * *", "30 4 * * 1-5", "0 12 29 2 *", "5,10 23 * * 0")]


@_query("round ran", [("1", "all"), ("2", ""), ("3", "all")])
def schedule_due(spark, d):
    """A schedule is due at once, then at its next time."""
    b = Bench(spark, d)
    b.add("t", "SELECT 1")
    b.engine.schedule_add("all", "0 6 * * *")
    first = datetime(2100, 1, 1, 5)
    return [(str(k), ",".join(b.engine.run_due(at))) for k, at in enumerate((first, datetime(2100, 1, 1, 5, 30), datetime(2100, 1, 1, 6)), 1)]


@_query("call result", [
    ("hello", "hello world from loomline"), ("extract_io", '{"inputs": ["a"], "outputs": ["t"]}'), ("parse_task", "daily"), ("build_dag", '["a","b"]'), ("topo_layers", '[["a"], ["b"]]'), ("downstream_of", '["b"]'), ("render_mermaid", "graph LR"),
    ("substitute_vars", "SELECT 5"), ("load_directory", "nations,regions"), ("column", "hello ASIA from loomline"),
])
def functions_in_sql(spark, d):
    """The functions, each called in a statement."""
    b = Bench(spark, d)
    tasks = '[{"name": "a", "outputs": ["x"]}, {"name": "b", "inputs": ["x"]}]'
    one = lambda sql: b.engine.sql(sql).first()[0]
    out = [("hello", one("SELECT orch_hello('world')")), ("extract_io", one("SELECT orch_extract_io('INSERT INTO t SELECT x FROM a WHERE s = ''q''')"))]
    out.append(("parse_task", one("SELECT get_json_object(orch_parse_task('-- @task name=daily\nSELECT 1', 'f.sql'), '$.name')")))
    out.append(("build_dag", one(f"SELECT get_json_object(orch_build_dag('{tasks}'), '$.order')")))
    out.append(("topo_layers", one(f"SELECT orch_topo_layers('{tasks}')")))
    out.append(("downstream_of", one(f"SELECT orch_downstream_of('{tasks}', 'a')")))
    out.append(("render_mermaid", one(f"SELECT split(orch_render_mermaid(orch_build_dag('{tasks}'), 1, '[]'), '\n')[0]")))
    out.append(("substitute_vars", one("SELECT orch_substitute_vars('SELECT {{ n }}', '{\"n\": \"5\"}')")))
    with tempfile.TemporaryDirectory() as folder:
        _files(b, folder)
        out.append(("load_directory", ",".join(sorted(t["name"] for t in json.loads(one(f"SELECT orch_load_directory_json('{folder}')"))["tasks"]))))
    return [*out, ("column", b.engine.sql(b.text("SELECT orch_hello(r_name) AS h FROM raw.region WHERE r_name = 'ASIA'")).first().h)]


@_query("text filled", [("SELECT {{ n }}", "SELECT 5"), ("WHERE t > {{last_processed_at}}", "WHERE t > '2024-01-01 00:00:00'"), ("x = {{ q }}", "x = 'it''s'"), ("{{ unknown }}", "{{ unknown }}"), ("open {{ n", "open {{ n")])
def templating(spark, d):
    values = {"n": "5", "last_processed_at": "2024-01-01 00:00:00", "q": "it's"}
    return [(t, substitute(t, values)) for t in ("SELECT {{ n }}", "WHERE t > {{last_processed_at}}", "x = {{ q }}", "{{ unknown }}", "open {{ n")]


@_query("what names", [("order", "c,b,a"), ("cycle", "x,y")])
def toposort_and_cycle(spark, d):
    """Upstream tasks come first; the tasks of a cycle are named."""
    chain = [Task("a", inputs=("2",)), Task("b", inputs=("1",), outputs=("2",)), Task("c", outputs=("1",))]
    try:
        build_dag([Task("x", inputs=("1",), outputs=("2",)), Task("y", inputs=("2",), outputs=("1",))])
        names = "none"
    except CycleError as e:
        names = ",".join(sorted(e.names))
    return [("order", ",".join(build_dag(chain).order)), ("cycle", names)]


@_query("event_id", sql="SELECT event_id FROM events")
def integer_watermark(spark, d):
    """A task that goes by an integer column: two loads and an idle run add up to the table."""
    b = Bench(spark, d)
    spark.sql(b.text("CREATE TABLE {db}.src AS SELECT event_id FROM raw.events WHERE event_id % 2 = 0 OR event_id < 100"))
    spark.sql(b.text("CREATE TABLE {db}.log (event_id BIGINT) USING parquet"))
    b.add("load", "INSERT INTO {db}.log SELECT event_id FROM {db}.src WHERE event_id > {{ last_processed_at }}", ("{db}.log",), incremental_by="event_id")
    spark.sql(b.text("CREATE OR REPLACE TEMP VIEW half_{db} AS SELECT percentile_approx(event_id, 0.5) AS m FROM raw.events"))
    spark.sql(b.text("CREATE TABLE {db}.low AS SELECT event_id FROM raw.events WHERE event_id <= (SELECT m FROM half_{db})"))
    b.engine.add([Task("load", sql=b.text("INSERT INTO {db}.log SELECT event_id FROM {db}.low WHERE event_id > {{ last_processed_at }}"), outputs=(b.text("{db}.log"),), incremental_by="event_id")])
    b.engine.run()
    spark.sql(b.text("INSERT INTO {db}.low SELECT event_id FROM raw.events WHERE event_id > (SELECT m FROM half_{db})"))
    b.engine.run()
    b.engine.run()
    return b.table("log")


@_query("event_id n", sql="SELECT event_id, CAST(1 AS BIGINT) AS n FROM events")
def failing_test_after_insert(spark, d):
    """A test that fails after the body was written doesn't make the next run write it again; nor does a retry of a script whose
    second statement failed."""
    b = Bench(spark, d, test_after_run=True)
    spark.sql(b.text("CREATE TABLE {db}.log AS SELECT event_id, ts FROM raw.events WHERE false"))
    late = "SELECT percentile_approx(CAST(ts AS TIMESTAMP), 0.5) FROM raw.events"
    body = f"INSERT INTO {{db}}.log SELECT event_id, ts FROM raw.events WHERE ts > {{{{ last_processed_at }}}} AND ts <= ({late}); SELECT 1 / count(*) FROM {{db}}.gate"
    spark.sql(b.text("CREATE TABLE {db}.gate (k INT) USING parquet"))
    b.add("load", body, ("{db}.log",), incremental_by="ts", tests=(TaskTest("SELECT 1", "expect 2"),), retries=1)
    execute, tries = b.engine._execute, []

    def opening(*a) -> None:
        tries.append(1)
        if len(tries) == 2:
            spark.sql(b.text("INSERT INTO {db}.gate VALUES (1)"))
        execute(*a)

    b.engine._execute = opening
    b.engine.run()
    b.add("load", "INSERT INTO {db}.log SELECT event_id, ts FROM raw.events WHERE ts > {{ last_processed_at }}", ("{db}.log",), incremental_by="ts", tests=(TaskTest("SELECT 1", "expect 2"),))
    b.engine.run()
    b.engine.run()
    return b.table("log").groupBy("event_id").count().withColumnRenamed("count", "n")


def _layout_of(b: Bench, name: str) -> list[tuple[str, str]]:
    rows = {r.col_name: r.data_type for r in b.spark.sql(f"DESCRIBE TABLE EXTENDED {b.db}.{name}").collect()}
    parts = b.spark.sql(f"SHOW PARTITIONS {b.db}.{name}").count()
    owner = b.spark.sql(f"SHOW TBLPROPERTIES {b.db}.{name} ('owner_team')").first()["value"]
    note = b.spark.table(f"{b.db}.{name}").schema["v"].metadata.get("comment", "")
    return [("provider", rows["Provider"].lower()), ("comment", rows["Comment"]), ("partitions", str(parts)), ("owner_team", owner), ("column comment", note), ("rows", str(b.table(name).count()))]


@_query("what value", [("provider", "orc"), ("comment", "it's kept"), ("partitions", "5"), ("owner_team", "x"), ("column comment", "a name"), ("rows", "20")])
def layout_after_changes(spark, d):
    """UPDATE, DELETE, MERGE and INSERT OR REPLACE leave format, partitions, comments and properties of a table."""
    b = Bench(spark, d)
    e = b.engine
    e.sql(b.text("CREATE TABLE {db}.t (k INT COMMENT 'a key', v STRING COMMENT 'a name', r INT) USING orc PARTITIONED BY (r) COMMENT \"it's kept\" TBLPROPERTIES ('owner_team' = 'x', 'primary_key' = 'k')"))
    e.sql(b.text("INSERT INTO {db}.t SELECT CAST(n_nationkey AS INT), n_name, CAST(n_regionkey AS INT) FROM raw.nation"))
    e.sql(b.text("UPDATE {db}.t SET v = lower(v) WHERE r = 1"))
    e.sql(b.text("DELETE FROM {db}.t WHERE k >= 20"))
    e.sql(b.text("MERGE INTO {db}.t AS t USING (SELECT 3 AS k, 'x' AS v) AS s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v"))
    e.sql(b.text("INSERT OR REPLACE INTO {db}.t (k, v, r) VALUES (3, 'y', 1)"))
    e.sql(b.text("UPDATE {db}.t AS t SET v = concat(t.v, s.w) FROM (SELECT 3 AS k, '!' AS w) AS s WHERE t.k = s.k"))
    if b.table("t").where("k = 3 AND v = 'y!'").count() != 1:
        raise RuntimeError("the change is not there")
    return _layout_of(b, "t")


@_query("what value", [("provider", "orc"), ("comment", "note"), ("partitions", "5"), ("owner_team", "x"), ("rows", "25")])
def layout_of_ctas(spark, d):
    """All clauses of CREATE TABLE AS stay."""
    b = Bench(spark, d)
    b.engine.sql(b.text("CREATE OR REPLACE TABLE {db}.t USING orc OPTIONS ('compression' = 'zlib') PARTITIONED BY (r) COMMENT 'note' TBLPROPERTIES ('owner_team' = 'x') AS SELECT n_nationkey AS k, n_name AS v, n_regionkey AS r FROM raw.nation"))
    return [x for x in _layout_of(b, "t") if x[0] != "column comment"]


@_query("k v", sql="SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN 'three' WHEN c_custkey % 2 = 0 THEN n_name ELSE c_name END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey <> 4 OR c_custkey % 2 = 0")
def changes_of_a_partitioned_table(spark, d):
    """Rows after UPDATE ... FROM, DELETE and UPDATE of a partitioned ORC table."""
    b = Bench(spark, d)
    e = b.engine
    e.sql(b.text("CREATE TABLE {db}.t USING orc PARTITIONED BY (n) AS SELECT c_custkey AS k, c_name AS v, c_nationkey AS n FROM raw.customer"))
    e.sql(b.text("UPDATE {db}.t AS t SET v = s.n_name FROM raw.nation AS s WHERE t.n = s.n_nationkey AND t.k % 2 = 0"))
    e.sql(b.text("DELETE FROM {db}.t WHERE n = 4 AND k % 2 <> 0"))
    e.sql(b.text("UPDATE {db}.t SET v = 'three' WHERE n = 3"))
    return b.table("t").select("k", "v")


@_query("k v", sql="SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS v FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_nationkey % 3 = 0")
def insert_or_replace(spark, d):
    """Rows with a key that is there take its place, others are added."""
    b = Bench(spark, d)
    b.add("t", "CREATE TABLE {db}.t USING parquet TBLPROPERTIES ('primary_key' = 'k') AS SELECT n_nationkey AS k, n_name AS v FROM raw.nation; INSERT OR REPLACE INTO {db}.t SELECT n_nationkey AS k, lower(n_name) AS v FROM raw.nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey + 100, n_name FROM raw.nation WHERE n_nationkey % 3 = 0", ("{db}.t",))
    failed = b.engine.run().where("status <> 'success'").collect()
    if failed:
        raise RuntimeError(failed[0].error_message)
    return b.table("t")


@_query("kind n", sql="SELECT 'csv' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'json', count(*) FROM nation UNION ALL SELECT 'orc', count(*) FROM nation UNION ALL SELECT 'parquet', count(*) FROM nation")
def file_readers(spark, d):
    """read_csv, read_json, read_orc and read_parquet in a statement, over files written before."""
    from loomline.session import scratch_path

    b, out = Bench(spark, d), None
    for kind in ("csv", "json", "orc", "parquet"):
        path = scratch_path(spark, kind)
        table(spark, d, "nation").write.format(kind).save(path)
        one = b.engine.sql(f"SELECT '{kind}' AS kind, count(*) AS n FROM read_{kind}('{path}')")
        out = one if out is None else out.unionByName(one)
    return out


@_query("task_name rows_count edges", [("first", "5", "1"), ("second", "5", "2")])
def run_records(spark, d):
    """The rows that each run counts and the edges that stay after it; a task that went takes its edges with it."""
    b = Bench(spark, d)
    b.add("first", "CREATE OR REPLACE TABLE {db}.a AS SELECT r_regionkey AS k FROM raw.region", ("{db}.a",), inputs=("src",))
    b.add("second", "CREATE OR REPLACE TABLE {db}.b AS SELECT k FROM {db}.a", ("{db}.b",), inputs=(b.text("{db}.a"), "other"))
    rows = {r.task_name: r.rows_count for r in b.engine.run().collect()}
    edges = [r.via_task for r in b.engine.frame("lineage_edges").collect()]
    return [(n, str(rows[n]), str(edges.count(n))) for n in ("first", "second")]


@_query("upstream downstream")
def tasks_edges(spark, d):
    """Edges between all tasks of the table."""
    return graph.task_edges(table(spark, d, "tasks"))


@_query("src_dataset dst_dataset via_task")
def tasks_lineage(spark, d):
    """Edges between all datasets that tasks of the table read and write."""
    return graph.lineage_edges(table(spark, d, "tasks"))


@_query("lines edges")
def tasks_mermaid(spark, d):
    """The graph of all tasks of the table as text: its lines and edges, whose number goes with that of the tasks."""
    tasks = table(spark, d, "tasks")
    edges = graph.lineage_edges(tasks)
    return edges.selectExpr("concat('    ', replace(replace(src_dataset, '.', '_'), '-', '_'), '[(', src_dataset, ')] --> ', replace(replace(dst_dataset, '.', '_'), '-', '_'), '[(', dst_dataset, ')]') AS line").distinct()


_N = "nullif(lower(trim({}, ' \t\r\n')), '')"
_T = f"""t AS (SELECT {_N.format('name')} AS name, inputs, outputs, depends_on FROM tasks),
i AS (SELECT DISTINCT name, {_N.format('u.x')} AS d FROM t, unnest(t.inputs) AS u(x)),
o AS (SELECT DISTINCT name, {_N.format('u.x')} AS d FROM t, unnest(t.outputs) AS u(x)),
p AS (SELECT DISTINCT name, {_N.format('u.x')} AS d FROM t, unnest(t.depends_on) AS u(x))"""
ORACLE |= {
    "tasks_edges": f"WITH {_T} SELECT DISTINCT upstream, downstream FROM (SELECT o.name AS upstream, i.name AS downstream FROM i JOIN o ON i.d = o.d UNION ALL SELECT t.name, p.name FROM p JOIN t ON t.name = p.d) WHERE upstream <> downstream",
    "tasks_lineage": f"WITH {_T} SELECT DISTINCT i.d AS src_dataset, o.d AS dst_dataset, i.name AS via_task FROM i JOIN o ON i.name = o.name WHERE i.d IS NOT NULL AND o.d IS NOT NULL AND i.d <> o.d",
    "tasks_mermaid": f"WITH {_T} SELECT DISTINCT '    ' || replace(replace(i.d, '.', '_'), '-', '_') || '[(' || i.d || ')] --> ' || replace(replace(o.d, '.', '_'), '-', '_') || '[(' || o.d || ')]' AS line FROM i JOIN o ON i.name = o.name WHERE i.d IS NOT NULL AND o.d IS NOT NULL AND i.d <> o.d",
}
