import json
import time
import uuid
from datetime import datetime

import pytest

from loomline.cli import main
from loomline.engine import mermaid
from loomline.engine.cron import Cron, CronError
from loomline.engine.dag import CycleError, build_dag, closure, downstream_of, topo_layers
from loomline.engine.dialect import DialectError, shim, statements
from loomline.engine.engine import Engine, EngineConfig
from loomline.engine.model import LineageEdge, Task, TaskTest
from loomline.engine.openlineage import Emitter
from loomline.engine.state import StateStore
from loomline.engine.taskfile import TaskError, load_directory, parse_task
from loomline.engine.templating import substitute
from loomline.functions import scalars
from loomline.plans.columns import extract_column_lineage
from loomline.plans.io import extract_io


@pytest.fixture
def db(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


# task files


def test_header(spark):
    t = parse_task(
        '-- @task name=a owner=x\n--  @description raw_x を\n-- @inputs p.q, , r\n\n-- @retries 2\n-- @timeout 5\n-- @tags x,y\n-- @schedule "0 6 * * *"\n-- @test "SELECT 1" expect 1\n-- @odd z\n-- plain\n-- @owner late\nSELECT 1\n',
        "d/f.sql",
    )
    assert (t.name, t.inputs, t.retries, t.timeout_seconds, t.tags, t.schedule, t.owner) == ("a", ("p.q", "r"), 2, 5, ("x", "y"), "0 6 * * *", None)
    assert t.description == "raw_x を" and t.tests == (TaskTest("SELECT 1", "expect 1"),)
    assert t.sql.startswith("-- plain") and t.sql.endswith("SELECT 1")
    assert parse_task("SELECT 1", "d/f.sql").name == "f"
    for bad in ("-- @task name=a\n-- @retries x", '-- @name a\n-- @test "SELECT 1', "-- @name a\n-- @test SELECT", "SELECT 1"):
        with pytest.raises(TaskError):
            parse_task(bad)


def test_load_directory(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.sql").write_text("INSERT INTO y SELECT * FROM x")
    (tmp_path / "b" / "c.sql").write_text("-- @retries no\nSELECT 1")
    (tmp_path / "b" / "d.SQL").write_text("SELECT 1")
    (tmp_path / "b" / "e.sql").write_text("-- @name a\nSELECT 2")
    tasks, errors = load_directory(str(tmp_path), lambda s: extract_io(spark, s))
    assert [t.name for t in tasks] == ["a"] and len(errors) == 2
    assert json.loads(scalars.load_directory_json(spark, str(tmp_path)))["errors"]


def test_templating():
    assert substitute("t > {{ last_processed_at }}", {"last_processed_at": "2024-01-01 00:00:00"}) == "t > '2024-01-01 00:00:00'"
    assert substitute("SELECT {{ unknown }}, {{a}}, {{b}}, {{ c", {"a": "1.5", "b": "it's", "c": "x"}) == "SELECT {{ unknown }}, 1.5, 'it''s', {{ c"
    assert substitute("{{ q }} é", {"q": "'x'"}) == "'x' é"


# plans


@pytest.mark.parametrize(
    ("sql", "inputs", "outputs"),
    [
        ("INSERT INTO clean SELECT * FROM raw WHERE deleted = false", ["raw"], ["clean"]),
        ("CREATE OR REPLACE TABLE analytics.user_stats AS SELECT country, count(*) n FROM analytics.clean_users GROUP BY 1", ["analytics.clean_users"], ["analytics.user_stats"]),
        ("INSERT INTO x SELECT * FROM a JOIN b ON a.id = b.id", ["a", "b"], ["x"]),
        ("CREATE VIEW v AS SELECT 1 FROM t", ["t"], ["v"]),
        ("UPDATE t SET a = (SELECT max(x) FROM u)", ["t", "u"], ["t"]),
        ("WITH a AS (SELECT * FROM t), b AS (SELECT * FROM a) SELECT * FROM b UNION ALL SELECT * FROM c", ["c", "t"], []),
        ("SELECT * FROM a WHERE x IN (SELECT y FROM z)", ["a", "z"], []),
        ("SELECT * FROM (SELECT * FROM a) s, LATERAL (SELECT * FROM b WHERE b.x = s.x)", ["a", "b"], []),
        ("CREATE TABLE t AS SELECT * FROM s WHERE e > {{ last_processed_at }}; INSERT INTO u SELECT * FROM t", ["s", "t"], ["t", "u"]),
        ("SELECT FROM WHERE (", [], []),
    ],
)
def test_extract_io(spark, sql, inputs, outputs):
    assert extract_io(spark, sql) == {"inputs": inputs, "outputs": outputs}


def test_extract_io_of_null(spark):
    assert extract_io(spark, None) is None


def _roles(extract, column):
    c = next(c for c in extract.columns if c.output_field == column)
    return {(i.dataset, i.field): {t.subtype for t in i.transformations} for i in c.inputs}


def test_column_lineage(spark):
    one = lambda sql, **s: extract_column_lineage(spark, sql, s)[0]
    x = one("SELECT id, UPPER(name) AS upname FROM users", users=["id", "name"])
    assert _roles(x, "id") == {("users", "id"): {"IDENTITY"}} and _roles(x, "upname") == {("users", "name"): {"TRANSFORMATION"}}
    x = one("SELECT country, COUNT(*) AS n, SUM(v) s FROM c WHERE d > 1 GROUP BY country ORDER BY e", c=["country", "v", "d", "e"])
    assert _roles(x, "country") == {("c", "country"): {"IDENTITY"}, ("c", "d"): {"FILTER"}, ("c", "e"): {"SORT"}}
    assert _roles(x, "n") == {("c", "country"): {"GROUP_BY"}, ("c", "d"): {"FILTER"}, ("c", "e"): {"SORT"}}
    assert _roles(x, "s")[("c", "v")] == {"AGGREGATION"}
    x = one("SELECT u.country, o.amount FROM users u JOIN orders o ON u.id = o.user_id")
    assert _roles(x, "amount") == {("orders", "amount"): {"IDENTITY"}, ("users", "id"): {"JOIN_KEY"}, ("orders", "user_id"): {"JOIN_KEY"}}
    x = one("SELECT * FROM users")
    assert x.unresolved_wildcards == ["users"] and x.columns[0].unresolved
    assert [c.output_field for c in one("SELECT * FROM users", users=["id", "name"]).columns] == ["id", "name"]
    x = one("WITH q AS (SELECT a + 1 AS b FROM t) INSERT INTO z SELECT b, row_number() OVER (ORDER BY b) rn, sum(b) OVER () w FROM q")
    assert x.output_dataset == "z" and _roles(x, "b") == {("t", "a"): {"TRANSFORMATION"}} and _roles(x, "rn") == {} and _roles(x, "w") == {("t", "a"): {"AGGREGATION"}}
    x = one("SELECT a FROM t UNION ALL SELECT b FROM u")
    assert _roles(x, "a") == {("t", "a"): {"IDENTITY"}, ("u", "b"): {"IDENTITY"}}
    x = one("SELECT CASE WHEN a > 1 THEN b ELSE c END k, lag(d) OVER (PARTITION BY e ORDER BY f) l FROM s.t")
    assert set(_roles(x, "k")) == {("s.t", "a"), ("s.t", "b"), ("s.t", "c")} and _roles(x, "l") == {("s.t", "d"): {"WINDOW"}}
    assert extract_column_lineage(spark, "UPDATE t SET a = 1") == [] and extract_column_lineage(spark, "SELECT (") == []


def test_sample_pipeline_lineage(spark):
    """The sample pipeline: GROUP BY 1, 2 counts as grouping by the columns it names."""
    s = {"raw.users": ["id", "name", "country", "created_at", "deleted_at"], "raw.orders": ["id", "user_id", "amount", "ordered_at"], "a.clean_users": ["id", "name", "country", "created_at"], "a.clean_orders": ["id", "user_id", "amount", "ordered_at"]}
    one = lambda sql: extract_column_lineage(spark, sql, s)[0]
    x = one("CREATE OR REPLACE TABLE a.clean_users AS SELECT id, name, country, created_at FROM raw.users WHERE deleted_at IS NULL")
    for c in ("id", "name", "country", "created_at"):
        assert _roles(x, c) == {("raw.users", c): {"IDENTITY"}, ("raw.users", "deleted_at"): {"FILTER"}}
    x = one("CREATE OR REPLACE TABLE a.clean_orders AS SELECT id, user_id, amount, ordered_at FROM raw.orders WHERE amount > 0")
    assert _roles(x, "amount") == {("raw.orders", "amount"): {"IDENTITY"}} and _roles(x, "id")[("raw.orders", "amount")] == {"FILTER"}
    x = one("CREATE OR REPLACE TABLE a.user_stats AS SELECT country, COUNT(*) AS users FROM a.clean_users GROUP BY country")
    assert _roles(x, "country") == {("a.clean_users", "country"): {"IDENTITY"}} and _roles(x, "users") == {("a.clean_users", "country"): {"GROUP_BY"}}
    x = one("CREATE OR REPLACE TABLE a.revenue_daily AS SELECT DATE_TRUNC('day', o.ordered_at) AS day, u.country, SUM(o.amount) AS revenue FROM a.clean_orders o JOIN a.clean_users u ON u.id = o.user_id GROUP BY 1, 2")
    keys = {("a.clean_users", "id"): {"JOIN_KEY"}, ("a.clean_orders", "user_id"): {"JOIN_KEY"}}
    assert _roles(x, "day") == {("a.clean_orders", "ordered_at"): {"TRANSFORMATION"}, ("a.clean_users", "country"): {"GROUP_BY"}} | keys
    assert _roles(x, "revenue")[("a.clean_orders", "amount")] == {"AGGREGATION"} and keys.items() <= _roles(x, "revenue").items()


# graph


def test_dag():
    a, b, c = Task("a", outputs=("X",)), Task("b", inputs=("X",), outputs=("Y",)), Task("c", inputs=("Y", "Y"), outputs=("Z", "Y"), depends_on=("a", "nobody"))
    dag = build_dag([c, b, a])
    assert [(e.upstream, e.downstream) for e in dag.task_edges] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert topo_layers([c, b, a]) == [["a"], ["b"], ["c"]] and downstream_of([c, b, a], "a") == ["b", "c"]
    assert len(dag.lineage_edges) == 5 and LineageEdge("Y", "Y", "c") in dag.lineage_edges
    loop = [Task("a", inputs=("Z",), outputs=("X",)), Task("b", inputs=("X",), outputs=("Z",))]
    with pytest.raises(CycleError):
        build_dag(loop)
    with pytest.raises(CycleError):
        build_dag([Task("a", depends_on=("a",))])
    assert downstream_of(loop, "a") == []
    assert closure(dag.lineage_edges, "X") == [("Y", "b"), ("Y", "c"), ("Z", "c")]
    assert closure(dag.lineage_edges, "Z", up=True) == [("X", "b"), ("Y", "c")]


def test_random_dags():
    import random

    r = random.Random(3)
    for n in (1, 10, 300):
        tasks = [Task(f"t{i}", outputs=(f"d{i}",), inputs=tuple(f"d{r.randrange(i)}" for _ in range(r.randrange(4)) if i)) for i in range(n)]
        r.shuffle(tasks)
        layers = topo_layers(tasks)
        level = {t: k for k, layer in enumerate(layers) for t in layer}
        edges = build_dag(tasks).task_edges
        assert sorted(level) == sorted(t.name for t in tasks) and all(level[e.upstream] < level[e.downstream] for e in edges)
        assert all(layer == sorted(layer) for layer in layers)


def test_mermaid():
    dag = build_dag([Task("a", inputs=("r.x",), outputs=("s.y",)), Task("b", inputs=("s.y", "s.y"), outputs=("q",))])
    text = mermaid.render(dag, mermaid.COMBINED, [("a", "success"), ("b", "test_failed"), ("c", "odd")], {"a": ("s.y",)})
    assert text.splitlines() == [
        "graph LR", "    r_x[(r.x)] --> s_y[(s.y)]", "    s_y[(s.y)] --> q[(q)]", "    a_task --> b_task", "    classDef success fill:#cfc,stroke:#393", "    classDef failed  fill:#fcc,stroke:#933",
        "    classDef running fill:#ffc,stroke:#993", "    classDef skipped fill:#eee,stroke:#999", "    class a_task success", "    class s_y success", "    class b_task failed",
    ]
    assert mermaid.render(dag, mermaid.DAG) == "graph LR\n    a_task --> b_task\n" and mermaid.node_id("été-1.x") == "été_1_x"


# dialect


def test_shim(spark):
    ok = {
        "SELECT x::VARCHAR, CAST(y AS VARCHAR) FROM t": "SELECT x::STRING, CAST(y AS STRING) FROM t",
        "SELECT list(x) FROM read_parquet('a/b.parquet')": "SELECT array_agg(x) FROM parquet.`a/b.parquet`",
        "SELECT * EXCLUDE (a) FROM t": "SELECT * EXCEPT (a) FROM t",
        "SELECT ['a', [1]], x[1], {'k': 1, j: [2]} FROM t": "SELECT array('a', array(1)), x[1], named_struct('k', 1, 'j', array(2)) FROM t",
        "SELECT 'x::VARCHAR [1]' -- list(x)\n FROM t": "SELECT 'x::VARCHAR [1]' -- list(x)\n FROM t",
        "SELECT a.x FROM a RIGHT SEMI JOIN b ON a.k = b.k": None,
    }
    for text, wanted in ok.items():
        got = shim(text)
        if wanted:
            assert got == wanted
    assert "LEFT SEMI JOIN" in shim("SELECT b.x FROM a RIGHT SEMI JOIN b ON a.k = b.k")
    for bad in ("SELECT * FROM a ASOF JOIN b ON a.t >= b.t",):
        with pytest.raises(DialectError):
            shim(bad)
    q = shim("SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id % 3 ORDER BY id) AS rn FROM range(9) QUALIFY rn = 1) ORDER BY id")
    assert [r.id for r in spark.sql(q).collect()] == [0, 1, 2]
    assert statements("a ';' ; /* ; */ b -- ; \n;; c") == ["a ';'", "/* ; */ b -- ;", "c"]


# running


def _engine(spark, **config):
    events = []
    e = Engine(spark, EngineConfig(**config), Emitter("http://sink", send=lambda u, k, b: events.append(json.loads(b))))
    return e, events


def _pipeline(spark, db):
    spark.sql(f"CREATE TABLE {db}.users AS SELECT * FROM VALUES (1, 'a', null), (2, 'b', null), (3, 'a', 1) AS t(id, country, gone)")
    spark.sql(f"CREATE TABLE {db}.orders AS SELECT * FROM VALUES (1, 10), (1, 5), (2, -1) AS t(user_id, amount)")
    return [
        Task("clean_users", sql=f"CREATE OR REPLACE TABLE {db}.cu AS SELECT id, country FROM {db}.users WHERE gone IS NULL"),
        Task("clean_orders", sql=f"CREATE OR REPLACE TABLE {db}.co AS SELECT user_id, amount FROM {db}.orders WHERE amount > 0"),
        Task("revenue", sql=f"CREATE OR REPLACE TABLE {db}.rev AS SELECT u.country, SUM(o.amount) AS revenue FROM {db}.co o JOIN {db}.cu u ON u.id = o.user_id GROUP BY 1", tests=(TaskTest(f"SELECT * FROM {db}.rev WHERE revenue < 0", "expect_empty"), TaskTest(f"SELECT max(revenue) FROM {db}.rev", "expect_lt 3"))),
        Task("stats", sql=f"CREATE OR REPLACE TABLE {db}.st AS SELECT country, count(*) AS users FROM {db}.cu GROUP BY country"),
    ]


@pytest.mark.parametrize("width", [1, 3])
def test_run(spark, db, rows, width):
    e, events = _engine(spark, max_parallel=width)
    e.add(_pipeline(spark, db))
    runs = e.run().collect()
    assert {r.task_name: r.status for r in runs} == dict.fromkeys(("clean_users", "clean_orders", "revenue", "stats"), "success")
    assert rows(spark.table(f"{db}.rev")) == [("a", 15)] and rows(spark.table(f"{db}.st")) == [("a", 1), ("b", 1)]
    assert {r.task_name: r.rows_count for r in runs}["stats"] == 2
    assert rows(e.impact(f"{db}.users")) == [(f"{db}.cu", "clean_users"), (f"{db}.rev", "revenue"), (f"{db}.st", "stats")]
    assert rows(e.lineage(f"{db}.st")) == [(f"{db}.cu", "stats"), (f"{db}.users", "clean_users")]
    assert [(r.test_idx, r.passed) for r in e.test().collect()] == [(0, True), (1, False)]
    cols = {(r["dst_column"], r["src_dataset"], r["src_column"], r["subtype"]) for r in e.state.rows("column_lineage", lambda r: r["via_task"] == "revenue")}
    assert ("revenue", f"{db}.co", "amount", "AGGREGATION") in cols and ("country", f"{db}.cu", "country", "IDENTITY") in cols and ("country", f"{db}.cu", "id", "JOIN_KEY") in cols
    e.emitter.flush()
    assert [x["eventType"] for x in events if x["job"]["name"] == "revenue"] == ["START", "COMPLETE"]
    done = next(x for x in events if x["eventType"] == "COMPLETE" and x["job"]["name"] == "revenue")
    assert "revenue" in done["outputs"][0]["facets"]["columnLineage"]["fields"] and done["run"]["facets"]["parent"]
    assert "class revenue_task success" in e.mermaid_text("dag")
    e.run()  # again over the tables that exist now
    assert e.sql("SELECT count(*) AS n FROM __orch__.runs").first().n == 8


def test_failure_skips(spark, db):
    e, events = _engine(spark)
    tasks = _pipeline(spark, db)
    tasks[0] = Task("clean_users", sql=f"CREATE OR REPLACE TABLE {db}.cu AS SELECT nope FROM {db}.users", inputs=(f"{db}.users",), outputs=(f"{db}.cu",), retries=2)
    e.add(tasks)
    got = {r.task_name: (r.status, r.retry_count) for r in e.run().collect()}
    assert got == {"clean_users": ("failed", 2), "clean_orders": ("success", 0), "revenue": ("skipped", 0), "stats": ("skipped", 0)}
    e.emitter.flush()
    fail = next(x for x in events if x["eventType"] == "FAIL")
    assert "nope" in fail["run"]["facets"]["errorMessage"]["message"]
    assert {r.task_name: r.status for r in e.latest_status().collect()}["revenue"] == "skipped"


def test_incremental(spark, db):
    spark.sql(f"CREATE TABLE {db}.ev AS SELECT id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, id) AS t FROM range(5)")
    spark.sql(f"CREATE TABLE {db}.log (id BIGINT, t TIMESTAMP_NTZ)")
    e, _ = _engine(spark)
    e.add([Task("log", sql=f"INSERT INTO {db}.log SELECT * FROM {db}.ev WHERE t > {{{{ last_processed_at }}}}", incremental_by="t")])
    e.run()
    assert e.watermark("log") == datetime(2024, 1, 5)
    spark.sql(f"INSERT INTO {db}.ev VALUES (9, timestamp_ntz'2024-02-01')")
    e.run()
    e.run()
    assert spark.table(f"{db}.log").count() == 6 and e.watermark("log") == datetime(2024, 2, 1)


def test_timeout(spark, db):
    e, _ = _engine(spark)
    e.add([Task("slow", sql=f"CREATE OR REPLACE TABLE {db}.s AS SELECT sum(sqrt(a.id * b.id)) x FROM range(20000000) a JOIN range(100000) b ON a.id % 7 <> b.id % 5", outputs=(f"{db}.s",), timeout_seconds=2)])
    began = time.time()
    row = e.run().first()
    assert row.status == "failed" and "timed out" in row.error_message and time.time() - began < 60


def test_writes(spark, db, rows):
    e, _ = _engine(spark)
    spark.sql(f"CREATE TABLE {db}.t AS SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, null) AS t(id, v)")
    e.sql(f"UPDATE {db}.t SET v = concat(v, '!'), id = id + 10 WHERE v <> 'b'")
    assert rows(spark.table(f"{db}.t")) == [(11, "a!"), (2, "b"), (3, None)]
    e.sql(f"DELETE FROM {db}.t AS x WHERE x.v = 'b'")
    assert rows(spark.table(f"{db}.t")) == [(11, "a!"), (3, None)]
    e.sql(f"MERGE INTO {db}.t AS t USING (SELECT * FROM VALUES (3, 'c'), (4, 'd'), (5, null) AS s(id, v)) AS s ON t.id = s.id WHEN MATCHED THEN UPDATE SET v = CASE WHEN true THEN s.v END WHEN NOT MATCHED AND s.v IS NOT NULL THEN INSERT (id, v) VALUES (s.id, s.v) WHEN NOT MATCHED BY SOURCE THEN DELETE")
    assert rows(spark.table(f"{db}.t")) == [(3, "c"), (4, "d")]
    with pytest.raises(ValueError, match="several"):
        e.sql(f"MERGE INTO {db}.t USING (SELECT * FROM VALUES (3, 'x'), (3, 'y') AS s(id, v)) s ON t.id = s.id WHEN MATCHED THEN DELETE")
    e.sql(f"CREATE OR REPLACE TABLE {db}.t AS SELECT id * 2 AS id, v FROM {db}.t")
    assert rows(spark.table(f"{db}.t")) == [(6, "c"), (8, "d")]
    e.upsert(f"{db}.t", spark.createDataFrame([(8, "z"), (9, "n")], "id int, v string"), ["id"])
    assert rows(spark.table(f"{db}.t")) == [(6, "c"), (8, "z"), (9, "n")]
    with pytest.raises(Exception):
        e.sql(f"CREATE OR REPLACE TABLE {db}.t AS SELECT nope FROM {db}.t")
    assert spark.table(f"{db}.t").count() == 3


def test_capture(spark, db):
    e, _ = _engine(spark, capture_interactive=True)
    e.sql(f"CREATE TABLE {db}.c AS SELECT 1 AS a")
    e.sql(f"CREATE OR REPLACE TABLE {db}.d AS SELECT a + 1 AS b FROM {db}.c")
    e.sql(f"SELECT * FROM {db}.c")
    assert [(r["src_column"], r["dst_column"]) for r in e.state.rows("column_lineage") if r["src_dataset"] == f"{db}.c"] == [("a", "b")]


def test_register_and_cli(spark, db, tmp_path, capsys):
    d = tmp_path / "tasks"
    d.mkdir()
    (d / "one.sql").write_text(f'-- @test "SELECT 1" expect 1\nCREATE OR REPLACE TABLE {db}.one AS SELECT 1 AS x')
    (d / "two.sql").write_text(f"CREATE OR REPLACE TABLE {db}.two AS SELECT x FROM {db}.one")
    e, _ = _engine(spark, state_dir=str(tmp_path / "state"))
    assert main(["register", str(d)], e) == 0 and main(["run"], e) == 0 and main(["test"], e) == 0
    assert main(["impact", f"{db}.one"], e) == 0 and f"{db}.two" in capsys.readouterr().out
    again = StateStore(str(tmp_path / "state"))
    assert len(again.rows("runs")) == 2 and again.rows("runs")[0]["started_at"] < datetime.now()
    (d / "two.sql").unlink()
    e.register(str(d))
    assert [t.name for t in e.tasks()] == ["one"]
    (d / "bad.sql").write_text("CREATE OR REPLACE TABLE x AS SELECT nope")
    e.register(str(d))
    assert main(["run"], e) == 1 and main(["graph", "dag"], e) == 0 and main(["status"], e) == 0
    assert main(["validate", str(d / "one.sql")]) == 0 and main(["schedule", "add", "one", "x y"], e) == 2
    assert main(["schedule", "add", "one", "0 6 * * *"], e) == 0 and main(["schedule", "run-due"], e) == 0 and e.run_due() == []


def test_cron():
    at = lambda c, t: Cron(c).next_after(datetime.fromisoformat(t)).replace(tzinfo=None).isoformat()
    assert at("0 6 * * *", "2024-01-01T06:00:00") == "2024-01-02T06:00:00"
    assert at("*/15 * * * *", "2024-01-01T06:07:30") == "2024-01-01T06:15:00"
    assert at("0 0 29 2 *", "2023-01-01T00:00:00") == "2024-02-29T00:00:00"
    assert at("30 0 0 1 JAN,JUL ?", "2024-01-02T00:00:00") == "2024-07-01T00:00:30"
    assert at("0 0 13 * 5", "2024-01-01T00:00:00") == "2024-01-05T00:00:00"
    for bad in ("", "* * *", "61 * * * *", "*/0 * * * *", "a * * * *"):
        with pytest.raises(CronError):
            Cron(bad)


def test_emitter_drops():
    assert Emitter("").emit({}) == 1
    calls = []

    def send(u, k, b):
        calls.append(b)
        raise OSError

    e = Emitter("http://x", send=send, pause=0.001)
    assert e.emit({"a": 1}) == 0
    e.flush()
    assert len(calls) == 3


def test_functions(spark):
    scalars.register_functions(spark)
    tasks = json.dumps([{"name": "a", "outputs": ["x"]}, {"name": "b", "inputs": ["x"]}])
    r = spark.createDataFrame([(tasks,)], "t string").selectExpr("orch_hello('w') h", "orch_downstream_of(t, 'a') d", "orch_topo_layers(t) l", "orch_build_dag('x') e", "orch_render_mermaid(orch_build_dag(t), 1, 'bad') m", "orch_parse_task('SELECT 1', 'q/z.sql') p", "orch_hello(null) n").first()
    assert r.h == "hello w from loomline" and r.d == '["b"]' and r.l == '[["a"], ["b"]]' and "error" in r.e and "a_task --> b_task" in r.m and json.loads(r.p)["name"] == "z" and r.n is None
    assert json.loads(scalars.extract_column_lineage_json(spark, "SELECT a FROM t"))[0]["columns"][0]["output_field"] == "a"


def test_commands(spark, db, tmp_path):
    (tmp_path / "a.sql").write_text(f'-- @test "SELECT 1" expect 1\nCREATE OR REPLACE TABLE {db}.a AS SELECT 1 AS x')
    e, _ = _engine(spark)
    e.sql("SET orch_max_parallel = 0")
    e.sql("SET orch_namespace = 'ns'; ")
    e.sql("SET orch_capture_interactive = true")
    assert (e.config.max_parallel, e.config.namespace, e.config.capture_interactive) == (1, "ns", True)
    assert e.sql(f"PRAGMA orch_register('{tmp_path}')").count() == 0
    assert e.sql("PRAGMA orch_run;").first().status == "success" and e.sql("pragma orch_test").first().passed
    assert e.sql("PRAGMA orch_visualize('dag')").first().mermaid.startswith("graph LR")
    with pytest.raises(ValueError, match="unknown"):
        e.sql("SET orch_other = 1")


def test_state_file(tmp_path):
    s = StateStore(str(tmp_path))
    s.upsert("task_edges", [{"upstream": "a", "downstream": "b"}, {"upstream": "b", "downstream": "c"}])
    s.upsert("schedules", [{"pipeline_or_task": "x", "cron_expr": "a", "next_trigger_at": datetime(2024, 1, 1)}])
    s.upsert("schedules", [{"pipeline_or_task": "x", "cron_expr": "b"}])
    with (tmp_path / "task_edges.jsonl").open("a") as f:
        f.write('{"upstream": "cut o')
    s = StateStore(str(tmp_path))
    s.insert_new("task_edges", [{"upstream": "c", "downstream": "d"}, {"upstream": "a", "downstream": "b"}])
    s.delete("schedules", lambda r: False)
    s = StateStore(str(tmp_path))
    assert len(s.rows("task_edges")) == 3 and [r["cron_expr"] for r in s.rows("schedules")] == ["b"]
    assert s.delete("task_edges", lambda r: r["upstream"] == "a") == 1 and len(StateStore(str(tmp_path)).rows("task_edges")) == 2
