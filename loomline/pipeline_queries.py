"""Queries that run the engine: tasks are registered and executed over the tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.engine import mermaid
from loomline.engine.dag import build_dag, closure, downstream_of, topo_layers
from loomline.engine.engine import Engine, EngineConfig
from loomline.engine.model import Task, TaskTest
from loomline.operators.joins import asof_join, range_join
from loomline.plans.columns import extract_column_lineage
from loomline.plans.io import extract_io
from loomline.session import scratch_path
from loomline.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Bench:
    """An engine with a database of its own; {raw} in a body stands for the folder's tables, {db} for the database."""

    def __init__(self, spark: SparkSession, folder: str, **config):
        self.spark, self.db = spark, f"lq_{uuid.uuid4().hex[:10]}"
        spark.sql(f"CREATE DATABASE {self.db} LOCATION '{scratch_path(spark, self.db)}'")
        self.raw = {t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}
        self.engine = Engine(spark, EngineConfig(**config))

    def text(self, sql: str) -> str:
        for t, path in self.raw.items():
            sql = sql.replace(f"raw.{t}", path)
        return sql.replace("{db}", self.db)

    def add(self, name: str, sql: str, outputs: tuple[str, ...] = (), **more) -> None:
        self.engine.add([Task(name, sql=self.text(sql), outputs=tuple(self.text(o) for o in outputs), **more)])

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.db}.{name}")

    def run_one(self, sql: str, name: str = "out") -> DataFrame:
        """One task that writes {db}.<name> from a query."""
        self.add(name, f"CREATE OR REPLACE TABLE {{db}}.{name} AS {sql}", (f"{{db}}.{name}",))
        failed = self.engine.run().where("status <> 'success'").collect()
        if failed:
            raise RuntimeError(failed[0].error_message)
        return self.table(name)


def _sample(spark: SparkSession, d: str, **config) -> Bench:
    """The sample pipeline: four tasks, two layers."""
    b = Bench(spark, d, **config)
    b.add("clean_users", "CREATE OR REPLACE TABLE {db}.clean_users AS SELECT c_custkey AS id, c_name AS name, n_name AS country FROM raw.customer JOIN raw.nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0", ("{db}.clean_users",), retries=2)
    b.add("clean_orders", "CREATE OR REPLACE TABLE {db}.clean_orders AS SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS amount, o_orderdate AS ordered_at FROM raw.orders WHERE o_totalprice > 0", ("{db}.clean_orders",))
    b.add("user_stats", "CREATE OR REPLACE TABLE {db}.user_stats AS SELECT country, COUNT(*) AS users FROM {db}.clean_users GROUP BY country", ("{db}.user_stats",), tests=(TaskTest(b.text("SELECT COUNT(*) FROM {db}.user_stats WHERE users < 0"), "expect 0"),))
    b.add(
        "revenue_daily",
        "CREATE OR REPLACE TABLE {db}.revenue_daily AS SELECT CAST(CAST(DATE_TRUNC('day', o.ordered_at) AS DATE) AS STRING) AS day, u.country, CAST(SUM(CAST(o.amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM {db}.clean_orders o JOIN {db}.clean_users u ON u.id = o.user_id GROUP BY 1, 2",
        ("{db}.revenue_daily",),
    )
    return b


def _after_run(result: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        b = _sample(spark, d, max_parallel=4)
        b.engine.run()
        return b.table(result)

    return query


def _one(sql: str) -> Query:
    return lambda spark, d: Bench(spark, d).run_one(sql)


def _script(setup: list[str], result: str) -> Query:
    """Tasks that run one after another, each after the one before."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        b = Bench(spark, d)
        for k, s in enumerate(setup):
            b.add(f"step_{k}", s, (f"{{db}}.mark_{k}",), depends_on=(f"step_{k - 1}",) if k else ())
        failed = b.engine.run().where("status <> 'success'").collect()
        if failed:
            raise RuntimeError(failed[0].error_message)
        return b.table(result)

    return query


def incremental_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over a growing table add up to one load of all of it."""
    b = Bench(spark, d)
    half = "SELECT * FROM raw.events WHERE ts <= (SELECT percentile_approx(CAST(ts AS TIMESTAMP), 0.5) FROM raw.events)"
    spark.sql(b.text(f"CREATE TABLE {{db}}.src AS {half}"))
    spark.sql(b.text("CREATE TABLE {db}.log AS SELECT * FROM raw.events WHERE false"))
    b.add("load", "INSERT INTO {db}.log SELECT * FROM {db}.src WHERE ts > {{ last_processed_at }}", ("{db}.log",), incremental_by="ts")
    b.engine.run()
    spark.sql(b.text("INSERT INTO {db}.src SELECT * FROM raw.events WHERE ts > (SELECT max(ts) FROM {db}.src)"))
    b.engine.run()
    b.engine.run()
    return b.table("log").select("event_id", "user_id", "event_type")


def _failing(spark: SparkSession, d: str) -> Bench:
    b = _sample(spark, d)
    b.add("clean_users", "CREATE OR REPLACE TABLE {db}.clean_users AS SELECT no_such_column FROM raw.customer", ("{db}.clean_users",), retries=2)
    return b


def skipped_after_failure(spark: SparkSession, d: str) -> DataFrame:
    return _failing(spark, d).engine.run().select("task_name", "status")


def retry_counts(spark: SparkSession, d: str) -> DataFrame:
    return _failing(spark, d).engine.run().select("task_name", "retry_count")


def test_assertions(spark: SparkSession, d: str) -> DataFrame:
    b = Bench(spark, d)
    queries = (
        ("SELECT * FROM raw.nation WHERE n_nationkey < 0", "expect_empty"), ("SELECT * FROM raw.nation", "expect_non_empty"), ("SELECT count(*) FROM raw.nation", "expect 25"), ("SELECT count(*) FROM raw.region", "expect_gt 5"),
        ("SELECT NULL", "expect_lt 1"), ("SELECT no_such FROM raw.region", "expect 1"), ("SELECT 1", "expect_odd 1"), ("SELECT 1 WHERE false", "expect 0"), ("SELECT 0", "expect"), ("SELECT count(*) FROM raw.region", "expect_gt 4"), ("SELECT count(*) FROM raw.region", "expect_lt 5"), ("SELECT count(*) FROM raw.region", "expect_lt 6"),
    )
    b.add("checks", "SELECT 1", tests=tuple(TaskTest(b.text(q), a) for q, a in queries))
    return b.engine.test().select("test_idx", "passed")


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    b = _sample(spark, d)
    b.engine.run()
    b.add("user_stats", "SELECT no_such_column FROM {db}.clean_users", ("{db}.user_stats",))
    b.engine.run()
    return b.engine.latest_status()


def _plain_graph(spark: SparkSession, d: str) -> list[Task]:
    io = lambda i, o: {"inputs": i, "outputs": o}
    return [
        Task("clean_users", **io(("raw.users",), ("an.clean_users",))), Task("clean_orders", **io(("raw.orders",), ("an.clean_orders",))),
        Task("user_stats", **io(("an.clean_users",), ("an.user_stats",))), Task("revenue_daily", **io(("an.clean_orders", "an.clean_users"), ("an.revenue_daily",))),
    ]


def _graph(columns: str, rows: Callable[[list[Task]], list[tuple]]) -> Query:
    return lambda spark, d: spark.createDataFrame(rows(_plain_graph(spark, d)), columns)


def _lines(mode: str) -> Query:
    return _graph("line string", lambda t: [(x,) for x in mermaid.render(build_dag(t), mode).splitlines()])


def _io(sql: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = extract_io(spark, sql)
        return spark.createDataFrame([(k[:-1], n) for k in ("inputs", "outputs") for n in found[k]], "kind string, name string")

    return query


def _columns(sql: str, schemas: dict[str, list[str]] | None = None) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = [(c.output_field, i.dataset, i.field, t.kind, t.subtype) for x in extract_column_lineage(spark, sql, schemas or {}) for c in x.columns for i in c.inputs for t in i.transformations]
        return spark.createDataFrame(out, "output string, dataset string, field string, kind string, subtype string")

    return query


def _values(columns: str, rows: list[tuple]) -> str:
    """An independent statement of the rows that are wanted."""
    if not rows:
        return "SELECT " + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in columns.split()) + " WHERE false"
    body = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    names = ", ".join(columns.split())
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


_C, _O = ["id", "country", "born"], ["user_id", "amount", "at"]
_LINEAGE: dict[str, tuple[str, dict, list[tuple]]] = {
    "identity": ("INSERT INTO x SELECT id, c.country AS land FROM c", {"c": _C}, [("id", "c", "id", "DIRECT", "IDENTITY"), ("land", "c", "country", "DIRECT", "IDENTITY")]),
    "transform": ("SELECT upper(country) AS u, id + born AS s FROM c", {"c": _C}, [("u", "c", "country", "DIRECT", "TRANSFORMATION"), ("s", "c", "id", "DIRECT", "TRANSFORMATION"), ("s", "c", "born", "DIRECT", "TRANSFORMATION")]),
    "agg": ("SELECT country, count(*) AS n, max(born) AS b FROM c WHERE id > 3 GROUP BY country", {"c": _C}, [
        ("country", "c", "country", "DIRECT", "IDENTITY"), ("country", "c", "id", "INDIRECT", "FILTER"), ("n", "c", "id", "INDIRECT", "FILTER"), ("n", "c", "country", "INDIRECT", "GROUP_BY"),
        ("b", "c", "born", "INDIRECT", "AGGREGATION"), ("b", "c", "id", "INDIRECT", "FILTER"), ("b", "c", "country", "INDIRECT", "GROUP_BY")]),
    "window": ("SELECT lag(born) OVER (PARTITION BY country ORDER BY id) AS p, row_number() OVER (ORDER BY id) AS k FROM c", {"c": _C}, [("p", "c", "born", "INDIRECT", "WINDOW")]),
    "join": ("SELECT c.country, o.amount FROM c JOIN o ON c.id = o.user_id", {"c": _C, "o": _O}, [
        ("country", "c", "country", "DIRECT", "IDENTITY"), ("country", "c", "id", "INDIRECT", "JOIN_KEY"), ("country", "o", "user_id", "INDIRECT", "JOIN_KEY"),
        ("amount", "o", "amount", "DIRECT", "IDENTITY"), ("amount", "c", "id", "INDIRECT", "JOIN_KEY"), ("amount", "o", "user_id", "INDIRECT", "JOIN_KEY")]),
    "star": ("CREATE VIEW v AS SELECT * FROM c", {"c": _C}, [(n, "c", n, "DIRECT", "IDENTITY") for n in _C]),
    "union": ("SELECT country AS x FROM c UNION ALL SELECT amount FROM o", {"c": _C, "o": _O}, [("x", "c", "country", "DIRECT", "IDENTITY"), ("x", "o", "amount", "DIRECT", "IDENTITY")]),
    "case": ("SELECT CASE WHEN id > 1 THEN country ELSE 'x' END AS k FROM c", {"c": _C}, [("k", "c", "id", "DIRECT", "TRANSFORMATION"), ("k", "c", "country", "DIRECT", "TRANSFORMATION")]),
    "cte": ("WITH q AS (SELECT id AS i, upper(country) AS u FROM c) SELECT u, i FROM q ORDER BY i", {"c": _C}, [("u", "c", "country", "DIRECT", "TRANSFORMATION"), ("u", "c", "id", "INDIRECT", "SORT"), ("i", "c", "id", "DIRECT", "IDENTITY")]),
    "unread_cte": ("WITH q AS (SELECT id FROM c WHERE born > 1) SELECT amount FROM o", {"c": _C, "o": _O}, [("amount", "o", "amount", "DIRECT", "IDENTITY")]),
    "scalar_subquery": ("SELECT country, (SELECT max(amount) FROM o WHERE o.user_id = c.id) AS m FROM c", {"c": _C, "o": _O}, [("country", "c", "country", "DIRECT", "IDENTITY"), ("m", "o", "amount", "INDIRECT", "AGGREGATION"), ("m", "o", "user_id", "INDIRECT", "FILTER"), ("m", "c", "id", "INDIRECT", "FILTER")]),
    "in_subquery": ("SELECT country FROM c WHERE id IN (SELECT user_id FROM o WHERE amount > 5)", {"c": _C, "o": _O}, [("country", "c", "country", "DIRECT", "IDENTITY"), ("country", "c", "id", "INDIRECT", "FILTER"), ("country", "o", "user_id", "INDIRECT", "FILTER"), ("country", "o", "amount", "INDIRECT", "FILTER")]),
    "exists": ("SELECT country FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = c.id)", {"c": _C, "o": _O}, [("country", "c", "country", "DIRECT", "IDENTITY"), ("country", "o", "user_id", "INDIRECT", "FILTER"), ("country", "c", "id", "INDIRECT", "FILTER")]),
    "qualified_star": ("SELECT o.* FROM c JOIN o ON c.id = o.user_id", {"c": _C, "o": _O}, [(n, *x) for n in _O for x in (("o", n, "DIRECT", "IDENTITY"), ("c", "id", "INDIRECT", "JOIN_KEY"), ("o", "user_id", "INDIRECT", "JOIN_KEY")) if x != ("o", "user_id", "INDIRECT", "JOIN_KEY") or n != "user_id"]),
    "predicates": ("SELECT (born) AS b, id BETWEEN 1 AND born AS i, country LIKE 'a%' AS l, country IN ('x', 'y') AS n FROM c", {"c": _C}, [("b", "c", "born", "DIRECT", "IDENTITY"), ("i", "c", "id", "DIRECT", "TRANSFORMATION"), ("i", "c", "born", "DIRECT", "TRANSFORMATION"), ("l", "c", "country", "DIRECT", "TRANSFORMATION"), ("n", "c", "country", "DIRECT", "TRANSFORMATION")]),
    "derived_table": ("SELECT x.u FROM (SELECT upper(country) AS u, id FROM c WHERE born > 3) AS x", {"c": _C}, [("u", "c", "country", "DIRECT", "TRANSFORMATION"), ("u", "c", "born", "INDIRECT", "FILTER")]),
    "several_roles": ("SELECT country, lag(country) OVER (ORDER BY id) AS p FROM c WHERE country > 'a'", {"c": _C}, [("country", "c", "country", "DIRECT", "IDENTITY"), ("p", "c", "country", "INDIRECT", "WINDOW")]),
    "unknown_star": ("SELECT * FROM unknown_table", {}, []),
    "group": ("SELECT country FROM c GROUP BY country, born", {"c": _C}, [("country", "c", "country", "DIRECT", "IDENTITY"), ("country", "c", "born", "INDIRECT", "GROUP_BY")]),
}
_IO: dict[str, tuple[str, list[tuple]]] = {
    "insert": ("INSERT INTO clean SELECT * FROM raw WHERE deleted = false", [("input", "raw"), ("output", "clean")]),
    "ctas": ("CREATE OR REPLACE TABLE an.s AS SELECT a FROM an.c GROUP BY 1", [("input", "an.c"), ("output", "an.s")]),
    "view": ("CREATE VIEW v AS SELECT * FROM a JOIN b USING (k)", [("input", "a"), ("input", "b"), ("output", "v")]),
    "update": ("UPDATE t SET x = 1 WHERE y = 2", [("input", "t"), ("output", "t")]),
    "union": ("SELECT x FROM a UNION SELECT x FROM b EXCEPT SELECT x FROM c", [("input", "a"), ("input", "b"), ("input", "c")]),
    "nested": ("SELECT * FROM (SELECT * FROM (SELECT * FROM a) x) y", [("input", "a")]),
    "cte": ("WITH a AS (SELECT * FROM t), b AS (SELECT * FROM a) SELECT * FROM b", [("input", "t")]),
    "subquery": ("SELECT (SELECT max(x) FROM b) FROM a WHERE EXISTS (SELECT 1 FROM c)", [("input", "a"), ("input", "b"), ("input", "c")]),
    "delete": ("DELETE FROM t WHERE k IN (SELECT k FROM s)", [("input", "s"), ("input", "t"), ("output", "t")]),
    "merge": ("MERGE INTO t USING s ON t.k = s.k WHEN MATCHED THEN DELETE", [("input", "s"), ("input", "t"), ("output", "t")]),
    "quoted": ("INSERT INTO `My Db`.`T x` SELECT * FROM Raw.`In put`", [("input", "Raw.In put"), ("output", "My Db.T x")]),
    "values": ("SELECT * FROM VALUES (1), (2) AS v(x) JOIN range(3) r ON r.id = x JOIN a USING (x)", [("input", "a")]),
    "parse_error": ("SELEC x FROM a", []),
    "several": ("INSERT INTO x SELECT * FROM a; CREATE TABLE y AS SELECT * FROM x", [("input", "a"), ("input", "x"), ("output", "x"), ("output", "y")]),
    "or_replace": ("INSERT OR REPLACE INTO x SELECT * FROM a", [("input", "a"), ("output", "x")]),
    "placeholder": ("INSERT INTO x SELECT * FROM e WHERE t > {{ last_processed_at }}", [("input", "e"), ("output", "x")]),
}

#: Host SQL through a task: (Spark body, DuckDB SQL or None for the same text without the prefix raw.).
_N, _R = "raw.nation n", "raw.region r"
_SQL: dict[str, tuple[str, str | None]] = {
    "join_inner": (f"SELECT n_name, r_name FROM {_N} JOIN {_R} ON n_regionkey = r_regionkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM raw.customer LEFT JOIN raw.orders ON c_custkey = o_custkey", None),
    "join_right": ("SELECT c_custkey, o_orderkey FROM raw.orders RIGHT JOIN raw.customer ON c_custkey = o_custkey", None),
    "join_full": ("SELECT n_name, s_name FROM raw.nation FULL JOIN raw.supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000", None),
    "join_semi": ("SELECT c_custkey FROM raw.customer LEFT SEMI JOIN raw.orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT c_custkey FROM raw.customer LEFT ANTI JOIN (SELECT * FROM raw.orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey"),
    "join_right_anti": ("SELECT c_custkey FROM (SELECT * FROM raw.orders WHERE o_totalprice > 200000) AS o RIGHT ANTI JOIN raw.customer AS c ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey"),
    "join_cross": ("SELECT n_name, r_name FROM raw.nation CROSS JOIN raw.region", None),
    "join_natural": ("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM raw.nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM raw.region)", None),
    "join_nonequi": ("SELECT a.s_suppkey AS x, count(*) AS n FROM raw.supplier a JOIN raw.nation b ON a.s_nationkey > b.n_nationkey GROUP BY a.s_suppkey", None),
    "math_functions": ("SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, p_size % 7 AS m, greatest(p_size, 10) AS g, sign(p_size - 25) AS sg FROM raw.part",
                       "SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(sqrt(p_retailprice), 6) AS s, round(ln(p_retailprice), 6) AS l, p_size % 7 AS m, greatest(p_size, 10) AS g, CAST(sign(p_size - 25) AS DOUBLE) AS sg FROM part"),
    "json_functions": ("SELECT n_nationkey AS k, get_json_object(to_json(named_struct('n', n_name, 'r', n_regionkey)), '$.n') AS n, CAST(get_json_object(to_json(named_struct('r', n_regionkey)), '$.r') AS BIGINT) AS r FROM raw.nation", "SELECT n_nationkey AS k, to_json({'n': n_name})->>'$.n' AS n, CAST(to_json({'r': n_regionkey})->>'$.r' AS BIGINT) AS r FROM nation"),
    "map_functions": ("SELECT n_nationkey AS k, element_at(map('name', n_name, 'low', lower(n_name)), 'low') AS v, size(map_keys(map('a', 1, 'b', 2))) AS n FROM raw.nation", "SELECT n_nationkey AS k, map(['name', 'low'], [n_name, lower(n_name)])['low'] AS v, CAST(len(map_keys(map(['a', 'b'], [1, 2]))) AS INTEGER) AS n FROM nation"),
    "struct_list": ("SELECT n_nationkey AS k, {'a': n_name, 'b': n_regionkey}.a AS a, ['x', n_name][1] AS second FROM raw.nation", "SELECT n_nationkey AS k, n_name AS a, n_name AS second FROM nation"),
    "filter_clause": ("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n FROM raw.lineitem GROUP BY l_returnflag", None),
    "having": ("SELECT o_custkey, count(*) AS n FROM raw.orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "offset": ("SELECT o_orderkey FROM raw.orders ORDER BY o_orderkey LIMIT 20 OFFSET 40", None),
    "join_right_semi": ("SELECT c_custkey FROM raw.orders RIGHT SEMI JOIN raw.customer ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_using": ("SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM raw.nation) JOIN (SELECT r_regionkey AS k, r_name AS b FROM raw.region) USING (k)", None),
    "join_theta": ("SELECT a.n_name AS x, b.n_name AS y FROM raw.nation a JOIN raw.nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "subquery_scalar": ("SELECT c_custkey FROM raw.customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM raw.customer)", None),
    "subquery_in": ("SELECT s_suppkey FROM raw.supplier WHERE s_nationkey IN (SELECT n_nationkey FROM raw.nation WHERE n_regionkey = 1)", None),
    "subquery_exists": ("SELECT c_custkey FROM raw.customer c WHERE NOT EXISTS (SELECT 1 FROM raw.orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)", None),
    "distinct": ("SELECT DISTINCT p_brand, p_size FROM raw.part", None),
    "agg_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM raw.lineitem GROUP BY l_returnflag", None),
    "rollup": ("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM raw.lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", None),
    "cube": ("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM raw.lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "grouping_sets": ("SELECT l_returnflag AS a, l_linestatus AS b, CAST(sum(l_linenumber) AS BIGINT) AS n FROM raw.lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "window_rank": ("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM raw.customer", None),
    "window_lag": ("SELECT event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS p FROM raw.events", None),
    "window_frame": ("SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM raw.orders", None),
    "setop_union": ("SELECT c_nationkey AS k FROM raw.customer UNION SELECT s_nationkey FROM raw.supplier", None),
    "setop_intersect": ("SELECT c_nationkey AS k FROM raw.customer INTERSECT SELECT s_nationkey FROM raw.supplier", None),
    "setop_except": ("SELECT c_custkey AS k FROM raw.customer EXCEPT SELECT o_custkey FROM raw.orders WHERE o_totalprice > 200000", None),
    "qualify": ("SELECT c_nationkey, c_custkey FROM raw.customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2", None),
    "exclude": ("SELECT * EXCLUDE (n_regionkey) FROM raw.nation", None),
    "shim_types": ("SELECT CAST(o_orderkey AS VARCHAR) AS k, o_custkey::VARCHAR AS c FROM raw.orders", None),
    "shim_list": ("SELECT n_regionkey AS k, array_sort(list(n_name))[0] AS first_name FROM raw.nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, min(n_name) AS first_name FROM nation GROUP BY n_regionkey"),
    "case_expression": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size FROM raw.orders", None),
    "string_functions": ("SELECT p_partkey, upper(p_name) AS u, length(p_type) AS n, substring(p_brand, 1, 3) AS b, concat(p_brand, '-', p_type) AS j, replace(p_name, ' ', '_') AS r FROM raw.part", None),
    "date_functions": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS STRING) AS t, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS d FROM raw.orders",
                       "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS t, datediff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS d FROM orders"),
    "group_by_all": ("SELECT p_brand, p_size, count(*) AS n FROM raw.part GROUP BY ALL", None),
    "recursive_cte": ("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t", None),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM raw.orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50", None),
}
_EXACT = "CAST(l_extendedprice AS DECIMAL(18,2))"
_AGGREGATES: dict[str, tuple[str, str | None]] = {
    "sum": (f"CAST(sum({_EXACT}) AS DOUBLE)", None), "count": ("count(l_tax)", None), "avg": ("round(avg(l_quantity), 6)", None), "min": ("min(l_shipdate)", None), "max": ("max(l_extendedprice)", None),
    "stddev": ("round(stddev(l_quantity), 6)", None), "stddev_pop": ("round(stddev_pop(l_quantity), 6)", None), "stddev_samp": ("round(stddev_samp(l_quantity), 6)", None), "variance": ("round(variance(l_quantity), 5)", None),
    "var_pop": ("round(var_pop(l_quantity), 5)", None), "var_samp": ("round(var_samp(l_quantity), 5)", None), "median": ("median(l_quantity)", None), "mode": ("mode(l_returnflag, true)", None),
    "array_agg": ("array_join(array_sort(array_agg(l_linenumber)), ',')", "array_to_string(list_sort(array_agg(l_linenumber)), ',')"), "string_agg": ("string_agg(l_returnflag, ',') WITHIN GROUP (ORDER BY l_returnflag)", "string_agg(l_returnflag, ',' ORDER BY l_returnflag)"), "list": ("array_join(array_sort(list(l_partkey)), ',')", "array_to_string(list_sort(list(l_partkey)), ',')"),
    "first": ("first(l_suppkey)", None), "last": ("last(l_suppkey)", None), "any_value": ("any_value(l_suppkey)", None), "bit_and": ("bit_and(l_partkey)", None), "bit_or": ("bit_or(l_partkey)", None),
}
#: Over all orders, as they come: any of an order's values is right (mode: any of the most frequent), so no SQL fixes them.
_WHOLE = {k: _AGGREGATES[k][0] for k in ("first", "last", "any_value", "mode")}


def join_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the last event of the customer's number at or before the end of the order's month."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), "o_orderdate")
    events = table(spark, d, "events").select("user_id", (F.col("ts") - F.expr("INTERVAL 30 YEARS")).alias("ts"), "event_id")
    return asof_join(orders, events, ["user_id"], "o_orderdate", "ts", ["event_id"]).select("o_orderkey", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


def join_range(spark: SparkSession, d: str) -> DataFrame:
    """Parts with the customers' balances within five of their price."""
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 5).alias("low"), (F.col("p_retailprice") + 5).alias("high"))
    return range_join(table(spark, d, "customer").select("c_custkey", "c_acctbal"), parts, "c_acctbal", "low", "high", 10).select("c_custkey", "p_partkey")


_FULL_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey"


def _aggregate(name: str, value: str, source: str) -> str:
    """Per order, over all orders; moments per supplier. first and last go by a whole order of an order's lines, each line with what
    is first or last so far; of any_value it is told whether it is one of the order's; of equally frequent values the mode
    is the lowest."""
    if name in ("first", "last"):
        fit = f"{name}_value(l_suppkey)" if source == "lineitem" else value
        return f"SELECT l_orderkey AS k, l_linenumber AS n, {fit} OVER (PARTITION BY l_orderkey {_FULL_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM {source}"
    if name == "any_value":
        member = f"list_contains(list(l_suppkey), {value})" if source == "lineitem" else f"array_contains(array_agg(l_suppkey), {value})"
        return f"SELECT l_orderkey AS k, {member} AS v FROM {source} GROUP BY l_orderkey"
    if name == "mode" and source == "lineitem":
        counts = "SELECT l_orderkey AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY ALL"
        return f"SELECT k, v FROM ({counts}) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1"
    key = "l_suppkey" if name.startswith(("std", "var")) else "l_orderkey"
    return f"SELECT {key} AS k, {value} AS v FROM {source} GROUP BY {key}"


def _whole(value: str, source: str) -> str:
    return f"SELECT l_orderkey AS k, {value} AS v FROM {source} GROUP BY l_orderkey"


def _host(text: str) -> str:
    return text.replace("raw.", "")


_CTE = "clean_users AS (SELECT c_custkey AS id, c_name AS name, n_name AS country FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0), clean_orders AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS amount, o_orderdate AS ordered_at FROM orders WHERE o_totalprice > 0)"

QUERIES: dict[str, Query] = {
    **{f"pipeline_{t}": _after_run(t) for t in ("revenue_daily", "clean_users", "clean_orders", "user_stats")},
    "incremental_two_pass": incremental_two_pass,
    "update_task": _script(["CREATE TABLE {db}.t AS SELECT n_nationkey, n_name, n_regionkey FROM raw.nation", "UPDATE {db}.t SET n_name = lower(n_name), n_regionkey = n_regionkey + 10 WHERE n_regionkey >= 3"], "t"),
    "delete_task": _script(["CREATE TABLE {db}.t AS SELECT c_custkey, c_acctbal FROM raw.customer", "DELETE FROM {db}.t WHERE c_acctbal < 0"], "t"),
    "insert_append": _script(["CREATE TABLE {db}.t AS SELECT n_nationkey AS k FROM raw.nation", "INSERT INTO {db}.t SELECT r_regionkey FROM raw.region"], "t"),
    "merge_task": _script([
        "CREATE TABLE {db}.t AS SELECT n_nationkey AS k, n_name AS v FROM raw.nation WHERE n_nationkey < 15",
        "MERGE INTO {db}.t AS t USING (SELECT n_nationkey AS k, lower(n_name) AS v FROM raw.nation WHERE n_nationkey >= 10) AS s ON t.k = s.k WHEN MATCHED AND t.k = 12 THEN DELETE WHEN MATCHED THEN UPDATE SET v = s.v WHEN NOT MATCHED THEN INSERT (k, v) VALUES (s.k, s.v)"], "t"),
    "staging_self_replace": _script(["CREATE TABLE {db}.t AS SELECT n_nationkey AS k FROM raw.nation", "CREATE OR REPLACE TABLE {db}.t AS SELECT k + 100 AS k FROM {db}.t WHERE k % 2 = 0"], "t"),
    "multi_statement_task": _script(["CREATE TABLE {db}.a AS SELECT r_regionkey AS k, 'a;b' AS s FROM raw.region; -- ; not here\nCREATE TABLE {db}.t AS SELECT k, s FROM {db}.a; INSERT INTO {db}.t SELECT k + 5, s FROM {db}.a;"], "t"),
    "test_assertions": test_assertions, "latest_status": latest_status, "skipped_after_failure": skipped_after_failure, "retry_counts": retry_counts,
    "task_edges": _graph("upstream string, downstream string", lambda t: [(e.upstream, e.downstream) for e in build_dag(t).task_edges]),
    "lineage_edges": _graph("src_dataset string, dst_dataset string, via_task string", lambda t: [(e.src_dataset, e.dst_dataset, e.via_task) for e in build_dag(t).lineage_edges]),
    "topo_layers": _graph("layer int, task string", lambda t: [(k, n) for k, layer in enumerate(topo_layers(t)) for n in layer]),
    "downstream_of": _graph("task string", lambda t: [(n,) for n in downstream_of(t, "clean_users")]),
    "impact": _graph("table_name string, via_task string", lambda t: closure(build_dag(t).lineage_edges, "raw.users")),
    "lineage_upstream": _graph("table_name string, via_task string", lambda t: closure(build_dag(t).lineage_edges, "an.revenue_daily", up=True)),
    **{f"mermaid_{m}": _lines(m) for m in (mermaid.LINEAGE, mermaid.DAG, mermaid.COMBINED)},
    **{f"extract_io_{k}": _io(sql) for k, (sql, _) in _IO.items()},
    **{f"column_lineage_{k}": _columns(sql, schemas) for k, (sql, schemas, _) in _LINEAGE.items()},
    **{k: _one(sql) for k, (sql, _) in _SQL.items()},
    **{f"agg_{k}": _one(_aggregate(k, sql, "raw.lineitem")) for k, (sql, _) in _AGGREGATES.items()},
    **{f"agg_{k}_all": _one(_whole(sql, "raw.lineitem")) for k, sql in _WHOLE.items()},
    "join_asof": join_asof, "join_range": join_range,
}

_LINES_L = ["    raw_users[(raw.users)] --> an_clean_users[(an.clean_users)]", "    raw_orders[(raw.orders)] --> an_clean_orders[(an.clean_orders)]", "    an_clean_users[(an.clean_users)] --> an_user_stats[(an.user_stats)]",
            "    an_clean_orders[(an.clean_orders)] --> an_revenue_daily[(an.revenue_daily)]", "    an_clean_users[(an.clean_users)] --> an_revenue_daily[(an.revenue_daily)]"]
_LINES_D = ["    clean_orders_task --> revenue_daily_task", "    clean_users_task --> revenue_daily_task", "    clean_users_task --> user_stats_task"]
_EDGES = [("raw.users", "an.clean_users", "clean_users"), ("raw.orders", "an.clean_orders", "clean_orders"), ("an.clean_users", "an.user_stats", "user_stats"), ("an.clean_orders", "an.revenue_daily", "revenue_daily"), ("an.clean_users", "an.revenue_daily", "revenue_daily")]
_GRAPH = f"WITH RECURSIVE e AS ({_values('src_dataset dst_dataset via_task', _EDGES)})"

ORACLE: dict[str, str] = {
    "pipeline_revenue_daily": f"WITH {_CTE} SELECT CAST(CAST(ordered_at AS DATE) AS VARCHAR) AS day, country, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM clean_orders o JOIN clean_users u ON u.id = o.user_id GROUP BY 1, 2",
    "pipeline_clean_users": f"WITH {_CTE} SELECT * FROM clean_users", "pipeline_clean_orders": f"WITH {_CTE} SELECT * FROM clean_orders",
    "pipeline_user_stats": f"WITH {_CTE} SELECT country, COUNT(*) AS users FROM clean_users GROUP BY country",
    "incremental_two_pass": "SELECT event_id, user_id, event_type FROM events",
    "update_task": "SELECT n_nationkey, CASE WHEN n_regionkey >= 3 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey >= 3 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation",
    "delete_task": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL OR c_acctbal >= 0",
    "insert_append": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "merge_task": "SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 10 THEN lower(n_name) ELSE n_name END AS v FROM nation WHERE n_nationkey <> 12",
    "staging_self_replace": "SELECT n_nationkey + 100 AS k FROM nation WHERE n_nationkey % 2 = 0",
    "multi_statement_task": "SELECT r_regionkey AS k, 'a;b' AS s FROM region UNION ALL SELECT r_regionkey + 5, 'a;b' FROM region",
    "test_assertions": _values("test_idx passed", [(0, True), (1, True), (2, True), (3, False), (4, True), (5, False), (6, False), (7, False), (8, True), (9, True), (10, False), (11, True)]),
    "latest_status": _values("task_name status", [("clean_users", "success"), ("clean_orders", "success"), ("user_stats", "failed"), ("revenue_daily", "success")]),
    "skipped_after_failure": _values("task_name status", [("clean_users", "failed"), ("clean_orders", "success"), ("user_stats", "skipped"), ("revenue_daily", "skipped")]),
    "retry_counts": _values("task_name retry_count", [("clean_users", 2), ("clean_orders", 0), ("user_stats", 0), ("revenue_daily", 0)]),
    "task_edges": f"{_GRAPH} SELECT DISTINCT a.via_task AS upstream, b.via_task AS downstream FROM e a JOIN e b ON a.dst_dataset = b.src_dataset",
    "lineage_edges": f"{_GRAPH} SELECT * FROM e",
    "topo_layers": f"{_GRAPH}, t AS (SELECT DISTINCT a.via_task AS up, b.via_task AS dn FROM e a JOIN e b ON a.dst_dataset = b.src_dataset), w(task, k) AS (SELECT DISTINCT via_task, 0 FROM e UNION SELECT t.dn, w.k + 1 FROM w JOIN t ON t.up = w.task) SELECT CAST(max(k) AS INTEGER) AS layer, task FROM w GROUP BY task",
    "downstream_of": f"{_GRAPH}, t AS (SELECT DISTINCT a.via_task AS up, b.via_task AS dn FROM e a JOIN e b ON a.dst_dataset = b.src_dataset), w(task) AS (SELECT dn FROM t WHERE up = 'clean_users' UNION SELECT t.dn FROM w JOIN t ON t.up = w.task) SELECT task FROM w",
    "impact": f"{_GRAPH}, w(table_name, via_task) AS (SELECT dst_dataset, via_task FROM e WHERE src_dataset = 'raw.users' UNION SELECT e.dst_dataset, e.via_task FROM w JOIN e ON e.src_dataset = w.table_name) SELECT * FROM w",
    "lineage_upstream": f"{_GRAPH}, w(table_name, via_task) AS (SELECT src_dataset, via_task FROM e WHERE dst_dataset = 'an.revenue_daily' UNION SELECT e.src_dataset, e.via_task FROM w JOIN e ON e.dst_dataset = w.table_name) SELECT * FROM w",
    "mermaid_lineage": _values("line", [(x,) for x in ["graph LR", *_LINES_L]]), "mermaid_dag": _values("line", [(x,) for x in ["graph LR", *_LINES_D]]), "mermaid_combined": _values("line", [(x,) for x in ["graph LR", *_LINES_L, *_LINES_D]]),
    **{f"extract_io_{k}": _values("kind name", r) for k, (_, r) in _IO.items()},
    **{f"column_lineage_{k}": _values("output dataset field kind subtype", r) for k, (_, _, r) in _LINEAGE.items()},
    **{k: other or _host(sql) for k, (sql, other) in _SQL.items()},
    **{f"agg_{k}": _aggregate(k, other or sql, "lineitem") for k, (sql, other) in _AGGREGATES.items()},
    "join_asof": "SELECT o_orderkey, coalesce((SELECT max_by(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.user_id = o.o_custkey AND e.ts - INTERVAL 30 YEARS <= o.o_orderdate), -1) AS event_id FROM orders o",
    "join_range": "SELECT c_custkey, p_partkey FROM customer JOIN part ON c_acctbal BETWEEN p_retailprice - 5 AND p_retailprice + 5",
}
