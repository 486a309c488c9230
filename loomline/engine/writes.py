"""Statements that change tables, on catalogs whose tables are files.

CREATE [OR REPLACE] TABLE AS, UPDATE, DELETE and MERGE become a query whose result is written beside the target and
then takes its name; the old table stays until the query has succeeded, and a body may read the table it replaces.
"""

from __future__ import annotations

import threading
import uuid
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomline.engine.dialect import DialectError, Script, shim, statements
from loomline.sources.files import exists, move

_locks: dict[str, threading.RLock] = defaultdict(threading.RLock)


def quoted(name: str) -> str:
    return ".".join(f"`{p.strip('`')}`" for p in name.split("."))


def _swap(spark: SparkSession, target: str, make: Callable[[str], None], check: Callable[[], None] | None = None) -> None:
    """make a table beside target, drop target, rename. If make or check fails, target stays as it is."""
    names = [p.strip("`") for p in target.split(".")]
    staging = quoted(".".join([*names[:-1], f"{names[-1]}__{uuid.uuid4().hex[:8]}"]))
    with _locks[target.lower()]:
        try:
            make(staging)
            if check:
                check()
        except Exception:
            spark.sql(f"DROP TABLE IF EXISTS {staging}")
            raise
        spark.sql(f"DROP TABLE IF EXISTS {quoted(target)}")
        _clear_leftover(spark, target)
        spark.sql(f"ALTER TABLE {staging} RENAME TO {quoted(target)}")
        if _layout(spark, target)[1]:  # the catalog still has the partitions in the place of staging
            spark.sql(f"MSCK REPAIR TABLE {quoted(target)} SYNC PARTITIONS")


def swap_table(spark: SparkSession, target: str, df: DataFrame, check: Callable[[], None] | None = None) -> None:
    """Put the rows of df in the place of target, which keeps its format, partitions, properties and comments."""
    provider, partitions, comment, properties = "parquet", [], None, {}
    if spark.catalog.tableExists(quoted(target)):
        provider, partitions, comment, properties = _layout(spark, target)
        for f in spark.table(quoted(target)).schema:
            if f.metadata and f.name in df.columns:
                df = df.withMetadata(f.name, f.metadata)

    def make(staging: str) -> None:
        writer = df.write.format(provider).mode("error")
        (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(staging)
        if comment:
            spark.sql(f"COMMENT ON TABLE {staging} IS {_text(comment)}")
        if properties:
            spark.sql(f"ALTER TABLE {staging} SET TBLPROPERTIES ({', '.join(f'{_text(k)} = {_text(v)}' for k, v in properties.items())})")

    _swap(spark, target, make, check)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _layout(spark: SparkSession, target: str) -> tuple[str, list[str], str | None, dict[str, str]]:
    """(format, partition columns, comment, properties) of a table, from the catalog."""
    state = spark._jsparkSession.sessionState()
    meta = state.catalog().getTableMetadata(state.sqlParser().parseTableIdentifier(quoted(target)))
    provider, comment = meta.provider(), meta.comment()
    names = meta.partitionColumnNames().mkString("\n")
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(target)}").collect() if "value" in r}
    return provider.get() if provider.isDefined() else "parquet", names.split("\n") if names else [], comment.get() if comment.isDefined() else None, properties


def _clear_leftover(spark: SparkSession, target: str) -> None:
    """Files in the place of a table that the catalog doesn't know, from an earlier session, would stop the rename: they
    are moved aside."""
    parts = [p.strip("`") for p in target.split(".")]
    database = parts[-2] if len(parts) > 1 else spark.catalog.currentDatabase()
    location = next((r[1] for r in spark.sql(f"DESCRIBE DATABASE {quoted(database)}").collect() if r[0] == "Location"), None)
    place = f"{location}/{parts[-1].lower()}"
    if location and exists(spark, place):
        move(spark, place, f"{location}/{parts[-1].lower()}.leftover-{uuid.uuid4().hex[:8]}")


class Statement:
    """A statement as tokens with a view of the top level."""

    def __init__(self, text: str):
        self.s = Script(text)
        self.code = self.s.code()
        self.depth, d = [], 0
        for i in self.code:
            t = self.s.toks[i]
            d -= t.kind == "mark" and t.text == ")"
            self.depth.append(d)
            d += t.kind == "mark" and t.text == "("

    def up(self, k: int) -> str:
        return self.s.toks[self.code[k]].up if 0 <= k < len(self.code) else ""

    def text(self, a: int, b: int | None = None) -> str:
        """The text of code tokens a to b, b not included."""
        stop = len(self.s.toks) if b is None or b >= len(self.code) else self.code[b]
        return "".join(t.text for t in self.s.toks[self.code[a] : stop]).strip() if a < len(self.code) else ""

    def find(self, *words: str, start: int = 0, stop: int | None = None) -> int:
        for k in range(start, len(self.code) if stop is None else stop):
            if self.depth[k] == 0 and self.up(k) in words:
                return k
        return -1

    def name(self, k: int) -> tuple[str, int]:
        """A dotted name from token k on, and the place after it."""
        parts = [self.s.toks[self.code[k]].text.strip("`")]
        k += 1
        while self.up(k) == ".":
            parts.append(self.s.toks[self.code[k + 1]].text.strip("`"))
            k += 2
        return ".".join(parts), k

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of parts between commas of the level of a."""
        out, start, level = [], a, self.depth[a] if a < len(self.depth) else 0
        for k in range(a, b):
            if self.up(k) == "," and self.depth[k] == level:
                out.append((start, k))
                start = k + 1
        out.append((start, b))
        return out

    def alias(self, k: int, *stops: str) -> tuple[str | None, int]:
        if self.up(k) == "AS":
            return self.s.toks[self.code[k + 1]].text, k + 2
        if k < len(self.code) and self.up(k) not in stops and self.s.toks[self.code[k]].kind in ("word", "string"):
            return self.s.toks[self.code[k]].text, k + 1
        return None, k


def _create(spark: SparkSession, st: Statement) -> bool:
    k = 1
    if st.up(k) == "OR":
        k += 2
    if st.up(k) != "TABLE":
        return False
    replace = st.up(1) == "OR"
    k += 1
    skip = False
    if [st.up(k), st.up(k + 1), st.up(k + 2)] == ["IF", "NOT", "EXISTS"]:
        skip, k = True, k + 3
    target, k = st.name(k)
    body = st.find("AS", start=k)
    start = body + 1 if body >= 0 else st.find("SELECT", "WITH", "FROM", "VALUES", start=k)
    if start < 0 or st.up(k) == "(":
        return False
    if not replace and spark.catalog.tableExists(target):
        if skip:
            return True
        raise ValueError(f"table {target} exists")
    end = body if body >= 0 else start
    # all clauses stay: format, options, partitions, comment, properties
    clauses = st.text(k, end) if end > k else ""
    if st.find("USING", "STORED", start=k, stop=end) < 0:
        clauses = f"USING parquet {clauses}"
    parts = target.split(".")
    if len(parts) > 1:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted('.'.join(parts[:-1]))}")
    query = st.text(start)
    _swap(spark, target, lambda staging: spark.sql(f"CREATE TABLE {staging} {clauses} AS {query}"))
    return True


def _columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.table(quoted(table)).schema]


def _update(spark: SparkSession, st: Statement) -> None:
    target, k = st.name(1)
    alias, k = st.alias(k, "SET")
    if st.up(k) != "SET":
        raise DialectError("UPDATE without SET")
    where = st.find("WHERE", start=k)
    stop = where if where >= 0 else len(st.code)
    source = st.find("FROM", start=k, stop=stop)
    if source >= 0:
        if st.find(",", "JOIN", start=source, stop=stop) >= 0:
            raise DialectError("UPDATE with FROM of several relations: put them in a subquery")
        on = st.text(where + 1) if where >= 0 else "true"
        _merge(spark, Statement(f"MERGE INTO {st.text(1, k)} USING {st.text(source + 1, stop)} ON {on} WHEN MATCHED THEN UPDATE SET {st.text(k + 1, source)}"))
        return
    condition = st.text(where + 1) if where >= 0 else "true"
    new = {}
    for a, b in st.split(k + 1, stop):
        name, e = st.name(a)
        new[name.split(".")[-1].lower()] = st.text(e + 1, b)
    columns = _columns(spark, target)
    unknown = set(new) - {c.lower() for c, _ in columns}
    if unknown:
        raise ValueError(f"{target} has no column {sorted(unknown)[0]}")
    a = alias or "__t"
    picked = [f"CASE WHEN ({condition}) THEN CAST({new[c.lower()]} AS {kind}) ELSE {a}.`{c}` END AS `{c}`" if c.lower() in new else f"{a}.`{c}`" for c, kind in columns]
    if not alias:
        a = target.split(".")[-1]
        picked = [p.replace("__t.`", f"`{a}`.`") for p in picked]
    swap_table(spark, target, spark.sql(f"SELECT {', '.join(picked)} FROM {quoted(target)} AS {alias or f'`{a}`'}"))


def _delete(spark: SparkSession, st: Statement) -> None:
    target, k = st.name(2)
    alias, k = st.alias(k, "WHERE")
    condition = st.text(k + 1) if st.up(k) == "WHERE" else "true"
    a = alias or f"`{target.split('.')[-1]}`"
    # a row goes where the condition is true, not where it is unknown
    swap_table(spark, target, spark.sql(f"SELECT {a}.* FROM {quoted(target)} AS {a} WHERE NOT coalesce(({condition}), false)"))


def _merge(spark: SparkSession, st: Statement) -> None:
    target, k = st.name(2)
    alias, k = st.alias(k, "USING")
    t = alias or f"`{target.split('.')[-1]}`"
    k += 1
    if st.up(k) == "(":
        close = st.s.close(st.code, k)
        source, k = st.text(k, close + 1), close + 1
        s, k = st.alias(k, "ON")
        s = s or "__source"
    else:
        start = k
        name, k = st.name(k)
        source = st.text(start, k)
        s, k = st.alias(k, "ON")
        s = s or f"`{name.split('.')[-1]}`"
    first = st.find("WHEN", start=k)
    on = st.text(k + 1, first)
    columns = _columns(spark, target)
    source_columns = {c.lower() for c in spark.sql(f"SELECT * FROM {source} AS {s} LIMIT 0").columns}
    whens = [j for j in range(first, len(st.code)) if st.depth[j] == 0 and st.up(j) == "WHEN"]
    # WHEN inside CASE is no clause: a clause has MATCHED after it
    whens = [j for j in whens if st.up(j + 1) == "MATCHED" or st.up(j + 1) == "NOT" and st.up(j + 2) == "MATCHED"] + [len(st.code)]
    rules: dict[str, list[tuple[str, dict[str, str] | None]]] = {"both": [], "target": [], "source": []}
    for a, b in zip(whens, whens[1:]):
        j, kind = a + 2, "both"
        if st.up(a + 1) == "NOT":
            j, kind = a + 3, "source"
            if st.up(j) == "BY":
                kind = "target" if st.up(j + 1) == "SOURCE" else "source"
                j += 2
        then = next(x for x in range(j, b) if st.depth[x] == 0 and st.up(x) == "THEN" and st.up(x + 1) in ("UPDATE", "DELETE", "INSERT"))
        condition = st.text(j + 1, then) if st.up(j) == "AND" else "true"
        action = st.up(then + 1)
        if action == "DELETE":
            rules[kind].append((condition, None))
        elif action == "UPDATE":
            if st.up(then + 3) == "*":
                new = {c.lower(): f"{s}.`{c}`" for c, _ in columns if c.lower() in source_columns}
            else:
                new = {}
                for x, y in st.split(then + 3, b):
                    name, e = st.name(x)
                    new[name.split(".")[-1].lower()] = st.text(e + 1, y)
            rules[kind].append((condition, new))
        elif st.up(then + 2) == "*":
            rules[kind].append((condition, {c.lower(): f"{s}.`{c}`" for c, _ in columns if c.lower() in source_columns}))
        else:
            close = st.s.close(st.code, then + 2)
            names = [st.text(x, y).strip("`").split(".")[-1].lower() for x, y in st.split(then + 3, close)]
            values = [st.text(x, y) for x, y in st.split(close + 3, st.s.close(st.code, close + 2))]
            rules[kind].append((condition, dict(zip(names, values))))
    place = {"both": "__in_t AND __in_s", "target": "__in_t AND __in_s IS NULL", "source": "__in_t IS NULL AND __in_s"}
    keep = []
    for kind, rule in rules.items():
        for n, (condition, new) in enumerate(rule):
            earlier = "".join(f" AND NOT coalesce(({c}), false)" for c, _ in rule[:n])
            if new is None:
                keep.append(f"NOT coalesce({place[kind]} AND ({condition}){earlier}, false)")
    if rules["source"]:
        keep.append(f"({place['source']}) IS NOT TRUE OR " + " OR ".join(f"coalesce(({c}), false)" for c, _ in rules["source"]))
    else:
        keep.append("__in_t")
    picked = []
    for c, type_ in columns:
        cases = [f"WHEN {place[kind]} AND ({condition}) THEN " + (f"CAST({new[c.lower()]} AS {type_})" if new and c.lower() in new else f"{t}.`{c}`" if kind != "source" else "NULL") for kind, rule in rules.items() for condition, new in rule]
        picked.append(f"CASE {' '.join(cases)} ELSE {t}.`{c}` END AS `{c}`")
    # one pass: what is kept, and how many rows of the target are in pairs and alone, are told by the rows of the join
    told = f"({') AND ('.join(keep)}) AS __keep, coalesce({place['both']}, false) AS __pair, coalesce({place['target']}, false) AS __alone"
    query = f"SELECT {', '.join(picked)}, {told} FROM (SELECT *, true AS __in_t FROM {quoted(target)}) AS {t} FULL OUTER JOIN (SELECT *, true AS __in_s FROM {source} AS {s}) AS {s} ON {on}"
    seen, whole = Observation(), spark.table(quoted(target)).count()
    rows = spark.sql(query).observe(seen, F.count_if("__pair").alias("pairs"), F.count_if("__alone").alias("alone")).where("__keep").drop("__keep", "__pair", "__alone")

    def single() -> None:
        if rules["both"] and seen.get["pairs"] + seen.get["alone"] != whole:
            raise ValueError("MERGE: several source rows match one row of the target")

    swap_table(spark, target, rows, single)


def _upsert(spark: SparkSession, st: Statement) -> None:
    """INSERT OR REPLACE: rows take the place of those with the same key, which the table's property primary_key names."""
    target, k = st.name(4 if st.up(3) == "INTO" else 3)
    keys = [c.strip() for c in _layout(spark, target)[3].get("primary_key", "").split(",") if c.strip()]
    if not keys:
        raise DialectError(f"INSERT OR REPLACE: {target} has no property primary_key that names its key")
    names = [c for c, _ in _columns(spark, target)]
    if st.up(k) == "(" and st.up(k + 1) not in ("SELECT", "WITH", "FROM", "VALUES", "("):
        close = st.s.close(st.code, k)
        names, k = [st.text(x, y).strip("`") for x, y in st.split(k + 1, close)], close + 1
    upsert(spark, target, spark.sql(st.text(k)).toDF(*names), keys)


def upsert(spark: SparkSession, target: str, rows: DataFrame, keys: list[str]) -> None:
    """rows take the place of those of target with the same keys; columns that rows lack are null. Among repeated keys any
    one stays. A table that isn't there is made."""
    fresh = rows.dropDuplicates(keys)
    if spark.catalog.tableExists(quoted(target)):
        old = spark.table(quoted(target))
        have = {c.lower() for c in fresh.columns}
        padded = fresh.select(*[F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])
        fresh = old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(padded)
    swap_table(spark, target, fresh)


def execute(spark: SparkSession, statement: str) -> DataFrame | None:
    """Run one statement; the DataFrame of a query, which is not yet computed."""
    st = Statement(statement)
    head = st.up(0)
    if head == "CREATE" and _create(spark, st):
        return None
    if [head, st.up(1), st.up(2)] == ["INSERT", "OR", "REPLACE"]:
        _upsert(spark, st)
        return None
    if head in ("UPDATE", "DELETE", "MERGE"):
        {"UPDATE": _update, "DELETE": _delete, "MERGE": _merge}[head](spark, st)
        return None
    df = spark.sql(statement)
    return df if head in ("SELECT", "WITH", "FROM", "VALUES", "TABLE", "SHOW", "DESCRIBE", "EXPLAIN", "(") else None


def run_script(spark: SparkSession, text: str, done: list[str] | None = None) -> None:
    """Run all statements of a script in order; plain queries are computed and their rows dropped.

    done: statements that an earlier try has run, which aren't run again; those that succeed now are added to it.
    """
    done = [] if done is None else done
    for s in statements(shim(text))[len(done) :]:
        df = execute(spark, s)
        if df is not None and df.columns:
            df.write.format("noop").mode("overwrite").save()
        done.append(s)
