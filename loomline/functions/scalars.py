"""Scalar functions over text and JSON, and their registration for SQL.

Functions that need Spark's parser run on the driver: workers have no access to it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomline.engine import dag as D
from loomline.engine import mermaid
from loomline.engine.dialect import DialectError, Script
from loomline.engine.model import Dag, LineageEdge, Task, TaskEdge
from loomline.engine.taskfile import load_directory, parse_task
from loomline.engine.templating import substitute
from loomline.plans.columns import extract_column_lineage
from loomline.plans.io import extract_io


def _dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def hello(name: str | None) -> str | None:
    """A greeting of at most 256 bytes."""
    return None if name is None else f"hello {name} from loomline".encode()[:256].decode(errors="ignore")


def parse_task_json(sql: str | None, file_path: str | None) -> str | None:
    """The task as JSON; {"error": ...} for a header that can't be read."""
    if sql is None:
        return None
    try:
        return _dumps(parse_task(sql, file_path or None).to_dict())
    except ValueError as e:
        return _dumps({"error": str(e)})


def _tasks(text: str) -> list[Task]:
    return [Task.from_dict(d) for d in json.loads(text)]


def build_dag_json(tasks: str | None) -> str | None:
    if tasks is None:
        return None
    try:
        d = D.build_dag(_tasks(tasks))
    except (ValueError, TypeError, KeyError) as e:
        return _dumps({"error": str(e)})
    return _dumps({"order": d.order, "task_edges": [{"from": e.upstream, "to": e.downstream} for e in d.task_edges], "lineage_edges": [vars(e) for e in d.lineage_edges]})


def topo_layers_json(tasks: str | None) -> str | None:
    if tasks is None:
        return None
    try:
        return _dumps(D.topo_layers(_tasks(tasks)))
    except (ValueError, TypeError, KeyError) as e:
        return _dumps({"error": str(e)})


def downstream_of_json(tasks: str | None, name: str | None) -> str | None:
    if tasks is None or name is None:
        return None
    try:
        return _dumps(D.downstream_of(_tasks(tasks), name))
    except (ValueError, TypeError, KeyError):
        return "[]"


def render_mermaid_json(dag: str | None, mode: int | None, statuses: str | None) -> str | None:
    """mode 0: lineage, 1: tasks, any other: both. statuses: a list of {task_name, status}; wrong JSON counts as none."""
    if dag is None:
        return None
    d = json.loads(dag)
    known = Dag(d.get("order", []), [TaskEdge(e["from"], e["to"]) for e in d.get("task_edges", [])], [LineageEdge(**e) for e in d.get("lineage_edges", [])])
    try:
        pairs = [(s["task_name"], s["status"]) for s in json.loads(statuses or "[]")]
    except (ValueError, TypeError, KeyError):
        pairs = []
    return mermaid.render(known, {0: mermaid.LINEAGE, 1: mermaid.DAG}.get(mode, mermaid.COMBINED), pairs)


def substitute_json(sql: str | None, values: str | None) -> str | None:
    return None if sql is None else substitute(sql, json.loads(values or "{}"))


def extract_io_json(spark: SparkSession, sql: str | None) -> str | None:
    found = extract_io(spark, sql)
    return None if found is None else _dumps(found)


def extract_column_lineage_json(spark: SparkSession, sql: str, schemas: str | None = None) -> str:
    return _dumps([e.to_dict() for e in extract_column_lineage(spark, sql, json.loads(schemas or "{}"))])


def load_directory_json(spark: SparkSession | None, folder: str) -> str:
    """{tasks, errors} of a folder; with a session, missing inputs and outputs are filled."""
    tasks, errors = load_directory(folder, (lambda s: extract_io(spark, s)) if spark else None)
    return _dumps({"tasks": [t.to_dict() for t in tasks], "errors": errors})


#: Functions of plain text, that may run on workers.
SQL_FUNCTIONS = {
    "orch_hello": hello, "orch_parse_task": parse_task_json, "orch_build_dag": build_dag_json, "orch_topo_layers": topo_layers_json, "orch_downstream_of": downstream_of_json,
    "orch_render_mermaid": render_mermaid_json, "orch_substitute_vars": substitute_json,
}


#: Functions that need Spark's parser or the driver's files: Engine.sql works them out before the statement runs.
DRIVER_FUNCTIONS = {"orch_extract_io": extract_io_json, "orch_load_directory_json": load_directory_json, "orch_extract_column_lineage": extract_column_lineage_json}

_registered: set[int] = set()


def register_functions(spark: SparkSession) -> None:
    """Make the functions of plain text callable in SQL, once in a session. They take Arrow batches."""
    mark = hash(spark._jsparkSession.hashCode())
    if mark not in _registered:
        for name, f in SQL_FUNCTIONS.items():
            spark.udf.register(name, F.udf(f, "string", useArrow=True))
        _registered.add(mark)


def driver_calls(spark: SparkSession, text: str) -> str:
    """The text with calls of DRIVER_FUNCTIONS, whose arguments must be strings as written, replaced by their results."""
    if not any(name in text.lower() for name in DRIVER_FUNCTIONS):
        return text
    s = Script(text)
    code = s.code()
    for k, i in enumerate(code[:-1]):
        f = DRIVER_FUNCTIONS.get(s.toks[i].text.lower()) if s.toks[i].kind == "word" else None
        if f is None or s.toks[code[k + 1]].text != "(":
            continue
        end = s.close(code, k + 1)
        given = [s.toks[j] for j in code[k + 2 : end] if s.toks[j].text != ","]
        if any(t.kind != "string" or t.text[0] == "`" for t in given):
            raise DialectError(f"{s.toks[i].text}: its arguments are texts as written, as the driver works it out")
        result = f(spark, *(_value(t.text) for t in given))
        for j in range(i, code[end] + 1):
            s.toks[j].text = ""
        s.toks[i].text = "CAST(NULL AS STRING)" if result is None else "'" + result.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "".join(t.text for t in s.toks)


def _value(literal: str) -> str:
    """The text that a string literal stands for: a doubled quote is one, a backslash takes the next sign as it is."""
    quote, body = literal[0], literal[1:-1]
    named = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
    return re.sub(rf"\\(.)|{quote}{quote}", lambda m: named.get(m[1], m[1]) if m[1] else quote, body, flags=re.S)
