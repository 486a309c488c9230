"""Parsed Catalyst plans as Python trees. All use of Spark's internal classes is in this module."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


_OR_REPLACE = re.compile(r"\A\s*INSERT\s+OR\s+REPLACE\s+(?:INTO\s+)?", re.I)


class SqlError(ValueError):
    """The text is no Spark SQL."""


@dataclass
class Node:
    """A plan or an expression: short class name, children of the same kind, other fields."""

    kind: str
    children: list[Node]
    fields: dict[str, Any] = field(default_factory=dict)

    def parts(self, name: str) -> list[str]:
        """A sequence of names, that the JSON has as "[a, b]"."""
        value = self.fields.get(name)
        if isinstance(value, list):
            return [str(v) for v in value]
        return [p for p in (value or "")[1:-1].split(", ") if p]

    def all(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.all()


def _tree(items: list[dict]) -> Node:
    """A tree from its nodes in pre-order, each with its number of children."""
    at = 0

    def take() -> Node:
        nonlocal at
        raw = items[at]
        at += 1
        n = raw["num-children"]
        fields = {k: _value(v) for k, v in raw.items() if k not in ("class", "num-children")}
        return Node(raw["class"].rsplit(".", 1)[-1], [take() for _ in range(n)], fields)

    return take()


def _value(v: Any) -> Any:
    if isinstance(v, list):
        if v and isinstance(v[0], dict) and "num-children" in v[0]:
            return _tree(v)
        return [_value(x) for x in v]
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items()}
    return v


def parse(spark: SparkSession, sql: str) -> Node:
    """The parsed plan of one statement; INSERT OR REPLACE is read as an INSERT."""
    sql = _OR_REPLACE.sub("INSERT INTO ", sql, count=1)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # noqa: BLE001  (py4j raises several classes)
        raise SqlError(str(getattr(e, "java_exception", e)).strip().split("\n")[0]) from None
    return _tree(json.loads(plan.toJSON()))


def nested(value: Any) -> Iterator[Node]:
    """Nodes in a field, at any depth of lists and maps."""
    if isinstance(value, Node):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from nested(x)
    elif isinstance(value, dict):
        for x in value.values():
            yield from nested(x)


def with_relations(node: Node) -> list[tuple[str, Node]]:
    """Names and plans of a WITH clause."""
    return [(t["_1"], t["_2"]) for t in node.fields.get("cteRelations") or []]
