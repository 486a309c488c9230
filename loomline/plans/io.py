"""Inputs and outputs of SQL text, from parsed plans."""

from __future__ import annotations


from pyspark.sql import SparkSession

from loomline.engine.dialect import shim, statements
from loomline.engine.templating import placeholders_to_literals
from loomline.plans.catalyst import Node, SqlError, nested, parse, with_relations

_WRITES = {"CreateTableAsSelect", "ReplaceTableAsSelect", "CreateTable", "ReplaceTable", "CreateView", "CreateViewCommand", "CreateTempViewUsing"}


def name_of(node: Node) -> str:
    return ".".join(node.parts("nameParts") or node.parts("multipartIdentifier"))


def _reads(node: Node, ctes: frozenset[str], out: set[str]) -> None:
    if node.kind == "UnresolvedRelation":
        name = name_of(node)
        if name.lower() not in ctes:
            out.add(name)
    if node.kind == "UnresolvedWith":
        recursive = bool(node.fields.get("allowRecursion"))
        seen = ctes
        for name, plan in with_relations(node):
            own = seen | {name.lower()} if recursive else seen
            _reads(plan, own, out)
            seen = seen | {name.lower()}
        ctes = seen
    for key, value in node.fields.items():
        if key == "cteRelations" or (node.kind == "InsertIntoStatement" and key == "table"):
            continue
        for n in nested(value):
            _reads(n, ctes, out)
    for c in node.children:
        _reads(c, ctes, out)


def plan_io(node: Node) -> tuple[set[str], set[str]]:
    """(inputs, outputs) of one statement."""
    reads: set[str] = set()
    writes: set[str] = set()
    if node.kind == "UnresolvedWith" and node.children and node.children[0].kind == "InsertIntoStatement":
        insert = node.children[0]
        writes.add(name_of(insert.fields["table"]))
    if node.kind == "InsertIntoStatement":
        writes.add(name_of(node.fields["table"]))
        _reads(node, frozenset(), reads)
    elif node.kind in _WRITES:
        for c in node.children:
            if c.kind in ("UnresolvedIdentifier", "ResolvedIdentifier"):
                writes.add(name_of(c))
            else:
                _reads(c, frozenset(), reads)
        if node.kind == "CreateViewCommand":
            table = node.fields.get("name") or {}
            writes.add(".".join(str(table[k]) for k in ("database", "table") if isinstance(table, dict) and table.get(k)))
            for n in nested(node.fields.get("plan")):
                _reads(n, frozenset(), reads)
    elif node.kind in ("UpdateTable", "DeleteFromTable", "MergeIntoTable"):
        target = next((n for n in node.children[0].all() if n.kind == "UnresolvedRelation"), None)
        if target:
            writes.add(name_of(target))
        _reads(node, frozenset(), reads)
    else:
        _reads(node, frozenset(), reads)
    return reads, writes - {""}


def extract_io(spark: SparkSession, sql: str | None) -> dict[str, list[str]] | None:
    """{"inputs": [...], "outputs": [...]}, sorted and distinct, over all statements of the text.

    None for None; both empty for text that does not parse. Placeholders count as literals. Names that a WITH
    clause defines are no inputs, where they are in scope; subqueries anywhere are read.
    """
    if sql is None:
        return None
    reads: set[str] = set()
    writes: set[str] = set()
    try:
        for s in statements(shim(placeholders_to_literals(sql))):
            r, w = plan_io(parse(spark, s))
            reads |= r
            writes |= w
    except (SqlError, ValueError):
        return {"inputs": [], "outputs": []}
    return {"inputs": sorted(reads), "outputs": sorted(writes)}
