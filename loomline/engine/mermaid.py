"""Mermaid text of a graph."""

from __future__ import annotations

from collections.abc import Iterable

from loomline.engine.model import Dag

LINEAGE, DAG, COMBINED = "lineage", "dag", "combined"

# Styles of the statuses, and the class that each status takes.
_STYLES = {"success": "success fill:#cfc,stroke:#393", "failed": "failed  fill:#fcc,stroke:#933", "running": "running fill:#ffc,stroke:#993", "skipped": "skipped fill:#eee,stroke:#999"}
_CLASS = {"success": "success", "failed": "failed", "test_failed": "failed", "running": "running", "skipped": "skipped"}


def node_id(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "_" for c in name)


def render(dag: Dag, mode: str = COMBINED, statuses: Iterable[tuple[str, str]] = (), outputs: dict[str, tuple[str, ...]] | None = None) -> str:
    """One line per edge. Statuses style the task nodes in modes with tasks and, with `outputs`, the datasets that
    a task writes in modes with datasets."""
    lines = ["graph LR"]
    if mode != DAG:
        seen = set()
        for e in dag.lineage_edges:
            a, b = node_id(e.src_dataset), node_id(e.dst_dataset)
            if (a, b) not in seen:
                seen.add((a, b))
                lines.append(f"    {a}[({e.src_dataset})] --> {b}[({e.dst_dataset})]")
    if mode != LINEAGE:
        lines += [f"    {node_id(e.upstream)}_task --> {node_id(e.downstream)}_task" for e in dag.task_edges]
    statuses = list(statuses)
    if statuses:
        lines += [f"    classDef {s}" for s in _STYLES.values()]
        for task, status in statuses:
            if status in _CLASS:
                nodes = [f"{node_id(task)}_task"] if mode != LINEAGE else []
                if mode != DAG:
                    nodes += [node_id(o) for o in (outputs or {}).get(task, ())]
                lines += [f"    class {n} {_CLASS[status]}" for n in nodes]
    return "\n".join(lines) + "\n"
