"""The graph of tasks: edges, order, layers, closures. All of it is metadata and stays on the driver."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

from loomline.engine.model import Dag, LineageEdge, Task, TaskEdge


class CycleError(ValueError):
    def __init__(self, names: Iterable[str]):
        self.names = sorted(names)
        super().__init__("DAG contains a cycle")


def build_dag(tasks: list[Task]) -> Dag:
    """Edges from depends_on (names that no task has are ignored) and from the task that writes an input, the last
    one that lists it. Lineage edges join each input with each output, repeated and self edges included."""
    known = {t.name for t in tasks}
    producer = {o: t.name for t in tasks for o in t.outputs}
    edges: set[TaskEdge] = set()
    lineage: list[LineageEdge] = []
    for t in tasks:
        edges |= {TaskEdge(d, t.name) for d in t.depends_on if d in known}
        edges |= {TaskEdge(producer[i], t.name) for i in t.inputs if producer.get(i, t.name) != t.name}
        lineage += [LineageEdge(i, o, t.name) for i in t.inputs for o in t.outputs]
    order = [n for layer in _layers(known, edges) for n in layer]
    return Dag(order, sorted(edges), lineage)


def _layers(names: set[str], edges: Iterable[TaskEdge]) -> list[list[str]]:
    """Kahn's levels, each sorted by name."""
    waiting = dict.fromkeys(names, 0)
    nexts = defaultdict(list)
    for e in edges:
        waiting[e.downstream] += 1
        nexts[e.upstream].append(e.downstream)
    layer = sorted(n for n, k in waiting.items() if not k)
    out = []
    done = 0
    while layer:
        out.append(layer)
        done += len(layer)
        ready: list[str] = []
        for n in layer:
            for x in nexts[n]:
                waiting[x] -= 1
                if not waiting[x]:
                    heapq.heappush(ready, x)
        layer = sorted(ready)
    if done < len(waiting):
        raise CycleError(n for n, k in waiting.items() if k)
    return out


def topo_layers(tasks: list[Task]) -> list[list[str]]:
    return _layers({t.name for t in tasks}, build_dag(tasks).task_edges)


def reach(edges: Iterable[tuple[str, str]], start: str) -> set[str]:
    """All that can be reached from start, by a search with a visited set; loops are no trouble."""
    nexts = defaultdict(set)
    for a, b in edges:
        nexts[a].add(b)
    seen: set[str] = set()
    todo = [start]
    while todo:
        for x in nexts[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def downstream_of(tasks: list[Task], name: str) -> list[str]:
    """All tasks that depend on the named one, itself not among them; empty if the graph can't be built."""
    try:
        dag = build_dag(tasks)
    except CycleError:
        return []
    return sorted(reach([(e.upstream, e.downstream) for e in dag.task_edges], name) - {name})


def closure(edges: Iterable[LineageEdge], table: str, up: bool = False) -> list[tuple[str, str]]:
    """(table, via_task) of every link on a way down from table (or up to it), distinct and sorted."""
    links = list(edges)
    pairs = [(e.dst_dataset, e.src_dataset) if up else (e.src_dataset, e.dst_dataset) for e in links]
    on_way = reach(pairs, table) | {table}
    return sorted({(b, e.via_task) for e, (a, b) in zip(links, pairs) if a in on_way})
