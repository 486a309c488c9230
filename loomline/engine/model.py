"""Tasks, edges and lineage as plain records."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class TaskTest:
    query: str
    assertion: str


@dataclass(frozen=True)
class Task:
    name: str = ""
    description: str | None = None
    owner: str | None = None
    sql: str = ""
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    schedule: str | None = None
    retries: int = 0
    timeout_seconds: int | None = None
    incremental_by: str | None = None
    tags: tuple[str, ...] = ()
    tests: tuple[TaskTest, ...] = ()
    file_path: str | None = None

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, d: dict) -> Task:
        """Missing fields take their defaults."""
        known = {k: d[k] for k in cls.__dataclass_fields__ if d.get(k) is not None}
        for k in ("inputs", "outputs", "depends_on", "tags"):
            known[k] = tuple(known.get(k, ()))
        known["tests"] = tuple(t if isinstance(t, TaskTest) else TaskTest(t["query"], t["assertion"]) for t in known.get("tests", ()))
        return cls(**known)


@dataclass(frozen=True, order=True)
class TaskEdge:
    upstream: str
    downstream: str


@dataclass(frozen=True, order=True)
class LineageEdge:
    src_dataset: str
    dst_dataset: str
    via_task: str


@dataclass
class Dag:
    order: list[str] = field(default_factory=list)
    task_edges: list[TaskEdge] = field(default_factory=list)
    lineage_edges: list[LineageEdge] = field(default_factory=list)


@dataclass(frozen=True, order=True)
class Transformation:
    kind: str  # DIRECT or INDIRECT
    subtype: str  # IDENTITY TRANSFORMATION AGGREGATION WINDOW FILTER JOIN_KEY GROUP_BY SORT


@dataclass
class InputField:
    dataset: str
    field: str
    transformations: list[Transformation]


@dataclass
class ColumnLineage:
    output_field: str
    inputs: list[InputField] = field(default_factory=list)
    unresolved: bool = False


@dataclass
class Extract:
    output_dataset: str
    columns: list[ColumnLineage] = field(default_factory=list)
    unresolved_wildcards: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {
            "output_dataset": self.output_dataset,
            "columns": [
                {
                    "output_field": c.output_field,
                    "inputs": [{"dataset": i.dataset, "field": i.field, "transformations": [{"type": t.kind, "subtype": t.subtype} for t in i.transformations]} for i in c.inputs],
                    **({"unresolved": True} if c.unresolved else {}),
                }
                for c in self.columns
            ],
            "unresolved_wildcards": self.unresolved_wildcards,
        }
