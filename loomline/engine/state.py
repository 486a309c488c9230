"""State of the engine: small keyed tables on the driver, kept in a folder, offered as DataFrames.

Runs of tasks and their lineage are metadata: their size goes with the number of tasks, not of rows. A lock orders
all changes. New and replaced rows are appended to the table's file, of which the last line of a key counts and a
broken last line doesn't; a deletion writes the whole table beside the old one and renames it.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable, Iterable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "tasks": "name string, description string, owner string, sql string, inputs array<string>, outputs array<string>, depends_on array<string>, schedule_cron string, retries int, timeout_seconds int, incremental_by string, tags array<string>, file_path string, registered_at timestamp",
    "runs": "run_id string, pipeline_run_id string, task_name string, started_at timestamp, finished_at timestamp, status string, rows_count bigint, error_message string, error_context_json string, retry_count int, last_processed_at timestamp",
    "lineage_edges": "src_dataset string, dst_dataset string, via_task string, transform_type string, discovered_at timestamp, source string",
    "task_edges": "upstream string, downstream string",
    "tests": "task_name string, test_idx int, query string, assertion string",
    "column_lineage": "src_dataset string, src_column string, dst_dataset string, dst_column string, via_task string, transform_kind string, subtype string, description string, discovered_at timestamp",
    "watermarks": "task_name string, column_name string, value string",
    "schedules": "pipeline_or_task string, cron_expr string, timezone string, enabled boolean, last_triggered_at timestamp, next_trigger_at timestamp",
}
KEYS = {
    "tasks": ("name",), "runs": ("run_id",), "lineage_edges": ("src_dataset", "dst_dataset", "via_task"), "task_edges": ("upstream", "downstream"), "tests": ("task_name", "test_idx"),
    "column_lineage": ("src_dataset", "src_column", "dst_dataset", "dst_column", "via_task", "subtype"), "watermarks": ("task_name",), "schedules": ("pipeline_or_task",),
}
COLUMNS = {t: [c.split()[0] for c in s.split(", ")] for t, s in SCHEMAS.items()}
_TIMES = {t: [c.split()[0] for c in s.split(", ") if c.endswith(" timestamp")] for t, s in SCHEMAS.items()}


class StateStore:
    def __init__(self, folder: str | None = None):
        self.folder = Path(folder) if folder else None
        self.lock = threading.RLock()
        self._rows: dict[str, dict[tuple, dict]] = {t: {} for t in SCHEMAS}
        self.changed = dict.fromkeys(SCHEMAS, 0)
        self._cut = dict.fromkeys(SCHEMAS, True)  # the first line that is added may follow a broken one
        if self.folder:
            self.folder.mkdir(parents=True, exist_ok=True)
            for t in SCHEMAS:
                path = self.folder / f"{t}.jsonl"
                if path.exists():
                    for line in path.read_text(encoding="utf-8").split("\n"):
                        try:
                            row = json.loads(line)
                        except ValueError:  # the end of the file, or of a write that was cut off
                            continue
                        for c in _TIMES[t]:
                            row[c] = datetime.fromisoformat(row[c]) if row[c] else None
                        self._rows[t][self._key(t, row)] = row

    @staticmethod
    def _key(table: str, row: dict) -> tuple:
        return tuple(row[k] for k in KEYS[table])

    @staticmethod
    def _lines(rows: Iterable[dict]) -> str:
        return "".join(json.dumps(r, default=lambda d: d.isoformat(), ensure_ascii=False) + "\n" for r in rows)

    def _append(self, table: str, rows: list[dict]) -> None:
        if self.folder and rows:
            with (self.folder / f"{table}.jsonl").open("a", encoding="utf-8") as f:
                f.write("\n" * (f.tell() > 0 and self._cut.pop(table, False)) + self._lines(rows))

    def _rewrite(self, table: str) -> None:
        if self.folder:
            path = self.folder / f"{table}.jsonl"
            tmp = path.with_suffix(".next")
            tmp.write_text(self._lines(self._rows[table].values()), encoding="utf-8")
            os.replace(tmp, path)

    def rows(self, table: str, where: Callable[[dict], bool] | None = None) -> list[dict]:
        with self.lock:
            return [dict(r) for r in self._rows[table].values() if where is None or where(r)]

    def upsert(self, table: str, rows: Iterable[dict]) -> None:
        """Insert, or replace rows with the same key."""
        with self.lock:
            full = [{c: r.get(c) for c in COLUMNS[table]} for r in rows]
            self.changed[table] += bool(full)
            for r in full:
                self._rows[table][self._key(table, r)] = r
            self._append(table, full)

    def insert_new(self, table: str, rows: Iterable[dict]) -> None:
        """Insert rows whose key isn't there."""
        with self.lock:
            fresh = []
            for r in rows:
                full = {c: r.get(c) for c in COLUMNS[table]}
                if self._rows[table].setdefault(self._key(table, full), full) is full:
                    fresh.append(full)
            self.changed[table] += bool(fresh)
            self._append(table, fresh)

    def delete(self, table: str, where: Callable[[dict], bool]) -> int:
        with self.lock:
            gone = [k for k, r in self._rows[table].items() if where(r)]
            for k in gone:
                del self._rows[table][k]
            if gone:
                self.changed[table] += 1
                self._rewrite(table)
            return len(gone)

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        data = [tuple(r[c] for c in COLUMNS[table]) for r in self.rows(table)]
        return spark.createDataFrame(data, SCHEMAS[table])
