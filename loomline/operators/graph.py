"""Edges between tasks and datasets of a whole table of tasks, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.names import canonical
from loomline.operators.skew import salted_join


def _names(tasks: DataFrame, name: str, column: str, out: str) -> DataFrame:
    rows = tasks.select(canonical(name).alias("task"), F.explode(column).alias("x")).select("task", canonical("x").alias(out))
    return rows.where(f"task is not null and {out} is not null").distinct()


def task_edges(tasks: DataFrame, name: str = "name", inputs: str = "inputs", outputs: str = "outputs", depends_on: str = "depends_on") -> DataFrame:
    """(upstream, downstream), each once: a task reads what another one writes, or names it in depends_on and it is there.

    Null and blank names name nothing; a task that reads its own output has no edge to itself. A dataset that very many
    tasks read is split.
    """
    reads = _names(tasks, name, inputs, "dataset").withColumnRenamed("task", "downstream")
    writes = _names(tasks, name, outputs, "dataset").withColumnRenamed("task", "upstream")
    by_data = salted_join(reads, writes, ["dataset"], ["downstream"]).select("upstream", "downstream")
    known = tasks.select(canonical(name).alias("upstream")).where("upstream is not null").distinct()
    named = salted_join(_names(tasks, name, depends_on, "upstream").withColumnRenamed("task", "downstream"), known, ["upstream"], ["downstream"])
    return by_data.unionByName(named.select("upstream", "downstream")).where("upstream <> downstream").distinct()


def lineage_edges(tasks: DataFrame, name: str = "name", inputs: str = "inputs", outputs: str = "outputs") -> DataFrame:
    """(src_dataset, dst_dataset, via_task) for each input and output of each task, each once; datasets to themselves are none."""
    a = tasks.select(canonical(name).alias("via_task"), F.explode(inputs).alias("i"), F.col(outputs).alias("o"))
    b = a.select("via_task", canonical("i").alias("src_dataset"), F.explode("o").alias("o")).select("src_dataset", canonical("o").alias("dst_dataset"), "via_task")
    return b.where("via_task is not null and src_dataset is not null and dst_dataset is not null and src_dataset <> dst_dataset").distinct()
