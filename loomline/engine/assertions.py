"""Assertions on the result of a query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loomline.engine.dialect import shim


def _number(text: str) -> int:
    m = re.match(r"\s*([+-]?[0-9]+)", text)
    return int(m[1]) if m else 0


def check(df: DataFrame, assertion: str) -> tuple[bool, str | None]:
    """(passed, error). Verbs: expect_empty, expect_non_empty, expect n, expect_gt n, expect_lt n; the last three look
    at the first cell of the first row: null counts as 0, a missing n as 0, no row fails."""
    verb, _, rest = assertion.strip().partition(" ")
    if verb in ("expect_empty", "expect_non_empty"):
        empty = df.isEmpty()
        return (empty, None) if verb == "expect_empty" else (not empty, None)
    if verb not in ("expect", "expect_gt", "expect_lt"):
        return False, f"unknown assertion: {assertion}"
    row = df.limit(1).collect()
    if not row:
        return False, "no rows"
    cell = row[0][0]
    value, wanted = int(cell) if cell is not None else 0, _number(rest)
    passed = {"expect": value == wanted, "expect_gt": value > wanted, "expect_lt": value < wanted}[verb]
    return passed, None if passed else f"got {value}"


def run_test(spark: SparkSession, query: str, assertion: str) -> tuple[bool, str | None]:
    try:
        return check(spark.sql(shim(query)), assertion)
    except Exception as e:  # noqa: BLE001
        return False, f"test query error: {str(e).splitlines()[0] if str(e) else e}"
