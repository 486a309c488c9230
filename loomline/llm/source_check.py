"""Source files that do not parse in the language their extension tells."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.batches import slices
from loomline.llm.syntax.core import Fault
from loomline.llm.syntax.json_lang import parse_json
from loomline.llm.syntax.python_lang import parse_python
from loomline.llm.syntax.sql_lang import parse_sql
from loomline.session import spread

PARSERS: dict[str, Callable[[str], list[Fault]]] = {"sql": parse_sql, "py": parse_python, "json": parse_json}
_FAULT = "array<struct<line:int,message:string>>"


def faults_of(language: str, text: str) -> list[Fault]:
    """All faults of a text in order of place; none if it parses."""
    return PARSERS[language](text)


def language_of(path: Column) -> Column:
    """The lower-case extension of a path, null where there is none that a parser is known for."""
    e = F.lower(F.regexp_extract(path, r"\.([^./]+)\s*$", 1))
    return F.when(e.isin(*PARSERS), e)


def check_files(files: DataFrame, path: str, body: str) -> DataFrame:
    """(path, repository, language, faults array<struct<line,message>>) of each file, one row for each.

    faults is in order of place and empty for a file that parses. Files without a body (null) or of an unknown
    language are left out; an empty SQL or Python body parses, an empty JSON body doesn't. Very long bodies are
    parsed whole. The columns of files besides path and body may have any names.
    """
    rows = files.select(F.col(path).alias("path"), F.col(body).alias("body"))
    rows = rows.select("path", F.substring_index("path", "/", 1).alias("repository"), language_of(F.col("path")).alias("language"), "body").where("language is not null and body is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8000))
        gc.set_threshold(200_000, 50, 50)  # parsers leave no cycles behind
        kind = pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))
        for b in slices(batches, 3):
            found = [[{"line": f.line, "message": f.message} for f in faults_of(lang, text)] for lang, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, kind)], ["path", "repository", "language", "faults"])

    return spread(rows).mapInArrow(run, f"path string, repository string, language string, faults {_FAULT}")


def rates(checked: DataFrame) -> DataFrame:
    """(repository, language, n_files, n_invalid, invalid_rate, accepted_rate of the language)."""
    bad = F.count_if(F.size("faults") > 0)
    by = checked.groupBy("repository", "language").agg(F.count(F.lit(1)).alias("n_files"), bad.alias("n_invalid"))
    lang = by.groupBy("language").agg((1 - F.sum("n_invalid") / F.sum("n_files")).alias("language_accepted"))
    return by.join(lang, "language").select("repository", "language", "n_files", "n_invalid", (F.col("n_invalid") / F.col("n_files")).alias("invalid_rate"), "language_accepted")
