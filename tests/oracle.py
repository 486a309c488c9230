"""Comparison of a registered query with its SQL in DuckDB."""

import os
from collections import Counter
from decimal import Decimal
from pathlib import Path

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return v


def _rows(table):
    names = sorted(table.column_names)
    return Counter(tuple(map(_plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names))), names


def same(spark, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'" if f.is_dir() else f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, mine = _rows(query(spark, str(DATA)).toArrow())
    wanted, theirs = _rows(con.execute(sql).to_arrow_table())
    assert mine == theirs, name
    assert got == wanted, (name, list((got - wanted).items())[:3], list((wanted - got).items())[:3])
