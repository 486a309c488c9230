from collections import Counter, defaultdict

import pytest

from loomline import pipeline_queries as P

ROWS = [(1, 1, 7, 70, "A"), (2, 1, 5, 50, "N"), (2, 2, 6, 60, "R"), (2, 3, 5, 55, "N"), (3, 1, 4, 41, "A"), (3, 2, 9, 42, "R"), (4, 1, 3, 30, None), (4, 2, None, 31, "R"), *[(5, k, k % 7, k, "ANR"[k % 5 % 3]) for k in range(1, 400)]]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder whose orders have one, several and very many lines, nulls and ties."""
    folder = tmp_path_factory.mktemp("lines")
    spark.createDataFrame(ROWS, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def _groups(column):
    out = defaultdict(list)
    for r in ROWS:
        out[r[0]].append(r[column])
    return out


def _values(spark, name, folder):
    return {r.k: r.v for r in P.QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("name", ["first", "last", "any_value"])
def test_member_of_every_group(spark, lines, name):
    got, groups = _values(spark, f"agg_{name}_all", lines), _groups(2)
    assert got.keys() == groups.keys() and all(got[k] in g for k, g in groups.items())


def test_mode_of_every_group(spark, lines):
    got, groups = _values(spark, "agg_mode_all", lines), _groups(4)
    assert got.keys() == groups.keys()
    for k, g in groups.items():
        n = Counter(x for x in g if x is not None)
        assert n[got[k]] == max(n.values()), k


@pytest.mark.parametrize(("name", "column"), [("array_agg", 1), ("string_agg", 4), ("list", 3)])
def test_whole_lists(spark, lines, name, column):
    wanted = {k: ",".join(map(str, sorted(x for x in g if x is not None))) for k, g in _groups(column).items()}
    assert _values(spark, f"agg_{name}", lines) == wanted
