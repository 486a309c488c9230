import random

import pytest

from loomline.llm.percentiles import combine, frequencies, percentiles
from loomline.llm.topn import candidates, top_n

SCHEMA = "g string, s long, item string, rank int"


@pytest.mark.parametrize(("seed", "n", "bins", "parts"), [(1, 3, 16, 3), (2, 1, 4, 2), (3, 100, 1024, 10), (4, 5, 1, 4)])
def test_top_n(spark, seed, n, bins, parts):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", "c", None]), r.choice([None, *range(40)]), r.choice([None] + [f"i{k}" for k in range(300)]), 7) for _ in range(900)]
    rows += r.sample(rows, 300)
    want = set()
    for g in {x[0] for x in rows} - {None}:
        mine = sorted({(-s, i) for gg, s, i, _ in rows if gg == g and s is not None and i is not None})[:n]
        want |= {(g, -s, i, k) for k, (s, i) in enumerate(mine, 1)}
    got = top_n(spark.createDataFrame(rows, SCHEMA), "g", "s", ["item"], n, bins, parts).collect()
    assert {(x.g, x.s, x.item, x["rank"]) for x in got} == want and len(got) == len(want)


def test_thresholds_are_the_groups_own(spark):
    """One far-off score in another group, and scores from one end of the longs to the other, leave the pruning alone."""
    rows = [("hot", k, f"i{k:06}") for k in range(20000)] + [("far", 2**63 - 1, "a"), ("far", -(2**63), "b"), ("far", 0, "c")] + [("same", 7, f"t{k:05}") for k in range(3000)] + [("one", 5, "again")] * 5000
    df = spark.createDataFrame(rows, "g string, s long, item string")
    got = {}
    for x in top_n(df, "g", "s", ["item"], 3).collect():
        got.setdefault(x.g, []).append((x["rank"], x.s, x.item))
    assert {g: sorted(v) for g, v in got.items()} == {
        "hot": [(1, 19999, "i019999"), (2, 19998, "i019998"), (3, 19997, "i019997")], "far": [(1, 2**63 - 1, "a"), (2, 0, "c"), (3, -(2**63), "b")],
        "same": [(k + 1, 7, f"t{k:05}") for k in range(3)], "one": [(1, 5, "again")],
    }
    kept = candidates(df.selectExpr("g AS __g", "s AS __s", "item"), ["item"], 3, 1024, 10_000)
    assert kept.where("__g = 'hot'").count() < 60


def test_top_n_of_nothing(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "s", ["item"], 3).count() == 0
    assert top_n(spark.createDataFrame([(None, 1, "a", 0), ("g", None, "a", 0)], SCHEMA), "g", "s", ["item"], 3).count() == 0


def test_percentiles(spark):
    r = random.Random(5)
    rows = [(r.choice(["m1", "m2", "m3"]), r.choice(["hot"] * 4 + ["a", "b", None]), r.choice([None, *range(60)])) for _ in range(700)] + [("m1", "one", 5)]
    df = spark.createDataFrame(rows, "month string, g string, v long")
    months = [frequencies(df.where(f"month = '{m}'"), ["g"], "v") for m in ("m1", "m2", "m3")]
    got = percentiles(combine(months[0].unionByName(months[1]).unionByName(months[2]), "g", "v"), "g", "v", (1, 50, 90, 99, 100))
    for x in got.collect():
        mine = sorted(v for _, g, v in rows if g == x.g and v is not None)
        assert x.n == len(mine) and all(x[f"p{p}"] == mine[-(-len(mine) * p // 100) - 1] for p in (1, 50, 90, 99, 100))
    assert got.count() == 4
    assert percentiles(frequencies(df.limit(0), ["g"], "v"), "g", "v", (50,)).count() == 0
