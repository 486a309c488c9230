import random

import pytest

from loomline.operators.references import orphans

REFS, PARENTS = "space string, key string, at long, ref string, start string", "space string, key string, valid_from long, valid_to long"


def brute(refs, parents):
    out = []
    for space, key, at, ref, _ in refs:
        mine = [(f, t) for s, k, f, t in parents if (s, k) == (space, key)]
        if key is None:
            continue
        if not mine:
            out.append((ref, "missing"))
        elif at is not None and not any((f is None or f <= at) and (t is None or t > at) for f, t in mine):
            out.append((ref, "deleted" if any(f is None or f <= at for f, t in mine) else "late"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < 0.4 else r.choice(["a", "b", "c", "d", None])
    refs = [(r.choice("xy"), key(), r.choice([None, *range(12)]), f"r{i}", "z") for i in range(400)]
    parents = []
    for _ in range(25):
        f = r.choice([None, *range(10)])
        parents.append((r.choice("xy"), key(), f, r.choice([None, (f or 0) + r.randrange(1, 4)])))
    parents += parents[:5]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), parts=7)
    assert sorted((x.ref, x.reason) for x in got.collect()) == brute(refs, parents)
    assert set(got.columns) == {"space", "key", "at", "ref", "start", "reason"}


def test_boundaries_and_empty(spark):
    refs = [("s", "k", 5, "before", ""), ("s", "k", 10, "first", ""), ("s", "k", 19, "last", ""), ("s", "k", 20, "end", ""), ("s", "k", None, "any", ""), ("t", "k", 12, "space", "")]
    parents = [("s", "k", 10, 20)]
    got = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS))
    assert sorted((x.ref, x.reason) for x in got.collect()) == [("before", "late"), ("end", "deleted"), ("space", "missing")]
    assert orphans(spark.createDataFrame([], REFS), spark.createDataFrame(parents, PARENTS)).count() == 0
    assert orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame([], PARENTS)).count() == 6


@pytest.mark.parametrize("share", [0.015, 0.9])
def test_hot_keys_are_split_in_proportion(spark, share):
    """No part of a key has more than about 1/parts of all references, whatever share of them the key has."""
    from loomline.operators.skew import hot_keys, salted

    n, parts = 6000, 1000
    refs = spark.range(n).selectExpr("'s' AS space", f"CASE WHEN id < {int(n * share)} THEN 'hot' ELSE concat('k', id) END AS key", "id AS at", "cast(id AS string) AS ref")
    hot = hot_keys(refs, ["space", "key"], parts)
    assert [(r.key, r["__salts"]) for r in hot.collect()] == [("hot", int(share * parts))]
    sizes = [r["count"] for r in salted(refs, hot, ["space", "key"], ["ref"], parts).groupBy("key", "__salt").count().collect()]
    assert max(sizes) < 6 * n / parts
    parents = spark.createDataFrame([("s", "hot", 10, 20)], PARENTS)
    got = orphans(refs, parents, parts).groupBy("key", "reason").count().where("key = 'hot'").collect()
    assert {r.reason: r["count"] for r in got} == {"late": 10, "deleted": int(n * share) - 20}
