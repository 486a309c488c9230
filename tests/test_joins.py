import random

from loomline.operators.joins import asof_join, range_join


def test_asof(spark):
    r = random.Random(1)
    left = [(i, r.choice(["a", "b", None]), r.choice([None, *range(20)]), "l") for i in range(60)] * 2
    right = [(r.choice(["a", "b", None]), r.choice([None, *range(20)]), r.choice([None, *range(100)]), "r") for _ in range(40)]
    a, b = spark.createDataFrame(left, "id int, k string, t int, v string"), spark.createDataFrame(right, "k string, s int, x int, v string")

    def want(k, t):
        best = [(s, x is not None, x or 0, x, v) for kk, s, x, v in right if kk == k and k is not None and s is not None and t is not None and s <= t]
        return max(best)[3:] if best else (None, None)

    got = sorted(((r.id, r.x, r.v_right) for r in asof_join(a, b, ["k"], "t", "s", ["x", "v"]).collect()), key=str)
    assert got == sorted(((i, *want(k, t)) for i, k, t, _ in left), key=str)
    assert asof_join(a, b, ["k"], "t", "s", ["x"], inner=True).count() == sum(want(k, t) != (None, None) for _, k, t, _ in left)
    assert asof_join(a, b.limit(0), ["k"], "t", "s", ["x"]).where("x is not null").count() == 0


def test_range(spark):
    p = spark.createDataFrame([(1, 0.0), (2, 9.99), (3, 10.0), (4, -3.0), (5, None)], "id int, v double")
    q = spark.createDataFrame([("a", 0.0, 10.0), ("b", 9.0, 31.0), ("c", 5.0, 4.0), ("d", None, 1.0), ("e", -4.0, -2.0)], "n string, lo double, hi double")
    got = {(r.id, r.n) for r in range_join(p, q, "v", "lo", "hi", 4).collect()}
    assert got == {(1, "a"), (2, "a"), (3, "a"), (2, "b"), (3, "b"), (4, "e")}
