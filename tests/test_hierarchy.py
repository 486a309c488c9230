import random

import pytest

from loomline.operators.hierarchy import ambiguous_parents, ancestors, hierarchy, paths

SCHEMA = "src string, dst string"


def brute(edges):
    up, nodes = {}, set()
    for p, c in edges:
        nodes |= {x for x in (p, c) if x is not None}
        if p is not None and c is not None and p != c:
            up[c] = min(up.get(c, p), p)
    out = []
    for n in nodes:
        path = [n]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if path[-1] not in up:
            out.append((n, path[-1], len(path) - 1, "tree"))
        else:
            ring = path[path.index(up[path[-1]]) :]
            out.append((n, min(ring), -1 if n in ring else -2, "loop" if n in ring else "below_loop"))
    return sorted(out)


def forest(seed, n):
    """Trees, long chains, hubs and loops, with repeated, self and null links."""
    r = random.Random(seed)
    names = [f"d{r.randrange(10**6)}_{i}" for i in range(n)]
    edges = []
    for i in range(1, n):
        kind = r.random()
        p = i - 1 if kind < 0.5 else 0 if kind < 0.65 else r.randrange(i) if kind < 0.93 else None
        if p is not None:
            edges.append((names[p], names[i]))
        else:
            edges.append((None, names[i]))
    for _ in range(4):  # close loops: a root becomes a child of one of its own
        k = r.randrange(n)
        if not any(c == names[k] for p, c in edges if p):
            edges.append((names[min(n - 1, k + r.randrange(1, 5))], names[k]))
    edges += [(names[3], names[3])] + r.sample(edges, n // 10)
    r.shuffle(edges)
    return edges


@pytest.mark.parametrize(("seed", "n", "base"), [(1, 40, 1000), (3, 300, 40), (4, 80, 3)])
def test_against_brute_force(spark, seed, n, base):
    edges = forest(seed, n)
    got = hierarchy(spark.createDataFrame(edges, SCHEMA), "src", "dst", base)
    assert sorted((r.node, r.root, r.depth, r.kind) for r in got.collect()) == brute(edges)


@pytest.mark.parametrize("base", [6])
def test_loops_and_chains(spark, base):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    ring = [(f"r{i:02}", f"r{(i + 1) % 25:02}") for i in range(25)]
    below = [("r03", "x1"), ("x1", "x2"), ("x2", "x3"), ("r07", "y1")]
    edges = chain + ring + below + [("p", "q"), ("q", "p"), (None, None)]
    got = hierarchy(spark.createDataFrame(edges, SCHEMA), "src", "dst", base)
    assert sorted((r.node, r.root, r.depth, r.kind) for r in got.collect()) == brute(edges)


def test_empty_and_clashing_columns(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA), "src", "dst").count() == 0
    df = spark.createDataFrame([("a", "b", "x", 1)], "src string, dst string, node string, w int")
    assert sorted((r.node, r.depth) for r in hierarchy(df, "src", "dst").collect()) == [("a", 0), ("b", 1)]


def test_ancestors_and_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "f"), ("l", "m"), ("m", "l"), ("m", "n"), ("n", "o"), ("z", "z")]
    df = spark.createDataFrame(edges, SCHEMA)
    got = {(r.node, r.ancestor, r.distance) for r in ancestors(df, "src", "dst").collect()}
    assert got == {
        ("b", "a", 1), ("c", "b", 1), ("c", "a", 2), ("d", "c", 1), ("d", "b", 2), ("d", "a", 3), ("e", "d", 1), ("e", "c", 2), ("e", "b", 3), ("e", "a", 4),
        ("f", "b", 1), ("f", "a", 2), ("n", "m", 1), ("o", "n", 1), ("o", "m", 2),
    }
    line = {r.node: r.path for r in paths(df, "src", "dst").collect()}
    assert line["e"] == ["a", "b", "c", "d", "e"] and line["z"] == ["z"] and line["o"] == ["m", "n", "o"] and len(line) == 11


def test_ambiguous_parents(spark):
    df = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "c"), ("a", "d"), ("a", "d"), (None, "e")], SCHEMA)
    assert [(r.node, r.n_parents, r.parent_min) for r in ambiguous_parents(df, "src", "dst").collect()] == [("c", 2, "a")]


@pytest.mark.parametrize(("seed", "n", "base"), [(5, 150, 30), (6, 60, 1000)])
def test_paths_against_brute_force(spark, seed, n, base):
    """Paths expanded from fragments, over several levels, with hubs that have many children."""
    edges = forest(seed, n)
    edges += [(edges[0][1], f"leaf{i}") for i in range(60)]
    up = {}
    for p, c in edges:
        if p is not None and p != c:
            up[c] = min(up.get(c, p), p)
    ring = {x for x, _, _, kind in brute(edges) if kind == "loop"}
    want = {}
    for x, *_ in brute(edges):
        path = [x]
        while path[-1] in up and path[-1] not in ring:
            path.append(up[path[-1]])
        want[x] = path[::-1]
    df = spark.createDataFrame(edges, SCHEMA)
    got = {r.node: r.path for r in paths(df, "src", "dst", base).collect()}
    assert got == want
    pairs = sorted((r.node, r.ancestor, r.distance) for r in ancestors(df, "src", "dst", base).collect())
    assert pairs == sorted((x, a, len(p) - 1 - k) for x, p in want.items() for k, a in enumerate(p[:-1]))
