"""Parent-child links to full hierarchies by contraction of partition-local chains.

Each level of the recursion
  1. rakes leaves: nodes that are nobody's parent take their result from the parent at the end;
  2. contracts: a parent with a single child may move to the child's partition (never more than one row
     moves to a place, so no partition grows with the fan-out of a node); there, chains of parents that lie
     in the same partition shrink to fragments, each known by its exit, the last node of the chain;
  3. solves the quotient forest, whose nodes are the exits, in the same way;
  4. expands the fragments, with loops found either inside a partition or in the quotient.
Leaves and branching nodes go in step 1, about a third of the rest in step 2, so a level has at most about
two thirds of the rows of the one above, whatever the shape. At base_rows or fewer one task solves the rest.

Full paths come by the same steps from the forest that is left when the nodes on loops lose their parents: a link of the
quotient carries the names that its fragment took in, and expanding it puts them back. Descendants are read off the
paths. Joins to a parent split the parents that have more than 1/PARTS of all children.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.skew import copied, salted
from loomline.session import written

TREE, ON_LOOP, BELOW_LOOP = 0, 1, 2
BASE_ROWS, PART_ROWS, PARTS = 512, 200_000, 1000
#: Names that the one task of the last level puts out at once.
CHUNK = 1_000_000

_LINKS = "node string, parent string, w long, loop boolean"
_RESULT = "node string, root string, dist long, kind int"
_PATHS = "node string, path array<string>"
_PIECE = "node string, top string, down array<string>, exit string, seg array<string>"
_FRAGMENT = "node string, top string, hops long, down array<string>, exit string, exit_w long, kind int, loop boolean"


def links(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """One row (node, parent) for each name in either column; parent is null for nodes without one.

    Self links and null names are no links. If a node has several parents the smallest is taken (see
    ambiguous_parents for a report). Repeated rows count once.
    """
    pair = edges.select(F.col(parent).alias("p"), F.col(child).alias("c"))
    real = F.col("p").isNotNull() & F.col("c").isNotNull() & (F.col("p") != F.col("c"))
    ends = pair.select(
        F.explode(
            F.array(
                F.struct(F.col("c").alias("node"), F.when(real, F.col("p")).alias("parent")),
                F.struct(F.col("p").alias("node"), F.lit(None).cast("string").alias("parent")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))


def ambiguous_parents(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """(node, n_parents, parents_min, parents_max) of nodes with more than one parent other than themselves."""
    e = edges.where((F.col(parent) != F.col(child)) & F.col(child).isNotNull())
    return (
        e.groupBy(F.col(child).alias("node"))
        .agg(F.countDistinct(parent).alias("n_parents"), F.min(parent).alias("parent_min"), F.max(parent).alias("parent_max"))
        .where("n_parents > 1")
    )


def _chains(node: list, parent: list) -> tuple[list[int], list[int], list[list[int]]]:
    """For each row: the row of the next local ancestor or -1, an order in which parents come first, and loops."""
    at = {n: i for i, n in enumerate(node)}
    up = [at.get(p, -1) if p is not None else -1 for p in parent]
    state, order, loops = bytearray(len(node)), [], []
    for i in range(len(node)):
        path = []
        j = i
        while j >= 0 and state[j] == 0:
            state[j] = 1
            path.append(j)
            j = up[j]
        if j >= 0 and state[j] == 1:
            loops.append(path[path.index(j) :])
        order.extend(reversed(path))
        for k in path:
            state[k] = 2
    return up, order, loops


def _none(x):
    return None if x is None or x != x else x


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Local chains of one partition; its size is bounded by the caller."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    node, parent = rows["node"].tolist(), [_none(p) for p in rows["parent"].tolist()]
    w, was_loop = rows["w"].tolist(), rows["loop"].tolist()
    up, order, loops = _chains(node, parent)
    n = len(node)
    top, hops, down, kind, is_loop = [""] * n, [0] * n, [None] * n, [TREE] * n, list(was_loop)
    done = bytearray(n)
    for ring in loops:
        rep = min(ring, key=lambda k: node[k])
        for k in ring:
            top[k], down[k], kind[k], done[k] = node[rep], [], ON_LOOP, 1
            up[k] = -1
            parent[k] = None
        is_loop[rep] = True
    for i in order:
        if done[i]:
            continue
        j = up[i]
        if j < 0:
            top[i], down[i] = node[i], []
        else:
            top[i], hops[i], down[i] = top[j], hops[j] + w[i], [*down[j], node[i]]
            if kind[j] != TREE:
                kind[i], down[i] = BELOW_LOOP, []
        done[i] = 1
    own = [t == x for t, x in zip(top, node)]
    yield pd.DataFrame(
        {
            "node": node, "top": top, "hops": hops, "down": down,
            "exit": [p if o else None for p, o in zip(parent, own)], "exit_w": w, "kind": kind, "loop": is_loop,
        }
    )


def _base(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    node, parent = rows["node"].tolist(), [_none(p) for p in rows["parent"].tolist()]
    w, was_loop = rows["w"].tolist(), rows["loop"].tolist()
    up, order, loops = _chains(node, parent)
    n = len(node)
    root, dist, kind, done = [""] * n, [0] * n, [TREE] * n, bytearray(n)
    for ring in loops:
        rep = min(node[k] for k in ring)
        for k in ring:
            root[k], kind[k], done[k] = rep, ON_LOOP, 1
    for i in order:
        if done[i]:
            continue
        j = up[i]
        if j < 0:
            root[i], kind[i] = node[i], ON_LOOP if was_loop[i] else TREE
        else:
            root[i], dist[i], kind[i] = root[j], dist[j] + w[i], BELOW_LOOP if kind[j] != TREE else TREE
        done[i] = 1
    yield pd.DataFrame({"node": node, "root": root, "dist": dist, "kind": kind})


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_contract for paths: seg are the names between a node and its parent; there are no loops."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    node, parent, seg = rows["node"].tolist(), [_none(p) for p in rows["parent"].tolist()], [list(x) for x in rows["seg"]]
    up, order, _ = _chains(node, parent)
    top, down = list(node), [[] for _ in node]
    for i in order:
        j = up[i]
        if j >= 0:
            top[i], down[i] = top[j], [*down[j], *seg[i], node[i]]
    own = [j < 0 for j in up]
    yield pd.DataFrame({"node": node, "top": top, "down": down, "exit": [p if o else None for p, o in zip(parent, own)], "seg": seg})


def _base_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    node, parent, seg = rows["node"].tolist(), [_none(p) for p in rows["parent"].tolist()], [list(x) for x in rows["seg"]]
    up, order, _ = _chains(node, parent)
    path: list[list[str]] = [[] for _ in node]
    done, names = [], 0
    for i in order:
        path[i] = [*path[up[i]], *seg[i], node[i]] if up[i] >= 0 else [node[i]]
        done.append(i)
        names += len(path[i])
        if names > CHUNK:
            yield pd.DataFrame({"node": [node[k] for k in done], "path": [path[k] for k in done]})
            done, names = [], 0
    yield pd.DataFrame({"node": [node[k] for k in done], "path": [path[k] for k in done]})


class _Level:
    """One level of the recursion: leaves raked off, the rest placed for contraction."""

    def __init__(self, t: DataFrame, rows: int, level: int, part_rows: int):
        self.rows, spark = rows, t.sparkSession
        # rake: one row for each parent, with its only child if it has just one
        child = t.where("parent is not null").groupBy(F.col("parent").alias("q")).agg(F.min("node").alias("c0"), F.max("node").alias("c1"), F.count(F.lit(1)).alias("n"))
        child = child.select("q", F.when(F.col("c0") == F.col("c1"), F.col("c0")).alias("only"), "n")
        marked = written(t.join(child, t["node"] == child["q"], "left").select(*t.columns, F.col("q").isNotNull().alias("inner"), "only", "n"), "forest")
        self.leaves = marked.where("not inner and parent is not null").select(*t.columns)
        self.alone = marked.where("not inner and parent is null").select(*t.columns)
        # fewer than PARTS parents
        hot = marked.where(F.col("n") > max(1, rows // PARTS)).select("node", F.least(F.ceil(F.col("n") * PARTS / rows), F.col("n")).cast("int")).collect()
        self.hot = spark.createDataFrame(hot, "parent string, __salts int") if hot else None
        # contract: a parent goes to the partition of its only child where the child's turn is higher
        turn = lambda c: F.xxhash64(F.col(c), F.lit(level))
        place = F.when(turn("only") > turn("node"), F.col("only")).otherwise(F.col("node"))
        self.placed = marked.where("inner").withColumn("place", place).repartition(max(2, -(-rows // part_rows)), "place").select(*t.columns)

    def below(self, rows: DataFrame, parents: DataFrame) -> DataFrame:
        """rows joined with the row of their parent; the children of a parent with many are spread."""
        if self.hot is None:
            return rows.join(parents, "parent")
        return salted(rows, self.hot, ["parent"], ["node"], PARTS).join(copied(parents, self.hot, ["parent"]), ["parent", "__salt"]).drop("__salt")


def _expand(t: DataFrame, level: int, base_rows: int, part_rows: int) -> DataFrame:
    """t: (node, parent, seg), written, without loops; returns (node, path)."""
    rows = t.count()
    if rows <= base_rows:
        return t.repartition(1).mapInPandas(_base_paths, _PATHS)
    at = _Level(t, rows, level, part_rows)
    frag = written(at.placed.mapInPandas(_fragments, _PIECE), "fragments")
    tops = frag.where("node = top").select("node", F.col("exit").alias("parent"), "seg")
    into = frag.select(F.col("node").alias("parent"), F.col("top").alias("vt"), "down")
    joined = at.below(tops.where("parent is not null"), into).select("node", F.col("vt").alias("parent"), F.concat("down", "seg").alias("seg"))
    quotient = written(joined.unionByName(tops.where("parent is null")), "quotient")
    above = written(_expand(quotient, level + 1, base_rows, part_rows), "solved").select(F.col("node").alias("top"), "path")
    body = written(frag.select("node", "top", "down").join(above, "top").select("node", F.concat("path", "down").alias("path")), "expanded")
    fall = at.below(at.leaves, body.select(F.col("node").alias("parent"), "path")).select("node", F.concat("path", "seg", F.array("node")).alias("path"))
    return body.unionByName(fall).unionByName(at.alone.select("node", F.array("node").alias("path")))


def _solve(t: DataFrame, level: int, base_rows: int, part_rows: int) -> DataFrame:
    """t: (node, parent, w, loop), written; returns (node, root, dist, kind)."""
    rows = t.count()
    if rows <= base_rows:
        return t.repartition(1).mapInPandas(_base, _RESULT)
    at = _Level(t, rows, level, part_rows)
    alone = at.alone.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("dist"), F.when(F.col("loop"), ON_LOOP).otherwise(TREE).alias("kind"))
    frag = written(at.placed.mapInPandas(_contract, _FRAGMENT), "fragments")
    tops = frag.where("node = top").select("node", F.col("exit").alias("parent"), F.col("exit_w").alias("w"), "loop")
    into = frag.select(F.col("node").alias("parent"), F.col("top").alias("vt"), F.col("hops").alias("vh"), F.col("down").alias("vd"))
    joined = at.below(tops.where("parent is not null"), into)
    joined = joined.select("node", F.col("vt").alias("parent"), (F.col("w") + F.col("vh")).cast("long").alias("w"), "loop", F.col("vd").alias("entry"))
    quotient = written(joined.unionByName(tops.where("parent is null"), allowMissingColumns=True), "quotient")
    above = written(_solve(quotient.select("node", "parent", "w", "loop"), level + 1, base_rows, part_rows), "solved")
    # expand: nodes between the entry of a loop into a fragment and the fragment's exit lie on that loop
    ring = above.where(F.col("kind") == ON_LOOP).select("node")
    on_ring = quotient.where("parent is not null").join(ring, "node", "left_semi").select(F.explode("entry").alias("m")).distinct()
    own = frag.select("node", F.col("top").alias("t"), "hops", F.col("kind").alias("local"))
    up = above.select(F.col("node").alias("t"), "root", "dist", F.col("kind").alias("outer"))
    kind = (
        F.when(F.col("outer") == TREE, TREE)
        .when((F.col("node") == F.col("t")), F.col("outer"))
        .when((F.col("local") == ON_LOOP) | F.col("m").isNotNull(), ON_LOOP)
        .otherwise(BELOW_LOOP)
    )
    body = own.join(up, "t").join(on_ring, own["node"] == on_ring["m"], "left").select("node", "root", (F.col("dist") + F.col("hops")).cast("long").alias("dist"), kind.cast("int").alias("kind"))
    body = written(body, "expanded")
    hang = body.select(F.col("node").alias("parent"), "root", "dist", F.col("kind").alias("pk"))
    fall = at.below(at.leaves, hang).select(
        "node", "root", (F.col("dist") + F.col("w")).cast("long").alias("dist"), F.when(F.col("pk") == TREE, TREE).otherwise(BELOW_LOOP).cast("int").alias("kind")
    )
    return body.unionByName(fall).unionByName(alone.select("node", "root", "dist", F.col("kind").cast("int").alias("kind")))


def hierarchy(edges: DataFrame, parent: str, child: str, base_rows: int = BASE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, root, depth, kind) of each name in edges.

    Trees: depth from the root (0 for the root itself), kind "tree". Nodes on a loop: depth -1, kind "loop";
    nodes that hang below one: depth -2, kind "below_loop"; the root of both is the smallest name on the loop.
    An empty table gives an empty result; null names are skipped; repeated rows count once; other columns of
    edges are ignored, whatever their names.

    base_rows bounds the quotient that one task solves alone, part_rows the expected rows of a partition.
    """
    start = written(links(edges, parent, child).select("node", "parent", F.lit(1).cast("long").alias("w"), F.lit(False).alias("loop")), "links")
    found = written(_solve(start, 0, base_rows, part_rows), "hierarchy")
    loop_root = found.where(F.col("kind") == ON_LOOP).groupBy(F.col("root").alias("r")).agg(F.min("node").alias("loop_root"))
    tree = found.where(F.col("kind") == TREE).select("node", "root", F.col("dist").cast("int").alias("depth"), F.lit("tree").alias("kind"))
    looped = (
        found.where(F.col("kind") != TREE)
        .join(loop_root, F.col("root") == F.col("r"))
        .select(
            "node", F.col("loop_root").alias("root"), F.when(F.col("kind") == ON_LOOP, -1).otherwise(-2).alias("depth"),
            F.when(F.col("kind") == ON_LOOP, F.lit("loop")).otherwise(F.lit("below_loop")).alias("kind"),
        )
    )
    return tree.unionByName(looped)


def paths(edges: DataFrame, parent: str, child: str, base_rows: int = BASE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, path) with path the names from the root to the node.

    A node on a loop is its own root here; the path of a node below a loop begins with the last node on the loop.
    """
    looped = hierarchy(edges, parent, child, base_rows, part_rows).where("kind = 'loop'").select(F.col("node").alias("l"))
    cut = links(edges, parent, child).join(looped, F.col("node") == F.col("l"), "left")
    start = cut.select("node", F.when(F.col("l").isNull(), F.col("parent")).alias("parent"), F.array().cast("array<string>").alias("seg"))
    return written(_expand(written(start, "links"), 0, base_rows, part_rows), "paths")


def ancestors(edges: DataFrame, parent: str, child: str, base_rows: int = BASE_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, ancestor, distance) of each node and each of its ancestors: read by ancestor, all descendants.

    Nodes on a loop have no ancestors, those below one have them up to and with the last node on the loop. The output
    has as many rows as the sum of all depths.
    """
    every = paths(edges, parent, child, base_rows, part_rows).select("node", "path", F.posexplode("path").alias("k", "ancestor"))
    return every.where(F.col("k") < F.size("path") - 1).select("node", "ancestor", (F.size("path") - 1 - F.col("k")).cast("int").alias("distance"))
