"""Graphs as tables of links: components, chains and clusters. Loops run on the cluster and are cut each round."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .joins import finite, neighbours


def fingerprint(links: DataFrame) -> tuple:
    """Tells sets of different links (a, b) apart, of any size: a sum of hashes would leave 64 bits."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> node, root; root is the smallest node reachable. nodes (node): also those without links.

    Large-star and small-star steps in turn (Kiveris et al., Connected Components in MapReduce and Beyond): a minimum for
    each node, combined before the shuffle, and a join back which adaptive execution may split at a hub.
    """
    state = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "links")
    before = None
    for _ in range(rounds):
        now = fingerprint(state)
        if now == before:
            break
        before = now
        both = state.unionAll(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        state = cut(small.filter("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"connected_components: not done after {rounds} rounds")
    out = state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    if nodes is None:
        return out
    return nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def cluster_points(points: DataFrame, key: str, names: Sequence[str], tol: float) -> DataFrame:
    """key, cluster (its smallest key): points linked by steps of at most tol.

    Only one link a point is needed inside a grid cell whose diagonal is below tol, and one for two such cells that hold
    points within tol: different places are compared, and what leaves a task is cells' smallest keys, not pairs of points.
    """
    fine = tol / len(names) ** 0.5 * 0.999
    ids = [f"_f{i}" for i in range(len(names))]
    cells = finite(points, names).select(F.col(key).cast("long").alias("a"), *(F.col(n).cast("double").alias(n) for n in names), *(F.floor(F.col(n) / fine).cast("long").alias(i) for n, i in zip(names, ids, strict=True)))
    heads = cells.groupBy(*ids).agg(F.min("a").alias("b"))
    members = cells.join(heads, ids)
    places = cut(members.groupBy(*names).agg(F.min("b").alias("head")), "places")
    near = neighbours(places, places, names, tol).filter("_l_head < _r_head").select(F.col("_l_head").alias("a"), F.col("_r_head").alias("b")).distinct()
    links = members.select("a", "b").filter("a <> b").unionAll(near)
    return connected_components(links, points.select(F.col(key).cast("long").alias("node"))).select(F.col("node").alias(key), F.col("root").alias("cluster"))


def merge_points(points: DataFrame, key: str, names: Sequence[str], tol: float) -> DataFrame:
    """Each cluster's centroid and size."""
    found = points.join(cluster_points(points, key, names, tol), key)
    return found.groupBy("cluster").agg(*(F.avg(n).alias(n) for n in names), F.count("*").alias("n"))


def grid_links(cells: DataFrame, key: str, names: Sequence[str], diagonal: bool = True) -> DataFrame:
    """a, b: links of neighbouring cells (whole-number columns), by an equi-join on half of the neighbour offsets."""
    offsets = [o for o in itertools.product((-1, 0, 1), repeat=len(names)) if o > (0,) * len(names) and (diagonal or sum(map(abs, o)) == 1)]
    shifted = cells.select(F.col(key).alias("a"), F.explode(F.array(*(F.struct(*((F.col(n) + d).cast("long").alias(n) for n, d in zip(names, o, strict=True))) for o in offsets))).alias("c"))
    return shifted.join(cells.select(F.col(key).alias("b"), F.struct(*(F.col(n).cast("long").alias(n) for n in names)).alias("c")), "c").select("a", "b")


def voxel_clusters(cells: DataFrame, names: Sequence[str] = ("i", "j", "k"), diagonal: bool = True) -> DataFrame:
    """cells with cluster: cells that touch (26 neighbours in 3D, 8 in 2D; 6 and 4 without diagonals), named by a member's key.

    The key is the cell's place as one number, so the name is that of the first cell in coordinate order.
    """
    low = cells.agg(*(F.min(n) for n in names), *(F.max(n) for n in names)).first()
    if low is None or low[0] is None:
        return cells.withColumn("cluster", F.lit(None).cast("long"))
    key = F.lit(0).cast("long")
    for i, n in enumerate(names):
        key = key * (low[len(names) + i] - low[i] + 1) + (F.col(n) - low[i])
    keyed = cells.select(*names).distinct().withColumn("_key", key.cast("long"))
    found = connected_components(grid_links(keyed, "_key", names, diagonal), keyed.select(F.col("_key").alias("node")))
    return keyed.join(found, keyed["_key"] == found["node"]).select(*names, F.col("root").alias("cluster"))


def chain(pairs: DataFrame) -> DataFrame:
    """pairs (a, b), directed -> chain, position, node. Chains run until their end or a branch; a loop starts at its smallest node.

    List ranking: each round doubles how far every node looks back.
    """
    one = pairs.filter("a <> b").distinct()
    out1 = one.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b")).filter("n = 1").select("a", "b")
    in1 = one.groupBy("b").agg(F.count("*").alias("n")).filter("n = 1").select("b")
    next_ = cut(out1.join(in1, "b", "left_semi"), "chain")
    single = one.join(next_, ["a", "b"], "left_anti")
    nodes = next_.select(F.col("a").alias("node")).union(next_.select(F.col("b"))).distinct()
    # loops have no first node: cut them before their smallest
    comp = connected_components(next_.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    sized = comp.join(next_.select(F.col("b").cast("long").alias("node")).withColumn("_in", F.lit(1)), "node", "left").groupBy("root").agg(F.count("*").alias("n"), F.count("_in").alias("m")).withColumn("loop", F.col("n") == F.col("m"))
    state = nodes.select(F.col("node").cast("long").alias("node")).join(next_.select(F.col("b").cast("long").alias("node"), F.col("a").cast("long").alias("up")), "node", "left")
    state = state.join(comp, "node").join(sized.select("root", "loop"), "root")
    state = state.select("node", F.when(F.col("loop") & (F.col("node") == F.col("root")), F.lit(None)).otherwise(F.col("up")).alias("up"), "loop", "root")
    state = cut(state.select("node", "root", "loop", F.coalesce("up", "node").alias("head"), F.col("up").isNotNull().cast("long").alias("position"), "up"), "rank")
    while True:
        above = state.select(F.col("node").alias("up"), F.col("head").alias("_head"), F.col("position").alias("_position"), F.col("up").alias("_up"))
        more = state.join(above, "up", "left").select("node", "root", "loop", F.coalesce("_head", "head").alias("head"), (F.col("position") + F.coalesce("_position", F.lit(0))).alias("position"), F.col("_up").alias("up"))
        state = cut(more, "rank")
        if not state.filter("up is not null").limit(1).count():
            break
    ranked = state.select(F.col("head").alias("chain"), "position", "node", "loop")
    # a link at a branch is a chain of its own
    alone = single.select(F.struct("a", "b").alias("s")).select(F.explode(F.array(F.struct(F.col("s.a").cast("long").alias("node"), F.lit(0).cast("long").alias("position"), F.col("s.a").cast("long").alias("chain"), F.col("s.b").cast("long").alias("to")), F.struct(F.col("s.b").cast("long").alias("node"), F.lit(1).cast("long").alias("position"), F.col("s.a").cast("long").alias("chain"), F.col("s.b").cast("long").alias("to")))).alias("r"))
    return ranked.select("chain", F.lit(None).cast("long").alias("branch_to"), "position", "node", "loop").unionByName(alone.select(F.col("r.chain").alias("chain"), F.col("r.to").alias("branch_to"), F.col("r.position").alias("position"), F.col("r.node").alias("node"), F.lit(False).alias("loop")))


# ---- mesh edges -----------------------------------------------------------------------------------------------------------
def directed_edges(faces: DataFrame) -> DataFrame:
    """fid, v0, v1 of each face's three edges; faces are (fid, a, b, c)."""
    return faces.select("fid", F.explode(F.array(F.struct(F.col("a").alias("v0"), F.col("b").alias("v1")), F.struct(F.col("b").alias("v0"), F.col("c").alias("v1")), F.struct(F.col("c").alias("v0"), F.col("a").alias("v1")))).alias("e")).select("fid", "e.v0", "e.v1")


def unique_edges(faces: DataFrame) -> DataFrame:
    """lo, hi, n: each undirected edge and in how many faces it is."""
    return directed_edges(faces).groupBy(F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi")).agg(F.count("*").alias("n"))


def checked_edges(faces: DataFrame) -> DataFrame:
    """unique_edges, failing where an edge is in over two faces."""
    return unique_edges(faces).withColumn("n", F.when(F.col("n") > 2, F.raise_error(F.lit("an edge is in more than two faces")).cast("long")).otherwise(F.col("n")))


def boundary_edges(faces: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """v0, v1 of the edges of just one (masked) face, in its direction."""
    used = faces if mask is None else faces.join(mask, "fid", "left_semi")
    keyed = directed_edges(used).select("v0", "v1", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    return keyed.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("v0").alias("v0"), F.min("v1").alias("v1")).filter("n = 1").select("v0", "v1")


def boundary_vertices(faces: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    e = boundary_edges(faces, mask)
    return e.select(F.explode(F.array("v0", "v1")).alias("vid")).distinct()


def nonmanifold_vertices(faces: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Boundary vertices that start more than one boundary edge."""
    return boundary_edges(faces, mask).groupBy(F.col("v0").alias("vid")).agg(F.count("*").alias("n")).filter("n > 1").select("vid")


def boundary_loops(faces: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """chain, position, node of the boundary loops, against the direction of the faces; fails at a non-manifold vertex."""
    bad = nonmanifold_vertices(faces, mask).limit(1).count()
    if bad:
        raise ValueError("boundary_loops: a vertex is in more than one loop")
    return chain(boundary_edges(faces, mask).select(F.col("v1").cast("long").alias("a"), F.col("v0").cast("long").alias("b"))).drop("branch_to")


def patches(faces: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """fid, patch (its smallest fid): faces connected over shared edges."""
    used = faces if mask is None else faces.join(mask, "fid", "left_semi")
    keyed = directed_edges(used).select("fid", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    head = keyed.groupBy("lo", "hi").agg(F.min("fid").alias("head"))
    links = keyed.join(head, ["lo", "hi"]).filter("fid <> head").select(F.col("fid").cast("long").alias("a"), F.col("head").cast("long").alias("b"))
    return connected_components(links, used.select(F.col("fid").cast("long").alias("node"))).select(F.col("node").alias("fid"), F.col("root").alias("patch"))


def patch_inside_loop(faces: DataFrame, loop: DataFrame) -> DataFrame:
    """fid of the patch to the left of a directed vertex loop (position, node), bounded by it."""
    n = loop.count()
    step = loop.select("position", F.col("node").alias("v0")).join(loop.select(F.pmod(F.col("position") - 1, F.lit(n)).alias("position"), F.col("node").alias("v1")), "position").select("v0", "v1")
    wall = step.select(F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi")).distinct()
    keyed = directed_edges(faces).select("fid", "v0", "v1", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    inner = keyed.join(wall, ["lo", "hi"], "left_anti")
    head = inner.groupBy("lo", "hi").agg(F.min("fid").alias("head"))
    links = inner.join(head, ["lo", "hi"]).filter("fid <> head").select(F.col("fid").cast("long").alias("a"), F.col("head").cast("long").alias("b"))
    comp = connected_components(links, faces.select(F.col("fid").cast("long").alias("node")))
    seeds = keyed.join(step, ["v0", "v1"], "left_semi").select(F.col("fid").cast("long").alias("node")).distinct()
    roots = comp.join(seeds, "node", "left_semi").select("root").distinct()
    return comp.join(roots, "root", "left_semi").select(F.col("node").alias("fid"))
