"""Expressions, aggregates, series and curves on small fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import angles as A
from plumbline.functions import shapes as S
from plumbline.functions import vectors as V
from plumbline.operators import curves, graph, joins, masks, sampling, series, stats


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first()


def test_vectors(spark):
    a, b, c, p = V.vec(0.0, 0.0), V.vec(2.0, 0.0), V.vec(0.0, 2.0), V.vec(0.5, 0.5)
    row = one(spark, V.triangle_area(a, b, c), *V.barycentric(a, b, c, p), *V.barycentric(a, a, a, p), V.three_point_angle(a, b, c), V.distance_to_line(a, b, c))
    assert row[0] == 2.0 and list(row[1:4]) == [0.5, 0.25, 0.25] and list(row[4:7]) == [0, 0, 0]
    assert row[7] == pytest.approx(math.pi / 2) and row[8] == 2.0
    q = V.roll(V.unroll(V.vec(3.0, 4.0, 7.0), 2.0), 2.0)
    assert list(one(spark, *q)) == pytest.approx([3, 4, 7])
    m = V.euler_to_matrix(*V.vec(10.0, -20.0, 30.0))
    assert list(one(spark, *V.matrix_to_euler(m))) == pytest.approx([10, -20, 30])
    assert one(spark, *V.pinhole(V.vec(1.0, 1.0, -1.0), 1, 1, 0, 0))[0] is None


def test_angles_and_intervals(spark):
    row = one(spark, A.to_2pi(F.lit(-0.5)), A.signed_pi(F.lit(math.pi)), A.shortest(F.lit(0.1), F.lit(6.2)), A.in_direction(F.lit(0.0), F.lit(1.0), -1), A.signed_complement(F.lit(1.0)))
    assert list(row) == pytest.approx([2 * math.pi - 0.5, -math.pi, 6.1 - 2 * math.pi, 2 * math.pi - 1, 1 - 2 * math.pi])
    i, j = A.interval(F.lit(3.0), F.lit(1.0)), A.interval(F.lit(2.0), F.lit(5.0))
    row = one(spark, i, A.interval_intersection(i, j), A.interval_contains(i, F.lit(3.0)), A.interval(F.lit(float("nan")), F.lit(1.0)), A.arc_contains(F.lit(6.0), F.lit(1.0), F.lit(0.5)))
    assert tuple(row[0]) == (1, 3) and tuple(row[1]) == (2, 3) and row[2] and row[3] is None and row[4]


def test_shapes(spark):
    c, r = S.circle_from_3_points(V.vec(1.0, 0.0), V.vec(0.0, 1.0), V.vec(-1.0, 0.0))
    assert list(one(spark, *c, r)) == pytest.approx([0, 0, 1])
    assert one(spark, S.circle_from_3_points(V.vec(0.0, 0.0), V.vec(1.0, 0.0), V.vec(2.0, 0.0))[1])[0] is None
    p, q = S.circles_intersections(V.vec(0.0, 0.0), F.lit(1.0), V.vec(1.0, 0.0), F.lit(1.0))
    assert list(one(spark, *p, *q)) == pytest.approx([0.5, math.sqrt(0.75), 0.5, -math.sqrt(0.75)])
    assert list(one(spark, *S.intersect_lines(V.vec(0.0, 0.0), V.vec(1.0, 1.0), V.vec(2.0, 0.0), V.vec(0.0, 1.0)))) == [2, 2]
    low, high = S.arc_aabb(V.vec(0.0, 0.0), F.lit(2.0), F.lit(0.0), F.lit(math.pi))
    assert list(one(spark, *low, *high)) == pytest.approx([-2, 0, 2, 2], abs=1e-12)
    n, d = S.plane_from_points(V.vec(0.0, 0.0, 1.0), V.vec(1.0, 0.0, 1.0), V.vec(0.0, 1.0, 1.0))
    assert list(one(spark, *n, d)) == [0, 0, 1, 1]
    against = S.plane_intersection_distance(n, d, V.vec(0.0, 0.0, 3.0), V.vec(0.0, 0.0, -1.0))
    assert one(spark, against, S.plane_intersection_distance(n, d, V.vec(0.0, 0.0, 3.0), V.vec(0.0, 0.0, -1.0), True))[0:2] == (None, 2.0)
    o, u = S.planes_intersection(V.vec(1.0, 0.0, 0.0), F.lit(2.0), V.vec(0.0, 1.0, 0.0), F.lit(3.0))
    assert list(one(spark, *o, *u)) == [2, 3, 0, 0, 0, 1]
    for (a, b), side in zip(S.outer_tangents(V.vec(0.0, 0.0), F.lit(1.0), V.vec(5.0, 0.0), F.lit(1.0)), (1, -1), strict=True):
        assert list(one(spark, *a, *b)) == pytest.approx([0, side, 5, side])


def test_stats(spark):
    v = spark.createDataFrame([(float(k),) for k in (1, 2, 3, 4)], "v double")
    row = v.agg(*stats.mean_var_std_median(F.col("v")).values()).first()
    assert list(row) == pytest.approx([2.5, 1.25, 1.118033988749895, 2.5])
    assert v.filter("v > 9").agg(*stats.mean_var_std_median(F.col("v")).values()).first()[0] is None
    d = spark.createDataFrame([(x,) for x in (0.5, 1.5, 1.0, 2.0, -0.5, 10.0)], "d double").agg(*stats.deviation_set(F.col("d")).values()).first()
    assert list(d) == [10.0, -0.5, 20.0]
    x = np.linspace(0.5, 3.0, 200)  # not symmetrical about 0
    rows = [("a", float(t), float(5 - 2 * t + t**2 + 4 * t**3 - 3 * t**4)) for t in x]
    fit = stats.polynomial_fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", 4).first()["coefficients"]
    assert list(fit) == pytest.approx([5, -2, 1, 4, -3], abs=1e-6)
    t = np.linspace(0, 2, 40)
    c = stats.circle_fit(spark.createDataFrame([("a", 3 + 2 * float(np.cos(u)), -1 + 2 * float(np.sin(u))) for u in t], "k string, x double, y double"), ["k"], "x", "y").first()
    assert (c["cx"], c["cy"], c["radius"]) == pytest.approx((3, -1, 2))
    noisy = [(3 + 2 * float(np.cos(u)), -1 + 2 * float(np.sin(u))) for u in t] + [(float(k), 7.0) for k in range(10)]
    best = stats.circle_ransac(spark.createDataFrame(noisy, "x double, y double"), "x", "y", 1e-6)
    assert best == (pytest.approx(3), pytest.approx(-1), pytest.approx(2), 40)
    rng = np.random.default_rng(4)
    p = rng.normal(size=(300, 3)) @ np.diag([5, 2, 0.5]) + [10, -4, 3]
    pca = stats.principal_axes(spark.createDataFrame([("a", *map(float, q)) for q in p], "k string, x double, y double, z double"), ["k"], ["x", "y", "z"]).first()["pca"]
    values = np.linalg.eigvalsh(np.cov(p.T, bias=True))[::-1]
    assert list(pca["variances"]) == pytest.approx(list(values)) and pca["rank"] == 3
    assert np.linalg.det(np.array(pca["basis"])) == pytest.approx(1)


@pytest.fixture(scope="module")
def s012(spark):
    return spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("a", 2.0, 2.0)], "k string, x double, y double")


def test_series_resample(spark, s012):
    for args in ({"n": 5}, {"spacing": 0.5}):
        rows = series.resample(s012, ["k"], **args).orderBy("x").collect()
        assert [(r["x"], r["y"]) for r in rows] == [(t, t) for t in (0, 0.5, 1, 1.5, 2)]
    outside = series.interpolate(spark.createDataFrame([("a", -1.0), ("a", 3.0), ("a", 1.25)], "k string, x double"), s012, ["k"]).orderBy("x").collect()
    assert [r["y"] for r in outside] == [None, 1.25, None]
    low, high = series.split_at(s012, ["k"], 0.5)
    assert [r["x"] for r in low.orderBy("x").collect()] == [0, 0.5] and [r["x"] for r in high.orderBy("x").collect()] == [0.5, 1, 2]


def test_asof(spark):
    right = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 2)], "x double, i int")
    left = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5)], "x double")
    assert [r["i"] for r in series.asof(left, right, [], "x", ["i"]).orderBy("x").collect()] == [None, 0, 0, 1, 1, 2, 2]
    zones = spark.createDataFrame([(1.0, -1.0, 1.0), (2.0, -2.0, 2.0), (3.0, -3.0, 3.0)], "x0 double, lower double, upper double")
    found = {r["x"]: r["upper"] - r["lower"] for r in series.tolerance_asof(left, zones).collect()}
    assert found[2.5] == 4.0 and found[0.5] == 6.0  # before all: the last zone


def test_series_windows(spark):
    dom = spark.range(101).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 1.0).alias("y"))
    n = {r["x"]: r["n"] for r in dom.select("x", series.window_count(["k"], "x", 6.5).alias("n")).collect()}
    assert n[0.0] == 4 and n[50.0] == 7 and n[100.0] == 4
    flat = spark.createDataFrame([("a", float(x), float(y)) for x, y in enumerate((1, 0, 0, -1, 1))], "k string, x double, y double")
    assert [r["x"] for r in series.crossings(flat, ["k"], 0.0).orderBy("x").collect()] == [1.0, 2.0, 3.5]
    assert series.area_under(flat, ["k"]).first()["area"] == pytest.approx(0.5 + 0 - 0.5 + 0)
    with pytest.raises(Exception, match="ascending"):
        series.checked_domain(spark.createDataFrame([(0, 2.0), (1, 1.0)], "i int, x double"), [], "i").collect()
    with pytest.raises(ValueError):
        series.concat(flat, flat, ["k"])


@pytest.fixture(scope="module")
def square(spark):
    return spark.createDataFrame([("q", k, float(x), float(y)) for k, (x, y) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))], "c string, seq int, x double, y double")


def test_curves(spark, square):
    closed = curves.closing(square, ["c"])
    places = spark.createDataFrame([("q", t) for t in (0.5, 0.0, 2.0, 2.25, 5.0)], "c string, length double")
    got = {r["length"]: (r["x"], r["y"]) for r in curves.at_lengths(closed, places, ["c"]).collect()}
    assert got == {0.5: (0.5, 0), 0.0: (0, 0), 2.0: (1, 1), 2.25: (0.75, 1), 5.0: (None, None)}
    part = curves.between_lengths(closed, ["c"], 0.1, 2.2).orderBy("length").collect()
    assert [(r["x"], r["y"]) for r in part] == [(0.1, 0), (1, 0), (1, 1), (pytest.approx(0.8), 1)]
    wrapped = curves.between_lengths(closed, ["c"], 3.7, 0.2).orderBy("length").collect()
    assert [(round(r["x"], 9), round(r["y"], 9)) for r in wrapped] == [(0, 0.3), (0, 0), (0.2, 0)]
    line = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 2.0, 0.0)], "c string, seq int, x double, y double")
    assert [(r["x"], r["y"]) for r in curves.fill_gaps(line, ["c"], 1.5).orderBy("seq", "k").collect()] == [(0, 0), (1, 0), (2, 0)]
    assert curves.is_counter_clockwise(square, ["c"]).first()["area"] == 1.0
    assert curves.spanning_rays(closed, ["c"], (0.5, -1.0), (0.0, 1.0)).first()["t1"] == 2.0
    for how in ({"n": 5}, {"spacing": 1.0}, {"max_spacing": 1.0}):
        assert len(curves.resample(closed, ["c"], **how).collect()) == 5
    moved = {r["seq"]: (r["x"], r["y"]) for r in curves.offset_segments(closed, ["c"], 0.1).collect()}
    assert moved[1] == (pytest.approx(1.1), pytest.approx(-0.1)) and moved[2] == (pytest.approx(1.1), pytest.approx(1.1))


def test_simplify():
    p = np.array([(0, 0), (1, 0.01), (2, -0.01), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)], float)
    assert curves.simplify_array(p, 1.0).tolist() == [0, 2, 3, 6, 9]


def test_joins_against_brute_force(spark):
    rng = np.random.default_rng(7)
    p, q = rng.uniform(0, 10, (150, 3)), rng.uniform(0, 10, (120, 3))
    a = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(q)], "id long, x double, y double, z double")
    d = np.linalg.norm(p[:, None] - q[None], axis=2)
    got = {(r["id"], r["id_2"]) for r in joins.radius_join(a, b, "id", "id", ("x", "y", "z"), 1.7).collect()}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= 1.7)), strict=True))
    near = {(r["id"], r["rank"]): r["id_2"] for r in joins.knn_join(a, b, "id", "id", ("x", "y", "z"), 4, 0.3).collect()}
    assert near == {(i, k + 1): int(j) for i in range(150) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    back = np.linalg.norm(p[d.T.argmin(axis=1)][d.argmin(axis=1)] - p, axis=1) < 1.0
    assert sorted(r["id"] for r in joins.overlap_by_reciprocity(a, b, "id", ("x", "y", "z"), 1.0, 0.5).collect()) == np.flatnonzero(back).tolist()
    bad = spark.createDataFrame([(1, float("nan"), 0.0, 0.0), (2, None, 0.0, 0.0)], a.schema)
    assert joins.radius_join(bad, b, "id", "id", ("x", "y", "z"), 1.0).count() == 0


def test_clusters(spark):
    pts = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(((0, 0), (1, 0), (2, 0), (0, 5), (1, 5), (0, 20)))], "idx long, x double, y double")
    groups = lambda tol: sorted(sorted(r["m"]) for r in graph.cluster_points(pts, "idx", ("x", "y"), tol).groupBy("cluster").agg(F.collect_list("idx").alias("m")).collect())
    assert groups(5.1) == [[0, 1, 2, 3, 4], [5]] and groups(1.1) == [[0, 1, 2], [3, 4], [5]]
    assert sorted((r["x"], r["y"]) for r in graph.merge_points(pts, "idx", ("x", "y"), 1.1).collect()) == [(0, 20), (0.5, 5), (1, 0)]


def test_chain(spark):
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5), (5, 6), (7, 8), (20, 21), (21, 22), (22, 20)], "a long, b long")
    rows = graph.chain(pairs).groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("m")).collect()
    assert sorted([x["node"] for x in r["m"]] for r in rows) == [[0, 1, 2, 3], [4, 5, 6], [7, 8], [20, 21, 22]]


def test_masks(spark):
    rng = np.random.default_rng(42)
    a, b = rng.random(200) < 0.4, rng.random(200) < 0.4
    df = lambda m: spark.createDataFrame([(int(i),) for i in np.flatnonzero(m)], "idx long")
    get = lambda d: sorted(r[0] for r in d.collect())
    assert get(masks.union(df(a), df(b))) == np.flatnonzero(a | b).tolist()
    assert get(masks.intersection(df(a), df(b))) == np.flatnonzero(a & b).tolist()
    assert get(masks.difference(df(a), df(b))) == np.flatnonzero(a & ~b).tolist()
    assert get(masks.complement(df(a), spark, 200)) == np.flatnonzero(~a).tolist()
    assert get(masks.flip(df(a), df(b))) == np.flatnonzero(a ^ b).tolist()
    with pytest.raises(Exception, match="out of range"):
        masks.checked(df(a), 100).collect()


def test_sampling(spark):
    grid = spark.range(10_000).select(F.col("id").alias("idx"), ((F.col("id") % 100) * 0.01 + 0.005).alias("x"), (F.floor(F.col("id") / 100) * 0.01 + 0.005).alias("y"))
    assert sampling.voxel_downsample(grid, "idx", ["x", "y"], 0.1).count() == 100
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 10, (600, 2))
    pts = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "idx long, x double, y double")
    kept = sorted(r["idx"] for r in sampling.poisson_disk(pts, "idx", ("x", "y"), 0.6).collect())
    assert kept == sampling.greedy_poisson(p, 0.6).tolist()
    d = np.linalg.norm(p[kept][:, None] - p[kept][None], axis=2)
    assert (d + np.eye(len(kept)) * 9).min() > 0.6
    hull = sampling.convex_hulls(pts.withColumn("g", F.lit(1)), ["g"])
    far = sampling.farthest_pair(hull, ["g"]).first()["d"]
    assert far == pytest.approx(np.linalg.norm(p[:, None] - p[None], axis=2).max())
    assert set(sampling.hull_2d(p)) <= set(sampling.ball_pivot(p, 50.0))


def test_connected_components_of_all_links(spark, tmp_path):
    """The unfiltered query against union-find; the links are none that the filtered one takes."""
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(1, 120, (90, 2))]
    rows = [(a, b, 1.0, 0.0, 0.0) for a, b in links]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b + 1000000)
        up[max(a, b)] = min(a, b)
    from plumbline.plans.queries import QUERIES

    got = {r["node"]: r["root"] for r in QUERIES["connected_components_all"](spark, str(tmp_path)).collect()}
    assert got == {x: root(x) for x in up}


def test_interpolated_totals_to_the_end(spark, tmp_path):
    """A series of 2,000,000 s with y = x / 5000 has 401 steps; a single event has one."""
    from plumbline.plans.more_queries import interpolated_totals_whole

    at = [(1, 0, 0.0), (1, 1_200_000, 240.0), (1, 2_000_000, 400.0), (2, 50, 7.0)]
    rows = spark.createDataFrame(at, "user_id long, s long, value double").selectExpr("user_id", "timestamp_seconds(1704067200 + s) as ts", "value", "s as event_id")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["id"]: (r["n"], r["total"]) for r in interpolated_totals_whole(spark, str(tmp_path)).collect()}
    assert got == {1: (401, 401 * 200.0), 2: (1, 7.0)}
