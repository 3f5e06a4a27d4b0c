"""Ingest, stations, lifts, selections, regions, matched indexes, hulls, ball paths, edges and images, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import lift
from plumbline.functions import vectors as V
from plumbline.operators import airfoil, align, curves, ingest, joins, mesh, raster, sampling, stations, stats
from plumbline.operators.masks import SelectOp
from plumbline.sources import formats


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_ingest(spark):
    a = np.arange(12.0).reshape(4, 3)
    assert rows(ingest.points_from_array(spark, a)) == [(k, *map(float, a[k])) for k in range(4)]
    with pytest.raises(ValueError, match="3 columns"):
        ingest.points_from_array(spark, a[:, :2])
    with pytest.raises(ValueError, match="corner"):
        ingest.faces_from_array(spark, [[0, 1, 9]], 4)
    assert ingest.mesh_from_arrays(spark, a, [[0, 1, 2]]).faces.count() == 1
    flat = spark.createDataFrame([("p", [1.0, 2.0, 3.0, 4.0]), ("q", []), ("r", None)], "k string, v array<double>")
    assert rows(ingest.unflattened(flat, "v", 2)) == [("p", 0, 1.0, 2.0), ("p", 1, 3.0, 4.0)]
    back = ingest.flattened(ingest.unflattened(flat, "v", 2), ["k"])
    assert rows(back) == [("p", [1.0, 2.0, 3.0, 4.0])]
    with pytest.raises(Exception, match="dimension 3 has 4 values"):
        ingest.unflattened(flat, "v", 3).collect()
    points = ingest.points_from_array(spark, a)
    normals = ingest.points_from_array(spark, a + 1)
    got = {r["idx"]: r for r in ingest.surface_points(points, normals).collect()}
    assert got[1]["nx"] == pytest.approx(4 / np.sqrt(77)) and len(got) == 4
    for wrong in (normals.limit(3), points):
        with pytest.raises(Exception, match="normal"):
            ingest.surface_points(points, wrong.withColumn("x", F.when(F.col("idx") > 0, F.col("x")).otherwise(0.0)).withColumn("y", F.when(F.col("idx") > 0, F.col("y")).otherwise(0.0)).withColumn("z", F.when(F.col("idx") > 0, F.col("z")).otherwise(0.0))).collect()
    one = spark.range(1).select(ingest.evenly_spaced(V.vec(0.0, 0.0), V.vec(4.0, 8.0), 3).alias("p"), ingest.evenly_spaced(V.vec(0.0, 0.0), V.vec(4.0, 8.0), 3, ends=False).alias("q")).first()
    assert one["p"] == [[0, 0], [2, 4], [4, 8]] and one["q"] == [[1, 2], [2, 4], [3, 6]]
    assert [r["x"] for r in ingest.indexed(points.drop("idx"), ["x"]).orderBy("idx").collect()] == [0, 3, 6, 9]


def test_lift(spark):
    flat = lift.normal_to_2d(V.vec(0.0, 0.0, 1.0))
    r = spark.range(1).select(flat[0].alias("none"), lift.to_3d(V.vec(1.0, 2.0))[2].alias("z"), lift.distance_value(V.vec(0.0, 0.0), V.vec(3.0, 4.0), V.vec(0.6, 0.8)).alias("d")).first()
    assert r["none"] is None and r["z"] == 0 and r["d"] == pytest.approx(5)


def test_stations(spark):
    square = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "c long, seq long, x double, y double")
    open_ = {r["seq"]: r for r in stations.at_vertices(square, ["c"]).collect()}
    assert open_[0]["previous"] is None and open_[3]["next"] is None and open_[1]["dx"] == pytest.approx(0.5**0.5)
    closed = {r["seq"]: r for r in stations.at_vertices(square, ["c"], closed=True).collect()}
    assert closed[0]["previous"] == 3 and closed[3]["next"] == 0 and (closed[0]["dx"], closed[0]["dy"]) == (pytest.approx(0.5**0.5), pytest.approx(-(0.5**0.5)))
    at = spark.createDataFrame([(1, -2.0), (1, 5.0), (1, 18.0)], "c long, length double")
    got = {round(r["length"], 6): r for r in stations.at(square, at, ["c"], closed=True).collect()}
    assert (got[14.0]["x"], got[14.0]["y"], got[14.0]["seq"], got[14.0]["fraction"]) == (0.0, 2.0, 3, 0.5)
    assert (got[5.0]["x"], got[5.0]["y"], got[5.0]["nx"], got[5.0]["ny"]) == (4.0, 1.0, 1.0, 0.0) and (got[2.0]["x"], got[2.0]["y"]) == (2.0, 0.0)
    on = stations.travelled(square, stations.at(square, at.filter("length = 5"), ["c"]), ["c"], 3.0).first()
    assert (on["x"], on["y"], on["length"]) == (4.0, 4.0, 8.0)
    assert {r["seq"]: r["is_front"] for r in stations.ends(square, ["c"]).collect()} == {0: True, 3: False}


def test_selection_and_places(spark):
    box = mesh.box(spark, 2.0, 2.0, 2.0)
    up = mesh.Selection.nothing(box).facing((0, 0, 1), 0.1, SelectOp.ADD)
    assert up.collect().count() == 2 and up.inverted().collect().count() == 10 and up.expanded().collect().count() == 12 - 2
    assert mesh.Selection.everything(box).facing((0, 0, 1), 0.1, SelectOp.REMOVE).near_point((0, 0, -1), 1.5, SelectOp.KEEP).create_mesh().faces.count() == 2
    corners = {r["fid"]: r for r in box.corners().collect()}
    q = spark.createDataFrame([(2, 1.0, 0.0, 0.0)], "fid long, u double, v double, w double")
    r = mesh.at_barycentric(box, q).first()
    assert (r["x"], r["y"], r["z"]) == (corners[2]["x0"], corners[2]["y0"], corners[2]["z0"]) and abs(r["nz"]) == 1
    with pytest.raises(Exception, match="no such face"):
        mesh.at_barycentric(box, q.withColumn("fid", F.lit(99).cast("long"))).collect()


def test_regions(spark):
    mask = spark.createDataFrame([(r, c) for r in range(5) for c in range(5) if (r + c) % 2], "row long, col long")
    roi = raster.RoiMask.of(mask, 1, 1, 3, 3)
    assert sorted(rows(roi.pixels())) == [(r, c, r - 1, c - 1) for r in range(1, 4) for c in range(1, 4) if (r + c) % 2]
    assert sorted(rows(roi.resized(2, 2, 3, 3).pixels()))[0] == (2, 3, 0, 1)
    assert roi.shared(raster.RoiMask.of(mask, 3, 0, 2, 3)).count() == 2 and roi.shared(raster.RoiMask.of(mask, 9, 9, 1, 1)).count() == 0


def test_matched_index(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(rng.random((50, 2)))], "id long, x double, y double")
    index = joins.MatchedIndex.of(p, "id", ("x", "y"), 0.2)
    assert index.checked(p.repartition(3), "id") is index
    with pytest.raises(ValueError, match="another cloud"):
        index.checked(p.filter("id > 0"), "id")
    with pytest.raises(ValueError, match="without points"):
        joins.MatchedIndex.of(p.limit(0), "id", ("x", "y"), 0.2)
    want = joins.radius_join(p, p, "id", "id", ("x", "y"), 0.2)
    assert sorted(rows(index.within(p, "id"))) == sorted(rows(want))


def test_radius_join_from_either_side(spark):
    rng = np.random.default_rng(2)
    few = [(k, *map(float, v)) for k, v in enumerate(rng.random((7, 2)))]
    many = [(k, *map(float, v)) for k, v in enumerate(rng.random((300, 2)))]
    a, b = (spark.createDataFrame(x, "id long, x double, y double") for x in (few, many))
    near = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 0.04
    want = sorted((p[0], q[0]) for p in few for q in many if near(p, q))
    assert sorted(r[:2] for r in rows(joins.radius_join(a, b, "id", "id", ("x", "y"), 0.2))) == want
    assert sorted(r[1::-1] for r in rows(joins.radius_join(b, a, "id", "id", ("x", "y"), 0.2))) == want
    same = spark.createDataFrame([*many, *((k + 1000, *x[1:]) for k, x in enumerate(many)), (5000, float("nan"), 0.0), (5001, None, 0.0)], "id long, x double, y double")
    counts = dict(rows(joins.radius_counts(same, same, "id", ("x", "y"), 0.2)))
    assert counts == {p[0] + add: 2 * sum(near(p, q) for q in many) for p in many for add in (0, 1000)} | {5000: 0, 5001: 0}


def test_vectors_nearest(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(300, 16)), np.zeros((4, 16)), np.ones((3, 16)) * 1e4])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(999, None)], "id long, e array<double>")
    got = {}
    for r in joins.high_dimensional_knn(df.filter("id % 20 = 0"), df, "id", "id", "e", 4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["id_2"], r["d"]))
    for k in range(0, len(v), 20):
        d = np.sqrt(((v - v[k]) ** 2).sum(axis=1))
        order = np.lexsort((np.arange(len(v)), d))[:4]
        assert [x[1] for x in sorted(got[k])] == order.tolist() and np.allclose([x[2] for x in sorted(got[k])], d[order])


def test_curve_parts(spark):
    """A curve in one part and in many gives the same, and brute force agrees."""
    t = np.linspace(0, 6, 90)
    line = np.column_stack([t * 3, np.sin(t) * 2])
    c = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(line)], "c long, seq long, x double, y double")
    s = curves.segments(c, ["c"]).select("x0", "y0", "x1", "y1", "l0", F.col("seq").alias("seg"))
    p = np.random.default_rng(4).uniform(-1, 18, (80, 2))
    points = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double")
    whole, parts = (dict((r["id"], r) for r in joins.closest_on_curve(points, "id", s, part_edges=n).collect()) for n in (10**6, 9))
    for k, v in enumerate(p):
        a, d = line[:-1], np.diff(line, axis=0)
        u = np.clip(((v - a) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
        least = np.linalg.norm(v - a - u[:, None] * d, axis=1).min()
        assert whole[k]["d"] == pytest.approx(least) == parts[k]["d"] and whole[k]["length"] == pytest.approx(parts[k]["length"])
    off = np.random.default_rng(5).choice(len(line) - 1, 40)
    q = (line[off] + line[off + 1]) / 2
    moved = (align.iso2(0.1, -0.05, 0.02) @ np.column_stack([q, np.ones(len(q))]).T).T
    found = align.points_to_curve(spark.createDataFrame([tuple(map(float, m[:2])) for m in moved], "x double, y double"), s, rounds=12)
    assert found.residual < 1e-8


def test_hulls_in_space(spark):
    p = np.random.default_rng(6).normal(size=(400, 3))
    f = sampling.hull_3d(p)
    n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    assert (np.einsum("fc,pfc->pf", n, p[:, None] - p[f[:, 0]][None]) <= 1e-9).all()
    assert len(np.unique(f)) - len(f) * 3 // 2 + len(f) == 2
    df = spark.createDataFrame([("a", *map(float, x)) for x in p] + [("flat", float(k), float(k % 3), 0.0) for k in range(9)], "g string, x double, y double, z double")
    hulls = [r for r in sampling.convex_hulls_3d(df, ["g"]).collect()]
    assert {r["g"] for r in hulls} == {"a"} and len(hulls) == len(f)
    assert {tuple(round(r[f"{c}{k}"], 9) for c in "xyz") for r in hulls for k in range(3)} == {tuple(np.round(x, 9)) for x in p[np.unique(f)]}
    cube = np.array([(i, j, k) for i in range(3) for j in range(3) for k in range(3)], float)
    t = cube[sampling.hull_3d(cube)]
    assert abs(np.einsum("fc,fc->f", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6) == pytest.approx(8)


def test_ball_paths():
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    ring = np.column_stack([10 * np.cos(t), 6 * np.sin(t)])
    inner = ring * 0.5
    p = np.concatenate([ring, inner])
    assert sorted(sampling.ball_pivot(p, 1.2)) == list(range(60))
    at, centres = sampling.ball_path(p, 1.2, start=5, end=20)
    assert at == list(range(5, 21)) and len(centres) == 15
    assert np.allclose(np.linalg.norm(centres - p[at[:-1]], axis=1), 1.2) and np.allclose(np.linalg.norm(centres - p[at[1:]], axis=1), 1.2)
    assert sampling.ball_path(p, 1.2, start=5, end=50, clockwise=True)[0][:3] == [5, 4, 3]
    filled = sampling.ball_boundary(p, 1.2, 0.2)
    assert np.linalg.norm(np.diff(filled, axis=0), axis=1).max() <= 0.2 + 1e-9 and len(filled) > 120
    with pytest.raises(ValueError, match="never comes"):
        sampling.ball_path(p, 1.2, start=5, end=80)


def test_circles_between_bounds(spark):
    t = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    p = [(float(np.cos(a)), float(np.sin(a))) for a in t] + [(float(20 + 8 * np.cos(a)), float(8 * np.sin(a))) for a in t[::2]]
    df = spark.createDataFrame(p, "x double, y double")
    assert stats.circle_ransac(df, "x", "y", 1e-6)[2] == pytest.approx(1)
    assert stats.circle_ransac(df, "x", "y", 1e-6, min_radius=5, max_radius=10)[:3] == pytest.approx((20, 0, 8))
    with pytest.raises(ValueError, match="between the bounds"):
        stats.circle_ransac(df, "x", "y", 1e-6, min_radius=1e9)


def test_airfoil_orientation_and_rounded_square():
    c = [airfoil.Station(np.array([float(k), 0.0]), r, np.array([k, r]), np.array([k, -r])) for k, r in enumerate((0.1, 0.2, 0.3, 0.5, 0.2))]
    front = airfoil.oriented(c)
    assert front[0].centre[0] == 4 and (front[0].upper[1], front[0].lower[1]) == (-0.2, 0.2)
    assert airfoil.oriented(c, "direction", (-1, 0))[0].centre[0] == 0 and airfoil.oriented(c, "direction", (1, 0))[0].centre[0] == 4
    for wrong in (("direction", None), ("other", None)):
        with pytest.raises(ValueError):
            airfoil.oriented(c, *wrong)
    # a contour of two legs, two rounded corners and the end between them
    arc = lambda cx, cy, r, a, b: [(cx + r * np.cos(t), cy + r * np.sin(t)) for t in np.linspace(a, b, 25)]
    line = lambda a, b: [tuple(np.array(a) + (np.array(b) - a) * t) for t in np.linspace(0, 1, 40)]
    p = np.array(line((0, 3), (3.5, 3)) + arc(3.5, 2.5, 0.5, np.pi / 2, 0) + line((4, 2.5), (4, 0.8)) + arc(3.2, 0.8, 0.8, 0, -np.pi / 2) + line((3.2, 0), (0, 0)))
    fit = airfoil.fit_rounded_square(p, np.array([4.1, 1.4]))
    assert fit["residual"] < 1e-6 and np.allclose(fit["corners"], [(4, 3), (4, 0)], atol=1e-5) and np.allclose(fit["radii"], (0.5, 0.8), atol=1e-5)


def test_grey_images():
    image = (np.random.default_rng(7).random((5, 7)) > 0.5).astype(np.uint8) * 255
    for write in formats.GREY_WRITERS.values():
        assert (formats.read_grey(write(image)) == image).all()
    wide = np.arange(12, dtype=np.uint16).reshape(3, 4) * 5000
    assert (formats.read_grey(formats.write_pgm(wide)) == wide).all()
    assert (formats.read_grey(b"P1\n# a comment\n3 2\n1 0 1\n0 1 0\n") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (formats.read_grey(b"P3 2 1 255 3 6 9 30 60 90 ") == [[6, 60]]).all()
    with pytest.raises(ValueError):
        formats.read_grey(b"GIF89a")
