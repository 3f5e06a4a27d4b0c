"""Meshes, rasters, alignment, flattening, airfoils, files and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import airfoil, align, flatten, graph, mesh, normals, raster, sampling
from plumbline.sources import files
from plumbline.sources import formats as fm
from plumbline.streaming import incremental


@pytest.fixture(scope="module")
def box(spark):
    return mesh.box(spark, 1.0, 1.0, 1.0)


def points(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id long, x double, y double, z double")


def test_closest(spark, box):
    got = {r["id"]: r["d"] for r in mesh.closest(points(spark, [(1.5, 0, 0), (1.5, 1.5, 0), (1.5, 1.5, 1.5)]), box, "id").collect()}
    assert got == {0: pytest.approx(1), 1: pytest.approx(math.sqrt(2)), 2: pytest.approx(math.sqrt(3))}
    parts = {r["id"]: r["d"] for r in mesh.closest(points(spark, [(1.5, 0, 0), (1.5, 1.5, 0)]), box, "id", part_faces=3).collect()}
    assert parts == {0: pytest.approx(1), 1: pytest.approx(math.sqrt(2))}
    dev = {r["id"]: r["deviation"] for r in mesh.deviations(points(spark, [(0, 0, 0.4), (0, 0, 0.7)]), box, "id").collect()}
    assert dev == {0: pytest.approx(-0.1), 1: pytest.approx(0.2)}


def test_closest_against_brute_force():
    rng = np.random.default_rng(3)
    tri, p = rng.normal(size=(300, 3, 3)), rng.normal(size=(200, 3)) * 2
    face, w, d2 = mesh.MeshIndex(np.arange(300), tri).closest(p)
    all_w = mesh.closest_on_triangles(p[:, None], tri[None, :, 0], tri[None, :, 1], tri[None, :, 2])
    all_d = (((all_w[..., None] * tri[None]).sum(2) - p[:, None]) ** 2).sum(-1)
    assert np.allclose(d2, all_d.min(axis=1))
    # the places themselves, against a fine sampling of the triangles
    u, v = (g.ravel() for g in np.meshgrid(np.linspace(0, 1, 41), np.linspace(0, 1, 41)))
    keep = u + v <= 1 + 1e-9
    s = np.stack([1 - u - v, u, v], 1)[keep]
    sampled = (((s @ tri[7]) [None] - p[:, None]) ** 2).sum(-1).min(axis=1)
    assert (all_d[:, 7] <= sampled + 1e-12).all() and (np.sqrt(sampled) - np.sqrt(all_d[:, 7])).max() < 0.15
    t, f = mesh.MeshIndex(np.arange(300), tri).first_hits(np.zeros((50, 3)), rng.normal(size=(50, 3)))
    assert np.isfinite(t).any()


def test_mesh_geometry(spark, box):
    assert box.facing((0, 0, 1), math.pi / 2).count() == 2
    assert box.face_geometry().agg(F.sum("area")).first()[0] == pytest.approx(6)
    up, down = box.split((1.0, 0.0, 0.0), 0.0)
    assert up.face_geometry().agg(F.sum("area")).first()[0] == pytest.approx(3)
    assert down.aabb().first()["x_max"] == pytest.approx(0)
    assert box.split((1.0, 0.0, 0.0), -2.0)[1] is None and box.split((1.0, 0.0, 0.0), 2.0)[0] is None
    n = box.vertex_normals().collect()
    assert all(abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-9 for r in n)
    assert box.append(box).faces.count() == 24 and box.append(box).merged_duplicates().vertices.count() == 8
    part = box.submesh(box.facing((0, 0, 1), 0.1))
    assert (part.vertices.count(), part.faces.count()) == (4, 2)
    assert graph.boundary_edges(box.faces).count() == 0 and graph.boundary_loops(part.faces).count() == 4
    moved = box.offset(0.1).aabb().first()
    assert moved["x_max"] == pytest.approx(0.5 + 0.1 / math.sqrt(3), abs=0.03)
    assert box.near_mesh(box.transformed(align.iso3(0, 0, 0.05)), 0.06).count() == 12


def test_section(spark):
    tube = mesh.cylinder(spark, 1.0, 2.0, 64)
    curve = tube.section((0.0, 0.0, 1.0), 0.1).orderBy("position").collect()
    p = np.array([(r["x"], r["y"], r["z"]) for r in curve])
    assert curve[0]["loop"] and len({r["chain"] for r in curve}) == 1
    assert np.linalg.norm(p - np.roll(p, 1, axis=0), axis=1).sum() == pytest.approx(2 * math.pi, abs=1e-2)


def test_rays_and_collisions(spark, box):
    rays = spark.createDataFrame([(0, 0.1, 0.2, 5.0, 0.0, 0.0, -1.0), (1, 3.0, 0.0, 5.0, 0.0, 0.0, -1.0)], "id long, ox double, oy double, oz double, dx double, dy double, dz double")
    hit = mesh.ray_hits(rays, box, "id").collect()
    assert [(r["id"], r["t"], r["z"]) for r in hit] == [(0, 4.5, 0.5)]
    as_rows = lambda m, k: m.corners().drop("fid", "a", "b", "c").withColumn("mesh_id", F.lit(k))
    scene = as_rows(box, 0).unionByName(as_rows(box.transformed(align.iso3(0.5, 0.5, 0.5)), 1)).unionByName(as_rows(box.transformed(align.iso3(2.5, 0.5, 0.5)), 2))
    roles = spark.createDataFrame([(0, False), (1, True), (2, True)], "mesh_id int, moving boolean")
    assert [tuple(r) for r in mesh.collisions(scene, roles).collect()] == [(1, 0)]
    assert mesh.collisions(scene, roles, spark.createDataFrame([(0, 1)], "id1 int, id2 int")).count() == 0
    seen = mesh.scan(box, 10.0, 5.0, 10.0, 0.8, -1.0, 1.0, 5, [0.0, 0.2])
    assert seen.count() == 10 and {round(r["z"], 6) for r in seen.collect()} == {0.5}


def test_patches(spark):
    g = mesh.grid(spark, 12, 12)
    cells = g.faces.withColumn("cell", F.floor(F.col("fid") / 2))
    row, col = F.floor(F.col("cell") / 11), F.col("cell") % 11
    mask = cells.filter((row.between(1, 3) & col.between(1, 4)) | (row.between(6, 9) & col.between(5, 9))).select("fid")
    sizes = sorted(r["n"] for r in graph.patches(g.faces, mask).groupBy("patch").agg(F.count("*").alias("n")).collect())
    assert sizes == [24, 40]
    loops = graph.boundary_loops(g.faces, mask)
    assert sorted(r["n"] for r in loops.groupBy("chain").agg(F.count("*").alias("n")).collect()) == [14, 18]
    rim = loops.join(loops.groupBy("chain").agg(F.count("*").alias("n")).filter("n = 14").select("chain"), "chain", "left_semi")
    outside = graph.patch_inside_loop(g.faces, rim).count()
    assert outside in (24, 242 - 24)


def test_alignment(spark):
    shape = mesh.box(spark, 20.0, 12.0, 6.0)
    true = align.rotation_about((1, 1, 1), 0.1, (2, 1, 0)) @ align.iso3(0.5, -0.4, 0.3)
    p = np.array([tuple(r)[-3:] for r in sampling.dense_samples(shape.corners(), 2.5).collect()])
    inverse = np.linalg.inv(true)
    start = points(spark, p @ inverse[:3, :3].T + inverse[:3, 3])
    found = align.points_to_mesh(start.drop("id"), shape)
    assert np.abs(found.transform - true).max() < 1e-6 and found.mean_residual < 1e-6
    cloud = points(spark, p)
    near = align.iso3(0.02, -0.01, 0.03, 0.002, 0.001, -0.001)
    back = np.linalg.inv(near)
    fit = align.points_to_cloud(points(spark, p @ back[:3, :3].T + back[:3, 3]).drop("id"), cloud.drop("id"), 1.0, rounds=8)
    assert np.abs(fit.transform - near).max() < 1e-6
    seg = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 10.0, 5.0), (2, 10.0, 5.0, 0.0, 5.0), (3, 0.0, 5.0, 0.0, 0.0)], "seg int, x0 double, y0 double, x1 double, y1 double")
    ring = np.concatenate([np.stack([np.linspace(0, 10, 21), np.zeros(21)], 1), np.stack([np.full(11, 10), np.linspace(0, 5, 11)], 1), np.stack([np.linspace(0, 10, 21), np.full(21, 5)], 1), np.stack([np.zeros(11), np.linspace(0, 5, 11)], 1)])
    pose = align.iso2(0.3, -0.2, 0.04)
    back2 = np.linalg.inv(pose)
    q = ring @ back2[:2, :2].T + back2[:2, 2]
    got = align.points_to_curve(spark.createDataFrame([tuple(map(float, r)) for r in q], "x double, y double"), seg)
    assert np.abs(got.transform - pose).max() < 1e-6


def test_isometries():
    m = align.iso3_from_xyzwpr(1, 2, 3, 10, 20, 30)
    assert align.xyzwpr_of(m) == pytest.approx([1, 2, 3, 10, 20, 30])
    with pytest.raises(ValueError):
        align.iso3_from_array(np.ones(16))
    with pytest.raises(ValueError):
        align.iso3_from_basis("x", (1, 0, 0), "y", (2, 0, 0))
    assert np.linalg.det(align.iso3_from_basis("z", (0, 1, 1), "y", (0, 1, 0))[:3, :3]) == pytest.approx(1)


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["v"]
    return out


def test_convolution(spark):
    i, j = np.mgrid[:40, :60]
    v = np.where((i + j) % 10 == 0, np.nan, ((i + j) % 50) / 100)
    df = spark.createDataFrame([(int(a), int(b), float(v[a, b])) for a, b in zip(*np.nonzero(~np.isnan(v)), strict=True)], "row int, col int, v double")
    k = raster.gaussian_kernel(1.0)
    got = dense(raster.tiled(df, (), len(k) // 2, lambda d, r, c: d, tile=16), v.shape)
    assert np.array_equal(got, v, equal_nan=True)
    got, h = dense(raster.convolve(df, (), k), v.shape), len(k) // 2
    for a, b in ((0, 1), (5, 7), (39, 58), (20, 33)):
        if np.isnan(v[a, b]):
            continue
        top = low = 0.0
        for da in range(-h, h + 1):
            for db in range(-h, h + 1):
                if 0 <= a + da < 40 and 0 <= b + db < 60 and not np.isnan(v[a + da, b + db]):
                    top, low = top + v[a + da, b + db] * k[da + h, db + h], low + k[da + h, db + h]
        assert got[a, b] == pytest.approx(top / low)


def test_raster_operators(spark):
    flat = spark.createDataFrame([(r, c, 1.0 if (r, c) != (10, 10) else 0.0) for r in range(21) for c in range(21)], "row int, col int, v double")
    rolled = dense(raster.rolling_ball(flat, (), 5.0, 1.0), (21, 21))
    assert rolled.min() == pytest.approx(1 - (5 - math.sqrt(24)))  # the pit is bridged
    holes = spark.createDataFrame([(10, 10)], "row int, col int")
    assert dense(raster.inpaint(flat, holes, (), 3), (21, 21))[10, 10] == pytest.approx(1)
    block = raster.rectangle(spark, 0, 0, 7, 15)
    assert raster.erode(block, ()).count() == 5 * 13 and raster.dilate(block, ()).count() == 7 * 15 + 2 * (7 + 15)
    skeleton = raster.thin(block, ())
    assert 0 < skeleton.count() < 20
    ring = raster.rectangle(spark, 2, 2, 5, 5).join(raster.rectangle(spark, 3, 3, 3, 3), ["row", "col"], "left_anti")
    assert raster.flood_fill(ring, 10, 10).count() == 100 - 25
    assert raster.flood_fill(ring, 10, 10, spark.createDataFrame([(4, 4)], "row long, col long")).count() == 9
    assert raster.polygon(spark, [(0, 0), (0, 10), (10, 10), (10, 0)]).count() == 100
    v, f = raster.depth_mesh(flat, 0.5)
    assert f.count() == 2 * 20 * 20
    assert raster.resized(flat, (), 2.0).count() == 42 * 42 and raster.resized(flat, (), 0.5).count() in (100, 110, 121)


def test_thinning_matches_whole_image(spark):
    rng = np.random.default_rng(5)
    a = rng.random((40, 50)) < 0.7
    df = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(a), strict=True)], "row int, col int")
    b = a.copy()
    while True:
        n = raster._thin_step(raster._thin_step(b, False), True)
        if (n == b).all():
            break
        b = n
    got = np.zeros_like(a)
    for r in raster.thin(df, ()).collect():
        got[r["row"], r["col"]] = True
    assert (got == b).all()


def test_normals(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 5, (200, 2))
    pts = points(spark, [(x, y, 0.5 * x) for x, y in xy])
    n = normals.estimate_normals(pts, "id", 1.0).collect()
    want = np.array([-0.5, 0, 1]) / math.sqrt(1.25)
    assert all(np.abs(np.array([r["nx"], r["ny"], r["nz"]]) - want).max() < 1e-6 for r in n if r["confidence"] > 0)
    smooth = normals.smooth_neighbourhood(mesh.grid(spark, 4, 4))
    assert smooth.vertices.agg(F.max(F.abs("z"))).first()[0] < 1e-9


def test_flatten():
    n = 12
    i, j = np.mgrid[:n, :n]
    flat = np.stack([j.ravel(), i.ravel(), np.zeros(n * n)], 1).astype(float)
    cell = (i[:-1, :-1] * n + j[:-1, :-1]).ravel()
    faces = np.concatenate([np.stack([cell, cell + 1, cell + n + 1], 1), np.stack([cell, cell + n + 1, cell + n], 1)])
    bent = flat.copy()
    bent[:, 0], bent[:, 2] = 8 * np.sin(flat[:, 0] / 8), 8 * np.cos(flat[:, 0] / 8)  # a piece of a cylinder
    for shape in (flat, bent):
        uv = flatten.flatten_array(shape, faces)
        e = faces[:, [0, 1]]
        real, made = np.linalg.norm(shape[e[:, 0]] - shape[e[:, 1]], axis=1), np.linalg.norm(uv[e[:, 0]] - uv[e[:, 1]], axis=1)
        assert np.abs(made / real - 1).max() < 0.02
    with pytest.raises(ValueError):
        flatten.boundary_loop(np.array([[0, 1, 2], [0, 2, 1]]))


def test_airfoil():
    t = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    x = (np.cos(t) + 1) / 2
    half = 5 * 0.12 * (0.2969 * np.sqrt(x) - 0.126 * x - 0.3516 * x**2 + 0.2843 * x**3 - 0.1036 * x**4)
    r = airfoil.analyse(np.stack([x, np.where(np.sin(t) >= 0, half, -half)], 1), 1e-4)
    assert 2 * r["t_max"].radius == pytest.approx(0.12, abs=1e-3)
    assert r["chord"] == pytest.approx(1, abs=5e-3) and r["leading"][0] < 0.01 and r["trailing"][0] > 0.99
    assert max(abs(s.centre[1]) for s in r["stations"]) < 1e-4


def test_formats(spark, tmp_path):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(50, 3)).astype(np.float32)
    data = fm.write_bxyz(p, p / np.linalg.norm(p, axis=1)[:, None], rng.integers(0, 255, (50, 3)), p[:, 0])
    (tmp_path / "a.bxyz").write_bytes(data)
    rows = files.load(spark, "bxyz", f"{tmp_path}/a.bxyz").orderBy("idx").collect()
    assert np.array_equal(np.array([(r["x"], r["y"], r["z"]) for r in rows], np.float32), p)
    files.register(spark)
    assert spark.read.format("bxyz").load(f"{tmp_path}/a.bxyz").count() == 50
    plain = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], "x double, y double, z double")
    plain.coalesce(1).write.format("bxyz").mode("append").save(f"{tmp_path}/out")
    assert files.load(spark, "bxyz", f"{tmp_path}/out").filter("nx is null").count() == 2
    box = mesh.box(spark, 2.0, 1.0, 1.0)
    for kind, compress in (("umesh", True), ("ply", False)):
        content = files.mesh_bytes(box, kind, compress).first()["content"]
        (tmp_path / f"m.{kind}").write_bytes(content)
        again = files.load_mesh(spark, kind, f"{tmp_path}/m.{kind}")
        assert again.face_geometry().agg(F.sum("area")).first()[0] == pytest.approx(10, abs=1e-3)
    corners = box.corners().select(*(f"{c}{k}" for k in range(3) for c in "xyz")).toPandas().to_numpy().reshape(-1, 3, 3)
    (tmp_path / "m.stl").write_bytes(fm.write_stl(corners))
    assert files.load_mesh(spark, "stl", f"{tmp_path}/m.stl").vertices.count() == 8
    image = rng.integers(0, 65535, (7, 9)).astype(np.uint16)
    assert np.array_equal(fm.read_png(fm.write_png(image)), image)
    px, low, high, values, mask = fm.read_raster(fm.write_raster(0.5, -1, 1, image, image > 9000))
    assert (px, low, high) == (0.5, -1, 1) and np.array_equal(values, image) and np.array_equal(mask, image > 9000)
    with pytest.raises(ValueError):
        fm.write_umesh(np.zeros((65536, 3)), np.zeros((1, 3), int))


def test_ply_reference_layouts():
    text = b"ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nproperty float confidence\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0 1\n1 0 0 1\n1 1 0 1\n0 1 0 1\n4 0 1 2 3\n"
    v, f = fm.read_ply(text)
    assert v.shape == (4, 3) and f.tolist() == [[0, 1, 2]]


def test_scan(spark, tmp_path):
    frames = [(k, np.arange(0, 2000, 100)[::-1], np.full(20, 50 + k), None) for k in range(8)]
    (tmp_path / "s.lptf3").write_bytes(fm.write_lptf3(frames, y_step_nm=100_000))
    every = files.load(spark, "lptf3", f"{tmp_path}/s.lptf3")
    assert every.count() == 160 and every.agg(F.max("y")).first()[0] == pytest.approx(0.7)
    taken = files.load(spark, "lptf3", f"{tmp_path}/s.lptf3", take_every=2)
    assert {r["frame"] for r in taken.collect()} == {0, 2, 4, 6} and taken.filter("frame = 0").count() == 10
    whole = files.load_scan_all(spark, f"{tmp_path}/s.lptf3", 2)
    smooth = files.smooth_sample(whole, 2, 0.1)
    assert smooth.count() == 40
    inner = smooth.filter("frame = 4").first()["z"]
    assert inner == pytest.approx(0.054, abs=1e-3)
    surface = files.scan_mesh(every, 0.1)
    assert surface.faces.count() == 7 * 38
    assert sum(r["n"] for r in files.point_distribution(every, 0.3).collect()) == 160


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", float(m)) for m in range(30)]
    spark.createDataFrame(rows, "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(f"{tmp_path}/in")
    out = incremental.windowed_average(stream, "ts", "value", ["k"], "10 minutes")
    q = out.writeStream.outputMode("complete").format("memory").queryName("averages").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["n"], r["mean"]) for r in spark.sql("select * from averages").collect())
    assert got == [(10, 4.5), (10, 14.5), (10, 24.5)]
    flagged = incremental.out_of_tolerance(stream, spark.createDataFrame([("a", 5.0, 25.0)], "k string, lower double, upper double"), ["k"], "value")
    q = flagged.writeStream.foreachBatch(incremental.once_per_batch(f"{tmp_path}/out")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9


def test_clouds(spark):
    from plumbline.operators.clouds import PointCloud

    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2, 5.0, 5.0, 5.0, 1.0, 0.0, 0.0)], "idx long, x double, y double, z double, nx double, ny double, nz double")
    cloud = PointCloud.of(rows)
    assert cloud.merged(cloud).rows.agg(F.max("idx")).first()[0] == 5
    with pytest.raises(ValueError):
        cloud.merged(PointCloud(rows.drop("nx", "ny", "nz")))
    moved = cloud.transformed(align.iso3(1, 2, 3, 0, 0, math.pi / 2)).rows.filter("idx = 2").first()
    assert (moved["x"], moved["y"], moved["z"], moved["ny"]) == pytest.approx((-4, 7, 8, 1))
    picked = cloud.picked(spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "position long, idx long")).rows.orderBy("idx").collect()
    assert [r["x"] for r in picked] == [5, 0, 5]
    with pytest.raises(Exception, match="out of range"):
        cloud.picked(spark.createDataFrame([(0, 9)], "position long, idx long")).rows.collect()
    assert cloud.poisson_sample(1.5).rows.count() == 2 and PointCloud.empty(spark, colors=True).rows.columns[-1] == "b"
    near = PointCloud(spark.createDataFrame([(7, 0.1, 0.0, 0.0), (8, 90.0, 0.0, 0.0)], "idx long, x double, y double, z double"))
    assert [r["idx"] for r in cloud.overlap_with_cloud(near, 0.5).orderBy("idx").collect()] == [0]


def test_overlap_and_uv(spark, box):
    lid = box.transformed(align.iso3(0, 0, 0.02))
    assert mesh.faces_overlap(box, lid, 0.3, 0.05).count() >= 2
    flat = mesh.grid(spark, 3, 3)
    uv = flat.vertices.select("vid", (F.col("x") / 2).alias("u"), (F.col("y") / 2).alias("v"))
    place = mesh.project_to_uv(points(spark, [(0.5, 1.5, 0.25)]), flat, uv, "id").first()
    assert (place["u"], place["v"], abs(place["height"])) == pytest.approx((0.25, 0.75, 0.25))
    back = mesh.uv_to_3d(spark.createDataFrame([(0, 0.25, 0.75), (1, 3.0, 0.0)], "id long, u double, v double"), flat, uv, "id").collect()
    assert [(r["id"], r["x"], r["y"]) for r in back] == [(0, 0.5, 1.5)]


def test_alignment_samples(spark):
    shape = mesh.box(spark, 8.0, 8.0, 8.0)
    found = align.alignment_samples(shape, 1.5)
    assert 0 < found.count() < 300
    kept = align.stable_subset(found, "id", 0.5).count()
    assert 0 < kept < found.count()


def test_raster_borders(spark):
    full = raster.rectangle(spark, 2, 2, 10, 10).withColumn("v", F.lit(1.0))
    assert raster.erode_from_border(full, (), 14, 14, 1).count() == 64
    smooth = raster.convolve_fast(full, (), 8.0)
    assert smooth.count() == 100 and smooth.agg(F.max(F.abs(F.col("v") - 1))).first()[0] < 1e-9


def test_airfoil_edges():
    t = np.linspace(0, 2 * np.pi, 600, endpoint=False)
    r = 0.05 + 0.03 * (1 + np.cos(t)) / 2
    pill = np.stack([np.where(np.cos(t) >= 0, 1.0, 0.0) + np.cos(t) * 0.1, np.sin(t) * 0.1], 1)  # two half circles, straight sides
    result = airfoil.analyse(pill, 1e-4)
    section = airfoil.Section(pill)
    for strategy in ("intersect", "fit", "constant", "ransac", "converge"):
        e = airfoil.locate_edge(section, result["stations"], strategy, radius=0.1, tol=1e-6)
        end = min(np.linalg.norm(e["point"] - [1.1, 0]), np.linalg.norm(e["point"] - [-0.1, 0]))
        assert end < 0.02, strategy
    assert airfoil.edge_kind(section, result["stations"]) == "round"
    upper, lower = airfoil.faces_of(pill, result)
    assert upper[:, 1].mean() > 0 > lower[:, 1].mean()
    assert np.linalg.norm(airfoil.caliper_chord(pill)[1]) == pytest.approx(1.2, abs=1e-3)
    assert r.min() > 0


def test_scan_cleaning(spark):
    rows = [(f, k, k * 0.1 + (20 if k >= 20 else 0), f * 0.1, 0.01 * f) for f in range(4) for k in range(40)]
    pts = spark.createDataFrame(rows, "frame long, idx long, x double, y double, z double")
    kept = files.clean_scan(pts, 0.1, bad_edge_count=2)
    assert kept.filter("frame = 0").count() == 40 - 8
    whole = files.comprehensive_scan(pts, 0.1, 5.0, 10.0, 0.01, bad_edge_count=2, check_occlusion=True)
    first = whole.first()
    assert whole.count() == 4 * 32 and first["nz"] > 0.99 and first["std_dev"] > 0.01
