"""One small test for each finding of the third round."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components
from plumbline.operators import curves, graph, joins, mesh, normals, sampling, series
from plumbline.sources import files, formats


def test_texture_lookup_keeps_each_place_and_stays_narrow(spark):
    flat = mesh.grid(spark, 6, 6, 10.0)
    uv = flat.vertices.select("vid", (F.col("x") / 50).alias("u"), (F.col("y") / 50).alias("v"))
    q = spark.createDataFrame([(1, 0.5, 0.25), (1, 0.1, 0.9), (2, 0.2, 0.2), (3, 1.5, 0.0)], "id long, u double, v double")
    found = mesh.uv_to_3d(q, flat, uv, "id")
    got = sorted((r["id"], round(r["x"], 9), round(r["y"], 9), r["z"]) for r in found.collect())
    assert got == [(1, 5.0, 45.0, 0.0), (1, 25.0, 12.5, 0.0), (2, 10.0, 10.0, 0.0)]
    # a few cells hold all places: they aren't dealt out by cell
    assert "hashpartitioning(_u" not in found._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_of_many_links_fit(spark):
    links = spark.range(1 << 25).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    assert graph.fingerprint(links)[0] == 1 << 25
    assert components.fingerprint(links)[0] == 1 << 25


def test_copies_are_one_place_in_space(spark):
    # 60 copies of 50 places: all pairs come, made from the pairs of places
    pts = spark.range(3000).select("id", (F.col("id") % 50).cast("double").alias("x"), F.lit(0.0).alias("y"))
    found = joins.radius_join(pts, pts, "id", "id", ("x", "y"), 1.0, digits=3)
    assert found.groupBy("d").count().orderBy("d").collect() == [(0.0, 50 * 3600), (1.0, 98 * 3600)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.index("Generate explode(_r__keys") < plan.index("SortMergeJoin")
    assert joins.places(pts, "id", ("x", "y")).count() == 50
    assert joins.places(pts.withColumn("x", F.lit(0.0)), "id", ("x", "y")).count() == 12


def test_nearest_of_copies_need_no_pairs_of_copies(spark, monkeypatch):
    pts = spark.range(3000).select("id", (F.col("id") % 50).cast("double").alias("x"), F.lit(0.0).alias("y"))
    rows, near = [], joins.neighbours
    monkeypatch.setattr(joins, "neighbours", lambda a, b, *more: rows.append((a.count(), b.count())) or near(a, b, *more))
    found = joins.knn_join(pts, pts, "id", "id", ("x", "y"), 3, 2.0)
    assert rows[0] == (50, 150)
    assert sorted(r["id_2"] for r in found.filter("id = 2999").collect()) == [49, 99, 149] and found.count() == 9000
    over = joins.overlap_by_reciprocity(pts, pts, "id", ("x", "y"), 0.5, 2.0)
    assert over.count() == 3000 and max(b for _, b in rows) <= 150


def test_normals_of_copies_count_them(spark):
    pts = spark.range(400).select("id", (F.col("id") % 4 % 2).cast("double").alias("x"), F.floor(F.col("id") % 4 / 2).cast("double").alias("y"), F.col("id") % 4 % 2 * 0.5)
    pts = pts.toDF("id", "x", "y", "z").unionByName(spark.createDataFrame([(900, 50.0, 0.0, 0.0), (901, 50.0, 0.0, 0.0)], "id long, x double, y double, z double"))
    found = normals.estimate_normals(pts, "id", 3.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 402 and plan.count("Join") == 2  # places with places, then each row with its place's sums
    n = {r["id"]: (round(r["nx"], 6), round(r["ny"], 6), round(r["nz"], 6)) for r in found.collect()}
    assert n[900] == n[901] == (0.0, 0.0, 1.0)
    assert n[0] == n[399] == (round(-0.5 / 1.25**0.5, 6), 0.0, round(1 / 1.25**0.5, 6))


def test_clusters_link_cells_not_points(spark, monkeypatch):
    pts = spark.range(2000).select("id", (F.col("id") % 40 * 0.1).alias("x"), F.lit(0.0).alias("y")).unionByName(spark.createDataFrame([(5000, 90.0, 0.0)], "id long, x double, y double"))
    links, comp = [], graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda e, n: links.append(e.count()) or comp(e, n))
    got = graph.cluster_points(pts, "id", ("x", "y"), 1.0).groupBy("cluster").count().orderBy("cluster").collect()
    assert got == [(0, 2000), (5000, 1)] and links[0] < 2100


def test_counts_in_sparse_clouds_repeat_little(spark):
    pts = spark.range(2000).select("id", (F.col("id") % 45).cast("double").alias("x"), (F.col("id") * 0.001).alias("y"))
    counts = joins.radius_counts(pts, pts, "id", ("x", "y"), 0.0005)
    assert counts.filter("n = 1").count() == 2000


def test_rays_and_points_with_one_key_each_count(spark):
    box = mesh.box(spark, 60.0, 80.0, 10.0)
    rays = spark.createDataFrame([(1, -3.0, 5.0), (1, -3.0, 5.0), (1, 7.0, 9.0), (2, 500.0, 0.0)], "id long, ox double, oy double")
    rays = rays.select("*", F.lit(50.0).alias("oz"), F.lit(0.1).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"))
    for more in ({}, {"part_faces": 4}):
        assert sorted((r["id"], round(r["x"], 6)) for r in mesh.ray_hits(rays, box, "id", **more).collect()) == [(1, 1.5), (1, 1.5), (1, 11.5)]
    p = spark.createDataFrame([(1, 0.0, 0.0, 9.0), (1, 0.0, 0.0, 9.0)], "id long, x double, y double, z double")
    assert [r["d"] for r in mesh.closest(p, box, "id", part_faces=4).collect()] == [4.0, 4.0]


def test_hull_passes_over_inner_points_in_blocks():
    p = np.random.default_rng(3).random((200_000, 3)) * [50, 100, 10]
    began = time.perf_counter()
    f = sampling.hull_3d(p)
    assert time.perf_counter() - began < 10  # point by point it takes several times that
    n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    assert (p @ n.T - (n * p[f[:, 0]]).sum(axis=1)).max() < 1e-6


def test_plane_hulls_shuffle_corners_only(spark):
    pts = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y")).localCheckpoint()
    found = sampling.convex_hulls(pts, ["g"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInPandas")  # below the shuffle
    for g in (0, 1):
        p = np.array([tuple(r) for r in pts.filter(f"g = {g}").select("x", "y").collect()])
        assert np.array_equal(np.array([tuple(r) for r in found.filter(f"g = {g}").orderBy("position").select("x", "y").collect()]), p[sampling.hull_2d(p)])


def test_many_curves_are_simplified_together(spark):
    g = np.random.default_rng(5)
    lengths = [*g.integers(1, 30, 300), 2500, 1, 2]
    p = [g.random((n, 2)) * 3 for n in lengths]
    p[0][:] = 1.0
    last = np.cumsum(lengths) - 1
    keep = curves.simplify_arrays(np.concatenate(p), np.append(0, last[:-1] + 1), last, 0.8)
    want = [np.isin(np.arange(len(q)), curves.simplify_array(q, 0.8)) if len(q) > 2 else np.ones(len(q), bool) for q in p]
    assert np.array_equal(keep, np.concatenate(want))
    rows = pd.DataFrame({"c": np.repeat(np.arange(len(p)), lengths), "seq": np.concatenate([np.arange(n) for n in lengths]), "x": np.concatenate(p)[:, 0], "y": np.concatenate(p)[:, 1]})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = curves.simplify(spark.createDataFrame(rows), ["c"], 0.8)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.orderBy("c", "seq").toPandas()[["c", "seq"]].equals(rows[keep][["c", "seq"]].reset_index(drop=True))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges_give_the_places_on_them(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 0.0), (1, 2, 3.0, 0.0), (1, 3, 3.0, 1.0), (2, 0, 5.0, 5.0), (2, 1, 5.0, 5.0), (3, 0, 1.0, 1.0), (3, 1, 1.5, 1.0)], "c long, seq long, x double, y double")
    found = curves.resample(rows, ["c"], n=5)
    got = sorted(tuple(r) for r in found.filter("c <> 2").collect())
    assert got == [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 1.0, 0.0), (1, 2, 2.0, 2.0, 0.0), (1, 3, 3.0, 3.0, 0.0), (1, 4, 4.0, 3.0, 1.0), *((3, k, k / 8, 1 + k / 8, 1.0) for k in range(5))]
    assert sorted(tuple(r) for r in found.filter("c = 2").collect()) == [(2, k, 0.0, None, None) for k in range(5)]
    assert [r["length"] for r in curves.resample(rows.filter("c = 1"), ["c"], spacing=1.5).orderBy("i").collect()] == [0.5, 2.0, 3.5]
    assert [r["length"] for r in curves.resample(rows.filter("c = 1"), ["c"], max_spacing=1.9).orderBy("i").collect()] == pytest.approx([0, 4 / 3, 8 / 3, 4])
    assert found._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1


def test_interpolation_never_looks_to_the_end_of_a_series(spark):
    s = spark.range(2000).select(F.lit(1).alias("id"), (F.col("id") * 2).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    q = spark.range(4001).select(F.lit(1).alias("id"), (F.col("id") - 1).cast("double").alias("x"))
    found = series.interpolate(q, s, ["id"])
    assert "UnboundedFollowing" not in found._jdf.queryExecution().executedPlan().toString().replace("unboundedfollowing", "UnboundedFollowing")
    got = {r["x"]: r["y"] for r in found.collect()}
    assert got[-1.0] is None and got[0.0] == 0.0 and got[3.0] == 1.5 and got[3998.0] == 1999.0 and got[3999.0] is None


def test_collisions_need_no_list_of_all_exceptions(spark):
    box = mesh.box(spark, 2.0, 2.0, 2.0).corners()
    at = spark.range(12).select(F.col("id").alias("mesh_id"), (F.col("id") * 1.5).alias("px"), (F.col("id") % 2 == 0).alias("moving"))
    faces = at.join(box).select("mesh_id", "fid", *((F.col(f"{c}{k}") + (F.col("px") if c == "x" else F.lit(0.0))).alias(f"{c}{k}") for k in range(3) for c in "xyz")).localCheckpoint()
    found = mesh.collisions(faces, at.select("mesh_id", "moving"), (F.col("id1") + F.col("id2")) % 3 == 0, 2.0)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(a, b) for a in range(0, 12, 2) for b in range(12) if abs(a - b) == 1 and (a + b) % 3}
    assert {tuple(r) for r in found.collect()} == want


def test_clouds_are_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    files.register(spark)
    n = (1 << 20) + 70_000
    pts = spark.range(n).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z")).coalesce(1)
    pts.write.format("bxyz").mode("append").save(str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("*.bxyz"))) == 2  # one task
    back = spark.read.format("bxyz").load(str(tmp_path / "a"))
    assert back.agg(F.count("*"), F.max("x"), F.sum("y"), F.count("nx"), F.max("idx")).first() == (n, float(n - 1), float(n), 0, (1 << 20) - 1)


def test_scans_come_frame_by_frame():
    x = np.arange(200_000, dtype=np.int32)
    data = formats.write_lptf3([(k, x, x, None) for k in (3, 5)], 200_000)
    sizes = [len(p) for p in files._pieces("lptf3", data, {})]
    assert max(sizes) <= 65_536 and sum(sizes) == 400_000
