"""Checked ingest, stations, lifts, selections, regions of interest and matched indexes on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lift
from ..functions import vectors as V
from ..operators import ingest, joins, mesh, raster, sampling, stations, stats
from ..operators.checkpoints import folder
from ..operators.masks import SelectOp
from . import views as W
from .queries import C, P, R, query, rounded
from .shape_queries import NORMALS, SEG, supplier_mesh


# ---- ingest ----------------------------------------------------------------------------------------------------------------
@query("select c_nationkey as nation, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as bigint) as idx, cast(c_custkey as double) as x, c_acctbal as y from customer")
def flat_lists(spark, sf):
    """The customers of each nation as one flat list of numbers, and points again."""
    p = W.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("idx"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return ingest.unflattened(ingest.flattened(p, ["nation"]), "values", 2)


@query("select cast(row_number() over (order by s_suppkey) - 1 as bigint) as idx, s_acctbal as x, cast(s_nationkey as double) as y, s_suppkey * 0.5 as z from supplier")
def array_points(spark, sf):
    """Supplier points that the driver holds as an array (a table of bounded size), checked and numbered."""
    s = W.table(spark, sf, "supplier").orderBy("s_suppkey").select("s_acctbal", F.col("s_nationkey").cast("double"), F.col("s_suppkey") * 0.5).toPandas()
    return ingest.points_from_array(spark, s.to_numpy())


@query(f"select key, x, y, round(coalesce((x - 25.5), 0) / sqrt((x - 25.5) ** 2 + 4.0), 9) as nx, round(2.0 / sqrt((x - 25.5) ** 2 + 4.0), 9) as ny from {P}")
def zipped_surface_points(spark, sf):
    p = W.line_points(spark, sf).groupBy("key").agg(F.first("x").alias("x"), F.first("y").alias("y"))
    many = W.line_points(spark, sf).groupBy("key").count().filter("count > 1").select("key")
    n = p.select("key", (F.col("x") - 25.5).alias("x"), F.lit(2.0).alias("y"))
    made = ingest.surface_points(p, n, "key", ("x", "y"))
    # keys are unique but for rows that repeat; each such row is a point of its own
    again = W.line_points(spark, sf).join(many, "key", "left_semi").select("key", "x", "y")
    again = again.exceptAll(p.join(many, "key", "left_semi").select("key", "x", "y"))
    size = F.sqrt(F.pow(F.col("x") - 25.5, 2) + 4.0)
    again = again.select("key", "x", "y", ((F.col("x") - 25.5) / size).alias("nx"), (2.0 / size).alias("ny"))
    return rounded(made.unionByName(again), "nx", "ny", digits=9)


@query(f"select key, cast(k as bigint) as k, round(x + (10.0 - x) * (k + 1) / 4.0, 9) as px, round(y + (20.0 - y) * (k + 1) / 4.0, 9) as py from {P}, range(0, 3) t(k) where grp = 'A'")
def evenly_spaced_points(spark, sf):
    made = ingest.evenly_spaced(V.vec("x", "y"), V.vec(10.0, 20.0), 3, ends=False)
    rows = W.line_points(spark, sf).filter("grp = 'A'").select("key", F.posexplode(made).alias("k", "p"))
    return rows.select("key", F.col("k").cast("long").alias("k"), F.round(F.col("p")[0], 9).alias("px"), F.round(F.col("p")[1], 9).alias("py"))


@query("select cast(row_number() over (order by p_retailprice, p_partkey) - 1 as bigint) as idx, p_partkey as key, p_retailprice as x from part")
def indexed_points(spark, sf):
    p = W.table(spark, sf, "part").select(F.col("p_retailprice").alias("x"), F.col("p_partkey").alias("key"))
    return ingest.indexed(p, ["x", "key"]).select("idx", "key", "x")


# ---- lifts -----------------------------------------------------------------------------------------------------------------
@query(f"""
with n as (select key, x, y, z, x / sqrt(x * x + y * y + z * z) as nx, y / sqrt(x * x + y * y + z * z) as ny from {P})
select key, x as px, 0.0 as pz, round(nx / sqrt(nx * nx + ny * ny), 9) as ux, round(ny / sqrt(nx * nx + ny * ny), 9) as uy, round(0.8 * x - 0.6 * y + 10.0, 6) as ax, 2.5 as az,
    round(0.6 * (0.8 * (x - 5.0) - 0.6 * (y - 4.0)) + 0.8 * (0.6 * (x - 5.0) + 0.8 * (y - 4.0)), 6) as across from n
""")
def lifted_points(spark, sf):
    p = V.vec("x", "y", "z")
    matrix = ((0.8, -0.6, 0.0, 10.0), (0.6, 0.8, 0.0, -5.0), (0.0, 0.0, 1.0, 2.5))
    q, (_, u) = lift.to_3d(lift.to_2d(p)), lift.surface_point_to_2d(p, V.unit(p))
    a, _, _ = lift.distance_to_3d(lift.to_2d(p), V.vec(0.0, 0.0), V.vec(1.0, 0.0), matrix)
    b, c, _ = lift.distance_to_2d(V.vec(5.0, 4.0, 1.0), p, V.vec(1.0, 0.0, 0.0), matrix)
    return W.line_points(spark, sf).select("key", q[0].alias("px"), q[2].alias("pz"), F.round(u[0], 9).alias("ux"), F.round(u[1], 9).alias("uy"), F.round(a[0], 6).alias("ax"), F.round(a[2], 6).alias("az"), F.round(lift.distance_value(b, c, V.vec(0.6, 0.8)), 6).alias("across"))


# ---- stations --------------------------------------------------------------------------------------------------------------
@query(f"""
with d as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as d, lead(seq) over o as nxt, lag(seq) over o as prv from {SEG} window o as (partition by curve order by seq)),
l as (select *, coalesce(sum(d) over (partition by curve order by seq rows between unbounded preceding and 1 preceding), 0) as l0, (x1 - x0) / d as bx, (y1 - y0) / d as by_, lag((x1 - x0) / d) over o as ax, lag((y1 - y0) / d) over o as ay from d window o as (partition by curve order by seq)),
v as (select *, coalesce(ax, 0) + coalesce(bx, 0) as vx, coalesce(ay, 0) + coalesce(by_, 0) as vy from l)
select curve, seq, prv as previous, nxt as next, round(l0, 6) as length, round(vx / nullif(sqrt(vx * vx + vy * vy), 0), 6) as dx, round(vy / nullif(sqrt(vx * vx + vy * vy), 0), 6) as nx from v
""")
def vertex_stations(spark, sf):
    s = stations.at_vertices(W.order_curves(spark, sf), ["curve"])
    return rounded(s.select("curve", "seq", "previous", "next", "length", "dx", "nx"), "length", "dx", "nx")


@query(f"""
with r as (select curve, seq, x, y, row_number() over (partition by curve order by seq) as n, count(*) over (partition by curve) as c, first_value(seq) over (partition by curve order by seq) as f, last_value(seq) over (partition by curve order by seq rows between unbounded preceding and unbounded following) as l, lead(seq) over (partition by curve order by seq) as nx, lag(seq) over (partition by curve order by seq) as pv from {C})
select curve, seq, coalesce(pv, l) as previous, coalesce(nx, f) as next from r
""")
def closed_curve_stations(spark, sf):
    return stations.at_vertices(W.order_curves(spark, sf), ["curve"], closed=True).select("curve", "seq", "previous", "next")


@query(f"""
with g as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as d from {SEG}), l as (select *, coalesce(sum(d) over (partition by curve order by seq rows between unbounded preceding and 1 preceding), 0) as l0 from g), t as (select curve, sum(d) as total from l group by curve)
select l.curve, round(q, 6) as length, seq, round((q - l0) / d, 6) as fraction, round(x0 + (x1 - x0) * (q - l0) / d, 6) as x, round((y1 - y0) / d, 6) as nx, round((x0 + (x1 - x0) * (q - l0) / d - 5.0) * (x1 - x0) / d + (y0 + (y1 - y0) * (q - l0) / d - 4.0) * (y1 - y0) / d, 5) as along
from l join t using (curve), lateral (select total * 0.37 as q) where d > 0 and q >= l0 and q < l0 + d
""")
def curve_stations(spark, sf):
    """A station at 37 % of each curve: its edge, fraction, place and normal, and how far it lies beyond (5, 4) along its direction."""
    from ..operators.curves import total_length

    c = W.order_curves(spark, sf)
    q = total_length(c, ["curve"]).filter("length > 0").select("curve", (F.col("length") * 0.37).alias("length"))
    s = stations.at(c, q, ["curve"]).filter("x is not null")
    along = -stations.direction_projection(V.vec("x", "y"), V.vec("dx", "dy"), V.vec(5.0, 4.0))
    return s.select("curve", F.round("length", 6).alias("length"), "seq", F.round("fraction", 6).alias("fraction"), F.round("x", 6).alias("x"), F.round("nx", 6).alias("nx"), F.round(along, 5).alias("along"))


# ---- meshes ----------------------------------------------------------------------------------------------------------------
@query(f"select fid, round(x0 * 0.2 + x1 * 0.3 + x2 * 0.5, 6) as x, round(z0 * 0.2 + z1 * 0.3 + z2 * 0.5, 6) as z, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) as nx from {NORMALS}")
def face_places(spark, sf):
    m = supplier_mesh(spark, sf)
    q = m.faces.select("fid", F.lit(0.2).alias("u"), F.lit(0.3).alias("v"), F.lit(0.5).alias("w"))
    return rounded(mesh.at_barycentric(m, q).select("fid", "x", "z", "nx"), "x", "z", "nx")


@query(f"""
with f as (select fid, x0 * 0.6 + z0 * 0.8 >= 30 and x1 * 0.6 + z1 * 0.8 >= 30 and x2 * 0.6 + z2 * 0.8 >= 30 as up, nx * nx + ny * ny + nz * nz > 0 and acos(greatest(least(nx / sqrt(nx * nx + ny * ny + nz * nz), 1.0), -1.0)) < 1.9 as facing,
    greatest((x0 - 50) ** 2 + (y0 - 12) ** 2 + (z0 - 20) ** 2, (x1 - 50) ** 2 + (y1 - 12) ** 2 + (z1 - 20) ** 2, (x2 - 50) ** 2 + (y2 - 12) ** 2 + (z2 - 20) ** 2) <= 2500 as near from {NORMALS})
select fid from f where not ((up or near) and not facing)
""")
def chained_selection(spark, sf):
    """All faces that aren't (above a plane or near a point) and turned away: one plan."""
    m = supplier_mesh(spark, sf)
    chosen = mesh.Selection.nothing(m).above_plane((0.6, 0.0, 0.8), 30.0, SelectOp.ADD).near_point((50.0, 12.0, 20.0), 50.0, SelectOp.ADD).facing((1.0, 0.0, 0.0), 1.9, SelectOp.REMOVE)
    return chosen.inverted().collect()


@query(f"select count(*) as n, round(sum(sqrt(nx * nx + ny * ny + nz * nz)) / 2, 4) as area from {NORMALS} where x0 * 0.6 + z0 * 0.8 >= 30 and x1 * 0.6 + z1 * 0.8 >= 30 and x2 * 0.6 + z2 * 0.8 >= 30")
def selected_mesh_area(spark, sf):
    m = mesh.Selection.everything(supplier_mesh(spark, sf)).above_plane((0.6, 0.0, 0.8), 30.0).create_mesh()
    return m.face_geometry().agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("area"))


@query()
def convex_hull_3d(spark, sf):
    """Triangles of the hull of each group's points in space; tests hold it against the half-spaces of its faces."""
    return sampling.convex_hulls_3d(W.line_points(spark, sf).select("grp", "x", "y", "z"), ["grp"])


@query(f"""
with s as (select x0, y0, x1, y1, row_number() over (order by seq) as n, coalesce(sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) over (order by seq rows between unbounded preceding and 1 preceding), 0) as l0 from {SEG} where curve = (select min(curve) from {C}) and x1 is not null),
p as (select key, x, y from {P} where z = 5), c as (
    select key, s.*, least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2), 0.0), 1.0) as t, x, y from p, s),
d as (select *, sqrt((x - x0 - (x1 - x0) * t) ** 2 + (y - y0 - (y1 - y0) * t) ** 2) as d from c), m as (select key, x, y, min(struct_pack(d := d, n := n, t := t, x0 := x0, y0 := y0, x1 := x1, y1 := y1, l0 := l0)) as m from d group by key, x, y)
select key, round((m).d, 6) as d, round((m).l0 + (m).t * sqrt(((m).x1 - (m).x0) ** 2 + ((m).y1 - (m).y0) ** 2), 5) as length from m
""")
def curve_deviations(spark, sf):
    """Distances of points from the first customer's polyline, and the lengths where they come closest to it."""
    from ..operators import curves

    c = W.order_curves(spark, sf)
    first = c.join(F.broadcast(c.agg(F.min("curve").alias("curve"))), "curve")  # one row
    segments = curves.segments(first, ["curve"]).select("seq", "x0", "y0", "x1", "y1", "l0").withColumnRenamed("seq", "seg")
    p = W.line_points(spark, sf).filter("z = 5").select("key", "x", "y").distinct()
    return joins.curve_deviation(p, "key", segments).select("key", F.round("d", 6).alias("d"), F.round("length", 5).alias("length"))


@query("select 12 as cx, 30 as cy, 9 as radius, true as enough")
def bounded_circle_ransac(spark, sf):
    """The circle that most of the points near a planted one lie on, among circles with a radius from 5 to 15."""
    t = F.col("y") * 7
    ring = W.line_points(spark, sf).select((F.lit(12.0) + F.cos(t) * 9).alias("x"), (F.lit(30.0) + F.sin(t) * 9).alias("y"))
    noise = W.line_points(spark, sf).filter("z >= 8").select(F.col("x").cast("double").alias("x"), "y")
    cx, cy, r, n = stats.circle_ransac(ring.unionAll(noise), "x", "y", 1e-6, min_radius=5.0, max_radius=15.0)
    return spark.createDataFrame([(round(cx), round(cy), round(r), n >= ring.count())], "cx int, cy int, radius int, enough boolean")


@query(f"""
with a as (select key, x, y, z from {P} where grp = 'A' and z >= 9), b as (select key, x, y, z from {P} where grp = 'N' and z >= 9)
select a.key, b.key as other, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) as d from a join b on b.x between a.x - 0.6 and a.x + 0.6 and b.y between a.y - 0.6 and a.y + 0.6 where (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.25
""")
def matched_index_join(spark, sf):
    """An index made once of one group's points, checked against them, and searched for another's neighbours."""
    p = W.line_points(spark, sf).filter("z >= 9").select("key", "grp", F.col("x").cast("double").alias("x"), "y", "z")
    of, near = p.filter("grp = 'N'").drop("grp"), p.filter("grp = 'A'").drop("grp")
    index = joins.MatchedIndex.of(of, "key", ("x", "y", "z"), 0.5).checked(of, "key")
    return index.within(near, "key", digits=6)


# ---- regions of interest and mask images ---------------------------------------------------------------------------------
@query(f"select row, col, row - 20 as local_row, col - 10 as local_col from {R} where n >= 8 and row between 20 and 59 and col between 10 and 34")
def roi_mask(spark, sf):
    dense = W.price_raster(spark, sf).filter("n >= 8").select("row", "col")
    return raster.RoiMask.of(dense, 0, 0, 120, 60).resized(20, 10, 40, 25).pixels()


@query(f"""
with b as (select r.row, c.col from range(30, 60) r(row), range(10, 30) c(col))
select b.row, b.col, m.row is not null as set from b left join (select row, col from {R} where n >= 8) m on m.row = b.row and m.col = b.col
""")
def roi_shared(spark, sf):
    dense = W.price_raster(spark, sf).filter("n >= 8").select("row", "col")
    a, b = raster.RoiMask.of(dense, 20, 10, 40, 25), raster.RoiMask.of(dense, 30, 0, 50, 30)
    return a.shared(b)


@query(f"select kind, row, col from (select row, col from {R} where n >= 8 and row >= 0), (values ('png'), ('pgm'), ('bmp')) t(kind)")
def mask_images(spark, sf):
    """A mask as images of three formats, and back."""
    from ..sources import files

    dense = W.price_raster(spark, sf).filter("n >= 8 and row >= 0").select("row", "col")
    out = None
    for kind in ("png", "pgm", "bmp"):
        path = folder(spark, f"mask-{kind}")
        files.save_content(files.mask_bytes(dense, kind), path, f"mask.{kind}")
        one = files.load(spark, "mask", path).select(F.lit(kind).alias("kind"), "row", "col")
        out = one if out is None else out.unionAll(one)
    return out
