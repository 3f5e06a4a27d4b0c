"""More of the row-wise geometry, curves and rasters on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import shapes as S
from ..functions import vectors as V
from ..operators import curves, graph, mesh, raster, sampling, series
from . import views as W
from .queries import C, E, P, R, T, query, rounded

TAU = "6.283185307179586"


@query(f"""
select key, greatest(lo, 10.0) as i_min, least(hi, 60.0) as i_max, round(hi - lo, 9) as length, lo >= 10.0 and hi <= 60.0 as within
from (select key, least(x, y) as lo, greatest(x, y) as hi from {P}) where lo <= 60.0 and hi >= 10.0
""")
def interval_algebra(spark, sf):
    i, j = A.interval(F.col("x").cast("double"), F.col("y")), A.interval(F.lit(10.0), F.lit(60.0))
    both = A.interval_intersection(i, j)
    rows = W.line_points(spark, sf).select("key", both.alias("b"), F.round(A.interval_length(i), 9).alias("length"), A.interval_contains_interval(j, i).alias("within"))
    return rows.filter("b is not null").select("key", F.col("b.min").alias("i_min"), F.col("b.max").alias("i_max"), "length", "within")


@query(f"""
select key, round(10.0 + 30.0 * t, 7) as px, round(5.0 + 40.0 * t, 7) as py, round(t, 7) as t, round(sqrt((x - 10.0 - 30.0 * t) * (x - 10.0 - 30.0 * t) + (y - 5.0 - 40.0 * t) * (y - 5.0 - 40.0 * t)), 7) as d
from (select key, x, y, least(greatest(((x - 10.0) * 30.0 + (y - 5.0) * 40.0) / 2500.0, 0.0), 1.0) as t from {P})
""")
def segment_closest(spark, sf):
    p = V.vec("x", "y")
    q, t = S.segment_closest(V.vec(10.0, 5.0), V.vec(40.0, 45.0), p)
    return W.line_points(spark, sf).select("key", F.round(q[0], 7).alias("px"), F.round(q[1], 7).alias("py"), F.round(t, 7).alias("t"), F.round(V.dist(p, q), 7).alias("d"))


@query(f"""
select key, case when along > 1e-6 then round((30.0 - (0.6 * x + 0.8 * z)) / along, 6) end as one_sided, case when abs(along) > 1e-6 then round((30.0 - (0.6 * x + 0.8 * z)) / along, 6) end as both_sides
from (select key, x, z, 0.6 * (y - 40.0) / 10 + 0.8 * 0.5 as along from {P})
""")
def ray_plane_distance(spark, sf):
    n, p, d = V.vec(0.6, 0.0, 0.8), V.vec("x", "y", "z"), ((F.col("y") - 40.0) / 10, F.lit(0.0), F.lit(0.5))
    rows = W.line_points(spark, sf)
    return rows.select("key", F.round(S.plane_intersection_distance(n, 30.0, p, d), 6).alias("one_sided"), F.round(S.plane_intersection_distance(n, 30.0, p, d, True), 6).alias("both_sides"))


@query(f"""
with q as (select key, x - 25.0 as wx, y - 40.0 as wy, z - 5.0 as wz from {P}), s as (select key, wx * 0.6 + wy * 0.8 as b, wx * wx + wy * wy + wz * wz - 900.0 as c from q)
select key, case when b * b - c >= 0 then round(-b - sqrt(b * b - c), 6) end as t0, case when b * b - c >= 0 then round(-b + sqrt(b * b - c), 6) end as t1 from s
""")
def line_sphere_hits(spark, sf):
    t0, t1 = S.line_sphere_params(V.vec("x", "y", "z"), V.vec(0.6, 0.8, 0.0), V.vec(25.0, 40.0, 5.0), 30.0)
    return W.line_points(spark, sf).select("key", F.round(t0, 6).alias("t0"), F.round(t1, 6).alias("t1"))


@query(f"""
with c as (select key, x, y, 0.2 * x + 5.0 as r, sqrt((x - 30.0) * (x - 30.0) + (y - 40.0) * (y - 40.0)) as d from {P}),
m as (select *, (r * r - 400.0 + d * d) / (2 * d) as a, d > 0 and d <= r + 20.0 and d >= abs(r - 20.0) as meets from c)
select key, meets, case when meets then round(a, 6) end as a, case when meets then round(2 * sqrt(greatest(r * r - a * a, 0)), 6) end as common_chord from m
""")
def circle_intersections(spark, sf):
    c, r = V.vec("x", "y"), F.col("x") * 0.2 + 5.0
    p, q = S.circles_intersections(c, r, V.vec(30.0, 40.0), F.lit(20.0))
    mid = V.mid_point(p, q)
    towards = V.dot(V.sub(mid, c), V.unit(V.sub(V.vec(30.0, 40.0), c)))
    return W.line_points(spark, sf).select("key", p[0].isNotNull().alias("meets"), F.round(towards, 6).alias("a"), F.round(V.dist(p, q), 6).alias("common_chord"))


@query(f"""
select key, round(b - a - {TAU} * floor((b - a) / {TAU}), 8) as ccw, round(a - b - {TAU} * floor((a - b) / {TAU}), 8) as cw, (a - 1.0 - {TAU} * floor((a - 1.0) / {TAU})) <= 2.0 + 1e-12 or (a - 1.0 - {TAU} * floor((a - 1.0) / {TAU})) >= {TAU} - 1e-12 as on_arc
from (select key, x * 0.31 as a, y * 0.17 as b from {P})
""")
def directed_angles(spark, sf):
    a, b = F.col("x") * 0.31, F.col("y") * 0.17
    return W.line_points(spark, sf).select("key", F.round(A.in_direction(a, b, 1), 8).alias("ccw"), F.round(A.in_direction(a, b, -1), 8).alias("cw"), A.arc_contains(F.lit(1.0), F.lit(2.0), a).alias("on_arc"))


@query(f"""
with s as (select *, lag(x) over o as ax, lag(y) over o as ay, lead(x) over o as bx, lead(y) over o as by_ from {C} window o as (partition by curve order by seq)),
u as (select *, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) as da, sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y)) as db from s),
v as (select curve, seq, coalesce((x - ax) / nullif(da, 0), 0) + coalesce((bx - x) / nullif(db, 0), 0) as vx, coalesce((y - ay) / nullif(da, 0), 0) + coalesce((by_ - y) / nullif(db, 0), 0) as vy from u)
select curve, seq, round(vx / nullif(sqrt(vx * vx + vy * vy), 0), 6) as dx, round(vy / nullif(sqrt(vx * vx + vy * vy), 0), 6) as dy from v
""")
def vertex_directions(spark, sf):
    d = curves.vertex_directions(W.order_curves(spark, sf), ["curve"])
    return W.order_curves(spark, sf).select("curve", "seq", F.round(d[0], 6).alias("dx"), F.round(d[1], 6).alias("dy"))


@query(f"""
with s as (select curve, seq, x as x0, y as y0, lead(x) over o as x1, lead(y) over o as y1 from {C} window o as (partition by curve order by seq)),
h as (select curve, seq, ((x0 - 20.0) * (y1 - y0) - (y0 - 50.0) * (x1 - x0)) / (0.8 * (y1 - y0) - 0.6 * (x1 - x0)) as t, ((x0 - 20.0) * 0.6 - (y0 - 50.0) * 0.8) / (0.8 * (y1 - y0) - 0.6 * (x1 - x0)) as u from s where x1 is not null and abs(0.8 * (y1 - y0) - 0.6 * (x1 - x0)) > 1e-12)
select curve, seq, round(t, 6) as t, round(20.0 + t * 0.8, 6) as x, round(50.0 + t * 0.6, 6) as y from h where u between 0 and 1
""")
def curve_ray_hits(spark, sf):
    return rounded(curves.ray_hits(W.order_curves(spark, sf), ["curve"], (20.0, 50.0), (0.8, 0.6)), "t", "x", "y")


@query(f"""
with r as (select row, col, v from {R}), n as (select a.row, a.col, b.v from r a cross join (select i, j from (select unnest(range(-2, 3)) as i) cross join (select unnest(range(-2, 3)) as j)) k join r b on b.row = a.row + k.i and b.col = a.col + k.j where abs(k.i) + abs(k.j) <= 3)
select row, col, round(avg(v), 6) as v from n group by row, col
""")
def raster_area_average(spark, sf):
    return rounded(raster.area_average(W.price_raster(spark, sf).select("row", "col", "v"), (), 2), "v")


@query(f"with r as (select row, col from {R}) select distinct row + dr as row, col + dc as col from r cross join (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) k(dr, dc)")
def raster_dilate_square(spark, sf):
    return raster.dilate(W.price_raster(spark, sf).select("row", "col"), (), 1, "linf")


@query(f"select row * 2 + i as row, col * 2 + j as col, v from {R} cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) k(i, j)")
def raster_upscale(spark, sf):
    return raster.resized(W.price_raster(spark, sf).select("row", "col", "v"), (), 2.0)


@query(f"""
with e as (select fid, least(u, v) as lo, greatest(u, v) as hi from (select fid, unnest([a, b, c]) as u, unnest([b, c, a]) as v from {T})),
s as (select e.fid as a, f.fid as b from e join e f using (lo, hi))
select a as fid, count(distinct b) - 1 as neighbours from s group by a
""")
def face_neighbours(spark, sf):
    e = graph.directed_edges(W.part_faces(spark, sf)).select("fid", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    both = e.join(e.select(F.col("fid").alias("other"), "lo", "hi"), ["lo", "hi"])
    return both.groupBy("fid").agg((F.count_distinct("other") - 1).alias("neighbours"))


@query(f"""
with v as (select cast(s_suppkey as bigint) as vid, s_acctbal / 100 as x, cast(s_nationkey as double) as y, s_suppkey * 0.5 as z from supplier),
c as (select f.fid, a.x as x0, a.y as y0, a.z as z0, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as vx, c.y - a.y as vy, c.z - a.z as vz from {T} f join v a on f.a = a.vid join v b on f.b = b.vid join v c on f.c = c.vid),
n as (select fid, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz from c)
select fid, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) as nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) as ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) as nz, round(0.5 * sqrt(nx * nx + ny * ny + nz * nz), 6) as area from n
""")
def face_normals_and_areas(spark, sf):
    s = W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vid"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") * 0.5).alias("z"))
    return rounded(mesh.Mesh(s, W.part_faces(spark, sf)).face_geometry(), "nx", "ny", "nz", "area")


@query(f"""
with z as (select id, min(x) as a, max(x) as b from {E} group by id),
q as (select id, a + i * 5000.0 as x from (select id, a, unnest(range(0, cast(floor((b - a) / 5000.0) as bigint) + 2)) as i, b from z) where a + i * 5000.0 <= b),
s as (select e.id, e.x as sx, e.y as sy, lead(e.x) over o as nx, lead(e.y) over o as ny from {E} e window o as (partition by e.id order by e.x)),
k as (select q.id, q.x, s.* exclude (id) from q asof join s on q.id = s.id and q.x >= s.sx)
select id, count(*) as n, round(sum(case when sx = x then sy else sy + (ny - sy) * (x - sx) / (nx - sx) end), 4) as total from k group by id
""")
def interpolated_totals_whole(spark, sf):
    """Sums of each series at steps of 5000 s from its first event to its end."""
    s = W.event_series(spark, sf)
    ends = s.groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    steps = F.sequence(F.lit(0), F.floor((F.col("b") - F.col("a")) / 5000.0) + 1)
    at = ends.select("id", "b", F.explode(F.transform(steps, lambda i: F.col("a") + i * 5000.0)).alias("x")).filter("x <= b").select("id", "x")
    return series.interpolate(at, s, ["id"]).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query(f"select key, rank from (select key, row_number() over (partition by grp order by y desc, key) as rank from {P}) where rank <= 10")
def highest_points(spark, sf):
    w = Window.partitionBy("grp").orderBy(F.desc("y"), "key")
    return W.line_points(spark, sf).select("key", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 10")


@query()
def ball_pivot(spark, sf):
    """The boundary that a ball meets around the thinned points of each group."""
    import pandas as pd

    thin = W.line_points(spark, sf).groupBy("grp", F.floor(F.col("x") / 4).alias("i"), F.floor(F.col("y") / 4).alias("j")).agg(F.min_by(F.struct("x", "y"), "key").alias("p")).select("grp", "p.x", "p.y")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(float)
        at = sampling.ball_pivot(p, 200.0)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "position": range(len(at)), "x": p[at, 0], "y": p[at, 1]})

    return thin.groupBy("grp").applyInPandas(run, "grp string, position long, x double, y double")
