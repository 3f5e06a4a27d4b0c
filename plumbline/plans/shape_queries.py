"""Series, curves, meshes, rasters, files and streams on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clouds, curves, graph, masks, mesh, raster, series, stats
from ..operators.checkpoints import folder
from . import views as W
from .queries import C, E, P, R, query, rounded

#: A mesh of suppliers: vertices by balance, nation and key; triangles as in views.part_faces.
V = "(select cast(s_suppkey as bigint) as vid, s_acctbal / 100 as x, cast(s_nationkey as double) as y, s_suppkey * 0.5 as z from supplier)"
T = f"(select f.* from {W.PART_FACES if W.PART_FACES.startswith('(') else f'({W.PART_FACES})'} f where f.b in (select s_suppkey from supplier) and f.c in (select s_suppkey from supplier))"
#: The triangles with their corners.
TRI = f"(select f.fid, f.a, f.b, f.c, p.x as x0, p.y as y0, p.z as z0, q.x as x1, q.y as y1, q.z as z1, r.x as x2, r.y as y2, r.z as z2 from {T} f join {V} p on p.vid = f.a join {V} q on q.vid = f.b join {V} r on r.vid = f.c)"
#: Not normalised normals.
NORMALS = f"(select *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) as nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) as ny, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) as nz from {TRI})"


def supplier_mesh(spark, sf) -> mesh.Mesh:
    s = W.table(spark, sf, "supplier")
    v = s.select(F.col("s_suppkey").cast("long").alias("vid"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (F.col("s_suppkey") * 0.5).alias("z"))
    f = W.part_faces(spark, sf)
    for n in "bc":
        f = f.join(s.select(F.col("s_suppkey").alias(n)), n, "left_semi")
    return mesh.Mesh(v, f.select("fid", "a", "b", "c"))


# ---- series ----------------------------------------------------------------------------------------------------------------
@query(f"""
with z as (select id, min(x) as a, max(x) as b from {E} group by id), s as (select e.id, e.x, e.y, lead(e.x) over o as nx, lead(e.y) over o as ny from {E} e window o as (partition by e.id order by e.x))
select z.id, round(z.a + (z.b - z.a) * i / 10, 3) as x, round(case when s.x = q then s.y else s.y + (s.ny - s.y) * (q - s.x) / (s.nx - s.x) end, 4) as y
from (select id, a, b, i, a + (b - a) * i / 10 as q from z, range(0, 10) t(i)) z asof join s on z.id = s.id and z.q >= s.x
""")
def series_tenths(spark, sf):
    out = series.resample(W.event_series(spark, sf), ["id"], n=11).filter("i < 10")
    return out.select("id", F.round("x", 3).alias("x"), F.round("y", 4).alias("y"))


@query(f"""
with s as (select id, x, y, lead(x) over o as nx, lead(y) over o as ny from {E} window o as (partition by id order by x)), c as (
    select id, y + (ny - y) * (1000000.0 - x) / (nx - x) as y from s where x < 1000000.0 and nx > 1000000.0)
select id, 'before' as part, count(*) as n, round(sum(y), 4) as total from (select id, y from {E} where x <= 1000000.0 union all select id, y from c) group by id
union all
select id, 'after', count(*), round(sum(y), 4) from (select id, y from {E} where x >= 1000000.0 union all select id, y from c) group by id
""")
def series_split(spark, sf):
    before, after = series.split_at(W.event_series(spark, sf), ["id"], 1000000.0)
    both = before.withColumn("part", F.lit("before")).unionByName(after.withColumn("part", F.lit("after")))
    return both.groupBy("id", "part").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query(f"select id, count(*) as n, round(sum(d), 4) as total from (select a.id, a.y - b.y as d from {E} a join {E} b on a.id = b.id and a.x = b.x) group by id")
def series_differences(spark, sf):
    s = W.event_series(spark, sf).select("id", "x", "y")
    d = series.combine(s, s, ["id"], -1)
    return d.groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("total"))


@query(f"select id, count(*) as n, min(x) as x0, max(x) as x1, sum(case when isnan(y) or isinf(y) or y is null then 1 else 0 end)::bigint as bad from {E} group by id")
def series_bounds(spark, sf):
    s = series.checked_domain(W.event_series(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("x", "event_id"))), ["id"], "n")
    return s.groupBy("id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count_if(F.isnan("y") | F.col("y").isNull() | (F.abs("y") == float("inf"))).alias("bad"))


@query("select cast(i as bigint) as i, round(-3.0 + i * (8.0 / 400), 9) as x from range(0, 401) t(i)")
def linear_domain(spark, sf):
    return rounded(series.linear_domain(spark, 5.0, -3.0, 401), "x", digits=9)


@query(f"select grp, bool_or(isnan(y)) as has_nan, bool_and(not isnan(y) and not isinf(y)) as finite from {P} group by grp")
def finite_checks(spark, sf):
    return W.line_points(spark, sf).groupBy("grp").agg(stats.has_nan(F.col("y")).alias("has_nan"), stats.all_finite(F.col("y")).alias("finite"))


# ---- curves ----------------------------------------------------------------------------------------------------------------
SEG = f"(select curve, seq, x as x0, y as y0, lead(x) over o as x1, lead(y) over o as y1, lag(x) over o as xp, lag(y) over o as yp from {C} window o as (partition by curve order by seq))"


@query(f"""
with d as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as d from {SEG}), u as (
    select curve, seq, x0, y0, (x1 - x0) / nullif(d, 0) as bx, (y1 - y0) / nullif(d, 0) as by_, lag((x1 - x0) / nullif(d, 0)) over o as ax, lag((y1 - y0) / nullif(d, 0)) over o as ay from d window o as (partition by curve order by seq)
), v as (select *, coalesce(ax, 0) + coalesce(bx, 0) as vx, coalesce(ay, 0) + coalesce(by_, 0) as vy from u)
select curve, seq, round(x0 + vy / nullif(sqrt(vx * vx + vy * vy), 0) * 1.5, 6) as x, round(y0 - vx / nullif(sqrt(vx * vx + vy * vy), 0) * 1.5, 6) as y from v
""")
def curve_offset_vertices(spark, sf):
    return rounded(curves.offset_vertices(W.order_curves(spark, sf), ["curve"], 1.5), "x", "y")


@query(f"""
with d as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as d, sqrt((x0 - xp) ** 2 + (y0 - yp) ** 2) as e from {SEG}), n as (
    select curve, seq, x0, y0, coalesce((y0 - yp) / e, (y1 - y0) / d) as ax, -coalesce((x0 - xp) / e, (x1 - x0) / d) as ay, coalesce((y1 - y0) / d, (y0 - yp) / e) as bx, -coalesce((x1 - x0) / d, (x0 - xp) / e) as by_ from d)
select curve, seq, round(x0 + (ax + bx) * 0.5 / (1 + ax * bx + ay * by_), 3) as x, round(y0 + (ay + by_) * 0.5 / (1 + ax * bx + ay * by_), 3) as y from n where 1 + ax * bx + ay * by_ > 0.01
""")
def curve_offset_segments(spark, sf):
    """Mitres of edges that turn back by more than some 172 degrees are left to the next query's taste: they reach far out."""
    c = W.order_curves(spark, sf)
    moved = curves.offset_segments(c, ["curve"], 0.5)
    turn = curves.offset_segments(c, ["curve"], 0.0)  # the same vertices, not moved
    w = Window.partitionBy("curve").orderBy("seq")
    ux, uy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    vx, vy = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    cosine = F.coalesce((ux * vx + uy * vy) / F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)), F.lit(1.0))
    sharp = turn.withColumn("c", cosine).filter("1 + c > 0.01").select("curve", "seq")
    return rounded(moved.join(sharp, ["curve", "seq"], "left_semi").filter("x is not null"), "x", "y", digits=3)


@query(f"""
with g as (select *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) as d from {SEG}), l as (select *, coalesce(sum(d) over (partition by curve order by seq rows between unbounded preceding and 1 preceding), 0) as l0 from g), own as (
    select curve, l0 as length, x0 as x, y0 as y from l where l0 > 10.0 and l0 < 40.0), ends as (
    select curve, q as length, x0 + (x1 - x0) * (q - l0) / d as x, y0 + (y1 - y0) * (q - l0) / d as y from l, (values (10.0), (40.0)) t(q) where d > 0 and q >= l0 and q < l0 + d)
select curve, count(*) as n, round(sum(x), 4) as sx, round(sum(y), 4) as sy, round(max(length), 4) as l1 from (select * from own union all select * from ends) group by curve
""")
def curve_between_lengths(spark, sf):
    part = curves.between_lengths(W.order_curves(spark, sf), ["curve"], 10.0, 40.0)
    return part.groupBy("curve").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"), F.round(F.max("length"), 4).alias("l1"))


@query(f"select curve, round(max(x * 0.6 + y * 0.8), 9) as far from {C} group by curve")
def curve_extremes(spark, sf):
    return W.order_curves(spark, sf).groupBy("curve").agg(F.round(curves.max_along((F.col("x"), F.col("y")), (F.lit(0.6), F.lit(0.8))), 9).alias("far"))


@query(f"""
with s as (select curve, x0, y0, x1, y1, 0.3 * (y1 - y0) - 1.0 * (x1 - x0) as turn from {SEG} where x1 is not null), h as (
    select distinct curve, round(((x0 - 15.0) * (y1 - y0) - (y0 - 0.0) * (x1 - x0)) / turn, 9) as t from s where abs(turn) > 1e-12 and ((x0 - 15.0) * 1.0 - (y0 - 0.0) * 0.3) / turn between 0 and 1)
select curve, round(min(t), 6) as t0, round(max(t), 6) as t1 from h group by curve having count(*) = 2
""")
def curve_spanning_rays(spark, sf):
    return rounded(curves.spanning_rays(W.order_curves(spark, sf), ["curve"], (15.0, 0.0), (0.3, 1.0)), "t0", "t1")


# ---- meshes ----------------------------------------------------------------------------------------------------------------
@query(f"""
with n as (select unnest([a, b, c]) as vid, nx, ny, nz from {NORMALS}), s as (select vid, sum(nx) as nx, sum(ny) as ny, sum(nz) as nz from n group by vid)
select v.vid, round(coalesce(nx / sqrt(nx * nx + ny * ny + nz * nz), 0), 6) as nx, round(coalesce(ny / sqrt(nx * nx + ny * ny + nz * nz), 0), 6) as ny, round(coalesce(nz / sqrt(nx * nx + ny * ny + nz * nz), 0), 6) as nz from {V} v left join s using (vid)
""")
def mesh_vertex_normals(spark, sf):
    return rounded(supplier_mesh(spark, sf).vertex_normals(), "nx", "ny", "nz")


@query(f"""
with n as (select unnest([a, b, c]) as vid, nx, ny, nz from {NORMALS}), s as (select vid, sum(nx) as nx, sum(ny) as ny, sum(nz) as nz from n group by vid)
select v.vid, round(x + 2.0 * coalesce(nx / sqrt(nx * nx + ny * ny + nz * nz), 0), 6) as x, round(z + 2.0 * coalesce(nz / sqrt(nx * nx + ny * ny + nz * nz), 0), 6) as z from {V} v left join s using (vid)
""")
def mesh_offset(spark, sf):
    return rounded(supplier_mesh(spark, sf).offset(2.0).vertices.select("vid", "x", "z"), "x", "z")


@query(f"select round(min(x), 6) as x_min, round(max(x), 6) as x_max, round(min(y), 6) as y_min, round(max(y), 6) as y_max, round(min(z), 6) as z_min, round(max(z), 6) as z_max from (select x * 2.5 as x, y * 2.5 as y, z * 2.5 as z from {V})")
def mesh_bounds(spark, sf):
    box = supplier_mesh(spark, sf).scaled(2.5).aabb()
    return rounded(box, *box.columns)


@query(f"select vid, round(0.8 * x - 0.6 * y + 10.0, 6) as x, round(0.6 * x + 0.8 * y - 5.0, 6) as y, round(z + 2.5, 6) as z from {V}")
def mesh_transformed(spark, sf):
    moved = supplier_mesh(spark, sf).transformed(((0.8, -0.6, 0.0, 10.0), (0.6, 0.8, 0.0, -5.0), (0.0, 0.0, 1.0, 2.5)))
    return rounded(moved.vertices, "x", "y", "z")


@query(f"select fid from {NORMALS} where acos(greatest(least(nx / sqrt(nx * nx + ny * ny + nz * nz), 1.0), -1.0)) < 1.2 and nx * nx + ny * ny + nz * nz > 0")
def mesh_facing(spark, sf):
    return supplier_mesh(spark, sf).facing((1.0, 0.0, 0.0), 1.2)


@query(f"select fid from {TRI} where 0.6 * x0 + 0.8 * z0 >= 40 and 0.6 * x1 + 0.8 * z1 >= 40 and 0.6 * x2 + 0.8 * z2 >= 40")
def mesh_above_plane(spark, sf):
    return supplier_mesh(spark, sf).above_plane((0.6, 0.0, 0.8), 40.0)


@query(f"select fid from {TRI} where least((x0 - 50) ** 2 + (y0 - 12) ** 2 + (z0 - 20) ** 2, (x1 - 50) ** 2 + (y1 - 12) ** 2 + (z1 - 20) ** 2, (x2 - 50) ** 2 + (y2 - 12) ** 2 + (z2 - 20) ** 2) <= 900")
def mesh_near_point(spark, sf):
    return supplier_mesh(spark, sf).near_point((50.0, 12.0, 20.0), 30.0, all_vertices=False)


@query(f"""
with f as (select * from {T} where fid % 3 = 0), v as (select vid, row_number() over (order by vid) - 1 as n from (select distinct unnest([a, b, c]) as vid from f))
select cast(row_number() over (order by fid) - 1 as bigint) as fid, cast(p.n as bigint) as a, cast(q.n as bigint) as b, cast(r.n as bigint) as c from f join v p on p.vid = f.a join v q on q.vid = f.b join v r on r.vid = f.c
""")
def mesh_submesh(spark, sf):
    m = supplier_mesh(spark, sf)
    return m.submesh(m.faces.filter("fid % 3 = 0").select("fid")).faces


@query(f"""
with v as (select vid, floor(x / 20) as x, floor(y / 5) as y, 0.0 as z from {V}), h as (select *, min(vid) over (partition by x, y) as head from v)
select f.fid, p.head as a, q.head as b, r.head as c from {T} f join h p on p.vid = f.a join h q on q.vid = f.b join h r on r.vid = f.c where p.head <> q.head and q.head <> r.head and p.head <> r.head
""")
def mesh_merged_duplicates(spark, sf):
    m = supplier_mesh(spark, sf)
    coarse = m.vertices.select("vid", F.floor(F.col("x") / 20).cast("double").alias("x"), F.floor(F.col("y") / 5).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return mesh.Mesh(coarse, m.faces).merged_duplicates().faces


@query(f"select f.fid from {NORMALS} f where sqrt(nx * nx + ny * ny + nz * nz) / 2 > 60")
def mesh_without_small_faces(spark, sf):
    return supplier_mesh(spark, sf).without_degenerate(60.0).faces.select("fid")


@query(f"select count(*) as n, sum(a)::bigint as a, sum(b)::bigint as b, max(fid) as fid from (select fid, a, b from {T} union all select fid + (select max(fid) + 1 from {T}), a + (select max(vid) + 1 from {V}), b + (select max(vid) + 1 from {V}) from {T})")
def mesh_append(spark, sf):
    m = supplier_mesh(spark, sf)
    return m.append(m.scaled(2.0)).faces.agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("fid").alias("fid"))


@query(f"""
with s as (select fid, x0 * 0.6 + z0 * 0.8 - 40 as s0, x1 * 0.6 + z1 * 0.8 - 40 as s1, x2 * 0.6 + z2 * 0.8 - 40 as s2, x0, x1, x2, y0, y1, y2 from {TRI}), e as (
    select fid, x0 + (x1 - x0) * s0 / (s0 - s1) as x, y0 + (y1 - y0) * s0 / (s0 - s1) as y from s where (s0 >= 0) <> (s1 >= 0)
    union all select fid, x1 + (x2 - x1) * s1 / (s1 - s2), y1 + (y2 - y1) * s1 / (s1 - s2) from s where (s1 >= 0) <> (s2 >= 0)
    union all select fid, x2 + (x0 - x2) * s2 / (s2 - s0), y2 + (y0 - y2) * s2 / (s2 - s0) from s where (s2 >= 0) <> (s0 >= 0))
select fid, round(min(x), 6) as x_min, round(max(x), 6) as x_max, round(min(y), 6) as y_min, round(max(y), 6) as y_max from e group by fid
""")
def mesh_section_segments(spark, sf):
    s = supplier_mesh(spark, sf).section_segments((0.6, 0.0, 0.8), 40.0)
    return s.select("fid", *(F.round(f(f"{c}0", f"{c}1"), 6).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.least, "min"), (F.greatest, "max"))))


@query(f"""
with v as (select vid, x, y, z, x * 0.6 + z * 0.8 - 40 as s from {V}), t as (select f.fid, p.s as s0, q.s as s1, r.s as s2, (q.x - p.x) as ux, (q.y - p.y) as uy, (q.z - p.z) as uz, (r.x - p.x) as vx, (r.y - p.y) as vy, (r.z - p.z) as vz from {T} f join v p on p.vid = f.a join v q on q.vid = f.b join v r on r.vid = f.c),
a as (select *, sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2 as area, (s0 > 0)::int + (s1 > 0)::int + (s2 > 0)::int as up from t),
k as (select *, case when up = 3 then 1.0 when up = 0 then 0.0 when up = 1 then case when s0 > 0 then s0 * s0 / ((s0 - s1) * (s0 - s2)) when s1 > 0 then s1 * s1 / ((s1 - s0) * (s1 - s2)) else s2 * s2 / ((s2 - s0) * (s2 - s1)) end
    else 1 - case when s0 <= 0 then s0 * s0 / ((s0 - s1) * (s0 - s2)) when s1 <= 0 then s1 * s1 / ((s1 - s0) * (s1 - s2)) else s2 * s2 / ((s2 - s0) * (s2 - s1)) end end as share from a)
select round(sum(area * share), 4) as above, round(sum(area * (1 - share)), 4) as below from k
""")
def mesh_split_areas(spark, sf):
    above, below = supplier_mesh(spark, sf).split((0.6, 0.0, 0.8), 40.0)
    area = lambda m, n: m.face_geometry().agg(F.round(F.sum("area"), 4).alias(n))
    return area(above, "above").join(area(below, "below"))


@query(f"""
with e as (select unnest([a, b, c]) as u, unnest([b, c, a]) as w from {T}), n as (select least(u, w) as lo, greatest(u, w) as hi, count(*) as n from e group by all)
select distinct unnest([lo, hi]) as vid from n where n = 1
""")
def mesh_boundary_vertices(spark, sf):
    return graph.boundary_vertices(supplier_mesh(spark, sf).faces).select("vid")


@query(f"""
with recursive e as (select least(u, w) as lo, greatest(u, w) as hi, fid from (select fid, unnest([a, b, c]) as u, unnest([b, c, a]) as w from {T})), l as (
    select distinct p.fid as f, q.fid as g from e p join e q using (lo, hi)), r as (
    select fid, fid as root from {T} union select l.g, r.root from r join l on l.f = r.fid where l.g > r.root)
select fid, min(root) as patch from r group by fid
""")
def mesh_patches(spark, sf):
    return graph.patches(supplier_mesh(spark, sf).faces).select("fid", "patch")


@query("select round(pi() * 4.0 * 6.0 * (sin(pi() / 96) / (pi() / 96)), 3) as side, cast(96 * 2 as bigint) as cap_faces")
def mesh_cylinder_area(spark, sf):
    """The side of a cylinder of 96 flat panels and the number of triangles of its caps."""
    g = mesh.cylinder(spark, 2.0, 6.0, 96).face_geometry()
    flat = F.abs(F.col("nz")) > 0.5
    return g.agg(F.round(F.sum(F.when(~flat, F.col("area"))), 3).alias("side"), F.count_if(flat).alias("cap_faces"))


# ---- masks and clouds ------------------------------------------------------------------------------------------------------
@query(f"select key, x, y, z from {P} where key in (select key from {P} where z >= 5 and x < 20)")
def cloud_by_mask(spark, sf):
    p = W.line_points(spark, sf).select("key", "x", "y", "z")
    return masks.gather(p, p.filter("z >= 5 and x < 20").select("key"), "key")


@query("select cast(n as bigint) as position, p_partkey as key, p_size as size from (select row_number() over (order by p_size, p_partkey desc) as n, p_partkey, p_size from part) where n <= 500")
def rows_by_index_list(spark, sf):
    part = W.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    wanted = part.withColumn("position", F.row_number().over(Window.orderBy("size", F.desc("key"))).cast("long")).filter("position <= 500").select("position", "key")
    return masks.gather_ordered(part, wanted, "key").select("position", "key", "size")


@query(f"select (z >= 5) as high, count(*) as n, round(sum(0.8 * x - 0.6 * y + 10.0), 4) as sx, round(sum(z + 2.5), 4) as sz from {P} group by all")
def cloud_transformed(spark, sf):
    p = W.line_points(spark, sf).select(F.xxhash64("key").alias("idx"), "x", "y", "z")
    high, low = (clouds.PointCloud.of(p.filter(c)) for c in ("z >= 5", "z < 5"))
    moved = lambda c: c.transformed(((0.8, -0.6, 0.0, 10.0), (0.6, 0.8, 0.0, -5.0), (0.0, 0.0, 1.0, 2.5))).rows.agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("z"), 4).alias("sz"))
    return moved(high).withColumn("high", F.lit(True)).unionByName(moved(low).withColumn("high", F.lit(False)))


# ---- rasters ---------------------------------------------------------------------------------------------------------------
@query(f"select row, col from {R} r where (row - 40.5) ** 2 + (col - 20.0) ** 2 <= 64.0")
def raster_disk_mask(spark, sf):
    r = W.price_raster(spark, sf).select("row", "col")
    return r.join(raster.disk(spark, 40.5, 20.0, 8.0), ["row", "col"], "left_semi")


@query(f"select count(*) as n, round(sum(v), 4) as total from {R} where not (row between 10 and 29 and col between 5 and 14)")
def raster_blanked(spark, sf):
    r = raster.blank(W.price_raster(spark, sf).select("row", "col", "v"), raster.rectangle(spark, 10, 5, 20, 10), ())
    return r.agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(f"select row, col from {R} r where exists (select 1 from (values (-1, 0), (1, 0), (0, -1), (0, 1)) o(i, j) where not exists (select 1 from {R} n where n.row = r.row + o.i and n.col = r.col + o.j))")
def raster_border(spark, sf):
    return raster.border_of(W.price_raster(spark, sf).select("row", "col"), ()).select("row", "col")


@query(f"select row, col, round(v, 6) as v from {R} where row between 1 and 88 and col between 1 and 48")
def raster_without_border(spark, sf):
    return rounded(raster.clear_border(W.price_raster(spark, sf).select("row", "col", "v"), 90, 50).select("row", "col", "v"), "v")


@query(f"""
with recursive f as (select row, col from (values (45, 25)) t(row, col) union
    select n.row, n.col from f, (values (-1, 0), (1, 0), (0, -1), (0, 1)) o(i, j), lateral (select f.row + o.i as row, f.col + o.j as col) n join {R} r on r.row = n.row and r.col = n.col where r.n >= 8)
select count(*) as n, min(row)::bigint as low, max(row)::bigint as high, sum(col)::bigint as cols from f
""")
def raster_flooded(spark, sf):
    dense = W.price_raster(spark, sf).filter((F.col("n") >= 8) | ((F.col("row") == 45) & (F.col("col") == 25))).select("row", "col")
    walls = raster.rectangle(spark, 0, 0, 120, 60).join(dense, ["row", "col"], "left_anti")
    seed = spark.createDataFrame([(45, 25)], "row long, col long")
    return raster.flood_fill(walls, 120, 60, seed).agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high"), F.sum("col").alias("cols"))


# ---- files -----------------------------------------------------------------------------------------------------------------
@query(f"select count(*) as n, round(sum(cast(cast(x as float) as double)), 3) as sx, round(sum(cast(cast(y as float) as double)), 3) as sy, round(max(cast(cast(y as float) as double)), 9) as y_max from {P}")
def bxyz_round_trip(spark, sf):
    """All points written to bxyz files, one for each task, and read back in byte ranges."""
    from ..sources import files

    files.register(spark)
    path = folder(spark, "bxyz")
    W.line_points(spark, sf).select("x", "y", "z").write.format("bxyz").mode("append").save(path)
    back = spark.read.format("bxyz").load(path)
    return back.agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"), F.round(F.max("y"), 9).alias("y_max"))


@query(f"select x, y, z, count(*) as n from {P} group by all")
def xyz_round_trip(spark, sf):
    from ..sources import files

    path = folder(spark, "xyz")
    files.save_xyz(W.line_points(spark, sf).select(F.col("x").cast("double").alias("x"), "y", "z"), path)
    part = F.split("value", " ")
    return spark.read.text(path).select(*(part[k].cast("double").alias(n) for k, n in enumerate("xyz"))).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


@query(f"select fid, round(cast(cast(x0 as float) as double), 6) as x0, round(cast(cast(y1 as float) as double), 6) as y1, round(cast(cast(z2 as float) as double), 6) as z2 from (select row_number() over (order by fid) - 1 as fid, * exclude (fid) from {TRI})")
def stl_round_trip(spark, sf):
    """The supplier mesh as one stl file and back."""
    from ..sources import files

    files.register(spark)
    path = folder(spark, "stl")
    supplier_mesh(spark, sf).corners().orderBy("fid").select(*(f"{c}{k}" for k in range(3) for c in "xyz")).coalesce(1).write.format("stl").mode("append").save(path)
    return rounded(files.load(spark, "stl", path).select("fid", "x0", "y1", "z2"), "x0", "y1", "z2")


@query(f"""
with b as (select min(x) as x0, max(x) as x1, min(z) as z0, max(z) as z1 from {V})
select cast(row_number() over (order by vid) - 1 as bigint) as vid, round(round((x - x0) / (x1 - x0) * 65535) / 65535 * (x1 - x0) + x0, 5) as x, round(round((z - z0) / (z1 - z0) * 65535) / 65535 * (z1 - z0) + z0, 5) as z from {V}, b
""")
def umesh_round_trip(spark, sf):
    """The supplier mesh with 16 bits a coordinate: written, gzipped, and read back."""
    from ..sources import files

    path = folder(spark, "umesh")
    files.save_content(files.mesh_bytes(supplier_mesh(spark, sf), "umesh", compress=True), path, "mesh.umesh.gz")
    m = files.load_mesh(spark, "umesh", path)
    return rounded(m.vertices.select("vid", "x", "z"), "x", "z", digits=5)


@query(f"select cast(row_number() over (order by fid) - 1 as bigint) as fid, cast(a - (select min(vid) from {V}) as bigint) as a, cast(b - (select min(vid) from {V}) as bigint) as b from {T}")
def ply_round_trip(spark, sf):
    from ..sources import files

    path = folder(spark, "ply")
    files.save_content(files.mesh_bytes(supplier_mesh(spark, sf), "ply"), path, "mesh.ply")
    return files.load_mesh(spark, "ply", path).faces.select("fid", "a", "b")


@query(f"select row, col, cast(floor(least(greatest(v / 10.0, 0.0), 1.0) * 65535) as integer) as u from {R} where row >= 0")
def raster_round_trip(spark, sf):
    """The price raster as a container of 16-bit heights and a mask, and back."""
    from ..sources import files

    path = folder(spark, "raster")
    r = W.price_raster(spark, sf).filter("row >= 0").select("row", "col", "v")
    files.save_content(files.raster_bytes(r, 1.0, 0.0, 10.0), path, "prices.raster")
    return files.load(spark, "raster", path).select("row", "col", "u")


@query("select s_suppkey as k, s_name as name, s_acctbal as v from supplier")
def json_round_trip(spark, sf):
    from ..sources import files

    path = folder(spark, "json")
    files.save_json(W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("v")), path)
    objects = F.concat(F.lit("["), F.regexp_replace(F.trim(F.regexp_replace("value", r"\s+$", "")), r"\}\s*\{", "},{"), F.lit("]"))
    return spark.read.text(path, wholetext=True).select(F.inline(F.from_json(objects, "array<struct<k:long,name:string,v:double>>")))


# ---- streams ---------------------------------------------------------------------------------------------------------------
def _timed(events):
    """ts as a point in time, whatever the session's time zone."""
    return events.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")))


@query("select cast(epoch_us(time_bucket(interval 1 day, ts)) // 1000000 as bigint) as day, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from events group by all")
def streamed_days(spark, sf):
    """Daily means of the events, read as a stream; it runs until all is read."""
    from ..streaming import incremental

    days = lambda stream: incremental.windowed_average(_timed(stream), "ts", "value", [], "1 day", late="400 days")
    out = incremental.replayed(spark, f"{sf}/events.parquet", folder(spark, "streamed"), days)
    return out.select(F.unix_seconds("start").alias("day"), "n", F.round("mean", 6).alias("mean"), "low", "high")


@query("""
with e as (select user_id, epoch_us(ts) as t, value, lag(epoch_us(ts)) over (partition by user_id order by ts) as before from events), r as (select *, sum(case when before is null or t - before >= 21600000000 then 1 else 0 end) over (partition by user_id order by t) as run from e)
select user_id, count(*) as n, round(2 * max(abs(value)), 6) as zone, min(t) // 1000000 as first from r group by user_id, run
""")
def streamed_runs(spark, sf):
    """Runs of events less than six hours apart, as sessions of a stream."""
    from ..streaming import incremental

    out = incremental.replayed(spark, f"{sf}/events.parquet", folder(spark, "streamed"), lambda s: incremental.runs(_timed(s), "ts", ["user_id"], "6 hours", late="400 days"))
    return out.select("user_id", "n", F.round("zone", 6).alias("zone"), F.unix_seconds("start").alias("first"))
