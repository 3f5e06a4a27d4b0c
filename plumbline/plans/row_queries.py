"""Row-wise geometry on the driver's tables: vectors, surface points, angles, lines, circles, planes and spheres, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import shapes as S
from ..functions import vectors as V
from ..operators import masks
from . import views as W
from .queries import P, query, rounded

TAU = "6.283185307179586"


def _wrap(a: str) -> str:
    return f"({a} - {TAU} * floor(({a}) / {TAU}))"


def points(spark, sf):
    return W.line_points(spark, sf)


def named(df, digits: int, **columns):
    return df.select("key", *(F.round(c, digits).alias(n) for n, c in columns.items()))


# ---- vectors and surface points ------------------------------------------------------------------------------------------
@query(f"select key, round((x + 10.0) / 2, 6) as mx, round((y + 20.0) / 2, 8) as my, round((z - 4.0) / 2, 6) as mz, round(x + (10.0 - x) * 0.3, 6) as qx, round(y + (20.0 - y) * 0.3, 6) as qy from {P}")
def mid_points(spark, sf):
    p, q = V.vec("x", "y", "z"), V.vec(10.0, 20.0, -4.0)
    m, t = V.mid_point(p, q), V.lerp(p, q, F.lit(0.3))
    return points(spark, sf).select("key", *(F.round(c, n).alias(k) for k, c, n in (("mx", m[0], 6), ("my", m[1], 8), ("mz", m[2], 6), ("qx", t[0], 6), ("qy", t[1], 6))))


@query(f"select key, round(y * 2.0 - z * -1.0, 6) as cx, round(z * 3.0 - x * 2.0, 6) as cy, round(x * -1.0 - y * 3.0, 6) as cz, round(x / nullif(sqrt(x * x + y * y + z * z), 0), 9) as ux, round(sqrt(x * x + y * y + z * z), 9) as size from {P}")
def cross_products(spark, sf):
    p = V.vec("x", "y", "z")
    c, u = V.cross(p, V.vec(3.0, -1.0, 2.0)), V.unit(p)
    return named(points(spark, sf), 6, cx=c[0], cy=c[1], cz=c[2]).join(named(points(spark, sf), 9, ux=u[0], size=V.norm(p)), "key")


@query(f"""
select key, round(s, 6) as along, round(sqrt((x - 5.0 - 0.6 * s) ** 2 + (y - 1.0) ** 2 + (z - 2.0 - 0.8 * s) ** 2), 6) as beside, round(5.0 + 0.6 * s, 6) as px, round(2.0 + 0.8 * s, 6) as pz
from (select key, x, y, z, (x - 5.0) * 0.6 + (z - 2.0) * 0.8 as s from {P})
""")
def surface_point_distances(spark, sf):
    p, n, q = V.vec(5.0, 1.0, 2.0), V.vec(0.6, 0.0, 0.8), V.vec("x", "y", "z")
    on = V.project_to_normal_line(p, n, q)
    return named(points(spark, sf), 6, along=V.scalar_projection(p, n, q), beside=V.planar_distance(p, n, q), px=on[0], pz=on[2])


@query(f"select key, round(x + 0.6 * 2.5, 6) as ax, round(y + 0.8 * 2.5, 6) as ay, round(x + 0.8 * 1.5, 6) as sx, round(y - 0.6 * 1.5, 6) as sy, round(x * cos(0.5) - y * sin(0.5), 6) as rx, round(x * sin(0.5) + y * cos(0.5), 6) as ry from {P}")
def surface_points_moved(spark, sf):
    p, n = V.vec("x", "y"), V.vec(0.6, 0.8)
    a, s, r = V.at_distance(p, n, 2.5), V.shift_orthogonal(p, n, 1.5), V.rotate2(p, 0.5)
    return named(points(spark, sf), 6, ax=a[0], ay=a[1], sx=s[0], sy=s[1], rx=r[0], ry=r[1])


@query(f"select key, round(-y, 6) as lx, x as ly, y as rx, round(-x, 6) as ry from {P}")
def quarter_turns(spark, sf):
    left, right = V.rot90(V.vec("x", "y")), V.rot270(V.vec("x", "y"))
    return named(points(spark, sf), 6, lx=left[0], rx=right[0]).join(points(spark, sf).select("key", left[1].alias("ly"), F.round(right[1], 6).alias("ry")), "key")


@query(f"select key, round(0.6 * (x - 5.0) + 0.8 * (y - 10.0), 6) as along, round(sqrt((x - 5.0) ** 2 + (y - 10.0) ** 2), 6) as whole from {P}")
def directed_distances(spark, sf):
    a, b = V.vec(5.0, 10.0), V.vec("x", "y")
    return named(points(spark, sf), 6, along=V.directed_distance(a, b, V.vec(0.6, 0.8)), whole=V.directed_distance(a, b))


@query(f"select key, round(x + 0.6 * z / 100, 9) as ax, round(y, 9) as ay, round(2.0 + 0.8 * z / 100, 9) as az from {P}")
def actual_points(spark, sf):
    a = V.actual_point(V.vec("x", "y", 2.0), V.vec(0.6, 0.0, 0.8), F.col("z") / 100)
    return named(points(spark, sf), 9, ax=a[0], ay=a[1], az=a[2])


@query(f"""
with a as (select key, radians(x) as w, radians(y / 2) as p, radians(z * 10) as r from {P})
select key, round(cos(r) * cos(p), 9) as m00, round(cos(r) * sin(p) * sin(w) - sin(r) * cos(w), 9) as m01, round(sin(r) * sin(p) * cos(w) - cos(r) * sin(w), 9) as m12, round(-sin(p), 9) as m20, round(cos(p) * sin(w), 9) as m21 from a
""")
def euler_matrices(spark, sf):
    m = V.euler_to_matrix(F.col("x"), F.col("y") / 2, F.col("z") * 10)
    return named(points(spark, sf), 9, m00=m[0][0], m01=m[0][1], m12=m[1][2], m20=m[2][0], m21=m[2][1])


@query(f"select key, round(x - 25.0, 8) as w, round(y / 2 - 20.0, 8) as p, round(z * 10, 8) as r from {P} where abs(y / 2 - 20.0) < 89")
def euler_round_trip(spark, sf):
    w, p, r = F.col("x") - 25.0, F.col("y") / 2 - 20.0, F.col("z") * 10
    back = V.matrix_to_euler(V.euler_to_matrix(w, p, r))
    return named(points(spark, sf).filter(F.abs(p) < 89), 8, w=back[0], p=back[1], r=back[2])


@query(f"select key, round((x - 25.0) / 500.0 / l, 9) as dx, round((y - 50.0) / 400.0 / l, 9) as dy, round(1.0 / l, 9) as dz from (select *, sqrt(((x - 25.0) / 500.0) ** 2 + ((y - 50.0) / 400.0) ** 2 + 1) as l from {P})")
def back_projected_rays(spark, sf):
    d = V.back_project(V.vec("x", "y"), 500.0, 400.0, 25.0, 50.0)
    return named(points(spark, sf), 9, dx=d[0], dy=d[1], dz=d[2])


@query(f"select key, round((z + 30.0) * cos(x / 30.0), 6) as cx, round((z + 30.0) * sin(x / 30.0), 6) as cy, y as cz from {P}")
def rolled_cylinder(spark, sf):
    p = V.roll(V.vec("x", "y", "z"), 30.0)
    return named(points(spark, sf), 6, cx=p[0], cy=p[1]).join(points(spark, sf).select("key", p[2].alias("cz")), "key")


# ---- angles, intervals, tolerances, weights ------------------------------------------------------------------------------
@query(f"""
with a as (select key, x / 5.0 as a, y / 20.0 as b from {P})
select key, round({_wrap("(b - a) * -1")}, 9) as clockwise, round({_wrap("b - a")}, 9) as counter, round({_wrap(f"(b - a) + {math.pi!r}")} - {math.pi!r}, 9) as shortest, case when a - 5 > 0 then round(a - 5 - {TAU}, 9) when a - 5 < 0 then round(a - 5 + {TAU}, 9) else 0.0 end as other_way, case when a - 5 < 0 then -1 else 1 end as sign from a
""")
def angle_directions(spark, sf):
    a, b = F.col("x") / 5.0, F.col("y") / 20.0
    df = points(spark, sf)
    return df.select("key", F.round(A.in_direction(a, b, -1), 9).alias("clockwise"), F.round(A.in_direction(a, b, 1), 9).alias("counter"), F.round(A.shortest(a, b), 9).alias("shortest"), F.round(A.signed_complement(a - 5), 9).alias("other_way"), A.direction_sign(a - 5).alias("sign"))


def _on_arc(start: str, extent: str, a: str) -> str:
    return f"({_wrap(f'({a}) - ({start})')} <= {extent} + 1e-12 or {_wrap(f'({a}) - ({start})')} >= {TAU} - 1e-12)"


@query(f"""
with a as (select key, x / 8.0 as a, y / 30.0 as e, z as b from {P})
select key, {_on_arc("a", "e", "b")} as holds, ({_on_arc("a", "e", "1.0")} or {_on_arc("1.0", "0.5", "a")}) as meets, round({_wrap("a + e * 0.25")}, 9) as quarter from a
""")
def angle_intervals(spark, sf):
    a, e, b = F.col("x") / 8.0, F.col("y") / 30.0, F.col("z")
    return points(spark, sf).select("key", A.arc_contains(a, e, b).alias("holds"), A.arcs_intersect(a, e, F.lit(1.0), F.lit(0.5)).alias("meets"), F.round(A.arc_at(a, e, F.lit(0.25)), 9).alias("quarter"))


@query(f"select key, y < 40.0 as close, case when y - 30.0 < 12.0 then 1.0 else 0.0 end as w, case when x * 0.6 - y * 0.8 > 0 then 1.0 else 0.0 end as facing, abs(y - 35.0) <= z / 2 + 1.0 as conforms from {P}")
def alignment_weights(spark, sf):
    df = points(spark, sf)
    tolerance = A.symmetrical(F.col("z") + 2.0, 35.0)
    return df.select("key", (A.distance_weight(F.col("y"), 40.0) == 1.0).alias("close"), A.distance_weight(F.col("y") - 30.0, 12.0).alias("w"), A.normal_weight(V.vec("x", "y"), V.vec(0.6, -0.8)).alias("facing"), A.conforms(tolerance, F.col("y")).alias("conforms"))


@query(f"select key, round((y - 12.5) * 3.0, 6) as mapped, round(y / 3.0 + 12.5, 6) as unmapped, round(floor(least(greatest((y - 10.0) / 80.0, 0.0), 1.0) * 65535) / 65535.0 * 80.0 + 10.0, 6) as height from {P}")
def domain_maps(spark, sf):
    y = F.col("y")
    return named(points(spark, sf), 6, mapped=A.domain_map(y, 12.5, 3.0), unmapped=A.domain_unmap(y, 12.5, 3.0), height=A.dequantise(A.quantise(y, 10.0, 90.0), 10.0, 90.0))


@query(f"select key, round(0.02 / cos(atan2(100.0 - y, 60.0)) ** 2, 9) as sigma from {P}")
def scan_uncertainty(spark, sf):
    return named(points(spark, sf), 9, sigma=A.scan_uncertainty(F.col("y"), 100.0, 60.0, 0.02))


# ---- lines and circles in the plane --------------------------------------------------------------------------------------
@query(f"""
with t as (select key, x, y, x * 1.0 - y * 2.0 as turn from {P})
select key, case when abs(turn) > 1e-12 then round(((10.0 - 0.0) * 1.0 - (5.0 - 0.0) * 2.0) / turn, 6) end as t, case when abs(turn) > 1e-12 then round((10.0 * y - 5.0 * x) / turn, 6) end as u from t
""")
def line_parameters(spark, sf):
    t, u = S.line_params(V.vec(0.0, 0.0), V.vec("x", "y"), V.vec(10.0, 5.0), V.vec(2.0, 1.0))
    return named(points(spark, sf), 6, t=t, u=u)


@query(f"select key, round(t * 4.0, 6) as px, round(t * 3.0, 6) as py, round(t, 9) as t, round(x - 0.6 * 2.0, 6) as ox, round(y + 0.8 * 2.0, 6) as oy from (select key, x, y, (x * 4.0 + y * 3.0) / 25.0 as t from {P})")
def line_projections(spark, sf):
    q, d = V.vec("x", "y"), V.vec(4.0, 3.0)
    p = S.projected_point(V.vec(0.0, 0.0), d, q)
    a, _ = S.segment_offset(q, V.add(q, d), 2.0)
    return named(points(spark, sf), 6, px=p[0], py=p[1], ox=a[0], oy=a[1]).join(named(points(spark, sf), 9, t=S.projected_parameter(V.vec(0.0, 0.0), d, q)), "key")


@query(f"""
with d as (select key, x, y, 2 * (40.0 * y - 10.0 * x) as turn, 40.0 ** 2 + 10.0 ** 2 as b2, x * x + y * y as c2 from {P})
select key, round((y * b2 - 10.0 * c2) / turn, 8) as cx, round((40.0 * c2 - x * b2) / turn, 8) as cy, round(sqrt(((y * b2 - 10.0 * c2) / turn) ** 2 + ((40.0 * c2 - x * b2) / turn) ** 2), 8) as r from d where abs(turn) > 100.0
""")
def circles_through_points(spark, sf):
    c, r = S.circle_from_3_points(V.vec(0.0, 0.0), V.vec(40.0, 10.0), V.vec("x", "y"))
    return named(points(spark, sf).filter(F.abs(F.col("y") * 40.0 - F.col("x") * 10.0) > 50.0), 8, cx=c[0], cy=c[1], r=r)


@query(f"""
with d as (select key, x, y, sqrt((x - 25.0) ** 2 + (y - 30.0) ** 2) as d from {P})
select key, round(25.0 + (x - 25.0) / nullif(d, 0) * 12.0, 6) as px, round(30.0 + (y - 30.0) / nullif(d, 0) * 12.0, 6) as py, round(25.0 + 12.0 * cos(x), 6) as ax, round(30.0 + 12.0 * sin(x), 6) as ay from d
""")
def circle_projections(spark, sf):
    c, r = V.vec(25.0, 30.0), F.lit(12.0)
    p, a = S.circle_project(c, r, V.vec("x", "y")), S.circle_at(c, r, F.col("x"))
    return named(points(spark, sf), 6, px=p[0], py=p[1], ax=a[0], ay=a[1])


@query(f"""
with d as (select key, (x - 25.0) as vx, (y - 30.0) as vy, (x - 25.0) ** 2 + (y - 30.0) ** 2 as d2 from {P})
select key, round(25.0 + vx * 144.0 / d2 - vy * 12.0 * sqrt(d2 - 144.0) / d2, 6) as ax, round(30.0 + vy * 144.0 / d2 + vx * 12.0 * sqrt(d2 - 144.0) / d2, 6) as ay,
    round(25.0 + vx * 144.0 / d2 + vy * 12.0 * sqrt(d2 - 144.0) / d2, 6) as bx, round(30.0 + vy * 144.0 / d2 - vx * 12.0 * sqrt(d2 - 144.0) / d2, 6) as by_ from d where d2 > 145.0
""")
def tangents_from_points(spark, sf):
    c = V.vec(25.0, 30.0)
    a, b = S.tangent_points(c, F.lit(12.0), V.vec("x", "y"))
    return named(points(spark, sf).filter(V.dist2(c, V.vec("x", "y")) > 145.0), 6, ax=a[0], ay=a[1], bx=b[0], by_=b[1])


@query(f"""
with d as (select key, x, y, sqrt((x + 20.0) ** 2 + (y + 5.0) ** 2) as d from {P}), u as (select *, (x + 20.0) / d as ux, (y + 5.0) / d as uy, (8.0 - 3.0) / d as k from d), n as (
    select key, x, y, ux * k - uy * sqrt(1 - k * k) as nx, uy * k + ux * sqrt(1 - k * k) as ny from u)
select key, round(-20.0 + nx * 8.0, 6) as ax, round(-5.0 + ny * 8.0, 6) as ay, round(x + nx * 3.0, 6) as bx, round(y + ny * 3.0, 6) as by_ from n
""")
def belt_tangents(spark, sf):
    (a, b), _ = S.outer_tangents(V.vec(-20.0, -5.0), F.lit(8.0), V.vec("x", "y"), F.lit(3.0))
    return named(points(spark, sf), 6, ax=a[0], ay=a[1], bx=b[0], by_=b[1])


@query(f"""
with u as (select key, x / sqrt(x * x + y * y) as ux, y / sqrt(x * x + y * y) as uy from {P}), h as (select *, acos(ux) / 2 as half, ux + 1.0 as bx, uy as by_ from u)
select key, round(bx / sqrt(bx * bx + by_ * by_) * 2.0 / sin(half), 5) as cx, round(by_ / sqrt(bx * bx + by_ * by_) * 2.0 / sin(half), 5) as cy from h
""")
def corner_fillets(spark, sf):
    c = S.tangent_to_corner(V.vec(0.0, 0.0), V.vec("x", "y"), V.vec(10.0, 0.0), 2.0)
    return named(points(spark, sf), 5, cx=c[0], cy=c[1])


@query(f"""
with a as (select key, x / 10.0 as s, (y - 50.0) / 20.0 as e, z + 1.0 as r from {P}), b as (select *, case when e < 0 then s + e else s end as f, abs(e) as w from a), c as (
    select *, 5.0 + r * cos(s) as x0, 5.0 + r * cos(s + e) as x1, 5.0 + r * sin(s) as y0, 5.0 + r * sin(s + e) as y1 from b)
select key, round(r * w, 8) as length, round(5.0 + r * cos(s + e * 0.5), 8) as mx, round(5.0 + r * sin(s + e * 0.5), 8) as my,
    round(case when {_on_arc("f", "w", repr(math.pi))} then 5.0 - r else least(x0, x1) end, 8) as x_min, round(case when {_on_arc("f", "w", "0.0")} then 5.0 + r else greatest(x0, x1) end, 8) as x_max,
    round(case when {_on_arc("f", "w", repr(1.5 * math.pi))} then 5.0 - r else least(y0, y1) end, 8) as y_min, round(case when {_on_arc("f", "w", repr(math.pi / 2))} then 5.0 + r else greatest(y0, y1) end, 8) as y_max from c
""")
def arcs_measured(spark, sf):
    c, r, s, e = V.vec(5.0, 5.0), F.col("z") + 1.0, F.col("x") / 10.0, (F.col("y") - 50.0) / 20.0
    m = S.arc_point(c, r, s, e, F.lit(0.5))
    low, high = S.arc_aabb(c, r, s, e)
    return named(points(spark, sf), 8, length=S.arc_length(r, e), mx=m[0], my=m[1], x_min=low[0], x_max=high[0], y_min=low[1], y_max=high[1])


@query(f"""
with a as (select key, x / 10.0 as s, y / 40.0 as e, z + 1.0 as r from {P}), n as (select *, greatest(cast(ceil(e / (2 * acos(1 - 0.05 / r))) as bigint), 1) as n from a), p as (
    select key, r, s, e, n, unnest(range(0, n + 1)) as k from n)
select key, k, round(5.0 + r * cos(s + e * k / n), 6) as px, round(5.0 + r * sin(s + e * k / n), 6) as py from p
""")
def arcs_as_polylines(spark, sf):
    made = S.arc_points(V.vec(5.0, 5.0), F.col("z") + 1.0, F.col("x") / 10.0, F.col("y") / 40.0, 0.05)
    rows = points(spark, sf).select("key", F.posexplode(made).alias("k", "p"))
    return rows.select("key", F.col("k").cast("long").alias("k"), F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


# ---- planes, lines and spheres in space ----------------------------------------------------------------------------------
@query(f"select key, round(x - 0.6 * s, 6) as px, y as py, round(z - 0.8 * s, 6) as pz, s >= 0 as above, round(x - 0.6 * (0.6 * x + 0.8 * z), 6) as vx from (select *, 0.6 * x + 0.8 * z - 30.0 as s from {P})")
def plane_projections(spark, sf):
    n, p = V.vec(0.6, 0.0, 0.8), V.vec("x", "y", "z")
    q, v = S.plane_project(n, 30.0, p), S.plane_project_vector(n, p)
    return points(spark, sf).select("key", F.round(q[0], 6).alias("px"), q[1].alias("py"), F.round(q[2], 6).alias("pz"), S.plane_is_positive(n, 30.0, p).alias("above"), F.round(v[0], 6).alias("vx"))


@query(f"""
with c as (select key, x, y, z, 10.0 * z - 2.0 * y as nx, 2.0 * x - 5.0 * z as ny, 5.0 * y - 10.0 * x as nz from {P}), l as (select *, sqrt(nx * nx + ny * ny + nz * nz) as l from c)
select key, round(nx / l, 6) as nx, round(ny / l, 6) as ny, round(nz / l, 6) as nz, round((nx * 5.0 + ny * 10.0 + nz * 2.0 + nx + ny + nz) / l, 6) as d from l where l > 1.0
""")
def planes_through_points(spark, sf):
    shift = V.vec(1.0, 1.0, 1.0)
    a, b, c = shift, V.add(shift, V.vec(5.0, 10.0, 2.0)), V.add(shift, V.vec("x", "y", "z"))
    n, d = S.plane_from_points(a, b, c)
    size = V.norm(V.cross(V.vec(5.0, 10.0, 2.0), V.vec("x", "y", "z")))
    return named(points(spark, sf).filter(size > 1.0), 6, nx=n[0], ny=n[1], nz=n[2], d=d)


@query(f"""
with u as (select key, x, y, z, sqrt(x * x + y * y + z * z) as l from {P}), n as (select key, x / l as a, y / l as b, z / l as c, x as d from u)
select key, round(-d * b / (a * a + b * b), 6) as lx, round(0 + d * 0.0, 6) as zero, round(b / sqrt(a * a + b * b), 6) as ux, round(-a / sqrt(a * a + b * b), 6) as uy from (select key, a, b, c, d * -1 as d from n)
""")
def plane_pairs(spark, sf):
    """The line in which a plane through the point meets the plane z = 0."""
    n = V.unit(V.vec("x", "y", "z"))
    _, u = S.planes_intersection(n, F.col("x"), V.vec(0.0, 0.0, 1.0), F.lit(0.0))
    o, _ = S.planes_intersection((n[1], n[0], n[2]), F.col("x"), V.vec(0.0, 0.0, 1.0), F.lit(0.0))
    return points(spark, sf).select("key", F.round(o[0], 6).alias("lx"), F.round(o[2], 6).alias("zero"), F.round(u[0], 6).alias("ux"), F.round(u[1], 6).alias("uy"))


@query(f"select key, round(t * 2.0, 6) as px, round(t * 1.0, 6) as py, round(t * -2.0, 6) as pz, round(sqrt((x - t * 2.0) ** 2 + (y - t) ** 2 + (z + t * 2.0) ** 2), 6) as d from (select *, (x * 2.0 + y * 1.0 - z * 2.0) / 9.0 as t from {P})")
def line3_distances(spark, sf):
    o, d, q = V.vec(0.0, 0.0, 0.0), V.vec(2.0, 1.0, -2.0), V.vec("x", "y", "z")
    p = S.line3_closest(o, d, q)
    return named(points(spark, sf), 6, px=p[0], py=p[1], pz=p[2], d=S.line3_distance(o, d, q))


@query(f"""
with s as (select key, x, y, z, sqrt((x - 20.0) ** 2 + (y - 30.0) ** 2 + (z - 5.0) ** 2) as l, 0.6 * x + 0.8 * z - 25.0 as h from {P})
select key, round(20.0 + (x - 20.0) / nullif(l, 0) * 7.0, 6) as px, round(5.0 + (z - 5.0) / nullif(l, 0) * 7.0, 6) as pz, case when 100.0 - h * h >= 0 then round(sqrt(100.0 - h * h), 6) end as cut, case when 100.0 - h * h >= 0 then round(x - 0.6 * h, 6) end as cx from s
""")
def sphere_sections(spark, sf):
    p = V.vec("x", "y", "z")
    q = S.sphere_closest(V.vec(20.0, 30.0, 5.0), 7.0, p)
    c, r = S.sphere_plane_circle(p, 10.0, V.vec(0.6, 0.0, 0.8), 25.0)
    return named(points(spark, sf), 6, px=q[0], pz=q[2], cut=r, cx=c[0])


@query(f"""
with s as (select key, x - 20.0 as vx, y - 30.0 as vy, z - 5.0 as vz, sqrt((x - 20.0) ** 2 + (y - 30.0) ** 2 + (z - 5.0) ** 2) as d from {P}), a as (select *, (d * d + 400.0 - 225.0) / (2 * d) as a from s where d > 0)
select key, round(20.0 + vx / d * a, 6) as cx, round(vy / d, 6) as ny, case when 400.0 - a * a >= 0 then round(sqrt(400.0 - a * a), 6) end as r from a
""")
def sphere_pairs(spark, sf):
    c0, p = V.vec(20.0, 30.0, 5.0), V.vec("x", "y", "z")
    c, n, r = S.spheres_circle(c0, F.lit(20.0), p, F.lit(15.0))
    return named(points(spark, sf).filter(V.dist(c0, p) > 0), 6, cx=c[0], ny=n[1], r=r)


@query(f"select key, round(1.0 + 6.0 * cos(x), 6) as px, round(2.0 + 6.0 * 0.6 * sin(x), 6) as py, round(3.0 + 6.0 * 0.8 * sin(x), 6) as pz, round(atan2((y - 2.0) * 0.6 + (z - 3.0) * 0.8, x - 1.0), 6) as angle from {P}")
def circle3_places(spark, sf):
    c, u, v = V.vec(1.0, 2.0, 3.0), V.vec(1.0, 0.0, 0.0), V.vec(0.0, 0.6, 0.8)
    p = S.circle3_at(c, u, v, 6.0, F.col("x"))
    return named(points(spark, sf), 6, px=p[0], py=p[1], pz=p[2], angle=S.circle3_closest_angle(c, u, v, V.vec("x", "y", "z")))


# ---- boxes ---------------------------------------------------------------------------------------------------------------
@query(f"""
select grp, round(greatest(min(x), 10.0), 6) as low_x, round(least(max(x), 30.0), 6) as high_x, round(least(min(y), 20.0), 6) as all_y, round(max(y) + 1.5, 6) as wide_y, greatest(min(x), 10.0) <= least(max(x), 30.0) and greatest(min(y), 20.0) <= least(max(y), 60.0) as meets from {P} group by grp
""")
def box_algebra(spark, sf):
    boxes = points(spark, sf).groupBy("grp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    low, high = [F.col("x0"), F.col("y0")], [F.col("x1"), F.col("y1")]
    other = ([F.lit(10.0), F.lit(20.0)], [F.lit(30.0), F.lit(60.0)])
    both_low, both_high, meets = masks.box_intersection(low, high, *other)
    all_low, _ = masks.box_merge(low, high, *other)
    _, wide = masks.box_expand(low, high, 1.5)
    return rounded(boxes.select("grp", both_low[0].alias("low_x"), both_high[0].alias("high_x"), all_low[1].alias("all_y"), wide[1].alias("wide_y"), meets.alias("meets")), "low_x", "high_x", "all_y", "wide_y")
