"""Lines, segments, circles, arcs, planes and spheres as Column expressions. What doesn't exist is null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import TAU, arc_contains, to_2pi
from .vectors import Vec, add, cross, cross2, dist, dist2, dot, norm, rot90, scale, sub, unit


def _div(a: Column, b: Column, eps: float = 1e-12) -> Column:
    """Null where b is (nearly) zero."""
    return a / F.when(F.abs(b) > eps, b)


# ---- 2D lines and segments --------------------------------------------------------------------------------------------
def line_params(p: Vec, d: Vec, q: Vec, e: Vec) -> Vec:
    """(t, u) with p + t d = q + u e; null when parallel."""
    turn = cross2(d, e)
    w = sub(q, p)
    return (_div(cross2(w, e), turn), _div(cross2(w, d), turn))


def intersect_lines(p: Vec, d: Vec, q: Vec, e: Vec) -> Vec:
    return add(p, scale(d, line_params(p, d, q, e)[0]))


def projected_parameter(p: Vec, d: Vec, q: Vec) -> Column:
    return _div(dot(sub(q, p), d), dot(d, d), 0.0)


def projected_point(p: Vec, d: Vec, q: Vec) -> Vec:
    return add(p, scale(d, projected_parameter(p, d, q)))


def segment_closest(a: Vec, b: Vec, q: Vec) -> tuple[Vec, Column]:
    """(closest point, its parameter from 0 at a to 1 at b); a itself for a segment without length."""
    d = sub(b, a)
    t = F.least(F.greatest(F.coalesce(projected_parameter(a, d, q), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return add(a, scale(d, t)), t


def segment_offset(a: Vec, b: Vec, distance: Column | float) -> tuple[Vec, Vec]:
    n = unit(rot90(sub(b, a)))
    return add(a, scale(n, distance)), add(b, scale(n, distance))


# ---- 2D circles and arcs -----------------------------------------------------------------------------------------------
def circle_from_3_points(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    """(centre, radius); null for points in line."""
    bx, cx = sub(b, a), sub(c, a)
    turn = cross2(bx, cx) * 2
    b2, c2 = dot(bx, bx), dot(cx, cx)
    u = (_div(cx[1] * b2 - bx[1] * c2, turn), _div(bx[0] * c2 - cx[0] * b2, turn))
    return add(a, u), norm(u)


def circle_at(centre: Vec, radius: Column, angle: Column) -> Vec:
    return (centre[0] + radius * F.cos(angle), centre[1] + radius * F.sin(angle))


def circle_angle_of(centre: Vec, p: Vec) -> Column:
    return to_2pi(F.atan2(p[1] - centre[1], p[0] - centre[0]))


def circle_project(centre: Vec, radius: Column, p: Vec) -> Vec:
    return add(centre, scale(unit(sub(p, centre)), radius))


def circle_signed_distance(centre: Vec, radius: Column, p: Vec) -> Column:
    """Negative inside."""
    return dist(centre, p) - radius


def circle_contains(centre: Vec, radius: Column, p: Vec) -> Column:
    return dist2(centre, p) <= radius * radius


def circles_intersections(c1: Vec, r1: Column, c2: Vec, r2: Column) -> tuple[Vec, Vec]:
    """Both points (equal ones when the circles touch); null when they don't meet or share the centre."""
    d = dist(c1, c2)
    meets = (d > 0) & (d <= r1 + r2) & (d >= F.abs(r1 - r2))
    a = F.when(meets, _div(r1 * r1 - r2 * r2 + d * d, d * 2, 0.0))
    h = F.sqrt(F.greatest(r1 * r1 - a * a, F.lit(0.0)))
    u = unit(sub(c2, c1))
    base, side = add(c1, scale(u, a)), scale(rot90(u), h)
    return add(base, side), sub(base, side)


def circle_line_params(centre: Vec, radius: Column, p: Vec, d: Vec) -> Vec:
    """Parameters of the line's two hits, falling behind null when it misses."""
    a, b = dot(d, d), dot(sub(p, centre), d) * 2
    c = dist2(p, centre) - radius * radius
    disc = b * b - a * c * 4
    root = F.sqrt(F.when(disc >= 0, disc))
    return (_div(-b - root, a * 2, 0.0), _div(-b + root, a * 2, 0.0))


def tangent_points(centre: Vec, radius: Column, p: Vec) -> tuple[Vec, Vec]:
    """Where lines through p touch the circle; null for p inside."""
    d2 = dist2(centre, p)
    out = F.when(d2 >= radius * radius, d2)
    k, h = radius * radius / out, radius * F.sqrt(F.greatest(out - radius * radius, F.lit(0.0))) / out
    v = sub(p, centre)
    base = add(centre, scale(v, k))
    return add(base, scale(rot90(v), h)), sub(base, scale(rot90(v), h))


def outer_tangents(c1: Vec, r1: Column, c2: Vec, r2: Column) -> tuple[tuple[Vec, Vec], tuple[Vec, Vec]]:
    """The two segments that touch both circles from outside."""
    d = dist(c1, c2)
    u, k = unit(sub(c2, c1)), (r1 - r2) / F.nullif(d, F.lit(0.0))
    h = F.sqrt(F.when(F.abs(k) <= 1, 1 - k * k))
    out = []
    for side in (1, -1):
        n = add(scale(u, k), scale(rot90(u), h * side))
        out.append((add(c1, scale(n, r1)), add(c2, scale(n, r2))))
    return tuple(out)


def tangent_to_corner(corner: Vec, a: Vec, b: Vec, radius: Column | float) -> Vec:
    """Centre of the circle that touches both legs of a corner; null for legs in line."""
    u, v = unit(sub(a, corner)), unit(sub(b, corner))
    half = F.acos(F.least(F.greatest(dot(u, v), F.lit(-1.0)), F.lit(1.0))) / 2
    return add(corner, scale(unit(add(u, v)), _div(F.lit(radius), F.sin(half))))


def arc_point(centre: Vec, radius: Column, start: Column, extent: Column, fraction: Column) -> Vec:
    return circle_at(centre, radius, start + extent * fraction)


def arc_length(radius: Column, extent: Column) -> Column:
    return radius * F.abs(extent)


def arc_aabb(centre: Vec, radius: Column, start: Column, extent: Column) -> tuple[Vec, Vec]:
    """(lower, upper) corner."""
    first, size = F.when(extent < 0, to_2pi(start + extent)).otherwise(to_2pi(start)), F.abs(extent)
    ends = [circle_at(centre, radius, start), circle_at(centre, radius, start + extent)]
    low, high = [], []
    for axis in (0, 1):
        values = [e[axis] for e in ends]
        for k in range(4):
            quarter = F.lit(k * math.pi / 2)
            values.append(F.when(arc_contains(first, F.least(size, F.lit(TAU)), quarter), centre[axis] + radius * (math.cos(k * math.pi / 2) if axis == 0 else math.sin(k * math.pi / 2))))
        low.append(F.least(*values))
        high.append(F.greatest(*values))
    return tuple(low), tuple(high)


def arc_points(centre: Vec, radius: Column, start: Column, extent: Column, tol: float) -> Column:
    """Array of points (struct x, y) whose chords stay within tol of the arc."""
    step = F.acos(F.greatest(1 - F.lit(tol) / radius, F.lit(-1.0))) * 2
    n = F.greatest(F.ceil(F.abs(extent) / F.nullif(step, F.lit(0.0))), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(*(c.alias(name) for c, name in zip(circle_at(centre, radius, start + extent * k / n), "xy", strict=True))))


# ---- planes: n . p = d -------------------------------------------------------------------------------------------------
def plane_from_points(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    n = unit(cross(sub(b, a), sub(c, a)))
    return n, dot(n, a)


def plane_signed_distance(n: Vec, d: Column | float, p: Vec) -> Column:
    return dot(n, p) - d


def plane_is_positive(n: Vec, d: Column | float, p: Vec) -> Column:
    return plane_signed_distance(n, d, p) >= 0


def plane_project(n: Vec, d: Column | float, p: Vec) -> Vec:
    return sub(p, scale(n, plane_signed_distance(n, d, p)))


def plane_project_vector(n: Vec, v: Vec) -> Vec:
    return sub(v, scale(n, dot(n, v)))


def plane_intersection_distance(n: Vec, d: Column | float, p: Vec, direction: Vec, both_sides: bool = False) -> Column:
    """Along direction from p to the plane. Only directions along the normal count, unless both_sides."""
    along = dot(n, direction)
    return (F.lit(d) - dot(n, p)) / F.when((F.abs(along) if both_sides else along) > 1e-6, along)


def planes_intersection(n1: Vec, d1: Column, n2: Vec, d2: Column) -> tuple[Vec, Vec]:
    """(origin, unit direction) of the line; null for parallel planes."""
    u = cross(n1, n2)
    size = dot(u, u)
    ok = F.when(size > 1e-12, size)
    origin = scale(cross(sub(scale(n2, d1), scale(n1, d2)), u), 1 / ok)
    return origin, unit(tuple(F.when(size > 1e-12, x) for x in u))


# ---- 3D lines, spheres, circles ----------------------------------------------------------------------------------------
def line3_closest(p: Vec, d: Vec, q: Vec) -> Vec:
    return add(p, scale(d, projected_parameter(p, d, q)))


def line3_distance(p: Vec, d: Vec, q: Vec) -> Column:
    return dist(q, line3_closest(p, d, q))


def line_sphere_params(p: Vec, d: Vec, centre: Vec, radius: Column | float) -> Vec:
    w = sub(p, centre)
    a, b, c = dot(d, d), dot(w, d), dot(w, w) - F.lit(radius) * radius
    disc = b * b - a * c
    root = F.sqrt(F.when(disc >= 0, disc))
    return (_div(-b - root, a, 0.0), _div(-b + root, a, 0.0))


def sphere_closest(centre: Vec, radius: Column | float, p: Vec) -> Vec:
    return add(centre, scale(unit(sub(p, centre)), radius))


def sphere_plane_circle(centre: Vec, radius: Column | float, n: Vec, d: Column | float) -> tuple[Vec, Column]:
    """(centre, radius) of the section; null when the plane misses."""
    s = plane_signed_distance(n, d, centre)
    r2 = F.lit(radius) * radius - s * s
    ok = r2 >= 0
    return tuple(F.when(ok, x) for x in plane_project(n, d, centre)), F.sqrt(F.when(ok, r2))


def spheres_circle(c1: Vec, r1: Column, c2: Vec, r2: Column) -> tuple[Vec, Vec, Column]:
    """(centre, normal, radius) of the circle in which two spheres meet."""
    d = dist(c1, c2)
    a = _div(d * d + r1 * r1 - r2 * r2, d * 2, 0.0)
    rr = r1 * r1 - a * a
    n = unit(sub(c2, c1))
    return add(c1, scale(n, a)), n, F.sqrt(F.when(rr >= 0, rr))


def circle3_at(centre: Vec, u: Vec, v: Vec, radius: Column | float, angle: Column) -> Vec:
    """u, v: unit vectors of the zero angle and a right angle."""
    return add(centre, add(scale(u, F.cos(angle) * radius), scale(v, F.sin(angle) * radius)))


def circle3_closest_angle(centre: Vec, u: Vec, v: Vec, p: Vec) -> Column:
    w = sub(p, centre)
    return F.atan2(dot(w, v), dot(w, u))
