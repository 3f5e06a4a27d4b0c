"""Points and vectors as Column expressions. A vector is a sequence of 2 or 3 columns, so that Catalyst generates code for it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]
EPS = 2.220446049250313e-16


def vec(*names: str | Column | float) -> tuple[Column, ...]:
    """Columns by name, Column or number."""
    return tuple(F.col(n) if isinstance(n, str) else n if isinstance(n, Column) else F.lit(float(n)) for n in names)


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(x * k for x in a)


def dot(a: Vec, b: Vec) -> Column:
    return reduce(lambda s, t: s + t, (x * y for x, y in zip(a, b, strict=True)))


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """Null for the zero vector."""
    n = F.nullif(norm(a), F.lit(0.0))
    return tuple(x / n for x in a)


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def cross2(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def dist2(a: Vec, b: Vec) -> Column:
    return dot(sub(a, b), sub(a, b))


def dist(a: Vec, b: Vec) -> Column:
    return F.sqrt(dist2(a, b))


def mid_point(a: Vec, b: Vec) -> Vec:
    return tuple((x + y) / 2.0 for x, y in zip(a, b, strict=True))


def lerp(a: Vec, b: Vec, t: Column) -> Vec:
    return tuple(x + (y - x) * t for x, y in zip(a, b, strict=True))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    u, v = sub(b, a), sub(c, a)
    if len(a) == 2:
        return F.abs(cross2(u, v)) * 0.5
    if len(a) == 3:
        return norm(cross(u, v)) * 0.5
    raise ValueError("triangles have 2 or 3 dimensions")


def barycentric(a: Vec, b: Vec, c: Vec, p: Vec) -> Vec:
    """Weights of a, b, c; all 0 for a triangle without area."""
    v0, v1, v2 = sub(b, a), sub(c, a), sub(p, a)
    d00, d01, d11, d20, d21 = dot(v0, v0), dot(v0, v1), dot(v1, v1), dot(v2, v0), dot(v2, v1)
    area = d00 * d11 - d01 * d01
    flat = F.abs(area) < EPS
    safe = F.when(flat, 1.0).otherwise(area)
    v, w = (d11 * d20 - d01 * d21) / safe, (d00 * d21 - d01 * d20) / safe
    return tuple(F.when(flat, 0.0).otherwise(x) for x in (1.0 - v - w, v, w))


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def angle_between(a: Vec, b: Vec) -> Column:
    """Radians, 0 to pi; null where a vector is zero."""
    return F.acos(clamp(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))))


def three_point_angle(centre: Vec, a: Vec, b: Vec) -> Column:
    return angle_between(sub(a, centre), sub(b, centre))


def distance_to_line(a: Vec, b: Vec, p: Vec) -> Column:
    """Of p to the line through a and b; to a where both are the same."""
    d, v = sub(b, a), sub(p, a)
    t = F.coalesce(dot(v, d) / F.nullif(dot(d, d), F.lit(0.0)), F.lit(0.0))
    return norm(sub(v, scale(d, t)))


def transform(p: Vec, matrix: Sequence[Sequence[float]], vector: bool = False) -> Vec:
    """A rigid transform given as rows of numbers (dimension x dimension + 1); vectors turn only."""
    n = len(p)
    return tuple(reduce(lambda s, t: s + t, [p[k] * float(matrix[r][k]) for k in range(n)] + ([] if vector else [F.lit(float(matrix[r][n]))])) for r in range(n))


# ---- surface points: a point and a unit normal ----------------------------------------------------------------------
def scalar_projection(p: Vec, n: Vec, q: Vec) -> Column:
    """Signed distance of q along the normal n at p."""
    return dot(sub(q, p), n)


def project_to_normal_line(p: Vec, n: Vec, q: Vec) -> Vec:
    return add(p, scale(n, scalar_projection(p, n, q)))


def planar_distance(p: Vec, n: Vec, q: Vec) -> Column:
    """Distance of q from the line along the normal."""
    return dist(q, project_to_normal_line(p, n, q))


def at_distance(p: Vec, n: Vec, d: Column | float) -> Vec:
    return add(p, scale(n, d))


def shift_orthogonal(p: Vec, n: Vec, d: Column | float) -> Vec:
    """2D: along the normal turned by -90 degrees."""
    return (p[0] + n[1] * d, p[1] - n[0] * d)


def rotate2(v: Vec, angle: Column | float) -> Vec:
    c, s = (F.cos(F.lit(angle)), F.sin(F.lit(angle))) if not isinstance(angle, Column) else (F.cos(angle), F.sin(angle))
    return (v[0] * c - v[1] * s, v[0] * s + v[1] * c)


def rot90(v: Vec) -> Vec:
    return (-v[1], v[0])


def rot270(v: Vec) -> Vec:
    return (v[1], -v[0])


# ---- cylinder unrolling and cameras -----------------------------------------------------------------------------------
def unroll(p: Vec, radius: float) -> Vec:
    """A point around the z axis as (angle * radius, z, distance from the cylinder)."""
    return (F.atan2(p[1], p[0]) * radius, p[2], F.sqrt(p[0] * p[0] + p[1] * p[1]) - radius)


def roll(q: Vec, radius: float) -> Vec:
    angle, r = q[0] / radius, q[2] + radius
    return (r * F.cos(angle), r * F.sin(angle), q[1])


def pinhole(p: Vec, fx: float, fy: float, cx: float, cy: float) -> Vec:
    """Pixel of a point in camera coordinates; null behind the camera."""
    z = F.when(p[2] > 0, p[2])
    return (p[0] / z * fx + cx, p[1] / z * fy + cy)


def back_project(pixel: Vec, fx: float, fy: float, cx: float, cy: float) -> Vec:
    """Unit direction of a pixel's ray."""
    return unit(((pixel[0] - cx) / fx, (pixel[1] - cy) / fy, F.lit(1.0)))


def directed_distance(a: Vec, b: Vec, direction: Vec | None = None) -> Column:
    """Of b from a along direction (their own if none is given: their distance)."""
    return dist(a, b) if direction is None else dot(sub(b, a), direction)


def actual_point(nominal: Vec, normal: Vec, deviation: Column) -> Vec:
    return at_distance(nominal, normal, deviation)


def euler_to_matrix(w: Column, p: Column, r: Column) -> tuple[Vec, Vec, Vec]:
    """Rows of the rotation z(r) y(p) x(w), angles in degrees."""
    (cw, sw), (cp, sp), (cr, sr) = ((F.cos(F.radians(a)), F.sin(F.radians(a))) for a in (w, p, r))
    return ((cr * cp, cr * sp * sw - sr * cw, cr * sp * cw + sr * sw), (sr * cp, sr * sp * sw + cr * cw, sr * sp * cw - cr * sw), (-sp, cp * sw, cp * cw))


def matrix_to_euler(m: Sequence[Vec]) -> Vec:
    """(w, p, r) in degrees of a rotation's rows."""
    return (F.degrees(F.atan2(m[2][1], m[2][2])), F.degrees(F.asin(clamp(-m[2][0]))), F.degrees(F.atan2(m[1][0], m[0][0])))
