"""Angles, intervals and tolerances as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, cross2, dot

TAU = 2 * math.pi
#: How much an angle may lie outside an arc and still count as on it.
ANGLE_TOL = 1e-12


def to_2pi(a: Column) -> Column:
    """[0, 2 pi)."""
    return F.pmod(a, F.lit(TAU))


def signed_pi(a: Column) -> Column:
    """[-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(TAU)) - math.pi


def in_direction(a: Column, b: Column, direction: int) -> Column:
    """Angle passed from a to b turning clockwise (-1) or counter-clockwise (1)."""
    return to_2pi((b - a) * direction)


def shortest(a: Column, b: Column) -> Column:
    """Signed, from a to b."""
    return signed_pi(b - a)


def signed_complement(a: Column) -> Column:
    """The same turn the other way round."""
    return F.when(a > 0, a - TAU).when(a < 0, a + TAU).otherwise(F.lit(0.0))


def direction_sign(a: Column) -> Column:
    """-1 clockwise, 1 counter-clockwise."""
    return F.when(a < 0, -1).otherwise(1)


def signed_angle(a: Vec, b: Vec) -> Column:
    return F.atan2(cross2(a, b), dot(a, b))


def directed_angle(a: Vec, b: Vec, direction: int) -> Column:
    return to_2pi(signed_angle(a, b) * direction)


def arc_contains(start: Column, extent: Column, a: Column) -> Column:
    """Whether an angle lies on the arc [start, start + extent]."""
    turned = to_2pi(a - start)
    return (turned <= extent + ANGLE_TOL) | (turned >= TAU - ANGLE_TOL)


def arcs_intersect(start1: Column, extent1: Column, start2: Column, extent2: Column) -> Column:
    return arc_contains(start1, extent1, start2) | arc_contains(start2, extent2, start1)


def arc_at(start: Column, extent: Column, fraction: Column) -> Column:
    return to_2pi(start + extent * fraction)


# ---- intervals and tolerances -------------------------------------------------------------------------------------------
def interval(a: Column, b: Column) -> Column:
    """struct(min, max) in either order; null when a bound is null or not a number."""
    bad = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    return F.when(~bad, F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max")))


def interval_length(i: Column) -> Column:
    return i["max"] - i["min"]


def interval_center(i: Column) -> Column:
    return (i["min"] + i["max"]) / 2


def interval_contains(i: Column, x: Column) -> Column:
    return x.between(i["min"], i["max"])


def interval_clamp(i: Column, x: Column) -> Column:
    return F.least(F.greatest(x, i["min"]), i["max"])


def interval_overlaps(a: Column, b: Column) -> Column:
    return (a["min"] <= b["max"]) & (b["min"] <= a["max"])


def interval_contains_interval(a: Column, b: Column) -> Column:
    return (a["min"] <= b["min"]) & (b["max"] <= a["max"])


def interval_intersection(a: Column, b: Column) -> Column:
    return F.when(interval_overlaps(a, b), F.struct(F.greatest(a["min"], b["min"]).alias("min"), F.least(a["max"], b["max"]).alias("max")))


def symmetrical(size: Column, center: Column | float = 0.0) -> Column:
    """The tolerance of half a size on either side."""
    return F.struct((F.lit(center) - size / 2).alias("min"), (F.lit(center) + size / 2).alias("max"))


conforms = interval_contains


# ---- scalar maps -------------------------------------------------------------------------------------------------------
def domain_map(a: Column, x0: float, m: float) -> Column:
    return (a - x0) * m


def domain_unmap(b: Column, x0: float, m: float) -> Column:
    return b / m + x0


def polynomial(x: Column, coefficients: list[Column | float]) -> Column:
    """Horner's scheme; coefficients from the constant up."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + c
    return out


def gaussian(x: Column, mean: float, sigma: float) -> Column:
    """Height 1."""
    return F.exp(F.pow((x - mean) / sigma, 2) * -0.5)


def line(x: Column, m: Column | float, b: Column | float) -> Column:
    return x * m + b


def distance_weight(d: Column, threshold: float) -> Column:
    return F.when(d < threshold, 1.0).otherwise(0.0)


def normal_weight(n: Vec, reference: Vec) -> Column:
    return F.when(dot(n, reference) > 0, 1.0).otherwise(0.0)


def quantise(z: Column, low: float, high: float) -> Column:
    """Height as 16-bit number: clamped, then truncated."""
    return F.floor(F.least(F.greatest((z - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 65535).cast("int")


def dequantise(u: Column, low: float, high: float) -> Column:
    return u / 65535.0 * (high - low) + low


def scan_uncertainty(z: Column, detector_z: float, detector_y: float, factor: float) -> Column:
    return F.lit(factor) / F.pow(F.cos(F.atan2(F.lit(detector_z) - z, F.lit(detector_y))), 2)
