"""Between the plane and space: points, vectors, surface points and measured distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import Vec, dot, norm, sub, transform


def to_2d(v: Vec) -> Vec:
    return (v[0], v[1])


def to_3d(v: Vec) -> Vec:
    return (v[0], v[1], F.lit(0.0))


def normal_to_2d(n: Vec, least: float = 1e-9) -> Vec:
    """The unit normal's direction in the plane; null for one that stands on the plane."""
    flat = to_2d(n)
    size = norm(flat)
    return tuple(F.when(size > least, x / size) for x in flat)


def surface_point_to_2d(p: Vec, n: Vec) -> tuple[Vec, Vec]:
    return to_2d(p), normal_to_2d(n)


def surface_point_to_3d(p: Vec, n: Vec) -> tuple[Vec, Vec]:
    return to_3d(p), to_3d(n)


def distance_to_3d(a: Vec, b: Vec, direction: Vec, matrix: Sequence[Sequence[float]]) -> tuple[Vec, Vec, Vec]:
    """A distance of the plane (from a to b along a unit direction) lifted to z = 0 and moved by a rigid transform."""
    return transform(to_3d(a), matrix), transform(to_3d(b), matrix), transform(to_3d(direction), matrix, vector=True)


def distance_to_2d(a: Vec, b: Vec, direction: Vec, matrix: Sequence[Sequence[float]]) -> tuple[Vec, Vec, Vec]:
    """A distance of space moved by a rigid transform, then without z; the direction is null where it stands on the plane."""
    return to_2d(transform(a, matrix)), to_2d(transform(b, matrix)), normal_to_2d(transform(direction, matrix, vector=True))


def distance_value(a: Vec, b: Vec, direction: Vec) -> Column:
    return dot(sub(b, a), direction)
