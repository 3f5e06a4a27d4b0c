"""Stations on curves (curve, seq, x, y[, z]): a place with its edge, direction, normal and length, and the ways on from it.

A station is a row: by, seq (of the edge's first vertex), fraction of the edge, length from the start, the place, its direction
(dx, ..) and in the plane its normal (nx, ny), to the right of the direction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec, dot, sub
from .curves import at_lengths, closing, coordinates, lengths, segments, total_length, vertex_directions

Keys = Sequence[str]


def _normal(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"nx": F.col("dy"), "ny": -F.col("dx")}) if "dz" not in rows.columns else rows


def at_vertices(curve: DataFrame, by: Keys, closed: bool = False) -> DataFrame:
    """A station for each vertex, with the vertex directions; previous and next are its neighbours' seq, around a closed curve.

    A closed curve is given without its first vertex repeated at the end.
    """
    names, w = coordinates(curve), Window.partitionBy(*by).orderBy("seq")
    rows = lengths(curve, by)
    if closed:
        # the neighbours of the first and the last vertex are each other
        all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        p = [F.col(n) for n in names]
        before = [F.coalesce(F.lag(n).over(w), F.last(n).over(all_)) for n in names]
        after = [F.coalesce(F.lead(n).over(w), F.first(n).over(all_)) for n in names]
        into, out = sub(p, before), sub(after, p)
        size = lambda v: F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))
        both = [F.coalesce(a / size(into), F.lit(0.0)) + F.coalesce(b / size(out), F.lit(0.0)) for a, b in zip(into, out, strict=True)]
        way = [c / size(both) for c in both]
        previous = F.coalesce(F.lag("seq").over(w), F.last("seq").over(all_))
        following = F.coalesce(F.lead("seq").over(w), F.first("seq").over(all_))
    else:
        way, previous, following = vertex_directions(curve, by), F.lag("seq").over(w), F.lead("seq").over(w)
    out = rows.select(*by, "seq", F.lit(0.0).alias("fraction"), "length", *names, *(c.alias(f"d{n}") for c, n in zip(way, names, strict=True)), previous.alias("previous"), following.alias("next"))
    return _normal(out)


def at(curve: DataFrame, queries: DataFrame, by: Keys, closed: bool = False) -> DataFrame:
    """A station for each row of queries (by, length, ...): on an edge, with the edge's direction; null outside.

    On a closed curve lengths run around: they may be negative or beyond the curve's length.
    """
    if closed:
        curve = closing(curve, by)
        total = total_length(curve, by).withColumnRenamed("length", "_total")
        queries = (queries.join(total, list(by)) if by else queries.crossJoin(F.broadcast(total))).withColumn("length", F.pmod("length", "_total")).drop("_total")
    names = coordinates(curve)
    found = at_lengths(curve, queries, by)
    edge = segments(curve, by).filter("step > 0").select(*by, F.col("seq"), F.col("l0"), F.col("step"))
    from .series import asof

    own = [c for c in queries.columns if c not in (*by, "length")]
    placed = asof(found, edge.withColumn("length", F.col("l0")), by, "length", ["seq", "l0", "step"])
    fraction = F.least((F.col("length") - F.col("l0")) / F.col("step"), F.lit(1.0))
    out = placed.select(*by, *own, F.when(F.col(names[0]).isNotNull(), F.col("seq")).alias("seq"), F.when(F.col(names[0]).isNotNull(), fraction).alias("fraction"), "length", *names, *(f"d{n}" for n in names))
    return _normal(out)


def travelled(curve: DataFrame, stations: DataFrame, by: Keys, distance: float | Column, closed: bool = False) -> DataFrame:
    """The stations that lie distance further along (back, if it is negative)."""
    moved = stations.select(*by, (F.col("length") + distance).alias("length"))
    return at(curve, moved, by, closed)


def ends(curve: DataFrame, by: Keys) -> DataFrame:
    """Both ends' stations, with is_front."""
    rows = at_vertices(curve, by)
    return rows.filter("previous is null or next is null").withColumn("is_front", F.col("previous").isNull())


# ---- a station's own frame ---------------------------------------------------------------------------------------------
def normal_projection(place: Vec, normal: Vec, other: Vec) -> Column:
    """How far other lies along the normal of a station."""
    return dot(sub(other, place), normal)


def direction_projection(place: Vec, direction: Vec, other: Vec) -> Column:
    """How far other lies along the direction of a station."""
    return dot(sub(other, place), direction)


def surface_point(station_names: Sequence[str] = ("x", "y")) -> tuple[Vec, Vec]:
    """(place, normal) of a station in the plane; in space (place, direction)."""
    lead = "n" if len(station_names) == 2 else "d"
    return tuple(F.col(n) for n in station_names), tuple(F.col(f"{lead}{n}") for n in station_names)
