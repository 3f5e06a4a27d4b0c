"""Arrays and lists in and out of DataFrames, checked: what doesn't fit fails with its reason."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .mesh import Mesh, numbered

AXES = ("x", "y", "z")


def _checked(values, dimension: int, what: str) -> np.ndarray:
    array = np.asarray(values)
    if array.ndim != 2 or array.shape[1] != dimension:
        raise ValueError(f"{what}: an array of n rows and {dimension} columns is wanted, not of shape {array.shape}")
    return array


def points_from_array(spark: SparkSession, values, dimension: int = 3, names: Sequence[str] = AXES) -> DataFrame:
    """idx and coordinates of an array of n points (or vectors: give other names) that the driver holds."""
    array = _checked(values, dimension, "points").astype(float)
    frame = pd.DataFrame(array, columns=list(names[:dimension]))
    frame.insert(0, "idx", np.arange(len(frame), dtype=np.int64))
    return spark.createDataFrame(frame, ", ".join(["idx long", *(f"{n} double" for n in names[:dimension])]))


def faces_from_array(spark: SparkSession, values, n_vertices: int | None = None) -> DataFrame:
    """fid, a, b, c; fails on numbers that aren't whole, are negative, or lie beyond n_vertices."""
    array = _checked(values, 3, "faces")
    whole = array.astype(np.int64)
    if (whole != array).any() or (whole < 0).any() or (n_vertices is not None and (whole >= n_vertices).any()):
        raise ValueError("faces: a corner isn't the number of a vertex")
    frame = pd.DataFrame(whole, columns=["a", "b", "c"])
    frame.insert(0, "fid", np.arange(len(frame), dtype=np.int64))
    return spark.createDataFrame(frame, "fid long, a long, b long, c long")


def mesh_from_arrays(spark: SparkSession, vertices, faces) -> Mesh:
    points = points_from_array(spark, vertices)
    return Mesh(points.withColumnRenamed("idx", "vid"), faces_from_array(spark, faces, len(vertices)))


def unflattened(df: DataFrame, values: str, dimension: int, names: Sequence[str] = AXES) -> DataFrame:
    """The other columns with idx and coordinates: a row for each point of a flat list x0, y0, .., x1, y1, ..

    Fails on a list whose length isn't a multiple of dimension; a null or empty list gives no rows.
    """
    size = F.size(values)
    odd = F.when(size % dimension != 0, F.raise_error(F.concat(F.lit(f"a flat list of points of dimension {dimension} has "), size.cast("string"), F.lit(" values"))).cast("int")).otherwise(size)
    count = (odd / dimension).cast("int")
    starts = F.when(size > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(values, k * dimension + 1, F.lit(dimension))))
    kept = [c for c in df.columns if c != values]
    rows = df.select(*kept, F.posexplode(starts).alias("idx", "_p"))
    return rows.select(*kept, F.col("idx").cast("long").alias("idx"), *(F.col("_p")[k].cast("double").alias(n) for k, n in enumerate(names[:dimension])))


def flattened(points: DataFrame, by: Sequence[str], order: str = "idx", names: Sequence[str] = AXES) -> DataFrame:
    """by and values: the coordinates of each group end to end, in order; for groups that fit in one row."""
    here = [n for n in names if n in points.columns]
    rows = F.sort_array(F.collect_list(F.struct(order, F.array(*here).alias("_p"))))
    return points.groupBy(*by).agg(F.flatten(F.transform(rows, lambda r: r["_p"])).alias("values"))


def surface_points(points: DataFrame, normals: DataFrame, key: str = "idx", names: Sequence[str] = AXES) -> DataFrame:
    """key, coordinates and unit normals (nx, ..) of points and vectors with the same keys.

    Fails where a key is on one side only and where a vector has no length.
    """
    here = [n for n in names if n in points.columns]
    both = points.select(key, *here).join(normals.select(key, *(F.col(n).alias(f"n{n}") for n in here)), key, "full_outer")
    first, vector = F.col(here[0]), [F.col(f"n{n}") for n in here]
    size = V.norm(vector)
    reason = F.when(first.isNull() | vector[0].isNull(), F.lit("a point has no normal, or a normal no point")).when(size == 0, F.lit("a normal has no length"))
    checked = F.when(reason.isNotNull(), F.raise_error(reason).cast("double")).otherwise(first)
    return both.select(key, checked.alias(here[0]), *here[1:], *((v / size).alias(f"n{n}") for v, n in zip(vector, here, strict=True)))


def indexed(points: DataFrame, order: Sequence[str]) -> DataFrame:
    """points with idx = 0, 1, .. in order of columns that together are unique; sorted over all tasks."""
    keyed = points.withColumn("_o", F.struct(*order))
    return numbered(keyed, "_o").drop("_o").withColumnRenamed("n", "idx")


def evenly_spaced(a: V.Vec, b: V.Vec, n: int, ends: bool = True) -> Column:
    """Array of n points (arrays of coordinates) from a to b; without ends they lie strictly between, as evenly spaced."""
    if n < (2 if ends else 1):
        raise ValueError("evenly spaced points: two with the ends, one without, at least")
    share = (lambda k: k / (n - 1)) if ends else (lambda k: (k + 1) / (n + 1))
    return F.array(*(F.array(*(x + (y - x) * share(k) for x, y in zip(a, b, strict=True))) for k in range(n)))
