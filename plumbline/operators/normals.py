"""Normals and smoothing from neighbourhoods: a radius join, sums in the JVM, one small matrix a point in Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .joins import finite, neighbours
from .mesh import Mesh

SUMS = ["n", "x", "y", "z", "xx", "yy", "zz", "xy", "xz", "yz"]


def _plane(s: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, normal, planarity) from SUMS of each neighbourhood."""
    v = np.stack(s.to_numpy()).astype(float)
    n = np.maximum(v[:, 0], 1)
    c = v[:, 1:4] / n[:, None]
    m = np.empty((len(v), 3, 3))
    for k, (i, j) in enumerate(((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))):
        m[:, i, j] = m[:, j, i] = v[:, 4 + k] / n - c[:, i] * c[:, j]
    values, vectors = np.linalg.eigh(m)
    flat = np.where(values[:, 1] > 1e-300, 1 - np.maximum(values[:, 0], 0) / np.maximum(values[:, 1], 1e-300), 0)
    return c, vectors[:, :, 0], flat


def _sums_of(prefix: str, weight: Column | None = None) -> list:
    x, y, z = (F.col(f"{prefix}{c}") for c in "xyz")
    terms = [F.lit(1.0), x, y, z, x * x, y * y, z * z, x * y, x * z, y * z]
    return [F.sum(t if weight is None else t * weight).alias(f"_s{k}") for k, t in enumerate(terms)]


def _normal(s: pd.Series, guide: pd.Series) -> pd.DataFrame:
    _, n, flat = _plane(s)
    g = np.stack(guide.to_numpy()).astype(float)
    n = np.where(((n * g).sum(1) < 0)[:, None], -n, n)
    few = np.stack(s.to_numpy())[:, 0] < 3
    n, flat = np.where(few[:, None], [0.0, 0.0, 1.0], n), np.where(few, 0.0, flat)
    return pd.DataFrame({"nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "confidence": flat})


def estimate_normals(points: DataFrame, key: str, radius: float, guide=("0.0", "0.0", "1.0")) -> DataFrame:
    """key, nx, ny, nz, confidence: the normal of the plane through the points within radius, turned to the guide's side.

    guide: three columns (or numbers as text). Fewer than three neighbours: (0, 0, 1) and confidence 0. Sums are taken
    around each point itself, so that far-off coordinates lose no digits. Equal points are one, with their number as weight.
    """
    names = ["x", "y", "z"]
    exact = [F.col(c).cast("double").alias(c) for c in names]
    places = cut(finite(points, names).select(*exact).groupBy(*names).agg(F.count("*").cast("double").alias("n")), "places")
    local = neighbours(places, places, names, radius).select(*(F.col(f"_l_{c}").alias(c) for c in names), F.col("_r_n").alias("_w"), *((F.col(f"_r_{c}") - F.col(f"_l_{c}")).alias(f"_d{c}") for c in names))
    sums = local.groupBy(*names).agg(*_sums_of("_d", F.col("_w")))
    to = points.select(F.col(key).alias("_key"), *exact, F.array(*(F.expr(g).cast("double") for g in guide)).alias("_g"))
    normal = F.pandas_udf(_normal, "struct<nx:double,ny:double,nz:double,confidence:double>")
    return to.join(sums, names).select(F.col("_key").alias(key), normal(F.array(*(f"_s{k}" for k in range(10))), "_g").alias("r")).select(key, "r.*")


def _drop(s: pd.Series, p: pd.Series) -> pd.DataFrame:
    c, n, _ = _plane(s)
    q = np.stack(p.to_numpy()).astype(float)
    few = np.stack(s.to_numpy())[:, 0] < 3
    out = np.where(few[:, None], q, q - ((q - c) * n).sum(1)[:, None] * n)
    return pd.DataFrame(out, columns=["x", "y", "z"])


def smooth_neighbourhood(mesh: Mesh) -> Mesh:
    """Each vertex moved onto the plane fitted to it and the vertices it shares a face with."""
    pair = mesh.faces.select(F.explode(F.array(*(F.struct(F.col(a).alias("vid"), F.col(b).alias("other")) for a in "abc" for b in "abc"))).alias("p")).select("p.*").distinct()
    near = mesh.vertices.select(F.col("vid").alias("other"), *(F.col(c).alias(f"_q{c}") for c in "xyz"))
    sums = pair.join(near, "other").groupBy("vid").agg(*_sums_of("_q"))
    rows = mesh.vertices.join(sums, "vid", "left")
    zero = F.array(*(F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) for k in range(10)))
    drop = F.pandas_udf(_drop, "struct<x:double,y:double,z:double>")
    return Mesh(rows.select("vid", drop(zero, F.array("x", "y", "z")).alias("p")).select("vid", "p.*"), mesh.faces)
