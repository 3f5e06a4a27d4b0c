"""Aggregates: all are sums, minima or maxima that Spark combines before the shuffle, unless said otherwise."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Vec, dot


def mean_var_std_median(value: Column) -> dict[str, Column]:
    """Population variance and deviation; the exact median gathers each group's distinct values. Null for no rows."""
    return {"mean": F.avg(value), "variance": F.var_pop(value), "stdev": F.stddev_pop(value), "median": F.median(value)}


def weighted_average(value: Column, weight: Column) -> Column:
    """Null when the weights sum to zero."""
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0.0))


def mean_point(p: Vec, weight: Column | None = None) -> Vec:
    return tuple(F.avg(x) if weight is None else weighted_average(x, weight) for x in p)


def aabb(p: Vec, names: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    return [f(x).alias(f"{n}_{k}") for x, n in zip(p, names, strict=False) for f, k in ((F.min, "min"), (F.max, "max"))]


def extreme_in_direction(p: Vec, direction: Vec, order: Sequence[Column], payload: Column) -> Column:
    """payload of the point farthest along direction, the first by order of equals; NaN is ignored."""
    d = dot(p, direction)
    return F.min_by(payload, F.struct((-F.when(~F.isnan(d), d)).alias("d"), *order))


def has_nan(value: Column) -> Column:
    return F.bool_or(F.isnan(value))


def all_finite(value: Column) -> Column:
    return F.bool_and(~F.isnan(value) & (F.abs(value) < float("inf")))


def deviation_set(dev: Column) -> dict[str, Column]:
    """Largest and smallest deviation and the symmetrical zone that holds all; 0 for none."""
    top, low = F.coalesce(F.max(dev), F.lit(0.0)), F.coalesce(F.min(dev), F.lit(0.0))
    return {"max_dev": top, "min_dev": low, "zone": F.greatest(F.abs(top), F.abs(low)) * 2}


# ---- least squares ----------------------------------------------------------------------------------------------------
def line_fit(x: Column, y: Column) -> dict[str, Column]:
    return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x)}


def moments(x: Column, y: Column, degree: int, weight: Column | None = None) -> list[Column]:
    """Sums of w x^k up to 2 * degree, then of w x^k y up to degree."""
    w = F.lit(1.0) if weight is None else weight
    power = lambda k: F.pow(x, F.lit(float(k))) if k else F.lit(1.0)
    return [F.sum(w * power(k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(w * power(k) * y).alias(f"t{k}") for k in range(degree + 1)]


def quadratic_from_moments() -> list[Column]:
    """c0, c1, c2 from the columns of moments(degree=2), by Cramer's rule; null when singular."""
    s, t = [F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)]

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = F.nullif(det(s[0], s[1], s[2], s[1], s[2], s[3], s[2], s[3], s[4]), F.lit(0.0))
    return [
        det(t[0], s[1], s[2], t[1], s[2], s[3], t[2], s[3], s[4]) / whole,
        det(s[0], t[0], s[2], s[1], t[1], s[3], s[2], t[2], s[4]) / whole,
        det(s[0], s[1], t[0], s[1], s[2], t[1], s[2], s[3], t[2]) / whole,
    ]


def polynomial_fit(df: DataFrame, by: Sequence[str], x: str, y: str, degree: int, weight: str | None = None) -> DataFrame:
    """Coefficients (array, constant first) of each group by normal equations around its mean; null when singular.

    Two aggregations; what reaches Python is one row of sums for each group.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.filter(ok).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), w.alias("_w"))
    centre = rows.groupBy(*by).agg((F.sum(F.col("_x") * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_c"), F.greatest(F.max(F.abs("_x")), F.lit(1e-300)).alias("_k"))
    rows = rows.join(centre, list(by)) if by else rows.crossJoin(F.broadcast(centre))
    sums = rows.groupBy(*by, "_c", "_k").agg(*moments((F.col("_x") - F.col("_c")) / F.col("_k"), F.col("_y"), degree, F.col("_w")))

    @F.pandas_udf("array<double>")
    def solve(values: pd.Series, centres: pd.Series, scales: pd.Series) -> pd.Series:
        out = []
        for v, c, k in zip(values, centres, scales, strict=True):
            s, t = np.asarray(v[: 2 * degree + 1]), np.asarray(v[2 * degree + 1 :])
            a = np.array([[s[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            if np.linalg.matrix_rank(a) <= degree:
                out.append(None)
                continue
            local = np.polynomial.Polynomial(np.linalg.solve(a, t))
            full = local(np.polynomial.Polynomial([-c / k, 1.0 / k]))
            out.append(np.pad(np.atleast_1d(full.coef), (0, degree + 1))[: degree + 1].tolist())
        return pd.Series(out)

    names = [f"s{k}" for k in range(2 * degree + 1)] + [f"t{k}" for k in range(degree + 1)]
    return sums.select(*by, solve(F.array(*names), "_c", "_k").alias("coefficients"))


# ---- principal components ----------------------------------------------------------------------------------------------
def covariance(p: Vec, names: Sequence[str], weight: Column | None = None) -> list[Column]:
    """n, centre and population covariances as columns n, c_<i>, v_<i><j>."""
    if weight is None:
        pairs = [F.covar_pop(p[i], p[j]).alias(f"v_{names[i]}{names[j]}") for i in range(len(p)) for j in range(i, len(p))]
        return [F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"c_{n}") for x, n in zip(p, names, strict=True)), *pairs]
    total = F.nullif(F.sum(weight), F.lit(0.0))
    mean = [F.sum(x * weight) / total for x in p]
    pairs = [(F.sum(p[i] * p[j] * weight) / total - mean[i] * mean[j]).alias(f"v_{names[i]}{names[j]}") for i in range(len(p)) for j in range(i, len(p))]
    return [F.count(F.lit(1)).alias("n"), *(m.alias(f"c_{n}") for m, n in zip(mean, names, strict=True)), *pairs]


BASIS = "struct<center:array<double>,basis:array<array<double>>,variances:array<double>,stdevs:array<double>,rank:int,n:long>"


def principal_axes(df: DataFrame, by: Sequence[str], names: Sequence[str], weight: str | None = None, tol: float = 1e-12) -> DataFrame:
    """Centre, axes (largest variance first, right-handed in 3D), variances and rank of each group's points.

    The rows are summed up in the JVM; Python decomposes one small matrix for each group.
    """
    sums = df.groupBy(*by).agg(*covariance(tuple(F.col(n) for n in names), names, F.col(weight) if weight else None))
    k = len(names)

    @F.pandas_udf(BASIS)
    def axes(n: pd.Series, centre: pd.Series, cov: pd.Series) -> pd.DataFrame:
        out = []
        for count, c, v in zip(n, centre, cov, strict=True):
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = v
            m = m + m.T - np.diag(np.diag(m))
            values, vectors = np.linalg.eigh(m)
            values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
            if k == 3:
                vectors[2] = np.cross(vectors[0], vectors[1])
            rank = int((values > tol * max(values[0], 1e-300)).sum()) if values[0] > 0 else 0
            out.append((list(c), vectors.tolist(), values.tolist(), np.sqrt(values).tolist(), rank, int(count)))
        return pd.DataFrame(out, columns=["center", "basis", "variances", "stdevs", "rank", "n"])

    cov = F.array(*(f"v_{names[i]}{names[j]}" for i in range(k) for j in range(i, k)))
    return sums.select(*by, axes("n", F.array(*(f"c_{n}" for n in names)), cov).alias("pca"))


def to_basis(p: Vec, centre: Sequence[Column], basis: Sequence[Sequence[Column]]) -> Vec:
    d = tuple(x - c for x, c in zip(p, centre, strict=True))
    return tuple(dot(d, row) for row in basis)


# ---- circles -----------------------------------------------------------------------------------------------------------
def circle_moments(x: Column, y: Column) -> list[Column]:
    z = x * x + y * y
    terms = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "z": z, "xz": x * z, "yz": y * z}
    return [F.sum(v).alias(f"m_{k}") for k, v in terms.items()]


#: Circles of so many groups go to every task (some 10 MB); those of more are joined.
FEW_GROUPS = 100_000
#: Gauss-Newton steps between two cuts of lineage.
STEPS = 4


def circle_fit(df: DataFrame, by: Sequence[str], x: str, y: str, rounds: int = 20) -> DataFrame:
    """Geometric least-squares circle (cx, cy, radius) of each group: an algebraic start, then Gauss-Newton steps.

    Each step is one aggregation of 3x3 sums; all steps of all groups run together.
    """
    points = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    mean = points.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    link = (lambda a, b: a.join(b, list(by))) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))
    rows = link(points, mean)
    local = rows.groupBy(*by, "_mx", "_my").agg(*circle_moments(F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")))

    @F.pandas_udf("struct<cx:double,cy:double,r:double>")
    def start(m: pd.Series) -> pd.DataFrame:
        out = []
        for n, sx, sy, xx, yy, xy, z, xz, yz in m:
            a = np.array([[xx, xy, sx], [xy, yy, sy], [sx, sy, n]])
            if np.linalg.matrix_rank(a) < 3:
                out.append((None, None, None))
                continue
            u, v, w = np.linalg.solve(a, [xz, yz, z])
            out.append((u / 2, v / 2, float(np.sqrt(w + u * u / 4 + v * v / 4))))
        return pd.DataFrame(out, columns=["cx", "cy", "r"])

    @F.pandas_udf("struct<cx:double,cy:double,r:double,moved:double>")
    def step(c: pd.DataFrame, m: pd.Series) -> pd.DataFrame:
        out = []
        for cx, cy, r, v in zip(c["cx"], c["cy"], c["r"], m, strict=True):
            n, sx, sy, xx, yy, xy, e, ex, ey = v
            a = np.array([[xx, xy, sx], [xy, yy, sy], [sx, sy, n]])
            d = np.linalg.lstsq(a, np.array([ex, ey, e]), rcond=None)[0]
            out.append((cx + d[0], cy + d[1], r + d[2], float(np.abs(d).max())))
        return pd.DataFrame(out, columns=["cx", "cy", "r", "moved"])

    names = [f"m_{k}" for k in ("n", "x", "y", "xx", "yy", "xy", "z", "xz", "yz")]
    fit = local.select(*by, "_mx", "_my", start(F.array(*names)).alias("c")).filter("c.cx is not null")
    fit = fit.select(*by, F.struct((F.col("c.cx") + F.col("_mx")).alias("cx"), (F.col("c.cy") + F.col("_my")).alias("cy"), F.col("c.r").alias("r")).alias("c"))
    from .checkpoints import cut

    fit, done = cut(fit, "circle"), 0
    few = by and fit.count() <= FEW_GROUPS
    while done < rounds:
        for _ in range(min(STEPS, rounds - done)):  # some steps are one job: each joins the one before it to the points
            near = link(points, F.broadcast(fit) if few else fit)
            d = F.nullif(F.sqrt(F.pow(F.col("_x") - F.col("c.cx"), 2) + F.pow(F.col("_y") - F.col("c.cy"), 2)), F.lit(0.0))
            ux, uy, e = (F.col("_x") - F.col("c.cx")) / d, (F.col("_y") - F.col("c.cy")) / d, d - F.col("c.r")
            terms = [F.lit(1.0), ux, uy, ux * ux, uy * uy, ux * uy, e, e * ux, e * uy]
            sums = near.groupBy(*by, "c").agg(*(F.sum(t).alias(n) for t, n in zip(terms, names, strict=True)))
            state = sums.select(*by, step("c", F.array(*names)).alias("s"))
            fit = state.select(*by, F.struct("s.cx", "s.cy", "s.r").alias("c"))
            done += 1
        state = cut(state, "circle")
        fit = state.select(*by, F.struct("s.cx", "s.cy", "s.r").alias("c"))
        moved = state.agg(F.max("s.moved")).first()[0]
        if moved is None or moved < 1e-12:
            break
    return fit.select(*by, F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"), F.col("c.r").alias("radius"))


def circle_ransac(df: DataFrame, x: str, y: str, tol: float, iterations: int = 400, seed: int = 7, sample: int = 4096, min_radius: float = 0.0, max_radius: float = float("inf")) -> tuple[float, float, float, int]:
    """(cx, cy, radius, inliers) of the circle with the most points within tol, of those with a radius between the bounds.

    Candidates come from triples of a bounded random sample of points; every candidate is counted over all rows in one pass.
    """
    picked = df.select(F.col(x).cast("double"), F.col(y).cast("double")).orderBy(F.xxhash64(x, y, F.lit(seed))).limit(sample).collect()
    pts, rng, circles = np.array([tuple(r) for r in picked]), np.random.default_rng(seed), []
    for _ in range(iterations):
        a, b, c = pts[rng.choice(len(pts), 3, replace=False)]
        m = np.array([b - a, c - a]) * 2
        if abs(np.linalg.det(m)) > 1e-12:
            u = np.linalg.solve(m, [(b - a) @ (b - a), (c - a) @ (c - a)])
            if min_radius <= (r := float(np.hypot(*u))) <= max_radius:
                circles.append((*(a + u), r))
    if not circles:
        raise ValueError("no three points that aren't in line make a circle between the bounds")
    table = np.array(circles)

    def count(batches):
        total = np.zeros(len(table), np.int64)
        for batch in batches:
            p = batch.to_numpy(float)
            for s in range(0, len(p), 2048):
                d = np.hypot(p[s : s + 2048, None, 0] - table[None, :, 0], p[s : s + 2048, None, 1] - table[None, :, 1])
                total += (np.abs(d - table[None, :, 2]) <= tol).sum(axis=0)
        yield pd.DataFrame({"k": np.arange(len(table)), "n": total})

    best = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").first()
    return (*(float(v) for v in table[best["k"]]), int(best["n"]))
