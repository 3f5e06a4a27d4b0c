"""Rasters: rows (raster key columns, row, col, v); an invalid pixel has no row (or a null or NaN value).

Small neighbourhoods are equi-joins on shifted pixels. Larger ones work on square tiles with a margin: a pixel goes to
its own tile and to those whose margin it is in, so a task holds one tile whatever the raster's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .graph import connected_components, grid_links

Keys = Sequence[str]
TILE = 256


def tiled(df: DataFrame, by: Keys, halo: int, work: Callable[[np.ndarray, int, int], np.ndarray], tile: int = TILE, every_pixel: bool = False) -> DataFrame:
    """Apply work(tile with margins, first row, first col) -> array of the same shape, NaN for invalid, to each tile.

    The result has the pixels that were valid before, or with every_pixel all that work makes valid.
    """
    if halo >= tile:
        tile = halo + 1
    grid = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - halo) / tile), F.floor(F.col(c) / tile), F.floor((F.col(c) + halo) / tile)))
    rows = df.filter(F.col("v").isNotNull()).select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))
    spread = rows.withColumn("_tr", F.explode(grid("row"))).withColumn("_tc", F.explode(grid("col")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["_tr"].iloc[0]) * tile - halo, int(pdf["_tc"].iloc[0]) * tile - halo
        size = tile + 2 * halo
        dense = np.full((size, size), np.nan)
        dense[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf["v"].to_numpy()
        out = work(dense, r0, c0)
        if not every_pixel:
            out = np.where(np.isnan(dense), np.nan, out)
        i, j = np.nonzero(~np.isnan(out[halo : halo + tile, halo : halo + tile]))
        res = pd.DataFrame({"row": i + r0 + halo, "col": j + c0 + halo, "v": out[i + halo, j + halo]})
        for n in reversed(by):
            res.insert(0, n, pdf[n].iloc[0])
        return res

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in by), "row long, col long, v double"])
    return spread.groupBy(*by, "_tr", "_tc").applyInPandas(run, schema)


# ---- convolution -------------------------------------------------------------------------------------------------------
def gaussian_kernel(sigma: float, size: int | None = None, half_pixel_shift: bool = False) -> np.ndarray:
    """Odd-sized, of sum one, centred on its middle pixel; with half_pixel_shift centred on size / 2."""
    size = size or int(np.ceil(6 * sigma)) | 1
    at = np.arange(size) - (size / 2 if half_pixel_shift else (size - 1) / 2)
    k = np.exp(-0.5 * (at / sigma) ** 2)
    return np.outer(k, k) / k.sum() ** 2


def kernel_for(sigma: float, px_size: float) -> np.ndarray:
    """A Gaussian of a physical size."""
    if px_size <= 0 or sigma <= 0:
        raise ValueError("sizes must be positive")
    return gaussian_kernel(sigma / px_size)


def _shifted_sum(dense: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    h, w = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(dense, ((h, h), (w, w)))
    out = np.zeros_like(dense)
    for i in range(kernel.shape[0]):
        for j in range(kernel.shape[1]):
            if kernel[i, j]:
                out += kernel[i, j] * padded[i : i + dense.shape[0], j : j + dense.shape[1]]
    return out


def convolve(df: DataFrame, by: Keys, kernel: np.ndarray, every_pixel: bool = False) -> DataFrame:
    """Sum of values times weights, over the sum of the valid pixels' weights and that of all weights (without signs)."""
    whole = np.abs(kernel).sum()

    def work(dense, r0, c0):
        valid = ~np.isnan(dense)
        top, low = _shifted_sum(np.where(valid, dense, 0.0), kernel), _shifted_sum(valid.astype(float), np.abs(kernel))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(low > 1e-15, top / low / whole, np.nan)

    return tiled(df, by, max(kernel.shape) // 2, work, every_pixel=every_pixel)


def shifted(df: DataFrame, by: Keys, offsets: Sequence[tuple[int, int]], weights: Sequence[float] | None = None) -> DataFrame:
    """Each pixel sent to the pixels that have it as neighbour: by, row, col, w, v of the neighbour at (row + dr, col + dc)."""
    weights = weights or [1.0] * len(offsets)
    to = F.array(*(F.struct(F.lit(-r).alias("r"), F.lit(-c).alias("c"), F.lit(float(w)).alias("w")) for (r, c), w in zip(offsets, weights, strict=True)))
    return df.select(*by, "row", "col", "v", F.explode(to).alias("o")).select(*by, (F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col"), F.col("o.w").alias("w"), "v")


def convolve_small(df: DataFrame, by: Keys, kernel: Sequence[Sequence[float]]) -> DataFrame:
    """Mask-normalised weighted mean over a small kernel of positive weights, in one aggregation and a semi-join."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    offsets = [(i - h, j - w) for i in range(len(kernel)) for j in range(len(kernel[0]))]
    weights = [kernel[i][j] for i in range(len(kernel)) for j in range(len(kernel[0]))]
    sums = shifted(df, by, offsets, weights).groupBy(*by, "row", "col").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return sums.join(df.select(*by, "row", "col"), [*by, "row", "col"], "left_semi")


# ---- masks ------------------------------------------------------------------------------------------------------------
def _offsets(metric: str) -> list[tuple[int, int]]:
    return [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if metric == "linf" or abs(r) + abs(c) <= 1]


def dilate(mask: DataFrame, by: Keys, steps: int = 1, metric: str = "l1", alternating: bool = False) -> DataFrame:
    """mask (by, row, col) grown by steps; alternating L-infinity and L1 steps make an octagon."""
    out = mask.select(*by, "row", "col")
    for k in range(steps):
        m = ("linf", "l1")[k % 2] if alternating else metric
        out = shifted(out.withColumn("v", F.lit(1.0)), by, _offsets(m)).select(*by, "row", "col").distinct()
    return out


def erode(mask: DataFrame, by: Keys, steps: int = 1, metric: str = "l1", alternating: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """Pixels all of whose neighbours are in the mask. shape: pixels outside a raster of so many rows and columns don't count against it."""
    out = mask.select(*by, "row", "col")
    for k in range(steps):
        offsets = _offsets(("linf", "l1")[k % 2] if alternating else metric)
        hits = shifted(out.withColumn("v", F.lit(1.0)), by, offsets).groupBy(*by, "row", "col").agg(F.count("*").alias("n"))
        if shape:
            inside = sum(((F.col("row") + r).between(0, shape[0] - 1) & (F.col("col") + c).between(0, shape[1] - 1)).cast("int") for r, c in offsets)
        else:
            inside = F.lit(len(offsets))
        out = out.join(hits.filter(F.col("n") == inside).select(*by, "row", "col"), [*by, "row", "col"], "left_semi")
    return out


def border_of(mask: DataFrame, by: Keys) -> DataFrame:
    e = erode(mask, by)
    return mask.join(e, [*by, "row", "col"], "left_anti")


def blank(df: DataFrame, mask: DataFrame, by: Keys) -> DataFrame:
    return df.join(mask, [*by, "row", "col"], "left_anti")


def clear_border(df: DataFrame, rows: int, cols: int) -> DataFrame:
    return df.filter(F.col("row").between(1, rows - 2) & F.col("col").between(1, cols - 2))


def rectangle(spark, top: int, left: int, height: int, width: int) -> DataFrame:
    r = spark.range(height).select((F.col("id") + top).alias("row"))
    return r.withColumn("col", F.explode(F.sequence(F.lit(left).cast("long"), F.lit(left + width - 1).cast("long"))))


def disk(spark, row: float, col: float, radius: float) -> DataFrame:
    box = rectangle(spark, int(np.floor(row - radius)), int(np.floor(col - radius)), int(2 * radius) + 3, int(2 * radius) + 3)
    return box.filter(F.pow(F.col("row") - row, 2) + F.pow(F.col("col") - col, 2) <= radius * radius)


def polygon(spark, corners: Sequence[tuple[float, float]]) -> DataFrame:
    """Pixels whose centre is inside a polygon of (row, col) corners, by the even-odd rule."""
    rr, cc = [c[0] for c in corners], [c[1] for c in corners]
    box = rectangle(spark, int(np.floor(min(rr))), int(np.floor(min(cc))), int(max(rr) - min(rr)) + 2, int(max(cc) - min(cc)) + 2)
    inside = F.lit(0)
    for (r0, c0), (r1, c1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if r0 != r1:
            crosses = ((F.col("row") >= min(r0, r1)) & (F.col("row") < max(r0, r1))) & (F.col("col") < (F.col("row") - r0) * ((c1 - c0) / (r1 - r0)) + c0)
            inside = inside + crosses.cast("int")
    return box.filter(inside % 2 == 1)


# ---- regions ----------------------------------------------------------------------------------------------------------
def _pixel_key(df: DataFrame, by: Keys) -> Column:
    """One number for each pixel: 31 bits of row and 32 of column, behind the raster's place among the rasters."""
    return (F.col("row").cast("long") + (1 << 20)) * (1 << 22) + (F.col("col").cast("long") + (1 << 20))


def regions(mask: DataFrame, diagonal: bool = False) -> DataFrame:
    """row, col, label: connected pixels of one raster (4 neighbours, or 8); labels are places of first pixels, row by row."""
    keyed = mask.select("row", "col").distinct().withColumn("_k", _pixel_key(mask, ()))
    found = connected_components(grid_links(keyed, "_k", ("row", "col"), diagonal), keyed.select(F.col("_k").alias("node")))
    return keyed.join(found, keyed["_k"] == found["node"]).select("row", "col", F.col("root").alias("label"))


def region_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))


def flood_fill(mask: DataFrame, rows: int, cols: int, seeds: DataFrame | None = None, diagonal: bool = False) -> DataFrame:
    """row, col of the pixels outside mask that are connected to the seeds (row, col), or to the raster's border."""
    spark = mask.sparkSession
    open_ = rectangle(spark, 0, 0, rows, cols).join(mask, ["row", "col"], "left_anti")
    found = cut(regions(open_, diagonal), "regions")
    if seeds is None:
        start = found.filter((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == rows - 1) | (F.col("col") == cols - 1))
    else:
        start = found.join(seeds, ["row", "col"], "left_semi")
    return found.join(start.select("label").distinct(), "label", "left_semi").select("row", "col")


def _thin_step(a: np.ndarray, second: bool) -> np.ndarray:
    p = np.pad(a, 1)
    n = [p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]]
    count = sum(x.astype(int) for x in n)
    turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
    if second:
        free = ~(n[0] & n[2] & n[6]) & ~(n[0] & n[4] & n[6])
    else:
        free = ~(n[0] & n[2] & n[4]) & ~(n[2] & n[4] & n[6])
    return a & ~((count >= 2) & (count <= 6) & (turns == 1) & free)


def thin(mask: DataFrame, by: Keys, steps: int = 8) -> DataFrame:
    """Zhang-Suen skeleton. A pass does several steps on tiles whose margin covers them; passes go on until nothing changes."""

    def work(dense, r0, c0):
        a = ~np.isnan(dense)
        for _ in range(steps):
            for second in (False, True):
                a = _thin_step(a, second)
        return np.where(a, 1.0, np.nan)

    state = cut(mask.select(*by, "row", "col").withColumn("v", F.lit(1.0)), "thin")
    n = state.count()
    while True:
        state = cut(tiled(state, by, 2 * steps + 2, work), "thin")
        m = state.count()
        if m == n:
            return state.select(*by, "row", "col")
        n = m


# ---- neighbourhoods ---------------------------------------------------------------------------------------------------
def octagon(radius: int) -> np.ndarray:
    """What alternating L-infinity and L1 steps reach from a pixel."""
    a = np.zeros((2 * radius + 1,) * 2, bool)
    a[radius, radius] = True
    for k in range(radius):
        p = np.pad(a, 1)
        a = p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:] | a | ((p[:-2, :-2] | p[:-2, 2:] | p[2:, :-2] | p[2:, 2:]) if k % 2 == 0 else False)
    return a


def area_average(df: DataFrame, by: Keys, radius: int) -> DataFrame:
    """Mean of the valid pixels around, in an octagon."""
    kernel = octagon(radius).astype(float)
    return convolve(df, by, kernel / kernel.sum())


def area_filtered(df: DataFrame, by: Keys, radius: int) -> DataFrame:
    """What a local mean leaves."""
    blur = area_average(df, by, radius).withColumnRenamed("v", "_blur")
    return df.join(blur, [*by, "row", "col"]).select(*by, "row", "col", (F.col("v") - F.col("_blur")).alias("v"))


def ball(radius: float, px_size: float) -> np.ndarray:
    """Height of a ball's lower side above its lowest point, by pixel; infinite outside."""
    n = int(np.floor(radius / px_size))
    at = np.arange(-n, n + 1) * px_size
    d2 = at[:, None] ** 2 + at[None] ** 2
    with np.errstate(invalid="ignore"):
        return np.where(d2 <= radius * radius, radius - np.sqrt(np.maximum(radius * radius - d2, 0)), np.inf)


def rolling_ball(df: DataFrame, by: Keys, radius: float, px_size: float) -> DataFrame:
    """Background: the lowest that a ball rolling over the surface gets at each pixel; a scratch it can't enter is bridged."""
    b = ball(radius, px_size)
    n = len(b) // 2
    offsets = list(zip(*np.nonzero(np.isfinite(b)), strict=True))

    def work(dense, r0, c0):
        rows, cols = dense.shape
        p = np.pad(np.where(np.isnan(dense), -np.inf, dense), n, constant_values=-np.inf)
        rest = np.full(dense.shape, -np.inf)  # height of the ball's lowest point when it rests over a pixel
        for i, j in offsets:
            rest = np.maximum(rest, p[i : i + rows, j : j + cols] - b[i, j])
        p = np.pad(np.where(np.isfinite(rest), rest, np.inf), n, constant_values=np.inf)
        out = np.full(dense.shape, np.inf)
        for i, j in offsets:
            out = np.minimum(out, p[i : i + rows, j : j + cols] + b[i, j])
        return out

    return tiled(df, by, 2 * n, work)


def bilinear(df: DataFrame, queries: DataFrame, by: Keys, key: str, y: str = "y", x: str = "x") -> DataFrame:
    """by, key, v at fractional (row y, col x) for each query; null where one of the pixels around that weigh is missing.

    The pixels are brought together to cells of four first, so each query meets its cell in one join.
    """
    to = F.array(*(F.struct((F.col("row").cast("long") - i).alias("r"), (F.col("col").cast("long") - j).alias("c"), F.lit(2 * i + j).alias("k")) for i in (0, 1) for j in (0, 1)))
    spread = df.select(*by, F.col("v").cast("double").alias("v"), F.explode(to).alias("o")).select(*by, F.col("o.r").alias("_r"), F.col("o.c").alias("_c"), F.col("o.k").alias("k"), "v")
    cells = spread.groupBy(*by, "_r", "_c").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"_v{k}") for k in range(4)))
    r, c = F.floor(F.col(y)).cast("long"), F.floor(F.col(x)).cast("long")
    fr, fc = F.col(y) - F.floor(F.col(y)), F.col(x) - F.floor(F.col(x))
    rows = queries.select(*by, key, r.alias("_r"), c.alias("_c"), fr.alias("_fr"), fc.alias("_fc"))
    weighed = []
    for i in (0, 1):
        for j in (0, 1):
            w = (F.col("_fr") if i else 1 - F.col("_fr")) * (F.col("_fc") if j else 1 - F.col("_fc"))
            weighed.append(F.when(w > 0, w * F.col(f"_v{2 * i + j}")).otherwise(0.0))
    value = weighed[0] + weighed[1] + weighed[2] + weighed[3]
    return rows.join(cells, [*by, "_r", "_c"], "left").select(*by, key, value.alias("v"))


def trace(spark, row: float, col: float, d_row: float, d_col: float, radius: int) -> DataFrame:
    """i, t, y, x: places one pixel apart along a direction, radius to either side; sample them with bilinear."""
    size = float(np.hypot(d_row, d_col))
    t = F.col("id") - radius
    return spark.range(2 * radius + 1).select(F.col("id").alias("i"), t.cast("double").alias("t"), (F.lit(row) + t * (d_row / size)).alias("y"), (F.lit(col) + t * (d_col / size)).alias("x"))


def subtract(a: DataFrame, b: DataFrame, by: Keys, limits: tuple[float, float] | None = None) -> DataFrame:
    """a - b where both are valid; fails outside limits."""
    d = F.col("v") - F.col("_b")
    if limits:
        d = F.when(d.between(*limits), d).otherwise(F.raise_error(F.lit("a difference is outside the z limits")).cast("double"))
    return a.join(b.withColumnRenamed("v", "_b"), [*by, "row", "col"]).select(*by, "row", "col", d.alias("v"))


def resized(df: DataFrame, by: Keys, factor: float) -> DataFrame:
    """Nearest pixel of a raster scaled by factor."""
    if factor <= 1:
        rows = df.withColumn("_r", F.floor((F.col("row") + 0.5) * factor).cast("long")).withColumn("_c", F.floor((F.col("col") + 0.5) * factor).cast("long"))
        far = F.abs((F.col("_r") + 0.5) / factor - F.col("row") - 0.5) + F.abs((F.col("_c") + 0.5) / factor - F.col("col") - 0.5)
        return rows.groupBy(*by, F.col("_r").alias("row"), F.col("_c").alias("col")).agg(F.min_by("v", F.struct(far, F.col("row"), F.col("col"))).alias("v"))
    n = int(np.ceil(factor)) + 1
    span = lambda c: F.sequence(F.floor(F.col(c) * factor).cast("long"), F.floor(F.col(c) * factor).cast("long") + n)
    rows = df.withColumn("_r", F.explode(span("row"))).withColumn("_c", F.explode(span("col")))
    own = (F.floor((F.col("_r") + 0.5) / factor) == F.col("row")) & (F.floor((F.col("_c") + 0.5) / factor) == F.col("col"))
    return rows.filter(own).select(*by, F.col("_r").alias("row"), F.col("_c").alias("col"), "v")


def from_points(points: DataFrame, by: Keys, px_size: float, origin: tuple[float, float] = (0.0, 0.0), value: str = "z") -> DataFrame:
    """Mean, deviation and count of the points in each pixel."""
    r, c = F.floor((F.col("y") - origin[1]) / px_size).cast("long"), F.floor((F.col("x") - origin[0]) / px_size).cast("long")
    return points.groupBy(*by, r.alias("row"), c.alias("col")).agg(F.avg(value).alias("v"), F.stddev_pop(value).alias("stdev"), F.count("*").alias("n"))


def depth_mesh(df: DataFrame, px_size: float) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of one raster: two triangles where four pixels are valid, one where three are."""
    key = _pixel_key(df, ())
    vertices = df.select(key.alias("vid"), (F.col("col") * px_size).alias("x"), (F.col("row") * px_size).alias("y"), F.col("v").alias("z"))
    corner = lambda r, c: _corner(df, r, c)
    quads = corner(0, 0).join(corner(0, 1), ["row", "col"], "full").join(corner(1, 0), ["row", "col"], "full").join(corner(1, 1), ["row", "col"], "full")
    n = sum((F.col(k).isNotNull().cast("int") for k in ("p00", "p01", "p10", "p11")), F.lit(0))
    tri = lambda a, b, c: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(c).alias("c"))
    made = F.array(tri("p00", "p01", "p11"), tri("p00", "p11", "p10"), tri("p00", "p01", "p10"), tri("p01", "p11", "p10"))
    four = F.col("p00").isNotNull() & F.col("p11").isNotNull()
    chosen = F.when(four, F.slice(made, 1, 2)).otherwise(F.slice(made, 3, 2))
    faces = quads.filter(n >= 3).select(F.explode(F.filter(chosen, lambda t: t["a"].isNotNull() & t["b"].isNotNull() & t["c"].isNotNull())).alias("t"))
    return vertices, faces.select(F.monotonically_increasing_id().alias("fid"), "t.a", "t.b", "t.c")


def _corner(df: DataFrame, r: int, c: int) -> DataFrame:
    key = _pixel_key(df, ())
    return df.select((F.col("row") - r).alias("row"), (F.col("col") - c).alias("col"), key.alias(f"p{r}{c}"))


# ---- inpainting --------------------------------------------------------------------------------------------------------
def inpaint_array(values: np.ndarray, holes: np.ndarray, radius: int) -> np.ndarray:
    """Fill holes from their rims inwards (fast marching): each pixel is the mean of what is known around, weighted by
    how near it is, how close to the same front, and how far along the front's direction."""
    out, known = np.where(holes, np.nan, values), ~holes & ~np.isnan(values)
    far = np.where(known, 0.0, np.inf)
    rows, cols = values.shape
    heap = [(0.0, int(i), int(j)) for i, j in zip(*np.nonzero(known), strict=True) if holes[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].any()]
    heapq.heapify(heap)
    around = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j <= radius * radius]

    def solve(i: int, j: int) -> float:
        v = min(far[i - 1, j] if i else np.inf, far[i + 1, j] if i + 1 < rows else np.inf)
        h = min(far[i, j - 1] if j else np.inf, far[i, j + 1] if j + 1 < cols else np.inf)
        a, b = min(v, h), max(v, h)
        return a + 1 if b - a >= 1 or np.isinf(b) else (a + b + np.sqrt(2 - (a - b) ** 2)) / 2

    while heap:
        d, i, j = heapq.heappop(heap)
        if d > far[i, j]:
            continue
        if holes[i, j] and np.isnan(out[i, j]):
            gi = (far[min(i + 1, rows - 1), j] - far[max(i - 1, 0), j]) if 0 < i < rows - 1 else 0.0
            gj = (far[i, min(j + 1, cols - 1)] - far[i, max(j - 1, 0)]) if 0 < j < cols - 1 else 0.0
            gi, gj = (0.0 if not np.isfinite(x) else x for x in (gi, gj))
            top = low = 0.0
            for di, dj in around:
                k, m = i + di, j + dj
                if 0 <= k < rows and 0 <= m < cols and not np.isnan(out[k, m]):
                    size = di * di + dj * dj
                    along = abs(di * gi + dj * gj) / np.sqrt(size) + 1e-6
                    w = along / size / (1 + abs(far[k, m] - far[i, j]))
                    top, low = top + w * out[k, m], low + w
            if low:
                out[i, j] = top / low
        for k, m in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
            if 0 <= k < rows and 0 <= m < cols and holes[k, m]:
                t = solve(k, m)
                if t < far[k, m] - 1e-12:
                    far[k, m] = t
                    heapq.heappush(heap, (t, k, m))
    return out


def inpaint(df: DataFrame, holes: DataFrame, by: Keys, radius: int = 5) -> DataFrame:
    """df with the pixels of holes (by, row, col) filled. The march is sequential, so a raster is one group."""
    rows = df.join(holes, [*by, "row", "col"], "left_anti").select(*by, "row", "col", "v", F.lit(False).alias("hole"))
    rows = rows.unionByName(holes.select(*by, "row", "col", F.lit(None).cast("double").alias("v"), F.lit(True).alias("hole")))
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        shape = (int(r.max() - r.min()) + 1, int(c.max() - c.min()) + 1)
        values, hole = np.full(shape, np.nan), np.zeros(shape, bool)
        values[r - r.min(), c - c.min()], hole[r - r.min(), c - c.min()] = pdf["v"].to_numpy(float), pdf["hole"].to_numpy(bool)
        return pdf.assign(v=inpaint_array(values, hole, radius)[r - r.min(), c - c.min()]).drop(columns="hole")

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in by), "row long, col long, v double"])
    rows = rows.select(*by, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"), "hole")
    if by:
        return rows.groupBy(*by).applyInPandas(run, schema).filter("not isnan(v)")
    return rows.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda pdf: run(pdf)[["row", "col", "v"]], schema).filter("not isnan(v)")


def erode_from_border(df: DataFrame, by: Keys, rows: int, cols: int, steps: int) -> DataFrame:
    """df without the valid pixels that are within so many steps of the invalid area around the raster's border; holes inside stay as they are."""
    outside = flood_fill(df.select("row", "col"), rows, cols)
    reach = dilate(outside, (), steps)
    return df.join(reach, ["row", "col"], "left_anti")


def convolve_fast(df: DataFrame, by: Keys, sigma: float, target: float = 2.0) -> DataFrame:
    """A wide Gaussian by its shrunk raster: block means, a Gaussian of about target pixels, and the nearest block's value."""
    factor = max(1, int(sigma / target))
    if factor == 1:
        return convolve(df, by, gaussian_kernel(sigma))
    block = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("row", "col")]
    small = df.filter(F.col("v").isNotNull()).groupBy(*by, *block).agg(F.avg("v").alias("v"))
    blurred = convolve(small, by, gaussian_kernel(sigma / factor)).withColumnRenamed("v", "_v").withColumnRenamed("row", "_r").withColumnRenamed("col", "_c")
    rows = df.withColumn("_r", F.floor(F.col("row") / factor).cast("long")).withColumn("_c", F.floor(F.col("col") / factor).cast("long"))
    return rows.join(blurred, [*by, "_r", "_c"]).select(*by, "row", "col", F.col("_v").alias("v"))


# ---- masks of a region of interest -------------------------------------------------------------------------------------
@dataclass(frozen=True)
class RoiMask:
    """A mask (row, col, counted inside the region) and where its region lies in the raster: first row and column, size."""

    mask: DataFrame
    top: int
    left: int
    height: int
    width: int

    @staticmethod
    def of(mask: DataFrame, top: int, left: int, height: int, width: int) -> RoiMask:
        """From a mask of the whole raster: the part inside the region."""
        inside = mask.filter(F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1))
        return RoiMask(inside.select((F.col("row") - top).alias("row"), (F.col("col") - left).alias("col")), top, left, height, width)

    def pixels(self) -> DataFrame:
        """row, col in the raster, and local_row, local_col in the region."""
        return self.mask.select((F.col("row") + self.top).alias("row"), (F.col("col") + self.left).alias("col"), F.col("row").alias("local_row"), F.col("col").alias("local_col"))

    def resized(self, top: int, left: int, height: int, width: int) -> RoiMask:
        """The same pixels of the raster under another region; those outside it are cut off."""
        return RoiMask.of(self.pixels().select("row", "col"), top, left, height, width)

    def shared(self, other: RoiMask) -> DataFrame:
        """row, col of the raster's pixels that lie in both regions, set or not, with set (by this mask)."""
        top, left = max(self.top, other.top), max(self.left, other.left)
        bottom, right = min(self.top + self.height, other.top + other.height), min(self.left + self.width, other.left + other.width)
        spark = self.mask.sparkSession
        both = rectangle(spark, top, left, max(0, bottom - top), max(0, right - left))
        return both.join(self.pixels().select("row", "col", F.lit(True).alias("set")), ["row", "col"], "left").withColumn("set", F.coalesce("set", F.lit(False)))
