"""One-dimensional series: rows (series key columns, x, y). Every window is partitioned by the series and ordered by x.

ties: further columns that order rows of equal x.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = Sequence[str]


def over(by: Keys, x: str = "x", ties: Keys = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(x, *ties)


def centred(function: str, by: Keys, x: str, window: float) -> Column:
    """An aggregate over rows within half a window either side, both ends included; shorter at the ends.

    Written as SQL because the DataFrame API takes whole-number frames only.
    """
    keys = "".join(f"`{k}`, " for k in by).rstrip(", ")
    part = f"partition by {keys} " if keys else ""
    return F.expr(f"{function} over ({part}order by `{x}` range between {float(window) / 2!r}D preceding and {float(window) / 2!r}D following)")


def moving_mean(y: str, by: Keys, x: str, window: float) -> Column:
    return centred(f"avg(`{y}`)", by, x, window)


def window_count(by: Keys, x: str, window: float) -> Column:
    return centred("count(*)", by, x, window)


#: The weights of the five-point quadratic smoothing filter.
SAV_GOL_5 = {-2: -3.0, -1: 12.0, 0: 17.0, 1: 12.0, 2: -3.0}


def savitzky_golay(y: str, w: WindowSpec) -> Column:
    """Five-point filter; at the ends the weights of the rows that exist are scaled to sum to one."""
    taps = {k: F.col(y) if k == 0 else (F.lag(y, -k) if k < 0 else F.lead(y, k)).over(w) for k in SAV_GOL_5}
    total = sum((F.when(t.isNotNull(), SAV_GOL_5[k]).otherwise(0.0) for k, t in taps.items()), F.lit(0.0))
    return sum((F.coalesce(t, F.lit(0.0)) * SAV_GOL_5[k] for k, t in taps.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))


def dydx(x: str, y: str, w: WindowSpec) -> Column:
    """Central difference, one-sided at the ends; null for a single row or rows of equal x."""
    x0, y0 = (F.coalesce(F.lag(c).over(w), F.col(c)) for c in (x, y))
    x1, y1 = (F.coalesce(F.lead(c).over(w), F.col(c)) for c in (x, y))
    return F.try_divide(y1 - y0, F.nullif(x1 - x0, F.lit(0.0)))


def is_local_maximum(y: str, w: WindowSpec) -> Column:
    """Higher than both neighbours; end points compare with the one they have."""
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    return (before.isNull() | (F.col(y) > before)) & (after.isNull() | (F.col(y) > after))


def trapezoid(x: str, y: str, w: WindowSpec) -> Column:
    """Area to the next row; null at the last one. Sum it for the area under the series."""
    return (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2


def area_under(df: DataFrame, by: Keys, x: str = "x", y: str = "y", ties: Keys = ()) -> DataFrame:
    rows = df.withColumn("_a", trapezoid(x, y, over(by, x, ties)))
    return rows.groupBy(*by).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("area"))


def segments(df: DataFrame, by: Keys, x: str = "x", y: str = "y", ties: Keys = ()) -> DataFrame:
    """A row for each pair of neighbours: x0, y0, x1, y1."""
    w = over(by, x, ties)
    return df.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).filter("x1 is not null")


def crossings(df: DataFrame, by: Keys, level: float, x: str = "x", y: str = "y", ties: Keys = (), tol: float = 1e-10) -> DataFrame:
    """by, x where the series crosses a level, without repeats closer than tol. A stretch that lies on the level gives its ends."""
    s = segments(df, by, x, y, ties)
    a, b = F.col("y0") - level, F.col("y1") - level
    flat = (a == 0) & (b == 0)
    hit = s.filter(a * b <= 0).select(*by, F.explode(F.when(flat, F.array("x0", "x1")).otherwise(F.array(F.col("x0") + (F.col("x1") - F.col("x0")) * a / F.nullif(a - b, F.lit(0.0))))).alias("x"))
    before = F.lag("x").over(over(by, "x"))
    return hit.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("x") - F.col("_b") > tol)).drop("_b")


def bounds_at_level(df: DataFrame, by: Keys, level: float = 0.0, x: str = "x", y: str = "y", ties: Keys = ()) -> DataFrame:
    """Intervals (x0, x1) between the ends and the crossings of a level."""
    ends = df.groupBy(*by).agg(F.array(F.min(x), F.max(x)).alias("e")).select(*by, F.explode("e").alias("x"))
    marks = crossings(df, by, level, x, y, ties).unionByName(ends).distinct()
    return marks.select(*by, F.col("x").alias("x0"), F.lead("x").over(over(by, "x")).alias("x1")).filter("x1 is not null")


def global_extrema(df: DataFrame, by: Keys, x: str = "x", y: str = "y") -> DataFrame:
    """x and y of the first largest and first smallest y."""
    ok = df.filter(F.col(y).isNotNull() & ~F.isnan(y))
    return ok.groupBy(*by).agg(F.min_by(x, F.struct((-F.col(y)).alias("y"), F.col(x))).alias("max_x"), F.max(y).alias("max_y"), F.min_by(x, F.struct(F.col(y), F.col(x))).alias("min_x"), F.min(y).alias("min_y"))


def islands(df: DataFrame, by: Keys, near: Column, min_span: float, x: str = "x", ties: Keys = ()) -> DataFrame:
    """Runs of neighbouring rows where near holds and x spans at least min_span: first_x, last_x, n."""
    w = over(by, x, ties)
    rows = df.withColumn("_ok", F.coalesce(near, F.lit(False))).withColumn("_n", F.row_number().over(w))
    kept = rows.filter("_ok").withColumn("_island", F.col("_n") - F.row_number().over(w))
    runs = kept.groupBy(*by, "_island").agg(F.min(x).alias("first_x"), F.max(x).alias("last_x"), F.count("*").alias("n"))
    return runs.filter(F.col("last_x") - F.col("first_x") >= min_span).drop("_island")


def plateau(df: DataFrame, by: Keys, tol: float, x: str = "x", y: str = "y", ties: Keys = ()) -> DataFrame:
    """The run of rows around each series' first maximum with y within tol of it: x0, x1."""
    top = global_extrema(df, by, x, y).select(*by, F.col("max_x").alias("_tx"), F.col("max_y").alias("_ty"))
    rows = df.join(top, list(by)) if by else df.crossJoin(F.broadcast(top))
    runs = islands(rows.withColumn("_near", F.col(y) >= F.col("_ty") - tol), [*by, "_tx"], F.col("_near"), 0.0, x, ties)
    return runs.filter("_tx between first_x and last_x").select(*by, F.col("first_x").alias("x0"), F.col("last_x").alias("x1"))


# ---- as-of and interpolation -------------------------------------------------------------------------------------------
def asof(left: DataFrame, right: DataFrame, by: Keys, x: str, payload: Sequence[str], ties: Keys = ()) -> DataFrame:
    """left with payload of the last right row of its series at or before its x; null before the first one.

    One sort of both sides together, no pairs. Rows of equal x match; of several such right rows the last by ties counts.
    """
    r = right.select(*by, F.col(x), F.struct(*payload).alias("_r"), F.lit(0).alias("_side"), *[F.col(t) for t in ties])
    kept = [c for c in left.columns if c not in (*by, x)]
    l_ = left.select(*by, F.col(x), F.struct(*kept).alias("_l") if kept else F.lit(None).alias("_l"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*by).orderBy(x, "_side", *ties).rowsBetween(Window.unboundedPreceding, 0)
    both = l_.unionByName(r, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*by, x, *[F.col(f"_l.{c}").alias(c) for c in kept], *[F.col(f"_m.{c}").alias(c) for c in payload])


def tolerance_asof(left: DataFrame, zones: DataFrame, by: Keys = (), x: str = "x") -> DataFrame:
    """left with lower and upper of the zone (x0, lower, upper) whose start is the last at or before x; outside all starts the last zone."""
    named = zones.select(*by, F.col("x0").alias(x), "lower", "upper")
    found = asof(left, named, by, x, ["lower", "upper"])
    last = zones.groupBy(*by).agg(F.max_by(F.struct("lower", "upper"), "x0").alias("_z"))
    found = found.join(last, list(by), "left") if by else found.crossJoin(F.broadcast(last))
    out = F.col("lower").isNull()
    return found.withColumns({n: F.when(out, F.col(f"_z.{n}")).otherwise(F.col(n)) for n in ("lower", "upper")}).drop("_z")


def closest_index(value: Column, before: Column, after: Column) -> Column:
    """The nearer of two bracketing values, the upper one of equals; one that is null doesn't count."""
    return F.when(before.isNull() | (after - value <= value - before), F.coalesce(after, before)).otherwise(before)


def interpolate(queries: DataFrame, series: DataFrame, by: Keys, x: str = "x", y: str = "y") -> DataFrame:
    """queries (by, x, ...) with y of the series at x, linear between neighbours, null outside. A sort each way, no pairs."""
    kept = [c for c in queries.columns if c not in (*by, x)]
    q = queries.select(*by, x, F.struct(F.lit(1).alias("_one"), *kept).alias("_q"), F.lit(None).cast("double").alias("_y"))
    s = series.select(*by, F.col(x), F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), F.col(y).cast("double").alias("_y"))
    at = F.when(F.col("_y").isNotNull(), F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    # RANGE frames: rows of equal x see each other. Both start at an end of the series: a frame that ends there is read anew for each row
    before = F.last(at, ignorenulls=True).over(Window.partitionBy(*by).orderBy(x).rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(at, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(x)).rangeBetween(Window.unboundedPreceding, 0))
    both = q.unionByName(s).select(*by, x, "_q", before.alias("_b"), after.alias("_a")).filter("_q is not null")
    t = (F.col(x) - F.col("_b.x")) / F.nullif(F.col("_a.x") - F.col("_b.x"), F.lit(0.0))
    value = F.when(F.col("_b.x") == F.col(x), F.col("_b.y")).otherwise(F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * t)
    return both.select(*by, x, *[F.col(f"_q.{c}").alias(c) for c in kept], F.when(F.col("_a").isNotNull(), value).alias(y))


def resample(df: DataFrame, by: Keys, n: int | None = None, spacing: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """n evenly spaced points from the first x to the last, or as many as make steps of at most spacing."""
    ends = df.groupBy(*by).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    count = F.lit(n) if n else F.ceil((F.col("_b") - F.col("_a")) / spacing + 1).cast("int")
    ends = ends.withColumn("_n", F.greatest(count, F.lit(1)))
    steps = ends.select(*by, "_a", "_b", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    at = F.when(F.col("i") == F.col("_n") - 1, F.when(F.col("_n") == 1, F.col("_a")).otherwise(F.col("_b"))).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("i") / F.greatest(F.col("_n") - 1, F.lit(1)))
    return interpolate(steps.select(*by, at.alias(x), "i"), df, by, x, y)


def between(df: DataFrame, by: Keys, low: float, high: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with low <= x <= high, and interpolated ones at both bounds where the series reaches over them."""
    inner = df.filter(F.col(x).between(low, high)).select(*by, x, y)
    bounds = df.select(*by).distinct().withColumn(x, F.explode(F.array(F.lit(float(low)), F.lit(float(high)))))
    ends = interpolate(bounds, df, by, x, y).filter(F.col(y).isNotNull())
    have = inner.select(*by, x).distinct()
    return inner.unionByName(ends.join(have, [*by, x], "left_anti").select(*by, x, y))


def split_at(df: DataFrame, by: Keys, at: float, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """The part before and the part after; both have the interpolated row at the cut."""
    low, high = -1.7976931348623157e308, 1.7976931348623157e308
    return between(df, by, low, at, x, y), between(df, by, at, high, x, y)


def transformed(df: DataFrame, x: str = "x", y: str = "y", x_scale: float = 1.0, y_scale: float = 1.0, x_shift: float = 0.0, y_shift: float = 0.0, absolute: bool = False) -> DataFrame:
    value = F.abs(F.col(y)) if absolute else F.col(y)
    return df.withColumn(x, F.col(x) * x_scale + x_shift).withColumn(y, value * y_scale + y_shift)


def combine(a: DataFrame, b: DataFrame, by: Keys, sign: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """a plus (or minus, sign -1) the value of b at its x."""
    other = interpolate(a.select(*by, x, F.col(y).alias("_own")), b, by, x, y)
    return other.select(*by, x, (F.col("_own") + F.col(y) * sign).alias(y))


def concat(a: DataFrame, b: DataFrame, by: Keys, x: str = "x") -> DataFrame:
    """a followed by b; fails where b starts before a ends."""
    last = a.groupBy(*by).agg(F.max(x).alias("_last"))
    first = b.groupBy(*by).agg(F.min(x).alias("_first"))
    bad = (last.join(first, list(by)) if by else last.crossJoin(first)).filter("_first < _last")
    if bad.limit(1).count():
        raise ValueError("concat: the second series starts before the first one ends")
    return a.unionByName(b)


def checked_domain(df: DataFrame, by: Keys, order: str, x: str = "x") -> DataFrame:
    """df, failing where x isn't finite or falls along order; equal values may repeat."""
    w = Window.partitionBy(*by).orderBy(order)
    bad = F.isnan(x) | (F.abs(x) == float("inf")) | (F.col(x) < F.lag(x).over(w))
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("the domain isn't finite and ascending")).cast("double")).otherwise(F.col(x))
    return df.withColumn(x, checked)


def linear_domain(spark, start: float, end: float, n: int) -> DataFrame:
    """n evenly spaced x from the smaller bound to the larger one, both included."""
    low, high = min(start, end), max(start, end)
    step = (high - low) / max(1, n - 1)
    return spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") == n - 1, float(high if n > 1 else low)).otherwise(F.lit(low) + F.col("id") * step).alias("x"))
