"""The engine's operators on the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import angles as A
from ..functions import shapes as S
from ..functions import vectors as V
from ..operators import curves, graph, joins, masks, raster, sampling, series, stats
from . import views as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


P, E, R, C = f"({W.LINE_POINTS})", f"({W.EVENT_SERIES})", f"({W.PRICE_RASTER})", f"({W.ORDER_CURVES})"
MATRIX = ((0.8, -0.6, 0.0, 10.0), (0.6, 0.8, 0.0, -5.0), (0.0, 0.0, 1.0, 2.5))
NORMAL, OFFSET = (0.6, 0.0, 0.8), 30.0


# ---- aggregations ------------------------------------------------------------------------------------------------------
@query(f"select grp, round(avg(y), 6) as mean, round(var_pop(y), 6) as variance, round(stddev_pop(y), 6) as stdev, round(median(y), 6) as median from {P} group by grp")
def mean_var_std_median(spark, sf):
    return rounded(W.line_points(spark, sf).groupBy("grp").agg(*(c.alias(n) for n, c in stats.mean_var_std_median(F.col("y")).items())), "mean", "variance", "stdev", "median")


@query(f"select grp, round(sum(y * x) / nullif(sum(x), 0), 6) as average from {P} group by grp")
def weighted_average(spark, sf):
    return rounded(W.line_points(spark, sf).groupBy("grp").agg(stats.weighted_average(F.col("y"), F.col("x")).alias("average")), "average")


@query(f"select grp, round(avg(x), 6) as cx, round(avg(y), 6) as cy, round(avg(z), 6) as cz, round(sum(x * x) / sum(x), 6) as wx, round(sum(y * x) / sum(x), 6) as wy from {P} group by grp")
def centroid(spark, sf):
    p = V.vec("x", "y", "z")
    c, w = stats.mean_point(p), stats.mean_point(p, F.col("x"))
    return rounded(W.line_points(spark, sf).groupBy("grp").agg(c[0].alias("cx"), c[1].alias("cy"), c[2].alias("cz"), w[0].alias("wx"), w[1].alias("wy")), "cx", "cy", "cz", "wx", "wy")


@query(f"select grp, min(x) as x_min, max(x) as x_max, min(y) as y_min, max(y) as y_max, min(z) as z_min, max(z) as z_max from {P} group by grp")
def aabb_by_group(spark, sf):
    return W.line_points(spark, sf).groupBy("grp").agg(*stats.aabb(V.vec("x", "y", "z")))


@query(f"select grp, key from (select *, row_number() over (partition by grp order by x * 1.0 + y * 2.0 + z * -0.5 desc, key) as n from {P}) where n = 1")
def extreme_point_in_direction(spark, sf):
    far = stats.extreme_in_direction(V.vec("x", "y", "z"), V.vec(1.0, 2.0, -0.5), [F.col("key")], F.col("key"))
    return W.line_points(spark, sf).groupBy("grp").agg(far.alias("key"))


@query(f"select id, round(max(y), 6) as max_dev, round(min(y), 6) as min_dev, round(2 * greatest(abs(max(y)), abs(min(y))), 6) as zone from (select id, y - avg(y) over (partition by id) as y from {E}) group by id")
def deviation_zone(spark, sf):
    dev = W.event_series(spark, sf).withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("id")))
    return rounded(dev.groupBy("id").agg(*(c.alias(n) for n, c in stats.deviation_set(F.col("y")).items())), "max_dev", "min_dev", "zone")


@query(f"select id, round(regr_slope(y, x) * 1e6, 4) as slope, round(regr_intercept(y, x), 4) as intercept from {E} group by id")
def series_best_fit_line(spark, sf):
    fit = stats.line_fit(F.col("x"), F.col("y"))
    return W.event_series(spark, sf).groupBy("id").agg(F.round(fit["slope"] * 1e6, 4).alias("slope"), F.round(fit["intercept"], 4).alias("intercept"))


@query(f"""
with s as (
    select grp, count(*)::double as s0, sum(x) as s1, sum(x * x) as s2, sum(x * x * x) as s3, sum(x * x * x * x) as s4, sum(y) as t0, sum(x * y) as t1, sum(x * x * y) as t2
    from (select grp, x / 50 as x, y from {P}) group by grp
), d as (
    select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) as det from s
)
select grp,
    round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det, 4) as c0,
    round((s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / det, 4) as c1,
    round((s0 * (s2 * t2 - t1 * s3) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / det, 4) as c2
from d
""")
def poly2_fit(spark, sf):
    m = W.line_points(spark, sf).groupBy("grp").agg(*stats.moments(F.col("x") / 50, F.col("y"), 2))
    return m.select("grp", *(F.round(c, 4).alias(f"c{k}") for k, c in enumerate(stats.quadratic_from_moments())))


@query(f"select grp, count(*) as n, round(avg(x), 6) as c_x, round(avg(y), 6) as c_y, round(covar_pop(x, x), 6) as v_xx, round(covar_pop(x, y), 6) as v_xy, round(covar_pop(y, y), 6) as v_yy from {P} group by grp")
def pca_moments(spark, sf):
    return rounded(W.line_points(spark, sf).groupBy("grp").agg(*stats.covariance(V.vec("x", "y"), ("x", "y"))), "c_x", "c_y", "v_xx", "v_xy", "v_yy")


@query(f"""
with m as (select grp, covar_pop(x, x) as a, covar_pop(x, y) as b, covar_pop(y, y) as d from {P} group by grp)
select grp, round((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b), 5) as v1, round((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b), 5) as v2 from m
""")
def pca_variances(spark, sf):
    axes = stats.principal_axes(W.line_points(spark, sf), ["grp"], ["x", "y"])
    return axes.select("grp", F.round(F.col("pca.variances")[0], 5).alias("v1"), F.round(F.col("pca.variances")[1], 5).alias("v2"))


# ---- thinning and grids ------------------------------------------------------------------------------------------------
@query(f"select key, x, y from (select *, row_number() over (partition by floor(x / 2.0), floor(y / 2.0) order by key) as n from {P}) where n = 1")
def voxel_downsample(spark, sf):
    return sampling.voxel_downsample(W.line_points(spark, sf), "key", ["x", "y"], 2.0).select("key", "x", "y")


@query(f"""
with c as (select cast(floor(y / 2.5) as bigint) as bin, count(*) as n from {P} where y >= 0 group by all)
select b.bin, coalesce(c.n, 0) as n from (select unnest(range(0, (select max(bin) from c) + 1)) as bin) b left join c using (bin)
""")
def voxel_histogram(spark, sf):
    from ..sources.files import point_distribution

    return point_distribution(W.line_points(spark, sf), 2.5)


# ---- intervals and tolerances ------------------------------------------------------------------------------------------
@query(f"select key, round(greatest(least(y, 60.0), 20.0), 6) as clamped, y between 20.0 and 60.0 as inside from {P} where x between 10 and 30")
def interval_filter_clamp(spark, sf):
    i, j = A.interval(F.lit(60.0), F.lit(20.0)), A.interval(F.lit(10.0), F.lit(30.0))
    rows = W.line_points(spark, sf).filter(A.interval_contains(j, F.col("x")))
    return rows.select("key", F.round(A.interval_clamp(i, F.col("y")), 6).alias("clamped"), A.interval_contains(i, F.col("y")).alias("inside"))


@query(f"select grp, count(*) filter (where y between 15.0 and 45.0) as ok, count(*) filter (where not y between 15.0 and 45.0) as bad from {P} group by grp")
def tolerance_conformity(spark, sf):
    ok = A.conforms(A.symmetrical(F.lit(30.0), 30.0), F.col("y"))
    return W.line_points(spark, sf).groupBy("grp").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"))


ZONES = ((0.0, 0.0, 10.0), (10.0, 5.0, 25.0), (25.0, 10.0, 50.0), (40.0, 30.0, 70.0))


@query(f"""
with z(x0, lower, upper) as (values {', '.join(str(z) for z in ZONES)})
select cast(p.x as double) as x, z.lower, z.upper, count(*) as n, count(*) filter (where p.y between z.lower and z.upper) as ok
from {P} p asof join z on p.x >= z.x0 group by all
""")
def tolerance_asof(spark, sf):
    zones = spark.createDataFrame(ZONES, "x0 double, lower double, upper double")
    p = W.line_points(spark, sf).select(F.col("x").cast("double").alias("x"), "y")
    # an x has one zone, so the as-of join sorts each x once; the rows then meet their zone on x
    found = series.tolerance_asof(p.select("x").distinct(), zones)
    ok = F.col("y").between(F.col("lower"), F.col("upper"))
    return p.join(found, "x").groupBy("x", "lower", "upper").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"))


# ---- series -------------------------------------------------------------------------------------------------------------
@query(f"select id, event_id, round(avg(y) over (partition by id order by x range between 43200.0 preceding and 43200.0 following), 6) as mean from {E}")
def series_moving_mean(spark, sf):
    return W.event_series(spark, sf).select("id", "event_id", F.round(series.moving_mean("y", ["id"], "x", 86400.0), 6).alias("mean"))


@query(f"""
with w as (select *, lag(y, 2) over o as a, lag(y) over o as b, lead(y) over o as d, lead(y, 2) over o as e from {E} window o as (partition by id order by x))
select id, event_id, round((-3 * coalesce(a, 0) + 12 * coalesce(b, 0) + 17 * y + 12 * coalesce(d, 0) - 3 * coalesce(e, 0)) / nullif(17 + case when a is null then 0 else -3 end + case when b is null then 0 else 12 end + case when d is null then 0 else 12 end + case when e is null then 0 else -3 end, 0), 6) as v from w
""")
def series_sav_gol5(spark, sf):
    return W.event_series(spark, sf).select("id", "event_id", F.round(series.savitzky_golay("y", series.over(["id"])), 6).alias("v"))


@query(f"""
with w as (select *, coalesce(lag(x) over o, x) as x0, coalesce(lag(y) over o, y) as y0, coalesce(lead(x) over o, x) as x1, coalesce(lead(y) over o, y) as y1 from {E} window o as (partition by id order by x))
select id, event_id, round((y1 - y0) / nullif(x1 - x0, 0) * 3600, 6) as slope from w
""")
def series_dydx(spark, sf):
    return W.event_series(spark, sf).select("id", "event_id", F.round(series.dydx("x", "y", series.over(["id"])) * 3600, 6).alias("slope"))


@query(f"select id, round(coalesce(sum((x1 - x) * (y1 + y) / 2), 0) / 3600, 4) as area from (select *, lead(x) over o as x1, lead(y) over o as y1 from {E} window o as (partition by id order by x)) group by id")
def series_area(spark, sf):
    return series.area_under(W.event_series(spark, sf), ["id"]).select("id", F.round(F.col("area") / 3600, 4).alias("area"))


@query(f"select id, event_id from (select *, lag(y) over o as b, lead(y) over o as a from {E} window o as (partition by id order by x)) where (b is null or y > b) and (a is null or y > a)")
def series_local_maxima(spark, sf):
    rows = W.event_series(spark, sf).withColumn("m", series.is_local_maximum("y", series.over(["id"])))
    return rows.filter("m").select("id", "event_id")


@query(f"""
with s as (select id, x as x0, y - 50.0 as a, lead(x) over o as x1, lead(y) over o - 50.0 as b from {E} window o as (partition by id order by x)),
h as (select id, unnest(case when a = 0 and b = 0 then [x0, x1] else [x0 + (x1 - x0) * a / nullif(a - b, 0)] end) as x from s where x1 is not null and a * b <= 0),
d as (select id, x, lag(x) over (partition by id order by x) as p from h)
select id, round(x, 3) as x from d where p is null or x - p > 1e-10
""")
def series_crossings(spark, sf):
    return rounded(series.crossings(W.event_series(spark, sf), ["id"], 50.0), "x", digits=3)


@query(f"""
with t as (select id, max(y) as max_y, min(y) as min_y from {E} group by id)
select t.id, min(e.x) filter (where e.y = t.max_y) as max_x, t.max_y, min(e.x) filter (where e.y = t.min_y) as min_x, t.min_y from t join {E} e on e.id = t.id group by t.id, t.max_y, t.min_y
""")
def series_global_extrema(spark, sf):
    return series.global_extrema(W.event_series(spark, sf), ["id"])


@query(f"""
with r as (select *, row_number() over (partition by id order by x) as n from {E}),
k as (select *, n - row_number() over (partition by id order by x) as island from r where abs(y - 50.0) < 30.0)
select id, min(x) as first_x, max(x) as last_x, count(*) as n from k group by id, island having max(x) - min(x) >= 3600.0
""")
def series_islands(spark, sf):
    return series.islands(W.event_series(spark, sf), ["id"], F.abs(F.col("y") - 50.0) < 30.0, 3600.0)


@query(f"""
with e as (select id, min(x) as a, max(x) as b from {E} group by id),
q as (select id, i, case when i = 20 then b else a + (b - a) * i / 20 end as x from (select id, a, b, unnest(range(0, 21)) as i from e)),
l as (select q.id, q.i, q.x, s.x as x0, s.y as y0 from q asof left join {E} s on q.id = s.id and q.x >= s.x),
u as (select l.*, s.x as x1, s.y as y1 from l asof left join {E} s on l.id = s.id and l.x <= s.x)
select id, i, round(x, 4) as x, round(case when x0 = x then y0 else y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0) end, 5) as y from u
""")
def series_resample(spark, sf):
    out = series.resample(W.event_series(spark, sf), ["id"], n=21).select("id", F.col("i").cast("long").alias("i"), F.round("x", 4).alias("x"), F.round("y", 5).alias("y"))
    return out


@query(f"""
with q as (select distinct id, b as x from {E} cross join (values (604800.5), (1209600.25)) t(b)),
l as (select q.id, q.x, s.x as x0, s.y as y0 from q asof join {E} s on q.id = s.id and q.x >= s.x),
u as (select l.*, s.x as x1, s.y as y1 from l asof join {E} s on l.id = s.id and l.x <= s.x)
select id, round(x, 4) as x, round(y, 5) as y from {E} where x between 604800.5 and 1209600.25
union all select id, round(x, 4), round(case when x0 = x then y0 else y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0) end, 5) from u
""")
def series_between(spark, sf):
    out = series.between(W.event_series(spark, sf), ["id"], 604800.5, 1209600.25)
    return out.select("id", F.round("x", 4).alias("x"), F.round("y", 5).alias("y"))


@query(f"""
with t as (select id, max(y) as ty from {E} group by id),
p as (select t.id, t.ty, min(e.x) as tx from t join {E} e on e.id = t.id and e.y = t.ty group by all),
r as (select e.id, e.x, p.tx, e.y >= p.ty - 40.0 as ok, row_number() over (partition by e.id order by e.x) as n from {E} e join p on e.id = p.id),
k as (select *, n - row_number() over (partition by id order by x) as island from r where ok)
select id, min(x) as x0, max(x) as x1 from k group by id, tx, island having tx between min(x) and max(x)
""")
def series_plateau(spark, sf):
    return series.plateau(W.event_series(spark, sf), ["id"], 40.0)


@query(f"select id, event_id, round(abs(y) * 2.0 + 1.0, 6) as y, x * 0.5 - 3.0 as x from {E}")
def series_transformed(spark, sf):
    return rounded(series.transformed(W.event_series(spark, sf), x_scale=0.5, x_shift=-3.0, y_scale=2.0, y_shift=1.0, absolute=True), "y").select("id", "event_id", "x", "y")


# ---- row-wise geometry -------------------------------------------------------------------------------------------------
@query(f"select key, round(d - 6.283185307179586 * floor((d + 3.141592653589793) / 6.283185307179586), 9) as signed, round(b - 6.283185307179586 * floor(b / 6.283185307179586), 9) as full from (select key, y / 7.0 - x as d, x * -0.37 as b from {P})")
def angle_wrap(spark, sf):
    return W.line_points(spark, sf).select("key", F.round(A.shortest(F.col("x"), F.col("y") / 7.0), 9).alias("signed"), F.round(A.to_2pi(F.col("x") * -0.37), 9).alias("full"))


@query(f"select key, round(x * 0.8 + y * -0.6 + z * 0.0 + 10.0, 6) as x, round(x * 0.6 + y * 0.8 + z * 0.0 - 5.0, 6) as y, round(z + 2.5, 6) as z from {P}")
def rigid_transform(spark, sf):
    p = V.transform(V.vec("x", "y", "z"), MATRIX)
    return W.line_points(spark, sf).select("key", *(F.round(c, 6).alias(n) for c, n in zip(p, "xyz", strict=True)))


@query(f"select key, round(atan2(y, x) * 25.0, 6) as a, z as h, round(sqrt(x * x + y * y) - 25.0, 6) as r from {P}")
def unroll_cylinder(spark, sf):
    a, h, r = V.unroll(V.vec("x", "y", "z"), 25.0)
    return W.line_points(spark, sf).select("key", F.round(a, 6).alias("a"), h.alias("h"), F.round(r, 6).alias("r"))


@query(f"select key, round(d, 6) as d, round(x - 0.6 * d, 6) as px, round(y, 6) as py, round(z - 0.8 * d, 6) as pz, d >= 0 as above from (select *, x * 0.6 + y * 0.0 + z * 0.8 - 30.0 as d from {P})")
def plane_signed_distance(spark, sf):
    n, p = V.vec(*NORMAL), V.vec("x", "y", "z")
    d, q = S.plane_signed_distance(n, OFFSET, p), S.plane_project(n, OFFSET, p)
    return W.line_points(spark, sf).select("key", F.round(d, 6).alias("d"), F.round(q[0], 6).alias("px"), F.round(q[1], 6).alias("py"), F.round(q[2], 6).alias("pz"), S.plane_is_positive(n, OFFSET, p).alias("above"))


@query(f"""
select key, round(abs((50.0 - x) * (100.0 - y) - (0.0 - y) * (10.0 - x)) * 0.5, 9) as area, round(1 - v - w, 9) as u, round(v, 9) as v, round(w, 9) as w
from (select key, x, y, ((x - 0.0) * 100.0 - (y - 0.0) * 10.0) / 5000.0 as v, (50.0 * y) / 5000.0 as w from {P})
""")
def barycentric_and_area(spark, sf):
    a, b, c, p = V.vec(0.0, 0.0), V.vec(50.0, 0.0), V.vec(10.0, 100.0), V.vec("x", "y")
    u, v, w = V.barycentric(a, b, c, p)
    return W.line_points(spark, sf).select("key", F.round(V.triangle_area(p, b, c), 9).alias("area"), F.round(u, 9).alias("u"), F.round(v, 9).alias("v"), F.round(w, 9).alias("w"))


@query(f"select key, round(sqrt((x - 25.0) * (x - 25.0) + (y - 30.0) * (y - 30.0)) - 20.0, 6) as signed, (x - 25.0) * (x - 25.0) + (y - 30.0) * (y - 30.0) <= 400.0 as inside, round(a - 6.283185307179586 * floor(a / 6.283185307179586), 9) as angle from (select *, atan2(y - 30.0, x - 25.0) as a from {P})")
def circle_relations(spark, sf):
    c, r, p = V.vec(25.0, 30.0), F.lit(20.0), V.vec("x", "y")
    return W.line_points(spark, sf).select("key", F.round(S.circle_signed_distance(c, r, p), 6).alias("signed"), S.circle_contains(c, r, p).alias("inside"), F.round(S.circle_angle_of(c, p), 9).alias("angle"))


@query(f"select key, round(abs(x * 3.0 - y * 4.0) / 5.0, 6) as to_line, round(acos(greatest(least((x * 4.0 + y * 3.0) / (sqrt(x * x + y * y) * 5.0), 1.0), -1.0)), 6) as angle from {P}")
def line_distance_and_angle(spark, sf):
    o, b, p = V.vec(0.0, 0.0), V.vec(4.0, 3.0), V.vec("x", "y")
    return W.line_points(spark, sf).select("key", F.round(V.distance_to_line(o, b, p), 6).alias("to_line"), F.round(V.three_point_angle(o, p, b), 6).alias("angle"))


@query(f"select key, case when c > 0 then round(x / c * 500.0 + 320.0, 5) end as u, case when c > 0 then round(y / c * 480.0 + 240.0, 5) end as v from (select *, z - 5.0 as c from {P})")
def pinhole_projection(spark, sf):
    u, v = V.pinhole((F.col("x"), F.col("y"), F.col("z") - 5.0), 500.0, 480.0, 320.0, 240.0)
    return W.line_points(spark, sf).select("key", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"))


@query(f"select key, u, round(u / 65535.0 * 120.0, 6) as back from (select key, cast(floor(least(greatest((y - 0.0) / 120.0, 0.0), 1.0) * 65535) as integer) as u from {P})")
def quantise_u16(spark, sf):
    u = A.quantise(F.col("y"), 0.0, 120.0)
    return W.line_points(spark, sf).select("key", u.alias("u")).withColumn("back", F.round(A.dequantise(F.col("u"), 0.0, 120.0), 6))


@query(f"select key, round(exp(-0.5 * power((y - 40.0) / 15.0, 2)), 9) as g, round(1.5 + x * (-0.25 + x * 0.01), 6) as p from {P}")
def function_values(spark, sf):
    return W.line_points(spark, sf).select("key", F.round(A.gaussian(F.col("y"), 40.0, 15.0), 9).alias("g"), F.round(A.polynomial(F.col("x"), [1.5, -0.25, 0.01]), 6).alias("p"))


# ---- joins ---------------------------------------------------------------------------------------------------------------
PARTS = "(select p_partkey as key, cast(p_size as double) as x, p_retailprice / 10 as y from part)"


def _parts(spark, sf):
    return W.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))


@query(f"""
select key, key_2, round(d, 6) as d, rank from (
    select a.key, b.key as key_2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d, row_number() over (partition by a.key order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.key) as rank
    from {PARTS} a cross join {PARTS} b
) where rank <= 3
""")
def knn_points(spark, sf):
    p = _parts(spark, sf)
    out = joins.knn_join(p, p, "key", "key", ("x", "y"), 3, 2.0)
    return out.select("key", "key_2", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


@query(f"select a.key, b.key as key_2, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as d from {PARTS} a join {PARTS} b on b.x between a.x - 2.0 and a.x + 2.0 and b.y between a.y - 2.0 and a.y + 2.0 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.0")
def radius_join(spark, sf):
    p = _parts(spark, sf)
    return joins.radius_join(p, p, "key", "key", ("x", "y"), 2.0, digits=6)


@query(f"select a.key, count(*) as n from {P} a join {P} b on a.x = b.x and b.y >= a.y - 0.011 and b.y <= a.y + 0.011 and (a.y - b.y) * (a.y - b.y) <= 0.01 * 0.01 group by a.key")
def radius_join_count(spark, sf):
    p = W.line_points(spark, sf)
    return joins.radius_counts(p, p, "key", ("x", "y"), 0.01)


CUST = "(select c_custkey as key, c_acctbal / 100 as x, cast(c_nationkey as double) as y from customer)"
SUPP = "(select s_suppkey as key, s_acctbal / 100 as x, cast(s_nationkey as double) as y from supplier)"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


@query(f"""
with t as (select key, k2 from (select a.key, b.key as k2, row_number() over (partition by a.key order by sqrt({_D2}), b.key) as n from {CUST} a cross join {SUPP} b) where n = 1),
u as (select key, k2 from (select a.key, b.key as k2, row_number() over (partition by a.key order by sqrt({_D2}), b.key) as n from {SUPP} a cross join {CUST} b) where n = 1)
select a.key from t join u on t.k2 = u.key join {CUST} a on a.key = t.key join {CUST} b on b.key = u.k2 where sqrt({_D2}) < 3.0
""")
def reciprocal_overlap(spark, sf):
    c = W.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    s = W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return joins.overlap_by_reciprocity(c, s, "key", ("x", "y"), 3.0, 2.0)


@query("""
with v as (select vec_id, unnest(embedding)::double as e, generate_subscripts(embedding, 1) as i from embeddings),
d as (select a.vec_id, b.vec_id as vec_id_2, sqrt(sum((a.e - b.e) * (a.e - b.e))) as d from v a join v b on a.i = b.i and a.vec_id % 20 = 0 group by all)
select vec_id, vec_id_2, round(d, 5) as d, rank from (select *, row_number() over (partition by vec_id order by d, vec_id_2) as rank from d) where rank <= 5
""")
def embedding_knn(spark, sf):
    v = W.table(spark, sf, "embeddings")
    out = joins.high_dimensional_knn(v.filter("vec_id % 20 = 0"), v, "vec_id", "vec_id", "embedding", 5)  # the query set
    return out.select("vec_id", "vec_id_2", F.round("d", 5).alias("d"), F.col("rank").cast("long").alias("rank"))


# ---- masks and sets ------------------------------------------------------------------------------------------------------
_A, _B = "(select l_partkey as idx from lineitem where l_quantity > 45)", "(select l_partkey as idx from lineitem where l_discount > 0.08)"


def _masks(spark, sf):
    rows = W.table(spark, sf, "lineitem")
    return (rows.filter("l_quantity > 45").select(F.col("l_partkey").alias("idx")), rows.filter("l_discount > 0.08").select(F.col("l_partkey").alias("idx")))


@query(f"select * from {_A} union select * from {_B}")
def mask_union(spark, sf):
    return masks.union(*_masks(spark, sf))


@query(f"select * from {_A} intersect select * from {_B}")
def mask_intersection(spark, sf):
    return masks.intersection(*_masks(spark, sf))


@query(f"select * from {_A} except select * from {_B}")
def mask_difference(spark, sf):
    return masks.difference(*_masks(spark, sf))


@query(f"select unnest(range(0, 5000)) as idx except select * from {_A}")
def mask_complement(spark, sf):
    return masks.complement(_masks(spark, sf)[0], spark, 5000)


@query(f"select key, s or p as added, s and not p as removed, s and p as kept from (select key, x > 25 as s, y > 40 as p from {P})")
def select_ops(spark, sf):
    s, p = F.col("x") > 25, F.col("y") > 40
    return W.line_points(spark, sf).select("key", *(masks.select_column(s, p, op).alias(n) for op, n in ((masks.SelectOp.ADD, "added"), (masks.SelectOp.REMOVE, "removed"), (masks.SelectOp.KEEP, "kept"))))


T = f"({W.PART_FACES})"


@query(f"""
with f as (select * from {T}), corner as (select fid, unnest([a, b, c]) as v from f),
s0 as (select fid from f where fid <= 3),
s1 as (select distinct fid from corner where v in (select v from corner where fid in (select fid from s0))),
s2 as (select distinct fid from corner where v in (select v from corner where fid in (select fid from s1)))
select fid from s2
""")
def expand_selection(spark, sf):
    faces = W.part_faces(spark, sf)
    return masks.expand(faces.filter("fid <= 3"), faces, 2)  # the selection that is expanded


@query(f"select key, x, y from {P} where x between 5 and 20 and y between 10.0 and 40.0")
def box_filter(spark, sf):
    return W.line_points(spark, sf).filter(masks.in_box(V.vec("x", "y"), (5, 10.0), (20, 40.0))).select("key", "x", "y")


# ---- graphs ---------------------------------------------------------------------------------------------------------------
_EDGES = f"(select least(u, v) as lo, greatest(u, v) as hi, u, v, fid from (select fid, unnest([a, b, c]) as u, unnest([b, c, a]) as v from {T}))"


@query(f"select lo, hi, count(*) as n from {_EDGES} group by lo, hi")
def unique_edges(spark, sf):
    return graph.unique_edges(W.part_faces(spark, sf))


@query(f"select min(u) as v0, min(v) as v1 from {_EDGES} group by lo, hi having count(*) = 1")
def boundary_edges(spark, sf):
    return graph.boundary_edges(W.part_faces(spark, sf))


@query(f"""
with recursive c as (select *, i * 100 + j as k from ({W.CUSTOMER_CELLS})),
e as (select a.k as a, b.k as b from c a join c b on abs(a.i - b.i) <= 1 and abs(a.j - b.j) <= 1),
r as (select k as node, k as seen from c union select r.node, e.b from r join e on e.a = r.seen)
select i, j, min(seen) as label from r join c on c.k = r.node group by i, j
""")
def voxel_clusters(spark, sf):
    cells = W.customer_cells(spark, sf).withColumn("k", F.col("i") * 100 + F.col("j"))
    found = graph.connected_components(graph.grid_links(cells, "k", ("i", "j")), cells.select(F.col("k").alias("node")))
    return cells.join(found, cells["k"] == found["node"]).select("i", "j", F.col("root").alias("label"))


@query("""
with recursive e as (select distinct l_suppkey as a, 1000000 + l_partkey as b from lineitem), d as (select a, b from e union all select b, a from e),
r(node, root) using key (node) as (
    select distinct a, a from d
    union
    select d.b, min(r.root) from r join d on d.a = r.node join recurring.r as old on old.node = d.b where r.root < old.root group by d.b)
select node, root from r
""")
def connected_components_all(spark, sf):
    """Suppliers and parts that order lines connect: every link."""
    rows = W.table(spark, sf, "lineitem")
    return graph.connected_components(rows.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b")))


@query("""
with recursive p as (select key, x, y from (select s_suppkey as key, s_acctbal / 50 as x, cast(s_nationkey as double) as y from supplier)),
e as (select a.key as a, b.key as b from p a join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9.0),
r as (select key as node, key as seen from p union select r.node, e.b from r join e on e.a = r.seen)
select node as key, min(seen) as cluster from r group by node
""")
def cluster_points_by_tol(spark, sf):
    s = W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 50).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return graph.cluster_points(s, "key", ("x", "y"), 3.0)


# ---- rasters ---------------------------------------------------------------------------------------------------------------
@query(f"select row, col, round(v, 6) as v, round(stdev, 6) as stdev, n from {R}")
def raster_bin_mean_std(spark, sf):
    return rounded(W.price_raster(spark, sf), "v", "stdev")


@query(f"""
with r as (select row, col, v from {R}),
k as (select * from (values (-1, -1, 1.0), (-1, 0, 2.0), (-1, 1, 1.0), (0, -1, 2.0), (0, 0, 4.0), (0, 1, 2.0), (1, -1, 1.0), (1, 0, 2.0), (1, 1, 1.0)) k(dr, dc, w))
select a.row, a.col, round(sum(b.v * k.w) / sum(k.w), 6) as v from r a cross join k join r b on b.row = a.row + k.dr and b.col = a.col + k.dc group by a.row, a.col
""")
def raster_convolve3x3(spark, sf):
    return rounded(raster.convolve_small(W.price_raster(spark, sf), (), [[1, 2, 1], [2, 4, 2], [1, 2, 1]]), "v")


_CROSS = "(values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) k(dr, dc)"


@query(f"with r as (select row, col from {R}) select row, col from (select a.row, a.col, count(*) as n from r a cross join {_CROSS} join r b on b.row = a.row + k.dr and b.col = a.col + k.dc group by a.row, a.col) where n = 5")
def raster_erode(spark, sf):
    return raster.erode(W.price_raster(spark, sf).select("row", "col"), ())


@query(f"with r as (select row, col from {R}) select distinct row + dr as row, col + dc as col from r cross join {_CROSS}")
def raster_dilate(spark, sf):
    return raster.dilate(W.price_raster(spark, sf).select("row", "col"), ())


@query(f"""
with r as (select row, col, v from {R}), q as (select key, y, x * 0.9 as x, floor(y) as r0, floor(x * 0.9) as c0 from {P}),
n as (select q.key, r0 + i as row, c0 + j as col, (case when i = 1 then y - r0 else 1 - (y - r0) end) * (case when j = 1 then x - c0 else 1 - (x - c0) end) as w from q cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) t(i, j))
select n.key, round(case when count(*) = count(r.v) then sum(w * r.v) end, 9) as v from n left join r on r.row = n.row and r.col = n.col where w > 0 group by n.key
""")
def raster_bilinear(spark, sf):
    q = W.line_points(spark, sf).select("key", "y", (F.col("x") * 0.9).alias("x"))
    return rounded(raster.bilinear(W.price_raster(spark, sf), q, (), "key"), "v", digits=9)


@query(f"with r as (select row, col, v from {R}) select a.row, a.col, round(a.v - b.v, 6) as v from r a join r b on b.row = a.row + 1 and b.col = a.col")
def raster_subtract(spark, sf):
    r = W.price_raster(spark, sf).select("row", "col", "v")
    return rounded(raster.subtract(r, r.withColumn("row", F.col("row") - 1), ()), "v")


@query(f"""
with recursive c as (select row, col, (row + 1048576) * 4194304 + col + 1048576 as k from {R} where v > 5.2),
e as (select a.k as a, b.k as b from c a join c b on abs(a.row - b.row) + abs(a.col - b.col) = 1),
t as (select k as node, k as seen from c union select t.node, e.b from t join e on e.a = t.seen),
l as (select node, min(seen) as label from t group by node)
select count(*) as n, min(row) as row_min, max(row) as row_max, min(col) as col_min, max(col) as col_max, label from l join c on c.k = l.node group by label
""")
def label_regions_stats(spark, sf):
    return raster.region_stats(raster.regions(W.price_raster(spark, sf).filter("v > 5.2").select("row", "col")))


# ---- curves ------------------------------------------------------------------------------------------------------------------
@query(f"select curve, round(sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)), 5) as length from (select *, lag(x) over o as px, lag(y) over o as py from {C} window o as (partition by curve order by seq)) group by curve")
def polyline_length(spark, sf):
    return rounded(curves.total_length(W.order_curves(spark, sf), ["curve"]), "length", digits=5)


@query(f"""
with s as (select *, lead(x) over o as nx, lead(y) over o as ny from {C} window o as (partition by curve order by seq)),
g as (select *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) as d from s),
n as (select *, case when d > 20.0 then cast(ceil(d / 20.0) as integer) else 1 end as n from g)
select curve, seq, k, round(x + coalesce((nx - x) * k / n, 0), 9) as x, round(y + coalesce((ny - y) * k / n, 0), 9) as y from (select *, unnest(range(0, n)) as k from n)
""")
def polyline_fill_gaps(spark, sf):
    out = rounded(curves.fill_gaps(W.order_curves(spark, sf), ["curve"], 20.0), "x", "y", digits=9)
    return out.withColumn("k", F.col("k").cast("long"))


@query(f"""
with s as (select *, lag(x) over o as ax, lag(y) over o as ay, lead(x) over o as bx, lead(y) over o as by_ from {C} window o as (partition by curve order by seq)),
c as (select curve, seq, 2 * ((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) as t, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay)) * sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y)) * sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) as d from s)
select curve, seq, round(coalesce(t / nullif(d, 0), 0), 6) as curvature from c
""")
def curvature_series(spark, sf):
    return W.order_curves(spark, sf).select("curve", "seq", F.round(curves.curvature(["curve"]), 6).alias("curvature"))


@query(f"""
with s as (select curve, seq, x as x0, y as y0, lead(x) over o as x1, lead(y) over o as y1 from {C} window o as (partition by curve order by seq)),
g as (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as step from s where x1 is not null),
l as (select *, coalesce(sum(step) over (partition by curve order by seq rows between unbounded preceding and 1 preceding), 0) as l0 from g),
t as (select curve, sum(step) as total from l group by curve),
q as (select curve, i, least(total * i / 8, total) as length from (select *, unnest(range(0, 9)) as i from t)),
a as (select q.*, l.* exclude (curve) from q asof left join (select * from l where step > 0) l on q.curve = l.curve and q.length >= l.l0)
select curve, i, round(length, 8) as length, round(x0 + (x1 - x0) * least((length - l0) / step, 1), 8) as x, round(y0 + (y1 - y0) * least((length - l0) / step, 1), 8) as y from a
""")
def polyline_resample(spark, sf):
    c = W.order_curves(spark, sf)
    many = c.groupBy("curve").agg(F.count("*").alias("_n")).filter("_n > 1").select("curve")
    out = rounded(curves.resample(c.join(many, "curve", "left_semi"), ["curve"], n=9), "length", "x", "y", digits=8)
    return out.withColumn("i", F.col("i").cast("long"))


@query(f"select curve, round(sum(x0 * y1 - x1 * y0) / 2, 4) as area, sum(x0 * y1 - x1 * y0) / 2 > 0 as ccw from (select curve, x as x0, y as y0, coalesce(lead(x) over o, first_value(x) over o) as x1, coalesce(lead(y) over o, first_value(y) over o) as y1 from {C} window o as (partition by curve order by seq)) group by curve")
def curve_area(spark, sf):
    return rounded(curves.is_counter_clockwise(W.order_curves(spark, sf), ["curve"]), "area", digits=4)


# ---- the flagship: a moving mean, deviations from it, zones by the time of the month, conformity for each series ------------
ZONE_ROWS = ((0.0, -45.0, 45.0), (864000.0, -40.0, 40.0), (1728000.0, -30.0, 50.0))


@query(f"""
with m as (select id, x, event_id, y - avg(y) over (partition by id order by x range between 43200.0 preceding and 43200.0 following) as dev from {E}),
z(x0, lower, upper) as (values {', '.join(str(z) for z in ZONE_ROWS)}),
j as (select m.*, z.lower, z.upper from m asof join z on m.x >= z.x0)
select id, count(*) as n, count(*) filter (where dev between lower and upper) as ok, round(avg(dev), 6) as mean_dev, round(stddev_pop(dev), 6) as stdev_dev, round(2 * greatest(abs(max(dev)), abs(min(dev))), 6) as zone from j group by id
""")
def tolerance_report(spark, sf):
    s = W.event_series(spark, sf).select("id", "x", "event_id", (F.col("y") - series.moving_mean("y", ["id"], "x", 86400.0)).alias("dev"))
    # zones are a stated short list: bounds of each as an expression, no join
    lower = upper = F.lit(None).cast("double")
    for x0, a, b in ZONE_ROWS:
        lower, upper = F.when(F.col("x") >= x0, a).otherwise(lower), F.when(F.col("x") >= x0, b).otherwise(upper)
    ok = F.col("dev").between(lower, upper)
    zone = stats.deviation_set(F.col("dev"))["zone"]
    out = s.filter(F.col("x") >= ZONE_ROWS[0][0]).groupBy("id").agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), F.avg("dev").alias("mean_dev"), F.stddev_pop("dev").alias("stdev_dev"), zone.alias("zone"))
    return rounded(out, "mean_dev", "stdev_dev", "zone")


# ---- what SQL can't say ------------------------------------------------------------------------------------------------------
@query(f"""
with recursive thin as (
    select key, x, y, row_number() over (order by key) as n from (select *, row_number() over (partition by floor(x / 0.75), floor(y / 0.75) order by key) as k from {PARTS}) where k = 1
), kept as (
    select n, [struct_pack(key := key, x := x, y := y)] as k from thin where n = 1
    union all
    select t.n, case when len(list_filter(kept.k, lambda q: (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) <= 9.0)) = 0 then list_append(kept.k, struct_pack(key := t.key, x := t.x, y := t.y)) else kept.k end
    from kept join thin t on t.n = kept.n + 1
)
select r.key, r.x, r.y from (select unnest(k) as r from kept where n = (select max(n) from thin))
""")
def poisson_disk(spark, sf):
    return sampling.poisson_disk(_parts(spark, sf), "key", ("x", "y"), 3.0)


@query(f"""
with recursive p as (select curve, seq, x, y, row_number() over (partition by curve order by seq) as n from {C}), s as (
    select curve, min(n) as i, max(n) as j from p group by curve
    union all
    select curve, unnest([i, k]) as i, unnest([k, j]) as j from (
        select s.curve, s.i, s.j, arg_max(p.n, struct_pack(d := sqrt((p.x - a.x - t * (b.x - a.x)) ** 2 + (p.y - a.y - t * (b.y - a.y)) ** 2), m := -p.n)) as k, max(sqrt((p.x - a.x - t * (b.x - a.x)) ** 2 + (p.y - a.y - t * (b.y - a.y)) ** 2)) as d
        from s join p a on a.curve = s.curve and a.n = s.i join p b on b.curve = s.curve and b.n = s.j join p on p.curve = s.curve and p.n > s.i and p.n < s.j,
            lateral (select coalesce(((p.x - a.x) * (b.x - a.x) + (p.y - a.y) * (b.y - a.y)) / nullif((b.x - a.x) ** 2 + (b.y - a.y) ** 2, 0), 0) as t)
        group by s.curve, s.i, s.j
    ) where d > 2.0
)
select curve, seq, x, y from p semi join (select curve, i as n from s union select curve, j from s) k on k.curve = p.curve and k.n = p.n
""")
def rdp_simplify(spark, sf):
    return curves.simplify(W.order_curves(spark, sf), ["curve"], 2.0)


#: Around each hull: the next corner is in the direction that turns least from the last one, the farthest of equal directions.
HULL = f"""
with recursive p as (select distinct grp, x, y from {P}), s as (
    select grp, x, y from (select *, row_number() over (partition by grp order by x, y) as n from p) where n = 1
), h as (
    select grp, 0 as position, x, y, x as sx, y as sy, -0.5 * pi() as a from s
    union all
    select grp, position + 1, (t).x, (t).y, sx, sy, (t).a from (
        select h.grp, h.position, h.sx, h.sy, min(struct_pack(a := u.a, d := -u.d, x := u.x, y := u.y)) as t
        from h join (select grp as g, x, y from p) q on q.g = h.grp and (q.x <> h.x or q.y <> h.y),
            lateral (select q.x as x, q.y as y, sqrt((q.x - h.x) * (q.x - h.x) + (q.y - h.y) * (q.y - h.y)) as d,
                case when atan2(q.y - h.y, q.x - h.x) < -0.5 * pi() then atan2(q.y - h.y, q.x - h.x) + 2 * pi() else atan2(q.y - h.y, q.x - h.x) end as a) u
        where u.a >= h.a group by h.grp, h.position, h.sx, h.sy
    ) where (t).x <> sx or (t).y <> sy
)
select grp, cast(position as bigint) as position, x, y from h
"""


@query(HULL)
def convex_hull(spark, sf):
    return sampling.convex_hulls(W.line_points(spark, sf).select("grp", "x", "y"), ["grp"])


def _circle_sql(rounds: int) -> str:
    """An algebraic start, then Gauss-Newton steps, each solved by Cramer's rule."""
    solve = lambda xx, xy, x, yy, y, n, a, b, c: (f"({xx} * ({yy} * {n} - {y} * {y}) - {xy} * ({xy} * {n} - {y} * {x}) + {x} * ({xy} * {y} - {yy} * {x}))", f"({a} * ({yy} * {n} - {y} * {y}) - {xy} * ({b} * {n} - {y} * {c}) + {x} * ({b} * {y} - {yy} * {c}))", f"({xx} * ({b} * {n} - {y} * {c}) - {a} * ({xy} * {n} - {y} * {x}) + {x} * ({xy} * {c} - {b} * {x}))", f"({xx} * ({yy} * {c} - {b} * {y}) - {xy} * ({xy} * {c} - {b} * {x}) + {a} * ({xy} * {y} - {yy} * {x}))")
    det, d1, d2, d3 = solve("xx", "xy", "x", "yy", "y", "n", "xe", "ye", "e")
    out = [
        f"p as (select grp, x::double as x, y::double as y, avg(x) over (partition by grp) as mx, avg(y) over (partition by grp) as my from {P})",
        "q as (select grp, any_value(mx) as mx, any_value(my) as my, count(*)::double as n, sum(x - mx) as x, sum(y - my) as y, sum((x - mx) ** 2) as xx, sum((x - mx) * (y - my)) as xy, sum((y - my) ** 2) as yy, sum(((x - mx) ** 2 + (y - my) ** 2) * (x - mx)) as xe, sum(((x - mx) ** 2 + (y - my) ** 2) * (y - my)) as ye, sum((x - mx) ** 2 + (y - my) ** 2) as e from p group by grp)",
        f"s as (select grp, mx, my, {d1} / {det} / 2 as u, {d2} / {det} / 2 as v, {d3} / {det} as w from q)",
        "c0 as (select grp, mx + u as cx, my + v as cy, sqrt(w + u * u + v * v) as r from s)",
    ]
    for k in range(rounds):
        terms = "count(*)::double as n, sum(ux) as x, sum(uy) as y, sum(ux * ux) as xx, sum(ux * uy) as xy, sum(uy * uy) as yy, sum(ux * e) as xe, sum(uy * e) as ye, sum(e) as e"
        out.append(f"m{k} as (select grp, any_value(cx) as cx, any_value(cy) as cy, any_value(r) as r, {terms} from (select p.grp, cx, cy, r, (x - cx) / d as ux, (y - cy) / d as uy, d - r as e from p join c{k} using (grp), lateral (select sqrt((x - cx) ** 2 + (y - cy) ** 2) as d)) group by grp)")
        out.append(f"c{k + 1} as (select grp, cx + {d1} / {det} as cx, cy + {d2} / {det} as cy, r + {d3} / {det} as r from m{k})")
    return f"with {', '.join(out)} select grp, round(cx, 4) as cx, round(cy, 4) as cy, round(r, 4) as radius from c{rounds}"


@query(_circle_sql(8))
def circle_fit(spark, sf):
    return rounded(stats.circle_fit(W.line_points(spark, sf), ["grp"], "x", "y", rounds=8), "cx", "cy", "radius", digits=4)


@query()
def mesh_deviation(spark, sf):
    from ..operators import mesh

    ball = mesh.sphere(spark, 40.0, 24, 12)
    points = W.line_points(spark, sf).select("key", (F.col("x") - 25).alias("x"), (F.col("y") - 40).alias("y"), (F.col("z") * 2).alias("z"))
    return mesh.deviations(points, ball, "key").select("key", "fid", F.round("deviation", 6).alias("deviation"))


@query(f"""
with h as (select key, x - 25.0 + 4.5 as x, y - 40.0 as y from {P})
select key, 45.0 as t, cast(case when x / 60.0 >= y / 80.0 then 2 else 3 end as bigint) as fid, x, y, 5.0 as z from h where abs(x) <= 30 and abs(y) <= 40
""")
def ray_bundle(spark, sf):
    from ..operators import mesh

    box = mesh.box(spark, 60.0, 80.0, 10.0)
    rays = W.line_points(spark, sf).select("key", (F.col("x") - 25.0).alias("ox"), (F.col("y") - 40.0).alias("oy"), F.lit(50.0).alias("oz"), F.lit(0.1).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"))
    return mesh.ray_hits(rays, box, "key")


@query()
def mesh_section(spark, sf):
    from ..operators import mesh

    return mesh.cylinder(spark, 1.0, 2.0, 64).section((0.0, 1.0, 0.0), 0.013)


@query("""
with a as (select cos(0.03) as cx, sin(0.03) as sx, cos(-0.02) as cy, sin(-0.02) as sy, cos(0.05) as cz, sin(0.05) as sz), m as (
    select unnest([[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, 0.4], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -0.3], [-sy, cy * sx, cy * cx, 0.2], [0.0, 0.0, 0.0, 1.0]]) as r, unnest(range(0, 4)) as i from a)
select cast(i as integer) as "row", cast(j as integer) as col, round(r[j + 1], 6) as v from m, range(0, 4) t(j)
""")
def rigid_alignment(spark, sf):
    import numpy as np

    from ..operators import align, mesh

    box = mesh.box(spark, 20.0, 12.0, 6.0)
    true = align.iso3(0.4, -0.3, 0.2, 0.03, -0.02, 0.05)
    p = V.transform(V.vec("x", "y", "z"), np.linalg.inv(true)[:3])
    shell = sampling.dense_samples(box.corners(), 2.0).select(*(e.alias(n) for e, n in zip(p, "xyz", strict=True)))
    found = align.points_to_mesh(shell, box)
    rows = [(i, j, round(float(found.transform[i, j]), 6)) for i in range(4) for j in range(4)]
    return spark.createDataFrame(rows, "row int, col int, v double")


@query(f"""
with b as (select i, j, 4 - sqrt(16 - i * i - j * j) as h from range(-4, 5) a(i), range(-4, 5) b(j) where i * i + j * j <= 16),
rest as (select r.row + b.i as row, r.col + b.j as col, max(r.v - b.h) as low from {R} r, b group by all)
select r.row, r.col, round(min(t.low + b.h), 6) as v from {R} r, b join rest t on t.row = r.row + b.i and t.col = r.col + b.j group by r.row, r.col
""")
def raster_rolling_ball(spark, sf):
    return rounded(raster.rolling_ball(W.price_raster(spark, sf).select("row", "col", "v"), (), 4.0, 1.0), "v")


@query(f"""
with k as (select i, j, exp(-0.5 * (i * i + j * j) / 2.25) as w from range(-4, 5) a(i), range(-4, 5) b(j))
select r.row, r.col, round(sum(n.v * k.w) / sum(k.w), 6) as v from {R} r, k join {R} n on n.row = r.row + k.i and n.col = r.col + k.j group by r.row, r.col
""")
def raster_gaussian(spark, sf):
    return rounded(raster.convolve(W.price_raster(spark, sf).select("row", "col", "v"), (), raster.gaussian_kernel(1.5)), "v")


def _thinning_sql(steps: int) -> str:
    """Zhang and Suen's two conditions in turn, written out; more steps than the mask is thick change nothing."""
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    side = "values " + ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate(around))
    out = [f"o(i, r, c) as ({side})", f"a0 as materialized (select row, col from {R})"]
    for k in range(2 * steps):
        free = "not (n[1] and n[3] and n[7]) and not (n[1] and n[5] and n[7])" if k % 2 else "not (n[1] and n[3] and n[5]) and not (n[3] and n[5] and n[7])"
        turns = " + ".join(f"(not n[{i + 1}] and n[{(i + 1) % 8 + 1}])::int" for i in range(8))
        near = f"select a.row, a.col, list(b.row is not null order by o.i) as n from a{k} a cross join o left join a{k} b on b.row = a.row + o.r and b.col = a.col + o.c group by a.row, a.col"
        out.append(f"a{k + 1} as materialized (select row, col from ({near}) where not (len(list_filter(n, lambda x: x)) between 2 and 6 and {turns} = 1 and {free}))")
    return f"with {', '.join(out)} select row, col from a{2 * steps}"


@query(_thinning_sql(40))
def raster_thinning(spark, sf):
    return raster.thin(W.price_raster(spark, sf).select("row", "col"), ())


@query()
def raster_inpaint(spark, sf):
    r = W.price_raster(spark, sf).select("row", "col", "v")
    holes = raster.disk(spark, 30.0, 20.0, 4.0)
    return rounded(raster.inpaint(r, holes, (), 3), "v")


@query("""
with p as (select p_partkey as key, cast(p_size as double) as x, p_retailprice / 100 as y, p_size * 0.25 + p_retailprice / 10 * 0.05 as z from part), n as (
    select a.key, count(*) as n from p a join p b on b.x between a.x - 3 and a.x + 3 and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 9 group by a.key)
select key, case when n < 3 then 0.0 else round(-0.25 / sqrt(1.3125), 4) end as nx, case when n < 3 then 0.0 else round(-0.5 / sqrt(1.3125), 4) end as ny, case when n < 3 then 1.0 else round(1 / sqrt(1.3125), 4) end as nz from n
""")
def normal_estimation(spark, sf):
    from ..operators import normals

    p = _parts(spark, sf).select("key", "x", (F.col("y") / 10).alias("y"), (F.col("x") * 0.25 + F.col("y") * 0.05).alias("z"))
    return normals.estimate_normals(p, "key", 3.0).select("key", *(F.round(c, 4).alias(c) for c in ("nx", "ny", "nz")))


@query()
def airfoil_sections(spark, sf):
    from ..operators import airfoil

    t = F.col("k") * (2 * math.pi / 200)
    c = (F.cos(t) + 1) / 2
    half = (F.col("s_nationkey") % 10 + 8) / 100.0 * 5 * (F.sqrt(c) * 0.2969 - c * 0.126 - c * c * 0.3516 + c * c * c * 0.2843 - c * c * c * c * 0.1036)
    rows = W.table(spark, sf, "supplier").groupBy("s_nationkey").count().select("s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("k"))
    pts = rows.select(F.col("s_nationkey").alias("section"), F.col("k").alias("seq"), c.alias("x"), F.when(F.sin(t) >= 0, half).otherwise(-half).alias("y"))
    return airfoil.analyse_sections(pts, "section", 1e-3).select("section", F.round("t_max", 4).alias("t_max"), F.round("chord", 3).alias("chord"))


# ---- host-engine sanity ---------------------------------------------------------------------------------------------------
@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by all")
def pricing_summary(spark, sf):
    return W.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by cube (r_name, n_name)")
def customer_cube(spark, sf):
    t = W.table(spark, sf, "customer").join(W.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(W.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.cube("r_name", "n_name").agg(F.count("*").alias("n"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def customers_without_orders(spark, sf):
    return W.table(spark, sf, "customer").join(W.table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def top_orders(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return W.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 3")
