"""The driver's tables as points, series, rasters, curves and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, grp, x, y, z: a point for each order line, as quantity, price and discount."""
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(key.alias("key"), F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


LINE_POINTS = "select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as key, l_returnflag as grp, l_quantity as x, l_extendedprice / 1000 as y, l_discount * 100 as z from lineitem"


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, event_id: a series for each user, in seconds since 2024."""
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), seconds.alias("x"), F.col("value").alias("y"), "event_id")


EVENT_SERIES = "select user_id as id, (epoch_us(ts) - 1704067200000000) / 1e6 as x, value as y, event_id from events"


def price_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, v, stdev, n: mean discount by whole price and quantity."""
    from ..operators.raster import from_points

    return from_points(line_points(spark, sf_dir), (), 1.0)


PRICE_RASTER = f"select cast(floor(y) as bigint) as row, cast(floor(x) as bigint) as col, avg(z) as v, stddev_pop(z) as stdev, count(*) as n from ({LINE_POINTS}) group by all"


def order_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """curve, seq, x, y: a polyline for each customer, through their orders by key."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("curve"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 10000).alias("x"), (F.col("o_orderkey") % 997 / 10.0).alias("y"))


ORDER_CURVES = "select o_custkey as curve, o_orderkey as seq, o_totalprice / 10000 as x, o_orderkey % 997 / 10.0 as y from orders"


def part_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, a, b, c: a triangle for each pair of order lines' suppliers around a part; corners are supplier keys."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"))
    n = 10
    return s.select(F.col("a").alias("fid"), "a", (F.col("a") + 1).alias("b"), (F.col("a") + n).alias("c"))


PART_FACES = "select s_suppkey as fid, s_suppkey as a, s_suppkey + 1 as b, s_suppkey + 10 as c from supplier"


def customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, j: the cells of balance and nation that hold a customer."""
    return table(spark, sf_dir, "customer").select(F.floor(F.col("c_acctbal") / 20).cast("long").alias("i"), F.col("c_nationkey").cast("long").alias("j")).distinct()


CUSTOMER_CELLS = "select distinct cast(floor(c_acctbal / 20) as bigint) as i, cast(c_nationkey as bigint) as j from customer"
