"""Streams of measurements: incremental averages, tolerance checks and runs, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_average(stream: DataFrame, time: str, value: str, by: list[str], window: str = "1 hour", slide: str | None = None, late: str = "1 hour", weight: str | None = None) -> DataFrame:
    """by, start, end, n, mean (weighted where a weight is given), low, high for each window; rows later than late are dropped."""
    w = F.col(weight) if weight else F.lit(1.0)
    at = F.window(time, window, slide) if slide else F.window(time, window)
    out = stream.withWatermark(time, late).groupBy(*by, at.alias("w")).agg(F.count("*").alias("n"), (F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "low", "high")


def runs(stream: DataFrame, time: str, by: list[str], gap: str, late: str = "1 hour", value: str = "value") -> DataFrame:
    """Sessions of rows no more than gap apart: by, start, end, n, zone (twice the largest absolute value)."""
    out = stream.withWatermark(time, late).groupBy(*by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), (F.max(F.abs(F.col(value))) * 2).alias("zone"))
    return out.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "zone")


def out_of_tolerance(stream: DataFrame, zones: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows of the stream outside their static zone (by, lower, upper)."""
    return stream.join(zones, by).filter(~F.col(value).between(F.col("lower"), F.col("upper")))


def once_per_batch(path: str):
    """For foreachBatch: a batch that is sent again replaces what it wrote before, so sums over the folder count it once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run


def replayed(spark: SparkSession, table: str, path: str, summed) -> DataFrame:
    """A Parquet table read as a stream until all of it is read: summed(stream) in complete mode, kept in path.

    Each batch replaces the result as a whole, so one that is sent again changes nothing.
    """
    pattern = f"{table[:-1]}[{table[-1]}]"  # a table may be one file; only as a pattern does a stream take that
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(pattern)
    result = f"{path}/result"
    run = summed(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    run.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(result)).start().awaitTermination()
    return spark.read.parquet(result)
