"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, remove, scratch, stored


def fingerprint(links: DataFrame) -> tuple:
    """Tells sets of different links (a, b) apart, of any size: a sum of hashes would leave 64 bits."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> node, root for every node with an edge; root is the smallest node of its component.

    Alternates large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond). A step is a
    minimum for each node, summed up before the shuffle, and a join back that adaptive execution may split at a hub. Each
    round is written to the shared folder and the round before it removed. Each round that isn't the last brings some node's
    link closer to its root, so it ends. Nulls and self-links are dropped.
    """
    spark = edges.sparkSession
    link = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    path = new_path(spark, "edges")
    edges.select(*link).filter("a is not null and b is not null and a <> b").distinct().write.parquet(path)
    before = None
    while True:
        state = spark.read.schema("a long, b long").parquet(path)
        now = fingerprint(state)
        if now == before:
            break
        before = now
        # what is joined is written first: a join with an aggregate isn't split at a hub
        with scratch(spark) as mine:
            both = state.unionAll(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
            large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
            large = stored(large, "large")
            least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
            small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            made = new_path(spark, "edges")
            mine.remove(made)  # this one stays
            small.filter("a <> b").distinct().write.parquet(made)
        remove(spark, path)
        path = made
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def all_but_first(rows: DataFrame, edges: DataFrame, *name: str) -> DataFrame:
    """rows (node, doc_id, two columns that name a row) -> the names, stored, of all rows but one of each component.

    The row with the smallest doc_id stays (null last; of several the first by name). Rows of one node are a component
    even without an edge. A hot node's rows are split by adaptive execution; firsts are summed up before the shuffle.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *name)
    nodes = rows.groupBy("node").agg(F.min(first).alias("first"))
    rooted = stored(nodes.join(components(edges), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "rooted")
    stays = stored(rooted.groupBy("root").agg(F.min("first").alias("stays")), "stays")
    told = stored(rooted.join(stays, "root").select("node", "stays"), "told")
    judged = rows.select("node", *name).join(told, "node")
    stay = (F.col(name[0]) == F.col(f"stays.{name[0]}")) & (F.col(name[1]) == F.col(f"stays.{name[1]}"))
    return stored(judged.filter(~stay).select(*name), "gone")
