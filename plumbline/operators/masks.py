"""Selections: a set of row keys as a DataFrame, or a boolean column, and the algebra of both."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SelectOp(Enum):
    ADD = "add"
    REMOVE = "remove"
    KEEP = "keep"


def select_column(selected: Column, passes: Column, op: SelectOp) -> Column:
    """A selection after an operation; a test that is null doesn't pass."""
    passes = F.coalesce(passes, F.lit(False))
    return {SelectOp.ADD: selected | passes, SelectOp.REMOVE: selected & ~passes, SelectOp.KEEP: selected & passes}[op]


def select_keys(selected: DataFrame, passes: DataFrame, op: SelectOp) -> DataFrame:
    """The same for sets of keys (one column, equal names)."""
    return {SelectOp.ADD: union, SelectOp.REMOVE: difference, SelectOp.KEEP: intersection}[op](selected, passes)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return union(difference(a, b), difference(b, a))


def complement(mask: DataFrame, spark: SparkSession, length: int) -> DataFrame:
    """Row numbers in [0, length) that aren't in the mask."""
    key = mask.columns[0]
    return spark.range(length).select(F.col("id").alias(key)).join(mask, key, "left_anti")


def complement_of(mask: DataFrame, universe: DataFrame) -> DataFrame:
    return difference(universe, mask)


def checked(mask: DataFrame, length: int) -> DataFrame:
    """mask, failing on a row number outside [0, length)."""
    key = mask.columns[0]
    bad = (F.col(key) < 0) | (F.col(key) >= length)
    return mask.withColumn(key, F.when(bad, F.raise_error(F.lit("a row number is out of range")).cast("long")).otherwise(F.col(key)))


def gather(items: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """Rows of items whose key is in the mask."""
    return items.join(mask.select(key).distinct(), key, "left_semi")


def gather_ordered(items: DataFrame, indices: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Rows by a list of keys (position, key): keys may repeat; a key that items lack fails."""
    got = indices.join(items.withColumn("_found", F.lit(True)), key, "left")
    lost = F.when(F.col("_found").isNull(), F.raise_error(F.lit("an index is out of range")).cast("long")).otherwise(F.col(position).cast("long"))
    return got.withColumn(position, lost).drop("_found")


def flip(mask: DataFrame, keys: DataFrame) -> DataFrame:
    return symmetric_difference(mask, keys)


def expand(selected: DataFrame, faces: DataFrame, hops: int = 1, exclude: DataFrame | None = None, fid: str = "fid", corners: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """The selection and all faces that share a vertex with it, so many hops far; faces in exclude are never added."""
    at = faces.select(fid, F.explode(F.array(*corners)).alias("_v")).distinct()
    out = selected.select(fid).distinct()
    for _ in range(hops):
        reached = at.join(at.join(out, fid, "left_semi").select("_v").distinct(), "_v", "left_semi").select(fid).distinct()
        if exclude is not None:
            reached = reached.join(exclude, fid, "left_anti")
        out = out.union(reached).distinct()
    return out


def shrink(selected: DataFrame, faces: DataFrame, hops: int = 1, fid: str = "fid", corners: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """The selection without the faces that share a vertex with one outside it."""
    every = faces.select(fid)
    outside = expand(difference(every, selected.select(fid)), faces, hops, None, fid, corners)
    return difference(selected.select(fid), outside)


# ---- boxes ---------------------------------------------------------------------------------------------------------------
def in_box(p, low, high) -> Column:
    """Closed on all sides."""
    out = F.lit(True)
    for x, a, b in zip(p, low, high, strict=True):
        out = out & x.between(a, b)
    return out


def box_expand(low, high, by: float):
    return [x - by for x in low], [x + by for x in high]


def box_merge(low1, high1, low2, high2):
    return [F.least(a, b) for a, b in zip(low1, low2, strict=True)], [F.greatest(a, b) for a, b in zip(high1, high2, strict=True)]


def box_intersection(low1, high1, low2, high2):
    """(low, high, whether they meet)."""
    low = [F.greatest(a, b) for a, b in zip(low1, low2, strict=True)]
    high = [F.least(a, b) for a, b in zip(high1, high2, strict=True)]
    meets = F.lit(True)
    for a, b in zip(low, high, strict=True):
        meets = meets & (a <= b)
    return low, high, meets
