"""Point clouds: idx, x, y, z and, where a cloud has them, nx, ny, nz, r, g, b and std_dev."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import joins, masks, sampling
from .mesh import Mesh, closest, numbered

OPTIONAL = {"normals": ("nx", "ny", "nz"), "colors": ("r", "g", "b"), "std_devs": ("std_dev",)}


@dataclass
class PointCloud:
    rows: DataFrame

    @staticmethod
    def empty(spark: SparkSession, normals: bool = False, colors: bool = False, std_devs: bool = False) -> PointCloud:
        kinds = ["idx long", "x double", "y double", "z double"]
        kinds += [f"{n} {'short' if k == 'colors' else 'double'}" for k, on in (("normals", normals), ("colors", colors), ("std_devs", std_devs)) if on for n in OPTIONAL[k]]
        return PointCloud(spark.createDataFrame([], ", ".join(kinds)))

    @staticmethod
    def of(points: DataFrame) -> PointCloud:
        """Fails where a row has only part of an optional group, or normals that aren't of length one."""
        rows = points
        for names in OPTIONAL.values():
            have = [n for n in names if n in points.columns]
            if have and len(have) != len(names):
                raise ValueError(f"a cloud has all of {', '.join(names)} or none")
        if "nx" in points.columns:
            size = V.norm(V.vec("nx", "ny", "nz"))
            rows = rows.withColumn("nx", F.when(F.abs(size - 1) > 1e-3, F.raise_error(F.lit("a normal isn't of length one")).cast("double")).otherwise(F.col("nx")))
        return PointCloud(rows)

    def features(self) -> dict[str, bool]:
        return {k: names[0] in self.rows.columns for k, names in OPTIONAL.items()}

    def merged(self, other: PointCloud) -> PointCloud:
        """Both clouds, the other's numbers behind this one's; fails unless both have the same optional columns."""
        if self.features() != other.features():
            raise ValueError("the clouds differ in what they have besides points")
        shift = int(self.rows.agg(F.max("idx")).first()[0] or -1) + 1 if self.rows.limit(1).count() else 0
        return PointCloud(self.rows.unionByName(other.rows.withColumn("idx", F.col("idx") + shift).select(*self.rows.columns)))

    def transformed(self, matrix: Sequence[Sequence[float]]) -> PointCloud:
        """Normals turn only."""
        p = dict(zip("xyz", V.transform(V.vec("x", "y", "z"), matrix), strict=True))
        if "nx" in self.rows.columns:
            p |= dict(zip(("nx", "ny", "nz"), V.transform(V.vec("nx", "ny", "nz"), matrix, vector=True), strict=True))
        return PointCloud(self.rows.withColumns(p))

    def selected(self, mask: DataFrame) -> PointCloud:
        return PointCloud(masks.gather(self.rows, mask, "idx"))

    def picked(self, indices: DataFrame) -> PointCloud:
        """Rows by a list (position, idx) that may repeat; fails on a number that the cloud lacks."""
        return PointCloud(masks.gather_ordered(self.rows, indices, "idx").drop("idx").withColumnRenamed("position", "idx").select(*self.rows.columns))

    def poisson_sample(self, radius: float) -> PointCloud:
        return PointCloud(sampling.poisson_disk(self.rows, "idx", ("x", "y", "z"), radius))

    def voxel_sample(self, size: float) -> PointCloud:
        return PointCloud(sampling.voxel_downsample(self.rows, "idx", ["x", "y", "z"], size))

    def renumbered(self) -> PointCloud:
        return PointCloud(numbered(self.rows, "idx").drop("idx").withColumnRenamed("n", "idx").select(*self.rows.columns))

    def overlap_with_cloud(self, other: PointCloud, max_distance: float, radius: float | None = None) -> DataFrame:
        return joins.overlap_by_reciprocity(self.rows, other.rows, "idx", ("x", "y", "z"), max_distance, radius or max_distance)

    def overlap_with_mesh(self, mesh: Mesh, max_distance: float) -> DataFrame:
        """idx of the points from which going to the mesh and from there to the cloud ends closer than max_distance."""
        on = closest(self.rows, mesh, "idx").select("idx", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
        back = joins.nearest_join(on, self.rows, "idx", "idx", ("x", "y", "z"), max_distance)
        ends = self.rows.select(F.col("idx").alias("idx_2"), *(F.col(c).alias(f"_e{c}") for c in "xyz"))
        gap = V.dist(V.vec("x", "y", "z"), V.vec("_ex", "_ey", "_ez"))
        return back.select("idx", "idx_2").join(ends, "idx_2").join(self.rows.select("idx", "x", "y", "z"), "idx").filter(gap < max_distance).select("idx")
