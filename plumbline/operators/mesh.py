"""Triangle meshes: vertices (vid, x, y, z) and faces (fid, a, b, c), two DataFrames.

A mesh that points are measured against is shipped to the tasks in parts of bounded size; each part answers with its
closest place, and the closest of all parts is kept, so a mesh may be larger than a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import masks
from .checkpoints import cut
from .graph import chain, directed_edges

#: Faces that are shipped to a task at once (some 100 MB).
PART_FACES = 1_000_000
#: Rows of a table that goes to every task of a join.
DIRECTORY = 262_144


@dataclass
class Mesh:
    vertices: DataFrame
    faces: DataFrame

    # ---- geometry ---------------------------------------------------------------------------------------------------
    def corners(self) -> DataFrame:
        """fid, a, b, c, x0..z2: three equi-joins."""
        out = self.faces.select("fid", "a", "b", "c")
        for k, name in enumerate("abc"):
            v = self.vertices.select(F.col("vid").alias(name), *(F.col(n).alias(f"{n}{k}") for n in "xyz"))
            out = out.join(v, name)
        return out

    def face_geometry(self) -> DataFrame:
        """fid, nx, ny, nz, area; the normal of a face without area is null."""
        return self.corners().select("fid", *(n.alias(f"n{c}") for n, c in zip(normal_of(), "xyz", strict=True)), area_of().alias("area"))

    def face_normals(self) -> DataFrame:
        """Fails on a face without area."""
        bad = F.when(F.col("nx").isNull(), F.raise_error(F.lit("a face has no normal")).cast("double")).otherwise(F.col("nx"))
        return self.face_geometry().select("fid", bad.alias("nx"), "ny", "nz")

    def vertex_normals(self) -> DataFrame:
        """Unit mean of the adjacent faces' normals weighted by area; zero for a vertex without faces."""
        c = self.corners()
        n = V.cross(V.sub(_corner(1), _corner(0)), V.sub(_corner(2), _corner(0)))
        spread = c.select(F.explode(F.array("a", "b", "c")).alias("vid"), *(e.alias(f"_{k}") for e, k in zip(n, "xyz", strict=True)))
        sums = spread.groupBy("vid").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in "xyz"))
        u = V.unit(tuple(F.col(f"_{k}") for k in "xyz"))
        return self.vertices.select("vid").join(sums, "vid", "left").select("vid", *(F.coalesce(e, F.lit(0.0)).alias(f"n{k}") for e, k in zip(u, "xyz", strict=True)))

    def aabb(self) -> DataFrame:
        return self.vertices.agg(*(f(n).alias(f"{n}_{k}") for n in "xyz" for f, k in ((F.min, "min"), (F.max, "max"))))

    # ---- changes ------------------------------------------------------------------------------------------------------
    def transformed(self, matrix: Sequence[Sequence[float]]) -> Mesh:
        p = V.transform(V.vec("x", "y", "z"), matrix)
        return Mesh(self.vertices.select("vid", *(e.alias(n) for e, n in zip(p, "xyz", strict=True))), self.faces)

    def scaled(self, factor: float) -> Mesh:
        return Mesh(self.vertices.select("vid", *((F.col(n) * factor).alias(n) for n in "xyz")), self.faces)

    def offset(self, distance: float) -> Mesh:
        """Vertices moved along their normals."""
        moved = self.vertices.join(self.vertex_normals(), "vid")
        return Mesh(moved.select("vid", *((F.col(n) + F.col(f"n{n}") * distance).alias(n) for n in "xyz")), self.faces)

    def append(self, other: Mesh) -> Mesh:
        """Both meshes; the other's numbers are moved behind this one's."""
        dv, df = (int(t.agg(F.max(k)).first()[0] or -1) + 1 for t, k in ((self.vertices, "vid"), (self.faces, "fid")))
        v = other.vertices.select((F.col("vid") + dv).alias("vid"), "x", "y", "z")
        f = other.faces.select((F.col("fid") + df).alias("fid"), *((F.col(n) + dv).alias(n) for n in "abc"))
        return Mesh(self.vertices.select("vid", "x", "y", "z").unionByName(v), self.faces.select("fid", "a", "b", "c").unionByName(f))

    def merged_duplicates(self) -> Mesh:
        """Vertices at the same place become one, the smallest vid; faces that lose a corner go."""
        head = self.vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("head"))
        to = self.vertices.join(head, ["x", "y", "z"]).select("vid", "head")
        faces = self.faces
        for n in "abc":
            faces = faces.join(to.withColumnRenamed("vid", n), n).drop(n).withColumnRenamed("head", n)
        kept = self.vertices.join(head.select(F.col("head").alias("vid")), "vid", "left_semi")
        return Mesh(kept, faces.filter("a <> b and b <> c and a <> c").select("fid", "a", "b", "c"))

    def without_degenerate(self, tol: float = 0.0) -> Mesh:
        bad = self.corners().filter(area_of() <= tol).select("fid")
        return Mesh(self.vertices, self.faces.join(bad, "fid", "left_anti"))

    def submesh(self, selected: DataFrame) -> Mesh:
        """The selected faces (fid) with vertices numbered anew in ascending order of their old numbers."""
        used = self.faces.join(selected.select("fid").distinct(), "fid", "left_semi")
        vids = used.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
        to = numbered(vids, "vid").withColumnRenamed("n", "new")
        faces = numbered(used, "fid").drop("fid").withColumnRenamed("n", "fid")
        for n in "abc":
            faces = faces.join(to.withColumnRenamed("vid", n), n).drop(n).withColumnRenamed("new", n)
        return Mesh(self.vertices.join(to, "vid").select(F.col("new").alias("vid"), "x", "y", "z"), faces.select("fid", "a", "b", "c"))

    # ---- selections: boolean columns over corners() --------------------------------------------------------------------
    def facing(self, direction: Sequence[float], angle: float) -> DataFrame:
        """fid of the faces whose normal is less than angle off a direction; faces without area never are."""
        turn = V.angle_between(normal_of(), V.vec(*map(float, direction)))
        return self.corners().filter(turn < angle).select("fid")

    def above_plane(self, n: Sequence[float], d: float, all_vertices: bool = True) -> DataFrame:
        return self._by_corner(lambda p: V.dot(p, V.vec(*map(float, n))) - float(d) >= 0, all_vertices)

    def near_point(self, point: Sequence[float], max_dist: float, all_vertices: bool = True) -> DataFrame:
        return self._by_corner(lambda p: V.dist2(p, V.vec(*map(float, point))) <= max_dist**2, all_vertices)

    def _by_corner(self, test, all_vertices: bool) -> DataFrame:
        passes = [test(_corner(k)) for k in range(3)]
        return self.corners().filter(reduce((lambda a, b: a & b) if all_vertices else (lambda a, b: a | b), passes)).select("fid")

    def near_mesh(self, other: Mesh, distance: float, all_points: bool = True, planar: float | None = None, angle: float | None = None) -> DataFrame:
        """fid of the faces whose corners (all or any) lie within distance of another mesh; planar: also within that of
        the closest face's plane; angle: also with normals closer than that."""
        found = closest(self.vertices.select(F.col("vid").alias("id"), "x", "y", "z"), other, "id")
        ok = F.col("d") <= distance
        if planar is not None:
            ok = ok & (F.abs((F.col("x") - F.col("px")) * F.col("nx") + (F.col("y") - F.col("py")) * F.col("ny") + (F.col("z") - F.col("pz")) * F.col("nz")) <= planar)
        met = found.select(F.col("id").alias("vid"), ok.alias("ok"), F.col("nx").alias("onx"), F.col("ny").alias("ony"), F.col("nz").alias("onz"))
        spread = self.faces.select("fid", F.explode(F.array("a", "b", "c")).alias("vid")).join(met, "vid")
        if angle is not None:
            spread = spread.join(self.face_geometry(), "fid")
            turn = V.angle_between(V.vec("nx", "ny", "nz"), V.vec("onx", "ony", "onz"))
            spread = spread.withColumn("ok", F.col("ok") & F.coalesce(turn <= angle, F.lit(False)))
        test = F.bool_and("ok") if all_points else F.bool_or("ok")
        return spread.groupBy("fid").agg(test.alias("ok")).filter("ok").select("fid")

    # ---- plane cuts -----------------------------------------------------------------------------------------------------
    def side_of_plane(self, n: Sequence[float], d: float) -> str:
        """positive, negative or both."""
        s = V.dot(V.vec("x", "y", "z"), V.vec(*map(float, n))) - float(d)
        low, high = self.vertices.agg(F.min(s), F.max(s)).first()
        return "positive" if low >= 0 else "negative" if high <= 0 else "both"

    def section_segments(self, n: Sequence[float], d: float) -> DataFrame:
        """fid, x0, y0, z0, x1, y1, z1 and keys e0, e1 of the mesh edges cut: a row for each face that a plane cuts."""
        unit = V.vec(*map(float, n))
        rows = self.corners()
        for k in range(3):
            rows = rows.withColumn(f"s{k}", V.dot(_corner(k), unit) - float(d))
        # a corner on the plane counts as above it, so that each cut face has one edge in and one edge out
        ends = []
        for i, j, a, b in ((0, 1, "a", "b"), (1, 2, "b", "c"), (2, 0, "c", "a")):
            crosses = (F.col(f"s{i}") >= 0) != (F.col(f"s{j}") >= 0)
            t = F.col(f"s{i}") / F.nullif(F.col(f"s{i}") - F.col(f"s{j}"), F.lit(0.0))
            place = [(F.col(f"{c}{i}") + (F.col(f"{c}{j}") - F.col(f"{c}{i}")) * t).alias(c) for c in "xyz"]
            # from below to above: the end of the segment; from above to below: its start
            ends.append(F.when(crosses, F.struct((F.col(f"s{i}") >= 0).cast("int").alias("o"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), *place)))
        both = F.sort_array(F.filter(F.array(*ends), lambda e: e.isNotNull()), asc=False)
        cutting = rows.select("fid", both.alias("e")).filter(F.size("e") == 2)
        first, second = F.col("e")[0], F.col("e")[1]
        return cutting.select("fid", *(first[c].alias(f"{c}0") for c in "xyz"), *(second[c].alias(f"{c}1") for c in "xyz"), F.struct(first["lo"], first["hi"]).alias("e0"), F.struct(second["lo"], second["hi"]).alias("e1"))

    def section(self, n: Sequence[float], d: float) -> DataFrame:
        """chain, position, x, y, z, loop: the section as chained curves."""
        segs = cut(self.section_segments(n, d), "section")
        ids = numbered(segs.select(F.col("e0").alias("e")).union(segs.select("e1")).distinct(), "e")
        links = segs.join(ids.select(F.col("e").alias("e0"), F.col("n").alias("a")), "e0").join(ids.select(F.col("e").alias("e1"), F.col("n").alias("b")), "e1")
        links = cut(links, "section")
        places = links.select(F.col("a").alias("node"), *(F.col(f"{c}0").alias(c) for c in "xyz")).union(links.select("b", "x1", "y1", "z1")).groupBy("node").agg(*(F.first(c).alias(c) for c in "xyz"))
        return chain(links.select("a", "b")).join(places, "node").select("chain", "position", "x", "y", "z", "loop")

    def split(self, n: Sequence[float], d: float) -> tuple[Mesh | None, Mesh | None]:
        """(above, below) the plane; None for a side without faces. Cut faces are triangulated anew."""
        where = self.side_of_plane(n, d)
        if where != "both":
            return (self, None) if where == "positive" else (None, self)
        unit = [float(x) for x in n]

        def work(batches):
            for pdf in batches:
                out = []
                for fid, tri in zip(pdf["fid"], pdf[[f"{c}{k}" for k in range(3) for c in "xyz"]].to_numpy().reshape(-1, 3, 3), strict=True):
                    s = tri @ unit - float(d)
                    for side in (1, -1):
                        poly = []
                        for i in range(3):
                            j = (i + 1) % 3
                            if s[i] * side >= 0:
                                poly.append(tri[i])
                            if s[i] * s[j] < 0:
                                # from the same end for either face of an edge, so that both get the same numbers
                                a, b = (i, j) if tuple(tri[i]) < tuple(tri[j]) else (j, i)
                                poly.append(tri[a] + (tri[b] - tri[a]) * (s[a] / (s[a] - s[b])))
                        if all(x * side <= 0 for x in s):
                            continue
                        for k in range(1, len(poly) - 1):
                            out.append((fid, side, k, *poly[0], *poly[k], *poly[k + 1]))
                yield pd.DataFrame(out, columns=["fid", "side", "k", *(f"{c}{i}" for i in range(3) for c in "xyz")])

        cols = ", ".join(f"{c}{i} double" for i in range(3) for c in "xyz")
        parts = cut(self.corners().mapInPandas(work, f"fid long, side int, k int, {cols}"), "split")
        return tuple(from_corners(parts.filter(F.col("side") == side).drop("side")) for side in (1, -1))


def _corner(k: int) -> V.Vec:
    return tuple(F.col(f"{c}{k}") for c in "xyz")


def normal_of() -> V.Vec:
    return V.unit(V.cross(V.sub(_corner(1), _corner(0)), V.sub(_corner(2), _corner(0))))


def area_of() -> Column:
    return V.triangle_area(_corner(0), _corner(1), _corner(2))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with n = 0, 1, .. in order of a unique column, without one task sorting all rows."""
    ranged = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_s"))
    sizes = sizes.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a partition
    w = Window.partitionBy("_p").orderBy(order)
    return ranged.withColumn("_r", F.row_number().over(w)).join(F.broadcast(sizes), "_p").withColumn("n", F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def from_corners(tri: DataFrame) -> Mesh:
    """A mesh of triangles given by their corners (fid, k, x0..z2): equal places become one vertex."""
    places = tri.select(F.explode(F.array(*(F.struct(*(F.col(f"{c}{i}").alias(c) for c in "xyz")) for i in range(3)))).alias("p")).distinct()
    vertices = cut(numbered(places, "p").select(F.col("n").alias("vid"), "p"), "vertices")
    faces = numbered(tri.withColumn("_o", F.struct("fid", "k")), "_o").drop("fid").withColumnRenamed("n", "fid")
    for i, n in enumerate("abc"):
        at = F.struct(*(F.col(f"{c}{i}").alias(c) for c in "xyz"))
        faces = faces.withColumn("p", at).join(vertices.withColumnRenamed("vid", n), "p").drop("p")
    return Mesh(vertices.select("vid", "p.*"), faces.select("fid", "a", "b", "c").filter("a <> b and b <> c and a <> c"))


def at_barycentric(mesh: Mesh, queries: DataFrame) -> DataFrame:
    """queries (fid, u, v, w, ...) with the place x, y, z on the face and its normal nx, ny, nz.

    Fails on a face that the mesh lacks and on one without a normal.
    """
    found = queries.join(mesh.corners(), "fid", "left")
    place = V.add(V.add(V.scale(_corner(0), F.col("u")), V.scale(_corner(1), F.col("v"))), V.scale(_corner(2), F.col("w")))
    normal = normal_of()
    reason = F.when(F.col("x0").isNull(), F.lit("the mesh has no such face")).when(normal[0].isNull(), F.lit("a face has no normal"))
    checked = F.when(reason.isNotNull(), F.raise_error(reason).cast("double")).otherwise(place[0])
    return found.select(*queries.columns, checked.alias("x"), place[1].alias("y"), place[2].alias("z"), *(c.alias(f"n{k}") for c, k in zip(normal, "xyz", strict=True)))


@dataclass(frozen=True)
class Selection:
    """Faces of a mesh, narrowed and widened step by step; nothing runs before collect() or create_mesh().

    A step takes a set of faces (fid) and adds it, removes it or keeps only it. Steps that look at corners alone become one
    filter over the corners; the others are semi-joins of the same plan.
    """

    mesh: Mesh
    chosen: DataFrame

    @staticmethod
    def everything(mesh: Mesh) -> Selection:
        return Selection(mesh, mesh.faces.select("fid"))

    @staticmethod
    def nothing(mesh: Mesh) -> Selection:
        return Selection(mesh, mesh.faces.select("fid").limit(0))

    def step(self, faces: DataFrame, op: masks.SelectOp) -> Selection:
        return Selection(self.mesh, masks.select_keys(self.chosen, faces.select("fid"), op))

    def facing(self, direction: Sequence[float], angle: float, op: masks.SelectOp = masks.SelectOp.KEEP) -> Selection:
        return self.step(self.mesh.facing(direction, angle), op)

    def above_plane(self, n: Sequence[float], d: float, op: masks.SelectOp = masks.SelectOp.KEEP, all_vertices: bool = True) -> Selection:
        return self.step(self.mesh.above_plane(n, d, all_vertices), op)

    def near_point(self, point: Sequence[float], max_dist: float, op: masks.SelectOp = masks.SelectOp.KEEP, all_vertices: bool = True) -> Selection:
        return self.step(self.mesh.near_point(point, max_dist, all_vertices), op)

    def near_mesh(self, other: Mesh, distance: float, op: masks.SelectOp = masks.SelectOp.KEEP, **options) -> Selection:
        return self.step(self.mesh.near_mesh(other, distance, **options), op)

    def expanded(self, hops: int = 1, exclude: DataFrame | None = None) -> Selection:
        return Selection(self.mesh, masks.expand(self.chosen, self.mesh.faces, hops, exclude))

    def inverted(self) -> Selection:
        return Selection(self.mesh, masks.difference(self.mesh.faces.select("fid"), self.chosen))

    def collect(self) -> DataFrame:
        return self.chosen

    def create_mesh(self) -> Mesh:
        return self.mesh.submesh(self.chosen)


# ---- generators -------------------------------------------------------------------------------------------------------
def box(spark: SparkSession, sx: float, sy: float, sz: float) -> Mesh:
    """Centred on the origin."""
    v = spark.range(8).select(F.col("id").alias("vid"), *(((F.floor(F.col("id") / 2**k) % 2) - 0.5).cast("double") .alias(n) for k, n in enumerate("xyz")))
    v = v.select("vid", *((F.col(n) * s).alias(n) for n, s in zip("xyz", (sx, sy, sz), strict=True)))
    quads = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))
    tris = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    return Mesh(v, spark.createDataFrame([(i, *t) for i, t in enumerate(tris)], "fid long, a long, b long, c long"))


def _strip_faces(spark: SparkSession, rows: int, cols: int, wrap: bool) -> DataFrame:
    """Two triangles for each cell of a grid of vertices numbered row by row; wrap joins the last column to the first."""
    cells = cols if wrap else cols - 1
    grid = spark.range((rows - 1) * cells).select(F.floor(F.col("id") / cells).alias("r"), (F.col("id") % cells).alias("c"), "id")
    at = lambda r, c: (F.col("r") + r) * cols + (F.col("c") + c) % cols
    return grid.select(F.explode(F.array(F.struct((F.col("id") * 2).alias("fid"), at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 1).alias("c")), F.struct((F.col("id") * 2 + 1).alias("fid"), at(0, 0).alias("a"), at(1, 1).alias("b"), at(1, 0).alias("c")))).alias("t")).select("t.*")


def grid(spark: SparkSession, rows: int, cols: int, spacing: float = 1.0) -> Mesh:
    v = spark.range(rows * cols).select(F.col("id").alias("vid"), ((F.col("id") % cols) * spacing).cast("double").alias("x"), (F.floor(F.col("id") / cols) * spacing).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return Mesh(v, _strip_faces(spark, rows, cols, False))


def _revolved(spark: SparkSession, profile: Sequence[tuple[float, float]], steps: int) -> Mesh:
    """A profile of (radius, z) from bottom to top, turned about the z axis; radius 0 closes an end."""
    radii, heights = (F.array(*(F.lit(float(p[k])) for p in profile)) for k in (0, 1))
    turn = F.col("c") * (2 * math.pi / steps)
    v = spark.range(len(profile) * steps).select(F.col("id").alias("vid"), F.floor(F.col("id") / steps).cast("int").alias("r"), (F.col("id") % steps).alias("c"))
    r, z = F.element_at(radii, F.col("r") + 1), F.element_at(heights, F.col("r") + 1)
    pole = (r == 0).cast("int")
    v = v.select("vid", (r * F.cos(turn) * (1 - pole)).alias("x"), (r * F.sin(turn) * (1 - pole)).alias("y"), z.alias("z"))
    return Mesh(v, _strip_faces(spark, len(profile), steps, True)).merged_duplicates()


def sphere(spark: SparkSession, radius: float, n_theta: int, n_phi: int) -> Mesh:
    angles = [math.pi * k / n_phi for k in range(n_phi + 1)]
    profile = [(0.0 if k in (0, n_phi) else radius * math.sin(a), -radius * math.cos(a)) for k, a in enumerate(angles)]
    return _revolved(spark, profile, n_theta)


def cylinder(spark: SparkSession, radius: float, height: float, steps: int) -> Mesh:
    return _revolved(spark, [(0.0, -height / 2), (radius, -height / 2), (radius, height / 2), (0.0, height / 2)], steps)


def cone(spark: SparkSession, radius: float, height: float, steps: int) -> Mesh:
    return _revolved(spark, [(0.0, -height / 2), (radius, -height / 2), (0.0, height / 2)], steps)


def capsule(spark: SparkSession, radius: float, height: float, steps: int, rings: int = 16) -> Mesh:
    half = [(radius * math.sin(math.pi / 2 * k / rings), radius * math.cos(math.pi / 2 * k / rings)) for k in range(rings + 1)]
    bottom = [(0.0 if k == 0 else r, -height / 2 - c) for k, (r, c) in enumerate(half)]
    return _revolved(spark, [*bottom, *((r, -z) for r, z in reversed(bottom))], steps)


def disc(spark: SparkSession, radius: float, steps: int) -> Mesh:
    return _revolved(spark, [(radius, 0.0), (0.0, 0.0)], steps)


def _frame(p0: Sequence[float], p1: Sequence[float], up: Sequence[float] | None = None) -> np.ndarray:
    """3x4 transform that takes the z axis to the line from p0 to p1 and the origin to its middle."""
    a, b = np.asarray(p0, float), np.asarray(p1, float)
    z = (b - a) / np.linalg.norm(b - a)
    hint = np.asarray(up, float) if up is not None else np.eye(3)[int(np.abs(z).argmin())]
    x = np.cross(hint, z)
    x /= np.linalg.norm(x)
    return np.column_stack([x, np.cross(z, x), z, (a + b) / 2])


def cylinder_between(spark: SparkSession, p0: Sequence[float], p1: Sequence[float], radius: float, steps: int) -> Mesh:
    return cylinder(spark, radius, float(np.linalg.norm(np.subtract(p1, p0))), steps).transformed(_frame(p0, p1))


def beam_between(spark: SparkSession, p0: Sequence[float], p1: Sequence[float], width: float, height: float, up: Sequence[float] = (0, 0, 1)) -> Mesh:
    return box(spark, width, height, float(np.linalg.norm(np.subtract(p1, p0)))).transformed(_frame(p0, p1, up))


# ---- closest places -----------------------------------------------------------------------------------------------------
def closest_on_triangles(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Weights (..., 3) of the closest places, for points and triangles of matching leading shape."""
    ab, ac, ap = b - a, c - a, p - a
    d1, d2 = (ab * ap).sum(-1), (ac * ap).sum(-1)
    bp, cp = p - b, p - c
    d3, d4, d5, d6 = (ab * bp).sum(-1), (ac * bp).sum(-1), (ab * cp).sum(-1), (ac * cp).sum(-1)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = va + vb + vc
        v, w = vb / total, vc / total
        out = np.stack([1 - v - w, v, w], -1)

        def put(where, weights):
            out[where] = np.stack(np.broadcast_arrays(*weights), -1)[where]

        t = (d4 - d3) / ((d4 - d3) + (d5 - d6))
        put((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), (0 * t, 1 - t, t))
        t = d2 / (d2 - d6)
        put((vb <= 0) & (d2 >= 0) & (d6 <= 0), (1 - t, 0 * t, t))
        t = d1 / (d1 - d3)
        put((vc <= 0) & (d1 >= 0) & (d3 <= 0), (1 - t, t, 0 * t))
        one, zero = np.ones_like(d1), np.zeros_like(d1)
        put((d6 >= 0) & (d5 <= d6), (zero, zero, one))
        put((d3 >= 0) & (d4 <= d3), (zero, one, zero))
        put((d1 <= 0) & (d2 <= 0), (one, zero, zero))
    return np.nan_to_num(out)


def rough_distances(p: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Squared distances (points x triangles) by products of matrices, about 1e-13 of the extent off; not a number where a triangle is flat."""
    centre = tri.mean(axis=(0, 1))
    p, a, b, c = p - centre, tri[:, 0] - centre, tri[:, 1] - centre, tri[:, 2] - centre
    ab, ac = b - a, c - a
    abab, abac, acac = (ab * ab).sum(1), (ab * ac).sum(1), (ac * ac).sum(1)
    d1, d2 = p @ ab.T - (a * ab).sum(1), p @ ac.T - (a * ac).sum(1)
    d3, d4, d5, d6 = d1 - abab, d2 - abac, d1 - abac, d2 - acac
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = abab * acac - abac * abac
        v, w = vb / total, vc / total
        on = (va <= 0) & (d4 >= d3) & (d5 >= d6)
        t = ((d4 - d3) / ((d4 - d3) + (d5 - d6)))[on]
        v[on], w[on] = 1 - t, t
        on = (vb <= 0) & (d2 >= 0) & (d6 <= 0)
        v[on], w[on] = 0, (d2[on] / (d2[on] - d6[on]))
        on = (vc <= 0) & (d1 >= 0) & (d3 <= 0)
        v[on], w[on] = (d1[on] / (d1[on] - d3[on])), 0
    for on, x, y in (((d6 >= 0) & (d5 <= d6), 0, 1), ((d3 >= 0) & (d4 <= d3), 1, 0), ((d1 <= 0) & (d2 <= 0), 0, 0)):
        v[on], w[on] = x, y
    whole = (p * p).sum(1)[:, None] - 2 * (p @ a.T) + (a * a).sum(1)
    return whole + v * (v * abab + 2 * w * abac - 2 * d1) + w * (w * acac - 2 * d2)


class MeshIndex:
    """Triangles in blocks of neighbours with bounding boxes; a query looks at blocks in order of how near they can be."""

    def __init__(self, fid: np.ndarray, tri: np.ndarray, block: int | None = None):
        block = block or int(np.clip(np.sqrt(len(tri)) / 4, 16, 512))
        centre = tri.mean(axis=1)
        low, size = centre.min(axis=0), np.maximum(np.ptp(centre, axis=0), 1e-300)
        q = ((centre - low) / size * 1023).astype(np.uint64)
        key = np.zeros(len(tri), np.uint64)
        for bit in range(10):
            for axis in range(3):
                key |= (q[:, axis] >> np.uint64(bit) & np.uint64(1)) << np.uint64(3 * bit + axis)
        order = np.argsort(key, kind="stable")
        self.fid, self.tri, self.block = fid[order], tri[order], block
        starts = np.arange(0, len(tri), block)
        self.low = np.minimum.reduceat(self.tri.min(axis=1), starts, axis=0)
        self.high = np.maximum.reduceat(self.tri.max(axis=1), starts, axis=0)
        self.first = self.tri[starts, 0]
        n = np.cross(self.tri[:, 1] - self.tri[:, 0], self.tri[:, 2] - self.tri[:, 0])
        self.normal = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)

    def closest(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the face in this index, weights, squared distance) for each point; the smallest fid of equals."""
        face, weight, best = np.zeros(len(p), np.int64), np.zeros((len(p), 3)), np.zeros(len(p))
        chunk = int(np.clip(4_000_000 // len(self.low), 64, 8192))
        for s in range(0, len(p), chunk):
            q = p[s : s + chunk]
            gap = np.maximum(np.maximum(self.low[None] - q[:, None], q[:, None] - self.high[None]), 0)
            bound = (gap**2).sum(-1)
            # no farther than a corner of each block; a little more, so that this corner's face is found
            near = ((q[:, None] - self.first[None]) ** 2).sum(-1).min(axis=1) * (1 + 1e-9) + 1e-300
            f, w, fid = np.zeros(len(q), np.int64), np.zeros((len(q), 3)), np.full(len(q), np.iinfo(np.int64).max)
            for b in np.argsort(bound.min(axis=0), kind="stable"):
                r = np.flatnonzero(bound[:, b] <= near)
                if not len(r):
                    continue
                start = b * self.block
                t = self.tri[start : start + self.block]
                rough = rough_distances(q[r], t)
                # what may be the closest is measured exactly, so that equal distances are equal
                extent = float(((q[r] - t[0, 0]) ** 2).sum(1).max() + ((t - t[0, 0]) ** 2).sum(-1).max())
                i, j = np.nonzero(~(rough > np.minimum(np.nanmin(rough, axis=1, initial=np.inf), near[r])[:, None] + 1e-11 * extent))
                if not len(i):
                    continue
                k = closest_on_triangles(q[r[i]], t[j, 0], t[j, 1], t[j, 2])
                d = ((np.einsum("nk,nkc->nc", k, t[j]) - q[r[i]]) ** 2).sum(-1)
                own = self.fid[start + j]
                order = np.lexsort((own, d, i))
                first = order[np.concatenate(([True], np.diff(i[order]) > 0))]
                g, low, own = r[i[first]], d[first], own[first]
                better = (low < near[g]) | ((low == near[g]) & (own < fid[g]))
                g, first = g[better], first[better]
                f[g], w[g], fid[g], near[g] = j[first] + start, k[first], own[better], low[better]
            face[s : s + chunk], weight[s : s + chunk], best[s : s + chunk] = f, w, near
        return face, weight, best

    def first_hits(self, origin: np.ndarray, way: np.ndarray, max_angle: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(t, place of the face) of the first triangle each ray meets; t is infinite for a miss."""
        t_best, face = np.full(len(origin), np.inf), np.zeros(len(origin), np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            for s in range(0, len(origin), 256):
                o, d = origin[s : s + 256, None], way[s : s + 256, None]
                t0, t1 = (self.low[None] - o) / d, (self.high[None] - o) / d
                near, far = np.fmax.reduce(np.fmin(t0, t1), axis=-1), np.fmin.reduce(np.fmax(t0, t1), axis=-1)
                rays, blocks = np.nonzero((near <= far) & (far >= 0))
                for k in range(0, len(rays), 4096):
                    r, b = rays[k : k + 4096], blocks[k : k + 4096]
                    at = np.minimum(b[:, None] * self.block + np.arange(self.block), len(self.tri) - 1)
                    tri, w = self.tri[at], way[s + r][:, None]
                    e1, e2 = tri[:, :, 1] - tri[:, :, 0], tri[:, :, 2] - tri[:, :, 0]
                    h = np.cross(np.broadcast_to(w, e2.shape), e2)
                    det = (e1 * h).sum(-1)
                    from_a = origin[s + r][:, None] - tri[:, :, 0]
                    u = (from_a * h).sum(-1) / det
                    g = np.cross(from_a, e1)
                    v, t = (w * g).sum(-1) / det, (e2 * g).sum(-1) / det
                    hit = (np.abs(det) > 1e-14) & (u >= -1e-12) & (v >= -1e-12) & (u + v <= 1 + 1e-12) & (t >= 0)
                    if max_angle is not None:
                        hit &= np.abs((self.normal[at] * w).sum(-1)) >= np.cos(max_angle) * np.linalg.norm(w, axis=-1)
                    t = np.where(hit, t, np.inf)
                    j = t.argmin(axis=1)
                    tj = t[np.arange(len(r)), j]
                    order = np.argsort(-tj, kind="stable")  # the nearest is written last
                    good = order[tj[order] < t_best[s + r[order]]]
                    t_best[s + r[good]], face[s + r[good]] = tj[good], at[good, j[good]]
        return t_best, face


def mesh_parts(mesh: Mesh, part_faces: int = PART_FACES):
    """Broadcast indexes of the mesh, of bounded size each."""
    corners = mesh.corners()
    n = mesh.faces.count()
    parts = max(1, -(-n // part_faces))
    if parts > 1:
        corners = cut(corners, "corners")
    for k in range(parts):
        part = corners.filter(F.pmod(F.xxhash64("fid"), F.lit(parts)) == k) if parts > 1 else corners
        pdf = part.select("fid", *(f"{c}{i}" for i in range(3) for c in "xyz")).toPandas()
        if len(pdf):
            index = MeshIndex(pdf["fid"].to_numpy(np.int64), pdf.iloc[:, 1:].to_numpy(float).reshape(-1, 3, 3))
            yield mesh.faces.sparkSession.sparkContext.broadcast(index)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows over all shuffle partitions: measuring a point costs far more than moving it, and a file may be one partition."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


CLOSEST = "fid long, w0 double, w1 double, w2 double, px double, py double, pz double, nx double, ny double, nz double, d double"


def closest(points: DataFrame, mesh: Mesh, key: str, part_faces: int = PART_FACES) -> DataFrame:
    """key, x, y, z and the closest place on the mesh: fid, weights, point, face normal, distance. Points without finite coordinates are left out."""
    kind = dict(points.dtypes)[key]
    rows = points.select(key, *(F.col(n).cast("double").alias(n) for n in "xyz")).filter(F.abs(F.col("x") + F.col("y") + F.col("z")) < float("inf"))
    rows, out = dealt(rows, key, "x", "y", "z"), None
    parts = list(mesh_parts(mesh, part_faces))
    if len(parts) > 1:
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "points")  # dealt once, read by each part; numbered, as rows may repeat
    for shared in parts:

        def run(batches, shared=shared):
            index = shared.value
            for pdf in batches:
                p = pdf[["x", "y", "z"]].to_numpy(float)
                face, w, d2 = index.closest(p)
                place = (w[..., None] * index.tri[face]).sum(1)
                cols = np.column_stack([w, place, index.normal[face], np.sqrt(d2)])
                res = pd.DataFrame(cols, columns=["w0", "w1", "w2", "px", "py", "pz", "nx", "ny", "nz", "d"])
                res.insert(0, "fid", index.fid[face])
                yield pd.concat([pdf.reset_index(drop=True), res], axis=1)

        one = rows.mapInPandas(run, f"{key} {kind}, x double, y double, z double, {'_row long, ' if len(parts) > 1 else ''}{CLOSEST}")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("closest: the mesh has no faces")
    if len(parts) > 1:
        out = out.groupBy("_row").agg(F.min_by(F.struct(key, "x", "y", "z", *(c.split()[0] for c in CLOSEST.split(", "))), F.struct("d", "fid")).alias("r")).select("r.*")
    return out


def deviations(points: DataFrame, mesh: Mesh, key: str, mode: str = "point") -> DataFrame:
    """closest with deviation: the distance with the sign of the face's side (mode point), or from the face's plane (mode plane)."""
    found = closest(points, mesh, key)
    plane = sum(((F.col(n) - F.col(f"p{n}")) * F.col(f"n{n}") for n in "xyz"), F.lit(0.0))
    dev = plane if mode == "plane" else F.when(plane < 0, -F.col("d")).otherwise(F.col("d"))
    return found.withColumn("deviation", dev)


def within_tolerance(points: DataFrame, mesh: Mesh, key: str, max_dist: float, max_angle: float | None = None) -> DataFrame:
    """key of the points within max_dist of the mesh; max_angle: the way to it at most that far off the face's normal, from either side."""
    found = deviations(points, mesh, key, "plane")
    ok = F.col("d") <= max_dist
    if max_angle is not None:
        ok = ok & ((F.col("d") < 1e-9) | (F.acos(F.least(F.abs(F.col("deviation")) / F.nullif(F.col("d"), F.lit(0.0)), F.lit(1.0))) <= max_angle))
    return found.filter(ok).select(key)


def ray_hits(rays: DataFrame, mesh: Mesh, key: str, max_angle: float | None = None, part_faces: int = PART_FACES) -> DataFrame:
    """key, t, fid, x, y, z of the first hit of each ray (ox, oy, oz, dx, dy, dz), also of rays with the same key; misses are left out."""
    kind = dict(rays.dtypes)[key]
    names = ["ox", "oy", "oz", "dx", "dy", "dz"]
    rows = dealt(rays.select(key, *(F.col(n).cast("double").alias(n) for n in names)), key, *names).withColumn("_row", F.lit(0).cast("long"))
    out, parts = None, list(mesh_parts(mesh, part_faces))
    if len(parts) > 1:
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rays")  # numbered, as keys may repeat
    for shared in parts:

        def run(batches, shared=shared):
            index = shared.value
            for pdf in batches:
                o, d = pdf[names[:3]].to_numpy(float), pdf[names[3:]].to_numpy(float)
                t, face = index.first_hits(o, d, max_angle)
                ok = np.isfinite(t)
                place = o[ok] + d[ok] * t[ok, None]
                yield pd.DataFrame({"_row": pdf["_row"].to_numpy()[ok], key: pdf[key].to_numpy()[ok], "t": t[ok], "fid": index.fid[face[ok]], "x": place[:, 0], "y": place[:, 1], "z": place[:, 2]})

        one = rows.mapInPandas(run, f"_row long, {key} {kind}, t double, fid long, x double, y double, z double")
        out = one if out is None else out.unionByName(one)
    if len(parts) == 1:
        return out.drop("_row")
    return out.groupBy("_row").agg(F.min_by(F.struct(key, "t", "fid", "x", "y", "z"), F.struct("t", "fid")).alias("r")).select("r.*")


def scan(mesh: Mesh, emitter_z: float, detector_y: float, detector_z: float, width: float, z_min: float, z_max: float, resolution: int, y_steps: Sequence[float], max_angle: float | None = None, obstruction: Mesh | None = None) -> DataFrame:
    """A simulated line scanner: i, step, x, y, z of the first hit of each ray in the measuring range that the detector sees."""
    spark = mesh.faces.sparkSession
    ys = F.array(*(F.lit(float(y)) for y in y_steps))
    rays = spark.range(resolution * len(y_steps)).select(F.col("id").alias("key"), (F.col("id") % resolution).alias("i"), F.floor(F.col("id") / resolution).cast("int").alias("step"))
    y = F.element_at(ys, F.col("step") + 1)
    x = (F.col("i") / float(max(1, resolution - 1)) - 0.5) * width
    rays = rays.select("*", F.lit(0.0).alias("ox"), y.alias("oy"), F.lit(float(emitter_z)).alias("oz"), x.alias("dx"), F.lit(0.0).alias("dy"), F.lit(float(z_min - emitter_z)).alias("dz"))
    hits = ray_hits(rays, mesh, "key", max_angle).filter(F.col("z").between(z_min, z_max)).join(rays.select("key", "i", "step", F.col("oy").alias("y0")), "key")
    if obstruction is not None:
        blocked = ray_hits(rays, obstruction, "key").select("key", F.col("t").alias("tb"))
        hits = hits.join(blocked, "key", "left").filter("tb is null or tb > t").drop("tb")
    to = (F.lit(0.0) - F.col("x"), F.col("y0") + detector_y - F.col("y"), F.lit(float(detector_z)) - F.col("z"))
    eps = 1e-6
    sight = hits.select("key", *((F.col(c) + d * eps).alias(f"o{c}") for c, d in zip("xyz", to, strict=True)), *(d.alias(f"d{c}") for c, d in zip("xyz", to, strict=True)))
    hidden = ray_hits(sight, mesh, "key").filter("t < 1").select("key")
    if obstruction is not None:
        hidden = hidden.union(ray_hits(sight, obstruction, "key").filter("t < 1").select("key"))
    return hits.join(hidden, "key", "left_anti").select("i", "step", "x", "y", "z")


# ---- collisions ----------------------------------------------------------------------------------------------------------
def triangles_meet(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether triangles (n, 3, 3) meet pair by pair, by separating axes."""
    es, et = np.roll(s, -1, axis=1) - s, np.roll(t, -1, axis=1) - t
    ns, nt = np.cross(es[:, 0], es[:, 1]), np.cross(et[:, 0], et[:, 1])
    axes = [ns, nt, *(np.cross(es[:, i], et[:, j]) for i in range(3) for j in range(3)), *(np.cross(ns, es[:, i]) for i in range(3)), *(np.cross(nt, et[:, i]) for i in range(3))]
    apart = np.zeros(len(s), bool)
    for a in axes:
        ps, pt = (s * a[:, None]).sum(-1), (t * a[:, None]).sum(-1)
        apart |= (np.abs(a).max(axis=1) > 1e-14) & ((ps.max(axis=1) < pt.min(axis=1)) | (pt.max(axis=1) < ps.min(axis=1)))
    return ~apart


def collisions(meshes: DataFrame, roles: DataFrame, exceptions: DataFrame | Column | None = None, size: float = 1.0) -> DataFrame:
    """id1, id2 of meshes that meet. meshes: mesh_id, x0..z2 for each face; roles: mesh_id, moving; exceptions: rows id1, id2
    or a test of the columns id1 and id2 that goes both ways.

    Pairs of moving and other meshes whose boxes meet, found by cells that both touch, are compared face by face where faces
    share a grid cell.
    """
    low = [F.least(*(F.col(f"{c}{k}") for k in range(3))) for c in "xyz"]
    high = [F.greatest(*(F.col(f"{c}{k}") for k in range(3))) for c in "xyz"]
    rows = meshes.select("*", *(e.alias(f"l{c}") for e, c in zip(low, "xyz", strict=True)), *(e.alias(f"h{c}") for e, c in zip(high, "xyz", strict=True)))
    boxes = rows.groupBy("mesh_id").agg(*(F.min(f"l{c}").alias(f"l{c}") for c in "xyz"), *(F.max(f"h{c}").alias(f"h{c}") for c in "xyz")).join(roles, "mesh_id")
    boxes = cut(boxes, "boxes")
    wide = F.greatest(*(F.col(f"h{c}") - F.col(f"l{c}") for c in "xyz"))
    mean, most = boxes.agg(F.avg(wide), F.max(wide)).first()
    # twice the mean extent, so that most boxes touch few cells; the largest one touches 17 an axis at most
    side = max(2 * (mean or 0.0), (most or 0.0) / 16, 1e-300)
    at = lambda e: F.floor(e / side).cast("long")
    spread = boxes
    for c in "xyz":
        spread = spread.withColumn(f"_{c}", F.explode(F.sequence(at(F.col(f"l{c}")), at(F.col(f"h{c}")))))
    a, b = (spread.select(*(F.col(f"_{c}") for c in "xyz"), *(F.col(c).alias(f"{c}_{k}") for c in boxes.columns)) for k in (1, 2))
    meets = reduce(lambda s, t: s & t, ((F.col(f"l{c}_1") <= F.col(f"h{c}_2")) & (F.col(f"l{c}_2") <= F.col(f"h{c}_1")) for c in "xyz"))
    # of the cells that both touch, the first one gives the pair
    once = reduce(lambda s, t: s & t, (F.col(f"_{c}") == at(F.greatest(f"l{c}_1", f"l{c}_2")) for c in "xyz"))
    roles_ok = (F.col("mesh_id_1") != F.col("mesh_id_2")) & (~F.col("moving_2") | (F.col("mesh_id_1") < F.col("mesh_id_2")))
    pairs = a.filter("moving_1").hint("merge").join(b, ["_x", "_y", "_z"]).filter(roles_ok & meets & once)
    # with the box that both share: only faces that reach it can meet
    common = [F.greatest(f"l{c}_1", f"l{c}_2").alias(f"lo{c}") for c in "xyz"] + [F.least(f"h{c}_1", f"h{c}_2").alias(f"hi{c}") for c in "xyz"]
    pairs = pairs.select(F.col("mesh_id_1").alias("id1"), F.col("mesh_id_2").alias("id2"), *common)
    if isinstance(exceptions, Column):
        pairs = pairs.filter(~F.coalesce(exceptions, F.lit(False)))
    elif exceptions is not None:
        both = exceptions.select("id1", "id2").union(exceptions.select("id2", "id1"))
        pairs = pairs.join(both, ["id1", "id2"], "left_anti")
    cells = [F.sequence(F.floor(F.col(f"l{c}") / size).cast("long"), F.floor(F.col(f"h{c}") / size).cast("long")) for c in "xyz"]
    dealt = rows
    for c, s in zip("xyz", cells, strict=True):
        dealt = dealt.withColumn(f"_{c}", F.explode(s))
    names = [f"{c}{k}" for k in range(3) for c in "xyz"]
    own = [*names, *(f"{e}{c}" for c in "xyz" for e in "lh")]
    one, two = (dealt.select(F.col("mesh_id").alias(f"id{k}"), "_x", "_y", "_z", *(F.col(n).alias(f"{n}_{k}") for n in own)) for k in (1, 2))
    near = lambda k: reduce(lambda s, t: s & t, ((F.col(f"l{c}_{k}") <= F.col(f"hi{c}")) & (F.col(f"lo{c}") <= F.col(f"h{c}_{k}")) for c in "xyz"))
    in_cell = reduce(lambda s, t: s & t, (F.col(f"_{c}").between(F.floor(F.col(f"lo{c}") / size), F.floor(F.col(f"hi{c}") / size)) for c in "xyz"))
    once = reduce(lambda s, t: s & t, (F.col(f"_{c}") == F.floor(F.greatest(f"l{c}_1", f"l{c}_2") / size) for c in "xyz"))
    met = pairs.join(one, "id1").filter(near(1) & in_cell).join(two, ["id2", "_x", "_y", "_z"]).filter(near(2) & meets & once)
    met = met.select("id1", "id2", *(f"{n}_{k}" for k in (1, 2) for n in names))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                s, t = (pdf[[f"{n}_{k}" for n in names]].to_numpy(float).reshape(-1, 3, 3) for k in (1, 2))
                yield pdf.loc[triangles_meet(s, t), ["id1", "id2"]].drop_duplicates()

    kind = dict(meshes.dtypes)["mesh_id"]
    return met.mapInPandas(run, f"id1 {kind}, id2 {kind}").distinct()


# ---- outlines and uv ------------------------------------------------------------------------------------------------------
def outline(mesh: Mesh, facing: Sequence[float], corner_angle: float = math.pi / 4) -> DataFrame:
    """lo, hi, kind of the edges that make a drawing: boundary, corner (sharper than an angle) or silhouette."""
    geometry = mesh.face_geometry()
    side = V.dot(V.vec("nx", "ny", "nz"), V.vec(*map(float, facing))) >= 0
    e = directed_edges(mesh.faces).join(geometry, "fid").select(F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"), "fid", "nx", "ny", "nz", side.alias("front"))
    g = e.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min_by(F.struct("nx", "ny", "nz"), "fid").alias("p"), F.max_by(F.struct("nx", "ny", "nz"), "fid").alias("q"), F.min("front").alias("f0"), F.max("front").alias("f1"))
    turn = V.angle_between([F.col(f"p.n{c}") for c in "xyz"], [F.col(f"q.n{c}") for c in "xyz"])
    kind = F.when(F.col("n") == 1, "boundary").when(F.col("f0") != F.col("f1"), "silhouette").when(turn > corner_angle, "corner")
    return g.select("lo", "hi", kind.alias("kind")).filter("kind is not null")


def uv_lookup(queries: DataFrame, uv: DataFrame, key: str) -> DataFrame:
    """key, u, v, fid, w0, w1, w2 of the triangle (fid, u0, v0, u1, v1, u2, v2) that holds each different (key, u, v), the
    smallest fid of several.

    Triangles are dealt to the grid cells of their mean size that they touch. Up to DIRECTORY entries go to every task, so
    that the places, which may all lie in a few cells, only move once, by all their columns; beyond that it is a shuffle.
    """
    ux, uy, vx, vy = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0"), F.col("u2") - F.col("u0"), F.col("v2") - F.col("v0")
    det = ux * vy - uy * vx
    # weights are products with what is made here once for each triangle; one without area holds no place
    uv = cut(uv.filter(det * det >= V.EPS).select("*", (vy / det).alias("_a1"), (-vx / det).alias("_b1"), (-uy / det).alias("_a2"), (ux / det).alias("_b2")), "uv")
    box = uv.agg(F.avg(F.greatest("u0", "u1", "u2") - F.least("u0", "u1", "u2")).alias("w")).first()["w"] or 1.0
    size = max(box, 1e-12)
    span = lambda c: F.sequence(F.floor(F.least(*(F.col(f"{c}{k}") for k in range(3))) / size).cast("long"), F.floor(F.greatest(*(F.col(f"{c}{k}") for k in range(3))) / size).cast("long"))
    own = ["fid", "u0", "v0", "_a1", "_b1", "_a2", "_b2"]
    dealt = cut(uv.withColumn("_u", F.explode(span("u"))).withColumn("_v", F.explode(span("v"))).select("_u", "_v", *own), "cells")
    shared = F.broadcast if dealt.count() <= DIRECTORY else lambda df: df
    du, dv = F.col("u") - F.col("u0"), F.col("v") - F.col("v0")
    w1, w2 = du * F.col("_a1") + dv * F.col("_b1"), du * F.col("_a2") + dv * F.col("_b2")
    q = queries.select(key, "u", "v", F.floor(F.col("u") / size).cast("long").alias("_u"), F.floor(F.col("v") / size).cast("long").alias("_v"))
    met = q.join(shared(dealt), ["_u", "_v"]).filter((w1 >= -1e-9) & (w2 >= -1e-9) & (w1 + w2 <= 1 + 1e-9)).groupBy(key, "u", "v").agg(F.min("fid").alias("fid"))
    return met.join(shared(uv.select(*own)), "fid").select(key, "u", "v", "fid", (1.0 - w1 - w2).alias("w0"), w1.alias("w1"), w2.alias("w2"))


def project_to_uv(points: DataFrame, mesh: Mesh, uv: DataFrame, key: str, max_dist: float | None = None) -> DataFrame:
    """key, u, v, height: the texture place of the closest place on the mesh (uv: vid, u, v) and the signed height over it."""
    found = deviations(points, mesh, key)
    if max_dist is not None:
        found = found.filter(F.col("d") <= max_dist)
    out = found.join(mesh.faces.select("fid", "a", "b", "c"), "fid")
    for k, n in enumerate("abc"):
        out = out.join(uv.select(F.col("vid").alias(n), F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}")), n)
    mix = lambda c: sum((F.col(f"{c}{k}") * F.col(f"w{k}") for k in range(3)), F.lit(0.0))
    return out.select(key, mix("u").alias("u"), mix("v").alias("v"), F.col("deviation").alias("height"))


def uv_to_3d(queries: DataFrame, mesh: Mesh, uv: DataFrame, key: str) -> DataFrame:
    """key, fid, x, y, z of the mesh at the different texture places (key, u, v); places outside all triangles are left out."""
    tri = mesh.faces
    for k, n in enumerate("abc"):
        tri = tri.join(uv.select(F.col("vid").alias(n), F.col("u").alias(f"u{k}"), F.col("v").alias(f"v{k}")), n)
    corners = mesh.corners()
    if mesh.faces.count() <= DIRECTORY:
        corners = F.broadcast(corners)
    met = uv_lookup(queries, tri.select("fid", *(f"{c}{k}" for k in range(3) for c in "uv")), key).join(corners, "fid")
    return met.select(key, "fid", *(sum((F.col(f"{c}{k}") * F.col(f"w{k}") for k in range(3)), F.lit(0.0)).alias(c) for c in "xyz"))


def faces_overlap(mesh: Mesh, other: Mesh, angle: float, distance: float) -> DataFrame:
    """fid of the faces that lie over another mesh: each of a face's corners and its centre is within distance of it, the
    closest faces' normals are less than angle off the face's, and the centre is approached along the face's normal."""
    c = mesh.corners().join(mesh.face_geometry().filter("area > 1e-12"), "fid")
    places = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{n}{k}").alias(n) for n in "xyz")) for k in range(3)), F.struct(F.lit(3).alias("k"), *(((F.col(f"{n}0") + F.col(f"{n}1") + F.col(f"{n}2")) / 3).alias(n) for n in "xyz")))
    probes = cut(c.select("fid", "nx", "ny", "nz", F.explode(places).alias("p")).select((F.col("fid") * 4 + F.col("p.k")).alias("id"), "fid", F.col("nx").alias("fx"), F.col("ny").alias("fy"), F.col("nz").alias("fz"), "p.x", "p.y", "p.z"), "probes")
    met = closest(probes.select("id", "x", "y", "z"), other, "id").drop("x", "y", "z", "fid").join(probes, "id")
    normal = V.angle_between(V.vec("fx", "fy", "fz"), V.vec("nx", "ny", "nz"))
    way = V.angle_between(V.vec("fx", "fy", "fz"), tuple(F.col(f"p{n}") - F.col(n) for n in "xyz"))
    along = (F.col("id") % 4 != 3) | (F.col("d") < 1e-9) | (F.least(way, math.pi - way) < angle)
    ok = (F.col("d") <= distance) & (normal < angle) & F.coalesce(along, F.lit(False))
    return met.groupBy("fid").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")).filter("ok").select("fid")
