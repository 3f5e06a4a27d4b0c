"""Rigid alignment: the driver solves a small system, the cluster sums it up.

Each step measures all points against the target under the current transform and sums J'J, J'r and r'r inside the tasks;
the driver gets one 6x6 (or 3x3) matrix for each task's rows, already summed by group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .checkpoints import cut
from .mesh import Mesh, closest, deviations, mesh_parts, numbered


# ---- transforms ---------------------------------------------------------------------------------------------------------
def rotation(rx: float, ry: float, rz: float) -> np.ndarray:
    """z(rz) y(ry) x(rx)."""
    (cx, sx), (cy, sy), (cz, sz) = ((np.cos(a), np.sin(a)) for a in (rx, ry, rz))
    return np.array([[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]])


def euler_of(r: np.ndarray) -> np.ndarray:
    return np.array([np.arctan2(r[2, 1], r[2, 2]), np.arcsin(np.clip(-r[2, 0], -1, 1)), np.arctan2(r[1, 0], r[0, 0])])


def iso3(tx: float = 0, ty: float = 0, tz: float = 0, rx: float = 0, ry: float = 0, rz: float = 0) -> np.ndarray:
    """4x4."""
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rotation(rx, ry, rz), (tx, ty, tz)
    return out


def iso3_from_xyzwpr(x: float, y: float, z: float, w: float, p: float, r: float) -> np.ndarray:
    """Angles in degrees."""
    return iso3(x, y, z, *np.radians([w, p, r]))


def xyzwpr_of(m: np.ndarray) -> np.ndarray:
    return np.concatenate([m[:3, 3], np.degrees(euler_of(m[:3, :3]))])


def iso3_from_array(values) -> np.ndarray:
    """16 numbers, row by row; fails unless it is a rigid transform."""
    m = np.asarray(values, float).reshape(4, 4)
    if not np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3), atol=1e-6) or not np.isclose(np.linalg.det(m[:3, :3]), 1, atol=1e-6) or not np.allclose(m[3], [0, 0, 0, 1]):
        raise ValueError("not a rigid transform")
    return m


def iso3_from_basis(first: str, a, second: str, b, origin=(0, 0, 0)) -> np.ndarray:
    """Axes by name: the first is kept, the second made orthogonal to it, the third completes a right-handed frame."""
    u = np.asarray(a, float) / np.linalg.norm(a)
    v = np.asarray(b, float) - np.dot(b, u) * u
    if np.linalg.norm(v) < 1e-12:
        raise ValueError("the basis vectors are parallel")
    v /= np.linalg.norm(v)
    axes = {first: u, second: v}
    third = ({"x", "y", "z"} - {first, second}).pop()
    order = "xyz"
    i = order.index(third)
    axes[third] = np.cross(axes[order[(i + 1) % 3]], axes[order[(i + 2) % 3]])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = np.column_stack([axes[k] for k in order]), origin
    return out


def rotation_about(axis, angle: float, centre=(0, 0, 0)) -> np.ndarray:
    k = np.asarray(axis, float) / np.linalg.norm(axis)
    x = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    out = np.eye(4)
    out[:3, :3] = np.eye(3) + np.sin(angle) * x + (1 - np.cos(angle)) * x @ x
    out[:3, 3] = np.asarray(centre, float) - out[:3, :3] @ np.asarray(centre, float)
    return out


def iso2(tx: float = 0, ty: float = 0, angle: float = 0) -> np.ndarray:
    """3x3."""
    c, s = np.cos(angle), np.sin(angle)
    return np.array([[c, -s, tx], [s, c, ty], [0, 0, 1.0]])


def param_of_iso2(m: np.ndarray) -> tuple[float, float, float]:
    return float(m[0, 2]), float(m[1, 2]), float(np.arctan2(m[1, 0], m[0, 0]))


@dataclass
class Alignment:
    transform: np.ndarray
    mean_residual: float
    residual: float
    rounds: int
    history: list[float] = field(default_factory=list)


def _solve(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, float, float, float]], start: np.ndarray, step_of: Callable[[np.ndarray], np.ndarray], rounds: int, tol: float) -> Alignment:
    """Levenberg-Marquardt. sums(transform) -> J'J, J'r, r'r, sum of |r|, weight."""
    current, damping = np.asarray(start, float), 1e-6
    a, g, cost, total, n = sums(current)
    history = [cost]
    for k in range(rounds):
        if n == 0:
            raise ValueError("no point takes part in the alignment")
        d = np.linalg.lstsq(a + damping * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
        moved = step_of(d) @ current
        a2, g2, cost2, total2, n2 = sums(moved)
        if cost2 <= cost:
            done = cost - cost2 <= tol * max(cost, 1e-300) and np.abs(d).max() < 1e-9 or cost2 < 1e-24
            current, a, g, cost, total, n = moved, a2, g2, cost2, total2, n2
            damping = max(damping / 10, 1e-12)
            history.append(cost)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e6 or np.abs(d).max() < 1e-12:
                break
    return Alignment(current, total / n if n else float("nan"), cost, len(history) - 1, history)


def _gather(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """rows: one array of sums for each batch -> their total."""
    total = rows.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    v = np.zeros(k * k + k + 3)
    for r in total:
        v[r["pos"]] = r["v"]
    return v[: k * k].reshape(k, k), v[k * k : k * k + k], float(v[-3]), float(v[-2]), float(v[-1])


def _sums(j: np.ndarray, r: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    jw = j * w[:, None]
    return pd.DataFrame({"s": [np.concatenate([(jw.T @ j).ravel(), jw.T @ r, [(w * r * r).sum(), (w * np.abs(r)).sum(), w.sum()]])]})


def point_jacobian(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows by which n . p changes for small translations and rotations about the origin."""
    return np.concatenate([n, np.cross(p, n)], axis=1)


def small_motion(d: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(d[3:]))
    out = rotation_about(d[3:], angle) if angle > 1e-15 else np.eye(4)
    out[:3, 3] = d[:3]
    return out


def _about(centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    to, back = np.eye(4), np.eye(4)
    to[:3, 3], back[:3, 3] = -centre, centre
    return to, back


def points_to_mesh(points: DataFrame, mesh: Mesh, initial: np.ndarray | None = None, mode: str = "plane", weight: str | None = None, rounds: int = 50, tol: float = 1e-12) -> Alignment:
    """The rigid transform that brings points (x, y, z) onto a mesh, by distance to faces' planes or to closest points.

    Motions turn about the points' centre. weight: a column of factors. The mesh is shipped in parts of bounded size; a
    mesh of several parts is measured through a join instead, one row a point.
    """
    rows = points.select(*(F.col(n).cast("double").alias(n) for n in "xyz"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    centre = np.array(rows.agg(*(F.avg(n) for n in "xyz")).first(), float)
    start = np.eye(4) if initial is None else np.asarray(initial, float)
    to, back = _about(start[:3, :3] @ centre + start[:3, 3])
    parts = list(mesh_parts(mesh))

    def sums(m: np.ndarray):
        def run(batches):
            index = parts[0].value
            for pdf in batches:
                if not len(pdf):
                    continue
                p = pdf[["x", "y", "z"]].to_numpy(float) @ m[:3, :3].T + m[:3, 3]
                face, w, _ = index.closest(p)
                place = (w[..., None] * index.tri[face]).sum(1)
                local, own = p - back[:3, 3], pdf["w"].to_numpy()
                if mode == "plane":
                    n = index.normal[face]
                    yield _sums(point_jacobian(local, n), ((p - place) * n).sum(1), own)
                else:
                    gap = p - place
                    for axis in np.eye(3):
                        yield _sums(point_jacobian(local, np.broadcast_to(axis, p.shape)), gap @ axis, own)

        def from_join(batches):
            for pdf in batches:
                if len(pdf):
                    p, n = pdf[["x", "y", "z"]].to_numpy(float), pdf[["nx", "ny", "nz"]].to_numpy(float)
                    yield _sums(point_jacobian(p - back[:3, 3], n), pdf["deviation"].to_numpy(), pdf["w"].to_numpy())

        if len(parts) == 1:
            return _gather(rows.mapInPandas(run, "s array<double>"), 6)
        from ..functions.vectors import transform, vec

        moved = rows.withColumn("id", F.monotonically_increasing_id()).select("id", "w", *(e.alias(n) for e, n in zip(transform(vec("x", "y", "z"), m), "xyz", strict=True)))
        found = deviations(moved, mesh, "id", "plane").join(moved.select("id", "w"), "id")
        return _gather(found.mapInPandas(from_join, "s array<double>"), 6)

    return _solve(sums, start, lambda d: back @ small_motion(d) @ to, rounds, tol)


def points_to_cloud(points: DataFrame, cloud: DataFrame, radius: float, initial: np.ndarray | None = None, rounds: int = 50, tol: float = 1e-12) -> Alignment:
    """The rigid transform that brings points onto a cloud (x, y, z[, nx, ny, nz]); points farther than radius from it weigh nothing.

    Distances are to the tangent plane where the cloud has normals. Nearest points come from a join on grid cells.
    """
    from ..functions.vectors import transform, vec
    from .joins import nearest_join

    has_normals = "nx" in cloud.columns
    rows = points.select(*(F.col(n).cast("double").alias(n) for n in "xyz")).withColumn("id", F.monotonically_increasing_id())
    from .checkpoints import cut

    rows = cut(rows, "points")
    target = cut(cloud.withColumn("cid", F.monotonically_increasing_id()), "cloud")
    centre = np.array(rows.agg(*(F.avg(n) for n in "xyz")).first(), float)
    start = np.eye(4) if initial is None else np.asarray(initial, float)
    to, back = _about(start[:3, :3] @ centre + start[:3, 3])

    def sums(m: np.ndarray):
        moved = rows.select("id", *(e.alias(n) for e, n in zip(transform(vec("x", "y", "z"), m), "xyz", strict=True)))
        met = nearest_join(moved, target, "id", "cid", ("x", "y", "z"), radius).filter(F.col("d") <= radius)
        names = ["x", "y", "z", *(["nx", "ny", "nz"] if has_normals else [])]
        both = met.join(moved, "id").join(target.select("cid", *(F.col(n).alias(f"t{n}") for n in names)), "cid")

        def run(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                p, q = pdf[["x", "y", "z"]].to_numpy(float), pdf[["tx", "ty", "tz"]].to_numpy(float)
                one = np.ones(len(p))
                if has_normals:
                    n = pdf[["tnx", "tny", "tnz"]].to_numpy(float)
                    yield _sums(point_jacobian(p - back[:3, 3], n), ((p - q) * n).sum(1), one)
                else:
                    for axis in np.eye(3):
                        yield _sums(point_jacobian(p - back[:3, 3], np.broadcast_to(axis, p.shape)), (p - q) @ axis, one)

        return _gather(both.mapInPandas(run, "s array<double>"), 6)

    return _solve(sums, start, lambda d: back @ small_motion(d) @ to, rounds, tol)


def points_to_curve(points: DataFrame, segments: DataFrame, initial: np.ndarray | None = None, rounds: int = 50, tol: float = 1e-12) -> Alignment:
    """2D: brings points (x, y) onto a polyline (seg, x0, y0, x1, y1) of any length."""
    from .joins import closest_on_curve

    edges = segments.select("seg", "x0", "y0", "x1", "y1", F.lit(0.0).alias("l0"))
    rows = cut(points.select(F.monotonically_increasing_id().alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    centre = np.array(rows.agg(F.avg("x"), F.avg("y")).first(), float)
    start = np.eye(3) if initial is None else np.asarray(initial, float)
    pivot = start[:2, :2] @ centre + start[:2, 2]

    def run(batches):
        for pdf in batches:
            q, n = pdf[["px", "py"]].to_numpy(float), pdf[["nx", "ny"]].to_numpy(float)
            r = pdf["r"].to_numpy(float)
            local = q - pivot
            yield _sums(np.column_stack([n, local[:, 0] * n[:, 1] - local[:, 1] * n[:, 0]]), r, np.ones(len(q)))

    def sums(m: np.ndarray):
        moved = rows.select("id", *(e.alias(c) for e, c in zip(V.transform((F.col("x"), F.col("y")), m[:2]), "xy", strict=True)))
        met = closest_on_curve(moved, "id", edges)
        along = (F.col("x") - F.col("px")) * F.col("nx") + (F.col("y") - F.col("py")) * F.col("ny")
        found = met.join(moved, "id").select(along.alias("r"), "nx", "ny", F.col("x").alias("px"), F.col("y").alias("py"))
        return _gather(found.mapInPandas(run, "s array<double>"), 3)

    def step(d: np.ndarray) -> np.ndarray:
        to, back = iso2(-pivot[0], -pivot[1]), iso2(pivot[0], pivot[1])
        return back @ iso2(d[0], d[1], d[2]) @ to

    return _solve(sums, start, step, rounds, tol)


def mesh_to_mesh(moving: Mesh, reference: Mesh, spacing: float, initial: np.ndarray | None = None, rounds: int = 10, max_dist: float | None = None, max_angle: float = 0.5) -> Alignment:
    """Samples of the moving mesh's faces that lie over the reference, aligned again and again until the mean residual gains less than 1 %."""
    from ..functions.vectors import transform, vec
    from .sampling import dense_samples

    samples = dense_samples(moving.corners(), spacing)
    m, best = np.eye(4) if initial is None else np.asarray(initial, float), None
    for _ in range(rounds):
        moved = samples.select(F.monotonically_increasing_id().alias("id"), *(e.alias(n) for e, n in zip(transform(vec("x", "y", "z"), m), "xyz", strict=True)), *(F.col(n).alias(f"o{n}") for n in "xyz"))
        used = moved
        if max_dist is not None:
            from .mesh import within_tolerance

            used = moved.join(within_tolerance(moved, reference, "id", max_dist, max_angle), "id", "left_semi")
        found = points_to_mesh(used.select(*(F.col(f"o{n}").alias(n) for n in "xyz")), reference, m)
        if best is not None and found.mean_residual > 0.99 * best.mean_residual:
            return min(found, best, key=lambda x: x.mean_residual)
        best, m = found, found.transform
    raise RuntimeError(f"mesh_to_mesh: not settled after {rounds} rounds")


def multi_mesh(samples: DataFrame, meshes: dict[int, Mesh], static: int | None = None, rounds: int = 20, tol: float = 1e-10) -> dict[int, np.ndarray]:
    """Transforms that bring overlapping meshes together at once. samples: mesh_id, to_id, x, y, z (a place on mesh_id that lies over to_id).

    The mesh with the most samples stays (or static). Each round sums the blocks of one large system by pairs of meshes.
    """
    counts = {r[0]: r[1] for r in samples.select(F.explode(F.array("mesh_id", "to_id")).alias("m")).groupBy("m").count().collect()}
    fixed = static if static is not None else min(counts, key=lambda k: (-counts[k], k))
    free = [k for k in sorted(meshes) if k != fixed]
    place = {k: i for i, k in enumerate(free)}
    poses = {k: np.eye(4) for k in meshes}
    rows = cut(samples.select(F.monotonically_increasing_id().alias("id"), "mesh_id", "to_id", *(F.col(c).cast("double").alias(f"s{c}") for c in "xyz")), "samples")
    spark, before = samples.sparkSession, None

    def run(batches):
        for pdf in batches:
            out = []
            for i, own in pdf.groupby("mesh_id"):
                jac = point_jacobian(own[["wx", "wy", "wz"]].to_numpy(float), own[["nx", "ny", "nz"]].to_numpy(float))
                r = own["r"].to_numpy(float)
                out.append((int(i), [*(jac.T @ jac).ravel(), *(jac.T @ r), float(r @ r)]))
            yield pd.DataFrame(out, columns=["i", "s"])

    for _ in range(rounds):
        sums = []
        for j in sorted(meshes):
            back = np.linalg.inv(poses[j])
            moves = spark.createDataFrame([(int(i), *map(float, m[:3].ravel()), *map(float, (back @ m)[:3].ravel())) for i, m in poses.items()], ", ".join(["mesh_id long", *(f"{t}{k} double" for t in "wl" for k in range(12))]))
            at = [F.col(f"s{c}") for c in "xyz"]
            to = lambda t, row: sum((F.col(f"{t}{4 * row + k}") * at[k] for k in range(3)), F.col(f"{t}{4 * row + 3}"))
            # a row for each mesh: a few
            own = rows.filter(F.col("to_id") == j).join(F.broadcast(moves), "mesh_id").select("id", "mesh_id", *(to("l", k).alias(c) for k, c in enumerate("xyz")), *(to("w", k).alias(f"w{c}") for k, c in enumerate("xyz")))
            met = closest(own.select("id", "x", "y", "z"), meshes[j], "id")
            r = V.dot(V.sub((F.col("x"), F.col("y"), F.col("z")), (F.col("px"), F.col("py"), F.col("pz"))), (F.col("nx"), F.col("ny"), F.col("nz")))
            turned = V.transform((F.col("nx"), F.col("ny"), F.col("nz")), poses[j][:3], vector=True)
            found = met.select("id", r.alias("r"), *(e.alias(f"n{c}") for e, c in zip(turned, "xyz", strict=True))).join(own.select("id", "mesh_id", "wx", "wy", "wz"), "id").drop("id")
            total = found.mapInPandas(run, "i long, s array<double>").select("i", F.posexplode("s")).groupBy("i", "pos").agg(F.sum("col").alias("v")).collect()  # 43 numbers for each mesh
            by: dict[int, np.ndarray] = {}
            for t in total:
                by.setdefault(t["i"], np.zeros(43))[t["pos"]] = t["v"]
            sums += [{"i": i, "j": j, "a": v[:36], "g": v[36:42], "c": v[42]} for i, v in sorted(by.items())]
        a, g, cost = np.zeros((6 * len(free),) * 2), np.zeros(6 * len(free)), 0.0
        for s in sums:
            block, grad, cost = np.array(s["a"]).reshape(6, 6), np.array(s["g"]), cost + s["c"]
            for m, sign in ((s["i"], 1.0), (s["j"], -1.0)):
                if m in place:
                    k = 6 * place[m]
                    g[k : k + 6] += sign * grad
                    for m2, sign2 in ((s["i"], 1.0), (s["j"], -1.0)):
                        if m2 in place:
                            k2 = 6 * place[m2]
                            a[k : k + 6, k2 : k2 + 6] += sign * sign2 * block
        d = np.linalg.lstsq(a + 1e-9 * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
        for m, k in place.items():
            poses[m] = small_motion(d[6 * k : 6 * k + 6]) @ poses[m]
        if before is not None and abs(before - cost) <= tol * max(before, 1e-300) or np.abs(d).max(initial=0.0) < 1e-12:
            break
        before = cost
    return poses


def correspondence_counts(samples: DataFrame) -> DataFrame:
    """i, j, n: samples shared by each unordered pair of meshes."""
    return samples.groupBy(F.least("mesh_id", "to_id").alias("i"), F.greatest("mesh_id", "to_id").alias("j")).agg(F.count("*").alias("n"))


def alignment_samples(mesh: Mesh, spacing: float, other: Mesh | None = None, max_dist: float | None = None, max_angle: float = 0.5, planarity: float = 0.9) -> DataFrame:
    """id, x, y, z, nx, ny, nz: thinned places of a mesh that are fit for alignment.

    Places stay where the surface around is flat (by the neighbours within three spacings), and over the other mesh where
    one is given; then those farther than the mean and three deviations from it are left out, if there are over ten.
    """
    from .checkpoints import cut
    from .mesh import closest, numbered
    from .normals import estimate_normals
    from .sampling import dense_samples, poisson_disk

    raw = dense_samples(mesh.corners(), spacing / 2).withColumn("k", F.struct("fid", "w0", "w1"))
    dense = cut(numbered(raw, "k").select(F.col("n").alias("id"), "fid", "x", "y", "z"), "samples")
    thin = poisson_disk(dense, "id", ("x", "y", "z"), spacing)
    geometry = mesh.face_geometry().select("fid", F.col("nx").alias("fx"), F.col("ny").alias("fy"), F.col("nz").alias("fz"))
    thin = cut(thin.join(geometry, "fid").filter("fx is not null"), "samples")
    flat = estimate_normals(thin, "id", 3 * spacing, ("fx", "fy", "fz")).filter(F.col("confidence") >= planarity)
    good = thin.join(flat.select("id"), "id", "left_semi").select("id", "x", "y", "z", F.col("fx").alias("nx"), F.col("fy").alias("ny"), F.col("fz").alias("nz"))
    if other is None:
        return good
    met = closest(good.select("id", "x", "y", "z"), other, "id").select("id", "d", F.col("nx").alias("ox"), F.col("ny").alias("oy"), F.col("nz").alias("oz"))
    both = good.join(met, "id").filter(F.acos(F.least(F.greatest(F.col("nx") * F.col("ox") + F.col("ny") * F.col("oy") + F.col("nz") * F.col("oz"), F.lit(-1.0)), F.lit(1.0))) <= max_angle)
    if max_dist is not None:
        both = both.filter(F.col("d") <= max_dist)
    both = cut(both, "samples")
    n, mean, dev = both.agg(F.count("*"), F.avg("d"), F.stddev_pop("d")).first()
    if n > 10:
        both = both.filter(F.col("d") <= mean + 3 * dev)
    return both.select("id", "x", "y", "z", "nx", "ny", "nz")


def weights(samples: DataFrame, id_: str = "id", **columns) -> DataFrame:
    """samples with w, the product of weight columns (null counts as 0)."""
    w = F.lit(1.0)
    for c in columns.values():
        w = w * F.coalesce(c.cast("double"), F.lit(0.0))
    return samples.withColumn("w", w)


def stable_subset(points: DataFrame, key: str, share: float) -> DataFrame:
    """key of the smallest set, in stability order, that holds each of the six motions by at least a share of what all points do.

    The driver bisects the number of points; each step is one aggregation of six sums over the ranked points.
    """
    from .sampling import stability_order

    c = {n: F.col(n) for n in ("x", "y", "z", "nx", "ny", "nz")}
    parts = [c["nx"], c["ny"], c["nz"], c["y"] * c["nz"] - c["z"] * c["ny"], c["z"] * c["nx"] - c["x"] * c["nz"], c["x"] * c["ny"] - c["y"] * c["nx"]]
    ranked = numbered(stability_order(points, key).select(key, F.struct("order", key).alias("_o")), "_o").withColumn("place", F.col("n") + 1)
    rows = cut(points.join(ranked.select(key, "place"), key).select(key, "place", *((p * p).alias(f"s{k}") for k, p in enumerate(parts))), "stability")
    n = rows.count()
    whole = rows.agg(*(F.sum(f"s{k}") for k in range(6))).first()
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        got = rows.filter(F.col("place") <= middle).agg(*(F.sum(f"s{k}") for k in range(6))).first()
        if all((g or 0.0) >= share * (w or 0.0) - 1e-12 for g, w in zip(got, whole, strict=True)):
            high = middle
        else:
            low = middle + 1
    return rows.filter(F.col("place") <= low).select(key)
