"""Conformal flattening of a mesh patch with one boundary loop, solved per mesh."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def face_angles(tri: np.ndarray) -> np.ndarray:
    out = np.zeros(tri.shape[:2])
    for k in range(3):
        a, b = tri[:, (k + 1) % 3] - tri[:, k], tri[:, (k + 2) % 3] - tri[:, k]
        out[:, k] = np.arctan2(np.linalg.norm(np.cross(a, b), axis=1), (a * b).sum(1))
    return out


def cotan_laplacian(vertices: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triplets (i, j, value) of the positive cotangent Laplacian; equal places add up."""
    cot = 1 / np.tan(np.maximum(face_angles(vertices[faces]), 1e-12))
    i, j, v = [], [], []
    for k in range(3):
        a, b, w = faces[:, (k + 1) % 3], faces[:, (k + 2) % 3], cot[:, k] / 2
        i += [a, b, a, b]
        j += [b, a, a, b]
        v += [-w, -w, w, w]
    return np.concatenate(i), np.concatenate(j), np.concatenate(v)


def boundary_loop(faces: np.ndarray) -> list[int]:
    edges = {(int(f[k]), int(f[(k + 1) % 3])) for f in faces for k in range(3)}
    rim = {a: b for a, b in edges if (b, a) not in edges}
    if not rim:
        raise ValueError("flatten: the mesh has no boundary")
    loop = [min(rim)]
    while rim[loop[-1]] != loop[0]:
        loop.append(rim[loop[-1]])
        if len(loop) > len(rim):
            raise ValueError("flatten: the boundary isn't a simple loop")
    if len(loop) != len(rim):
        raise ValueError("flatten: the mesh has more than one boundary loop")
    return loop


class _Solver:
    """Symmetric positive systems by conjugate gradients on triplets, without a dense matrix."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, inner: np.ndarray):
        self.i, self.j, self.v, self.n, self.inner = i, j, v, n, inner
        self.diag = np.maximum(np.bincount(i[i == j], v[i == j], n), 1e-12)

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, self.v * x[self.j], self.n)

    def solve(self, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """x with A x = b on inner places and x = known elsewhere."""
        x = np.where(self.inner, 0.0, known)
        r = np.where(self.inner, b - self.times(x), 0.0)
        z = r / self.diag
        p, rz = z.copy(), r @ z
        for _ in range(20 * self.n + 100):
            if np.abs(r).max(initial=0.0) < 1e-13 * max(1.0, np.abs(b).max(initial=0.0), np.abs(x).max(initial=0.0)):
                break
            ap = np.where(self.inner, self.times(p), 0.0)
            alpha = rz / (p @ ap)
            x, r = x + alpha * p, r - alpha * ap
            z = r / self.diag
            rz, old = r @ z, rz
            p = z + rz / old * p
        return x


def flatten_array(vertices: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """uv of each vertex: boundary first, with the lengths of the rim kept as far as a closed curve allows.

    The rim's target angles come from the scale factors that are zero on the rim and balance the angle defects inside;
    the rim is laid out by them and closed by least squares, and the inside is its harmonic extension.
    """
    n, loop = len(vertices), boundary_loop(faces)
    i, j, v = cotan_laplacian(vertices, faces)
    rim = np.zeros(n, bool)
    rim[loop] = True
    defect = np.where(rim, np.pi, 2 * np.pi) - np.bincount(faces.ravel(), face_angles(vertices[faces]).ravel(), n)
    solver = _Solver(i, j, v, n, ~rim)
    u = solver.solve(-defect, np.zeros(n))
    flux = solver.times(u)
    turn = defect[loop] + flux[loop]  # what is left to turn at each rim vertex
    turn *= 2 * np.pi / turn.sum() if abs(turn.sum()) > 1e-9 else 1
    ring = vertices[loop]
    length = np.linalg.norm(np.roll(ring, -1, axis=0) - ring, axis=1)
    heading = np.concatenate(([0], np.cumsum(turn[1:])))
    t = np.stack([np.cos(heading), np.sin(heading)], 1)
    # the smallest change of lengths, weighted by length, that closes the curve
    w = length
    fix = np.linalg.lstsq((t * w[:, None]).T @ t, -(t * length[:, None]).sum(0), rcond=None)[0]
    closed = t * (length + w * (t @ fix))[:, None]
    places = np.concatenate([np.zeros((1, 2)), np.cumsum(closed, axis=0)[:-1]])
    out = np.zeros((n, 2))
    for k in range(2):
        known = np.zeros(n)
        known[loop] = places[:, k]
        out[:, k] = solver.solve(np.zeros(n), known)
    return out


def flatten(vertices: DataFrame, faces: DataFrame, by: str = "mesh_id") -> DataFrame:
    """by, vid, u, v for each mesh (by, vid, x, y, z; by, fid, a, b, c). A mesh is one group."""
    kind = dict(vertices.dtypes)[by]

    def run(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("vid")
        at = pd.Series(range(len(v)), index=v["vid"])
        uv = flatten_array(v[["x", "y", "z"]].to_numpy(float), np.stack([at[f[c]].to_numpy() for c in "abc"], 1))
        return pd.DataFrame({by: key[0], "vid": v["vid"], "u": uv[:, 0], "v": uv[:, 1]})

    return vertices.select(by, "vid", "x", "y", "z").groupBy(by).cogroup(faces.select(by, F.col("a"), "b", "c").groupBy(by)).applyInPandas(run, f"{by} {kind}, vid long, u double, v double")
