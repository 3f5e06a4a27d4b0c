"""Airfoil sections: camber line by inscribed circles, edges, thickness and faces; a section is one group."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .sampling import hull_2d, turn


@dataclass
class Station:
    """An inscribed circle with its contact points on both sides of the camber line."""

    centre: np.ndarray
    radius: float
    upper: np.ndarray
    lower: np.ndarray


class Section:
    def __init__(self, points: np.ndarray):
        p = np.asarray(points, float)
        if np.allclose(p[0], p[-1]):
            p = p[:-1]
        area = (p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()
        self.p = p if area > 0 else p[::-1]
        self.a, self.d = self.p, np.roll(self.p, -1, axis=0) - self.p
        self.size = np.maximum((self.d**2).sum(1), 1e-300)

    def hits(self, o: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sorted parameters at which the line o + t w meets the section."""
        across = w[0] * self.d[:, 1] - w[1] * self.d[:, 0]
        g = self.a - o
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (g[:, 0] * self.d[:, 1] - g[:, 1] * self.d[:, 0]) / across
            u = (g[:, 0] * w[1] - g[:, 1] * w[0]) / across
        return np.unique(np.round(t[(np.abs(across) > 1e-14) & (u >= 0) & (u <= 1)], 12))

    def closest(self, q: np.ndarray, side: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """(distance, place) of the closest place; side: only what lies on that side of q."""
        g = q - self.a
        t = np.clip((g * self.d).sum(1) / self.size, 0, 1)
        place = self.a + t[:, None] * self.d
        gap = place - q
        d = np.linalg.norm(gap, axis=1)
        if side is not None:
            d = np.where(gap @ side >= 0, d, np.inf)
        k = int(d.argmin())
        return float(d[k]), place[k]

    def inscribed(self, o: np.ndarray, w: np.ndarray, tol: float) -> Station | None:
        """The inscribed circle centred on the part of a line inside the section, where both sides are equally far."""
        t = self.hits(o, w)
        if len(t) < 2:
            return None
        k = int(np.searchsorted(t, 0.0))
        k = min(max(k, 1), len(t) - 1)
        low, high = t[k - 1], t[k]
        w = w / np.linalg.norm(w)
        scale = 1.0
        for _ in range(200):
            m = (low + high) / 2
            c = o + w * m * scale
            up, down = self.closest(c, w), self.closest(c, -w)
            if up[0] > down[0]:
                low = m
            else:
                high = m
            if high - low < tol * 1e-3:
                break
        return Station(c, min(up[0], down[0]), up[1], down[1])


def camber_stations(section: Section, tol: float) -> list[Station]:
    """From a spanning ray at mid-chord in both directions, in steps of a quarter radius, then refined until a circle
    halfway between two stations is within tol of their mean."""
    p = section.p
    hull = p[hull_2d(p)]
    gap = np.linalg.norm(hull[:, None] - hull[None], axis=2)
    i, j = np.unravel_index(gap.argmax(), gap.shape)
    chord = (hull[j] - hull[i]) / gap[i, j]
    first = section.inscribed((hull[i] + hull[j]) / 2, np.array([-chord[1], chord[0]]), tol)
    if first is None:
        raise ValueError("no ray spans the section")

    def march(sign: float) -> list[Station]:
        out, way = [], chord * sign
        last = first
        for _ in range(2000):
            step = max(last.radius * 0.25, tol)
            n = np.array([-way[1], way[0]])
            s = section.inscribed(last.centre + way * step, n, tol)
            inside = s is not None and np.linalg.norm(s.centre - last.centre) < 3 * step
            if not inside or s.radius < tol or section.hits(s.centre, way)[-1] < tol:
                break
            way = (s.centre - last.centre) / max(np.linalg.norm(s.centre - last.centre), 1e-300)
            out.append(s)
            last = s
            end = section.hits(s.centre, way)
            if not len(end) or end[-1] <= s.radius * 1.02:
                break
        return out

    stations = [*march(-1.0)[::-1], first, *march(1.0)]
    refined, stack = [stations[0]], stations[:0:-1]
    while stack and len(refined) < 20_000:
        a, b = refined[-1], stack[-1]
        mid, way = (a.centre + b.centre) / 2, b.centre - a.centre
        if np.linalg.norm(way) > 4 * tol:
            s = section.inscribed(mid, np.array([-way[1], way[0]]) / np.linalg.norm(way), tol)
            if s is not None and (np.linalg.norm(s.centre - mid) > tol or abs(s.radius - (a.radius + b.radius) / 2) > tol):
                stack.append(s)
                continue
        refined.append(stack.pop())
    return refined


def edge_point(section: Section, stations: Sequence[Station], strategy: str = "intersect") -> np.ndarray | None:
    """Where the camber line leaves the section beyond its last station.

    open: none. intersect: along the last direction. trace: the place of largest distance from the last station.
    radius: along the direction through the centre of a circle fitted to the contour beyond the last contact points.
    """
    if strategy == "open":
        return None
    last, before = stations[-1], stations[-2] if len(stations) > 1 else stations[-1]
    way = last.centre - before.centre
    way = way / max(np.linalg.norm(way), 1e-300)
    beyond = section.p[(section.p - last.centre) @ way > 0]
    if strategy == "trace" and len(beyond):
        return beyond[np.linalg.norm(beyond - last.centre, axis=1).argmax()]
    if strategy == "radius" and len(beyond) >= 3:
        a = np.column_stack([2 * beyond, np.ones(len(beyond))])
        c = np.linalg.lstsq(a, (beyond**2).sum(1), rcond=None)[0]
        r = np.sqrt(max(c[2] + c[0] ** 2 + c[1] ** 2, 0))
        w = c[:2] - before.centre
        return c[:2] + w / max(np.linalg.norm(w), 1e-300) * r
    t = section.hits(last.centre, way)
    t = t[t > 0]
    return last.centre + way * t[0] if len(t) else None


def reversed_stations(stations: Sequence[Station]) -> list[Station]:
    """In the other order, so that what was on the left of the camber line is on its right."""
    return [Station(s.centre, s.radius, s.lower, s.upper) for s in reversed(stations)]


def oriented(stations: Sequence[Station], strategy: str = "thickest", direction: Sequence[float] | None = None) -> list[Station]:
    """Stations with the leading edge first.

    thickest: the end that is nearer, along the camber line, to the largest inscribed circle leads, as on most subsonic
    airfoils. direction: the end that lies further in a given direction leads.
    """
    if not stations:
        raise ValueError("no stations to orient")
    centres = np.array([s.centre for s in stations])
    if strategy == "direction":
        if direction is None:
            raise ValueError("a direction is needed")
        turned = (centres[-1] - centres[0]) @ np.asarray(direction, float) > 0
    elif strategy == "thickest":
        at = np.concatenate(([0], np.cumsum(np.linalg.norm(np.diff(centres, axis=0), axis=1))))
        turned = at[int(np.argmax([s.radius for s in stations]))] > at[-1] / 2
    else:
        raise ValueError(f"no such orientation: {strategy}")
    return reversed_stations(stations) if turned else list(stations)


def analyse(points: np.ndarray, tol: float = 1e-3, leading: str = "intersect", trailing: str = "intersect", direction: Sequence[float] | None = None) -> dict:
    """Stations from the leading edge to the trailing edge, edges, largest thickness and chord.

    Without a direction (from trailing to leading edge) the end nearer the thickest station leads.
    """
    section = Section(points)
    stations = camber_stations(section, tol)
    stations = oriented(stations, "thickest" if direction is None else "direction", direction)
    stations = [s if turn(stations[-1].centre - stations[0].centre, s.upper - s.centre) >= 0 else Station(s.centre, s.radius, s.lower, s.upper) for s in stations]
    le, te = edge_point(section, stations[::-1], leading), edge_point(section, stations, trailing)
    # the last of the largest circles
    radii = np.array([s.radius for s in stations])
    t_max = stations[len(radii) - 1 - int(radii[::-1].argmax())]
    ends = [e if e is not None else s.centre for e, s in ((le, stations[0]), (te, stations[-1]))]
    return {"stations": stations, "leading": le, "trailing": te, "t_max": t_max, "chord": float(np.linalg.norm(ends[1] - ends[0]))}


def thickness_at(points: np.ndarray, stations: Sequence[Station], length: float) -> float:
    """Width across the camber line at a length from its first station."""
    c = np.array([s.centre for s in stations])
    step = np.linalg.norm(np.diff(c, axis=0), axis=1)
    at = np.concatenate(([0], np.cumsum(step)))
    k = min(max(int(np.searchsorted(at, length)) - 1, 0), len(step) - 1)
    way = (c[k + 1] - c[k]) / step[k]
    t = Section(points).hits(c[k] + way * (length - at[k]), np.array([-way[1], way[0]]))
    below, above = t[t <= 0], t[t > 0]
    return float(above[0] - below[-1]) if len(above) and len(below) else float("nan")


def analyse_sections(points: DataFrame, by: str, tol: float = 1e-3, leading: str = "intersect", trailing: str = "intersect") -> DataFrame:
    """by, t_max, t_max_x, t_max_y, chord, n_stations, le_x, le_y, te_x, te_y for each section (by, seq, x, y)."""
    kind = dict(points.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = analyse(pdf.sort_values("seq")[["x", "y"]].to_numpy(float), tol, leading, trailing)
        nan = (float("nan"),) * 2
        le, te = (tuple(e) if e is not None else nan for e in (r["leading"], r["trailing"]))
        row = (pdf[by].iloc[0], 2 * r["t_max"].radius, *r["t_max"].centre, r["chord"], len(r["stations"]), *le, *te)
        return pd.DataFrame([row], columns=[by, "t_max", "t_max_x", "t_max_y", "chord", "n_stations", "le_x", "le_y", "te_x", "te_y"])

    return points.groupBy(by).applyInPandas(run, f"{by} {kind}, t_max double, t_max_x double, t_max_y double, chord double, n_stations long, le_x double, le_y double, te_x double, te_y double")


def stations_of(points: DataFrame, by: str, tol: float = 1e-3) -> DataFrame:
    """by, station, cx, cy, radius and both contact points of each section's inscribed circles."""
    kind = dict(points.dtypes)[by]
    names = ["cx", "cy", "radius", "ux", "uy", "lx", "ly"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = analyse(pdf.sort_values("seq")[["x", "y"]].to_numpy(float), tol)["stations"]
        out = pd.DataFrame([(*x.centre, x.radius, *x.upper, *x.lower) for x in s], columns=names)
        out.insert(0, "station", range(len(out)))
        out.insert(0, by, pdf[by].iloc[0])
        return out

    return points.groupBy(by).applyInPandas(run, f"{by} {kind}, station long, " + ", ".join(f"{n} double" for n in names))


# ---- more on edges -----------------------------------------------------------------------------------------------------
def _beyond(section: Section, stations: Sequence[Station]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contour beyond the last station in order, direction of travel, last centre)."""
    last = stations[-1]
    way = last.centre - stations[-2].centre
    way = way / max(np.linalg.norm(way), 1e-300)
    ahead = (section.p - last.centre) @ way > 0
    start = np.flatnonzero(~ahead & np.roll(ahead, -1))
    order = np.roll(np.arange(len(ahead)), -(int(start[0]) + 1)) if len(start) else np.arange(len(ahead))
    return section.p[order[ahead[order]]], way, last.centre


def curvature_of(p: np.ndarray) -> np.ndarray:
    a, b = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
    across = (p[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]) - (p[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    sides = np.linalg.norm(p - a, axis=1) * np.linalg.norm(b - p, axis=1) * np.linalg.norm(b - a, axis=1)
    out = np.where(sides > 0, 2 * np.abs(across) / np.maximum(sides, 1e-300), 0)
    out[[0, -1]] = 0
    return out


def fit_circle(p: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Geometric least squares by Gauss-Newton from the algebraic fit."""
    a = np.column_stack([2 * p, np.ones(len(p))])
    c = np.linalg.lstsq(a, (p**2).sum(1), rcond=None)[0]
    centre, r = c[:2], float(np.sqrt(max(c[2] + c[0] ** 2 + c[1] ** 2, 0)))
    for _ in range(rounds):
        gap = p - centre
        d = np.maximum(np.linalg.norm(gap, axis=1), 1e-300)
        step = np.linalg.lstsq(np.column_stack([gap / d[:, None], np.ones(len(p))]), d - r, rcond=None)[0]
        centre, r = centre + step[:2], r + step[2]
        if np.abs(step).max() < 1e-14:
            break
    return centre, float(r)


def locate_edge(section: Section, stations: Sequence[Station], strategy: str, radius: float | None = None, tol: float = 1e-4, seed: int = 7, draws: int = 400) -> dict | None:
    """The edge beyond the last station: point, and centre and radius where the strategy fits a circle.

    open: none. intersect: along the last direction. gap: midway between the ends of an open contour. curvature: the
    contour's sharpest place. fit: least-squares circle of the contour beyond the last station. constant: the circle of a
    given radius that touches both sides. converge: where the tangents at the last contact points meet the contour.
    ransac: the circle of three contour points that most of them are within tol of.
    """
    if strategy == "open" or len(stations) < 2:
        return None
    p, way, last = _beyond(section, stations)
    if strategy in ("intersect", "gap") or len(p) < 3:
        point = edge_point(section, stations, "intersect")
        if strategy == "gap" and len(p) > 1:
            step = np.linalg.norm(np.diff(p, axis=0), axis=1)
            k = int(step.argmax())
            point = (p[k] + p[k + 1]) / 2
        return None if point is None else {"point": point}
    if strategy == "curvature":
        return {"point": p[int(curvature_of(p).argmax())]}
    if strategy == "converge":
        a, b = stations[-1].upper, stations[-1].lower
        u, v = a - stations[-2].upper, b - stations[-2].lower
        m = np.column_stack([u, -v])
        if abs(np.linalg.det(m)) > 1e-12:
            t = np.linalg.solve(m, b - a)
            to = a + u * t[0] - last
            hits = section.hits(last, to / max(np.linalg.norm(to), 1e-300))
            hits = hits[hits > 0]
            if len(hits):
                return {"point": last + to / np.linalg.norm(to) * hits[0]}
        return {"point": edge_point(section, stations, "intersect")}
    if strategy == "constant":
        if not radius:
            raise ValueError("a constant radius is needed")
        low, high = 0.0, float(section.hits(last, way)[-1])
        for _ in range(80):  # the distance to the contour falls towards the edge
            t = (low + high) / 2
            low, high = (t, high) if section.closest(last + way * t)[0] > radius else (low, t)
        centre, r = last + way * low, radius
    elif strategy == "ransac":
        rng, best, centre, r = np.random.default_rng(seed), -1, last, 0.0
        for _ in range(draws):
            a, b, c = p[rng.choice(len(p), 3, replace=False)]
            m = np.array([b - a, c - a]) * 2
            if abs(np.linalg.det(m)) < 1e-14:
                continue
            u = np.linalg.solve(m, [(b - a) @ (b - a), (c - a) @ (c - a)])
            near = int((np.abs(np.linalg.norm(p - a - u, axis=1) - np.hypot(*u)) <= tol).sum())
            if near > best:
                best, centre, r = near, a + u, float(np.hypot(*u))
    else:
        centre, r = fit_circle(p)
    to = centre - last
    to = to / np.linalg.norm(to) if np.linalg.norm(to) > 1e-12 else way
    return {"point": centre + to * r, "centre": centre, "radius": r, "residual": float(np.abs(np.linalg.norm(p - centre, axis=1) - r).max())}


def edge_kind(section: Section, stations: Sequence[Station], tol: float = 1e-3) -> str:
    """open (a wide gap), square (two corners), sharp (one corner), round (a circle fits) or other."""
    p, _, _ = _beyond(section, stations)
    if len(p) < 3:
        return "sharp"
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    if step.max() > 10 * np.median(step) and step.max() > stations[-1].radius:
        return "open"
    a, b = p[1:-1] - p[:-2], p[2:] - p[1:-1]
    angle = np.abs(np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(1)))
    corners = int((angle > np.pi / 4).sum())
    if corners == 2:
        return "square"
    if corners == 1:
        return "sharp"
    c, r = fit_circle(p)
    near = np.abs(np.linalg.norm(p - c, axis=1) - r)
    return "round" if near.max() < max(tol, 0.1 * r) else "other"


def faces_of(points: np.ndarray, result: dict) -> tuple[np.ndarray, np.ndarray]:
    """The contour's upper and lower side, both from the leading to the trailing edge."""
    p = Section(points).p
    ends = [result[k] if result[k] is not None else result["stations"][j].centre for k, j in (("leading", 0), ("trailing", -1))]
    i, j = (int(np.linalg.norm(p - e, axis=1).argmin()) for e in ends)
    one = p[i : j + 1] if i <= j else np.concatenate([p[i:], p[: j + 1]])
    two = (p[j : i + 1] if j <= i else np.concatenate([p[j:], p[: i + 1]]))[::-1]
    chord = ends[1] - ends[0]
    above = lambda q: turn(chord, q.mean(axis=0) - ends[0])
    return (one, two) if above(one) >= above(two) else (two, one)


def caliper_chord(points: np.ndarray, lower_side: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Origin and direction of the chord that a straight edge on the section's longest hull edge gives."""
    p = Section(points).p
    hull = p[hull_2d(p)]
    step = np.roll(hull, -1, axis=0) - hull
    k = int((step**2).sum(1).argmax())
    way = step[k] / np.linalg.norm(step[k])
    t = (hull - hull[k]) @ way
    return hull[k] + way * t.min(), way * (t.max() - t.min())


# ---- an edge with two rounded corners ------------------------------------------------------------------------------------
def rounded_square_distances(p: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of each point from the path start, corner, corner, end with rounded corners; x: both corners, both radii.

    A corner's circle touches both legs; between the touching points its arc replaces them.
    """
    path = [start, x[:2], x[2:4], end]
    legs, arcs, at = [], [], start
    for corner, after, radius in ((path[1], path[2], x[4]), (path[2], path[3], x[5])):
        before = path[0] if corner is path[1] else path[1]
        u, v = before - corner, after - corner
        u, v = u / max(np.linalg.norm(u), 1e-300), v / max(np.linalg.norm(v), 1e-300)
        half = np.arccos(np.clip(u @ v, -1, 1)) / 2
        radius, reach = abs(radius), abs(radius) / max(np.tan(half), 1e-9)
        middle = u + v
        centre = corner + middle / max(np.linalg.norm(middle), 1e-300) * radius / max(np.sin(half), 1e-9)
        legs.append((at, corner + u * reach))
        arcs.append((centre, radius, corner - centre, np.cos(np.pi / 2 - half)))
        at = corner + v * reach
    legs.append((at, end))
    out = []
    for a, b in legs:
        d = b - a
        t = np.clip((p - a) @ d / max(d @ d, 1e-300), 0, 1)
        out.append(np.linalg.norm(p - a - t[:, None] * d, axis=1))
    for centre, radius, way, spread in arcs:
        gap = p - centre
        size = np.maximum(np.linalg.norm(gap, axis=1), 1e-300)
        inside = gap @ way / size >= spread * np.linalg.norm(way)
        out.append(np.where(inside, np.abs(size - radius), np.inf))
    return np.min(out, axis=0)


def fit_rounded_square(p: np.ndarray, tip: np.ndarray, rounds: int = 100) -> dict:
    """Least squares of an edge contour p (in order) as two corners with radii; tip: where the camber line leaves it.

    Levenberg and Marquardt's steps with differences for slopes. Returns corners, radii and the largest distance left.
    """
    start, end = p[0], p[-1]
    middle = (start + end) / 2
    x = np.concatenate([tip + start - middle, tip + end - middle, [np.linalg.norm(end - start) / 4] * 2])
    damping, now = 1e-3, rounded_square_distances(p, start, end, x)
    for _ in range(rounds):
        slopes = np.stack([(rounded_square_distances(p, start, end, x + h) - now) / 1e-6 for h in np.eye(6) * 1e-6], axis=1)
        a, b = slopes.T @ slopes, -slopes.T @ now
        step = np.linalg.solve(a + damping * (np.diag(np.diag(a)) + 1e-12 * np.eye(6)), b)
        then = rounded_square_distances(p, start, end, x + step)
        if then @ then < now @ now:
            small = now @ now - then @ then < 1e-15 * (now @ now)
            x, now, damping = x + step, then, damping / 5
            if small:
                break
        else:
            damping *= 5
            if damping > 1e12:
                break
    return {"corners": x[:4].reshape(2, 2), "radii": np.abs(x[4:]), "residual": float(now.max())}
