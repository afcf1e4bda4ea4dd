"""Kernels that make shapes: hulls, bounding shapes, buffers, Voronoi cells."""

from __future__ import annotations

import math

import numpy as np

from . import arrangement as ar
from .bridge import Shape


def all_points(shape: Shape) -> np.ndarray:
    rings = [r[:, :2] for p in shape for r in p if len(r)]
    return np.vstack(rings) if rings else np.empty((0, 2))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise and open (Andrew's monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    rows = pts.tolist()
    lower, upper = chain(rows), chain(rows[::-1])
    return np.array(lower[:-1] + upper[:-1])


def closed(ring: np.ndarray) -> np.ndarray:
    return np.vstack([ring, ring[:1]])


def rotated_rectangle(points: np.ndarray, by_width: bool = False) -> tuple[np.ndarray, float, float, float]:
    """The smallest rectangle by area or width: corners (closed), width, length, orientation clockwise from north."""
    h = hull(points)
    if len(h) < 3:
        d = h[-1] - h[0]
        return closed(np.vstack([h, h[::-1]]))[: len(h) * 2], 0.0, float(np.hypot(*d)), math.degrees(math.atan2(d[0], d[1])) % 180
    best = None
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        u = (b - a) / np.hypot(*(b - a))
        v = np.array([-u[1], u[0]])
        s, t = h @ u, h @ v
        w, l = s.max() - s.min(), t.max() - t.min()
        size = min(w, l) if by_width else w * l
        if best is None or size < best[0] - 1e-12 * max(1.0, abs(size)):
            best = (size, u, v, s.min(), s.max(), t.min(), t.max())
    _, u, v, s0, s1, t0, t1 = best
    corners = np.array([s0 * u + t0 * v, s1 * u + t0 * v, s1 * u + t1 * v, s0 * u + t1 * v])
    long = u if s1 - s0 >= t1 - t0 else v
    return closed(corners), float(min(s1 - s0, t1 - t0)), float(max(s1 - s0, t1 - t0)), math.degrees(math.atan2(long[0], long[1])) % 180


def circle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The smallest enclosing circle: centre and radius (Welzl, iteratively over the hull)."""
    h = hull(points)
    rng = np.random.default_rng(0)
    pts = h[rng.permutation(len(h))]

    def holds(c, p):
        return c is not None and np.hypot(*(p - c[0])) <= c[1] * (1 + 1e-12) + 1e-300

    def two(a, b):
        return (a + b) / 2, float(np.hypot(*(a - b)) / 2)

    def three(a, b, c):
        d = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        if d == 0:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda x: x[1])
        p, q = (b - a) @ (b - a), (c - a) @ (c - a)
        x = np.array([(c - a)[1] * p - (b - a)[1] * q, (b - a)[0] * q - (c - a)[0] * p]) / d
        return a + x, float(np.hypot(*x))

    c = None
    for i, p in enumerate(pts):
        if holds(c, p):
            continue
        c = (p, 0.0)
        for j in range(i):
            if not holds(c, pts[j]):
                c = two(p, pts[j])
                for k in range(j):
                    if not holds(c, pts[k]):
                        c = three(p, pts[j], pts[k])
    return c


def circle_ring(centre: np.ndarray, radius: float, n: int = 32) -> np.ndarray:
    t = np.arange(n) * (2 * math.pi / n)
    return closed(np.stack([centre[0] + radius * np.cos(t), centre[1] + radius * np.sin(t)], axis=1))


def bounding(shape: Shape, kind: str) -> tuple[Shape | None, float | None, float | None, float | None]:
    """A bounding shape and its width, length and orientation."""
    pts = all_points(shape)
    if not len(pts):
        return None, None, None, None
    if kind == "envelope":
        (x0, y0), (x1, y1) = pts.min(axis=0), pts.max(axis=0)
        w, h = x1 - x0, y1 - y0
        return ar.box(x0, y0, x1, y1), float(min(w, h)), float(max(w, h)), 90.0 if w > h else 0.0
    if kind in ("rectangle_by_area", "rectangle_by_width"):
        ring, w, l, o = rotated_rectangle(pts, kind.endswith("width"))
        return ([[ring]] if len(ring) > 3 else None), w, l, o
    if kind == "convex_hull":
        h = hull(pts)
        _, w, _, _ = rotated_rectangle(pts, True)
        d = h[:, None] - h[None]
        far = np.hypot(d[..., 0], d[..., 1])
        i, j = np.unravel_index(np.argmax(far), far.shape)
        long = h[j] - h[i]
        return ([[closed(h)]] if len(h) > 2 else None), w, float(far[i, j]), math.degrees(math.atan2(long[0], long[1])) % 360
    if kind == "circle":
        c, r = circle(pts)
        return [[circle_ring(c, r)]], 2 * r, 2 * r, 0.0
    raise ValueError(f"unknown bounding shape {kind!r}")


def _arc(centre, start, end, radius, quadrant) -> list:
    """Points of an arc counter-clockwise from angle start to end."""
    n = max(1, math.ceil((end - start) / (math.pi / 2) * quadrant - 1e-9))
    return [(centre[0] + radius * math.cos(start + (end - start) * k / n), centre[1] + radius * math.sin(start + (end - start) * k / n)) for k in range(n + 1)]


def disk(centre: np.ndarray, radius: float, quadrant: int) -> Shape:
    n = 4 * quadrant
    t = np.arange(n) * (2 * math.pi / n)
    return [[closed(np.stack([centre[0] + radius * np.cos(t), centre[1] + radius * np.sin(t)], axis=1))]]


def _capsule(a, b, radius, quadrant, side, cap, first, last) -> Shape:
    """One segment thickened: on both sides, or on one; with round joints inside a line and caps at its ends."""
    angle = math.atan2(b[1] - a[1], b[0] - a[0])
    u = np.array([math.cos(angle), math.sin(angle)])
    v = np.array([-u[1], u[0]])
    if side:
        w = v * radius * side
        ring = np.array([a, b, b + w, a + w])
        return [[closed(ring if side > 0 else ring[::-1])]]
    p, q = a.copy(), b.copy()
    end_cap, start_cap = (cap if last else "round"), (cap if first else "round")
    if end_cap == "square":
        q = b + u * radius
    if start_cap == "square":
        p = a - u * radius
    right = [tuple(p - v * radius), tuple(q - v * radius)]
    left = [tuple(q + v * radius), tuple(p + v * radius)]
    ring = right[:1]
    ring += _arc(b, angle - math.pi / 2, angle + math.pi / 2, radius, quadrant) if end_cap == "round" else [right[1], left[0]]
    ring += _arc(a, angle + math.pi / 2, angle + 3 * math.pi / 2, radius, quadrant)[:-1] if start_cap == "round" else [left[1]]
    return [[closed(np.array(ring))]]


def buffer(shape: Shape, distance: float, dimension: int, quadrant: int = 32, side: str = "full", cap: str = "round", tolerance: float | None = None) -> Shape | None:
    """All places within ``distance``; negative distances shrink polygons and leave nothing of others."""
    if distance is None or not math.isfinite(distance):
        return None
    sign = {"left": 1, "right": -1}.get(side, 0)
    if dimension == 0:
        if distance <= 0:
            return None
        pts = all_points(shape)
        if cap == "square":
            return ar.union([ar.box(x - distance, y - distance, x + distance, y + distance) for x, y in pts], tolerance)
        return ar.union([disk(p, distance, quadrant) for p in pts], tolerance)
    if dimension == 1:
        if distance == 0 or (distance < 0 and not sign):
            return None
        pieces = []
        for part in shape:
            for ring in part:
                r = ring[:, :2][np.append(True, (np.diff(ring[:, :2], axis=0) != 0).any(axis=1))]
                looped = (r[0] == r[-1]).all()
                for k in range(len(r) - 1):
                    pieces.append(_capsule(r[k], r[k + 1], abs(distance), quadrant, sign * (1 if distance > 0 else -1), cap, k == 0 and not looped, k == len(r) - 2 and not looped))
        return ar.union(pieces, tolerance) if pieces else None
    valid = ar.make_valid(shape)
    if not valid:
        return None
    if distance == 0:
        return valid
    band = buffer(ar.boundary(valid), abs(distance), 1, quadrant, "full", "round", tolerance)
    grown = ar.union([valid, band], tolerance) if distance > 0 else ar.difference(valid, band, tolerance)
    if side in ("outside", "only_outside"):
        return ar.difference(grown, valid, tolerance) if distance > 0 else ar.difference(valid, grown, tolerance)
    return grown or None


def voronoi_cell(site: np.ndarray, others: np.ndarray, window: tuple[float, float, float, float]) -> np.ndarray:
    """The cell of one site among others (nearest first), within a window: an open ring."""
    x0, y0, x1, y1 = window
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    sx, sy = site.tolist()
    reach2 = math.inf
    for ox, oy in others.tolist():
        dx, dy = ox - sx, oy - sy
        n2 = dx * dx + dy * dy
        if n2 == 0:
            continue
        if n2 > 4 * reach2:  # no farther site can cut the cell
            break
        c = (dx * (sx + ox) + dy * (sy + oy)) / 2
        beyond = [dx * x + dy * y - c for x, y in ring]
        if max(beyond) <= 0:
            if reach2 == math.inf:
                reach2 = max((x - sx) ** 2 + (y - sy) ** 2 for x, y in ring)
            continue
        cut, p, sp = [], ring[-1], beyond[-1]
        for q, sq in zip(ring, beyond):
            if sp < 0 < sq or sq < 0 < sp:
                t = sp / (sp - sq)
                cut.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
            if sq <= 0:
                cut.append(q)
            p, sp = q, sq
        ring = cut
        if not ring:
            break
        reach2 = max((x - sx) ** 2 + (y - sy) ** 2 for x, y in ring)
    return np.array(ring).reshape(-1, 2)


def voronoi_cells(points: np.ndarray, count: int, window: tuple[float, float, float, float]) -> list[np.ndarray]:
    """``voronoi_cell`` of the first ``count`` points among all, each looking only as far around as it must.

    Points are sorted into squares of about two, and a site asks wider and wider blocks of squares around its own,
    until its cell is closed off by what it has seen.
    """
    low, high = points.min(axis=0), points.max(axis=0)
    n = max(1, int((len(points) / 2) ** 0.5))
    size = np.maximum((high - low) / n, 1e-300)
    at = np.minimum((points - low) / size, n - 1).astype(np.int64)
    number = at[:, 0] * n + at[:, 1]
    order = np.argsort(number, kind="stable")
    begins = np.searchsorted(number[order], np.arange(n * n + 1))
    out = []
    for k in range(count):
        s, (a, b), r = points[k], at[k].tolist(), 2
        while True:
            a0, a1, b0, b1 = max(a - r, 0), min(a + r, n - 1), max(b - r, 0), min(b + r, n - 1)
            near = np.concatenate([order[begins[c * n + b0] : begins[c * n + b1 + 1]] for c in range(a0, a1 + 1)])
            others = points[near]
            ring = voronoi_cell(s, others[np.argsort(((others - s) ** 2).sum(axis=1), kind="stable")], window)
            if a0 == b0 == 0 and a1 == b1 == n - 1 or not len(ring):
                break
            reach = 2 * float(np.hypot(*(ring - s).T).max())
            x0, y0 = low + size * (a0, b0)
            x1, y1 = low + size * (a1 + 1, b1 + 1)
            if (a0 == 0 or s[0] - reach >= x0) and (b0 == 0 or s[1] - reach >= y0) and (a1 == n - 1 or s[0] + reach <= x1) and (b1 == n - 1 or s[1] + reach <= y1):
                break
            r *= 2
        out.append(ring)
    return out
