"""Kernels over all rings of a batch at once: those of one length are one array."""

from __future__ import annotations

import numpy as np

from .bridge import Shape, Shapes

#: Longer rings go to the kernels for single ones: the work here is quadratic in their length.
LONGEST = 32
#: How near, relative to edges, counts as touching: what touches is left to the general kernels.
NEAR = 1e-9
#: What a ring is: not known here; nothing; simple; an upright rectangle as it should be; two loops that cross once.
UNKNOWN, NOTHING, SIMPLE, RECTANGLE, LOOPS = range(5)


def cleaned(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices without NaN and without repeats of the one before, and the rings' new offsets."""
    keep = ~np.isnan(flat[:, :2]).any(axis=1)
    if not keep.all():
        ends = np.append(0, np.cumsum(keep))[ends]
        flat = flat[keep]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:, :2] != flat[:-1, :2]).any(axis=1)
    starts = ends[:-1][ends[:-1] < len(flat)]
    new[starts] = True
    return flat[new], np.append(0, np.cumsum(new))[ends]


def _by_length(flat: np.ndarray, ends: np.ndarray):
    """For rings of each length: their numbers and open vertices (rings, n, 2)."""
    n = np.diff(ends)
    some = n > 0
    closed = np.zeros(len(n), bool)
    closed[some] = (flat[ends[:-1][some], :2] == flat[ends[1:][some] - 1, :2]).all(axis=1) & (n[some] > 1)
    size = n - closed
    for k in np.unique(size):
        which = np.flatnonzero(size == k)
        yield int(k), which, (flat[ends[which][:, None] + np.arange(k)][:, :, :2] if k else None)


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that aren't neighbours."""
    i, j = np.triu_indices(n, 2)
    far = ~((i == 0) & (j == n - 1))
    return i[far], j[far]


def _meets(v: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Of edges i and j of each ring: the cross product of their directions, and where their lines meet on both."""
    p, d = v, np.roll(v, -1, axis=1) - v
    r, s, w = d[:, i], d[:, j], p[:, j] - p[:, i]
    cross = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * s[..., 1] - w[..., 1] * s[..., 0]) / cross
        u = (w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0]) / cross
    return cross, t, u, d


def crossing(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each ring (without repeats) whether it meets itself: 1, 0, or -1 where it is too long for this."""
    out = np.full(len(ends) - 1, -1, np.int8)
    for n, which, v in _by_length(flat, ends):
        if n > LONGEST:
            continue
        out[which] = 0
        if n > 3:
            cross, t, u, _ = _meets(v, *_pairs(n))
            out[which] = ((cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any(axis=1)
    return out


def kinds(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each ring (without repeats) is, its signed area, and for loops the two edges and the place of their crossing."""
    m = len(ends) - 1
    kind, area, edges, at = np.zeros(m, np.int8), np.zeros(m), np.zeros((m, 2), np.int64), np.zeros((m, 2))
    for n, which, v in _by_length(flat, ends):
        if n < 3:
            kind[which] = NOTHING
            continue
        if n > LONGEST:
            continue
        o = v - v[:, :1]
        nxt = np.roll(o, -1, axis=1)
        area[which] = (o[..., 0] * nxt[..., 1] - nxt[..., 0] * o[..., 1]).sum(axis=1) / 2
        d = np.roll(v, -1, axis=1) - v
        size = np.hypot(d[..., 0], d[..., 1])
        e = np.roll(d, -1, axis=1)
        turn = d[..., 0] * e[..., 1] - d[..., 1] * e[..., 0]
        bent = (np.abs(turn) > NEAR * size * np.roll(size, -1, axis=1)).all(axis=1)  # no straight vertex, no spike
        scale = np.abs(v).max(axis=(1, 2))
        fair = bent & (size.min(axis=1) > NEAR * np.maximum(scale, 1.0))
        if n == 3:
            kind[which] = np.where(fair, SIMPLE, UNKNOWN)
            continue
        i, j = _pairs(n)
        cross, t, u, d = _meets(v, i, j)
        slant = np.abs(cross) > NEAR * size[:, i] * size[:, j]
        low, high = np.minimum(v, np.roll(v, -1, axis=1)), np.maximum(v, np.roll(v, -1, axis=1))
        reach = (NEAR * np.maximum(scale, 1.0))[:, None, None]
        boxes = ((low[:, i] - reach <= high[:, j]) & (high[:, i] + reach >= low[:, j])).all(axis=2)
        apart = ~boxes | slant & ((t < -NEAR) | (t > 1 + NEAR) | (u < -NEAR) | (u > 1 + NEAR))
        proper = boxes & slant & (t > NEAR) & (t < 1 - NEAR) & (u > NEAR) & (u < 1 - NEAR)
        simple = fair & apart.all(axis=1)
        once = fair & (proper.sum(axis=1) == 1) & (apart | proper).all(axis=1)
        kind[which] = np.where(simple, SIMPLE, np.where(once, LOOPS, UNKNOWN))
        if n == 4:
            c = np.diff(ends)[which] == 5
            upright = ((d[..., 0] == 0) ^ (d[..., 1] == 0)).all(axis=1) & ((d[:, 0, 0] == 0) != (d[:, 1, 0] == 0))
            kind[which] = np.where(simple & c & upright & (area[which] > 0), RECTANGLE, kind[which])
        rows = np.flatnonzero(once)
        if len(rows):
            k = proper[rows].argmax(axis=1)
            a, b = i[k], j[k]
            x = v[rows, a] + t[rows, k][:, None] * d[rows, a]
            x = np.where(d[rows, b] == 0, v[rows, b], x)  # an upright or level edge gives its own ordinate exactly
            edges[which[rows]], at[which[rows]] = np.stack([a, b], axis=1), x
    return kind, area, edges, at


def made_valid(column: Shapes) -> list[Shape | None]:
    """Polygons of one part whose shell is simple or crosses itself once, with holes apart from it if any; an ellipsis for others."""
    flat, ends = cleaned(column.flat, column.ends)
    kind, area, edges, at = kinds(flat, ends)
    n = len(ends) - 1
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    some = np.flatnonzero(np.diff(ends) > 0)
    if len(some):
        low[some], high[some] = (f.reduceat(flat[:, :2], ends[some], axis=0) for f in (np.minimum, np.maximum))
    out: list = []
    parts, rings = column.parts, column.rings
    for k in range(len(column)):
        if not column.valid[k] or parts[k + 1] - parts[k] != 1:
            out.append(...)
            continue
        r, last = rings[parts[k]], rings[parts[k] + 1]
        if r == last or kind[r] == UNKNOWN:
            out.append(...)
            continue
        if kind[r] == NOTHING:
            out.append(None)
            continue
        if last > r + 1 and not ((high[r + 1 : last] < low[r]) | (low[r + 1 : last] > high[r])).any(axis=1).all():
            out.append(...)
            continue
        own = flat[ends[r] : ends[r + 1]]
        if kind[r] == RECTANGLE and last == r + 1:
            out.append([[own]])
            continue
        v = own[:, :2]
        if v[0, 0] == v[-1, 0] and v[0, 1] == v[-1, 1]:
            v = v[:-1]
        if kind[r] != LOOPS:
            v = v if area[r] > 0 else v[::-1]
            out.append([[np.concatenate([v, v[:1]])]])
            continue
        (i, j), x = edges[r], at[r][None]
        loops = [np.concatenate([x, v[i + 1 : j + 1], x]), np.concatenate([x, v[j + 1 :], v[: i + 1], x])]
        signed = [float((l[:-1, 0] - x[0, 0]) @ (l[1:, 1] - x[0, 1]) - (l[1:, 0] - x[0, 0]) @ (l[:-1, 1] - x[0, 1])) for l in loops]
        if signed[0] * signed[1] >= 0:  # one within the other
            out.append(...)
            continue
        loops = [l if s > 0 else l[::-1] for l, s in zip(loops, signed)]
        out.append([[l] for _, l in sorted(zip((abs(s) for s in signed), loops), key=lambda e: e[0])])
    return out


def hulls(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex hulls of point sets (sets, n, 2), as monotone chains: (sets, n, 2), open and counter-clockwise, and their sizes."""
    m, n, _ = v.shape
    order = np.lexsort((v[..., 1], v[..., 0]), axis=1)
    v = np.take_along_axis(v, order[..., None], axis=1)
    new = np.ones((m, n), bool)
    new[:, 1:] = (v[:, 1:] != v[:, :-1]).any(axis=2)
    rows = np.arange(m)
    out, size = np.zeros((m, 2 * n + 2, 2)), np.zeros(m, np.int64)
    for base, steps in ((0, range(n)), (1, range(n - 1, -1, -1))):
        stack, top = np.zeros((m, n + 1, 2)), np.zeros(m, np.int64)
        for k in steps:
            p, on = v[:, k], new[:, k]
            while True:
                a, b = stack[rows, np.maximum(top - 2, 0)], stack[rows, np.maximum(top - 1, 0)]
                back = on & (top > 1) & ((b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0]) <= 0)
                if not back.any():
                    break
                top -= back
            stack[rows[on], top[on]] = p[on]
            top += on
        for k in range(n):  # all but the last, which begins the other chain
            has = k < top - 1
            out[rows[has], size[has]] = stack[has, k]
            size += has
    return out[:, : max(int(size.max(initial=0)), 1)], size


def rectangles_of(column: Shapes, by_width: bool) -> list[Shape | None]:
    """The smallest rectangles by area or width around shapes of up to ``LONGEST`` vertices, as ``shapes.rotated_rectangle``."""
    out: list = [...] * len(column)
    first, last = column.spans()
    size = np.where(column.valid, last - first, 0)
    for n in np.unique(size):
        if not 3 <= n <= LONGEST:
            continue
        which = np.flatnonzero(size == n)
        h, count = hulls(column.flat[first[which][:, None] + np.arange(n)][:, :, :2])
        fine = count > 2
        which, h, count = which[fine], h[fine], count[fine]
        if not len(which):
            continue
        k = np.arange(h.shape[1])
        h = np.where((k < count[:, None])[..., None], h, h[:, :1])  # the rest repeats the first
        best, found = np.full(len(which), np.inf), np.zeros((len(which), 8))
        for e in range(h.shape[1]):
            a, b = h[:, e], np.where((e + 1 < count)[:, None], h[:, min(e + 1, h.shape[1] - 1)], h[:, 0])
            d = b - a
            norm = np.hypot(d[:, 0], d[:, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                u = d / norm[:, None]
            s, t = h[..., 0] * u[:, :1] + h[..., 1] * u[:, 1:], h[..., 1] * u[:, :1] - h[..., 0] * u[:, 1:]
            s0, s1, t0, t1 = s.min(axis=1), s.max(axis=1), t.min(axis=1), t.max(axis=1)
            w, l = s1 - s0, t1 - t0
            area = np.minimum(w, l) if by_width else w * l
            better = (e < count) & ((best == np.inf) | (area < best - 1e-12 * np.maximum(1.0, np.abs(area))))
            best = np.where(better, area, best)
            found[better] = np.stack([u[:, 0], u[:, 1], -u[:, 1], u[:, 0], s0, s1, t0, t1], axis=1)[better]
        u, v, (s0, s1, t0, t1) = found[:, :2], found[:, 2:4], found[:, 4:, None].transpose(1, 0, 2)
        ring = np.stack([s0 * u + t0 * v, s1 * u + t0 * v, s1 * u + t1 * v, s0 * u + t1 * v, s0 * u + t0 * v], axis=1)
        for row, r in zip(which.tolist(), ring):
            out[row] = [[r]]
    return out
