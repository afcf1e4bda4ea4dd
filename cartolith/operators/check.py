"""Checks and repairs of geometry. Checks are Catalyst expressions but for topology."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions import geometry as g
from ..functions.kernels import arrangement as ar
from ..functions.kernels import rings
from ..model import FeatureFrame
from ..settings import Extent
from .common import kernel, spread

CHECKS = "extent empty empty_part empty_ring empty_point nan_z nan_m repeated_xy repeated_m mismatch_z mismatch_m point_count orientation unclosed self_intersection outside_ring overlap_ring".split()
DEFAULT = tuple(c for c in CHECKS if c not in ("nan_z", "nan_m", "repeated_m", "mismatch_z", "mismatch_m"))
GRID = 1e-8


def _wanted(options: Iterable[str] | None) -> list[str]:
    found = [str(o).casefold() for o in (options or DEFAULT)]
    if bad := [o for o in found if o not in CHECKS]:
        raise ArgumentError(f"unknown checks: {', '.join(bad)}")
    return found


def _same(a: Column, b: Column, grid: float) -> Column:
    near = lambda k: (F.abs(a[k] - b[k]) <= 2 * grid) | F.isnan(a[k] - b[k])  # noqa: E731 - rounding is slow: only for what may be equal
    return F.when(near("x") & near("y"), (F.round(a["x"] / grid) == F.round(b["x"] / grid)) & (F.round(a["y"] / grid) == F.round(b["y"] / grid))).otherwise(False)


def _reasons(layer: FeatureFrame, wanted: list[str], grid: float) -> Column:
    geom, dim, multi = F.col(layer.meta.geom), layer.meta.dimension, layer.meta.multi
    of = g.rings(geom)
    lost = lambda v: v["x"].isNull() | F.isnan(v["x"]) | v["y"].isNull() | F.isnan(v["y"])
    any_step = lambda test: F.exists(of, lambda r: F.exists(g.steps(r, test), lambda x: x))
    tests: dict[str, Column] = {
        "empty_part": F.exists(geom, lambda p: (F.size(p) == 0) | (F.size(F.flatten(p)) == 0)) if multi and dim else F.lit(False),
        "empty_ring": F.exists(of, lambda r: F.size(r) == 0) if dim == 2 else F.lit(False),
        "empty_point": F.exists(g.vertices(geom), lost) if dim else F.lit(False),
        "nan_z": F.exists(g.vertices(geom), lambda v: F.isnan(v["z"])) if layer.meta.has_z else F.lit(False),
        "nan_m": F.exists(g.vertices(geom), lambda v: F.isnan(v["m"])) if layer.meta.has_m else F.lit(False),
        "repeated_xy": any_step(lambda a, b: _same(a, b, grid)) if dim else F.lit(False),
        "repeated_m": any_step(lambda a, b: F.round(a["m"] / grid) == F.round(b["m"] / grid)) if dim and layer.meta.has_m else F.lit(False),
        "mismatch_z": _mismatch(geom, "z", grid) if layer.meta.has_z else F.lit(False),
        "mismatch_m": _mismatch(geom, "m", grid) if layer.meta.has_m else F.lit(False),
        "point_count": F.exists(of, lambda r: F.size(F.array_distinct(F.transform(r, lambda v: F.struct(v["x"], v["y"])))) < (2 if dim == 1 else 3)) if dim else F.lit(False),
        "orientation": F.exists(geom, lambda p: F.exists(F.transform(p, lambda r, i: F.when(i == 0, g.ring_area(r) < 0).otherwise(g.ring_area(r) > 0)), lambda x: x)) if dim == 2 else F.lit(False),
        "unclosed": F.exists(of, lambda r: (F.size(r) > 0) & ((F.get(r, F.lit(0))["x"] != F.element_at(r, -1)["x"]) | (F.get(r, F.lit(0))["y"] != F.element_at(r, -1)["y"]))) if dim == 2 else F.lit(False),
    }
    found = F.filter(F.array(*[F.when(tests[c], F.lit(c.upper())) for c in wanted if c in tests]), lambda x: x.isNotNull())
    if "empty" in wanted:  # an empty geometry has no other faults
        return F.when(g.is_empty(geom), F.array(F.lit("EMPTY"))).otherwise(found)
    return F.when(g.is_empty(geom), F.array().cast("array<string>")).otherwise(found)


def _mismatch(geom: Column, name: str, grid: float) -> Column:
    """Whether two vertices at one place have different values."""
    at = F.transform(g.vertices(geom), lambda v: F.struct(F.round(v["x"] / grid).alias("x"), F.round(v["y"] / grid).alias("y"), F.round(v[name] / grid).alias("v")))
    places = F.transform(at, lambda a: F.struct(a["x"], a["y"]))
    return F.size(F.array_distinct(at)) > F.size(F.array_distinct(places))


_TOPOLOGY = ("self_intersection", "outside_ring", "overlap_ring")


def _topology(wanted: tuple[str, ...]):
    def faults(shape):
        """Numbers of the faults, as the x of the vertices of one ring."""
        found = []
        if not shape:
            return None
        for part in shape:
            own = [ar.close(r) for r in part if len(r) >= 3]
            if not own:
                continue
            if 0 not in found and any(_crosses(r) for r in own):
                found.append(0)
            if len(own) > 1:
                found += [k for k in _of_holes(own) if k not in found]
        found = [k for k in found if _TOPOLOGY[k] in wanted]
        return [[np.array([[float(k), 0.0] for k in found])]] if found else None

    return faults


def _of_holes(rings_: list[np.ndarray]) -> list[int]:
    """Faults of a shell's holes: outside it, or over each other."""
    found, (shell, *holes) = [], rings_
    edges, low, high = ar.edges_of([[shell]]), shell[:, :2].min(axis=0), shell[:, :2].max(axis=0)
    slack = 1e-9 * max(1.0, float(np.abs(shell[:, :2]).max()))
    for h in holes:
        v = h[:-1, :2]
        far = ((v < low - slack) | (v > high + slack)).any()
        if 1 not in found and (far or (~ar.inside(v, edges) & ~np.array([ar.on_boundary(p, edges) for p in v])).any()):
            found.append(1)
    for i, a in enumerate(holes):
        for b in holes[i + 1 :]:
            if 2 not in found and ar.area(ar.intersection([[a]], [[b]])) > 0:
                found.append(2)
    return found


def _topology_of(wanted: tuple[str, ...]):
    """``_topology`` of a batch: crossings of all rings at once."""

    def faults(column):
        flat, ends = rings.cleaned(column.flat, column.ends)
        long, parts, of = np.diff(column.ends) >= 3, column.parts, column.rings
        marks = rings.crossing(flat, ends)
        lost = np.append(0, np.cumsum(np.isnan(column.flat[:, :2]).any(axis=1)))[column.ends]
        marks[lost[1:] > lost[:-1]] = -1
        found: list = []
        for k in range(len(column)):
            if not column.valid[k]:
                found.append(None)
                continue
            a, b = of[parts[k]], of[parts[k + 1]]
            own = marks[a:b][long[a:b]]
            if (own < 0).any():
                found.append(...)
                continue
            faults_ = [0] if (own > 0).any() else []
            if (np.diff(of[parts[k] : parts[k + 1] + 1]) > 1).any():
                for part in column[k]:
                    closed = [ar.close(r) for r in part if len(r) >= 3]
                    faults_ += [f for f in (_of_holes(closed) if len(closed) > 1 else ()) if f not in faults_]
            faults_ = [f for f in faults_ if _TOPOLOGY[f] in wanted]
            found.append([[np.array([[float(f), 0.0] for f in faults_])]] if faults_ else None)
        return found

    return faults


def _crosses(ring: np.ndarray) -> bool:
    """Whether a closed ring meets itself other than at successive vertices."""
    e = np.hstack([ring[:-1, :2], ring[1:, :2]])
    e = e[(e[:, :2] != e[:, 2:]).any(axis=1)]
    n = len(e)
    for i in range(n):
        later = np.arange(i + 2, n if i else n - 1)
        if not len(later):
            continue
        d, s = e[i, 2:] - e[i, :2], e[later, 2:] - e[later, :2]
        w = e[later, :2] - e[i, :2]
        cross = d[0] * s[:, 1] - d[1] * s[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / cross, (w[:, 0] * d[1] - w[:, 1] * d[0]) / cross
        if ((cross != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any():
            return True
    return False


def check_geometry(source: FeatureFrame, check_options: Iterable[str] | None = None, xy_tolerance: float | None = None, declared_extent: Extent | None = None) -> DataFrame:
    """ORIG_FID and REASON of every fault; EXTENT has id -1."""
    wanted, grid = _wanted(check_options), xy_tolerance or GRID
    geom = source.meta.geom
    source = source.with_df(spread(source.df.select(source.meta.pk, geom), source.meta.pk))
    fid = source.fid.cast("long").alias("ORIG_FID")
    # an inner explode would be given a filter on its size, which makes the reasons a second time
    out = source.df.select(fid, F.explode_outer(_reasons(source, wanted, grid)).alias("REASON")).where("REASON is not null")
    topology = tuple(c for c in _TOPOLOGY if c in wanted)
    if source.meta.dimension == 2 and topology:
        rows = kernel(source.df.select(fid, F.col(geom).alias("__g")), "__f", _topology(topology), ["__g"], drop=("__g",), many=_topology_of(topology))
        names = F.array(*[F.lit(c.upper()) for c in _TOPOLOGY])
        out = out.unionByName(rows.where("__f is not null").select("ORIG_FID", F.explode(F.transform(g.vertices(F.col("__f")), lambda v: F.get(names, v["x"].cast("int")))).alias("REASON")))
    if "extent" in wanted and declared_extent is not None:
        b = source.df.select(g.bbox(F.col(geom)).alias("b")).agg(F.min("b.xmin").alias("x0"), F.min("b.ymin").alias("y0"), F.max("b.xmax").alias("x1"), F.max("b.ymax").alias("y1"))
        e = declared_extent
        off = lambda c, v: ~(F.abs(F.col(c) - v) <= 1.2e-7 * F.abs(F.lit(float(v))))
        out = out.unionByName(b.where(off("x0", e.xmin) | off("y0", e.ymin) | off("x1", e.xmax) | off("y1", e.ymax)).select(F.lit(-1).cast("long").alias("ORIG_FID"), F.lit("EXTENT").alias("REASON")))
    return out


def repair_geometry(source: FeatureFrame, drop_empty: bool = False) -> FeatureFrame:
    """Geometries set right: repeated vertices, empty and unclosed rings, orientation, crossings, holes outside."""
    geom, dim = source.meta.geom, source.meta.dimension

    def mend(shape):
        if not shape:
            return None
        shape = [[_once(r[~np.isnan(r[:, :2]).any(axis=1)]) for r in p] for p in shape]
        if dim == 2:
            return ar.make_valid([p for p in shape if p and len(p[0]) >= 3]) or None
        least = 2 if dim == 1 else 1
        kept = [[r for r in p if len(r) >= least] for p in shape]
        return [p for p in kept if p] or None

    df = kernel(spread(source.df, source.meta.pk).drop("bbox").withColumnRenamed(geom, "__g"), geom, mend, ["__g"], drop=("__g",), many=rings.made_valid if dim == 2 else None).select(*[c for c in source.df.columns if c != "bbox"])
    return source.with_df(df.where(~g.is_empty(F.col(geom))) if drop_empty else df, rectangles=False)


def _once(ring: np.ndarray) -> np.ndarray:
    return ring[np.append(True, (np.diff(ring[:, :2], axis=0) != 0).any(axis=1))] if len(ring) else ring


def recalculate_extent(source: FeatureFrame) -> Extent | None:
    """The bounds of all features."""
    r = source.df.select(source.box.alias("b")).agg(F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first()
    return None if r[0] is None else Extent(*r, source.meta.crs)


recalculate_feature_class_extent = recalculate_extent
