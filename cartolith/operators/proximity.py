"""Buffers, rings of buffers, Thiessen polygons."""

from __future__ import annotations

import math
from collections.abc import Iterable
from enum import StrEnum

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, GeometryTypeError
from ..functions import geometry as g
from ..functions.kernels import arrangement as ar
from ..functions.kernels import geodesic as geo
from ..functions.kernels import shapes as sh
from ..model import MULTIPOLYGON, POLYGON, FeatureFrame
from ..settings import Settings, current, tolerance
from ..units import Distance, length_factor, meters_of, parse
from .common import coerce, fields, in_extent, kernel, option, resolve, spread, with_orig_fid
from .generalization import united
from .projections import is_geographic


class Side(StrEnum):
    FULL = "full"
    LEFT = "left"
    RIGHT = "right"
    ONLY_OUTSIDE = "only_outside"


class Cap(StrEnum):
    ROUND = "round"
    FLAT = "flat"
    SQUARE = "square"


class Dissolve(StrEnum):
    NONE = "none"
    LIST = "list"
    ALL = "all"


class BufferType(StrEnum):
    PLANAR = "planar"
    GEODESIC = "geodesic"


def clamp(resolution: int) -> int:
    """Segments of a quarter circle: 8 to 256."""
    return max(8, min(256, int(resolution)))


def _distance(source: FeatureFrame, distance, kind: BufferType) -> tuple[Column, BufferType, bool]:
    """The distance of each row, the buffer type it makes, and whether it is angular."""
    geographic = is_geographic(source.meta.crs)
    if isinstance(distance, str) and (name := resolve(distance, source.df.columns)):
        numeric = source.df.schema[name].dataType.typeName() != "string"
        if numeric:
            return source.df[name].cast("double"), kind, False
        # column strings with units: metres, so geodesic on geographic systems
        return meters_of(source.df[name]), BufferType.GEODESIC if geographic else kind, False
    found = parse(distance)
    if not isinstance(found, Distance):
        return F.lit(float(found)), kind, geographic and kind == BufferType.GEODESIC
    if found.angular:
        return F.lit(found.value), kind if geographic else BufferType.GEODESIC, True
    return F.lit(found.meters), BufferType.GEODESIC if geographic else kind, False


def _side_for(source: FeatureFrame, side: Side, cap: Cap) -> tuple[Side, Cap]:
    """Combinations that make no sense fall back to full and round."""
    dim = source.meta.dimension
    if dim == 0 or side in (Side.LEFT, Side.RIGHT) and dim != 1 or side == Side.ONLY_OUTSIDE and dim != 2:
        side = Side.FULL
    return side, cap if dim < 2 else Cap.ROUND


def _kernel(dim: int, side: Side, cap: Cap, quadrant: int, geodesic: bool, angular: bool, tol: float | None):
    def planar(shape, d):
        return sh.buffer(shape, d, dim, quadrant, str(side), str(cap), tol) if shape and d is not None else None

    def around(shape, d):
        if not shape or d is None:
            return None
        v = sh.all_points(shape)
        lon, lat = np.round(v.mean(axis=0), -1)  # a centre in steps of ten degrees
        if angular:
            d = d * geo.meters_per_degree(*v.mean(axis=0))
        forward, backward = geo.azimuthal(float(lon), float(max(-90.0, min(90.0, lat))))
        flat = [[forward(r) for r in p] for p in shape]
        found = planar(flat, d)
        return [[backward(r) for r in p] for p in found] if found else None

    return around if geodesic else planar


def buffer(
    source: FeatureFrame, distance, buffer_type="planar", dissolve_option="none", group_fields: str | Iterable[str] = (), side_option="full", end_option="round",
    resolution: int = 32, xy_tolerance: float | None = None, settings: Settings | None = None,
) -> FeatureFrame:
    """Everything within a distance: per feature, per group, or in one. Rows with no valid distance are left out."""
    kind, how = option(BufferType, buffer_type), option(Dissolve, dissolve_option)
    side, cap = _side_for(source, option(Side, side_option), option(Cap, end_option))
    source = in_extent(source, settings)
    d, kind, angular = _distance(source, distance, kind)
    geom, dim, quadrant, tol = source.meta.geom, source.meta.dimension, clamp(resolution), tolerance(xy_tolerance, settings)
    rows = source.df.drop("bbox").withColumn("__d", d).where(F.col("__d").isNotNull() & ~F.isnan("__d") & ~g.is_empty(F.col(geom)))
    if dim == 0 and not source.meta.multi and kind == BufferType.PLANAR and cap == Cap.ROUND:
        rows = spread(rows, source.meta.pk)  # points are small, what they become isn't
        v = g.first_vertex(F.col(geom))  # a point's buffer needs no kernel
        rows = rows.where("__d > 0").withColumn(geom, g.disk(v["x"], v["y"], F.col("__d"), quadrant)).drop("__d")
    else:
        rows = kernel(rows, "__b", _kernel(dim, side, cap, quadrant, kind == BufferType.GEODESIC, angular, tol), [geom, "__d"], drop=("__d",))
        rows = rows.where(~g.is_empty(F.col("__b"))).withColumn(geom, F.col("__b")).drop("__b")
    pk = source.meta.pk
    if how == Dissolve.NONE:
        df, fid = with_orig_fid(rows, pk)
        return source.with_df(df, shape_type=MULTIPOLYGON, pk=fid, rectangles=False)
    keys = fields(rows, group_fields) if how == Dissolve.LIST else []
    df = united(rows, keys, geom, F.col(pk), 2, tol)
    return source.with_df(df.where(~g.is_empty(F.col(geom))), shape_type=MULTIPOLYGON, rectangles=False)


def ring_distances(distances: Iterable[float], polygons: bool, overlapping: bool, only_outside: bool) -> list[float]:
    """The distances in the order that they are used in."""
    found = sorted({float(d) for d in distances})
    if not found:
        raise ArgumentError("no distances")
    if not polygons:
        return [d for d in found if d > 0]
    if only_outside:
        return [*[d for d in found if d < 0][::-1], *[d for d in found if d > 0]] if overlapping else [d for d in found if d]
    return sorted({0.0, *found}) if found[0] < 0 else found


def multiple_buffer(
    source: FeatureFrame, distance_unit: str, distances: Iterable[float], buffer_type="planar", overlapping: bool = False, only_outside: bool = False,
    field_name: str = "distance", resolution: int = 32, xy_tolerance: float | None = None, settings: Settings | None = None,
) -> FeatureFrame:
    """Buffers at several distances: of every feature, or of all together as rings that don't overlap."""
    polygons = source.meta.dimension == 2
    used = ring_distances(distances, polygons, overlapping, only_outside)
    factor = 1.0 if source.meta.crs is None else length_factor(distance_unit)
    label = lambda d: None if d == 0 and overlapping and polygons and 0 not in {float(x) for x in distances} else f"{d:g} {distance_unit}"
    side = "only_outside" if only_outside and polygons else "full"
    geom, tol = source.meta.geom, tolerance(xy_tolerance, settings)
    if overlapping:
        layers = [buffer(source, d * factor, buffer_type, "none", (), side, "round", resolution, xy_tolerance, settings) for d in sorted(used, reverse=True)]
        frames = [b.df.withColumn(field_name, F.lit(label(d)).cast("string")) for b, d in zip(layers, sorted(used, reverse=True))]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return layers[0].with_df(out)
    one = [buffer(source, d * factor, buffer_type, "all", (), side, "round", resolution, xy_tolerance, settings).df.select(F.lit(k).alias("__k"), F.col(geom).alias("__g")) for k, d in enumerate(used)]
    rows = one[0]
    for f in one[1:]:
        rows = rows.unionByName(f)
    whole = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct("__k", "__g"))).alias("s")).where(F.size("s") > 0)  # one row a distance
    steps = [(k, d, *_inner(used, k, only_outside and polygons)) for k, d in enumerate(used)]
    plan = source.df.sparkSession.createDataFrame([(k, label(d), inner) for k, d, inner in steps], "__k int, label string, inner array<int>")
    joined = whole.crossJoin(F.broadcast(plan)).select(
        "label", "__k", F.get(F.transform(F.filter("s", lambda x: x["__k"] == F.col("__k")), lambda x: x["__g"]), F.lit(0)).alias("__o"), F.transform(F.filter("s", lambda x: F.array_contains("inner", x["__k"])), lambda x: x["__g"]).alias("__i")
    )
    df = kernel(joined.where("__o is not null"), geom, lambda o, i: ar.difference(o, ar.union(i, tol), tol) if i else o, ["__o", "__i"], lists=("__i",), drop=("__o", "__i"))
    df = df.where(~g.is_empty(F.col(geom))).select(F.col("__k").cast("long").alias(source.meta.pk), geom, F.col("label").alias(field_name))
    return source.with_df(df, shape_type=MULTIPOLYGON, rectangles=False)


def _inner(used: list[float], k: int, outside: bool) -> tuple[list[int]]:
    """The rings to take out of ring ``k``: the next smaller one, or, outside only, all nearer on its side."""
    if not outside:
        return ([k - 1] if k else [],)
    d = used[k]
    return ([j for j, e in enumerate(used) if (e > 0) == (d > 0) and abs(e) < abs(d)],)


def create_thiessen_polygons(source: FeatureFrame, include_attributes: bool = False, xy_tolerance: float | None = None, settings: Settings | None = None) -> FeatureFrame:
    """The cell of places nearest to each point, within the extent or the points' own bounds widened by 5 %.

    Points are cut to tiles of some thousands, by quantiles; a tile's cells are made from its points and those of a halo
    around it, and a cell is final when no point beyond the halo can cut it. The few that aren't are made again with a
    halo four times as wide, until all are.
    """
    if source.meta.dimension != 0:
        raise GeometryTypeError("points are needed")
    s = settings or current()
    geom, pk = source.meta.geom, source.meta.pk
    points = source.df.select(F.col(pk).alias("id"), F.explode(g.vertices(source.geom)).alias("v")).select("id", "v.x", "v.y")
    points = points.where("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("id"))  # cells of equal points go to the first
    ends = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    empty = source.with_df(source.df.limit(0), shape_type=POLYGON)
    if not ends[4]:
        return empty
    if s.extent:
        from .projections import bounds_in

        window = bounds_in(s.extent, source.meta.crs)
    else:
        w, h = ends[2] - ends[0], ends[3] - ends[1]
        pad_x, pad_y = (0.05 * w or 1.0), (0.05 * h or 1.0)
        window = (ends[0] - pad_x, ends[1] - pad_y, ends[2] + pad_x, ends[3] + pad_y)
    cells = _cells(points, window, ends[4])
    shaped = cells.select(F.col("id").alias("__id"), F.col("cell").alias("__cell"))
    if source.meta.multi:
        shaped = shaped.groupBy("__id").agg(F.flatten(F.collect_list("__cell")).alias("__cell"))
        shape = MULTIPOLYGON
    else:
        shape = POLYGON
    keep = source.df.select(pk, *(source.attributes if include_attributes else []))
    df = keep.join(shaped, keep[pk] == shaped["__id"]).select(pk, F.col("__cell").alias(geom), *(source.attributes if include_attributes else []))
    df, fid = with_orig_fid(df, pk)
    return source.with_df(coerce(df, geom, shape), shape_type=shape, pk=fid, rectangles=False)


#: Points of a tile, about: the bounds of all tiles are part of the plan.
TILE_POINTS = 2000


def _bounds(points: DataFrame, count: int) -> tuple[list[float], list[list[float]]]:
    """Bounds between strips in x of about equal numbers of points, and between the tiles in y of each strip."""
    strips = max(1, round((count / TILE_POINTS) ** 0.5))
    cuts = [k / strips for k in range(1, strips)]
    if not cuts:
        return [], [[]]
    xs = sorted(set(points.agg(F.percentile_approx("x", cuts, 100 * strips)).first()[0]))
    in_strip = points.select(_place(F.col("x"), F.lit(xs)).alias("i"), "y").groupBy("i").agg(F.percentile_approx("y", cuts, 100 * strips).alias("ys"))
    ys = {r.i: sorted(set(r.ys)) for r in in_strip.collect()}  # a row a strip
    return xs, [ys.get(i, []) for i in range(len(xs) + 1)]


def _place(v: Column, bounds: Column) -> Column:
    """How many of the bounds (in order) are at most ``v``."""
    return F.aggregate(bounds, F.lit(0), lambda n, b: n + (b <= v).cast("int"))


def _cells(points: DataFrame, window: tuple[float, float, float, float], count: int) -> DataFrame:
    """Tiles have about as many points each, however dense: a cell is final when all points that could cut it are known."""
    points = points.persist()
    xs, ys = _bounds(points, count)
    edges_x = [-math.inf, *xs, math.inf]
    tiles = [(i, j, edges_x[i], lo, edges_x[i + 1], hi) for i, own in enumerate(ys) for j, (lo, hi) in enumerate(zip([-math.inf, *own], [*own, math.inf]))]
    spark = points.sparkSession
    bounds = spark.createDataFrame([(i, own) for i, own in enumerate(ys)], "i int, ys array<double>")
    placed = points.withColumn("i", _place(F.col("x"), F.lit(xs).cast("array<double>"))).join(F.broadcast(bounds), "i").select("id", "x", "y", "i", _place(F.col("y"), F.col("ys")).alias("j"))
    # a first halo of a fourth of the tile, in each direction
    x0, y0, x1, y1 = window
    clipped = lambda lo, hi, a, b: max((min(hi, b) - max(lo, a)) / 4, (b - a) * 1e-9)
    todo = spark.createDataFrame([(i, j, a, b, c, d, clipped(a, c, x0, x1), clipped(b, d, y0, y1)) for i, j, a, b, c, d in tiles], "i int, j int, ax double, ay double, bx double, by double, hx double, hy double")
    own, done = placed.persist(), None
    while True:
        seen = todo.select("i", "j", (F.col("ax") - F.col("hx")).alias("kx0"), (F.col("ay") - F.col("hy")).alias("ky0"), (F.col("bx") + F.col("hx")).alias("kx1"), (F.col("by") + F.col("hy")).alias("ky1"))
        # the strips that a halo reaches; of those the points in its range of y
        strip = F.sequence(_place(F.col("kx0"), F.lit(xs).cast("array<double>")), _place(F.col("kx1"), F.lit(xs).cast("array<double>")))
        reach = seen.select("*", F.explode(strip).alias("pi"))
        others = placed.select(F.col("id"), "x", "y", F.col("i").alias("pi"), F.col("j").alias("pj"))
        within = (others["x"] >= reach["kx0"]) & (others["x"] <= reach["kx1"]) & (others["y"] >= reach["ky0"]) & (others["y"] <= reach["ky1"])
        if done is None:  # later, only some of a tile's points are its sites
            within = within & ~((others["pi"] == reach["i"]) & (others["pj"] == reach["j"]))
        halo = others.join(F.broadcast(reach), (others["pi"] == reach["pi"]) & within).select("id", "x", "y", "i", "j", F.lit(False).alias("own"))
        both = own.select("id", "x", "y", "i", "j", F.lit(True).alias("own")).unionByName(halo)
        known = seen.select("i", "j", "kx0", "ky0", "kx1", "ky1")
        both = spread(both.join(F.broadcast(known), ["i", "j"]), "i", "j")
        made = both.groupBy("i", "j").applyInArrow(_tile_kernel(window), f"id long, x double, y double, i int, j int, fine boolean, cell {g.GEOMETRY}").persist()
        fine = made.where("fine").select("id", "cell")
        done = fine if done is None else done.unionByName(fine)
        own = made.where("not fine").select("id", "x", "y", "i", "j")
        left = [(r.i, r.j) for r in own.select("i", "j").distinct().collect()]  # some of the tiles
        if not left:
            return done
        again = spark.createDataFrame(left, "i int, j int")
        todo = todo.join(F.broadcast(again), ["i", "j"], "left_semi").withColumn("hx", F.col("hx") * 4).withColumn("hy", F.col("hy") * 4)


def _tile_kernel(window):
    def kernel_(table):
        import pyarrow as pa

        from ..functions.kernels.bridge import column_of

        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        xy = np.stack([table.column("x").to_numpy(), table.column("y").to_numpy()], axis=1)
        n = int(own.sum())
        ids, sites = table.column("id").to_numpy()[own], xy[own]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        # up to here every point is known; beyond the window there may be points, too
        known = [table.column(k)[0].as_py() for k in ("kx0", "ky0", "kx1", "ky1")]
        order = np.concatenate([np.flatnonzero(own), np.flatnonzero(~own)])
        cells, fine = [], []
        for s, ring in zip(sites, sh.voronoi_cells(xy[order], n, window)):
            reach = 2 * float(np.hypot(*(ring - s).T).max()) if len(ring) else 0.0
            fine.append(bool(s[0] - reach >= known[0] and s[1] - reach >= known[1] and s[0] + reach <= known[2] and s[1] + reach <= known[3]))
            cells.append([[sh.closed(ring)]] if len(ring) > 2 else None)
        return pa.table({"id": pa.array(ids, pa.int64()), "x": pa.array(sites[:, 0]), "y": pa.array(sites[:, 1]), "i": pa.array([i] * n, pa.int32()), "j": pa.array([j] * n, pa.int32()), "fine": pa.array(fine, pa.bool_()), "cell": column_of(cells)})

    return kernel_
