"""Feature geometry tools."""

from __future__ import annotations

import math
from collections.abc import Iterable
from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..errors import ArgumentError, CoordinateSystemError, FieldError, GeometryTypeError
from ..functions import geometry as g
from ..functions.kernels import arrangement as ar
from ..functions.kernels import geodesic as geo
from ..functions.kernels import rings as rg
from ..functions.kernels import shapes as sh
from ..model import LINE, MULTIPOLYGON, POINT, POLYGON, SINGLE, FeatureFrame, FeatureMeta, Layer, df_of
from ..names import unique_name
from ..settings import Settings
from ..units import area_factor, length_factor
from .common import fields, in_extent, kernel, option, resolve, spread, with_orig_fid
from .projections import is_geographic, normal


class PointType(StrEnum):
    ALL = "all"
    MID = "mid"
    START = "start"
    END = "end"
    BOTH_ENDS = "both_ends"


class LineType(StrEnum):
    PLANAR = "planar"
    GEODESIC = "geodesic"


class Bounding(StrEnum):
    RECTANGLE_BY_AREA = "rectangle_by_area"
    RECTANGLE_BY_WIDTH = "rectangle_by_width"
    CONVEX_HULL = "convex_hull"
    CIRCLE = "circle"
    ENVELOPE = "envelope"


class Group(StrEnum):
    NONE = "none"
    LIST = "list"
    ALL = "all"


def _exploded(source: FeatureFrame, shapes: Column, shape_type: str, position: str | None = None, **changes) -> FeatureFrame:
    """A row for each geometry of an array, with ORIG_FID and perhaps its number from 1."""
    geom = source.meta.geom
    df, fid = with_orig_fid(source.df.drop("bbox").withColumn("__shapes", shapes), source.meta.pk)
    rest = [c for c in df.columns if c not in (geom, "__shapes")]
    if position:
        name = unique_name(position, rest)
        df = df.select(*rest, F.posexplode("__shapes").alias("__i", "__g")).select(*rest, (F.col("__i") + 1).cast("int").alias(name), F.col("__g").alias(geom))
    else:
        df = df.select(*rest, F.explode("__shapes").alias(geom))
    return source.with_df(df.where(~g.is_empty(F.col(geom))), shape_type=shape_type, pk=fid, rectangles=False, **changes)


def multipart_to_singlepart(source: FeatureFrame, settings: Settings | None = None) -> FeatureFrame:
    """A row for each part."""
    if not source.meta.multi:
        raise GeometryTypeError("a multipart layer is needed")
    source = in_extent(source, settings)
    return _exploded(source, g.singleparts(source.geom), SINGLE[source.meta.shape_type])


explode = multipart_to_singlepart


def add_xy_coordinates(source: FeatureFrame, weight_option: str = "two_d", settings: Settings | None = None) -> FeatureFrame:
    """POINT_X and POINT_Y (and POINT_Z, POINT_M) of the centroid, in place of any such fields."""
    df = source.df
    for name in ("POINT_X", "POINT_Y", "POINT_Z", "POINT_M"):
        if old := resolve(name, df.columns):
            df = df.drop(old)
    c = g.centroid(F.col(source.meta.geom), source.meta.dimension)
    df = df.withColumn("__c", c)
    df = df.withColumn("POINT_X", F.col("__c.x")).withColumn("POINT_Y", F.col("__c.y")).drop("__c")
    if source.meta.has_z:
        df = df.withColumn("POINT_Z", _mean(source, "z"))
    if source.meta.has_m:
        df = df.withColumn("POINT_M", _mean(source, "m"))
    return source.with_df(df)


def _mean(source: FeatureFrame, name: str) -> Column:
    """Mean of Z or M over the vertices, weighted by the lengths around them for lines and rings."""
    geom = F.col(source.meta.geom)
    if source.meta.dimension == 0:
        v = g.ordinates(geom, name)
        return g.total(v) / F.nullif(F.size(v), F.lit(0))
    terms = F.flatten(F.transform(g.rings(geom), lambda r: g.steps(r, lambda a, b: F.struct(F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("w"), ((a[name] + b[name]) / 2).alias("v")))))
    kept = F.filter(terms, lambda t: t["v"].isNotNull() & ~F.isnan(t["v"]))
    return g.let(kept, lambda k: g.total(F.transform(k, lambda t: t["w"] * t["v"])) / F.nullif(g.total(F.transform(k, lambda t: t["w"])), F.lit(0.0)))


NATIVE_ATTRIBUTES = (
    "point_x point_y point_z point_m centroid_x centroid_y centroid_z centroid_m extent_min_x extent_min_y extent_min_z extent_min_m extent_max_x extent_max_y extent_max_z extent_max_m "
    "part_count point_count hole_count length perimeter area line_start_x line_start_y line_start_z line_start_m line_end_x line_end_y line_end_z line_end_m"
).split()
KERNEL_ATTRIBUTES = "inside_x inside_y length_geodesic perimeter_geodesic area_geodesic line_azimuth".split()
ATTRIBUTES = [*NATIVE_ATTRIBUTES, *KERNEL_ATTRIBUTES]


def valid_attributes(meta: FeatureMeta) -> list[str]:
    """The attributes that a layer's geometries have, Z and M ones only where it has those."""
    axes = ["x", "y", *(["z"] if meta.has_z else []), *(["m"] if meta.has_m else [])]
    each = lambda kind: [f"{kind}_{a}" for a in axes]
    if meta.dimension == 0:
        return [*each("centroid"), "part_count", "point_count", *each("extent_min"), *each("extent_max")] if meta.multi else each("point")
    common = [*each("centroid"), "part_count", "point_count", *each("extent_min"), *each("extent_max"), "inside_x", "inside_y"]
    if meta.dimension == 1:
        return [*common, "length", "length_geodesic", "line_azimuth", *each("line_start"), *each("line_end")]
    return [*common, "hole_count", "area", "area_geodesic", "perimeter", "perimeter_geodesic"]


def attribute(source: FeatureFrame, name: str) -> Column:
    """A geometry attribute that Catalyst can express, in the layer's own units."""
    geom, dim = F.col(source.meta.geom), source.meta.dimension
    kind, _, axis = name.rpartition("_")
    if kind in ("point", "centroid") and axis in "xy" and len(axis) == 1:
        return g.centroid(geom, dim)[axis]
    if kind in ("point", "centroid") and axis in ("z", "m"):
        return _mean(source, axis)
    if kind == "extent_min":
        return g.low(geom, axis)
    if kind == "extent_max":
        return g.high(geom, axis)
    if kind == "line_start":
        return g.first_vertex(geom)[axis]
    if kind == "line_end":
        return g.last_vertex(geom)[axis]
    return {"part_count": g.part_count, "point_count": g.point_count, "hole_count": g.hole_count, "length": g.length, "perimeter": g.length, "area": g.area}[name](geom)


def calculate_geometry_attributes(source: FeatureFrame, field: str, geometry_attribute: str, weight_option: str = "two_d", length_unit: str = "meters", area_unit: str = "square meters", settings: Settings | None = None) -> FeatureFrame:
    """Write an attribute of each geometry to an existing numeric field."""
    name = str(geometry_attribute).casefold()
    if name not in ATTRIBUTES:
        raise ArgumentError(f"unknown geometry attribute {geometry_attribute!r}")
    if name not in valid_attributes(source.meta):
        raise ArgumentError(f"{source.meta.shape_type} layers have no {name}")
    (target,) = fields(source.df, field)
    kind = source.df.schema[target].dataType
    if not isinstance(kind, NumericType):
        raise FieldError(f"{target} isn't numeric")
    geographic = is_geographic(source.meta.crs)
    if geographic and name in ("length", "perimeter", "area"):
        name += "_geodesic"
    if name in KERNEL_ATTRIBUTES:
        fn = _KERNELS[name]
        df = kernel(source.df, "__v", lambda s: [[_scalar(fn(s))]] if s else None, [source.meta.geom])
        value = g.first_vertex(F.col("__v"))["x"]
    else:
        df, value = source.df.withColumn("__v", F.lit(None)), attribute(source, name)
    if name.startswith(("length", "perimeter")) and source.meta.crs:
        value = value / length_factor(length_unit)
    if name.startswith("area") and source.meta.crs:
        value = value / area_factor(area_unit)
    return source.with_df(df.withColumn(target, value.cast(kind)).drop("__v"))


def _scalar(v: float | None):
    import numpy as np

    return np.array([[math.nan if v is None else v, 0.0]])


_KERNELS = {
    "inside_x": lambda s: (p := ar.point_inside(s)) is not None and float(p[0]) or 0.0,
    "inside_y": lambda s: (p := ar.point_inside(s)) is not None and float(p[1]) or 0.0,
    "length_geodesic": geo.length,
    "perimeter_geodesic": geo.length,
    "area_geodesic": geo.area,
    "line_azimuth": lambda s: geo.inverse(*s[0][0][0, :2], *s[-1][-1][-1, :2])[1],
}


def xy_table_to_point(source: Layer, coordinate_system: str | None, x_field: str, y_field: str, z_field: str | None = None, m_field: str | None = None, pk: str = "fid", geom: str = "geom", name: str = "points", settings: Settings | None = None) -> FeatureFrame:
    """Points from numeric columns, all columns kept; rows without finite x and y go; the extent is exact."""
    df = df_of(source)
    x, y = (F.col(fields(df, f)[0]).cast("double") for f in (x_field, y_field))
    z, m = (F.col(fields(df, f)[0]).cast("double") if f else None for f in (z_field, m_field))
    df = df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).withColumn(geom, g.point(x, y, z, m))
    crs = normal(coordinate_system) if coordinate_system else None
    out = FeatureFrame(df, FeatureMeta(POINT, bool(z_field), bool(m_field), crs, pk, geom, name))
    return in_extent(out, settings)  # of a point, its box is the point itself


def xy_to_line(source: Layer, coordinate_system: str | None, start_x_field: str, start_y_field: str, end_x_field: str, end_y_field: str, line_type="geodesic", point_count: int = 9, pk: str = "fid", geom: str = "geom", name: str = "lines") -> FeatureFrame:
    """A line for each row, with ``point_count`` (0 to 1000) vertices in between: straight, or along the geodesic."""
    df, kind = df_of(source), option(LineType, line_type)
    x0, y0, x1, y1 = (F.col(fields(df, f)[0]).cast("double") for f in (start_x_field, start_y_field, end_x_field, end_y_field))
    n = max(0, min(1000, int(point_count)))
    crs = normal(coordinate_system) if coordinate_system else None
    good = [c.isNotNull() & ~F.isnan(c) for c in (x0, y0, x1, y1)]
    df = df.where(good[0] & good[1] & good[2] & good[3])
    if kind == LineType.PLANAR or n == 0:
        at = lambda a, b, i: F.when(i == 0, a).when(i == n + 1, b).otherwise(a + (b - a) * i / (n + 1))
        df = df.withColumn(geom, g.line(F.transform(F.sequence(F.lit(0), F.lit(n + 1)), lambda i: g.vertex(at(x0, x1, i), at(y0, y1, i)))))
    else:
        if crs is None or not is_geographic(crs):
            raise CoordinateSystemError("geodesic lines need a geographic coordinate system")
        df = df.select("*", x0.alias("__x0"), y0.alias("__y0"), x1.alias("__x1"), y1.alias("__y1"))
        df = kernel(df, geom, lambda a, b, c, d: [[geo.path(a, b, c, d, n)]], ["__x0", "__y0", "__x1", "__y1"], drop=("__x0", "__y0", "__x1", "__y1"))
    return FeatureFrame(df, FeatureMeta(LINE, False, False, crs, pk, geom, name))


xy_table_to_line = xy_to_line


def feature_envelope_to_polygon(source: FeatureFrame, as_multi_part: bool = False, settings: Settings | None = None) -> FeatureFrame:
    """The bounding rectangle of each feature, or of each of its parts."""
    if source.meta.dimension == 0 and not source.meta.multi:
        raise GeometryTypeError("points have no envelopes")
    source = in_extent(source, settings)
    geom = source.geom
    shape = F.flatten(F.transform(g.singleparts(geom), g.envelope)) if as_multi_part else g.envelope(geom)
    df, fid = with_orig_fid(source.df.drop("bbox").withColumn(source.meta.geom, shape), source.meta.pk)
    return source.with_df(df, shape_type=MULTIPOLYGON if as_multi_part else POLYGON, pk=fid, rectangles=not as_multi_part)


def minimum_bounding_geometry(source: FeatureFrame, geometry_type="rectangle_by_area", add_geometric_attributes: bool = False, group_option="none", group_fields: str | Iterable[str] = (), settings: Settings | None = None) -> FeatureFrame:
    """A bounding shape of each feature, each group, or all; perhaps with width, length and orientation.

    Groups are bounded by envelopes in plain aggregates, other shapes from the hulls of hash parts of a group, so that
    no task takes all vertices of a large group.
    """
    kind, how = option(Bounding, geometry_type), option(Group, group_option)
    source = in_extent(source, settings)
    geom, pk = source.meta.geom, source.meta.pk
    rows = source.df.drop("bbox").where(~g.is_empty(F.col(geom)))
    keys = fields(rows, group_fields) if how == Group.LIST else []
    shape = POLYGON
    if kind == Bounding.ENVELOPE:
        b = g.bbox(F.col(geom))
        if how == Group.NONE:
            df, fid = with_orig_fid(rows.withColumn("__b", b), pk)
        else:
            b = rows.select(*keys, b.alias("b")).groupBy(*keys).agg(F.struct(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax")).alias("__b"))
            df, fid = b.where("__b.xmin is not null"), pk
        w, h = F.col("__b.xmax") - F.col("__b.xmin"), F.col("__b.ymax") - F.col("__b.ymin")
        df = df.withColumn(geom, g.box(F.col("__b.xmin"), F.col("__b.ymin"), F.col("__b.xmax"), F.col("__b.ymax")))
        if add_geometric_attributes:
            df = df.withColumn("MBG_WIDTH", F.least(w, h)).withColumn("MBG_LENGTH", F.greatest(w, h)).withColumn("MBG_ORIENTATION", F.when(w > h, 90.0).otherwise(0.0))
        return source.with_df(df.drop("__b"), shape_type=shape, pk=fid, rectangles=True)
    if how == Group.NONE:
        df, fid = with_orig_fid(spread(rows, pk), pk)
        df = df.withColumnRenamed(geom, "__g")
    else:
        part = F.pmod(F.xxhash64(F.col(pk)), F.lit(64)).alias("__p")
        hulls = kernel(rows.groupBy(*keys, part).agg(F.collect_list(geom).alias("__gs")), "__h", _hull_of, ["__gs"], lists=("__gs",), drop=("__gs",))
        df = kernel(hulls.groupBy(*keys).agg(F.collect_list("__h").alias("__hs")), "__g", _hull_of, ["__hs"], lists=("__hs",), drop=("__hs",))
        fid = pk
    name = str(kind)
    many = (lambda column: rg.rectangles_of(column, kind == Bounding.RECTANGLE_BY_WIDTH)) if name.startswith("rectangle") else None
    df = kernel(df, geom, lambda s: sh.bounding(s, name)[0] if s else None, ["__g"], many=many)
    if add_geometric_attributes:
        import numpy as np

        def measures(s):
            _, w, l, o = sh.bounding(s, name) if s else (None,) * 4
            return [[np.array([[math.nan if v is None else v for v in (w, l)] + [math.nan, math.nan], [math.nan if o is None else o, 0.0, math.nan, math.nan]])]]

        df = kernel(df, "__m", measures, ["__g"])
        v = F.get(F.get(F.col("__m"), F.lit(0)), F.lit(0))
        df = df.withColumn("MBG_WIDTH", F.get(v, F.lit(0))["x"]).withColumn("MBG_LENGTH", F.get(v, F.lit(0))["y"]).withColumn("MBG_ORIENTATION", F.get(v, F.lit(1))["x"]).drop("__m")
    df = df.drop("__g").where(~g.is_empty(F.col(geom)))
    return source.with_df(df, shape_type=shape, pk=fid, rectangles=False)


def _hull_of(given):
    """Vertices of the hull, as the one ring of a shape."""
    import numpy as np

    pts = [sh.all_points(s) for s in given]
    pts = [p for p in pts if len(p)]
    return [[sh.hull(np.vstack(pts))]] if pts else None


def feature_to_point(source: FeatureFrame, inside: bool = False, weight_option: str = "two_d", settings: Settings | None = None) -> FeatureFrame:
    """The centroid of each feature, or a point on its surface."""
    source = in_extent(source, settings)
    geom = source.meta.geom
    df, fid = with_orig_fid(source.df.drop("bbox"), source.meta.pk)
    if inside and source.meta.dimension == 2:
        df = kernel(df.withColumnRenamed(geom, "__g"), geom, lambda s: [[p[None]]] if s and (p := ar.point_inside(s)) is not None else None, ["__g"], drop=("__g",))
    elif inside:
        v = g.middle(F.get(F.get(F.col(geom), F.lit(0)), F.lit(0))) if source.meta.dimension == 1 else g.first_vertex(F.col(geom))
        df = df.withColumn(geom, g.point(v["x"], v["y"]))
    else:
        df = df.withColumn("__c", g.centroid(F.col(geom), source.meta.dimension))
        df = df.withColumn(geom, g.point(F.col("__c.x"), F.col("__c.y"))).drop("__c")
    return source.with_df(df.where(~g.is_empty(F.col(geom))), shape_type=POINT, pk=fid, has_z=False, has_m=False, rectangles=False)


def feature_vertices_to_points(source: FeatureFrame, point_type="all", settings: Settings | None = None) -> FeatureFrame:
    """Vertices, middles or ends of every line or ring."""
    kind = option(PointType, point_type)
    source = in_extent(source, settings)
    rings = F.filter(g.rings(source.geom), lambda r: F.size(r) > 0)
    as_point = lambda v: F.array(F.array(F.array(v)))
    if kind == PointType.ALL:
        shapes = F.transform(F.flatten(rings), as_point)
    elif kind == PointType.MID:
        shapes = F.transform(rings, lambda r: as_point(g.middle(r)))
    elif kind == PointType.BOTH_ENDS:
        shapes = F.flatten(F.transform(rings, lambda r: F.array(as_point(F.get(r, F.lit(0))), as_point(F.element_at(r, -1)))))
    else:
        shapes = F.transform(rings, lambda r: as_point(F.get(r, F.lit(0)) if kind == PointType.START else F.element_at(r, -1)))
    return _exploded(source, shapes, POINT)


def split_line_at_vertices(source: FeatureFrame, settings: Settings | None = None) -> FeatureFrame:
    """A row for each segment, numbered from 1 within its feature in ORIG_SEQ."""
    if source.meta.dimension == 0:
        raise GeometryTypeError("lines or polygons are needed")
    source = in_extent(source, settings)
    return _exploded(source, g.segments(source.geom), LINE, position="ORIG_SEQ")


def polygon_to_line(source: FeatureFrame, settings: Settings | None = None) -> FeatureFrame:
    """A line for each ring."""
    if source.meta.dimension != 2:
        raise GeometryTypeError("polygons are needed")
    source = in_extent(source, settings)
    return _exploded(source, g.ring_lines(source.geom), LINE)
