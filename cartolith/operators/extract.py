"""Selection, copies, clip and the two splits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.kernels import arrangement as ar
from ..model import FeatureFrame, Layer, df_of, like
from ..names import unique_names, valid_name
from ..plans import point_join, spatial_join
from ..settings import Settings, tolerance
from .common import check_dimensions, coerce, fields, in_extent, kernel, same_crs, spread, where
from .generalization import gathered


def table_select(source: Layer, where_clause: str = "") -> Layer:
    """Rows that meet a predicate, of a table or of a layer's rows; no extent."""
    return like(source, where(df_of(source), where_clause))


extract_rows = copy_rows = table_select


def select(source: FeatureFrame, where_clause: str = "", settings: Settings | None = None) -> FeatureFrame:
    """Features that meet a predicate and the extent, without empty geometries."""
    found = in_extent(source, settings)
    return found.with_df(where(found.df, where_clause).where(~g.is_empty(F.col(source.meta.geom))))


extract_features = copy_features = select


def copy(source: Layer, where_clause: str = "") -> Layer:
    """Table or layer as it is, whatever the settings."""
    return like(source, where(df_of(source), where_clause))


def delete_rows(source: Layer, where_clause: str = "") -> Layer:
    """What a deletion leaves: rows for which the predicate isn't true; a blank one deletes all."""
    df = df_of(source)
    if not where_clause or not where_clause.strip():
        return like(source, df.limit(0))
    where(df, where_clause)
    return like(source, df.where(~F.coalesce(F.expr(where_clause), F.lit(False))))


delete_features = delete_rows


def truncate_table(source: Layer) -> Layer:
    return like(source, df_of(source).limit(0))


def get_count(source: Layer) -> int:
    return df_of(source).count()


def _sides(source: FeatureFrame, operator: FeatureFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    left = source.df.select(F.struct(*[source.df[c] for c in source.df.columns]).alias("row"), source.fid.alias("id"), source.geom.alias("geom"), source.box.alias("box"))
    right = operator.df.select(*[operator.df[c] for c in extra], operator.fid.alias("id"), operator.geom.alias("geom"), operator.box.alias("box"))
    return left, right


def _clipped(source: FeatureFrame, operator: FeatureFrame, xy_tolerance: float | None, by: str | None = None) -> DataFrame:
    """Source rows (and ``by``) with their geometry cut to the operators that they meet."""
    geom, dim = source.meta.geom, source.meta.dimension
    if dim == 0:
        return _clipped_points(source, operator, by)
    left, right = _sides(source, operator, *([by] if by else []))
    if not (source.meta.rectangles and operator.meta.rectangles):
        left = spread(left, "id")
    pairs, over = spatial_join.join(left, right), operator.meta.dimension
    named = ["__by"] if by else []
    ids = [F.col("l.id").alias("__id"), F.col("r.id").alias("__op"), *([F.col(f"r.{by}").alias("__by")] if by else [])]
    keys, few = ["__id", *named], spatial_join.is_few(right)
    source_rows = left.select(F.col("id").alias("__sid"), "row", F.col("geom").alias("__src"))
    back = lambda d: d.join(source_rows, F.col("__id").eqNullSafe(F.col("__sid")))
    if source.meta.rectangles and operator.meta.rectangles and not xy_tolerance:
        pieces = pairs.select(*ids, g.rectangle_intersection(F.col("l.box"), F.col("r.box")).alias("__p")).where("__p is not null")
        met = gathered(pieces, keys, "__p", "__op", few, None)
        # one piece needs no union
        single = met.where(F.size("__ops") == 1).select(*keys, F.get("__ops", F.lit(0)).alias("__g"))
        many = kernel(met.where(F.size("__ops") > 1), "__g", lambda ops: ar.union(ops), ["__ops"], lists=("__ops",), drop=("__ops",))
        return back(single.unionByName(many.select(*keys, "__g"))).select("row.*", "__g", *named)
    met = gathered(pairs.select(*ids, F.col("r.geom").alias("__o")), keys, "__o", "__op", few, xy_tolerance, over)
    if dim == 2:
        cut = lambda s, ops: ar.intersection(s, ar.union(ops, xy_tolerance), xy_tolerance)
    elif over == 2:
        cut = lambda s, ops: ar.clip_line(s, ar.union(ops, xy_tolerance))
    else:
        cut = lambda s, ops: ar.clip_line(s, ar.joined(ops), lines=True)
    return kernel(back(met).select("row", "__src", "__ops", *named), "__g", cut, ["__src", "__ops"], lists=("__ops",), drop=("__src", "__ops")).select("row.*", "__g", *named)


def _clipped_points(source: FeatureFrame, operator: FeatureFrame, by: str | None) -> DataFrame:
    """Points that lie at an operator, equal ones and their order kept: once for all operators, or for each ``by``."""
    named = {"__by": operator.df[by]} if by else {}
    points = point_join.exploded(source, F.struct(*[source.df[c] for c in source.df.columns if c not in (source.meta.geom, "bbox")]))
    found = point_join.touched(points, operator, named, list(named))
    kept = point_join.at(points, found, "inner" if by else "left_semi")
    one = point_join.regrouped(kept, *named) if source.meta.multi else kept.select("row", F.array("p").alias("__g"), *named)
    return one.select("row.*", "__g", *named)


def clip(source: FeatureFrame, operator: FeatureFrame, xy_tolerance: float | None = None, settings: Settings | None = None) -> FeatureFrame:
    """Source features cut to the union of all operator features; attributes of the source alone."""
    check_dimensions(source, operator)
    source, operator = in_extent(source, settings), same_crs(operator, source)
    geom = source.meta.geom
    df = _clipped(source, operator, tolerance(xy_tolerance, settings))
    df = df.select(*[F.col("__g").alias(geom) if c == geom else F.col(c) for c in source.df.columns if c != "bbox"])
    return source.with_df(coerce(df, geom, source.meta.shape_type), rectangles=False)


def split(source: FeatureFrame, operator: FeatureFrame, field: str, xy_tolerance: float | None = None, settings: Settings | None = None) -> FeatureFrame:
    """Clip by the operators of each value of a text field, in one plan: column ``split_value`` names the output.

    ``outputs`` gives the single layers.
    """
    check_dimensions(source, operator)
    source, operator = in_extent(source, settings), same_crs(operator, source)
    (by,) = fields(operator.df, field)
    geom = source.meta.geom
    df = _clipped(source, operator, tolerance(xy_tolerance, settings), by)
    df = df.select(*[F.col("__g").alias(geom) if c == geom else F.col(c) for c in source.df.columns if c != "bbox"], F.col("__by").alias("split_value"))
    return source.with_df(coerce(df, geom, source.meta.shape_type), rectangles=False)


def split_by_attributes(source: Layer, group_fields: str | Iterable[str], settings: Settings | None = None) -> Layer:
    """Each row with ``split_id``, the dense rank of its group (nulls are a group, and first).

    The groups are ranked on their distinct values, not on the rows; ``outputs`` gives the single layers.
    """
    layer = in_extent(source, settings) if isinstance(source, FeatureFrame) else source
    df = df_of(layer)
    keys = fields(df, group_fields)
    groups = df.select(*keys).distinct()
    ranked = groups.withColumn("split_id", F.dense_rank().over(Window.orderBy(*[F.asc_nulls_first(k) for k in keys])))
    right = ranked.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("split_id").cast("int").alias("split_id"))
    same = [df[k].eqNullSafe(right[f"__{k}"]) for k in keys]
    return like(layer, df.join(right, same).drop(*[f"__{k}" for k in keys]))


def outputs(layer: Layer, column: str, prefix: str = "split") -> dict[str, Layer]:
    """Single layers of a split, by valid and unique name. The number of distinct values is the caller's choice."""
    df = df_of(layer)
    values = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    names = unique_names(valid_name(f"{prefix}_{v}", prefix) for v in values)
    return {n: like(layer, df.where(F.col(column).eqNullSafe(F.lit(v))).drop(column)) for n, v in zip(names, values)}

