"""What the tools share: predicates, extents, output coercion, column algebra."""

from __future__ import annotations

from collections.abc import Iterable
from enum import StrEnum

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, DimensionError, FieldError, GeometryTypeError, OperationsError
from ..functions import geometry as g
from ..functions.kernels import bridge
from ..model import DIMENSION, SINGLE, FeatureFrame, Layer, df_of
from ..names import resolve, unique_name, unique_names
from ..settings import Settings, current


class AttributeOption(StrEnum):
    ALL = "all"
    SANS_FID = "sans_fid"
    ONLY_FID = "only_fid"


class OutputType(StrEnum):
    SAME = "same"
    LINE = "line"
    POINT = "point"


class Algorithm(StrEnum):
    PAIRWISE = "pairwise"
    CLASSIC = "classic"


def option(kind: type[StrEnum], value) -> StrEnum:
    """An enum member by value or name, whatever the case."""
    try:
        return value if isinstance(value, kind) else kind(str(value).casefold())
    except ValueError:
        raise ArgumentError(f"{value!r} is none of {', '.join(kind)}") from None


def where(df: DataFrame, clause: str | Column | None) -> DataFrame:
    """Rows that meet a predicate; a blank one keeps all."""
    if clause is None or isinstance(clause, str) and not clause.strip():
        return df
    try:
        found = df.where(clause)
        found.schema  # noqa: B018 - analysed now
        return found
    except (AnalysisException, ParseException) as e:
        raise OperationsError(f"bad where clause {clause!r}: {e}") from e


def fields(df: DataFrame, names: str | Iterable[str]) -> list[str]:
    """Columns by name whatever the case; commas and semicolons part a string."""
    if isinstance(names, str):
        names = [n for n in names.replace(";", ",").split(",") if n.strip()]
    out = []
    for n in names:
        found = resolve(n.strip(), df.columns)
        if found is None:
            raise FieldError(f"no field {n!r}")
        if found not in out:
            out.append(found)
    return out


def in_extent(layer: FeatureFrame, settings: Settings | None = None) -> FeatureFrame:
    """Features whose boxes meet that of the extent, as scalar comparisons that reach the Parquet statistics of ``bbox``."""
    from .projections import bounds_in

    extent = (settings or current()).extent
    if not extent:
        return layer
    x0, y0, x1, y1 = bounds_in(extent, layer.meta.crs)
    b = layer.box
    return layer.with_df(layer.df.where((b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0)))


def coerce(df: DataFrame, geom: str, shape_type: str) -> DataFrame:
    """What a target of ``shape_type`` takes: nothing empty, and single parts for a single type."""
    df = df.where(~g.is_empty(F.col(geom)))
    if shape_type in SINGLE:
        return df
    parts = F.explode(g.singleparts(F.col(geom))).alias(geom)
    many = df.select(*[parts if c == geom else F.col(c) for c in df.columns])
    return many


def attribute_names(source: FeatureFrame, operator: FeatureFrame, how: AttributeOption) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(column, output name) of both sides: clashes get numbers before any join, whatever their case."""
    left = [] if how == AttributeOption.SANS_FID else [(source.meta.pk, f"{source.meta.pk}_{source.meta.name}")]
    right = [] if how == AttributeOption.SANS_FID else [(operator.meta.pk, f"{operator.meta.pk}_{operator.meta.name}")]
    if how != AttributeOption.ONLY_FID:
        left += [(c, c) for c in source.attributes]
        right += [(c, c) for c in operator.attributes]
    names = unique_names([n for _, n in left + right], taken=[source.meta.geom])
    return [(c, n) for (c, _), n in zip(left, names)], [(c, n) for (c, _), n in zip(right, names[len(left) :])]


def check_dimensions(source: FeatureFrame, operator: FeatureFrame, same: bool = False) -> None:
    a, b = source.meta.dimension, operator.meta.dimension
    if b < a or same and a != b:
        raise DimensionError(f"{operator.meta.shape_type} doesn't fit {source.meta.shape_type}")


def polygons_only(layer: FeatureFrame) -> None:
    if DIMENSION[layer.meta.shape_type] != 2:
        raise GeometryTypeError(f"polygons are needed, not {layer.meta.shape_type}")


def same_crs(operator: FeatureFrame, source: FeatureFrame) -> FeatureFrame:
    """``operator`` in the source's coordinate system."""
    from .projections import project

    if operator.meta.crs and source.meta.crs and operator.meta.crs != source.meta.crs:
        return project(operator, source.meta.crs)
    return operator


def with_orig_fid(df: DataFrame, pk: str, name: str = "ORIG_FID") -> tuple[DataFrame, str]:
    """An existing ORIG_FID moves on to ORIG_FID_1 ..., and the id becomes ORIG_FID."""
    old = resolve(name, df.columns)
    if old:
        df = df.withColumnRenamed(old, unique_name(name, df.columns))
    return df.withColumnRenamed(pk, name), name


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Partitioned by keys in as many tasks as a shuffle has: the grouping that follows reuses it, and kernels that
    work long on little data aren't put together in few tasks by size.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kernel(df: DataFrame, out: str, fn, inputs: list[str], lists: tuple[str, ...] = (), drop: tuple[str, ...] = (), many=None) -> DataFrame:
    return bridge.transform_rows(df, out, fn, inputs, lists, drop, many)


def kind(layer: Layer) -> str:
    return "features" if isinstance(layer, FeatureFrame) else "table"


__all__ = [n for n in dir() if not n.startswith("_")]
