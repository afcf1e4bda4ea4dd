"""Dissolve: groups with united geometries and statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import stats
from ..functions.kernels import arrangement as ar
from ..model import MULTI, FeatureFrame, Layer, df_of, pk_of
from ..settings import Settings, tolerance
from .common import coerce, fields, in_extent, kernel, spread

#: Members that one task unites at once; a larger group is united in levels.
FAN_IN = 256


def summarize(source: Layer, group_fields: str | Iterable[str], statistics: Iterable = ()) -> DataFrame:
    """One row per group with its statistics: plain grouping, so nulls are a group.

    Modes are taken from counts of distinct values, so that no group is collected for them.
    """
    df, pk = df_of(source), pk_of(source)
    keys = fields(df, group_fields)
    given = [s if isinstance(s, stats.Statistic) else stats.Statistic(*s) for s in statistics]
    unique = {s.output.casefold(): s for s in reversed(given)}
    ordered = [s for s in given if unique[s.output.casefold()] is s]
    plain = [s for s in ordered if stats._kind(s.kind) != "mode"]
    out = df.groupBy(*keys).agg(*[s.over(df, pk) for s in plain]) if plain else df.select(*keys).distinct()
    for s in (s for s in ordered if stats._kind(s.kind) == "mode"):
        (name,) = fields(df, s.field)
        counted = df.where(F.col(name).isNotNull()).groupBy(*keys, F.col(name).alias("__v")).agg(F.count("*").alias("__n"), F.min(pk).alias("__first"))
        best = counted.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by("__v", F.struct("__n", -F.col("__first"))).alias(s.output))
        same = [out[k].eqNullSafe(best[f"__{k}"]) for k in keys]
        out = (out.join(best, same, "left") if keys else out.crossJoin(best)).drop(*[f"__{k}" for k in keys])
    return out.select(*keys, *[s.output for s in ordered])


def united(df: DataFrame, keys: list[str], geom: str, id_: Column, dimension: int, xy_tolerance: float | None) -> DataFrame:
    """``keys`` and the union of ``geom`` of each group, in levels of at most ``FAN_IN`` members by place.

    A level unites neighbours (by a coarse Z-order of their boxes), so groups of any size go through bounded tasks
    as long as their united outlines do.
    """
    unite = _unite(dimension, xy_tolerance)
    now = df.select(*keys, F.col(geom).alias("__g"), id_.cast("long").alias("__o"))
    now = now.groupBy(*keys, "__g").agg(F.min("__o").alias("__o")).persist()  # one of equal geometries will do
    same = lambda a, b: [a[k].eqNullSafe(b[f"__{k}"]) for k in keys]
    most = now.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while most > FAN_IN:
        b, cell, blocks = g.bbox(F.col("__g")), _cell(now), -(-most // FAN_IN)
        now = now.withColumn("__b", F.pmod(F.xxhash64(F.floor(b["xmin"] / cell), F.floor(b["ymin"] / cell)), F.lit(blocks)))
        # blocks that a crowded place makes too large are divided further
        many = now.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__mb")).agg(F.ceil(F.count("*") / FAN_IN).alias("__n")).where("__n > 1")
        now = now.join(many, [*same(now, many), now["__b"] == many["__mb"]], "left").drop("__mb", *[f"__{k}" for k in keys])
        now = now.withColumn("__c", F.coalesce(F.pmod(F.xxhash64("__o", b["xmin"], b["ymin"], b["xmax"]), F.col("__n")), F.lit(0)))
        now = spread(now, *keys, "__b", "__c").groupBy(*keys, "__b", "__c").agg(F.collect_list("__g").alias("__gs"), F.min("__o").alias("__o"))
        now = kernel(now, "__g", unite, ["__gs"], lists=("__gs",), drop=("__gs", "__b", "__c")).persist()
        fewer = now.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if fewer >= most:
            break
        most = fewer
    one = spread(now, *keys).groupBy(*keys) if keys else now.groupBy()
    one = one.agg(F.array_sort(F.collect_list(F.struct("__o", "__g"))).alias("__s")).withColumn("__gs", F.transform("__s", lambda s: s["__g"])).drop("__s")
    return kernel(one, geom, unite, ["__gs"], lists=("__gs",), drop=("__gs",))


def gathered(pairs: DataFrame, keys: list[str], geom: str, order: str, few: bool, xy_tolerance: float | None, dimension: int = 2) -> DataFrame:
    """``keys`` and ``__ops``, the operators (of one dimension) that each of them meets.

    With few operators in all they are listed as they are. Otherwise any feature may meet a great many, and what it meets
    is united in levels first, so that no task takes more than ``FAN_IN`` of them.
    """
    if few:
        return spread(pairs, *keys).groupBy(*keys).agg(F.collect_list(geom).alias("__ops"))
    return united(pairs, keys, geom, F.col(order), dimension, xy_tolerance).select(*keys, F.array(geom).alias("__ops"))


def _cell(df: DataFrame) -> float:
    b = g.bbox(F.col("__g"))
    r = df.select(F.avg(b["xmax"] - b["xmin"]).alias("w"), F.avg(b["ymax"] - b["ymin"]).alias("h")).first()
    return 8 * max(r.w or 0, r.h or 0) or 1.0


def _unite(dimension: int, xy_tolerance: float | None):
    import numpy as np

    if dimension == 0:

        def points(given):
            seen = {tuple(r[0, :2].tolist()): r for s in given for p in s for r in p}
            return [[r] for r in seen.values()]

        return points
    if dimension == 1:

        def lines(given):
            segments = [ar._segments(s) for s in given]
            segments = [s for s in segments if len(s)]
            if not segments:
                return []
            e = ar.run_together(np.vstack(segments))
            grid = ar._grid(e, xy_tolerance)
            return ar.merged(ar.node(e, grid), grid)

        return lines
    return lambda given: ar.union(given, xy_tolerance)


def dissolve(source: FeatureFrame, group_fields: str | Iterable[str], statistics: Iterable = (), as_multi_part: bool = True, xy_tolerance: float | None = None, settings: Settings | None = None) -> FeatureFrame:
    """One feature per group (or one for each part of it), with statistics of its members."""
    source = in_extent(source, settings)
    keys = fields(source.df, group_fields)
    geom, dim = source.meta.geom, source.meta.dimension
    rows = source.df.where(~g.is_empty(source.geom))
    shapes = united(rows, keys, geom, source.fid, dim, tolerance(xy_tolerance, settings))
    if statistics:
        found = summarize(source, keys, statistics)
        right = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c not in keys])
        same = [shapes[k].eqNullSafe(right[f"__{k}"]) for k in keys]
        shapes = (shapes.join(right, same) if keys else shapes.crossJoin(right)).drop(*[f"__{k}" for k in keys])
    multi = source.meta.shape_type if source.meta.multi else MULTI[source.meta.shape_type]
    shape = multi if as_multi_part else {v: k for k, v in MULTI.items()}[multi]
    return source.with_df(coerce(shapes, geom, shape), shape_type=shape, rectangles=False)

