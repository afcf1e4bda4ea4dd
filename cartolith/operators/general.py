"""Identical features, and the catalogue: copies, renames, deletions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..model import FeatureFrame, Layer, df_of, like, pk_of
from ..settings import Settings, tolerance
from .common import fields, in_extent


def _normal(geom: Column, dimension: int, grid: float | None) -> Column:
    """A key that is equal for equal 2D geometries, however their rings begin and turn and their parts are ordered."""
    at = lambda v: F.struct(F.round(v["x"] / grid).alias("x"), F.round(v["y"] / grid).alias("y")) if grid else F.struct(v["x"].alias("x"), v["y"].alias("y"))
    if dimension == 0:
        return F.array_sort(F.transform(g.vertices(geom), at)).cast("string")

    def ring(r: Column) -> Column:
        points = F.transform(r, at)
        if dimension == 1:
            return F.least(points.cast("string"), F.reverse(points).cast("string"))

        def turned(p: Column) -> Column:
            n = F.size(p)
            start = F.array_position(p, F.array_min(p)).cast("int")
            return F.concat(F.slice(p, start, n - start + 1), F.slice(p, F.lit(1), start - 1))

        open_ = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
        both = lambda p: F.when(F.size(p) == 0, F.lit("")).otherwise(F.least(turned(p).cast("string"), turned(F.reverse(p)).cast("string")))
        return g.let(open_, both)

    return F.array_sort(F.transform(geom, lambda p: F.concat_ws("|", F.transform(p, ring)))).cast("string")


def find_identical(
    source: Layer, fields_: str | Iterable[str] = (), include_geometry: bool = False, xy_tolerance: float | None = None, z_tolerance: float | None = None, m_tolerance: float | None = None, settings: Settings | None = None,
) -> DataFrame:
    """ORIG_FID and REPEAT_FID: the first of each group of equal rows (nulls are equal) and every other one.

    Without tolerance, groups are plain aggregation: the smallest id per key, joined back, so that a large group is
    never collected. With a tolerance, clusters are made greedily by id.
    """
    layer = in_extent(source, settings) if isinstance(source, FeatureFrame) else source
    df, pk = df_of(layer), pk_of(layer)
    keys = [F.col(f) for f in fields(df, fields_)] if fields_ else []
    if not include_geometry or not isinstance(layer, FeatureFrame):
        return _repeats(df, pk, keys)
    tol, dim, geom = tolerance(xy_tolerance, settings), layer.meta.dimension, F.col(layer.meta.geom)
    df = df.where(~g.is_empty(geom))
    if not tol and not z_tolerance and not m_tolerance:
        return _repeats(df, pk, [*keys, _normal(geom, dim, None)])
    return _clusters(df, pk, keys, layer, tol or 0.0, z_tolerance, m_tolerance)


def _repeats(df: DataFrame, pk: str, keys: list[Column]) -> DataFrame:
    keyed = df.select(F.col(pk).cast("long").alias("id"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key") if keys else F.lit(0).alias("key"))
    first = keyed.groupBy("key").agg(F.min("id").alias("ORIG_FID"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("key1"), "ORIG_FID")
    return keyed.join(first, keyed["key"].eqNullSafe(first["key1"])).where("id <> ORIG_FID").select("ORIG_FID", F.col("id").alias("REPEAT_FID"))


def _clusters(df: DataFrame, pk: str, keys: list[Column], layer: FeatureFrame, tol: float, z_tol: float | None, m_tol: float | None) -> DataFrame:
    """Greedy by id: a row that no earlier head takes heads a group, and each other goes to the first head that it equals.

    Rows of one geometry share their fate, so only the first of each is compared; and of those that lie in one cell as
    wide as the tolerances, only the first is a candidate (see ``_heads``). So work goes by rows, not by pairs.
    """
    geom = F.col(layer.meta.geom)
    used = [("x", tol), ("y", tol), *([("z", z_tol)] if z_tol is not None and layer.meta.has_z else []), *([("m", m_tol)] if m_tol is not None and layer.meta.has_m else [])]
    vs = F.transform(g.vertices(geom), lambda v: F.struct(*[v[k].alias(k) for k, _ in used]))
    rows = df.select(F.col(pk).cast("long").alias("id"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key") if keys else F.lit(0).alias("key"), vs.alias("g"))
    # no number is within any tolerance of these
    lost = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("g", lambda v: ~F.exists(F.array(*[v[k] for k, _ in used]), lost)))
    in_cell = F.transform("g", lambda v: F.struct(*[(F.floor(v[k] / t) if t else v[k]).alias(k) for k, t in used]))
    size = 2 * max(tol, 1e-9)
    at = F.get("g", F.lit(0))
    firsts = rows.groupBy("key", "g").agg(F.min("id").alias("id")).select("id", "key", "g", F.size("g").alias("n"), F.xxhash64("key", in_cell).alias("q"), F.floor(at["x"] / size).alias("cx"), F.floor(at["y"] / size).alias("cy"))

    def near(some: DataFrame, all_: DataFrame) -> DataFrame:
        """``a`` of some and ``b`` of all rows that are equal, each row with itself left out."""
        around = F.explode(F.array(*[F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        left = some.select(F.col("id").alias("a"), F.col("key").alias("ka"), F.col("n").alias("na"), F.col("g").alias("ga"), around.alias("c")).select("a", "ka", "na", "ga", F.col("c.x").alias("ax"), F.col("c.y").alias("ay"))
        right = all_.select(F.col("id").alias("b"), "key", "n", "g", "cx", "cy")
        equal = F.forall(F.zip_with("ga", "g", lambda v, w: F.forall(F.array(*[F.abs(v[k] - w[k]) <= t for k, t in used]), lambda x: x)), lambda x: x)
        met = (F.col("ax") == F.col("cx")) & (F.col("ay") == F.col("cy")) & F.col("na").eqNullSafe(F.col("n")) & F.col("ka").eqNullSafe(F.col("key")) & (F.col("a") != F.col("b"))
        return left.join(right, met & F.when(met, equal)).select("a", "b")

    keep = (lambda d: d.checkpoint()) if df_has_folder(df) else (lambda d: d.persist())
    firsts = keep(firsts)
    taken = near(_heads(firsts, near, keep), firsts).where("a < b").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("head"))
    fate = firsts.join(taken, "id", "left").select(F.col("key").alias("k1"), F.col("g").alias("g1"), F.coalesce("head", "id").alias("ORIG_FID"))
    return rows.join(fate, rows["key"].eqNullSafe(fate["k1"]) & (rows["g"] == fate["g1"])).where("id <> ORIG_FID").select("ORIG_FID", F.col("id").alias("REPEAT_FID"))


def _heads(rows: DataFrame, near, keep) -> DataFrame:
    """Rows that no earlier head equals, in rounds.

    The first undecided row of a cell is a candidate, and a head if no undecided row that precedes it is equal to it;
    others of its cell wait, as they (nearly always) equal it. What equals a head is decided. Each round is written
    down (or held, without a folder for checkpoints) as the next one reads it several times.
    """
    left, found = rows, None
    while not left.isEmpty():
        first = left.groupBy("q").agg(F.min_by(F.struct("id", "key", "n", "g", "cx", "cy"), "id").alias("s")).select("s.*")
        met = keep(near(first, left))
        heads = keep(first.join(met.where("b < a").select(F.col("a").alias("id")).distinct(), "id", "left_anti"))
        found = heads if found is None else found.union(heads)
        gone = heads.select("id").union(met.join(heads.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")))
        left = keep(left.join(gone, "id", "left_anti"))
    return rows.limit(0) if found is None else found


def df_has_folder(df: DataFrame) -> bool:
    """Whether the cluster names a folder for checkpoints."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder and not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return bool(sc.getCheckpointDir())


def delete_identical(source: Layer, fields_: str | Iterable[str] = (), include_geometry: bool = False, xy_tolerance: float | None = None, z_tolerance: float | None = None, m_tolerance: float | None = None, settings: Settings | None = None) -> Layer:
    """The layer without its repeats."""
    gone = find_identical(source, fields_, include_geometry, xy_tolerance, z_tolerance, m_tolerance, settings)
    df, pk = df_of(source), pk_of(source)
    return like(source, df.join(gone.select(F.col("REPEAT_FID").alias("__gone")), df[pk].cast("long") == F.col("__gone"), "left_anti"))

