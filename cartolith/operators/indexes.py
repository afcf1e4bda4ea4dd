"""What indexes are here: a materialised box and an order for files, and assertions of uniqueness."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from ..errors import OperationsError
from ..model import FeatureFrame, Layer, df_of, like
from .common import fields


def add_spatial_index(source: FeatureFrame, cells: int = 1024) -> FeatureFrame:
    """With ``bbox``, and rows ordered along a Z curve by range, so that written files prune by place. Idempotent."""
    layer = source.with_bbox()
    ends = layer.df.agg(F.min("bbox.xmin").alias("x"), F.min("bbox.ymin").alias("y"), F.max("bbox.xmax").alias("x1"), F.max("bbox.ymax").alias("y1")).first()
    if ends.x is None:
        return layer
    sx, sy = (ends.x1 - ends.x) / cells or 1.0, (ends.y1 - ends.y) / cells or 1.0
    i, j = F.floor((F.col("bbox.xmin") - ends.x) / sx).cast("long"), F.floor((F.col("bbox.ymin") - ends.y) / sy).cast("long")
    z = F.lit(0).cast("long")
    for bit in range(cells.bit_length()):
        z = z.bitwiseOR(F.shiftleft(F.shiftright(i, bit).bitwiseAND(F.lit(1).cast("long")), 2 * bit)).bitwiseOR(F.shiftleft(F.shiftright(j, bit).bitwiseAND(F.lit(1).cast("long")), 2 * bit + 1))
    df = layer.df.withColumn("__z", F.coalesce(z, F.lit(-1).cast("long")))
    return layer.with_df(df.repartitionByRange("__z").sortWithinPartitions("__z").drop("__z"))


def remove_spatial_index(source: FeatureFrame) -> FeatureFrame:
    return source.with_df(source.df.drop("bbox"))


def add_attribute_index(source: Layer, name: str, index_fields: str | Iterable[str], is_unique: bool = False, is_ascending: bool = True) -> Layer:
    """Rows ordered by range of the fields; a unique index is checked."""
    df = df_of(source)
    keys = fields(df, index_fields)
    if is_unique and not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise OperationsError(f"{', '.join(keys)} aren't unique")
    order = [F.asc_nulls_first(k) if is_ascending else F.desc_nulls_last(k) for k in keys]
    return like(source, df.repartitionByRange(*order).sortWithinPartitions(*order))


def remove_attribute_index(source: Layer, name: str) -> Layer:
    """An order of rows needs no removal."""
    return source
