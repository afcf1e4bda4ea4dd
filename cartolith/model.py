"""Layers: a DataFrame with an id, a nested-array geometry, and a record of what the geometry is."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import GeometryTypeError
from .functions import geometry as g
from .names import resolve

POINT, MULTIPOINT, LINE, MULTILINE, POLYGON, MULTIPOLYGON = "Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon"
SHAPES = (POINT, MULTIPOINT, LINE, MULTILINE, POLYGON, MULTIPOLYGON)
DIMENSION = {POINT: 0, MULTIPOINT: 0, LINE: 1, MULTILINE: 1, POLYGON: 2, MULTIPOLYGON: 2}
SINGLE = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}
MULTI = {v: k for k, v in SINGLE.items()}


@dataclass(frozen=True)
class FeatureMeta:
    """What a DataFrame can't say of its geometry column.

    ``rectangles`` promises that every geometry is one upright rectangle: overlays of such layers
    need no kernel.
    """

    shape_type: str
    has_z: bool = False
    has_m: bool = False
    crs: str | None = None
    pk: str = "fid"
    geom: str = "geom"
    name: str = "layer"
    rectangles: bool = False

    def __post_init__(self):
        if self.shape_type not in SHAPES:
            raise GeometryTypeError(f"unknown shape type {self.shape_type!r}")

    @property
    def dimension(self) -> int:
        return DIMENSION[self.shape_type]

    @property
    def multi(self) -> bool:
        return self.shape_type in SINGLE


@dataclass(frozen=True)
class FeatureFrame:
    df: DataFrame
    meta: FeatureMeta

    @property
    def geom(self) -> Column:
        return self.df[self.meta.geom]

    @property
    def fid(self) -> Column:
        return self.df[self.meta.pk]

    @property
    def attributes(self) -> list[str]:
        """All columns but the id, the geometry and its box."""
        special = {self.meta.pk.casefold(), self.meta.geom.casefold(), "bbox"}
        return [c for c in self.df.columns if c.casefold() not in special]

    def with_df(self, df: DataFrame, **changes) -> FeatureFrame:
        return FeatureFrame(df, replace(self.meta, **changes))

    def with_bbox(self) -> FeatureFrame:
        """With a column ``bbox`` of bounds, whose Parquet statistics prune files and row groups."""
        return self if "bbox" in self.df.columns else self.with_df(self.df.withColumn("bbox", g.bbox(F.col(self.meta.geom))))

    @property
    def box(self) -> Column:
        if "bbox" in self.df.columns:
            return self.df["bbox"]
        return g.point_box(self.geom) if self.meta.shape_type == POINT else g.bbox(self.geom)


Layer = FeatureFrame | DataFrame


def df_of(layer: Layer) -> DataFrame:
    return layer.df if isinstance(layer, FeatureFrame) else layer


def like(layer: Layer, df: DataFrame) -> Layer:
    """``df`` as the kind of layer that ``layer`` is."""
    return layer.with_df(df) if isinstance(layer, FeatureFrame) else df


def pk_of(layer: Layer) -> str | None:
    return layer.meta.pk if isinstance(layer, FeatureFrame) else resolve("fid", layer.columns)
