"""Workspaces: folders of Parquet layers, each with a record of its geometry, and their elements."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ContainerError, OperationsError
from ..functions.geometry import GEOMETRY
from ..model import POLYGON, FeatureFrame, FeatureMeta, Layer, df_of
from ..names import valid_name
from ..settings import Settings, current
from ..sources import geopackage


def create_folder(path: str, name: str, settings: Settings | None = None) -> str:
    full = os.path.join(path, name)
    try:
        os.makedirs(full, exist_ok=(settings or current()).overwrite)
    except FileExistsError:
        raise ContainerError(f"{full} exists") from None
    return full


def create_workspace(path: str) -> str:
    """A folder for layers."""
    os.makedirs(path, exist_ok=True)
    return path


def create_sqlite_database(path: str, **_) -> str:
    """A new GeoPackage; it never replaces one."""
    return geopackage.create(path)


create_geopackage = create_sqlite_database


def elements(workspace: str) -> list[str]:
    return sorted(n for n in os.listdir(workspace) if os.path.isdir(os.path.join(workspace, n)) and not n.startswith((".", "_")))


def save(layer: Layer, workspace: str, name: str, settings: Settings | None = None) -> str:
    """Write a layer; an element of that name is replaced only with the overwrite setting."""
    s = settings or current()
    prefix = "fc" if isinstance(layer, FeatureFrame) else "tbl"
    name = valid_name(name, prefix)
    path = os.path.join(workspace, name)
    if os.path.exists(path) and not s.overwrite:
        raise OperationsError(f"{name} exists in {workspace}")
    if isinstance(layer, FeatureFrame):
        layer = layer.with_bbox()
    df_of(layer).write.mode("overwrite" if s.overwrite else "errorifexists").parquet(path)
    if isinstance(layer, FeatureFrame):
        with open(os.path.join(path, "_meta.json"), "w") as out:
            json.dump({**asdict(layer.meta), "name": name}, out)
    return path


def load(spark: SparkSession, workspace: str, name: str) -> Layer:
    path = os.path.join(workspace, name)
    if not os.path.isdir(path):
        raise ContainerError(f"no {name} in {workspace}")
    df = spark.read.parquet(path)
    meta = os.path.join(path, "_meta.json")
    if not os.path.exists(meta):
        return df
    with open(meta) as f:
        return FeatureFrame(df, FeatureMeta(**json.load(f)))


def delete(workspace: str, names: str | Iterable[str]) -> bool:
    """Whether all were there and are gone."""
    found = True
    for name in [names] if isinstance(names, str) else list(names):
        path = os.path.join(workspace, name)
        if os.path.isdir(path):
            shutil.rmtree(path)
        else:
            found = False
    return found


def rename(workspace: str, name: str, new_name: str) -> str:
    if name not in elements(workspace):
        raise ContainerError(f"no {name} in {workspace}")
    new = valid_name(new_name, "fc")
    if new in elements(workspace):
        raise OperationsError(f"{new} exists in {workspace}")
    os.rename(os.path.join(workspace, name), os.path.join(workspace, new))
    return new


def create_table(spark: SparkSession, fields: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """An empty table with an id."""
    return spark.createDataFrame([], T.StructType([T.StructField("fid", T.LongType(), False), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)]))


def create_feature_class(spark: SparkSession, name: str, crs: str | None, fields: Iterable[tuple[str, str]] = (), shape_type: str = POLYGON, z_enabled: bool = False, m_enabled: bool = False) -> FeatureFrame:
    """An empty layer."""
    schema = T.StructType([T.StructField("fid", T.LongType(), False), T.StructField("geom", T._parse_datatype_string(GEOMETRY)), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in fields)])
    return FeatureFrame(spark.createDataFrame([], schema), FeatureMeta(shape_type, z_enabled, m_enabled, crs, name=valid_name(name, "fc")))


def table_to_geopackage(source: dict[str, DataFrame], path: str, overwrite: bool = False) -> list[str]:
    """Copy tables to a GeoPackage; returns their names there."""
    return [geopackage.write(df, path, name, overwrite) for name, df in source.items()]


def feature_class_to_geopackage(source: Iterable[FeatureFrame], path: str, overwrite: bool = False, settings: Settings | None = None) -> list[str]:
    """Copy layers to a GeoPackage, within the extent and in the output coordinate system of the settings."""
    from .common import in_extent
    from .projections import project

    s, names = settings or current(), []
    for layer in source:
        layer = in_extent(layer, s)
        if s.output_coordinate_system:
            layer = project(layer, s.output_coordinate_system)
        names.append(geopackage.write(layer, path, None, overwrite))
    return names
