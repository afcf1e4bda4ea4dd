"""OGC GeoPackages (SQLite files) as sources and sinks.

Reading is a Python data source: partitions are ranges of row ids, each opened by its own task, with only the wanted
columns selected. The file must be on a path that all executors see. Writing goes through one connection, as SQLite
has one writer: row batches come from an iterator over partitions, so the driver holds one partition at a time.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ContainerError
from ..functions import wkb
from ..functions.kernels.bridge import column_of
from ..model import FeatureFrame, FeatureMeta
from ..names import unique_name, valid_name

REQUIRED = {"gpkg_contents", "gpkg_spatial_ref_sys", "gpkg_geometry_columns", "gpkg_tile_matrix", "gpkg_tile_matrix_set", "gpkg_extensions"}
ROWS = 100_000
_TYPES = [("bool", "boolean"), ("tinyint", "tinyint"), ("smallint", "smallint"), ("int2", "smallint"), ("mediumint", "int"), ("int", "bigint"), ("real", "double"), ("double", "double"), ("float", "float"), ("numeric", "double"), ("decimal", "double"), ("text", "string"), ("char", "string"), ("varchar", "string"), ("clob", "string"), ("datetime", "string"), ("timestamp", "string"), ("date", "string"), ("time", "string"), ("blob", "binary")]
#: A data source is asked for its schema where there is no Spark session to parse type names.
_KINDS = {"boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType()}
_DECLARED = {"boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "MEDIUMINT", "bigint": "INTEGER", "float": "FLOAT", "double": "DOUBLE", "string": "TEXT", "date": "DATE", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "binary": "BLOB"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def is_geopackage(path: str) -> bool:
    if not os.path.isfile(path):
        return False
    try:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            names = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    except sqlite3.DatabaseError:
        return False
    return len(REQUIRED & names) >= 4 and {"gpkg_contents", "gpkg_spatial_ref_sys"} <= names


def create(path: str) -> str:
    """A new container; it never replaces one."""
    if os.path.exists(path):
        raise ContainerError(f"{path} exists")
    with sqlite3.connect(path) as con:
        con.executescript(
            """
            PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
            CREATE TABLE gpkg_tile_matrix_set (table_name TEXT PRIMARY KEY, srs_id INTEGER NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE);
            CREATE TABLE gpkg_tile_matrix (table_name TEXT NOT NULL, zoom_level INTEGER NOT NULL, matrix_width INTEGER, matrix_height INTEGER, tile_width INTEGER, tile_height INTEGER, pixel_x_size DOUBLE, pixel_y_size DOUBLE, PRIMARY KEY (table_name, zoom_level));
            CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL, scope TEXT NOT NULL);
            INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL), ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84"]', NULL);
            """
        )
    return path


def tables(path: str) -> dict[str, str]:
    """Names and kinds (attributes, features) of the elements."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return dict(con.execute("SELECT table_name, data_type FROM gpkg_contents"))


def _body(blob: bytes | None) -> bytes | None:
    """WKB of a GeoPackage geometry: without its header."""
    if blob is None or blob[:2] != b"GP":
        return blob
    flags = blob[3]
    return None if flags >> 4 & 1 else blob[8 + (0, 32, 48, 48, 64)[flags >> 1 & 7] :]


def _header(srs: int) -> bytes:
    return b"GP\0" + bytes([1]) + struct.pack("<i", srs)


def _columns(con, table: str) -> tuple[list[tuple[str, str]], str | None, tuple | None]:
    """(name, Spark type) of attributes, the key, and (geometry column, type, srs, z, m)."""
    geometry = con.execute("SELECT column_name, geometry_type_name, srs_id, z, m FROM gpkg_geometry_columns WHERE table_name = ?", (table,)).fetchone()
    out, pk = [], None
    for _, name, declared, _, _, key in con.execute(f"PRAGMA table_info({quoted(table)})"):
        if geometry and name == geometry[0]:
            continue
        kind = next((s for p, s in _TYPES if declared.lower().startswith(p)), "string")
        pk = name if key else pk
        out.append((name, kind))
    return out, pk, geometry


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.schema = schema

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        return [_Range(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            _, _, geometry = _columns(con, self.table)
            names = ", ".join(quoted(geometry[0]) if geometry and f.name == "geom" else quoted(f.name) for f in self.schema.fields)
            cursor = con.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
            while rows := cursor.fetchmany(5000):
                columns = []
                for f, kind, values in zip(self.schema.fields, kinds, zip(*rows)):
                    if f.name == "geom" and geometry:
                        columns.append(column_of([wkb.decode(_body(v))[0] for v in values]).cast(kind.type))
                    elif pa.types.is_boolean(kind.type):
                        columns.append(pa.array([None if v is None else bool(v) for v in values], kind.type))
                    elif pa.types.is_string(kind.type):
                        columns.append(pa.array([None if v is None else str(v) for v in values], kind.type))
                    else:
                        columns.append(pa.array(values, kind.type))
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)


class GeoPackageSource(DataSource):
    """``spark.read.format("geopackage").option("path", ...).option("table", ...).load()``."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            attributes, _, geometry = _columns(con, self.options["table"])
        fields = [T.StructField(n, _KINDS[k]) for n, k in attributes]
        if geometry:
            vertex = T.StructType([T.StructField(n, T.DoubleType()) for n in "xyzm"])
            fields.insert(1, T.StructField("geom", T.ArrayType(T.ArrayType(T.ArrayType(vertex)))))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


_SHAPES = {k.upper(): k for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")}


def read(spark: SparkSession, path: str, table: str) -> FeatureFrame | DataFrame:
    """A layer, or a DataFrame if the element has no geometry."""
    if not is_geopackage(path):
        raise ContainerError(f"{path} is no GeoPackage")
    spark.dataSource.register(GeoPackageSource)
    df = spark.read.format("geopackage").option("table", table).load(path)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        _, pk, geometry = _columns(con, table)
    if not geometry:
        return df
    _, kind, srs, z, m = geometry
    return FeatureFrame(df, FeatureMeta(_SHAPES[kind.upper()], bool(z), bool(m), f"EPSG:{srs}" if srs > 0 else None, pk or "fid", "geom", table))


def write(layer: FeatureFrame | DataFrame, path: str, name: str | None = None, overwrite: bool = False) -> str:
    """Write an element; without ``overwrite`` it gets a name of its own. Returns the name."""
    if not is_geopackage(path):
        create(path)
    features = isinstance(layer, FeatureFrame)
    df = layer.df.drop("bbox") if features else layer
    meta = layer.meta if features else None
    name = valid_name(name or (meta.name if meta else "table"), "fc" if features else "tbl")
    have = tables(path)
    if overwrite and name in have:
        delete(path, name)
    else:
        name = unique_name(name, have)
    pk = meta.pk if meta else next((c for c in df.columns if c.casefold() == "fid"), None)
    attributes = [f for f in df.schema.fields if f.name != pk and not (meta and f.name == meta.geom)]
    declared = [f"{quoted(pk or 'fid')} INTEGER PRIMARY KEY", *([f"{quoted(meta.geom)} {meta.shape_type.upper()}"] if meta else []), *(f"{quoted(f.name)} {_DECLARED.get(f.dataType.simpleString().split('(')[0], 'TEXT')}" for f in attributes)]
    columns = [*([pk] if pk else []), *([meta.geom] if meta else []), *(f.name for f in attributes)]
    srs = int(meta.crs.split(":")[1]) if meta and meta.crs else -1
    if meta:
        df = wkb.to_wkb(df, meta.geom, "__wkb", meta.shape_type, meta.has_z, meta.has_m).drop(meta.geom).withColumnRenamed("__wkb", meta.geom)
    plain = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(f.name) for f in df.select(*columns).schema.fields]
    with sqlite3.connect(path) as con:
        con.execute(f"CREATE TABLE {quoted(name)} ({', '.join(declared)})")
        insert = f"INSERT INTO {quoted(name)} ({', '.join(map(quoted, columns))}) VALUES ({', '.join('?' * len(columns))})"
        head, at = _header(srs), columns.index(meta.geom) if meta else -1
        rows = df.select(*plain).toLocalIterator()
        con.executemany(insert, (tuple(None if v is None else head + bytes(v) if k == at else bytes(v) if isinstance(v, bytearray) else v for k, v in enumerate(r)) for r in rows))
        con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, ?, ?, ?)", (name, "features" if meta else "attributes", name, srs if meta else None))
        if meta:
            con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?, ?, ?, ?)", (name, meta.geom, meta.shape_type.upper(), srs, int(meta.has_z), int(meta.has_m)))
            if srs > 0:
                con.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
    return name


def delete(path: str, name: str) -> bool:
    """Remove an element; false if there is none."""
    if name not in tables(path):
        return False
    with sqlite3.connect(path) as con:
        con.execute(f"DROP TABLE {quoted(name)}")
        con.execute("DELETE FROM gpkg_contents WHERE table_name = ?", (name,))
        con.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (name,))
    return True
