"""Fields: add, delete, calculate, alter; GNSS metadata; end times."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, FieldError, OperationsError
from ..model import FeatureFrame, Layer, df_of, like, pk_of
from ..names import resolve
from .common import fields as named

FAMILIES = {"boolean": "number", "tinyint": "number", "smallint": "number", "int": "number", "bigint": "number", "float": "number", "double": "number", "string": "text", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "binary": "binary"}


def family(kind: T.DataType) -> str:
    return FAMILIES.get(kind.simpleString().split("(")[0], "number" if isinstance(kind, T.NumericType) else kind.simpleString())


def compatible(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of one type may be kept as the other."""
    return family(a) == family(b)


def common_fields(a: Layer, b: Layer) -> list[str]:
    """Names (of ``a``) of fields that both have, of one type."""
    other = {f.name.casefold(): f.dataType for f in df_of(b).schema.fields}
    return [f.name for f in df_of(a).schema.fields if other.get(f.name.casefold()) == f.dataType]


def _protected(source: Layer) -> set[str]:
    if isinstance(source, FeatureFrame):
        return {source.meta.pk.casefold(), source.meta.geom.casefold()}
    return {pk.casefold()} if (pk := pk_of(source)) else set()


def add_field(source: Layer, fields: Iterable[T.StructField | tuple[str, str]] = (), elements: Iterable[Layer] = ()) -> Layer:
    """New null fields: those given, and those of other layers. A name that exists, whatever its case, stays as it is."""
    df = df_of(source)
    wanted = [f if isinstance(f, T.StructField) else T.StructField(f[0], T._parse_datatype_string(f[1])) for f in fields]
    for e in elements:
        skip = _protected(e)
        wanted += [f for f in df_of(e).schema.fields if f.name.casefold() not in skip]
    for f in wanted:
        if resolve(f.name, df.columns) is None:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
            if f.metadata:
                df = df.withMetadata(f.name, f.metadata)
    return like(source, df)


def delete_field(source: Layer, fields: str | Iterable[str]) -> Layer:
    """Without some fields; the id and the geometry can't go."""
    df = df_of(source)
    gone = named(df, fields)
    if kept := [f for f in gone if f.casefold() in _protected(source)]:
        raise FieldError(f"protected: {', '.join(kept)}")
    return like(source, df.drop(*gone))


def calculate_field(source: Layer, field: str, expression: str | Column, where_clause: str = "") -> Layer:
    """Set a field to an SQL expression where a predicate is true."""
    df = df_of(source)
    (name,) = named(df, field)
    try:
        value = (F.expr(expression) if isinstance(expression, str) else expression).cast(df.schema[name].dataType)
        if where_clause and where_clause.strip():
            value = F.when(F.expr(where_clause), value).otherwise(F.col(name))
        out = df.withColumn(name, value)
        out.schema  # noqa: B018 - analysed now
    except (AnalysisException, ParseException) as e:
        raise OperationsError(f"bad expression {expression!r}: {e}") from e
    return like(source, out)


def alter_field(source: Layer, field: str, field_property: str = "name", value: str | None = None) -> Layer:
    """Another name, or an alias or comment in the field's metadata."""
    df = df_of(source)
    (name,) = named(df, field)
    kind = field_property.casefold()
    if kind == "name":
        if not value or not value.strip():
            raise ArgumentError("a field needs a name")
        return like(source, df.withColumnRenamed(name, value.strip()))
    if kind not in ("alias", "comment"):
        raise ArgumentError(f"{field_property!r} is none of name, alias, comment")
    return like(source, df.withMetadata(name, {**df.schema[name].metadata, kind: value}))


#: name (after GNSS_), type and alias of the fields of positioning; kinds of fix and source are texts
_GNSS = """POSITIONSOURCETYPE string Position Source Type; RECEIVER string Receiver Name; LATITUDE double Latitude; LONGITUDE double Longitude; ALTITUDE double Altitude
H_RMS double Horizontal Accuracy (m); V_RMS double Vertical Accuracy (m); FIXDATETIME timestamp_ntz Fix Time; FIXTYPE string Fix Type; CORRECTIONAGE double Correction Age
STATIONID bigint Station ID; NUMSATS bigint Number of Satellites; PDOP double PDOP; HDOP double HDOP; VDOP double VDOP; DIRECTION double Direction of travel (°)
SPEED double Speed (km/h); AZIMUTH double Compass reading (°); AVG_H_RMS double Average Horizontal Accuracy (m); AVG_V_RMS double Average Vertical Accuracy (m)
AVG_POSITIONS bigint Averaged Positions; H_STDDEV double Standard Deviation (m)"""
_GNSS_LINES = """WORST_H_RMS double Worst Horizontal Accuracy (m); WORST_V_RMS double Worst Vertical Accuracy (m); WORST_FIXTYPE string Worst Fix Type; MANUAL_LOCATIONS bigint Number of Manual Locations"""
_RANGES = {"NUMSATS": [0, 99], "STATIONID": [0, 1023]}


def _positioning(text: str) -> list[T.StructField]:
    out = []
    for entry in text.replace("\n", ";").split(";"):
        name, kind, alias = entry.strip().split(" ", 2)
        full = "SNSR_AZIMUTH" if name == "AZIMUTH" else f"GNSS_{name}"
        out.append(T.StructField(full, T._parse_datatype_string(kind), True, {"alias": alias} | ({"range": _RANGES[name]} if name in _RANGES else {})))
    return out


def add_gps_metadata_fields(source: FeatureFrame) -> FeatureFrame:
    """22 fields of satellite positioning, and those of worst fixes for layers other than points. Existing ones stay."""
    points = source.meta.dimension == 0 and not source.meta.multi
    return add_field(source, _positioning(_GNSS if points else f"{_GNSS};{_GNSS_LINES}"))


def calculate_end_time(source: Layer, start_field: str, end_field: str, sort_fields: str | Iterable[str] = (), partition_fields: str | Iterable[str] = ()) -> Layer:
    """The end of each row is the start of the next one in order of ``sort_fields`` or the id; the last one's is null.

    Over a whole table that order is made by ranges, each range's last row taking the next range's first start, so
    no task holds the table; ``partition_fields`` starts afresh for each of their values.
    """
    df = df_of(source)
    (start,), (end,) = named(df, start_field), named(df, end_field)
    if start == end:
        raise FieldError("start and end must be two fields")
    if not compatible(df.schema[start].dataType, df.schema[end].dataType):
        raise FieldError("start and end must be of like types")
    pk = pk_of(source)
    order = [*named(df, sort_fields), *([pk] if pk else [])] if sort_fields else [pk]
    kind = df.schema[end].dataType
    if partition_fields:
        at = Window.partitionBy(*named(df, partition_fields)).orderBy(*[F.asc_nulls_first(c) for c in order])
        return like(source, df.withColumn(end, F.lead(start).over(at).cast(kind)))
    # ranges are fixed first: every use of them below compares with the same bounds
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tops = df.select(key.alias("key")).repartitionByRange(parts, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("key"))
    kinds = [df.schema[c].dataType for c in order]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(r.key, kinds))]) for r in tops.orderBy("key").collect()]  # one row a range
    at = F.size(F.filter(F.array(*bounds[:-1]), lambda x: x < F.col("__key"))) if len(bounds) > 1 else F.lit(0)
    ranged = df.withColumn("__key", key).withColumn("__part", at.cast("int"))
    firsts = ranged.groupBy("__part").agg(F.min(F.struct("__key", F.col(start).alias("v")))["v"].alias("v")).orderBy("__part").collect()
    rows = [(r["__part"], after.v) for r, after in zip(firsts, firsts[1:])]
    seam = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__v", df.schema[start].dataType)]))
    within = Window.partitionBy("__part").orderBy("__key")
    out = ranged.withColumn("__next", F.lead(F.struct(F.col(start).alias("v"))).over(within))
    out = out.join(F.broadcast(seam), out["__part"] == seam["__p"], "left")
    out = out.withColumn(end, F.when(F.col("__next").isNotNull(), F.col("__next.v")).otherwise(F.col("__v")).cast(kind))
    return like(source, out.select(*df.columns))
