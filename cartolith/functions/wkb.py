"""Well-known binary, both ways, for the edges of the system."""

from __future__ import annotations

import struct

import numpy as np

from .kernels.bridge import Shape

_CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}
NAMES = {v: k for k, v in _CODES.items()}


def _vertices(ring: np.ndarray, has_z: bool, has_m: bool) -> bytes:
    use = [0, 1, *([2] if has_z else []), *([3] if has_m else [])]
    return np.ascontiguousarray(ring[:, use], "<f8").tobytes()


def encode(shape: Shape | None, shape_type: str, has_z: bool = False, has_m: bool = False) -> bytes | None:
    if shape is None:
        return None
    extra = 1000 * has_z + 2000 * has_m
    head = lambda kind: struct.pack("<BI", 1, _CODES[kind] + extra)
    array = lambda r: struct.pack("<I", len(r)) + _vertices(r, has_z, has_m)
    one = {
        "Point": lambda p: head("Point") + _vertices(p[0][:1], has_z, has_m),
        "LineString": lambda p: head("LineString") + array(p[0]),
        "Polygon": lambda p: head("Polygon") + struct.pack("<I", len(p)) + b"".join(map(array, p)),
    }
    if shape_type in one:
        return one[shape_type](shape[0])
    single = shape_type.removeprefix("Multi")
    return head(shape_type) + struct.pack("<I", len(shape)) + b"".join(map(one[single], shape))


def decode(data: bytes | None) -> tuple[Shape | None, str | None]:
    """The shape and its type. Vertices get x, y, z, m with NaN for what is missing."""
    if data is None:
        return None, None
    at = 0

    def geometry() -> tuple[Shape, str]:
        nonlocal at
        order = "<" if data[at] else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        has_z, has_m = bool(code & 0x80000000) or code // 1000 % 10 in (1, 3), bool(code & 0x40000000) or code // 1000 % 10 in (2, 3)
        if code & 0x20000000:
            at += 4
        kind = NAMES[(code & 0x0FFFFFFF) % 1000]
        width = 2 + has_z + has_m

        def vertices(n: int) -> np.ndarray:
            nonlocal at
            raw = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)
            at += 8 * n * width
            out = np.full((n, 4), np.nan)
            out[:, :2] = raw[:, :2]
            if has_z:
                out[:, 2] = raw[:, 2]
            if has_m:
                out[:, 3] = raw[:, -1]
            return out

        def count() -> int:
            nonlocal at
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            return n

        if kind == "Point":
            return [[vertices(1)]], kind
        if kind == "LineString":
            return [[vertices(count())]], kind
        if kind == "Polygon":
            return [[vertices(count()) for _ in range(count())]], kind
        return [part for _ in range(count()) for part in geometry()[0]], kind

    return geometry()


def to_wkb(df, geom: str, out: str, shape_type: str, has_z: bool = False, has_m: bool = False):
    """``df`` with a WKB column of a geometry column."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from .kernels.bridge import shapes

    def task(batches):
        for b in batches:
            found = [encode(s, shape_type, has_z, has_m) for s in shapes(b.column(b.schema.get_field_index(geom)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(task, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def from_wkb(df, column: str, out: str):
    """``df`` with a geometry column of a WKB column."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from .geometry import GEOMETRY
    from .kernels.bridge import column_of

    def task(batches):
        for b in batches:
            found = [decode(x)[0] for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, column_of(found)], [*b.schema.names, out])

    return df.mapInArrow(task, T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(GEOMETRY))]))
