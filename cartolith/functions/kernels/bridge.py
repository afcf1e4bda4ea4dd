"""Arrow nested arrays to lists of NumPy rings and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Ring = np.ndarray  # (n, 4): x, y, z, m
Shape = list[list[Ring]]  # parts of rings

_LEAF = pa.struct([(n, pa.float64()) for n in "xyzm"])
ARROW = pa.list_(pa.list_(pa.list_(_LEAF)))


#: Bytes of a batch that a task takes from Spark at once, and vertices of a batch that it gives back (one row at least).
BATCH_BYTES, BATCH_VERTICES = 16 << 20, 200_000
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


class Shapes:
    """The geometries of a column: ``flat`` has all vertices, a geometry's lists are made when it is asked for."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        parts, rings = column.values, column.values.values
        leaf = rings.values
        self.flat = np.stack([leaf.field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4)], axis=1) if len(leaf) else np.empty((0, 4))
        self.parts, self.rings, self.ends = (a.offsets.to_numpy() for a in (column, parts, rings))
        self.valid = column.is_valid().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.valid)

    def __getitem__(self, k: int) -> Shape | None:
        if not self.valid[k]:
            return None
        ends, rings = self.ends, self.rings
        return [[self.flat[ends[r] : ends[r + 1]] for r in range(rings[p], rings[p + 1])] for p in range(self.parts[k], self.parts[k + 1])]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) vertex of each geometry."""
        at = self.ends[self.rings[self.parts]]
        return at[:-1], at[1:]


def shapes(column: pa.Array) -> Shapes:
    return Shapes(column)


def column_of(found: list[Shape | None]) -> pa.Array:
    """A column of geometries; None, and shapes without vertices, are null."""
    o1, o2, o3, flat, null = [0], [0], [0], [], []
    for shape in found:
        rings = 0
        for part in shape or []:
            for ring in part:
                flat.append(ring)
                o3.append(o3[-1] + len(ring))
                rings += 1
            o2.append(len(o3) - 1)
        o1.append(len(o2) - 1)
        null.append(not rings)
    if any(r.shape[1] == 4 for r in flat):
        flat = [r if r.shape[1] == 4 else np.hstack([r, np.full((len(r), 2), np.nan)]) for r in flat]
    data = np.concatenate(flat) if flat else np.empty((0, 2))
    of = lambda k: pa.array(data[:, k], mask=np.isnan(data[:, k]) if k > 1 else None) if k < data.shape[1] else pa.nulls(len(data), pa.float64())
    leaf = pa.StructArray.from_arrays([of(k) for k in range(4)], fields=list(_LEAF))
    three = pa.ListArray.from_arrays(pa.array(o3, pa.int32()), leaf)
    two = pa.ListArray.from_arrays(pa.array(o2, pa.int32()), three)
    return pa.ListArray.from_arrays(pa.array(o1, pa.int32()), two, mask=pa.array(null))


class Nested:
    """Lists of geometries, made as they are asked for."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        self.of = Shapes(column.values)
        self.offsets, self.valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.valid)

    def __getitem__(self, k: int) -> list[Shape]:
        if not self.valid[k]:
            return []
        return [s for s in map(self.of.__getitem__, range(self.offsets[k], self.offsets[k + 1])) if s is not None]


def nested(column: pa.Array) -> Nested:
    return Nested(column)


def transform_rows(df: DataFrame, out: str, kernel: Callable[..., Shape | None], inputs: list[str], lists: tuple[str, ...] = (), drop: tuple[str, ...] = (), many: Callable | None = None) -> DataFrame:
    """``df`` with column ``out`` computed by ``kernel`` from ``inputs`` row by row, in Arrow batches.

    Columns in ``lists`` are arrays of geometries; other geometry columns are geometries, the rest plain values.
    ``many`` takes the columns of a whole batch, and gives a list with an ellipsis for each row that is left to ``kernel``.
    """
    geometry = {f.name: f.dataType.simpleString().startswith("array<array<array<struct") for f in df.schema.fields}
    carried = [f for f in df.schema.fields if f.name != out and f.name not in drop]
    from .. import geometry as g

    kind = T.StructType([*carried, T.StructField(out, T._parse_datatype_string(g.GEOMETRY))])
    conf = df.sparkSession.conf
    if int(conf.get(_LIMIT, None) or 1 << 62) > 1 << 30:  # rows may be as large as their geometries
        conf.set(_LIMIT, str(BATCH_BYTES))

    def task(batches):
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in inputs}
            given = [nested(at[n]) if n in lists else shapes(at[n]) if geometry[n] else at[n].to_pylist() for n in inputs]
            known = many(*given) if many else None
            rest = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)) for f in carried] or [pa.nulls(batch.num_rows)], [f.name for f in carried] or ["__none"])
            found, size, start = [], 0, 0
            for k in range(batch.num_rows):
                shape = known[k] if known else ...
                if shape is ...:
                    shape = kernel(*[c[k] for c in given])
                found.append(shape)
                size += sum(len(r) for p in shape for r in p) if shape else 0
                if size >= BATCH_VERTICES or k == batch.num_rows - 1:
                    own = rest.slice(start, len(found))
                    yield pa.RecordBatch.from_arrays([*(own.columns if carried else ()), column_of(found)], [*(f.name for f in carried), out])
                    found, size, start = [], 0, k + 1

    return df.mapInArrow(task, kind)
