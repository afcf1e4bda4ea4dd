"""A stream of features against a static layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import OperationsError
from ..functions import geometry as g
from ..model import FeatureFrame
from ..operators import overlay
from ..plans import spatial_join


def _checked(stream: FeatureFrame, operator: FeatureFrame) -> None:
    if not stream.df.isStreaming or operator.df.isStreaming:
        raise OperationsError("a stream and a static layer are needed")
    if not spatial_join.is_few(operator.df):
        raise OperationsError(f"the static layer has more than {spatial_join.FEW} features: write the stream and join batches of it")


def intersect(stream: FeatureFrame, operator: FeatureFrame, attribute_option: str = "all") -> FeatureFrame:
    """Each streamed feature with every static one that it meets, as it arrives."""
    _checked(stream, operator)
    return overlay.intersect(stream, operator, attribute_option)


def clip_points(stream: FeatureFrame, operator: FeatureFrame) -> FeatureFrame:
    """Streamed points that any static polygon covers, each once: the polygons travel in one row."""
    _checked(stream, operator)
    if stream.meta.dimension != 0 or stream.meta.multi:
        raise OperationsError("single points are needed")
    shapes = operator.df.agg(F.collect_list(operator.geom).alias("__all"))  # at most FEW
    v = g.first_vertex(F.col(stream.meta.geom))
    df = stream.df.crossJoin(F.broadcast(shapes)).where(F.exists("__all", lambda s: g.covers(s, v["x"], v["y"]))).drop("__all")
    return stream.with_df(df)


def write(layer: FeatureFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch to ``sink`` once; a repeated batch has the same number."""
    return layer.df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
