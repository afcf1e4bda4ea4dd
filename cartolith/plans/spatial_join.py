"""Spatial joins as equi-joins on grid cells.

Both sides are exploded to the cells that their boxes cover and joined on the cell; a pair is kept only in the cell of
the lower left corner of the boxes' overlap, so none comes twice. Features that cover more than ``MOST_CELLS`` cells
would multiply rows: they are joined apart, in one coarser grid for each power of ``COARSER`` that fits them.
A side of at most ``FEW`` rows, counted first, is broadcast instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g

#: Rows that are broadcast without cells, and cells a feature may cover in its grid.
FEW, MOST_CELLS, COARSER, LEVELS = 1000, 16, 8.0, 8


def is_few(df: DataFrame) -> bool:
    """Whether a side has at most ``FEW`` rows: reads no more than that."""
    return df.limit(FEW + 1).count() <= FEW


def cell_size(a: DataFrame, b: DataFrame) -> float:
    """Twice the mean side of the smaller layer's boxes, at least 1/1024 of its extent: one job over its boxes."""
    sides = []
    for d in (a, b):
        r = d.select(
            F.avg(F.greatest(F.col("box.xmax") - F.col("box.xmin"), F.col("box.ymax") - F.col("box.ymin"))).alias("side"),
            F.min("box.xmin").alias("x0"), F.max("box.xmax").alias("x1"), F.min("box.ymin").alias("y0"), F.max("box.ymax").alias("y1"),
        ).first()
        if r.side is not None:
            sides.append(max(2 * r.side, (r.x1 - r.x0) / 1024, (r.y1 - r.y0) / 1024))
    return min((s for s in sides if s > 0), default=1.0)


def _level(box: Column, cell: float) -> Column:
    """The finest grid in which a box covers at most ``MOST_CELLS`` cells, by side lengths."""
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(side <= (MOST_CELLS**0.5 - 1) * cell * COARSER**k, k).otherwise(out)
    return out


def _size(level: Column, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(COARSER), level)


def _cells(box: Column, level: Column, cell: float) -> Column:
    size = _size(level, cell)
    span = lambda a, b: F.sequence(F.floor(box[a] / size).cast("long"), F.floor(box[b] / size).cast("long"))
    return F.flatten(F.transform(span("xmin", "xmax"), lambda i: F.transform(span("ymin", "ymax"), lambda j: F.struct(level.alias("level"), i.alias("i"), j.alias("j")))))


def join(left: DataFrame, right: DataFrame, cell: float | None = None, within: float = 0.0, exact: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet (or are within a distance in x and y) and that are ``exact``.

    Filters after a join become its condition and come before what it had: so ``exact`` is guarded by the boxes here.

    ``left`` and ``right``: ``id``, ``box`` and any columns; the result has structs ``l`` and ``r`` of them.
    Rows without a box meet nothing.
    """
    l, r = left.where("box.xmin is not null"), right.where("box.xmin is not null")
    l = l.select(F.struct(*l.columns).alias("l"), F.col("box").alias("lb"))
    if within:
        grown = F.struct((F.col("box.xmin") - within).alias("xmin"), (F.col("box.ymin") - within).alias("ymin"), (F.col("box.xmax") + within).alias("xmax"), (F.col("box.ymax") + within).alias("ymax"))
        r = r.select(F.struct(*r.columns).alias("r"), grown.alias("rb"))
    else:
        r = r.select(F.struct(*r.columns).alias("r"), F.col("box").alias("rb"))
    meet = g.boxes_meet(F.col("lb"), F.col("rb"))
    sure = lambda met: F.when(met, exact(F.col("l"), F.col("r"))).otherwise(False) if exact else met
    if is_few(right):
        return l.join(F.broadcast(r), sure(meet)).select("l", "r")
    cell = cell or cell_size(left, right)
    # a row lives in the grid of its own size; a smaller one visits the coarser grids of the other side too
    l = l.withColumn("own", _level(F.col("lb"), cell))
    r = r.withColumn("own", _level(F.col("rb"), cell))
    levels_l = [row.own for row in l.select("own").distinct().collect()]  # at most LEVELS
    levels_r = [row.own for row in r.select("own").distinct().collect()]
    both = sorted({max(a, b) for a in levels_l for b in levels_r})
    visits = lambda box, own: F.flatten(F.transform(F.filter(F.array(*map(F.lit, both)), lambda k: k >= own), lambda k: _cells(box, k, cell)))
    if not both:
        return l.join(r, F.lit(False)).select("l", "r")
    lc = l.select("l", "lb", F.col("own").alias("lo"), F.explode(visits(F.col("lb"), F.col("own"))).alias("c"))
    rc = r.select("r", "rb", F.col("own").alias("ro"), F.explode(visits(F.col("rb"), F.col("own"))).alias("c"))
    size = _size(F.col("c.level"), cell)
    corner = (F.floor(F.greatest("lb.xmin", "rb.xmin") / size) == F.col("c.i")) & (F.floor(F.greatest("lb.ymin", "rb.ymin") / size) == F.col("c.j"))
    return lc.join(rc, "c").where(sure(meet & (F.col("c.level") == F.greatest("lo", "ro")) & corner)).select("l", "r")
