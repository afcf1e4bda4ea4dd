"""Geometry as Catalyst expressions: no Python runs on the executors for anything here.

A geometry is parts of rings of vertices, ``array<array<array<struct<x, y, z, m>>>>``. A point is one part with one
ring of one vertex; a line one part with one ring; a polygon one part whose first ring is the shell, closed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double,z:double,m:double>"
GEOMETRY = f"array<array<array<{VERTEX}>>>"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is evaluated once."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


def vertex(x, y, z=None, m=None) -> Column:
    col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(col(x).alias("x"), col(y).alias("y"), col(z).alias("z"), col(m).alias("m"))


def point(x, y, z=None, m=None) -> Column:
    return F.array(F.array(F.array(vertex(x, y, z, m))))


def line(vertices: Column) -> Column:
    """One line of an array of vertices."""
    return F.array(F.array(vertices))


def box(xmin, ymin, xmax, ymax) -> Column:
    """An upright rectangle, counter-clockwise."""
    return F.array(F.array(F.array(vertex(xmin, ymin), vertex(xmax, ymin), vertex(xmax, ymax), vertex(xmin, ymax), vertex(xmin, ymin))))


def rings(geom: Column) -> Column:
    return F.flatten(geom)


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def _finite(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))


def ordinates(geom: Column, name: str) -> Column:
    return _finite(F.transform(vertices(geom), lambda v: v[name]))


def low(geom: Column, name: str) -> Column:
    return F.array_min(ordinates(geom, name))


def high(geom: Column, name: str) -> Column:
    return F.array_max(ordinates(geom, name))


def bbox(geom: Column) -> Column:
    return F.struct(low(geom, "x").alias("xmin"), low(geom, "y").alias("ymin"), high(geom, "x").alias("xmax"), high(geom, "y").alias("ymax"))


def point_box(geom: Column) -> Column:
    """``bbox`` of a single point."""
    v = first_vertex(geom)
    x, y = (F.nullif(v[k], F.lit(float("nan"))) for k in "xy")
    return F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes share a point, be it on their edges."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def is_empty(geom: Column) -> Column:
    return geom.isNull() | (F.size(vertices(geom)) == 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def steps(ring: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each two successive vertices."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), f)


def ring_area(ring: Column) -> Column:
    """Signed by direction, relative to the first vertex: positive if counter-clockwise."""
    return let(ring, lambda r: let(F.get(r, F.lit(0)), lambda o: total(steps(r, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))) / 2))


def area(geom: Column) -> Column:
    """Of shells less that of holes."""
    one = lambda part: total(F.transform(part, lambda r, i: F.when(i == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))))
    return total(F.transform(geom, one))


def length(geom: Column) -> Column:
    """Of all lines, or of all rings."""
    return total(F.transform(rings(geom), lambda r: total(steps(r, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))))


def part_count(geom: Column) -> Column:
    return F.size(geom)


def point_count(geom: Column) -> Column:
    return F.size(vertices(geom))


def hole_count(geom: Column) -> Column:
    return F.aggregate(geom, F.lit(0), lambda s, p: s + F.greatest(F.size(p) - 1, F.lit(0)))


def first_vertex(geom: Column) -> Column:
    return F.get(F.get(F.get(geom, F.lit(0)), F.lit(0)), F.lit(0))


def last_vertex(geom: Column) -> Column:
    return F.element_at(F.element_at(F.element_at(geom, -1), -1), -1)


def _weighted(terms: Column, fallback: Column) -> Column:
    """x and y from an array of (w, x, y), or the fallback's means when all weights are nought."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda s, t: F.struct((s["w"] + t["w"]).alias("w"), (s["x"] + t["w"] * t["x"]).alias("x"), (s["y"] + t["w"] * t["y"]).alias("y"))
    sums = F.aggregate(terms, zero, add)
    mean = lambda n: total(F.transform(fallback, lambda v: v[n])) / F.nullif(F.size(fallback), F.lit(0))
    return let(sums, lambda s: F.when(s["w"] != 0, F.struct((s["x"] / s["w"]).alias("x"), (s["y"] / s["w"]).alias("y"))).otherwise(F.struct(mean("x").alias("x"), mean("y").alias("y"))))


def centroid(geom: Column, dimension: int) -> Column:
    """struct<x, y>: mean of points, or of segments by length, or of ring triangles by area (holes negative)."""
    if dimension == 0:
        v = vertices(geom)
        mean = lambda n: total(F.transform(v, lambda p: p[n])) / F.nullif(F.size(v), F.lit(0))
        return F.struct(mean("x").alias("x"), mean("y").alias("y"))
    if dimension == 1:
        terms = F.flatten(F.transform(rings(geom), lambda r: steps(r, lambda a, b: F.struct(F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("w"), ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))))
        return _weighted(terms, vertices(geom))

    def of_ring(r: Column, i: Column) -> Column:
        def fan(o: Column) -> Column:
            def triangle(a: Column, b: Column) -> Column:
                w = ((a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])) / 2
                return F.struct(w.alias("w"), ((o["x"] + a["x"] + b["x"]) / 3).alias("x"), ((o["y"] + a["y"] + b["y"]) / 3).alias("y"))

            return steps(r, triangle)

        turned = F.signum(ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)
        return let(turned, lambda s: F.transform(let(F.get(r, F.lit(0)), fan), lambda t: F.struct((t["w"] * s).alias("w"), t["x"].alias("x"), t["y"].alias("y"))))

    terms = F.flatten(F.flatten(F.transform(geom, lambda p: F.transform(p, of_ring))))
    return _weighted(terms, vertices(geom))


def covers(geom: Column, x: Column, y: Column) -> Column:
    """Whether a polygon holds a point, its boundary included."""

    def crossing(a: Column, b: Column) -> Column:
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        between = (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))
        spans = (a["y"] > y) != (b["y"] > y)
        # 2: on the edge; 1: the ray to the right meets it
        return F.when((cross == 0) & between, 2).when(spans & ((cross > 0) == (b["y"] > a["y"])), 1).otherwise(0)

    def inside(part: Column) -> Column:
        marks = F.flatten(F.transform(part, lambda r: steps(r, crossing)))
        return let(marks, lambda m: F.exists(m, lambda v: v == 2) | (F.size(F.filter(m, lambda v: v == 1)) % 2 == 1))

    return F.exists(geom, inside)


def singleparts(geom: Column) -> Column:
    """array of geometries of one part each."""
    return F.transform(geom, lambda p: F.array(p))


def envelope(geom: Column) -> Column:
    return let(bbox(geom), lambda b: box(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def ring_lines(geom: Column) -> Column:
    """array of one line for each ring with two or more vertices."""
    return F.transform(F.filter(rings(geom), lambda r: F.size(r) >= 2), lambda r: F.array(F.array(r)))


def segments(geom: Column) -> Column:
    """array of two-vertex lines over all parts and rings."""
    return F.flatten(F.transform(rings(geom), lambda r: steps(r, lambda a, b: F.array(F.array(F.array(a, b))))))


def middle(ring: Column) -> Column:
    """The vertex at half of a line's length, its Z and M interpolated."""

    def walk(r: Column) -> Column:
        lengths = steps(r, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
        half = total(lengths) / 2
        zero = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast(VERTEX).alias("v"))
        pairs = steps(r, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def step(s: Column, p: Column) -> Column:
            n = F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])
            t = F.when(n > 0, (half - s["at"]) / n).otherwise(0.0)
            put = lambda k: p["a"][k] + t * (p["b"][k] - p["a"][k])
            here = s["v"].isNull() & (s["at"] + n >= half)
            return F.struct((s["at"] + n).alias("at"), F.when(here, vertex(put("x"), put("y"), put("z"), put("m"))).otherwise(s["v"]).alias("v"))

        return F.aggregate(pairs, zero, step, lambda s: s["v"])

    return let(ring, walk)


def rectangle_intersection(a: Column, b: Column) -> Column:
    """The common rectangle of two boxes, null if they share no area."""
    x0, y0 = F.greatest(a["xmin"], b["xmin"]), F.greatest(a["ymin"], b["ymin"])
    x1, y1 = F.least(a["xmax"], b["xmax"]), F.least(a["ymax"], b["ymax"])
    return F.when((x1 > x0) & (y1 > y0), box(x0, y0, x1, y1))


def disk(x: Column, y: Column, radius: Column, quadrant: int = 32) -> Column:
    """The polygon of ``4 * quadrant`` vertices that a buffer of a point is."""
    n = 4 * quadrant
    turn = [(i % n) * (-2 * math.pi / n) for i in range(n, -1, -1)]
    return F.array(F.array(F.zip_with(F.lit([math.cos(t) for t in turn]), F.lit([math.sin(t) for t in turn]), lambda c, s: vertex(x + radius * c, y + radius * s))))
