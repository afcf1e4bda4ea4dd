"""Overlays and dissolves: what one task takes is bounded, and plain shapes take short ways."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.functions.kernels import arrangement as ar
from cartolith.functions.kernels import bridge
from cartolith.model import LINE, POLYGON, FeatureFrame, FeatureMeta
from cartolith.operators import extract, generalization, overlay


def boxes(spark, rows, name="a", rectangles=True):
    df = spark.createDataFrame(rows, "fid long, x0 double, y0 double, x1 double, y1 double")
    return FeatureFrame(df.select("fid", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom")), FeatureMeta(POLYGON, name=name, rectangles=rectangles))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lines_that_run_together_are_joined_before_they_are_cut(spark, monkeypatch):
    e = np.array([(0.0, 1.0, 4.0, 1.0), (6.0, 1.0, 3.0, 1.0), (7.0, 1.0, 8.0, 1.0), (2.0, 0.0, 2.0, 5.0), (0.0, 0.0, 3.0, 3.0), (3.0, 3.0, 0.0, 0.0)])
    assert sorted(map(tuple, ar.run_together(e).tolist())) == [(0.0, 0.0, 3.0, 3.0), (0.0, 1.0, 6.0, 1.0), (2.0, 0.0, 2.0, 5.0), (7.0, 1.0, 8.0, 1.0)]
    monkeypatch.setattr(generalization, "FAN_IN", 8)  # all in one place: its block is divided
    rows = spark.range(60).select(F.col("id").alias("fid"), F.lit(1).alias("k"), g.line(F.array(g.vertex(F.col("id") % 20, 0.5), g.vertex(F.col("id") % 20 + 1 + F.col("id") / 60, 0.5))).alias("geom"))
    d = generalization.dissolve(FeatureFrame(rows, FeatureMeta(LINE)), "k").df
    assert math.isclose(sum(r[0] for r in d.select(g.length(F.col("geom"))).collect()), 19 + 1 + 59 / 60)


def test_lines_over_upright_rectangles():
    line = [[np.array([(-1.0, 1.0, 7.0, 0.0), (3.0, 1.0, 9.0, 0.0), (3.0, 5.0, 9.0, 0.0), (1.0, 5.0, 9.0, 0.0), (1.0, 4.0, 9.0, 0.0)])]]
    other = ar.box(0, 0, 2, 4)
    inside = ar.clip_line(line, other)
    assert [p[0].tolist() for p in inside] == [[[0.0, 1.0, 7.5, 0.0], [2.0, 1.0, 8.5, 0.0]]]
    outside = ar.clip_line(line, other, keep_inside=False)
    assert [p[0][:, :2].tolist() for p in outside] == [[[-1.0, 1.0], [0.0, 1.0]], [[2.0, 1.0], [3.0, 1.0], [3.0, 5.0], [1.0, 5.0], [1.0, 4.0]]]


def test_lines_are_spread_before_they_are_cut(spark):
    row = spark.range(1).select(F.col("id").alias("fid"), g.line(F.array(g.vertex(0.5, 0.5), g.vertex(3.5, 0.5))).alias("geom"))
    found = overlay.intersect(FeatureFrame(row.coalesce(1), FeatureMeta(LINE, name="l")), boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0)]), "only_fid").df
    text = plan(found)
    assert text.index("MapInArrow") < text.index("BroadcastNestedLoopJoin") < text.index("REPARTITION_BY_NUM")
    assert found.count() == 1


def test_a_batch_of_large_shapes_is_given_back_in_parts(spark, monkeypatch):
    """Geometries are unpacked one by one, and what a task holds is bounded by vertices, not by rows."""
    column = bridge.column_of([ar.box(0, 0, k + 1, 1) for k in range(5)] + [None])
    lazy = bridge.shapes(column)
    assert len(lazy) == 6 and lazy[5] is None and not isinstance(lazy, list)
    assert lazy[3][0][0][:, :2].tolist() == ar.box(0, 0, 4, 1)[0][0].tolist()
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    layer = boxes(spark, [(k, 0.0, 0.0, k + 1.0, 1.0) for k in range(5)])
    out = bridge.transform_rows(layer.df.coalesce(1), "__g", lambda s: [[np.zeros((150_000, 2))]], ["geom"], drop=("geom",))
    assert int(spark.conf.get(limit)) <= 1 << 24

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert sorted(r.fid for r in out.select("fid").collect()) == [0, 1, 2, 3, 4]


def test_equal_geometries_are_united_once(spark):
    layer = boxes(spark, [(k, float(k % 3), 0.0, k % 3 + 1.0, 1.0) for k in range(3000)])
    found = generalization.united(layer.df, [], "geom", F.col("fid"), 2, None)
    assert "__gs" in plan(found)
    assert found.select(g.area(F.col("geom"))).first()[0] == 3.0


def test_union_of_crowded_boxes(spark):
    a = boxes(spark, [(k, float(k % 30), float(k // 30 % 30), k % 30 + 2.0, k // 30 % 30 + 2.0) for k in range(900)])
    d = overlay.union(a, boxes(spark, [(1, 0.0, 0.0, 10.5, 10.5)], "b"), "only_fid").df
    total = {r[0]: r[1] for r in d.groupBy("fid_b").agg(F.sum(g.area(F.col("geom")))).collect()}
    inside = sum((min(x + 2, 10.5) - x) * (min(y + 2, 10.5) - y) for x in range(11) for y in range(11))
    assert math.isclose(total[1], inside) and math.isclose(total[None], 3600 - inside)


def test_boxes_within_an_operator_need_no_kernel(spark):
    a = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 4.0, 0.0, 6.0, 1.0), (3, 5.0, 0.0, 6.0, 1.0), (4, 3.0, 3.0, 6.0, 6.0)])
    found = overlay.erase(a, boxes(spark, [(1, 0.0, 0.0, 5.0, 5.0)], "b")).df
    assert "__whole" in plan(found)
    assert {r[0]: r[1] for r in found.select("fid", g.area(F.col("geom"))).collect()} == {2: 1.0, 3: 1.0, 4: 5.0}


def test_a_rectangle_less_few(monkeypatch):
    monkeypatch.setattr(ar, "trace", None)  # no cells, no rings to follow
    a = ar.box(0, 0, 4, 4)
    for others, left in (([(0, 0, 4, 1)], 12), ([(0, 0, 9, 1), (3, -1, 9, 9)], 9), ([(2, 2, 9, 9)], 12), ([(-1, 3, 1, 5)], 15), ([(3, -1, 5, 1)], 15), ([(-1, -1, 1, 1)], 15), ([(-1, -1, 5, 5)], 0), ([(4, 0, 5, 4)], 16)):
        assert ar.area(ar.less(a, [ar.box(*o) for o in others])) == left


def test_polygons_are_spread_before_they_are_clipped(spark):
    found = extract.clip(boxes(spark, [(1, 0.0, 0.0, 2.0, 2.0)], rectangles=False), boxes(spark, [(1, 1.0, 1.0, 3.0, 3.0), (2, 0.0, 0.0, 1.0, 1.0)], "b", rectangles=False)).df
    text = plan(found)
    assert "REPARTITION_BY_NUM" in text[text.index("BroadcastNestedLoopJoin") :]
    assert found.select(F.sum(g.area(F.col("geom")))).first()[0] == 2.0
