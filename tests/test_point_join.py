"""Points over points, lines and polygons: decided by place, without Python on the executors."""

import pytest
from pyspark.sql import functions as F

from cartolith import layers as L
from cartolith.functions import geometry as g
from cartolith.model import LINE, MULTIPOINT, POINT, FeatureFrame, FeatureMeta
from cartolith.operators import extract, overlay
from cartolith.plans import spatial_join

SF = "/root/testdata/sf0.001"


def multipoints(spark, rows, name="m"):
    df = spark.createDataFrame(rows, "fid long, at array<struct<x:double,y:double>>")
    return FeatureFrame(df.select("fid", F.transform("at", lambda v: F.array(F.array(g.vertex(v["x"], v["y"])))).alias("geom")), FeatureMeta(MULTIPOINT, name=name))


def points(spark, rows, name="p"):
    df = spark.createDataFrame(rows, "fid long, x double, y double")
    return FeatureFrame(df.select("fid", g.point(F.col("x"), F.col("y")).alias("geom")), FeatureMeta(POINT, name=name))


def lines(spark, rows, name="l"):
    df = spark.createDataFrame(rows, "fid long, at array<struct<x:double,y:double>>")
    return FeatureFrame(df.select("fid", g.line(F.transform("at", lambda v: g.vertex(v["x"], v["y"]))).alias("geom")), FeatureMeta(LINE, name=name))


def plan(df):
    return df._jdf.queryExecution().toString()


def places(df):
    return {r.fid: [(p[0][0].x, p[0][0].y) for p in r.geom] for r in df.collect()}


def test_points_over_multipoints_join_by_place(spark):
    found = overlay.intersect(points(spark, [(1, 1.0, 1.0), (2, 2.0, 2.0), (3, -0.0, 5.0)]), multipoints(spark, [(7, [(1.0, 1.0), (1.0, 1.0), (0.0, 5.0)]), (8, [(1.0, 1.0)])]), "only_fid").df
    assert "MapInArrow" not in plan(found)
    assert sorted((r.fid_p, r.fid_m) for r in found.collect()) == [(1, 7), (1, 8), (3, 7)]


def test_clip_keeps_equal_points_of_a_feature(spark):
    """On the edge of two tiles, too, each comes once and in its order."""
    found = extract.clip(multipoints(spark, [(1, [(5.0, 5.0), (20.0, 5.0), (5.0, 5.0), (500.0, 5.0)])]), L.tiles(spark, SF)).df
    assert places(found) == {1: [(5.0, 5.0), (20.0, 5.0), (5.0, 5.0)]}


@pytest.mark.parametrize("few", (0, 1000))
def test_exact_tests_wait_for_the_boxes(spark, monkeypatch, few):
    monkeypatch.setattr(spatial_join, "FEW", few)
    side = spark.range(8).select("id", F.struct(F.col("id").cast("double").alias("xmin"), F.lit(0.0).alias("ymin"), (F.col("id") + 0.5).alias("xmax"), F.lit(1.0).alias("ymax")).alias("box"))
    alone = lambda l, r: F.when(l["id"] == r["id"], True).otherwise(F.raise_error(F.lit("boxes apart")).cast("boolean"))
    assert spatial_join.join(side, side, exact=alone).count() == 8


def test_a_point_has_a_box_without_lambdas(spark):
    p = points(spark, [(1, 1.0, 2.0), (2, float("nan"), 3.0), (3, None, 4.0)])
    found = p.df.select("fid", p.box.alias("b"))
    assert "lambda" not in plan(found)
    assert {r.fid: tuple(r.b) for r in found.collect()} == {1: (1.0, 2.0, 1.0, 2.0), 2: (None, 3.0, None, 3.0), 3: (None, 4.0, None, 4.0)}


def test_multipoints_over_lines_come_together_at_the_end(spark):
    m = multipoints(spark, [(1, [(1.0, 0.0), (9.0, 9.0), (0.5, 0.0), (1.0, 0.0)]), (2, [(3.0, 3.0)]), (3, [(1.0, 4.0)])])
    l = lines(spark, [(5, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (3.0, 3.0)]), (6, [(1.0, 4.0)])])
    found = overlay.intersect(m, l, "only_fid").df
    assert "MapInArrow" not in plan(found)
    assert {(r.fid_m, r.fid_l): [(p[0][0].x, p[0][0].y) for p in r.geom] for r in found.collect()} == {(1, 5): [(1.0, 0.0), (0.5, 0.0), (1.0, 0.0)], (2, 5): [(3.0, 3.0)], (3, 6): [(1.0, 4.0)]}


def test_points_clipped_by_points_by_place(spark):
    found = extract.clip(points(spark, [(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 1.0, 1.0)]), points(spark, [(7, 1.0, 1.0), (8, 1.0, 1.0)])).df
    assert "MapInArrow" not in plan(found)
    assert sorted(r.fid for r in found.collect()) == [1, 3]


def test_points_erased_by_points_by_place(spark):
    found = overlay.erase(multipoints(spark, [(1, [(1.0, 1.0), (2.0, 2.0), (2.0, 2.0)]), (2, [(1.0, 1.0)])]), points(spark, [(7, 1.0, 1.0), (8, 1.0, 1.0)])).df
    assert "MapInArrow" not in plan(found)
    assert places(found) == {1: [(2.0, 2.0), (2.0, 2.0)]}
