"""Thiessen polygons of crowded points: tiles by quantiles, against cells among all points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.functions.kernels import arrangement as ar
from cartolith.functions.kernels import shapes as sh
from cartolith.model import POINT, FeatureFrame, FeatureMeta
from cartolith.operators import proximity


def crowded(n):
    rng = np.random.default_rng(5)
    return np.vstack([rng.normal(0, 0.01, (n, 2)), rng.normal(0, 5, (n // 4, 2)), [[40.0, 40.0], [-40.0, 3.0]]])


def cell(points, k, window):
    others = points[np.argsort(((points - points[k]) ** 2).sum(axis=1), kind="stable")]
    return ar.area([[sh.closed(sh.voronoi_cell(points[k], others, window))]])


def test_sites_look_only_around_themselves():
    points, window = crowded(200), (-50.0, -50.0, 50.0, 50.0)
    found = sh.voronoi_cells(points, 120, window)
    assert len(found) == 120
    assert np.allclose([ar.area([[sh.closed(r)]]) for r in found], [cell(points, k, window) for k in range(120)], rtol=1e-9)


def test_tiles_of_crowded_points_are_even(spark, monkeypatch):
    monkeypatch.setattr(proximity, "TILE_POINTS", 20)
    points = crowded(160)
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "id long, x double, y double")
    xs, ys = proximity._bounds(df, len(points))
    i = np.searchsorted(xs, points[:, 0], side="right")
    j = [np.searchsorted(ys[a], y, side="right") for a, y in zip(i, points[:, 1])]
    assert np.unique(np.stack([i, j]), axis=1, return_counts=True)[1].max() <= 40
    layer = FeatureFrame(df.select(F.col("id").alias("fid"), g.point(F.col("x"), F.col("y")).alias("geom")), FeatureMeta(POINT))
    found = {r[0]: r[1] for r in proximity.create_thiessen_polygons(layer).df.select("ORIG_FID", g.area(F.col("geom"))).collect()}
    (x0, y0), (x1, y1) = points.min(axis=0), points.max(axis=0)
    window = (x0 - 0.05 * (x1 - x0), y0 - 0.05 * (y1 - y0), x1 + 0.05 * (x1 - x0), y1 + 0.05 * (y1 - y0))
    assert len(found) == len(points)
    assert all(found[k] == pytest.approx(cell(points, k, window), rel=1e-6, abs=1e-12) for k in range(0, len(points), 5))
