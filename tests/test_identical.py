"""Identity within a tolerance, against greedy choice by id in Python."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith.functions import geometry as g
from cartolith.model import POINT, FeatureFrame, FeatureMeta
from cartolith.operators import general


def greedy(rows, tol):
    heads, out = [], []
    for i, x, y in sorted(rows):
        head = next((h for h in heads if abs(h[1] - x) <= tol and abs(h[2] - y) <= tol), None)
        if head:
            out.append((head[0], i))
        else:
            heads.append((i, x, y))
    return sorted(out)


def identical(spark, rows, tol):
    df = spark.createDataFrame(rows, "fid long, x double, y double").select("fid", g.point(F.col("x"), F.col("y")).alias("geom"))
    found = general.find_identical(FeatureFrame(df, FeatureMeta(POINT)), (), include_geometry=True, xy_tolerance=tol)
    return sorted((r.ORIG_FID, r.REPEAT_FID) for r in found.collect())


def test_a_row_goes_to_the_first_head_that_it_equals(spark):
    """4 is known to be a head before 3 is, but 3 comes first."""
    rows = [(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 1.8, 0.0), (10, 2.7, 0.0), (4, 3.6, 0.0)]
    assert identical(spark, rows, 1.0) == greedy(rows, 1.0) == [(1, 2), (3, 10)]


@pytest.mark.parametrize("wide", (0.2, 3.0))
def test_clusters_of_random_points(spark, wide):
    """Dense ones (all pairs are near), and chains; whole places repeated."""
    rng = random.Random(7)
    rows = [(i, round(rng.uniform(-wide, wide), 2), round(rng.uniform(-wide, wide), 2)) for i in rng.sample(range(1000), 120)]
    assert identical(spark, rows, 0.5) == greedy(rows, 0.5)
