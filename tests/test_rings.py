"""Kernels over whole batches of rings, against those for single shapes."""

import math
import random

import numpy as np
import pytest

from cartolith.functions.kernels import arrangement as ar
from cartolith.functions.kernels import bridge
from cartolith.functions.kernels import rings as rg
from cartolith.functions.kernels import shapes as sh
from cartolith.operators import check


def batch(shapes):
    return bridge.shapes(bridge.column_of(shapes))


def random_rings(seed, n, whole=True):
    rng = random.Random(seed)
    f = (lambda: float(rng.randint(0, 5))) if whole else (lambda: rng.uniform(0, 5))
    out = []
    for _ in range(n):
        v = [(f(), f()) for _ in range(rng.randint(3, 7))]
        out.append([[np.array(v + v[:1] if rng.random() < 0.8 else v)]])
    return out


def once(shape):
    return [p for p in ([check._once(r) for r in p] for p in shape) if p and len(p[0]) >= 3]


def same(a, b):
    a, b = a or [], b or []
    return ar.area(a) == pytest.approx(ar.area(b), abs=1e-9) and ar.area(ar.difference(a, b)) + ar.area(ar.difference(b, a)) < 1e-9 if a and b else ar.area(a) + ar.area(b) < 1e-9


@pytest.mark.parametrize("whole", (True, False))
def test_rings_made_valid_in_batches(whole):
    given = [*random_rings(3, 400, whole), [[ar.box(0, 0, 1, 1)[0][0], ar.box(2, 2, 3, 3)[0][0]]], [[ar.box(0, 0, 4, 4)[0][0], ar.box(1, 1, 3, 3)[0][0]]], ar.box(0, 0, 2, 3), [[ar.box(0, 0, 2, 3)[0][0][::-1]]]]
    found = rg.made_valid(batch(given))
    known = [(f, g) for f, g in zip(found, given) if f is not ...]
    assert len(known) > 30 and all(same(f, ar.make_valid(once(g))) for f, g in known)
    assert all(ar.signed_area(p[0]) > 0 for f, _ in known for p in f or [])
    assert [f is ... for f in found[400:]] == [False, True, False, False]
    bow = rg.made_valid(batch([[[np.array([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)])]]]))[0]
    assert len(bow) == 2 and ar.area(bow) == 2


@pytest.mark.parametrize("whole", (True, False))
def test_crossings_in_batches(whole):
    given = [*random_rings(5, 400, whole), None, [[np.array([(0.0, 0.0), (1.0, 1.0)])]], [ar.box(0, 0, 1, 1)[0], ar.box(0, 0, 1, 1)[0]], [[ar.box(0, 0, 1, 1)[0][0], ar.box(2, 2, 3, 3)[0][0]]], [[np.array([(0.0, 0.0), (np.nan, 1.0), (1.0, 1.0), (0.0, 0.0)])]]]
    wanted = check._TOPOLOGY
    found, single = check._topology_of(wanted)(batch(given)), check._topology(wanted)
    assert [f is ... for f in found[-5:]] == [False, False, False, False, True]
    assert all((f is None) == (single(g) is None) for f, g in zip(found, given) if f is not ...)
    assert 0 < sum(f is not None for f in found if f is not ...) < 400


def test_checks_are_spread_and_holes_told_apart(spark):
    from pyspark.sql import functions as F

    from cartolith import layers as L

    broken = L.broken_boxes(spark, "/root/testdata/sf0.001")
    found = check.check_geometry(broken)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 2 and "size(flatten" not in text.split("Generate")[0]
    assert {r[0] for r in found.where(F.col("ORIG_FID") % 7 == 4).select("REASON").collect()} == {"OUTSIDE_RING"}


@pytest.mark.parametrize("kind", ("rectangle_by_area", "rectangle_by_width"))
def test_smallest_rectangles_in_batches(kind):
    given = [*random_rings(9, 200), *random_rings(10, 200, False), ar.box(1, 2, 5, 4), None, [[np.array([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])]], [[sh.circle_ring(np.zeros(2), 1.0, 64)]]]
    found = rg.rectangles_of(batch(given), kind.endswith("width"))
    assert [f is ... for f in found[-4:]] == [False, True, True, True]
    for f, g in zip(found, given):
        if f is not ...:
            expected = sh.bounding(g, kind)[0]
            assert math.isclose(ar.area(f), ar.area(expected), rel_tol=1e-9)
            assert np.allclose(f[0][0], expected[0][0], atol=1e-9)
    assert sum(f is ... for f in found) < 40


def test_buffers_of_points_are_spread_first(spark):
    from pyspark.sql import functions as F

    from cartolith.functions import geometry as g
    from cartolith.model import POINT, FeatureFrame, FeatureMeta
    from cartolith.operators import proximity

    df = spark.createDataFrame([(1, 3.0, 4.0)], "fid long, x double, y double").select("fid", g.point(F.col("x"), F.col("y")).alias("geom"))
    found = proximity.buffer(FeatureFrame(df, FeatureMeta(POINT)), 2.0).df
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in text and "cos(" not in text.lower()
    (ring,) = found.first().geom[0]
    assert len(ring) == 129 and ring[0] == ring[-1] and (ring[0].x, ring[0].y) == (5.0, 4.0)
    assert np.allclose([(v.x, v.y) for v in ring], sh.disk(np.array([3.0, 4.0]), 2.0, 32)[0][0])
