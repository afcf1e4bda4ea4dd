"""A stream against a static layer equals the batch result."""

import pytest

from cartolith import layers as L
from cartolith import streaming
from cartolith.errors import OperationsError
from cartolith.operators import extract, features, overlay
from cartolith.plans import spatial_join

SF = "/root/testdata/sf0.001"


def streamed(spark):
    source = spark.readStream.schema(L.table(spark, SF, "customer").schema).parquet(f"{SF}/cust*")
    df = source.selectExpr("c_custkey AS fid", "cast(c_custkey % 100 + 0.5 AS double) AS x", "cast((c_custkey * 37 + c_custkey div 100) % 100 + 0.5 AS double) AS y")
    return features.xy_table_to_point(df, None, "x", "y", name="cust_p")


def run(layer, tmp_path):
    rows = []
    q = streaming.write(layer, lambda df, _: rows.extend(map(tuple, df.drop("geom").collect())), str(tmp_path))
    q.processAllAvailable()
    q.stop()
    return sorted(rows)


def test_stream_meets_static_tiles(spark, tmp_path):
    tiles = L.tiles(spark, SF)
    found = run(streaming.intersect(streamed(spark), tiles, "only_fid"), tmp_path)
    assert found == sorted(map(tuple, overlay.intersect(L.customers(spark, SF), tiles, "only_fid").df.drop("geom").collect()))


def test_stream_is_clipped(spark, tmp_path):
    tiles = L.tiles(spark, SF, even=True)
    found = run(streaming.clip_points(streamed(spark), tiles), tmp_path)
    assert [r[0] for r in found] == sorted(r.fid for r in extract.clip(L.customers(spark, SF), tiles).df.select("fid").collect())


def test_large_static_layers_are_refused(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "FEW", 3)
    with pytest.raises(OperationsError):
        streaming.intersect(streamed(spark), L.tiles(spark, SF))
    with pytest.raises(OperationsError):
        streaming.intersect(L.customers(spark, SF), L.tiles(spark, SF))
