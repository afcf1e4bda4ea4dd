"""Options, errors and schemas of the tools."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith import layers as L
from cartolith import names, settings, units
from cartolith.errors import ArgumentError, CoordinateSystemError, DimensionError, FieldError, OperationsError, UnitError
from cartolith.functions import geometry as g
from cartolith.functions.stats import Statistic
from cartolith.model import LINE, POLYGON, FeatureFrame, FeatureMeta
from cartolith.operators import extract, features, fields, general, generalization, overlay, projections, proximity, workspace
from cartolith.operators.common import attribute_names, AttributeOption
from cartolith.plans import spatial_join
from cartolith.sources import geopackage

SF = "/root/testdata/sf0.001"


def boxes(spark, rows, name="a", extra="tag string"):
    df = spark.createDataFrame(rows, f"fid long, x0 double, y0 double, x1 double, y1 double, {extra}")
    df = df.select("fid", g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("geom"), *[c for c in df.columns if c not in ("fid", "x0", "y0", "x1", "y1")])
    return FeatureFrame(df, FeatureMeta(POLYGON, name=name))


def test_names():
    assert names.valid_name(None, "fc") == "none" and names.valid_name("  ", "fc") == "empty"
    assert names.valid_name("1 a--b__c", "fc") == "fc_1_a_b_c" and names.valid_name("select", "t") == "t_select"
    assert names.unique_names(["ID", "id", "Id"]) == ["ID", "id_1", "Id_2"]


def test_units():
    assert units.parse("12 km").meters == 12_000 and units.parse("1.5 mi").meters == pytest.approx(2414.016)
    assert units.parse(3) == 3 and units.parse("4") == 4
    with pytest.raises(UnitError):
        units.parse("12 parsecs")


def test_distance_columns(spark):
    df = spark.createDataFrame([("12 km",), ("3",), ("x",), (None,), ("5 furlongs",)], "d string")
    assert [r[0] for r in df.select(units.meters_of(F.col("d"))).collect()] == [12_000, 3, None, None, None]


def test_settings_are_scoped():
    with settings.use(overwrite=True):
        assert settings.current().overwrite
    assert not settings.current().overwrite
    assert not settings.Extent.from_bounds(0, 0, float("nan"), 1) and settings.Extent.from_bounds(5, 6, 1, 2).xmin == 1
    assert settings.tolerance(-1) == 0


def test_output_names_avoid_clashes(spark):
    a, b = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0, "x")], "a", "id string"), boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0, "y")], "b", "ID string")
    left, right = attribute_names(a, b, AttributeOption.ALL)
    assert [n for _, n in left + right] == ["fid_a", "id", "fid_b", "ID_1"]
    assert overlay.intersect(a, b).df.columns == ["geom", "fid_a", "id", "fid_b", "ID_1"]
    assert overlay.intersect(a, a, "only_fid").df.columns == ["geom", "fid_a", "fid_a_1"]


def test_bad_predicates_and_fields(spark):
    with pytest.raises(OperationsError):
        extract.table_select(L.table(spark, SF, "nation"), "no such thing !!")
    with pytest.raises(FieldError):
        fields.delete_field(L.tiles(spark, SF), "geom")
    with pytest.raises(ArgumentError):
        fields.alter_field(L.table(spark, SF, "nation"), "n_name", "name", " ")
    with pytest.raises(FieldError):
        generalization.summarize(L.tiles(spark, SF), "n_regionkey", [Statistic("mean", "n_name")])
    with pytest.raises(DimensionError):
        extract.clip(L.tiles(spark, SF), L.customers(spark, SF))


def test_general_polygons_overlay_with_the_kernel(spark):
    a, b = boxes(spark, [(1, 0.0, 0.0, 4.0, 4.0, "p")]), boxes(spark, [(1, 1.0, 1.0, 2.0, 2.0, "q"), (2, 3.0, 3.0, 6.0, 6.0, "r"), (3, 4.0, 0.0, 5.0, 1.0, "touch")], "b")
    area = lambda layer: round(sum(r[0] for r in layer.df.select(g.area(F.col("geom"))).collect()), 9)
    assert area(extract.clip(a, b)) == 2 and area(overlay.erase(a, b)) == 14
    assert area(overlay.intersect(a, b)) == 2 and overlay.intersect(a, b).df.count() == 2
    assert area(overlay.symmetrical_difference(a, b)) == 14 + 8 + 1
    assert area(overlay.union(a, b)) == 16 + 8 + 1
    lines = overlay.intersect(a, boxes(spark, [(1, 4.0, 0.0, 6.0, 4.0, "z")], "b"), output_type_option="line")
    assert lines.df.select(g.length(F.col("geom"))).first()[0] == 4


def test_classic_overlay_repeats_self_overlaps(spark):
    a = boxes(spark, [(1, 0.0, 0.0, 2.0, 2.0, "p"), (2, 1.0, 0.0, 3.0, 2.0, "q")])
    b = boxes(spark, [(9, 0.0, 0.0, 3.0, 2.0, "r")], "b")
    rows = overlay.intersect(a, b, algorithm_option="classic").df.select("fid_a", g.area(F.col("geom")).alias("s")).collect()
    assert sorted((r[0], r[1]) for r in rows) == [(1, 2), (1, 2), (2, 2), (2, 2)]


def test_join_meets_brute_force_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "FEW", 0)
    rng = np.random.default_rng(0)
    make = lambda n, s: [(i, *map(float, (x, y, x + w, y + h)), "t") for i, (x, y, w, h) in enumerate(np.concatenate([rng.uniform(-50, 50, (n, 2)), rng.exponential(s, (n, 2))], axis=1).tolist())]
    p, q = make(120, 1.0), [*make(80, 3.0), (900, -60.0, -60.0, 60.0, 60.0, "t")]
    sides = [boxes(spark, rows).with_bbox().df.select(F.col("fid").alias("id"), F.col("bbox").alias("box")) for rows in (p, q)]
    found = [(r[0], r[1]) for r in spatial_join.join(*sides).select("l.id", "r.id").collect()]
    expected = {(a[0], b[0]) for a in p for b in q if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]}
    assert len(found) == len(set(found)) and set(found) == expected


def test_thiessen_with_many_tiles_fills_the_window(spark, monkeypatch):
    monkeypatch.setattr(proximity, "TILE_POINTS", 10)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (200, 2)) ** 1.5)], "fid long, x double, y double")
    p = features.xy_table_to_point(df, None, "x", "y")
    cells = proximity.create_thiessen_polygons(p, settings=settings.Settings(extent=settings.Extent(0, 0, 32, 32)))
    rows = cells.df.select("ORIG_FID", g.area(F.col("geom")).alias("s")).collect()
    assert len(rows) == 200 and sum(r.s for r in rows) == pytest.approx(32 * 32)


def test_buffers_in_groups_and_rings(spark):
    t = boxes(spark, [(1, 0.0, 0.0, 2.0, 2.0, "p"), (2, 1.0, 0.0, 3.0, 2.0, "p")])
    one = proximity.buffer(t, 1, dissolve_option="list", group_fields="tag").df
    assert one.count() == 1 and one.select(g.area(F.col("geom"))).first()[0] == pytest.approx(6 + 10 + 3.14, abs=0.01)
    rings = proximity.multiple_buffer(t, "meters", [-0.5, 1], field_name="d").df
    assert sorted(r[0] for r in rings.select("d").collect()) == ["-0.5 meters", "0 meters", "1 meters"]
    assert sum(r[0] for r in rings.select(g.area(F.col("geom"))).collect()) == pytest.approx(6 + 10 + 3.14, abs=0.01)
    assert proximity.ring_distances([1, -1], True, False, False) == [-1, 0, 1] and proximity.ring_distances([-1, 2, 1], False, True, False) == [1, 2]


def test_dissolve_of_large_groups_goes_in_levels(spark, monkeypatch):
    monkeypatch.setattr(generalization, "FAN_IN", 4)
    t = boxes(spark, [(i, float(i), 0.0, i + 1.5, 1.0, "p") for i in range(30)])
    d = generalization.dissolve(t, "tag", [Statistic("count", "tag")]).df
    row = d.select(g.area(F.col("geom")).alias("s"), F.size("geom").alias("n"), "COUNT_tag").first()
    assert row.s == pytest.approx(30.5) and row.n == 1 and row.COUNT_tag == 30


def test_end_times_end_with_null(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 3, None), (3, 9, None)], "fid long, s int, e int")
    got = lambda d: {r.fid: r.e for r in d.collect()}
    assert got(fields.calculate_end_time(df, "s", "e")) == {1: 3, 2: 9, 3: None}
    assert got(fields.calculate_end_time(df, "s", "e", "s")) == {2: 5, 1: 9, 3: None}


def test_identical_geometry_whatever_its_start(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    ring = lambda k, back: [v for v in ((square[k:] + square[:k])[::-1] if back else square[k:] + square[:k])]
    rows = []
    for fid, k, back in ((1, 0, False), (2, 2, False), (3, 1, True)):
        r = ring(k, back)
        rows.append((fid, [[[(x, y, None, None) for x, y in [*r, r[0]]]]]))
    rows.append((4, [[[(x + 1e-4, y, None, None) for x, y in [*square, square[0]]]]]))
    f = FeatureFrame(spark.createDataFrame(rows, f"fid long, geom {g.GEOMETRY}"), FeatureMeta(POLYGON))
    pairs = lambda d: sorted((r[0], r[1]) for r in d.collect())
    assert pairs(general.find_identical(f, (), True)) == [(1, 2), (1, 3)]
    assert (1, 4) in pairs(general.find_identical(f, (), True, xy_tolerance=0.01))


def test_projections_round_trip(spark):
    for code in ("EPSG:3857", "EPSG:32633", "EPSG:32733"):
        lat = -33.0 if code.startswith("EPSG:327") else 48.0
        x, y = projections.transform("EPSG:4326", code, 14.5, lat, floats=True)
        assert projections.transform(code, "EPSG:4326", x, y, floats=True) == pytest.approx((14.5, lat), abs=1e-8)
    assert projections.transform("EPSG:4326", "EPSG:32633", 15.0, 0.0, floats=True) == pytest.approx((500_000, 0), abs=1e-6)
    with pytest.raises(CoordinateSystemError):
        projections.transform("EPSG:4326", "EPSG:4617", 0, 0, floats=True)


def test_lines_and_geodesic_paths(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "fid long, a double, b double, c double, d double")
    flat = features.xy_to_line(df, "EPSG:4326", "a", "b", "c", "d", "planar", 4)
    assert flat.df.select(F.size(g.vertices(F.col("geom")))).first()[0] == 6 and flat.meta.shape_type == LINE
    bent = features.xy_to_line(df, "EPSG:4326", "a", "b", "c", "d")
    assert bent.df.select(F.size(g.vertices(F.col("geom")))).first()[0] == 11
    with pytest.raises(CoordinateSystemError):
        features.xy_to_line(df, "EPSG:3857", "a", "b", "c", "d", "geodesic")


def test_workspaces_and_geopackages(spark, tmp_path):
    ws = workspace.create_workspace(str(tmp_path / "ws"))
    t = L.tiles(spark, SF)
    workspace.save(t, ws, "my tiles")
    with pytest.raises(OperationsError):
        workspace.save(t, ws, "my tiles")
    back = workspace.load(spark, ws, "my_tiles")
    assert back.meta.name == "my_tiles" and back.df.count() == 25 and "bbox" in back.df.columns
    assert workspace.rename(ws, "my_tiles", "other") == "other" and workspace.delete(ws, "other") and not workspace.delete(ws, "other")
    path = str(tmp_path / "a.gpkg")
    assert workspace.feature_class_to_geopackage([t, t], path) == ["nation_tile_a", "nation_tile_a_1"]
    read = geopackage.read(spark, path, "nation_tile_a")
    assert read.meta.shape_type == POLYGON and read.df.select(F.sum(g.area(F.col("geom")))).first()[0] == 10_000
    empty = workspace.create_feature_class(spark, "fresh", "EPSG:4326", [("a", "int")])
    assert empty.df.count() == 0 and workspace.create_table(spark, [("b", "string")]).columns == ["fid", "b"]


def test_row_local_tools_stream(spark, tmp_path):
    schema = L.table(spark, SF, "customer").schema
    source = spark.readStream.schema(schema).parquet(f"{SF}/customer.parquet/../cust*")
    points = features.xy_table_to_point(source.withColumn("x", (F.col("c_custkey") % 10).cast("double")).withColumn("y", F.lit(1.0)), None, "x", "y")
    q = extract.select(points, "x > 4").df.select("c_custkey").writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("streamed").count() == L.table(spark, SF, "customer").where("c_custkey % 10 > 4").count()


def test_positioning_fields_and_units(spark):
    p = L.customers(spark, SF)
    assert len(set(fields.add_gps_metadata_fields(p).df.columns) - set(p.df.columns)) == 22
    t = L.tiles(spark, SF)
    added = fields.add_gps_metadata_fields(t).df
    assert len(set(added.columns) - set(t.df.columns)) == 26 and added.schema["GNSS_SPEED"].metadata["alias"] == "Speed (km/h)"
    assert units.length_factor("MILES_US") == pytest.approx(1609.3472187) and units.area_factor("SQUARE_KILOMETERS") == 1e6 and units.area_factor("acres_us") == pytest.approx(4046.8726)
    assert units.parse("2 nautical_miles_international").meters == 3704 and units.parse("1 degrees").angular


def test_attributes_fit_the_shape(spark):
    t = L.tiles(spark, SF)
    t = t.with_df(t.df.withColumn("v", F.lit(0.0)))
    with pytest.raises(ArgumentError):
        features.calculate_geometry_attributes(t, "v", "line_start_x")
    with pytest.raises(FieldError):
        features.calculate_geometry_attributes(t, "n_name", "area")
    assert {r.v for r in features.calculate_geometry_attributes(t, "V", "INSIDE_X").df.collect()} == {10, 30, 50, 70, 90}


def test_conics_in_columns_and_floats(spark):
    assert projections.transform("EPSG:4171", "EPSG:2154", 2.3522, 48.8566, floats=True) == pytest.approx((652_469.02, 6_862_035.26), abs=0.01)
    for geographic, code, x, y in (("EPSG:4269", "EPSG:3347", -100.0, 55.0), ("EPSG:4269", "EPSG:5070", -100.0, 40.0), ("EPSG:4617", "EPSG:2959", -76.0, 45.0), ("EPSG:4326", "EPSG:32736", 33.0, -20.0)):
        df = spark.createDataFrame([(1, x, y)], "fid long, x double, y double")
        p = features.xy_table_to_point(df, geographic, "x", "y")
        there = projections.project(p, code)
        v = g.first_vertex(F.col("geom"))
        a, b = there.df.select(v["x"], v["y"]).first(), projections.project(there, geographic).df.select(v["x"], v["y"]).first()
        assert tuple(a) == pytest.approx(projections.transform(geographic, code, x, y, floats=True), abs=1e-4)
        assert tuple(b) == pytest.approx((x, y), abs=1e-8)


def test_many_operators_are_united_in_levels(spark, monkeypatch):
    monkeypatch.setattr(spatial_join, "FEW", 3)
    monkeypatch.setattr(generalization, "FAN_IN", 4)
    big = boxes(spark, [(1, 0.0, 0.0, 20.0, 10.0, "p")])
    ops = boxes(spark, [(i, float(i), 0.0, i + 1.5, 5.0, "q") for i in range(15)], "b")
    area = lambda layer: round(sum(r[0] for r in layer.df.select(g.area(F.col("geom"))).collect()), 9)
    assert area(overlay.erase(big, ops)) == 200 - 15.5 * 5 and area(extract.clip(big, ops)) == 15.5 * 5
    plain = FeatureFrame(big.df, FeatureMeta(POLYGON, rectangles=True)), FeatureFrame(ops.df, FeatureMeta(POLYGON, rectangles=True))
    assert area(extract.clip(*plain)) == 15.5 * 5
    assert area(extract.split(big, ops, "tag")) == 15.5 * 5


def test_end_times_over_many_ranges(spark):
    """What one window over everything gives, twice: bounds mustn't move between uses."""
    df = spark.range(300_000).selectExpr("id as fid", "cast(hash(id) % 1000 as int) as k", "cast(id * 7 as bigint) as start", "cast(null as bigint) as end")
    df = df.withColumn("k", F.when(F.col("k") % 50 == 0, None).otherwise(F.col("k")))
    expected = df.toPandas().sort_values(["k", "fid"], na_position="first")
    expected["end"] = expected["start"].shift(-1)
    for _ in range(2):
        found = fields.calculate_end_time(df, "start", "end", ["k"]).select("fid", "end").toPandas().set_index("fid")["end"]
        assert found.isna().sum() == 1 and (found.reindex(expected["fid"]).fillna(-1).to_numpy() == expected["end"].fillna(-1).to_numpy()).all()


def test_identity_within_a_tolerance_is_greedy_by_id(spark):
    import random

    rng = random.Random(3)
    for tol, n in ((1.0, 12), (0.8, 80)):
        at = [(i + 1, float(i) if n == 12 else rng.uniform(0, 12), 0.0 if n == 12 else rng.uniform(0, 2)) for i in range(n)]
        points = features.xy_table_to_point(spark.createDataFrame(at, "fid long, x double, y double"), None, "x", "y")
        found = sorted(map(tuple, general.find_identical(points, (), include_geometry=True, xy_tolerance=tol).collect()))
        taken, expected = set(), []
        for i, x, y in at:
            if i in taken:
                continue
            for j, u, v in at:
                if j > i and j not in taken and abs(x - u) <= tol and abs(y - v) <= tol:
                    taken.add(j)
                    expected.append((i, j))
        assert found == sorted(expected) and expected


def test_lines_over_lines(spark):
    lines = lambda *rows: FeatureFrame(spark.createDataFrame([(i, [[[(float(x), float(y), None, None) for x, y in r]] for r in parts]) for i, parts in rows], f"fid long, geom {g.GEOMETRY}"), FeatureMeta("MultiLineString", name="l"))
    source = lines((1, [[(0, 0), (10, 0), (10, 10)]]), (2, [[(0, 5), (10, 5)]]))
    operator = lines((1, [[(-5, 0), (4, 0)]]), (2, [[(2, 0), (6, 0)]]), (3, [[(10, 2), (10, 20)]]), (4, [[(5, -5), (5, 9)]]))
    length = lambda layer: {r.fid: r.n for r in layer.df.select("fid", g.length(F.col("geom")).alias("n")).collect()}
    assert length(extract.clip(source, operator)) == {1: 6 + 8}
    assert length(overlay.erase(source, operator)) == {1: 4 + 2, 2: 10}
    parts = extract.clip(source, operator).df.select(F.size("geom").alias("n")).first().n
    assert parts == 2


def test_pieces_are_merged_to_lines():
    from cartolith.functions.kernels import arrangement as ar

    star = np.array([(0, 0, 1, 0), (1, 0, 2, 0), (2, 0, 2, 1), (2, 0, 3, 0), (5, 5, 6, 5), (6, 5, 6, 6), (5, 5, 6, 6)], float)
    found = ar.merged(star, 1e-9)
    assert sorted(len(p[0]) for p in found) == [2, 2, 3, 4]
    assert any((p[0][0] == p[0][-1]).all() for p in found)
