"""The registered queries of the geoprocessing tools, and their SQL."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layers as L
from .functions import geometry as g
from .functions.stats import Statistic
from .model import FeatureFrame
from .operators import check, extract, features, fields, general, generalization, indexes, overlay, projections, proximity, workspace
from .plans import spatial_join
from .settings import Extent, Settings
from .sources import geopackage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

OB = """ob AS (SELECT o_orderkey AS fid, o_custkey, o_orderstatus, (o_orderkey % 97)::DOUBLE AS x0, ((o_orderkey // 97) % 89)::DOUBLE AS y0,
  (o_orderkey % 97 + 1 + o_custkey % 4)::DOUBLE AS x1, ((o_orderkey // 97) % 89 + 1 + o_orderkey % 3)::DOUBLE AS y1 FROM orders)"""
TL = """tl AS (SELECT n_nationkey::BIGINT AS fid, n_name, n_regionkey, (20 * (n_nationkey % 5))::DOUBLE AS x0, (20 * (n_nationkey // 5))::DOUBLE AS y0,
  (20 * (n_nationkey % 5) + 20)::DOUBLE AS x1, (20 * (n_nationkey // 5) + 20)::DOUBLE AS y1 FROM nation)"""
CP = "cp AS (SELECT c_custkey AS fid, c_nationkey, c_acctbal, c_mktsegment, (c_custkey % 100 + 0.5)::DOUBLE AS x, ((c_custkey * 37 + c_custkey // 100) % 100 + 0.5)::DOUBLE AS y FROM customer)"
TR = "tr AS (SELECT user_id AS fid, (event_id % 64)::DOUBLE AS x, floor(value)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
MEET = "greatest(b.x0, t.x0) < least(b.x1, t.x1) AND greatest(b.y0, t.y0) < least(b.y1, t.y1)"
SHARED = "(least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0))"


def query(sql: str | None = None, name: str | None = None):
    """Register a query and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def xy(geom: str = "geom") -> list:
    v = g.first_vertex(F.col(geom))
    return [v["x"].alias("x"), v["y"].alias("y")]


# --- selection and rows


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def table_select(spark, sf_dir):
    return extract.table_select(L.table(spark, sf_dir, "customer"), "c_acctbal > 5000 AND c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")


@query(f"WITH {CP} SELECT fid, x, y FROM cp WHERE x BETWEEN 20 AND 60 AND y BETWEEN 30 AND 70 AND c_acctbal > 0")
def select_extent(spark, sf_dir):
    return extract.select(L.customers(spark, sf_dir), "c_acctbal > 0", Settings(extent=Extent(20, 30, 60, 70))).df.select("fid", *xy())


@query(f"WITH {OB} SELECT fid, (x1 - x0) * (y1 - y0) AS area FROM ob WHERE o_orderstatus = 'F' AND x0 <= 50 AND x1 >= 30 AND y0 <= 45 AND y1 >= 20")
def copy_features(spark, sf_dir):
    s = Settings(extent=Extent(30, 20, 50, 45))
    return extract.copy_features(L.order_boxes(spark, sf_dir), "o_orderstatus = 'F'", s).df.select("fid", g.area(F.col("geom")).alias("area"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0 OR s_nationkey IN (1, 2, 3)")
def copy_rows(spark, sf_dir):
    return extract.copy_rows(L.table(spark, sf_dir, "supplier"), "s_acctbal < 0 OR s_nationkey IN (1, 2, 3)").select("s_suppkey", "s_name")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 25)", name="copy_table")
def copy_table(spark, sf_dir):
    return extract.copy(L.table(spark, sf_dir, "part"), "NOT (p_size > 25)").select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000 OR o_orderstatus = 'O', false)")
def delete_rows(spark, sf_dir):
    return extract.delete_rows(L.table(spark, sf_dir, "orders"), "o_totalprice > 100000 OR o_orderstatus = 'O'").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE false")
def truncate_table(spark, sf_dir):
    return extract.truncate_table(L.table(spark, sf_dir, "orders")).select("o_orderkey")


@query("SELECT count(*) AS n FROM lineitem")
def get_count(spark, sf_dir):
    return spark.createDataFrame([(extract.get_count(L.table(spark, sf_dir, "lineitem")),)], "n long")


@query("SELECT c_nationkey, c_mktsegment, dense_rank() OVER (ORDER BY c_nationkey NULLS FIRST, c_mktsegment NULLS FIRST)::INTEGER AS split_id, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment")
def split_by_attributes(spark, sf_dir):
    found = extract.split_by_attributes(L.table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"])
    return found.groupBy("c_nationkey", "c_mktsegment", "split_id").agg(F.count("*").alias("n"))


# --- fields


@query("SELECT n_nationkey, NULL::INTEGER AS rank, NULL::VARCHAR AS note FROM nation")
def add_field(spark, sf_dir):
    return fields.add_field(L.table(spark, sf_dir, "nation"), [("rank", "int"), ("note", "string"), ("N_NAME", "int")]).select("n_nationkey", "rank", "note")


@query("SELECT n_nationkey, n_name FROM nation")
def delete_field(spark, sf_dir):
    return fields.delete_field(L.table(spark, sf_dir, "nation"), "N_REGIONKEY").select("n_nationkey", "n_name")


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size * 2 + 1 ELSE p_size END::INTEGER AS p_size FROM part")
def calculate_field(spark, sf_dir):
    return fields.calculate_field(L.table(spark, sf_dir, "part"), "P_SIZE", "p_size * 2 + 1", "p_size > 10").select("p_partkey", "p_size")


@query("SELECT r_regionkey, r_name AS region_name FROM region")
def alter_field(spark, sf_dir):
    return fields.alter_field(L.table(spark, sf_dir, "region"), "r_name", "name", "region_name")


@query("SELECT event_id, lead(ts) OVER (ORDER BY user_id, ts, event_id) AS end_ts FROM events")
def calculate_end_time(spark, sf_dir):
    df = L.table(spark, sf_dir, "events").withColumnRenamed("event_id", "fid")
    df = df.withColumn("end_ts", F.lit(None).cast(df.schema["ts"].dataType))
    return fields.calculate_end_time(df, "ts", "end_ts", ["user_id", "ts"]).select(F.col("fid").alias("event_id"), "end_ts")


_GPS = {"VARCHAR": "POSITIONSOURCETYPE RECEIVER FIXTYPE", "DOUBLE": "LATITUDE LONGITUDE ALTITUDE H_RMS V_RMS CORRECTIONAGE PDOP HDOP VDOP DIRECTION SPEED AVG_H_RMS AVG_V_RMS H_STDDEV", "TIMESTAMP": "FIXDATETIME", "BIGINT": "STATIONID NUMSATS AVG_POSITIONS"}


@query(f"""WITH {CP} SELECT fid, NULL::DOUBLE AS "SNSR_AZIMUTH", {", ".join(f'NULL::{kind} AS "GNSS_{n}"' for kind, names in _GPS.items() for n in names.split())} FROM cp""")
def add_gps_metadata_fields(spark, sf_dir):
    d = fields.add_gps_metadata_fields(L.customers(spark, sf_dir)).df
    return d.drop("geom", "c_nationkey", "c_acctbal", "c_mktsegment", "x", "y")


# --- identical rows

_FIRST = "WITH f AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS o FROM customer)"


@query(f"{_FIRST} SELECT o AS \"ORIG_FID\", c_custkey AS \"REPEAT_FID\" FROM f WHERE o <> c_custkey")
def find_identical(spark, sf_dir):
    return general.find_identical(L.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "fid"), ["c_nationkey", "c_mktsegment"])


@query(f"{_FIRST} SELECT c_custkey FROM f WHERE o = c_custkey")
def delete_identical(spark, sf_dir):
    df = L.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "fid")
    return general.delete_identical(df, ["c_nationkey", "c_mktsegment"]).select(F.col("fid").alias("c_custkey"))


@query(f'WITH {OB}, f AS (SELECT fid, min(fid) OVER (PARTITION BY x0, y0, x1, y1) AS o FROM ob) SELECT o AS "ORIG_FID", fid AS "REPEAT_FID" FROM f WHERE o <> fid')
def find_identical_geometry(spark, sf_dir):
    return general.find_identical(L.order_boxes(spark, sf_dir), (), include_geometry=True)


# --- dissolve and statistics


@query("""SELECT l_returnflag, l_linestatus, avg(l_quantity) AS "AVG_l_quantity", median(l_quantity) AS "MEDIAN_l_quantity", min(l_quantity) AS "MIN_l_quantity", max(l_quantity) AS "MAX_l_quantity",
  max(l_quantity) - min(l_quantity) AS "RANGE_l_quantity", round(stddev_samp(l_quantity), 6) AS "STDEV_l_quantity", round(var_samp(l_quantity), 6) AS "VAR_l_quantity", sum(l_quantity) AS "SUM_l_quantity",
  count(l_quantity) AS "COUNT_l_quantity", count(DISTINCT l_quantity) AS "UNIQUE_l_quantity" FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def dissolve_stats_numeric(spark, sf_dir):
    kinds = "average median minimum maximum range standard_deviation variance summation count unique".split()
    df = L.table(spark, sf_dir, "lineitem").withColumn("fid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    out = generalization.summarize(df, ["l_returnflag", "l_linestatus"], [Statistic(k, "l_quantity") for k in kinds])
    return out.withColumn("STDEV_l_quantity", F.round("STDEV_l_quantity", 6)).withColumn("VAR_l_quantity", F.round("VAR_l_quantity", 6))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS f FROM customer GROUP BY ALL),
  m AS (SELECT c_nationkey, c_mktsegment AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, f) AS r FROM c)
  SELECT c.c_nationkey, any_value(m.v) AS "MODE_c_mktsegment", arg_min(c.c_mktsegment, c.c_custkey) AS "FIRST_c_mktsegment", arg_max(c.c_mktsegment, c.c_custkey) AS "LAST_c_mktsegment",
  string_agg(c.c_mktsegment, ';' ORDER BY c.c_custkey) AS "CONCAT_c_mktsegment" FROM customer c JOIN m ON m.c_nationkey = c.c_nationkey AND m.r = 1 GROUP BY c.c_nationkey""")
def dissolve_stats_text(spark, sf_dir):
    df = L.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "fid")
    return generalization.summarize(df, "c_nationkey", [Statistic("mode", "c_mktsegment"), Statistic("first", "c_mktsegment"), Statistic("last", "c_mktsegment"), Statistic("concatenate", "c_mktsegment", ";")])


@query("SELECT n_regionkey, 400.0::DOUBLE * count(*) AS area, count(*) AS \"COUNT_n_name\" FROM nation GROUP BY n_regionkey")
def dissolve_area(spark, sf_dir):
    d = generalization.dissolve(L.tiles(spark, sf_dir), "n_regionkey", [Statistic("count", "n_name")])
    return d.df.select("n_regionkey", g.area(F.col("geom")).alias("area"), "COUNT_n_name")


# --- points, lines, parts


@query("SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def xy_table_to_point(spark, sf_dir):
    return features.xy_table_to_point(L.table(spark, sf_dir, "lineitem"), None, "L_QUANTITY", "l_extendedprice").df.select("l_orderkey", "l_linenumber", *xy())


@query("""SELECT l_orderkey, l_linenumber, i::INTEGER AS i, l_linenumber + (l_suppkey - l_linenumber) * i / 4.0 AS x, l_quantity + 1.0 * i / 4.0 AS y FROM lineitem, range(0, 5) r(i)""")
def xy_to_line_planar(spark, sf_dir):
    df = L.table(spark, sf_dir, "lineitem").withColumn("qend", F.col("l_quantity") + 1)
    out = features.xy_to_line(df, None, "l_linenumber", "l_quantity", "l_suppkey", "qend", "planar", 3)
    return out.df.select("l_orderkey", "l_linenumber", F.posexplode(g.vertices(F.col("geom"))).alias("i", "v")).select("l_orderkey", "l_linenumber", "i", "v.x", "v.y")


@query(f'WITH {OB} SELECT o_custkey AS "ORIG_FID", count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area FROM ob GROUP BY o_custkey')
def multipart_to_singlepart(spark, sf_dir):
    d = features.multipart_to_singlepart(L.order_parts(spark, sf_dir)).df
    return d.groupBy("ORIG_FID").agg(F.count("*").alias("n"), F.sum(g.area(F.col("geom"))).alias("area"))


@query(f'WITH {TR} SELECT fid AS "ORIG_FID", x, y FROM tr WHERE n > 1')
def feature_vertices_all(spark, sf_dir):
    return features.feature_vertices_to_points(L.tracks(spark, sf_dir)).df.select("ORIG_FID", *xy())


@query(f'WITH {TR} SELECT fid AS "ORIG_FID", x, y FROM tr WHERE n > 1 AND seq = 1')
def feature_vertices_start(spark, sf_dir):
    return features.feature_vertices_to_points(L.tracks(spark, sf_dir), "START").df.select("ORIG_FID", *xy())


@query(f'WITH {TR} SELECT fid AS "ORIG_FID", x, y FROM tr WHERE n > 1 AND (seq = 1 OR seq = n)')
def feature_vertices_both_ends(spark, sf_dir):
    return features.feature_vertices_to_points(L.tracks(spark, sf_dir), "both_ends").df.select("ORIG_FID", *xy())


@query(f"""WITH {OB} SELECT fid AS "ORIG_FID", CASE WHEN (x1 - x0) >= (y1 - y0) THEN x1 ELSE x1 END AS x, y1 AS y FROM ob""")
def feature_vertices_mid(spark, sf_dir):
    """Half way around a rectangle from its lower left corner is the upper right one."""
    return features.feature_vertices_to_points(L.order_boxes(spark, sf_dir), "mid").df.select("ORIG_FID", *xy())


@query(f"""WITH {TR}, s AS (SELECT fid, seq, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM tr WHERE n > 1 WINDOW w AS (PARTITION BY fid ORDER BY seq))
  SELECT fid AS "ORIG_FID", seq::INTEGER AS "ORIG_SEQ", x, y, x2, y2 FROM s WHERE x2 IS NOT NULL""")
def split_line_at_vertices(spark, sf_dir):
    d = features.split_line_at_vertices(L.tracks(spark, sf_dir)).df
    last = g.last_vertex(F.col("geom"))
    return d.select("ORIG_FID", "ORIG_SEQ", *xy(), last["x"].alias("x2"), last["y"].alias("y2"))


@query(f'WITH {OB} SELECT fid AS "ORIG_FID", 2 * (x1 - x0 + y1 - y0) AS length FROM ob')
def polygon_to_line(spark, sf_dir):
    return features.polygon_to_line(L.order_boxes(spark, sf_dir)).df.select("ORIG_FID", g.length(F.col("geom")).alias("length"))


# --- envelopes and bounding shapes

_TRB = f"WITH {TR}, b AS (SELECT fid, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM tr WHERE n > 1 GROUP BY fid)"


def bounds(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, g.bbox(F.col("geom")).alias("b")).select(*keys, F.col("b.xmin").alias("x0"), F.col("b.ymin").alias("y0"), F.col("b.xmax").alias("x1"), F.col("b.ymax").alias("y1"))


@query(f'{_TRB} SELECT fid AS "ORIG_FID", x0, y0, x1, y1 FROM b')
def feature_envelope(spark, sf_dir):
    return bounds(features.feature_envelope_to_polygon(L.tracks(spark, sf_dir)).df, "ORIG_FID")


@query(f'{_TRB} SELECT fid AS "ORIG_FID", x0, y0, x1, y1, least(x1 - x0, y1 - y0) AS "MBG_WIDTH", greatest(x1 - x0, y1 - y0) AS "MBG_LENGTH" FROM b')
def mbg_envelope_none(spark, sf_dir):
    return bounds(features.minimum_bounding_geometry(L.tracks(spark, sf_dir), "envelope", True).df, "ORIG_FID", "MBG_WIDTH", "MBG_LENGTH").select("ORIG_FID", "x0", "y0", "x1", "y1", "MBG_WIDTH", "MBG_LENGTH")


@query(f"WITH {CP} SELECT c_nationkey, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM cp GROUP BY c_nationkey")
def mbg_envelope_list(spark, sf_dir):
    return bounds(features.minimum_bounding_geometry(L.customers(spark, sf_dir), "envelope", False, "list", "c_nationkey").df, "c_nationkey")


@query(f"WITH {OB} SELECT min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ob")
def mbg_envelope_all(spark, sf_dir):
    return bounds(features.minimum_bounding_geometry(L.order_boxes(spark, sf_dir), "envelope", False, "all").df)


@query(f'WITH {OB} SELECT fid AS "ORIG_FID", (x1 - x0) * (y1 - y0) AS area FROM ob')
def mbg_rectangle(spark, sf_dir):
    d = features.minimum_bounding_geometry(L.order_boxes(spark, sf_dir), "rectangle_by_area").df
    return d.select("ORIG_FID", F.round(g.area(F.col("geom")), 9).alias("area"))


# directed edges of the hull: all other points of the label lie to their left
_HULL = """WITH p AS (SELECT DISTINCT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
  e AS (SELECT a.label, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)
    WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))"""


@query(f"""{_HULL} SELECT e.label, round(sum(x0 * y1 - x1 * y0) / 2, 6) AS area,
  (SELECT round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) FROM p a JOIN p b ON a.label = b.label WHERE a.label = e.label) AS "MBG_LENGTH" FROM e GROUP BY e.label""")
def mbg_hull_list(spark, sf_dir):
    d = features.minimum_bounding_geometry(L.embedding_points(spark, sf_dir), "convex_hull", True, "list", "label").df
    return d.select("label", F.round(g.area(F.col("geom")), 6).alias("area"), F.round("MBG_LENGTH", 6).alias("MBG_LENGTH"))


@query()
def mbg_circle_all(spark, sf_dir):
    return features.minimum_bounding_geometry(L.embedding_points(spark, sf_dir), "circle", True, "all").df.select(F.round("MBG_WIDTH", 6).alias("MBG_WIDTH"))


@query(f'WITH {OB} SELECT fid, (x0 + x1) / 2 AS "POINT_X", (y0 + y1) / 2 AS "POINT_Y" FROM ob')
def add_xy_coordinates(spark, sf_dir):
    return features.add_xy_coordinates(L.order_boxes(spark, sf_dir)).df.select("fid", F.round("POINT_X", 9).alias("POINT_X"), F.round("POINT_Y", 9).alias("POINT_Y"))


@query(f'WITH {OB} SELECT fid AS "ORIG_FID", (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM ob')
def feature_to_point(spark, sf_dir):
    d = features.feature_to_point(L.order_boxes(spark, sf_dir)).df.select("ORIG_FID", *xy())
    return d.select("ORIG_FID", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f'WITH {OB} SELECT fid AS "ORIG_FID", (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM ob')
def feature_to_point_inside(spark, sf_dir):
    return features.feature_to_point(L.order_boxes(spark, sf_dir), inside=True).df.select("ORIG_FID", *xy())


@query(f"""WITH {OB} SELECT fid, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0 + y1 - y0) AS perimeter, 1 AS part_count, 5 AS point_count, 0 AS hole_count,
  x0 AS extent_min_x, y1 AS extent_max_y, x0 AS line_start_x, y0 AS line_end_y FROM ob""")
def geom_attributes(spark, sf_dir):
    o = L.order_boxes(spark, sf_dir)
    names = "area perimeter part_count point_count hole_count extent_min_x extent_max_y line_start_x line_end_y".split()
    return o.df.select("fid", *[features.attribute(o, n).alias(n) for n in names])


@query(f"WITH {OB} SELECT fid, (x1 - x0) * (y1 - y0) AS size FROM ob")
def calculate_geometry_attributes(spark, sf_dir):
    o = L.order_boxes(spark, sf_dir)
    o = o.with_df(o.df.withColumn("size", F.lit(0.0)))
    return features.calculate_geometry_attributes(o, "SIZE", "area").df.select("fid", "size")


@query(f"""WITH {TR}, s AS (SELECT fid, hypot(lead(x) OVER w - x, lead(y) OVER w - y) AS d FROM (SELECT *, 0 AS z FROM tr WHERE n > 1) WINDOW w AS (PARTITION BY fid ORDER BY seq)) SELECT fid, round(sum(d), 6) AS length FROM s GROUP BY fid""".replace("hypot(lead(x) OVER w - x, lead(y) OVER w - y)", "sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2)"))
def track_length(spark, sf_dir):
    return L.tracks(spark, sf_dir).df.select("fid", F.round(g.length(F.col("geom")), 6).alias("length"))


# --- overlays


@query(f"WITH {CP}, {TL} SELECT c.fid, c.c_nationkey, t.fid AS tile FROM cp c JOIN tl t ON c.x BETWEEN t.x0 AND t.x1 AND c.y BETWEEN t.y0 AND t.y1 WHERE t.fid % 2 = 0".replace("c.fid, c.c_nationkey, t.fid AS tile", "DISTINCT c.fid, c.c_nationkey"))
def clip_points(spark, sf_dir):
    return extract.clip(L.customers(spark, sf_dir), L.tiles(spark, sf_dir, even=True)).df.select("fid", "c_nationkey")


@query(f"WITH {OB}, {TL} SELECT b.fid, sum({SHARED}) AS area FROM ob b JOIN tl t ON {MEET} WHERE t.fid % 2 = 0 GROUP BY b.fid")
def clip_boxes(spark, sf_dir):
    d = extract.clip(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir, even=True)).df
    return d.groupBy("fid").agg(F.sum(g.area(F.col("geom"))).alias("area"))


@query(f"WITH {OB}, {TL} SELECT t.n_name AS split_value, count(DISTINCT b.fid) AS n, sum({SHARED}) AS area FROM ob b JOIN tl t ON {MEET} GROUP BY t.n_name")
def split_tiles(spark, sf_dir):
    d = extract.split(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir), "N_NAME").df
    return d.groupBy("split_value").agg(F.count_distinct("fid").alias("n"), F.sum(g.area(F.col("geom"))).alias("area"))


_CUT = f"k AS (SELECT b.fid, sum({SHARED}) AS a FROM ob b JOIN tl t ON {MEET} WHERE t.fid % 2 = 0 GROUP BY b.fid)"


@query(f"WITH {OB}, {TL}, {_CUT} SELECT b.fid, (b.x1 - b.x0) * (b.y1 - b.y0) - coalesce(k.a, 0) AS area FROM ob b LEFT JOIN k ON k.fid = b.fid WHERE (b.x1 - b.x0) * (b.y1 - b.y0) > coalesce(k.a, 0)")
def erase_boxes(spark, sf_dir):
    d = overlay.erase(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir, even=True)).df
    return d.groupBy("fid").agg(F.round(F.sum(g.area(F.col("geom"))), 9).alias("area"))


@query(f"WITH {CP}, {TL} SELECT c.fid FROM cp c WHERE NOT EXISTS (SELECT 1 FROM tl t WHERE t.fid % 2 = 0 AND c.x BETWEEN t.x0 AND t.x1 AND c.y BETWEEN t.y0 AND t.y1)")
def erase_points(spark, sf_dir):
    return overlay.erase(L.customers(spark, sf_dir), L.tiles(spark, sf_dir, even=True)).df.select("fid")


_PAIR = f"FROM ob b JOIN tl t ON {MEET}"


@query(f"WITH {OB}, {TL} SELECT b.fid AS fid_order_box_a, b.o_custkey, t.fid AS fid_nation_tile_a, t.n_name, {SHARED} AS area {_PAIR}")
def intersect_all(spark, sf_dir):
    d = overlay.intersect(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir)).df
    return d.select("fid_order_box_a", "o_custkey", "fid_nation_tile_a", "n_name", g.area(F.col("geom")).alias("area"))


@query(f"WITH {OB}, {TL} SELECT b.o_custkey, t.n_name, {SHARED} AS area {_PAIR}")
def intersect_sans_fid(spark, sf_dir):
    d = overlay.intersect(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir), "sans_fid").df
    return d.select("o_custkey", "n_name", g.area(F.col("geom")).alias("area"))


@query(f"WITH {OB}, {TL} SELECT b.fid AS fid_order_box_a, t.fid AS fid_nation_tile_a {_PAIR}")
def intersect_only_fid(spark, sf_dir):
    return overlay.intersect(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir), "only_fid").df.drop("geom")


@query(f"WITH {CP}, {TL} SELECT c.fid AS fid_cust_p, t.fid AS fid_nation_tile_a FROM cp c JOIN tl t ON c.x BETWEEN t.x0 AND t.x1 AND c.y BETWEEN t.y0 AND t.y1")
def intersect_points(spark, sf_dir):
    return overlay.intersect(L.customers(spark, sf_dir), L.tiles(spark, sf_dir), "only_fid").df.drop("geom")


@query(f"WITH {TL} SELECT b.fid AS fid_nation_tile_a, t.fid AS fid_nation_tile_a_1, {SHARED} AS area {_PAIR.replace('ob b', 'tl b')}")
def intersect_classic(spark, sf_dir):
    t = L.tiles(spark, sf_dir)
    d = overlay.intersect(t, t, "only_fid", algorithm_option="classic").df
    return d.select("fid_nation_tile_a", "fid_nation_tile_a_1", g.area(F.col("geom")).alias("area"))


# unit cells that no order box covers: all coordinates are whole numbers
_FREE = """bx AS (SELECT DISTINCT x0, y0, x1, y1 FROM ob), cell AS (SELECT x, y FROM range(0, 100) a(x), range(0, 100) b(y)),
  free AS (SELECT x, y FROM cell WHERE NOT EXISTS (SELECT 1 FROM bx WHERE bx.x0 <= x AND bx.x1 >= x + 1 AND bx.y0 <= y AND bx.y1 >= y + 1))"""
_LEFT = "SELECT b.fid AS f, NULL::BIGINT AS t, (b.x1 - b.x0) * (b.y1 - b.y0) - coalesce(k.a, 0) AS area FROM ob b LEFT JOIN k ON k.fid = b.fid"
_RIGHT = "SELECT NULL::BIGINT AS f, t.fid AS t, count(*)::DOUBLE AS area FROM tl t JOIN free ON x >= t.x0 AND x < t.x1 AND y >= t.y0 AND y < t.y1 WHERE t.fid % 2 = 0 GROUP BY t.fid"


def _areas(d: DataFrame) -> DataFrame:
    return d.groupBy("fid_order_box_a", "fid_nation_tile_even_a").agg(F.round(F.sum(g.area(F.col("geom"))), 9).alias("area"))


@query(f"""WITH {OB}, {TL}, {_CUT}, {_FREE}, a AS ({_LEFT}), z AS ({_RIGHT})
  SELECT f AS fid_order_box_a, t AS fid_nation_tile_even_a, area FROM a WHERE area > 0 UNION ALL SELECT f, t, area FROM z""")
def symmetrical_difference(spark, sf_dir):
    return _areas(overlay.symmetrical_difference(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir, even=True), "only_fid").df)


@query(f"""WITH {OB}, {TL}, {_CUT}, {_FREE}, a AS ({_LEFT}), z AS ({_RIGHT}), i AS (SELECT b.fid AS f, t.fid AS t, {SHARED} AS area FROM ob b JOIN tl t ON {MEET} WHERE t.fid % 2 = 0)
  SELECT f AS fid_order_box_a, t AS fid_nation_tile_even_a, area FROM a WHERE area > 0 UNION ALL SELECT f, t, area FROM z UNION ALL SELECT f, t, area FROM i""")
def union(spark, sf_dir):
    return _areas(overlay.union(L.order_boxes(spark, sf_dir), L.tiles(spark, sf_dir, even=True), "only_fid").df)


# --- lines and points over lines and points

ST = "st AS (SELECT n_nationkey::BIGINT AS sid, n_name, n_nationkey::DOUBLE AS a0, n_nationkey + 50.0::DOUBLE AS a1, 4 * n_nationkey + 0.5::DOUBLE AS ay FROM nation)"
DR = "dr AS (SELECT o_orderkey AS fid, (o_orderkey % 97)::DOUBLE AS x0, (o_orderkey % 97 + 1 + o_orderkey % 8)::DOUBLE AS x1, o_custkey % 100 + 0.5::DOUBLE AS y FROM orders)"
_ON = "c.y = st.ay AND c.x BETWEEN st.a0 AND st.a1"
_ALONG = "dr.y = st.ay AND greatest(dr.x0, st.a0) < least(dr.x1, st.a1)"


def lengths(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum(g.length(F.col("geom"))), 9).alias("length"))


@query(f"WITH {CP}, {ST} SELECT DISTINCT c.fid, c.x, c.y FROM cp c JOIN st ON {_ON}")
def clip_points_by_lines(spark, sf_dir):
    return extract.clip(L.customers(spark, sf_dir), L.streets(spark, sf_dir)).df.select("fid", *xy())


@query(f"WITH {CP}, {ST} SELECT c.fid FROM cp c WHERE NOT EXISTS (SELECT 1 FROM st WHERE {_ON})")
def erase_points_by_lines(spark, sf_dir):
    return overlay.erase(L.customers(spark, sf_dir), L.streets(spark, sf_dir)).df.select("fid")


_THIRD = "SELECT x, y FROM cp WHERE c_nationkey % 3 = 0"


def _third(spark, sf_dir) -> FeatureFrame:
    c = L.customers(spark, sf_dir)
    return c.with_df(c.df.where("c_nationkey % 3 = 0"), name="third_p")


@query(f"WITH {CP} SELECT fid FROM cp WHERE (x, y) IN ({_THIRD})")
def clip_points_by_points(spark, sf_dir):
    return extract.clip(L.customers(spark, sf_dir), _third(spark, sf_dir)).df.select("fid")


@query(f"WITH {CP} SELECT fid FROM cp WHERE (x, y) NOT IN ({_THIRD})")
def erase_points_by_points(spark, sf_dir):
    return overlay.erase(L.customers(spark, sf_dir), _third(spark, sf_dir)).df.select("fid")


@query(f"WITH {DR}, {ST} SELECT dr.fid, sum(least(x1, a1) - greatest(x0, a0)) AS length FROM dr JOIN st ON {_ALONG} GROUP BY dr.fid")
def clip_lines_by_lines(spark, sf_dir):
    return lengths(extract.clip(L.drives(spark, sf_dir), L.streets(spark, sf_dir)).df, "fid")


@query(f"WITH {DR}, {ST}, k AS (SELECT dr.fid, sum(least(x1, a1) - greatest(x0, a0)) AS n FROM dr JOIN st ON {_ALONG} GROUP BY dr.fid) SELECT dr.fid, x1 - x0 - coalesce(n, 0) AS length FROM dr LEFT JOIN k ON k.fid = dr.fid WHERE x1 - x0 > coalesce(n, 0)")
def erase_lines_by_lines(spark, sf_dir):
    return lengths(overlay.erase(L.drives(spark, sf_dir), L.streets(spark, sf_dir)).df, "fid")


@query(f"WITH {DR}, {ST} SELECT st.n_name AS split_value, count(DISTINCT dr.fid) AS n, sum(least(x1, a1) - greatest(x0, a0)) AS length FROM dr JOIN st ON {_ALONG} GROUP BY st.n_name")
def split_lines_by_lines(spark, sf_dir):
    d = extract.split(L.drives(spark, sf_dir), L.streets(spark, sf_dir), "n_name").df
    return d.groupBy("split_value").agg(F.count_distinct("fid").alias("n"), F.round(F.sum(g.length(F.col("geom"))), 9).alias("length"))


@query(f"WITH {DR}, {ST} SELECT dr.fid AS fid_drive_l, sid AS fid_street_l, greatest(x0, a0) AS x0, least(x1, a1) AS x1 FROM dr JOIN st ON {_ALONG}")
def intersect_lines(spark, sf_dir):
    return bounds(overlay.intersect(L.drives(spark, sf_dir), L.streets(spark, sf_dir), "only_fid").df, "fid_drive_l", "fid_street_l").drop("y0", "y1")


@query(f"WITH {CP}, {ST} SELECT c.fid AS fid_cust_p, sid AS fid_street_l FROM cp c JOIN st ON {_ON}")
def intersect_points_lines(spark, sf_dir):
    return overlay.intersect(L.customers(spark, sf_dir), L.streets(spark, sf_dir), "only_fid").df.drop("geom")


@query(f"WITH {CP}, {ST} SELECT c_nationkey::BIGINT AS fid_nation_mp, sid AS fid_street_l, count(*)::INTEGER AS n FROM cp c JOIN st ON {_ON} GROUP BY 1, 2")
def intersect_multipoints_lines(spark, sf_dir):
    d = overlay.intersect(L.nation_points(spark, sf_dir), L.streets(spark, sf_dir), "only_fid").df
    return d.select("fid_nation_mp", "fid_street_l", F.size("geom").alias("n"))


@query(f"WITH {CP} SELECT a.fid AS fid_cust_p, b.c_nationkey::BIGINT AS fid_nation_mp FROM cp a JOIN (SELECT DISTINCT c_nationkey, x, y FROM cp) b ON a.x = b.x AND a.y = b.y")
def intersect_points_multipoints(spark, sf_dir):
    return overlay.intersect(L.customers(spark, sf_dir), L.nation_points(spark, sf_dir), "only_fid").df.drop("geom")


@query(f"WITH {CP}, {TL} SELECT c_nationkey::BIGINT AS fid, count(DISTINCT c.fid)::INTEGER AS n FROM cp c JOIN tl t ON c.x BETWEEN t.x0 AND t.x1 AND c.y BETWEEN t.y0 AND t.y1 WHERE t.fid % 2 = 0 GROUP BY 1")
def clip_multipoints(spark, sf_dir):
    return extract.clip(L.nation_points(spark, sf_dir), L.tiles(spark, sf_dir, even=True)).df.select("fid", F.size("geom").alias("n"))


@query(f"WITH {DR}, {TL} SELECT dr.fid, t.fid AS tile, least(dr.x1, t.x1) - greatest(dr.x0, t.x0) AS length FROM dr JOIN tl t ON dr.y > t.y0 AND dr.y < t.y1 AND greatest(dr.x0, t.x0) < least(dr.x1, t.x1)")
def intersect_lines_tiles(spark, sf_dir):
    d = overlay.intersect(L.drives(spark, sf_dir), L.tiles(spark, sf_dir), "only_fid").df
    return lengths(d.withColumnRenamed("fid_drive_l", "fid").withColumnRenamed("fid_nation_tile_a", "tile"), "fid", "tile")


def _plain(layer: FeatureFrame) -> FeatureFrame:
    """The same without the promise of rectangles: for the kernel."""
    return layer.with_df(layer.df, rectangles=False)


@query(f"WITH {OB}, {TL} SELECT b.fid, sum({SHARED}) AS area FROM ob b JOIN tl t ON {MEET} WHERE t.fid % 2 = 0 GROUP BY b.fid")
def clip_polygons(spark, sf_dir):
    d = extract.clip(_plain(L.order_boxes(spark, sf_dir)), _plain(L.tiles(spark, sf_dir, even=True))).df
    return d.groupBy("fid").agg(F.round(F.sum(g.area(F.col("geom"))), 9).alias("area"))


@query(f"WITH {OB}, {TL} SELECT b.fid AS fid_order_box_a, t.fid AS fid_nation_tile_a, {SHARED} AS area {_PAIR}")
def intersect_polygons(spark, sf_dir):
    d = overlay.intersect(_plain(L.order_boxes(spark, sf_dir)), _plain(L.tiles(spark, sf_dir)), "only_fid").df
    return d.select("fid_order_box_a", "fid_nation_tile_a", F.round(g.area(F.col("geom")), 9).alias("area"))


@query(f"WITH {TL} SELECT t.fid AS fid_nation_tile_a, b.fid AS fid_nation_tile_a_1, (CASE WHEN t.fid = b.fid THEN 80.0 ELSE 20.0 END)::DOUBLE AS length FROM tl t JOIN tl b ON t.fid = b.fid OR abs(t.x0 - b.x0) + abs(t.y0 - b.y0) = 20")
def intersect_outlines(spark, sf_dir):
    t = L.tiles(spark, sf_dir)
    d = overlay.intersect(t, t, "only_fid", "line").df
    return lengths(d, "fid_nation_tile_a", "fid_nation_tile_a_1")


@query(f"WITH {DR} SELECT y, sum(b - a) AS length FROM (SELECT y, a, max(b) AS b FROM (SELECT y, x AS a, x + 1 AS b FROM dr, range(0, 110) r(x) WHERE x >= x0 AND x < x1) GROUP BY y, a) GROUP BY y")
def dissolve_lines(spark, sf_dir):
    """Lines that run together count once."""
    d = L.drives(spark, sf_dir)
    d = d.with_df(d.df.withColumn("y", g.low(F.col("geom"), "y")))
    return lengths(generalization.dissolve(d, "y").df, "y")


@query(f"WITH {CP} SELECT fid, x, y FROM cp WHERE x BETWEEN 10.5 AND 20 AND y BETWEEN 0 AND 50.5")
def xy_table_to_point_extent(spark, sf_dir):
    df = L.customers(spark, sf_dir).df.drop("geom")
    return features.xy_table_to_point(df, None, "x", "y", settings=Settings(extent=Extent(10.5, 0, 20, 50.5))).df.select("fid", "x", "y")


@query(f"WITH {CP}, {TL} SELECT c.fid FROM cp c WHERE false")
def clip_apart(spark, sf_dir):
    """Layers that meet nowhere."""
    t = L.tiles(spark, sf_dir)
    far = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: g.vertex(v["x"] + 1000, v["y"]))))
    return extract.clip(L.customers(spark, sf_dir), t.with_df(t.df.withColumn("geom", far))).df.select("fid")


@query(f"WITH {CP}, l AS (SELECT n_nationkey::BIGINT AS lid, 20 * (n_nationkey % 5) + 10 AS lx, 20 * (n_nationkey // 5) + 10 AS ly FROM nation) SELECT fid, lid FROM cp JOIN l ON abs(x - lx) <= 1.5 AND abs(y - ly) <= 1.5")
def join_within(spark, sf_dir):
    side = lambda layer: layer.df.select(layer.fid.alias("id"), layer.box.alias("box"))
    return spatial_join.join(side(L.customers(spark, sf_dir)), side(L.lattice(spark, sf_dir)), within=1.5).select(F.col("l.id").alias("fid"), F.col("r.id").alias("lid"))


@query("""WITH c AS (SELECT *, c_custkey % 7 AS g FROM customer WHERE c_custkey % 7 < 6) SELECT g::BIGINT AS g, min(c_custkey) AS "ORIG_FID", count(*) - 1 AS n FROM c GROUP BY g HAVING count(*) > 1""")
def find_identical_within(spark, sf_dir):
    """Points around six far centres, all of a centre within the tolerance of each other."""
    df = L.table(spark, sf_dir, "customer").selectExpr("c_custkey as fid", "c_custkey % 7 as g", "cast(100 * (c_custkey % 7) + (c_custkey % 3) / 4.0 as double) as x", "cast((c_custkey % 5) / 8.0 as double) as y").where("g < 6")
    points = features.xy_table_to_point(df, None, "x", "y")
    found = general.find_identical(points, (), include_geometry=True, xy_tolerance=1.0)
    return found.groupBy((F.col("ORIG_FID") % 7).alias("g"), "ORIG_FID").agg(F.count("*").alias("n"))


# --- proximity

# half of 4 * 32 vertices, times the sine of the angle of a step: see the SQL


@query(f'WITH {CP} SELECT fid AS "ORIG_FID", round(64 * sin(pi() / 64) * 0.0625, 9) AS area FROM cp')
def buffer_none(spark, sf_dir):
    d = proximity.buffer(L.customers(spark, sf_dir), 0.25).df
    return d.select("ORIG_FID", F.round(g.area(F.col("geom")), 9).alias("area"))


@query("SELECT n_regionkey, round(count(*) * 64 * sin(pi() / 64) * 9, 6) AS area FROM nation GROUP BY n_regionkey")
def buffer_list(spark, sf_dir):
    p = L.lattice(spark, sf_dir)
    p = p.with_df(p.df.join(L.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("fid"), "n_regionkey"), "fid"))
    d = proximity.buffer(p, 3, dissolve_option="list", group_fields="n_regionkey").df
    return d.select("n_regionkey", F.round(g.area(F.col("geom")), 6).alias("area"))


@query("SELECT round(count(*) * 64 * sin(pi() / 64) * 9, 6) AS area FROM nation")
def buffer_all(spark, sf_dir):
    return proximity.buffer(L.lattice(spark, sf_dir), 3, dissolve_option="all").df.select(F.round(g.area(F.col("geom")), 6).alias("area"))


@query("SELECT n_nationkey::BIGINT AS \"ORIG_FID\", d || ' meters' AS distance, round(64 * sin(pi() / 64) * d * d, 9) AS area FROM nation, (VALUES (1), (2), (3)) v(d)")
def multiple_buffer_overlap(spark, sf_dir):
    d = proximity.multiple_buffer(L.lattice(spark, sf_dir), "meters", [3, 1, 2, 2], overlapping=True).df
    return d.select("ORIG_FID", "distance", F.round(g.area(F.col("geom")), 9).alias("area"))


@query("SELECT d || ' meters' AS distance, round(count(*) * 64 * sin(pi() / 64) * (d * d - (d - 1) * (d - 1)), 6) AS area FROM nation, (VALUES (1), (2), (3)) v(d) GROUP BY d")
def multiple_buffer_rings(spark, sf_dir):
    d = proximity.multiple_buffer(L.lattice(spark, sf_dir), "meters", [1, 2, 3]).df
    return d.select("distance", F.round(g.area(F.col("geom")), 6).alias("area"))


@query("SELECT n_nationkey::BIGINT AS \"ORIG_FID\", n_name, (20 * (n_nationkey % 5))::DOUBLE AS x0, (20 * (n_nationkey // 5))::DOUBLE AS y0, 400.0::DOUBLE AS area FROM nation")
def thiessen_lattice(spark, sf_dir):
    d = proximity.create_thiessen_polygons(L.lattice(spark, sf_dir), True, settings=Settings(extent=Extent(0, 0, 100, 100))).df
    return d.select("ORIG_FID", "n_name", F.round(g.low(F.col("geom"), "x"), 9).alias("x0"), F.round(g.low(F.col("geom"), "y"), 9).alias("y0"), F.round(g.area(F.col("geom")), 6).alias("area"))


@query()
def thiessen_points(spark, sf_dir):
    d = proximity.create_thiessen_polygons(L.embedding_points(spark, sf_dir)).df
    return d.select("ORIG_FID", F.round(g.area(F.col("geom")), 6).alias("area"))


# --- checks, repairs, projections


@query("""SELECT o_orderkey AS "ORIG_FID", r AS "REASON" FROM orders, (VALUES (1, 'ORIENTATION'), (2, 'UNCLOSED'), (3, 'SELF_INTERSECTION'), (4, 'ORIENTATION'), (4, 'OUTSIDE_RING'), (5, 'POINT_COUNT'), (6, 'REPEATED_XY')) v(k, r)
  WHERE o_orderkey % 7 = k AND (k <> 4 OR r = 'OUTSIDE_RING')""")
def check_geometry(spark, sf_dir):
    return check.check_geometry(L.broken_boxes(spark, sf_dir)).select("ORIG_FID", "REASON")


@query(f"WITH {OB} SELECT fid, round(CASE WHEN fid % 7 = 3 THEN (x1 - x0) * (y1 - y0) / 2 ELSE (x1 - x0) * (y1 - y0) END, 6) AS area FROM ob WHERE fid % 7 <> 5")
def repair_geometry(spark, sf_dir):
    d = check.repair_geometry(L.broken_boxes(spark, sf_dir), drop_empty=True).df
    return d.select("fid", F.round(g.area(F.col("geom")), 6).alias("area"))


@query(f"WITH {CP} SELECT fid, round((x - 50) * pi() / 180 * 6378137, 3) AS x, round(6378137 * ln(tan(pi() / 4 + (y - 50) * pi() / 360)), 3) AS y FROM cp")
def project_3857(spark, sf_dir):
    c = L.customers(spark, sf_dir)
    v = g.first_vertex(F.col("geom"))
    c = c.with_df(c.df.withColumn("geom", g.point(v["x"] - 50, v["y"] - 50)), crs="EPSG:4326")
    d = projections.project(c, "EPSG:3857").df.select("fid", *xy())
    return d.select("fid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH {CP} SELECT fid, x, y FROM cp")
def define_projection(spark, sf_dir):
    return projections.define_projection(L.customers(spark, sf_dir), "4326").df.select("fid", *xy())


def _geographic(layer: FeatureFrame, shift: float = 50.0) -> FeatureFrame:
    """A layer of [0, 100] squared moved about the equator, as degrees."""
    moved = F.transform(layer.meta.geom, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: g.vertex(v["x"] - shift, v["y"] - shift))))
    return layer.with_df(layer.df.withColumn(layer.meta.geom, moved), crs="EPSG:4326")


@query()
def length_geodesic(spark, sf_dir):
    t = _geographic(L.tracks(spark, sf_dir), 0.0)
    low = F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: g.vertex(v["x"], v["y"] % 80))))
    t = t.with_df(t.df.withColumn("geom", low).withColumn("km", F.lit(0.0)))
    return features.calculate_geometry_attributes(t, "km", "length_geodesic", length_unit="km").df.select("fid", F.round("km", 6).alias("km"))


@query()
def area_geodesic(spark, sf_dir):
    t = _geographic(L.tiles(spark, sf_dir))
    t = t.with_df(t.df.withColumn("km2", F.lit(0.0)))
    return features.calculate_geometry_attributes(t, "km2", "area_geodesic", area_unit="square kilometers").df.select("fid", F.round("km2", 3).alias("km2"))


@query()
def buffer_geodesic(spark, sf_dir):
    c = _geographic(L.lattice(spark, sf_dir))
    d = proximity.buffer(c, "100 km").df
    return d.select("ORIG_FID", F.round(g.area(F.col("geom")), 6).alias("area"))


# --- indexes, workspaces, GeoPackages


@query(f"WITH {OB} SELECT fid, x0, y0 FROM ob")
def add_spatial_index(spark, sf_dir):
    d = indexes.add_spatial_index(L.order_boxes(spark, sf_dir)).df
    return d.select("fid", F.col("bbox.xmin").alias("x0"), F.col("bbox.ymin").alias("y0"))


@query("SELECT p_partkey, p_brand FROM part")
def add_attribute_index(spark, sf_dir):
    return indexes.add_attribute_index(L.table(spark, sf_dir, "part"), "by_key", "p_partkey", is_unique=True).select("p_partkey", "p_brand")


@query(f"WITH {TL} SELECT fid, n_name, x0, y0 FROM tl")
def geopackage_round_trip(spark, sf_dir):
    path = os.path.join(tempfile.mkdtemp(), "tiles.gpkg")
    workspace.feature_class_to_geopackage([L.tiles(spark, sf_dir)], path)
    d = geopackage.read(spark, path, "nation_tile_a").df
    return d.select("fid", "n_name", g.low(F.col("geom"), "x").alias("x0"), g.low(F.col("geom"), "y").alias("y0"))


@query("SELECT r_regionkey::BIGINT AS fid, r_name FROM region")
def table_to_geopackage(spark, sf_dir):
    path = os.path.join(tempfile.mkdtemp(), "region.gpkg")
    workspace.table_to_geopackage({"region": L.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("fid"), "r_name")}, path)
    return geopackage.read(spark, path, "region")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within an extent, cut to the nations' tiles and counted by nation."""
    points = extract.select(L.customers(spark, sf_dir), settings=Settings(extent=Extent(10, 10, 90, 90)))
    joined = overlay.intersect(points, L.tiles(spark, sf_dir))
    return joined.df.groupBy("n_name").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
