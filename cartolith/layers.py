"""Layers derived from the test tables: all coordinates are multiples of 1/2, so that results are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as g
from .model import LINE, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, FeatureFrame, FeatureMeta
from .operators.features import xy_table_to_point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("fid"), "c_nationkey", "c_acctbal", "c_mktsegment",
        (F.col("c_custkey") % 100 + 0.5).cast("double").alias("x"), F.expr("cast((c_custkey * 37 + c_custkey div 100) % 100 + 0.5 as double)").alias("y"),
    )
    return xy_table_to_point(df, None, "x", "y", name="cust_p")


def order_boxes(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    k = F.col("o_orderkey")
    x0, y0 = (k % 97).cast("double"), F.expr("cast((o_orderkey div 97) % 89 as double)")
    df = table(spark, sf_dir, "orders").select(
        k.alias("fid"), "o_custkey", "o_orderstatus", g.box(x0, y0, x0 + 1 + F.col("o_custkey") % 4, y0 + 1 + k % 3).alias("geom"),
        F.struct(x0.alias("xmin"), y0.alias("ymin"), (x0 + 1 + F.col("o_custkey") % 4).alias("xmax"), (y0 + 1 + k % 3).alias("ymax")).alias("bbox"),
    )
    return FeatureFrame(df, FeatureMeta(POLYGON, name="order_box_a", rectangles=True))


def tiles(spark: SparkSession, sf_dir: str, even: bool = False) -> FeatureFrame:
    n = F.col("n_nationkey").cast("long")
    x0, y0 = (20 * (n % 5)).cast("double"), F.expr("cast(20 * (n_nationkey div 5) as double)")
    df = table(spark, sf_dir, "nation").select(n.alias("fid"), "n_name", "n_regionkey", g.box(x0, y0, x0 + 20, y0 + 20).alias("geom"))
    df = df.where("fid % 2 = 0") if even else df
    return FeatureFrame(df, FeatureMeta(POLYGON, name="nation_tile_even_a" if even else "nation_tile_a", rectangles=True))


def tracks(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    v = F.struct("ts", "event_id", g.vertex(F.col("event_id") % 64, F.floor("value")).alias("v"))
    df = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("fid")).agg(F.array_sort(F.collect_list(v)).alias("vs"))
    df = df.where(F.size("vs") > 1).select("fid", g.line(F.transform("vs", lambda s: s["v"])).alias("geom"))
    return FeatureFrame(df, FeatureMeta(LINE, name="event_track_l"))


def streets(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """A level line for each nation: from (n, 4 n + 1/2), 50 long."""
    n = F.col("n_nationkey").cast("double")
    ends = F.array(g.vertex(n, 4 * n + 0.5), g.vertex(n + 50, 4 * n + 0.5))
    return FeatureFrame(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("fid"), "n_name", g.line(ends).alias("geom")), FeatureMeta(LINE, name="street_l"))


def drives(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """A level line of 1 to 8 for each order, in two pieces of which the second runs on from the first."""
    x, y, n = (F.col("o_orderkey") % 97).cast("double"), (F.col("o_custkey") % 100 + 0.5).cast("double"), (1 + F.col("o_orderkey") % 8).cast("double")
    ends = F.array(g.vertex(x, y), g.vertex(x + n / 2, y), g.vertex(x + n, y))
    return FeatureFrame(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fid"), "o_orderstatus", g.line(ends).alias("geom")), FeatureMeta(LINE, name="drive_l"))


def nation_points(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """The customers of each nation as one feature of many points."""
    c = customers(spark, sf_dir).df
    df = c.groupBy(F.col("c_nationkey").cast("long").alias("fid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("fid", "geom"))), lambda s: F.get(s["geom"], F.lit(0))).alias("geom"))
    return FeatureFrame(df, FeatureMeta(MULTIPOINT, name="nation_mp"))


def order_parts(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    boxes = order_boxes(spark, sf_dir).df
    df = boxes.groupBy(F.col("o_custkey").alias("fid")).agg(F.array_sort(F.collect_list(F.struct("fid", "geom"))).alias("parts"))
    df = df.select("fid", F.transform("parts", lambda p: F.get(p["geom"], F.lit(0))).alias("geom"))
    return FeatureFrame(df, FeatureMeta(MULTIPOLYGON, name="order_parts_ma"))


def lattice(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """The middles of the nations' tiles: their Voronoi cells are the tiles."""
    t = tiles(spark, sf_dir).df
    df = t.select("fid", "n_name", (g.low(F.col("geom"), "x") + 10).alias("x"), (g.low(F.col("geom"), "y") + 10).alias("y"))
    return xy_table_to_point(df, None, "x", "y", name="lattice_p")


def embedding_points(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("fid"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return xy_table_to_point(df, None, "x", "y", name="emb_p")


def broken_boxes(spark: SparkSession, sf_dir: str) -> FeatureFrame:
    """Order boxes with a fault by the key's remainder of 7: none, clockwise, unclosed, bow tie, hole outside, two vertices, repeated vertex."""
    o = order_boxes(spark, sf_dir)
    b = F.col("bbox")
    v = lambda x, y: g.vertex(b[x], b[y])
    p, q, r, s = v("xmin", "ymin"), v("xmax", "ymin"), v("xmax", "ymax"), v("xmin", "ymax")
    one = lambda *vs: F.array(F.array(F.array(*vs)))
    hole = F.array(*[g.vertex(b["xmax"] + dx, b["ymax"] + dy) for dx, dy in ((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))])
    kind = F.col("fid") % 7
    geom = (
        F.when(kind == 1, one(p, s, r, q, p)).when(kind == 2, one(p, q, r, s)).when(kind == 3, one(p, r, q, s, p))
        .when(kind == 4, F.array(F.array(F.array(p, q, r, s, p), hole))).when(kind == 5, one(p, q, p)).when(kind == 6, one(p, q, q, r, s, p)).otherwise(F.col("geom"))
    )
    return FeatureFrame(o.df.withColumn("geom", geom).drop("bbox"), FeatureMeta(POLYGON, name="broken_a"))
