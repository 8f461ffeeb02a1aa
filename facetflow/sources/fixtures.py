"""Measurement tables derived from the relational ones, and the same tables as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table

PIXELS_SQL = "pixels AS (SELECT l_orderkey % 4 AS shot, (l_partkey % 32)::INTEGER AS ix, (l_suppkey % 32)::INTEGER AS iy, l_linenumber AS t, l_quantity AS v, 1 - l_discount * 10 AS w FROM lineitem)"
WAVES_SQL = "waves AS (SELECT user_id AS wf, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch(ts)::DOUBLE - 1704067200.0 AS t, value AS v, event_type FROM events)"
BOXES_SQL = """boxes AS (SELECT p_partkey AS mesh, p_size::DOUBLE AS length, (1 + p_partkey % 7)::DOUBLE AS width, (1 + p_partkey % 3)::DOUBLE AS thickness FROM part),
vertices AS (SELECT mesh, c.vid, c.x * length AS x, c.y * width AS y, c.z * thickness AS z FROM boxes, (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, 1, 0, 1), (6, 1, 1, 1), (7, 0, 1, 1)) c(vid, x, y, z)),
corners AS (SELECT mesh, c.facet, c.k, c.vid FROM boxes, (VALUES (0, 0, 0), (0, 1, 3), (0, 2, 2), (0, 3, 1), (1, 0, 4), (1, 1, 5), (1, 2, 6), (1, 3, 7), (2, 0, 0), (2, 1, 1), (2, 2, 5), (2, 3, 4), (3, 0, 1), (3, 1, 2), (3, 2, 6), (3, 3, 5), (4, 0, 2), (4, 1, 3), (4, 2, 7), (4, 3, 6), (5, 0, 3), (5, 1, 0), (5, 2, 4), (5, 3, 7)) c(facet, k, vid)),
ring AS (SELECT mesh, facet, k, vid, x, y, z FROM corners JOIN vertices USING (mesh, vid))"""
LINES_SQL = "lines AS (SELECT o_orderkey AS line, (o_orderkey % 97) / 97.0::DOUBLE AS u1, (o_orderkey % 89) / 89.0::DOUBLE AS v1, (o_custkey % 83) / 83.0::DOUBLE * 1.4 - 0.2 AS u2, (o_custkey % 79) / 79.0::DOUBLE * 1.4 - 0.2 AS v2 FROM orders)"


GRID_N, GRID_M = 12, 9
GRIDS_SQL = f"""gdims AS (SELECT s_suppkey AS mesh, 0.05::DOUBLE + (s_suppkey % 10) * 0.1::DOUBLE AS amplitude FROM supplier),
gvertices AS (SELECT mesh, (j * {GRID_N} + i)::INTEGER AS vid, i / {GRID_N - 1}.0::DOUBLE AS x, j / {GRID_M - 1}.0::DOUBLE AS y, amplitude * sin(3 * (i / {GRID_N - 1}.0::DOUBLE)) * cos(2 * (j / {GRID_M - 1}.0::DOUBLE)) AS z, i / {GRID_N - 1}.0::DOUBLE AS u, j / {GRID_M - 1}.0::DOUBLE AS v FROM gdims, range({GRID_N}) a(i), range({GRID_M}) b(j)),
gcorners AS (SELECT mesh, (j * {GRID_N - 1} + i)::INTEGER AS facet, k, (j * {GRID_N} + i + o)::INTEGER AS vid FROM gdims, range({GRID_N - 1}) a(i), range({GRID_M - 1}) b(j), (VALUES (0, 0), (1, 1), (2, {GRID_N + 1}), (3, {GRID_N})) c(k, o))"""


def grid_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mesh, amplitude: one height field a supplier."""
    k = F.col("s_suppkey")
    return spread(table(spark, sf_dir, "supplier").select(k.alias("mesh"), (0.05 + (k % 10) * 0.1).alias("amplitude")), "mesh")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shot, ix, iy, t, v, w: line items as measurement pixels."""
    n = table(spark, sf_dir, "lineitem")
    return n.select((F.col("l_orderkey") % 4).alias("shot"), (F.col("l_partkey") % 32).cast("int").alias("ix"), (F.col("l_suppkey") % 32).cast("int").alias("iy"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("v"), (1 - F.col("l_discount") * 10).alias("w"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wf, i, t, v, event_type: each user's events as one waveform, t in seconds of 2024."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    return e.select(F.col("user_id").alias("wf"), F.row_number().over(order).cast("long").alias("i"), seconds.alias("t"), F.col("value").alias("v"), "event_type")


def box_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mesh, length, width, thickness: one box a part."""
    p = table(spark, sf_dir, "part")
    return spread(p.select(F.col("p_partkey").alias("mesh"), F.col("p_size").cast("double").alias("length"), (1 + F.col("p_partkey") % 7).cast("double").alias("width"), (1 + F.col("p_partkey") % 3).cast("double").alias("thickness")), "mesh")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, u1, v1, u2, v2: orders as line segments on the unit square and around it."""
    o = table(spark, sf_dir, "orders")
    part = lambda c, n: (F.col(c) % n) / float(n)
    return o.select(F.col("o_orderkey").alias("line"), part("o_orderkey", 97).alias("u1"), part("o_orderkey", 89).alias("v1"), (part("o_custkey", 83) * 1.4 - 0.2).alias("u2"), (part("o_custkey", 79) * 1.4 - 0.2).alias("v2"))


def texels(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """iu, iv of an nx x ny texture."""
    return spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("iu"), F.expr(f"cast(id div {nx} as int)").alias("iv"))
