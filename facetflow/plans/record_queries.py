"""Queries of calibration records, landmark lines and mesh curvature."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curvature
from ..session import spread, table
from ..sources import calibration as src
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)


@query("src15_calibration_records", "SELECT p_partkey AS id, p_size + 640 AS sizex, p_size + 480 AS sizey, 700.5 + p_partkey AS fx, 0.25::DOUBLE * (p_partkey % 7) AS k1, p_retailprice AS error, p_partkey % 10 <> 0 AS ok FROM part")
def calibration_records(spark, d):
    """A record a part, written as XML and read back; every tenth lacks a number of its lens."""
    p, k, n = table(spark, d, "part"), F.col("p_partkey"), lambda x: F.lit(float(x))
    lens = F.array(k % 7 * 0.25, n(0.5), n(-0.125), n(0))
    camera = F.array(k + 700.5, n(0), n(320), n(0), n(700), n(240), n(0), n(0), n(1))
    r = p.select(k.alias("id"), (F.col("p_size") + 640).cast("int").alias("sizex"), (F.col("p_size") + 480).cast("int").alias("sizey"), camera.alias("k"), F.when(k % 10 == 0, lens).otherwise(F.array_append(lens, n(1))).alias("dist"), F.col("p_retailprice").cast("double").alias("error"), F.lit("2015-06-14T12:00:00-05:00").alias("at"))
    return src.read_intrinsics(src.write_intrinsics(r)).select("id", "sizex", "sizey", F.get("k", F.lit(0)).alias("fx"), F.get("dist", F.lit(0)).alias("k1"), "error", "ok")


@query("src16_landmark_lines", "SELECT event_id, 'L' || user_id AS name, round(value, 3) AS x, -1.0::DOUBLE * (user_id % 9) AS y FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL")
def landmark_lines(spark, d):
    e = table(spark, d, "events").where("value is not null")
    line = F.concat(F.lit("LANDMARK L"), F.col("user_id").cast("string"), F.lit(" ("), F.round("value", 3).cast("string"), F.lit(","), (F.col("user_id") % 9 * -1.0).cast("string"), F.lit(")"))
    return src.landmark_lines(e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value")))


def _patches(spark, d):
    """A 5 x 5 patch of z = (a x^2 + b y^2) / 2 a part: vertices, corners, dealt by part."""
    side = F.explode(F.sequence(F.lit(0), F.lit(4)))
    p = spread(table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("mesh"), (F.col("p_size") / 25.0).alias("a"), (F.col("p_partkey") % 7 / 4.0 - 1).alias("b"))
    g = p.withColumn("i", side).withColumn("j", side)
    x, y = (F.col("i") - 2) * 0.1, (F.col("j") - 2) * 0.1
    vertices = g.select("mesh", (F.col("j") * 5 + F.col("i")).alias("vid"), x.alias("x"), y.alias("y"), ((F.col("a") * x * x + F.col("b") * y * y) / 2).alias("z"))
    low = F.col("j") * 5 + F.col("i")
    corners = g.where("i < 4 and j < 4").select("mesh", (F.col("j") * 4 + F.col("i")).alias("facet"), F.posexplode(F.array(low, low + 1, low + 6, low + 5)).alias("k", "vid"))
    return vertices, corners


@query("agg09_vertex_curvature", "SELECT p_partkey AS mesh, greatest(p_size / 25.0, p_partkey % 7 / 4.0 - 1) AS k1, least(p_size / 25.0, p_partkey % 7 / 4.0 - 1) AS k2, 25 AS n FROM part")
def vertex_curvature(spark, d):
    """All vertices of a patch a part; the middle one's curvatures are known, and all have some."""
    out = curvature.vertex_curvature(*_patches(spark, d))
    middle = lambda c: F.max(F.when(F.col("vid") == 12, F.col(c)))
    return out.groupBy("mesh").agg((F.round(middle("k1"), 5) + 0.0).alias("k1"), (F.round(middle("k2"), 5) + 0.0).alias("k2"), F.count_if(F.col("k1") >= F.col("k2")).cast("int").alias("n"))


@query("agg09_flat_curvature", "SELECT p_partkey AS mesh, n AS vid, 0.0::DOUBLE AS k1, 0.0::DOUBLE AS k2 FROM part, range(25) r(n)")
def flat_curvature(spark, d):
    """Every vertex of a tilted plane bends nowhere, at the border, too."""
    v, c = _patches(spark, d)
    tilted = v.withColumn("z", F.col("x") * (F.col("mesh") % 5) - F.col("y") * (F.col("mesh") % 3))
    out = curvature.vertex_curvature(tilted, c)
    return out.select("mesh", F.col("vid").cast("long").alias("vid"), *((F.round(F.abs(k), 5) + 0.0).alias(k) for k in ("k1", "k2")))
