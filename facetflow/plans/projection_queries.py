"""Queries of points and segments on the UV square."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..operators import locate as op
from ..sources import fixtures as fx
from .registry import query

W = f"WITH {fx.LINES_SQL}"


@query("join03_point_location", f"{W}, g AS (SELECT f AS facet, (f % 15) / 15.0::DOUBLE AS u0, (f % 15 + 1) / 15.0::DOUBLE AS u1, (f // 15) / 11.0::DOUBLE AS v0, (f // 15 + 1) / 11.0::DOUBLE AS v1 FROM range(165) q(f)) SELECT line AS id, min(facet) AS facet FROM lines LEFT JOIN g ON u1_ BETWEEN u0 AND g.u1 AND v1_ BETWEEN v0 AND g.v1 GROUP BY line".replace("u1_", "lines.u1").replace("v1_", "lines.v1"))
def point_location(spark, d):
    p = fx.lines(spark, d).select(F.col("line").alias("id"), F.col("u1").alias("u"), F.col("v1").alias("v"))
    return op.locate(p, op.grid_quads(spark, 15, 11), 13).select("id", "facet")


@query("pred03_segment_hits_box", f"{W} SELECT line, abs((u1 + u2) / 2 - 0.5) <= 0.25 + abs(u2 - u1) / 2 AND abs((v1 + v2) / 2 - 0.5) <= 0.25 + abs(v2 - v1) / 2 AND abs(((u1 + u2) / 2 - 0.5) * (v2 - v1) / 2 - ((v1 + v2) / 2 - 0.5) * (u2 - u1) / 2) <= 0.25 * abs(v2 - v1) / 2 + 0.25 * abs(u2 - u1) / 2 AS hit FROM lines")
def segment_box(spark, d):
    c, q, r = F.col, F.lit(0.25), F.lit(0.75)
    return fx.lines(spark, d).select("line", pr.segment_hits_box2(c("u1"), c("v1"), c("u2"), c("v2"), q, q, r, r).alias("hit"))


@query("pred05_segments_cross", f"{W}, s AS (SELECT line, (u2 - u1) * (0.3 - v1) - (0.1 - u1) * (v2 - v1) AS a, (u2 - u1) * (0.6 - v1) - (0.9 - u1) * (v2 - v1) AS b, 0.8 * (v1 - 0.3) - (u1 - 0.1) * 0.3 AS c, 0.8 * (v2 - 0.3) - (u2 - 0.1) * 0.3 AS e FROM lines) SELECT line, a * b < -1e-12 AND c * e < -1e-12 AS hit FROM s")
def cross(spark, d):
    c, n = F.col, lambda x: F.lit(float(x))
    return fx.lines(spark, d).select("line", pr.segments_cross(c("u1"), c("v1"), c("u2"), c("v2"), n(0.1), n(0.3), n(0.9), n(0.6)).alias("hit"))


@query("pred01_point_in_polygon", f"{W} SELECT line, u1 >= 0 AND v1 >= 0 AND u1 + v1 <= 1 AS inside FROM lines")
def in_polygon(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))])
    return fx.lines(spark, d).select("line", pr.in_polygon(ring, F.col("u1"), F.col("v1")).alias("inside"))


@query("pred10_ray_hits_box", f"{W} SELECT line, coalesce(greatest(0, least((0.25 - u1) / nullif(u2 - u1, 0), (0.75 - u1) / nullif(u2 - u1, 0)), least((0.25 - v1) / nullif(v2 - v1, 0), (0.75 - v1) / nullif(v2 - v1, 0))) <= least(greatest((0.25 - u1) / nullif(u2 - u1, 0), (0.75 - u1) / nullif(u2 - u1, 0)), greatest((0.25 - v1) / nullif(v2 - v1, 0), (0.75 - v1) / nullif(v2 - v1, 0))), false) AS hit FROM lines WHERE u1 <> u2 AND v1 <> v2")
def ray_box(spark, d):
    c, q, r = F.col, F.lit(0.25), F.lit(0.75)
    hit = pr.ray_hits_box((c("u1"), c("v1")), (c("u2") - c("u1"), c("v2") - c("v1")), (q, q), (r, r))
    return fx.lines(spark, d).where("u1 <> u2 and v1 <> v2").select("line", hit.alias("hit"))


@query("join18_raster_lookup", f"WITH {fx.LINES_SQL}, {fx.PIXELS_SQL}, r AS (SELECT ix, iy, max(v) AS v FROM pixels GROUP BY ALL) SELECT line, v FROM lines LEFT JOIN r ON ix = floor(u2 * 32)::INTEGER AND iy = floor(v2 * 32)::INTEGER")
def raster_lookup(spark, d):
    r = fx.pixels(spark, d).groupBy("ix", "iy").agg(F.max("v").alias("v"))
    p = fx.lines(spark, d).select("line", F.floor(F.col("u2") * 32).cast("int").alias("ix"), F.floor(F.col("v2") * 32).cast("int").alias("iy"))
    return p.join(r, ["ix", "iy"], "left").select("line", "v")
