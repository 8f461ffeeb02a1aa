"""Queries that project measurements onto UV grids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import fusion, project as op
from ..session import table
from ..sources import fixtures as fx
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)
W = f"WITH {fx.PIXELS_SQL}, fused AS (SELECT ix, iy, t, sum(w * v) / sum(w) AS v, sum(w) AS w FROM pixels WHERE w > 0 GROUP BY ALL)"


@query("agg01_splat", f"""{W}, p AS (SELECT t, ix * 0.7::DOUBLE + 0.15::DOUBLE AS u, iy * 0.7::DOUBLE + 0.15::DOUBLE AS z, v, w FROM fused),
k AS (SELECT t, u, z, v, w, floor(u)::INTEGER + a.d AS iu, floor(z)::INTEGER + b.d AS iv FROM p, (VALUES (-1), (0), (1), (2)) a(d), (VALUES (-1), (0), (1), (2)) b(d)),
c AS (SELECT t, iu, iv, v, w * (0.5 + 0.5 * cos(sqrt((iu - u) * (iu - u) + (iv - z) * (iv - z)) * {0.4 * math.pi / math.sqrt(2)!r}::DOUBLE)) AS c FROM k WHERE (iu - u) * (iu - u) + (iv - z) * (iv - z) <= 2.25)
SELECT t, iu, iv, round(sum(c * v), 5) + 0.0 AS sum_wv, round(sum(c), 5) + 0.0 AS sum_w FROM c GROUP BY ALL""")
def splat(spark, d):
    p = fusion.fuse(fx.pixels(spark, d))
    p = p.select("t", (F.col("ix") * 0.7 + 0.15).alias("u"), (F.col("iy") * 0.7 + 0.15).alias("v"), F.col("v").alias("value"), "w")
    return op.splat(p, "t").select("t", "iu", "iv", R("sum_wv", 5).alias("sum_wv"), R("sum_w", 5).alias("sum_w"))


@query("join04_nearest_hits", f"WITH {fx.LINES_SQL}, f AS (SELECT p_partkey AS facet, (p_partkey % 101) / 101.0::DOUBLE AS u0, (p_partkey % 101) / 101.0::DOUBLE + p_size / 1000.0::DOUBLE AS u1, (p_partkey % 103) / 103.0::DOUBLE AS v0, (p_partkey % 103) / 103.0::DOUBLE + p_size / 1000.0::DOUBLE AS v1, (1000 - p_partkey % 997)::DOUBLE AS dist FROM part), h AS (SELECT line, facet, dist FROM lines l JOIN f ON l.u1 BETWEEN f.u0 AND f.u1 AND l.v1 BETWEEN f.v0 AND f.v1 QUALIFY row_number() OVER (PARTITION BY line ORDER BY dist, facet) = 1) SELECT line AS id, facet, dist FROM lines LEFT JOIN h USING (line)")
def nearest_hits(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size") / F.lit(1000.0)
    u, v = (k % 101) / F.lit(101.0), (k % 103) / F.lit(103.0)
    faces = table(spark, d, "part").select(k.alias("facet"), u.alias("u0"), (u + size).alias("u1"), v.alias("v0"), (v + size).alias("v1"), (1000 - k % 997).cast("double").alias("dist"))
    return op.nearest_hits(fx.lines(spark, d).select(F.col("line").alias("id"), F.col("u1").alias("u"), F.col("v1").alias("v")), faces, 20)


@query("agg15_line_means", f"WITH {fx.LINES_SQL}, {fx.PIXELS_SQL}, r AS (SELECT ix, iy, max(v) AS v FROM pixels GROUP BY ALL), n AS (SELECT *, floor(1 + sqrt((u2 - u1) * 32 * ((u2 - u1) * 32) + (v2 - v1) * 32 * ((v2 - v1) * 32)))::INTEGER AS steps FROM lines), s AS (SELECT *, unnest(range(steps)) AS k FROM n), c AS (SELECT line, steps, sqrt((u2 - u1) * (u2 - u1) + (v2 - v1) * (v2 - v1)) AS length, floor((u1 + (k + 0.5::DOUBLE) / steps * (u2 - u1)) * 32)::INTEGER AS ix, floor((v1 + (k + 0.5::DOUBLE) / steps * (v2 - v1)) * 32)::INTEGER AS iy FROM s) SELECT line, steps, round(length, 6) AS length, round(avg(v), 6) AS mean FROM c LEFT JOIN r USING (ix, iy) GROUP BY line, steps, c.length")
def line_means(spark, d):
    r = fx.pixels(spark, d).groupBy("ix", "iy").agg(F.max("v").alias("v"))
    return op.line_means(fx.lines(spark, d), r, 32).select("line", "steps", R("length").alias("length"), R("mean").alias("mean"))
