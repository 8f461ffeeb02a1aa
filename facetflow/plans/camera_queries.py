"""Queries of cameras: undistorted and rectified frames, reprojection errors, facets behind pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import camera as op, fusion, project, uv
from ..operators.diffusion import diffusion_steps
from ..session import cut, spread, table
from ..sources import fixtures as fx
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)
#: A camera over the 32 x 32 measurement pixels: focal lengths, centre, and a lens's k1, k2, p1, p2, k3.
FOCAL, CENTRE, LENS = (20.0, 21.0), (15.3, 15.7), (-0.21, 0.13, 0.008, -0.004, -0.05)
_D = lambda x: f"({x!r})::DOUBLE"
K1, K2, P1, P2, K3 = map(_D, LENS)
FX, FY, CX, CY = map(_D, (*FOCAL, *CENTRE))


def _lens_sql(x: str, y: str) -> tuple[str, str]:
    r2 = f"({x} * {x} + {y} * {y})"
    radial = f"(1 + {K1} * {r2} + {K2} * {r2} * {r2} + {K3} * {r2} * {r2} * {r2})"
    return f"({x} * {radial} + 2 * {P1} * {x} * {y} + {P2} * ({r2} + 2 * {x} * {x}))", f"({y} * {radial} + {P1} * ({r2} + 2 * {y} * {y}) + 2 * {P2} * {x} * {y})"


FUSED = f"WITH {fx.PIXELS_SQL}, fused AS (SELECT ix, iy, t, sum(w * v) / sum(w) AS v FROM pixels WHERE w > 0 GROUP BY ALL)"
_TAPS = """t4 AS (SELECT p.*, floor(sx)::INTEGER + a AS px, floor(sy)::INTEGER + b AS py, (CASE a WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE b WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS tw FROM places p, (VALUES (0), (1)) qa(a), (VALUES (0), (1)) qb(b))"""
_X, _Y = _lens_sql("x", "y")


@query("join13_undistort", f"""{FUSED}, n AS (SELECT i AS ix, j AS iy, (i - {CX}) / {FX} AS x, (j - {CY}) / {FY} AS y FROM range(32) a(i), range(32) b(j)),
places AS (SELECT ix, iy, {_X} * {FX} + {CX} AS sx, {_Y} * {FY} + {CY} AS sy FROM n), {_TAPS}
SELECT t4.ix::INTEGER AS ix, t4.iy::INTEGER AS iy, t, round(sum(tw * v), 6) AS v FROM t4 JOIN fused f ON f.ix = px AND f.iy = py WHERE tw > 0 GROUP BY ALL""")
def undistort(spark, d):
    """Each fused frame without its lens distortion. The map has one row a pixel, whatever the number of frames."""
    grid = spark.range(32 * 32).select((F.col("id") % 32).cast("int").alias("ix"), F.expr("int(id div 32)").alias("iy"))
    frames = fusion.fuse(fx.pixels(spark, d)).select("ix", "iy", "t", "v")
    out = op.resample(op.undistortion_map(grid, FOCAL, CENTRE, LENS), frames, ["ix", "iy"])
    return out.select("ix", "iy", "t", R("v").alias("v"))


@query("join14_rectify", f"""{FUSED}, q AS (SELECT DISTINCT t, 2.2 + t * 0.1::DOUBLE AS x0, 3.1::DOUBLE AS y0, 27.3::DOUBLE AS x1, 1.2 + t * 0.2::DOUBLE AS y1, 29.4 - t * 0.3::DOUBLE AS x2, 28.2::DOUBLE AS y2, 4.6::DOUBLE AS x3, 26.7::DOUBLE AS y3 FROM fused),
k AS (SELECT *, x0 - x1 + x2 - x3 AS sx_, y0 - y1 + y2 - y3 AS sy_, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det FROM q),
h AS (SELECT *, (sx_ * (y3 - y2) - (x3 - x2) * sy_) / det AS g, ((x1 - x2) * sy_ - sx_ * (y1 - y2)) / det AS h FROM k),
w AS (SELECT h.*, i AS ix, j AS iy, (i + 0.5::DOUBLE) / 16 AS u, (j + 0.5::DOUBLE) / 12 AS z FROM h, range(16) a(i), range(12) b(j)),
places AS (SELECT t AS pt, ix, iy, ((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * z + x0) / (g * u + h * z + 1) AS sx, ((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * z + y0) / (g * u + h * z + 1) AS sy FROM w), {_TAPS}
SELECT t4.ix::INTEGER AS ix, t4.iy::INTEGER AS iy, t, round(sum(tw * v), 6) AS v FROM t4 JOIN fused f ON f.t = pt AND f.ix = px AND f.iy = py WHERE tw > 0 GROUP BY ALL""")
def rectify(spark, d):
    """Each fused frame's quadrilateral on a 16 x 12 grid."""
    frames = fusion.fuse(fx.pixels(spark, d)).select("ix", "iy", "t", "v")
    t, n = F.col("t"), lambda x: F.lit(float(x))
    at = {"x0": t * 0.1 + 2.2, "y0": n(3.1), "x1": n(27.3), "y1": t * 0.2 + 1.2, "x2": 29.4 - t * 0.3, "y2": n(28.2), "x3": n(4.6), "y3": n(26.7)}
    quads = table(spark, d, "lineitem").where(1 - F.col("l_discount") * 10 > 0).select(F.col("l_linenumber").alias("t")).distinct().withColumns(at)
    return op.resample(op.rectification_map(quads, list(at), F.lit(16), F.lit(12)), frames, ["t", "ix", "iy"], ["t"]).select("ix", "iy", "t", R("v").alias("v"))


_PX, _PY = _lens_sql("(u1 / 2.5)", "(v1 / 2.5)")


@query("agg30_reprojection_error", f"WITH {fx.LINES_SQL}, p AS (SELECT line % 50 AS image, {_PX} * {FX} + {CX} - (u1 * 8 + 15) AS dx, {_PY} * {FY} + {CY} - (v1 * 8 + 16) AS dy FROM lines) SELECT image, count(*) AS n, round(sqrt(avg(dx * dx + dy * dy)), 6) AS rms FROM p GROUP BY image")
def reprojection(spark, d):
    p = fx.lines(spark, d).select((F.col("line") % 50).alias("image"), F.col("u1").alias("x"), F.col("v1").alias("y"), F.lit(2.5).alias("z"), (F.col("u1") * 8 + 15).alias("px"), (F.col("v1") * 8 + 16).alias("py"))
    return op.reprojection_rms(p, FOCAL, CENTRE, LENS).select("image", "n", R("rms").alias("rms"))


def _faces(spark, d):
    """Every part as a rectangle across the view, at a depth of its own, in every shot."""
    k, depth = F.col("p_partkey"), 2 + F.col("p_partkey") / 1000.0
    a, b, s = (k % 101) / 101.0 * 1.6 - 0.79863, (k % 103) / 103.0 * 1.6 - 0.79741, F.col("p_size") / 500.0
    corner = [(a, b), (a + s, b), (a + s, b + s), (a, b + s)]
    ring = F.array(*(F.struct((x * depth).alias("x"), (-y * depth).alias("y"), (-depth).alias("z")) for x, y in corner)).cast("array<struct<x:double,y:double,z:double>>")
    shots = F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("image")
    return spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(k.alias("facet"), ring.alias("ring"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"), shots)


_SLOPES = f"WITH {fx.PIXELS_SQL}, p AS (SELECT DISTINCT shot AS image, ix, iy, (ix - 15.3::DOUBLE) / 20 AS sx, (iy - 15.7::DOUBLE) / 21 AS sy FROM pixels), f AS (SELECT p_partkey AS facet, 2 + p_partkey / 1000.0::DOUBLE AS depth, (p_partkey % 101) / 101.0::DOUBLE * 1.6::DOUBLE - 0.79863::DOUBLE AS a, (p_partkey % 103) / 103.0::DOUBLE * 1.6::DOUBLE - 0.79741::DOUBLE AS b, p_size / 500.0::DOUBLE AS s FROM part), n AS (SELECT image, ix, iy, min(facet) AS facet, min(depth) AS depth FROM p JOIN f ON sx BETWEEN a AND a + s AND sy BETWEEN b AND b + s GROUP BY ALL)"


@query("join05_pinhole_hits", f"{_SLOPES} SELECT p.image, p.ix, p.iy, facet, round(depth * sqrt(1 + sx * sx + sy * sy), 6) AS dist, round(CASE WHEN facet IS NOT NULL THEN 1 / sqrt(1 + sx * sx + sy * sy) END, 6) AS cosine FROM p LEFT JOIN n USING (image, ix, iy)")
def pinhole(spark, d):
    pixels = fx.pixels(spark, d).withColumnRenamed("shot", "image")
    hits = op.pinhole_hits(pixels, _faces(spark, d), FOCAL, CENTRE, 4)
    return hits.select("image", "ix", "iy", "facet", R("dist").alias("dist"), R("cosine").alias("cosine"))


@query("agg02_project_frames", f"""{_SLOPES}, m AS (SELECT l_orderkey % 4 AS image, l_partkey % 32 AS ix, l_suppkey % 32 AS iy, l_linenumber AS t, l_quantity AS value, 1 - l_discount * 10 AS w FROM lineitem),
g AS (SELECT image, t, value, w / sqrt(1 + sx * sx + sy * sy) AS w, (sx * depth + 2) * 4 AS u, (sy * depth + 2) * 4 AS z FROM m JOIN n USING (image, ix, iy) JOIN p USING (image, ix, iy) WHERE w > 0),
k AS (SELECT *, floor(u)::INTEGER + a.d AS iu, floor(z)::INTEGER + b.d AS iv FROM g, (VALUES (-1), (0), (1), (2)) a(d), (VALUES (-1), (0), (1), (2)) b(d)),
c AS (SELECT t, iu, iv, value, w * (0.5 + 0.5 * cos(sqrt((iu - u) * (iu - u) + (iv - z) * (iv - z)) * 0.4 * pi() / sqrt(2))) AS c FROM k WHERE (iu - u) * (iu - u) + (iv - z) * (iv - z) <= 2.25)
SELECT t, iu, iv, round(sum(c * value), 4) + 0.0 AS sum_wv, round(sum(c), 4) + 0.0 AS sum_w FROM c GROUP BY ALL""")
def project_frames(spark, d):
    """All measurements splatted on the surface behind their pixels, weighted by the facets' inclination. Hits are found once for all frames."""
    pixels = fx.pixels(spark, d).withColumnRenamed("shot", "image")
    hits = op.pinhole_hits(pixels, _faces(spark, d), FOCAL, CENTRE, 4).where("facet is not null")
    depth = F.col("dist") * F.col("cosine")
    at = lambda n, f, c: ((F.col(n) - c) / f * depth + 2) * 4
    p = pixels.join(hits, ["image", "ix", "iy"]).select("t", at("ix", FOCAL[0], CENTRE[0]).alias("u"), at("iy", FOCAL[1], CENTRE[1]).alias("v"), F.col("v").alias("value"), (F.col("w") * F.col("cosine")).alias("w"))
    return project.splat(p, "t").select("t", "iu", "iv", R("sum_wv", 4).alias("sum_wv"), R("sum_w", 4).alias("sum_w"))


#: Wider rectangles, each with a tile of a texture of its own: 8 by 5 tiles.
_TEXTURED = _SLOPES.replace("p_size / 500.0::DOUBLE AS s", "0.1::DOUBLE + p_size / 100.0::DOUBLE AS s").replace("n AS (SELECT image, ix, iy, min(facet) AS facet, min(depth) AS depth FROM", "n AS (SELECT image, ix, iy, min(facet) AS facet, min(depth) AS depth, arg_min(a, facet) AS a, arg_min(b, facet) AS b, arg_min(s, facet) AS s FROM")


def _texture_hits(spark, d):
    """Pinhole hits of all shots on textured rectangles, with the products of each pixel."""
    k, depth = F.col("p_partkey"), 2 + F.col("p_partkey") / 1000.0
    a, b, s = (k % 101) / 101.0 * 1.6 - 0.79863, (k % 103) / 103.0 * 1.6 - 0.79741, 0.1 + F.col("p_size") / 100.0
    u, v = (k % 8) / 8.0, F.expr("p_partkey div 8 % 5") / 5.0
    corner = [(a, b, u, v), (a + s, b, u + 1 / 8, v), (a + s, b + s, u + 1 / 8, v + 1 / 5), (a, b + s, u, v + 1 / 5)]
    ring = F.array(*(F.struct((x * depth).alias("x"), (-y * depth).alias("y"), (-depth).alias("z"), p.alias("u"), q.alias("v")) for x, y, p, q in corner))
    parts = cut(spread(table(spark, d, "part"), "p_partkey").select(F.lit(0).alias("mesh"), k.alias("facet"), ring.alias("ring")), "textured")
    shots = F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("image")
    n = lambda x: F.lit(float(x))
    faces = parts.select("facet", F.transform("ring", lambda q: F.struct(*(q[c].alias(c) for c in "xyz"))).alias("ring"), n(0).alias("nx"), n(0).alias("ny"), n(1).alias("nz"), shots)
    hits = cut(op.pinhole_hits(fx.pixels(spark, d).withColumnRenamed("shot", "image"), faces, FOCAL, CENTRE, 4), "textured-hits")
    seen = parts.join(hits.select("facet").distinct(), "facet", "left_semi")  # of the others no frame is needed
    frames = cut(uv.frames(seen.select("mesh", "facet", F.posexplode("ring").alias("k", "q")).select("mesh", "facet", "k", "q.*")), "textured-frames")
    return cut(op.pixel_products(hits.withColumn("mesh", F.lit(0)), frames, FOCAL, CENTRE), "texture-hits")


@query("join05_pixel_products", f"{_TEXTURED} SELECT image, ix, iy, facet, round(facet % 8 / 8.0::DOUBLE + (sx - a) / s / 8, 9) + 0.0 AS u, round(facet // 8 % 5 / 5.0::DOUBLE + (sy - b) / s / 5, 9) + 0.0 AS v, round(1 / 20.0::DOUBLE / s / 8, 9) AS du_h, 0.0::DOUBLE AS dv_h, 0.0::DOUBLE AS du_v, round(1 / 21.0::DOUBLE / s / 5, 9) AS dv_v, 0.0::DOUBLE AS dz_h, 0.0::DOUBLE AS dz_v FROM n JOIN p USING (image, ix, iy)")
def pixel_products(spark, d):
    out = _texture_hits(spark, d)
    return out.select("image", "ix", "iy", "facet", *(R(c, 9).alias(c) for c in ("u", "v", "du_h", "dv_h", "du_v", "dv_v", "dz_h", "dz_v")))


_REACH = repr(0.4 * math.pi / math.sqrt(2))


@query("agg02_texture_projection", f"""{_TEXTURED}, m AS (SELECT l_orderkey % 4 AS image, l_partkey % 32 AS ix, l_suppkey % 32 AS iy, l_linenumber AS t, l_quantity AS value, 1 - l_discount * 10 AS w FROM lineitem),
g AS (SELECT t, value, w / sqrt(1 + sx * sx + sy * sy) AS w, facet % 8 / 8.0::DOUBLE + (sx - a) / s / 8 AS u, facet // 8 % 5 / 5.0::DOUBLE + (sy - b) / s / 5 AS z, 1 / 20.0::DOUBLE / s / 8 AS du, 1 / 21.0::DOUBLE / s / 5 AS dv FROM m JOIN n USING (image, ix, iy) JOIN p USING (image, ix, iy) WHERE w > 0),
k AS (SELECT g.*, iu::INTEGER AS iu, iv::INTEGER AS iv, iu - (u * 48 - 0.5) AS x, iv - (z * 40 - 0.5) AS y FROM g, range(48) q(iu), range(40) r(iv) WHERE abs(iu - (u * 48 - 0.5)) <= greatest(1.5, 1.5 * du * 48) AND abs(iv - (z * 40 - 0.5)) <= greatest(1.5, 1.5 * dv * 40)),
e AS (SELECT *, (x / 48 / du) ** 2 + (y / 40 / dv) ** 2 AS r2 FROM k), h AS (SELECT *, w * CASE WHEN sqrt(r2) * {_REACH}::DOUBLE > pi() THEN 0 ELSE 0.5 + 0.5 * cos(sqrt(r2) * {_REACH}::DOUBLE) END AS c FROM e WHERE x * x + y * y <= 2.25 OR r2 <= 2.25)
SELECT t, iu, iv, round(sum(c * value), 4) + 0.0 AS sum_wv, round(sum(c), 4) + 0.0 AS sum_w FROM h GROUP BY ALL""")
def texture_projection(spark, d):
    """All measurements on the texture behind their pixels, each as wide as its pixel is there, weighted by the facets' inclination: pixels to
    facets to texture coordinates to texels. Hits and their products are made once for all frames. What a pixel measured in a frame is one weighted
    mean before it goes to the texels: their sums are linear in it."""
    hits = _texture_hits(spark, d)
    p = fx.pixels(spark, d).withColumnRenamed("shot", "image").where("w > 0 and v is not null and not isnan(v)")
    w = F.col("w").cast("double")
    p = p.groupBy("image", "ix", "iy", "t").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("value"), F.sum(w).alias("w")).join(hits, ["image", "ix", "iy"])
    p = p.select("t", "u", "v", "value", (F.col("w") * F.col("cosine")).alias("w"), "du_h", "dv_h", "du_v", "dv_v")
    return uv.splat_footprints(p, 48, 40, "t").select("t", "iu", "iv", R("sum_wv", 4).alias("sum_wv"), R("sum_w", 4).alias("sum_w"))


#: The same rectangles seen by parallel rays; pixels of 1/9 and 1/10.
_PLAN = f"WITH {fx.PIXELS_SQL}, p AS (SELECT DISTINCT shot AS image, ix, iy, (ix - 15.3::DOUBLE) / 9 AS ox, -(iy - 15.7::DOUBLE) / 10 AS oy FROM pixels), f AS (SELECT p_partkey AS facet, 2 + p_partkey / 1000.0::DOUBLE AS depth, (p_partkey % 101) / 101.0::DOUBLE * 1.6::DOUBLE - 0.79863::DOUBLE AS a, (p_partkey % 103) / 103.0::DOUBLE * 1.6::DOUBLE - 0.79741::DOUBLE AS b, p_size / 500.0::DOUBLE AS s FROM part), n AS (SELECT image, ix, iy, min(facet) AS facet, min(depth) AS depth FROM p JOIN f ON ox BETWEEN a * depth AND (a + s) * depth AND -oy BETWEEN b * depth AND (b + s) * depth GROUP BY ALL)"


@query("join06_orthographic_hits", f"{_PLAN} SELECT p.image, p.ix, p.iy, facet, round(depth, 6) AS dist, CASE WHEN facet IS NOT NULL THEN 1.0::DOUBLE END AS cosine FROM p LEFT JOIN n USING (image, ix, iy)")
def orthographic(spark, d):
    pixels = fx.pixels(spark, d).withColumnRenamed("shot", "image")
    hits = op.orthographic_hits(pixels, _faces(spark, d), (9.0, 10.0), CENTRE, 4)
    return hits.select("image", "ix", "iy", "facet", R("dist").alias("dist"), R("cosine").alias("cosine"))


@query("agg03_project_orthographic", f"""{_PLAN}, m AS (SELECT l_orderkey % 4 AS image, l_partkey % 32 AS ix, l_suppkey % 32 AS iy, l_linenumber AS t, l_quantity AS value, 1 - l_discount * 10 AS w FROM lineitem),
g AS (SELECT t, value, w, (ox + 2) * 4 AS u, (oy + 2) * 4 AS z FROM m JOIN n USING (image, ix, iy) JOIN p USING (image, ix, iy) WHERE w > 0),
k AS (SELECT *, floor(u)::INTEGER + a.d AS iu, floor(z)::INTEGER + b.d AS iv FROM g, (VALUES (-1), (0), (1), (2)) a(d), (VALUES (-1), (0), (1), (2)) b(d)),
c AS (SELECT t, iu, iv, value, w * (0.5 + 0.5 * cos(sqrt((iu - u) * (iu - u) + (iv - z) * (iv - z)) * 0.4 * pi() / sqrt(2))) AS c FROM k WHERE (iu - u) * (iu - u) + (iv - z) * (iv - z) <= 2.25)
SELECT t, iu, iv, round(sum(c * value), 4) + 0.0 AS sum_wv, round(sum(c), 4) + 0.0 AS sum_w FROM c GROUP BY ALL""")
def project_orthographic(spark, d):
    """Frames with a validity image of their own (w), on what parallel rays meet."""
    pixels = fx.pixels(spark, d).withColumnRenamed("shot", "image")
    hits = op.orthographic_hits(pixels, _faces(spark, d), (9.0, 10.0), CENTRE, 4).where("facet is not null")
    at = lambda n, f, c, sign: (sign * (F.col(n) - c) / f + 2) * 4
    p = pixels.join(hits, ["image", "ix", "iy"]).select("t", at("ix", 9.0, CENTRE[0], 1).alias("u"), at("iy", 10.0, CENTRE[1], -1).alias("v"), F.col("v").alias("value"), "w")
    return project.splat(p, "t").select("t", "iu", "iv", R("sum_wv", 4).alias("sum_wv"), R("sum_w", 4).alias("sum_w"))


@query("agg34_weight_map", f"WITH {fx.PIXELS_SQL}, s AS (SELECT shot, ix, iy, sum(w * (t % 2)) AS a, sum(w) AS w, sum(w * v / 53.1234567::DOUBLE) AS b FROM pixels GROUP BY ALL), n AS (SELECT shot, ix, iy, CASE WHEN w < 0.01 THEN 0 ELSE a / w END AS up, CASE WHEN w < 0.01 THEN 0 ELSE b / w END AS f FROM s), g AS (SELECT q.shot, (i % 32)::INTEGER AS iu, (i // 32)::INTEGER AS iv, coalesce(up, 0.0) AS up, coalesce(f, 0.0) AS f FROM (SELECT DISTINCT shot FROM n) q CROSS JOIN range(1024) r(i) LEFT JOIN n ON n.shot = q.shot AND ix = i % 32 AND iy = i // 32) SELECT shot, iu, iv, round(up * f, 5) + 0.0 AS weight FROM g")
def unblurred_weights(spark, d):
    """Weights by agreement and angle, without blur (a distance of 0)."""
    return _weights(spark, d, 0.0).select("shot", "iu", "iv", R("weight", 5).alias("weight"))


def _weights(spark, d, far):
    p = fx.pixels(spark, d).select("shot", F.col("ix").alias("iu"), F.col("iy").alias("iv"), "t", "v", "w")
    sums = lambda v: p.groupBy("shot", "iu", "iv").agg(F.sum(F.col("w") * v).alias("sum_wv"), F.sum("w").alias("sum_w"))
    return op.weight_map(sums(F.col("t") % 2), sums(F.col("v") / 53.1234567), 32, 32, far, far, ("shot",), tile=16)


def _blurred_sql(steps: int, dt: float, rx: float, ry: float) -> str:
    """The mismatch of slopes projected on the texture, thresholded, diffused step by step, times the projected angles."""
    from . import fusion_queries as fq

    w = "WINDOW r AS (PARTITION BY shot, iy ORDER BY ix), c AS (PARTITION BY shot, ix ORDER BY iy)"
    out = [
        f"{fq.GRID}, {fq.DEPTH}, {fq.NEAR}, a AS (SELECT shot, ix * 0.9::DOUBLE + 0.35::DOUBLE AS u, iy * 0.9::DOUBLE + 0.25::DOUBLE AS z, CASE WHEN {fq.AGREE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up, 1 / sqrt(1 + ((ix - 16) / 20.0::DOUBLE) ** 2 + ((iy - 16) / 25.0::DOUBLE) ** 2) AS f FROM s)",
        "k AS (SELECT shot, u, z, up, f, floor(u)::INTEGER + a1.d AS iu, floor(z)::INTEGER + b1.d AS iv FROM a, (VALUES (-1), (0), (1), (2)) a1(d), (VALUES (-1), (0), (1), (2)) b1(d))",
        "e AS (SELECT shot, iu, iv, up, f, 0.5 + 0.5 * cos(sqrt((iu - u) * (iu - u) + (iv - z) * (iv - z)) * 0.4 * pi() / sqrt(2)) AS c FROM k WHERE (iu - u) * (iu - u) + (iv - z) * (iv - z) <= 2.25)",
        "n AS (SELECT shot, iu, iv, CASE WHEN sum(c) < 0.01 THEN 0 ELSE sum(c * up) / sum(c) END AS up, CASE WHEN sum(c) < 0.01 THEN 0 ELSE sum(c * f) / sum(c) END AS f FROM e GROUP BY ALL)",
        "q0 AS (SELECT b.shot, (i % 32)::INTEGER AS ix, (i // 32)::INTEGER AS iy, coalesce(up, 0.0) AS upper, coalesce(f, 0.0) AS f, 1.0::DOUBLE AS v FROM (SELECT DISTINCT shot FROM n) b CROSS JOIN range(1024) r(i) LEFT JOIN n ON n.shot = b.shot AND iu = i % 32 AND iv = i // 32)",
    ]
    for j in range(steps):
        out.append(f"c{j} AS MATERIALIZED (SELECT shot, ix, iy, upper, f, least(v, upper) AS v FROM q{j})")
        out.append(f"q{j + 1} AS MATERIALIZED (SELECT shot, ix, iy, upper, f, v + {dt!r}::DOUBLE * ((coalesce(lag(v) OVER r, v) + coalesce(lead(v) OVER r, v) - 2 * v) * {rx!r}::DOUBLE + (coalesce(lag(v) OVER c, v) + coalesce(lead(v) OVER c, v) - 2 * v) * {ry!r}::DOUBLE) AS v FROM c{j} {w})")
    return ", ".join(out) + f" SELECT shot, ix AS iu, iy AS iv, round(v * f, 5) + 0.0 AS weight FROM q{steps}"


@query("agg34_mismatch_weights", _blurred_sql(*diffusion_steps(3.0, 2.0)))
def mismatch_weights(spark, d):
    """From depths to weights: slopes that don't fit the surface, projected on each shot's texture with the facets' angles, blurred over 3 texels
    along u and 2 along v."""
    from . import fusion_queries as fq

    v, r = F.col("v"), ("shot", "t")
    g = fq.op.dense(fx.pixels(spark, d).groupBy(*r, "ix", "iy").agg(F.max("v").alias("v")), 32, 32, frame=r)
    g = g.select(*r, "ix", "iy", F.when(v == 13, F.lit(float("nan"))).otherwise(100 + v).alias("z"), ((v - 25) / 10).alias("dx"), ((F.col("ix") - 16) / 8.0).alias("dy"))
    m = fq.op.slope_mismatch(g, (20.0, 25.0), r)
    x, y = (F.col("ix") - 16) / 20.0, (F.col("iy") - 16) / 25.0
    at = m.select("shot", (F.col("ix") * 0.9 + 0.35).alias("u"), (F.col("iy") * 0.9 + 0.25).alias("v"), F.when(F.col("m"), 0.0).otherwise(1.0).alias("agree"), (1 / F.sqrt(1 + x * x + y * y)).alias("angle"), F.lit(1.0).alias("w"))
    at = cut(at, "mismatch")
    sums = lambda c: project.splat(at.select("shot", "u", "v", F.col(c).alias("value"), "w"), "shot")
    return op.weight_map(sums("agree"), sums("angle"), 32, 32, 3.0, 2.0, ("shot",), tile=16).select("shot", "iu", "iv", R("weight", 5).alias("weight"))


@query("vec16_project_landmarks", f"WITH {fx.BOXES_SQL} SELECT mesh, vid, round(CASE WHEN z - 3 < 0 THEN (cos(0.3) * x - sin(0.3) * y + 0.1) / (3 - z) * 20 + 11.5 END, 6) AS px, round(CASE WHEN z - 3 < 0 THEN -(sin(0.3) * x + cos(0.3) * y - 0.2) / (3 - z) * 21 + 8.5 END, 6) AS py FROM vertices")
def project_landmarks(spark, d):
    """Vertices by a pose (a turn about z, a shift) into a pinhole picture; null behind the camera. Also SF-29: the turn is a rotation vector."""
    from ..functions import vec
    from ..operators import mesh

    pose = vec.rotation(F.lit(0.0), F.lit(0.0), F.lit(0.3))
    pose[3], pose[7], pose[11] = F.lit(0.1), F.lit(-0.2), F.lit(-3.0)
    px, py = vec.project(vec.vec(), pose, 20.0, 21.0, 11.5, 8.5)
    return mesh.box_vertices(fx.box_dims(spark, d)).select("mesh", "vid", R(px).alias("px"), R(py).alias("py"))
