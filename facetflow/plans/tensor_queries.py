"""Queries of curvature tensors at points and along lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mesh, tensors as op, uv
from ..session import cut
from ..sources import fixtures as fx
from .registry import query
from .surface_queries import _AXES, W, _boxes

R = lambda c, n=6: (F.round(c, n) + 0.0)
N = 32
_RASTER = "r AS (SELECT ix, iy, max(v) / 10 AS c11, (ix % 3) / 4.0::DOUBLE AS c12, (iy % 3) / 4.0::DOUBLE AS c21, (ix + iy) / 16.0::DOUBLE AS c22, 0.02::DOUBLE + ix / 1000.0::DOUBLE AS wide, 0.03::DOUBLE + iy / 1000.0::DOUBLE AS high FROM pixels WHERE (ix + 3 * iy) % 7 <> 0 GROUP BY ix, iy)"
_LINES = fx.LINES_SQL + ", few AS (SELECT line, u1, v1, CASE WHEN line % 40 = 0 THEN u1 ELSE u2 END AS u2, CASE WHEN line % 40 = 0 THEN v1 ELSE v2 END AS v2 FROM lines)"
_SUMS = f"""t AS (SELECT line, u1, v1, u2, v2, floor(1 + sqrt(((u2 - u1) * {N}) ** 2 + ((v2 - v1) * {N}) ** 2))::BIGINT AS steps FROM pieces),
s AS (SELECT *, (u2 - u1) / steps AS su, (v2 - v1) / steps AS sv, u1 + (j + 0.5::DOUBLE) / steps * (u2 - u1) AS u, v1 + (j + 0.5::DOUBLE) / steps * (v2 - v1) AS v FROM (SELECT *, unnest(range(steps)) AS j FROM t)),
g AS (SELECT s.*, r.c11, r.c12, r.c21, r.c22, wide, high, sqrt(su * su + sv * sv) AS h FROM s LEFT JOIN r ON r.ix = floor(u * {N}) AND r.iy = floor(v * {N})),
d AS (SELECT line, CASE WHEN c11 IS NULL THEN h ELSE sqrt((wide * su * {N}) ** 2 + (high * sv * {N}) ** 2) END AS along, coalesce((su * (c11 * su + c12 * sv) + sv * (c21 * su + c22 * sv)) / nullif(h * h, 0), CASE WHEN c11 IS NULL THEN 0 END) AS bend,
coalesce((sv * (c11 * sv - c12 * su) - su * (c21 * sv - c22 * su)) / nullif(h * h, 0), CASE WHEN c11 IS NULL THEN 0 END) AS across, coalesce((c11 + c22) / 2, 0) AS m, coalesce(sqrt((c11 - c22) ** 2 / 4 + c12 * c21), 0) AS o FROM g),
q AS (SELECT line, count(*)::INTEGER AS steps, sum(along) AS length, sum(along * bend) AS b, sum(along * across) AS a, max(m + o) AS k1, max(m - o) AS k2 FROM d GROUP BY line)
SELECT q.line, steps, round(length, 6) + 0.0 AS length, round(CASE WHEN length > 0 THEN b / length ELSE k1 END, 4) + 0.0 AS curvature, round(CASE WHEN length > 0 THEN a / length ELSE k2 END, 4) + 0.0 AS cross_curvature, round(atan2(v2 - v1, u2 - u1), 6) + 0.0 AS theta FROM q JOIN few USING (line)"""


def _raster(spark, d):
    """A tensor and the sizes of a cell by cell of the pixels' raster; some cells are missing."""
    p = fx.pixels(spark, d).where("(ix + 3 * iy) % 7 <> 0").groupBy("ix", "iy").agg((F.max("v") / 10).cast("double").alias("c11"))
    return p.select("ix", "iy", "c11", (F.col("ix") % 3 / 4.0).alias("c12"), (F.col("iy") % 3 / 4.0).alias("c21"), ((F.col("ix") + F.col("iy")) / 16.0).alias("c22"), (0.02 + F.col("ix") / 1000.0).alias("su"), (0.03 + F.col("iy") / 1000.0).alias("sv"))


def _few(spark, d):
    """Orders as segments; every fortieth is a point."""
    still = F.col("line") % 40 == 0
    return fx.lines(spark, d).select("line", "u1", "v1", *(F.when(still, F.col(c + "1")).otherwise(F.col(c + "2")).alias(c + "2") for c in "uv"))


def _shown(out):
    return out.select("line", "steps", R("length").alias("length"), R("curvature", 4).alias("curvature"), R("cross", 4).alias("cross_curvature"), R("theta").alias("theta"))


@query("agg15_raster_line_curvature", f"WITH {_LINES}, {fx.PIXELS_SQL}, {_RASTER}, pieces AS (SELECT * FROM few), {_SUMS}")
def raster_lines(spark, d):
    return _shown(op.raster_line_curvature(_few(spark, d), _raster(spark, d), N, N, 1 / N, 1 / N))


@query("agg16_mirrored_line_curvature", f"""WITH {_LINES}, {fx.PIXELS_SQL}, {_RASTER},
c AS (SELECT *, list_sort(list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_filter([(0 - u1) / nullif(u2 - u1, 0), (1 - u1) / nullif(u2 - u1, 0), (0 - v1) / nullif(v2 - v1, 0), (1 - v1) / nullif(v2 - v1, 0)], lambda t: t > 0 AND t < 1)))) AS ts FROM few),
h AS (SELECT line, u1, v1, u2, v2, ts[i] AS t0, ts[i + 1] AS t1, (ts[i] + ts[i + 1]) / 2 AS tm FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM c)),
k AS (SELECT line, u1 + t0 * (u2 - u1) AS a0, u1 + t1 * (u2 - u1) AS a1, v1 + t0 * (v2 - v1) AS b0, v1 + t1 * (v2 - v1) AS b1, u1 + tm * (u2 - u1) AS am, v1 + tm * (v2 - v1) AS bm FROM h),
pieces AS (SELECT line, {", ".join(f"CASE WHEN {x}m < 0 THEN -{x}{i} WHEN {x}m > 1 THEN 2 - {x}{i} ELSE {x}{i} END AS {c}{i + 1}" for i in (0, 1) for x, c in (("a", "u"), ("b", "v")))} FROM k), {_SUMS}""")
def mirrored_lines(spark, d):
    return _shown(op.mirrored_line_curvature(_few(spark, d), _raster(spark, d), N, N, 1 / N, 1 / N))


def _bent_boxes(spark, d):
    """Boxes whose faces have the unit square as texture and whose vertices have curvatures and tangents; some lack them."""
    c, v = _boxes(spark, d)
    k = F.col("k")
    ring = cut(mesh.corner_points(c, v).withColumns({"u": k.isin(1, 2).cast("double"), "v": k.isin(2, 3).cast("double")}), "ring")
    n = lambda x: F.lit(float(x))
    bent = v.select("mesh", "vid", F.when((F.col("mesh") % 5 != 0) | (F.col("vid") != 6), F.col("vid") + 1.0).alias("k1"), (F.col("vid") * -0.25).alias("k2"), *(n(x).alias(a) for a, x in zip(("ax", "ay", "az", "bx", "by", "bz"), (1, 0.5, 0.25, -0.5, 1, 0.3))))
    frames = cut(uv.frames(ring), "frames")
    return ring, frames, op.corner_tensors(ring, bent, frames)


_CORNERS = f"""{W}, {_AXES}, p AS (SELECT mesh, facet, list(struct_pack(x := x, y := y, z := z, vid := vid) ORDER BY k) AS r FROM ring GROUP BY ALL),
b AS (SELECT mesh, facet, r, nx, ny, nz, sqrt((r[2].x - r[1].x) ** 2 + (r[2].y - r[1].y) ** 2 + (r[2].z - r[1].z) ** 2) AS le, sqrt((r[3].x - r[2].x) ** 2 + (r[3].y - r[2].y) ** 2 + (r[3].z - r[2].z) ** 2) AS lf FROM p JOIN ax USING (facet)),
e AS (SELECT *, (r[2].x - r[1].x) / le AS ex, (r[2].y - r[1].y) / le AS ey, (r[2].z - r[1].z) / le AS ez FROM b), f AS (SELECT *, ny * ez - nz * ey AS fx, nz * ex - nx * ez AS fy, nx * ey - ny * ex AS fz FROM e),
o AS (SELECT mesh, facet, le, lf, ex, ey, ez, fx, fy, fz, (r[1].x + r[2].x + r[3].x + r[4].x) / 4 AS cx, (r[1].y + r[2].y + r[3].y + r[4].y) / 4 AS cy, (r[1].z + r[2].z + r[3].z + r[4].z) / 4 AS cz, unnest(r) AS q FROM f),
w AS (SELECT mesh, facet, le, lf, ex, ey, ez, fx, fy, fz, cx, cy, cz, q.x AS x, q.y AS y, q.z AS z, CASE WHEN mesh % 5 <> 0 OR q.vid <> 6 THEN q.vid + 1.0::DOUBLE END AS k1, q.vid * -0.25::DOUBLE AS k2,
 ex + 0.5 * ey + 0.25 * ez AS p1, fx + 0.5 * fy + 0.25 * fz AS q1, -0.5 * ex + ey + 0.3 * ez AS p2, -0.5 * fx + fy + 0.3 * fz AS q2 FROM o),
t AS (SELECT *, k1 * p1 * p1 / (p1 * p1 + q1 * q1) + k2 * p2 * p2 / (p2 * p2 + q2 * q2) AS t11, k1 * p1 * q1 / (p1 * p1 + q1 * q1) + k2 * p2 * q2 / (p2 * p2 + q2 * q2) AS t12, k1 * q1 * q1 / (p1 * p1 + q1 * q1) + k2 * q2 * q2 / (p2 * p2 + q2 * q2) AS t22 FROM w)"""


@query("agg11_texture_tensors", f"""{_CORNERS}, d AS (SELECT *, sqrt((cx + 0.1 * le * ex + 0.2 * lf * fx - x) ** 2 + (cy + 0.1 * le * ey + 0.2 * lf * fy - y) ** 2 + (cz + 0.1 * le * ez + 0.2 * lf * fz - z) ** 2) AS d FROM t),
m AS (SELECT *, 1 / (d + max(d) OVER (PARTITION BY mesh, facet) / 1e4) AS w FROM d), s AS (SELECT mesh, facet, le, lf, CASE WHEN count(t11) = 4 THEN sum(w * t11) / sum(w) END AS t11, CASE WHEN count(t11) = 4 THEN sum(w * t12) / sum(w) END AS t12, CASE WHEN count(t11) = 4 THEN sum(w * t22) / sum(w) END AS t22 FROM m GROUP BY ALL)
SELECT mesh, facet, round(t11, 5) + 0.0 AS c11, round(t12 * lf / le, 5) + 0.0 AS c12, round(t12 * le / lf, 5) + 0.0 AS c21, round(t22, 5) + 0.0 AS c22 FROM s""")
def texture_tensors(spark, d):
    """The tensor at a place of each face of each box, from its corners' curvatures, in texture coordinates."""
    ring, frames, corners = _bent_boxes(spark, d)
    points = ring.select("mesh", "facet").distinct().select("mesh", "facet", F.struct("mesh", "facet").alias("id"), F.lit(0.6).alias("u"), F.lit(0.7).alias("v"))
    return op.texture_tensors(points, corners, frames).select("mesh", "facet", *(R(c, 5).alias(c) for c in ("c11", "c12", "c21", "c22")))


@query("agg14_facet_line_curvature", f"""{_CORNERS}, j AS (SELECT mesh, 1 + floor(sqrt((0.8::DOUBLE / 0.25) ** 2 + (0.4::DOUBLE / 0.25) ** 2))::BIGINT AS n FROM boxes),
i AS (SELECT mesh, n, 0.1 + 0.8 * (k + 0.5::DOUBLE) / n AS u, 0.3 + 0.4 * (k + 0.5::DOUBLE) / n AS v FROM (SELECT *, unnest(range(n)) AS k FROM j)),
d AS (SELECT t.*, i.n, i.u, i.v, sqrt((cx + (u - 0.5) * le * ex + (v - 0.5) * lf * fx - x) ** 2 + (cy + (u - 0.5) * le * ey + (v - 0.5) * lf * fy - y) ** 2 + (cz + (u - 0.5) * le * ez + (v - 0.5) * lf * fz - z) ** 2) AS d FROM t JOIN i ON i.mesh = t.mesh WHERE t.facet = 0),
m AS (SELECT *, 1 / (d + max(d) OVER (PARTITION BY mesh, u) / 1e4) AS w FROM d), s AS (SELECT mesh, u, n, le, lf, count(t11) AS c, sum(w * t11) / sum(w) AS t11, sum(w * t12) / sum(w) AS t12, sum(w * t22) / sum(w) AS t22 FROM m GROUP BY ALL),
bb AS (SELECT mesh, n, c, sqrt((0.8 * le / n) ** 2 + (0.4 * lf / n) ** 2) AS along, (0.64 * t11 + 0.32 * t12 * lf / le + 0.32 * t12 * le / lf + 0.16 * t22) / 0.8 AS bend, (0.16 * t11 - 0.32 * t12 * lf / le - 0.32 * t12 * le / lf + 0.64 * t22) / 0.8 AS across FROM s)
SELECT mesh, count(*)::INTEGER AS steps, CASE WHEN min(c) = 4 THEN round(sum(along), 6) END AS length, CASE WHEN min(c) = 4 THEN round(sum(along * bend) / sum(along), 4) + 0.0 END AS curvature, CASE WHEN min(c) = 4 THEN round(sum(along * across) / sum(along), 4) + 0.0 END AS cross_curvature FROM bb GROUP BY mesh""")
def facet_line(spark, d):
    """A line over the smallest face at its places of each box's shared texture: length and curvatures by facet."""
    ring, frames, corners = _bent_boxes(spark, d)
    leaves = uv.cells(uv.polygons(ring.select("mesh", "facet", "k", "u", "v")))
    n = lambda x: F.lit(float(x))
    lines = ring.select("mesh").distinct().select("mesh", F.lit(0).alias("line"), n(0.1).alias("u1"), n(0.3).alias("v1"), n(0.9).alias("u2"), n(0.7).alias("v2"))
    out = op.facet_line_curvature(lines, leaves, frames, corners, 0.25, 0.25)
    return out.select("mesh", "steps", R("length").alias("length"), R("curvature", 4).alias("curvature"), R("cross", 4).alias("cross_curvature"))
