"""Queries of surfaces with texture coordinates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import vec
from ..operators import fusion, mesh, uv as op
from ..session import cut, dealt, table
from ..sources import fixtures as fx
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)
#: Height fields whose texture is bent: quadrilaterals of any shape.
BENT = f"WITH {fx.GRIDS_SQL}, bent AS (SELECT mesh, facet, k, vid, x, y, z, 0.06::DOUBLE + 0.86::DOUBLE * u + 0.05::DOUBLE * sin(6 * v) AS u, 0.07::DOUBLE + 0.84::DOUBLE * v + 0.06::DOUBLE * sin(5 * u) AS v FROM gcorners JOIN gvertices USING (mesh, vid)), quad AS (SELECT mesh, facet, list(struct_pack(u := u, v := v) ORDER BY k) AS r FROM bent GROUP BY ALL)"
POINTS = "pts AS (SELECT l_suppkey AS mesh, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 97) / 96.0::DOUBLE AS u, (l_orderkey % 89) / 88.0::DOUBLE AS v FROM lineitem)"
INSIDE = " AND ".join(f"(r[{b}].u - r[{a}].u) * (p.v - r[{a}].v) - (p.u - r[{a}].u) * (r[{b}].v - r[{a}].v) >= 0" for a, b in ((1, 2), (2, 3), (3, 4), (4, 1)))
#: Box faces with the unit square as their texture; points of line items on them.
FACES = f"WITH {fx.BOXES_SQL}, face AS (SELECT mesh, facet, list(struct_pack(x := x, y := y, z := z) ORDER BY k) AS r FROM ring GROUP BY ALL), e AS (SELECT mesh, facet, r[1] AS o, r[2].x - r[1].x AS ax, r[2].y - r[1].y AS ay, r[2].z - r[1].z AS az, r[4].x - r[1].x AS bx, r[4].y - r[1].y AS by_, r[4].z - r[1].z AS bz FROM face), q AS (SELECT l_partkey AS mesh, (l_linenumber % 6)::INTEGER AS facet, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 97) / 96.0::DOUBLE AS u, (l_orderkey % 89) / 88.0::DOUBLE AS v FROM lineitem)"


def _bent(spark, d):
    v, c = mesh.grid_meshes(fx.grid_dims(spark, d), fx.GRID_N, fx.GRID_M)
    b = mesh.corner_points(c, v)
    u, w = F.col("u"), F.col("v")
    return b.withColumns({"u": 0.06 + 0.86 * u + 0.05 * F.sin(6 * w), "v": 0.07 + 0.84 * w + 0.06 * F.sin(5 * u)})


def _points(spark, d):
    n = table(spark, d, "lineitem")
    return n.select(F.col("l_suppkey").alias("mesh"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 97 / 96.0).alias("u"), (F.col("l_orderkey") % 89 / 88.0).alias("v"))


def _faces(spark, d):
    k = F.col("k")
    b = fx.box_dims(spark, d)
    r = mesh.corner_points(mesh.box_corners(b), mesh.box_vertices(b))
    return r.withColumns({"u": k.isin(1, 2).cast("double"), "v": k.isin(2, 3).cast("double")})


def _on_faces(spark, d):
    n = table(spark, d, "lineitem")
    return n.select(F.col("l_partkey").alias("mesh"), (F.col("l_linenumber") % 6).cast("int").alias("facet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 97 / 96.0).alias("u"), (F.col("l_orderkey") % 89 / 88.0).alias("v"))


@query("join03_bent_point_location", f"{BENT}, {POINTS}, h AS (SELECT p.mesh, p.id, min(facet) AS facet FROM pts p JOIN quad q ON q.mesh = p.mesh AND {INSIDE} GROUP BY ALL) SELECT mesh, id, facet FROM pts LEFT JOIN h USING (mesh, id)")
def bent_location(spark, d):
    return op.locate(_points(spark, d), op.cells(op.polygons(_bent(spark, d)))).select("mesh", "id", "facet")


@query("join02_uv_cells", f"{BENT}, b AS (SELECT mesh, facet, min(u) AS a, max(u) AS e, min(v) AS c, max(v) AS g FROM bent GROUP BY ALL) SELECT mesh, facet, true AS covered, 1 AS whole FROM b")
def uv_cells(spark, d):
    """Each facet's cells cover its bounds, and no cell encloses more than six facets."""
    c = op.cells(op.polygons(_bent(spark, d)))
    size = F.pow(F.lit(0.5), F.col("depth"))
    lo = lambda a: F.col(f"c_{a}") * size
    held = (F.col("lo_u") >= lo("u")) & (F.col("hi_u") <= lo("u") + size) & (F.col("lo_v") >= lo("v")) & (F.col("hi_v") <= lo("v") + size)
    c = cut(c, "uv-cells")
    full = c.groupBy("mesh", "depth", "c_u", "c_v").agg(F.count_if(held).alias("n")).groupBy("mesh").agg((F.max("n") <= 6).cast("int").alias("whole"))
    ends = [F.min(lo("u")) <= F.first("lo_u"), F.max(lo("u") + size) >= F.first("hi_u"), F.min(lo("v")) <= F.first("lo_v"), F.max(lo("v") + size) >= F.first("hi_v")]
    return c.groupBy("mesh", "facet").agg((ends[0] & ends[1] & ends[2] & ends[3]).alias("covered")).join(dealt(full), "mesh").select("mesh", "facet", "covered", "whole")


@query("join01_space_cells", f"WITH {fx.BOXES_SQL} SELECT mesh, facet, 0 AS depth, 1::BIGINT AS n FROM (SELECT DISTINCT mesh, facet FROM corners)")
def space_cells(spark, d):
    """A box has six facets: one cell holds them all."""
    rings = _faces(spark, d).groupBy("mesh", "facet").agg(F.collect_list(F.struct("x", "y", "z")).alias("ring"))
    return op.space_cells(rings).groupBy("mesh", "facet", "depth").agg(F.count("*").alias("n"))


@query("vec17_uv_to_xyz", f"{FACES} SELECT mesh, facet, id, round(o.x + u * ax + v * bx, 6) + 0.0 AS x, round(o.y + u * ay + v * by_, 6) + 0.0 AS y, round(o.z + u * az + v * bz, 6) + 0.0 AS z FROM q JOIN e USING (mesh, facet)")
def uv_to_xyz(spark, d):
    return op.to_xyz(_on_faces(spark, d), op.frames(_faces(spark, d))).select("mesh", "facet", "id", *(R(c).alias(c) for c in "xyz"))


@query("vec13_hit_uv", f"{FACES} SELECT mesh, facet, id, round(u, 6) AS u, round(v, 6) AS v, round((ax + 2 * ay - az) / (ax * ax + ay * ay + az * az), 6) + 0.0 AS du_h, round((bx + 2 * by_ - bz) / (bx * bx + by_ * by_ + bz * bz), 6) + 0.0 AS dv_h FROM q JOIN e USING (mesh, facet)")
def hit_uv(spark, d):
    """Places on facets back to texture coordinates, and what a shift of (1, 2, -1) changes of these."""
    f = cut(op.frames(_faces(spark, d)), "frames")
    hits = op.to_xyz(_on_faces(spark, d), f).drop("u", "v")
    out = op.to_uv(hits, f, {"h": (F.lit(1.0), F.lit(2.0), F.lit(-1.0))})
    return out.select("mesh", "facet", "id", *(R(c).alias(c) for c in ("u", "v", "du_h", "dv_h")))


@query("vec18_planar_corner_uv", f"{FACES}, m AS (SELECT mesh, facet, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ring GROUP BY ALL) SELECT mesh, facet, k, round(((x - mx) * ax + (y - my) * ay + (z - mz) * az) / sqrt(ax * ax + ay * ay + az * az), 6) + 0.0 AS u, round(((x - mx) * bx + (y - my) * by_ + (z - mz) * bz) / sqrt(bx * bx + by_ * by_ + bz * bz), 6) + 0.0 AS v FROM ring JOIN m USING (mesh, facet) JOIN e USING (mesh, facet)")
def planar_corner_uv(spark, d):
    """Corners in the planar parameters of surfaces of one face each."""
    r = _faces(spark, d).drop("u", "v")
    surface = r.select("mesh", "facet", F.col("facet").alias("surface")).distinct()
    p = mesh.planar_parameters(r, surface).withColumnRenamed("surface", "facet")
    j = r.join(dealt(p), ["mesh", "facet"])
    off = vec.sub(vec.vec(), vec.vec("m"))
    return j.select("mesh", "facet", "k", R(vec.dot(off, vec.vec("u"))).alias("u"), R(vec.dot(off, vec.vec("v"))).alias("v"))


@query("vec19_step_sizes", f"{FACES} SELECT mesh, facet, round(sqrt(ax * ax + ay * ay + az * az) / 64, 6) AS du, round(sqrt(bx * bx + by_ * by_ + bz * bz) / 32, 6) AS dv FROM e")
def step_sizes(spark, d):
    return op.step_sizes(op.frames(_faces(spark, d)), 64, 32).select("mesh", "facet", R("du").alias("du"), R("dv").alias("dv"))


@query("agg08_inverse_fit", f"{FACES}, s AS (SELECT mesh, facet, sqrt(ax * ax + ay * ay + az * az) AS a, sqrt(bx * bx + by_ * by_ + bz * bz) AS b FROM e) SELECT mesh, facet, round(1 / a, 6) AS a11, round(1 / b, 6) AS a22, round(a, 6) AS i11, 0.0::DOUBLE AS i12, 0.0::DOUBLE AS i21, round(b, 6) AS i22 FROM s")
def inverse_fit(spark, d):
    f = op.frames(_faces(spark, d))
    return f.select("mesh", "facet", *(R(c).alias(c) for c in ("a11", "a22", "i11", "i12", "i21", "i22")))


@query("join19_grid_attributes", f"{BENT}, g AS (SELECT s_suppkey AS mesh, (i % 24)::INTEGER AS ix, (i // 24)::INTEGER AS iy, ((i % 24) + 0.5::DOUBLE) / 24 AS u, ((i // 24) + 0.5::DOUBLE) / 16 AS v FROM supplier, range(384) r(i)), h AS (SELECT p.mesh, p.ix, p.iy, min(facet) AS facet FROM g p JOIN quad q ON q.mesh = p.mesh AND {INSIDE} GROUP BY ALL) SELECT mesh, ix, iy, facet, facet * 0.5::DOUBLE AS value FROM g LEFT JOIN h USING (mesh, ix, iy)")
def grid_attributes(spark, d):
    b = _bent(spark, d)
    values = b.select("mesh", "facet", (F.col("facet") * 0.5).alias("value")).distinct()
    return op.grid_attributes(fx.grid_dims(spark, d), op.cells(op.polygons(b)), values, 24, 16)


@query("join08_landmark_places", f"{FACES}, l2 AS (SELECT p_partkey AS mesh, 'L' || p_partkey % 5 AS name, (p_partkey % 13) / 10.0::DOUBLE AS u, (p_partkey % 7) / 7.0::DOUBLE AS v FROM part), l3 AS (SELECT p_partkey AS mesh, 'L' || p_partkey % 3 AS name, p_size::DOUBLE AS x, 1.0::DOUBLE AS y, 2.0::DOUBLE AS z FROM part), f AS (SELECT l2.mesh, name, CASE WHEN u <= 1 THEN o.x + u * ax + v * bx END AS x, CASE WHEN u <= 1 THEN o.y + u * ay + v * by_ END AS y, CASE WHEN u <= 1 THEN o.z + u * az + v * bz END AS z FROM l2 JOIN e ON e.mesh = l2.mesh AND e.facet = 0) SELECT mesh, name, round(coalesce(l3.x, f.x), 6) + 0.0 AS x, round(coalesce(l3.y, f.y), 6) + 0.0 AS y, round(coalesce(l3.z, f.z), 6) + 0.0 AS z, CASE WHEN l3.x IS NOT NULL THEN '3d' WHEN f.x IS NOT NULL THEN '2d' END AS kind FROM f FULL JOIN l3 USING (mesh, name)")
def landmark_places(spark, d):
    """Landmarks of box bottoms by texture, some of them in space, too, some beside the texture."""
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    name = lambda n: F.concat(F.lit("L"), (k % n).cast("string")).alias("name")
    two = p.select(k.alias("mesh"), name(5), (k % 13 / 10.0).alias("u"), (k % 7 / 7.0).alias("v"))
    three = p.select(k.alias("mesh"), name(3), F.col("p_size").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"))
    r = _faces(spark, d).where("facet = 0")
    out = op.landmark_places(two, three, op.cells(op.polygons(r)), op.frames(r))
    return out.select("mesh", "name", *(R(c).alias(c) for c in "xyz"), "kind")


@query("agg14_facet_lines", f"{FACES}, l AS (SELECT (o_orderkey % n + 1)::BIGINT AS mesh, o_orderkey AS line, (o_orderkey % 97) / 97.0::DOUBLE AS u1, (o_orderkey % 89) / 89.0::DOUBLE AS v1, (o_custkey % 83) / 83.0::DOUBLE * 1.1 AS u2, (o_custkey % 79) / 79.0::DOUBLE AS v2 FROM orders, (SELECT count(*) AS n FROM part)), s AS (SELECT *, floor(1 + sqrt(((u2 - u1) / 0.05) ** 2 + ((v2 - v1) / 0.1) ** 2))::INTEGER AS steps FROM l), w AS (SELECT *, u1 + (steps - 0.5::DOUBLE) / steps * (u2 - u1) > 1 OR u1 + 0.5::DOUBLE / steps * (u2 - u1) > 1 AS lost FROM s) SELECT w.mesh, line, steps, CASE WHEN NOT lost THEN round(sqrt((u2 - u1) ** 2 * (ax * ax + ay * ay + az * az) + (v2 - v1) ** 2 * (bx * bx + by_ * by_ + bz * bz)), 5) END AS length, CASE WHEN NOT lost AND e.mesh IS NOT NULL THEN w.mesh * 0.5::DOUBLE END AS mean FROM w LEFT JOIN e ON e.mesh = w.mesh AND e.facet = 0")
def facet_lines(spark, d):
    """Segments over box bottoms, some of which leave the texture or belong to no box."""
    o = table(spark, d, "orders").crossJoin(F.broadcast(table(spark, d, "part").agg(F.count("*").alias("n"))))  # one row
    part = lambda c, n: F.col(c) % n / float(n)
    l = o.select((F.col("o_orderkey") % F.col("n") + 1).alias("mesh"), F.col("o_orderkey").alias("line"), part("o_orderkey", 97).alias("u1"), part("o_orderkey", 89).alias("v1"), (part("o_custkey", 83) * 1.1).alias("u2"), part("o_custkey", 79).alias("v2"))  # noqa: E741
    r = _faces(spark, d).where("facet = 0")
    values = r.select("mesh", "facet", (F.col("mesh") * 0.5).alias("value")).distinct()
    return op.facet_line_means(l, op.cells(op.polygons(r)), op.frames(r), values, 0.05, 0.1).select("mesh", "line", "steps", R("length", 5).alias("length"), "mean")


SPLAT = f"""WITH {fx.PIXELS_SQL}, fused AS (SELECT ix, iy, t, sum(w * v) / sum(w) AS v, sum(w) AS w FROM pixels WHERE w > 0 GROUP BY ALL),
p AS (SELECT t, 0.1 + ix / 40.0::DOUBLE AS u, 0.05 + iy / 36.0::DOUBLE AS z, v AS value, w, 0.02::DOUBLE AS a, 0.001::DOUBLE * t AS b, 0.002::DOUBLE AS c, 0.03::DOUBLE AS e FROM fused),
k AS (SELECT p.*, iu::INTEGER AS iu, iv::INTEGER AS iv, iu - (u * 48 - 0.5) AS x, iv - (z * 40 - 0.5) AS y FROM p, range(48) q(iu), range(40) r(iv) WHERE abs(iu - (u * 48 - 0.5)) <= 4 AND abs(iv - (z * 40 - 0.5)) <= 4),
s AS (SELECT *, ((e * x / 48 - c * y / 40) / (a * e - c * b)) ** 2 + ((a * y / 40 - b * x / 48) / (a * e - c * b)) ** 2 AS r2 FROM k),
g AS (SELECT *, w * CASE WHEN sqrt(r2) * {0.4 * math.pi / math.sqrt(2)!r}::DOUBLE > pi() THEN 0 ELSE 0.5 + 0.5 * cos(sqrt(r2) * {0.4 * math.pi / math.sqrt(2)!r}::DOUBLE) END AS h FROM s WHERE x * x + y * y <= 2.25 OR r2 <= 2.25)"""


def _footprints(spark, d):
    f = fusion.fuse(fx.pixels(spark, d))
    return f.select("t", (0.1 + F.col("ix") / 40.0).alias("u"), (0.05 + F.col("iy") / 36.0).alias("v"), F.col("v").alias("value"), "w", F.lit(0.02).alias("du_h"), (0.001 * F.col("t")).alias("dv_h"), F.lit(0.002).alias("du_v"), F.lit(0.03).alias("dv_v"))


@query("agg01_footprints", f"{SPLAT} SELECT t, iu, iv, round(sum(h * value), 5) + 0.0 AS sum_wv, round(sum(h), 5) + 0.0 AS sum_w FROM g GROUP BY ALL")
def footprints(spark, d):
    return op.splat_footprints(_footprints(spark, d), 48, 40, "t").select("t", "iu", "iv", R("sum_wv", 5).alias("sum_wv"), R("sum_w", 5).alias("sum_w"))


@query("agg01_weighted_footprints", f"{SPLAT} SELECT t, iu, iv, round(sum(h * value * (iu + iv) / 88.0::DOUBLE), 5) + 0.0 AS sum_wv, round(sum(h * (iu + iv) / 88.0::DOUBLE), 5) + 0.0 AS sum_w FROM g WHERE iu >= 4 GROUP BY ALL")
def weighted_footprints(spark, d):
    """With a weight for each texel; the first four columns have none."""
    w = fx.texels(spark, 48, 40).where("iu >= 4").withColumn("cw", (F.col("iu") + F.col("iv")) / 88.0)
    return op.splat_footprints(_footprints(spark, d), 48, 40, "t", cell_weights=w).select("t", "iu", "iv", R("sum_wv", 5).alias("sum_wv"), R("sum_w", 5).alias("sum_w"))


TRI = f"WITH {fx.LINES_SQL}"


def _triangles(spark, d):
    """A triangle of each line's ends and the corner (u1, v2)."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return fx.lines(spark, d).withColumn("ring", F.array(at("u1", "v1"), at("u2", "v2"), at("u1", "v2")))


BOX = (0.31, 0.42, 0.63, 0.74)


def _hit(a, b, c, e):
    return f"(abs(({a} + {c}) / 2 - 0.47::DOUBLE) <= 0.16::DOUBLE + abs({c} - {a}) / 2 AND abs(({b} + {e}) / 2 - 0.58::DOUBLE) <= 0.16::DOUBLE + abs({e} - {b}) / 2 AND abs((({a} + {c}) / 2 - 0.47::DOUBLE) * ({e} - {b}) / 2 - (({b} + {e}) / 2 - 0.58::DOUBLE) * ({c} - {a}) / 2) <= 0.16::DOUBLE * abs({e} - {b}) / 2 + 0.16::DOUBLE * abs({c} - {a}) / 2)"


def _in(x, y):
    return f"((u2 <> u1 AND v2 <> v1) AND ({x}::DOUBLE - u1) / (u2 - u1) >= 0 AND ({y}::DOUBLE - v2) / (v1 - v2) >= 0 AND ({x}::DOUBLE - u1) / (u2 - u1) + ({y}::DOUBLE - v2) / (v1 - v2) <= 1)"


@query("pred13_polygon_touches_box", f"{TRI} SELECT line, ({_hit('u1', 'v1', 'u2', 'v2')} OR {_hit('u2', 'v2', 'u1', 'v2')} OR {_hit('u1', 'v2', 'u1', 'v1')}) AS edge, ({' AND '.join(_in(x, y) for x in (0.31, 0.63) for y in (0.42, 0.74))}) AS box_inside, (least(u1, u2) >= 0.31 AND greatest(u1, u2) <= 0.63 AND least(v1, v2) >= 0.42 AND greatest(v1, v2) <= 0.74) AS enclosed FROM lines")
def polygon_box(spark, d):
    """PRED-06, 07, 08 and what they make together, for triangles and a box."""
    b = tuple(F.lit(x) for x in BOX)
    r = F.col("ring")
    return _triangles(spark, d).select("line", pr.polygon_hits_box2(r, *b).alias("edge"), pr.box_in_polygon2(r, *b).alias("box_inside"), pr.vertices_in_box(r, {"x": b[0], "y": b[1]}, {"x": b[2], "y": b[3]}).alias("enclosed"))


@query("sf34_winding_bands", f"{TRI} SELECT line, u1 > 0 AND v1 > 0 AND u1 + v1 < 1 OR (u1 = 0 AND v1 BETWEEN 0 AND 1) OR (v1 = 0 AND u1 BETWEEN 0 AND 1) OR (u1 + v1 = 1) AS inside FROM lines")
def winding(spark, d):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))])
    return fx.lines(spark, d).select("line", pr.inside_by_winding(pr.winding(ring, F.col("u1"), F.col("v1"))).alias("inside"))


@query("pred01_tolerance", f"{TRI} SELECT line, u2 >= -0.1 AND v2 >= -0.1 AND (u2 >= 0 AND v2 >= 0 OR (u2 >= 0 AND u2 <= 1) OR (v2 >= 0 AND v2 <= 1) OR sqrt(least(u2, 0) ** 2 + least(v2, 0) ** 2) <= 0.1) AND (u2 <= 1 AND v2 <= 1 OR (u2 <= 1 AND v2 <= 1.1 AND u2 >= 0) OR (v2 <= 1 AND u2 <= 1.1 AND v2 >= 0) OR sqrt(greatest(greatest(u2 - 1, -u2), 0) ** 2 + greatest(greatest(v2 - 1, -v2), 0) ** 2) <= 0.1) AS inside FROM lines")
def tolerance(spark, d):
    """The unit square with a band of a tenth around it."""
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    return fx.lines(spark, d).select("line", pr.in_polygon(ring, F.col("u2"), F.col("v2"), 0.1).alias("inside"))


@query("pred04_polygon_hits_box3", f"{FACES}, b AS (SELECT mesh, facet, min(x) AS a, max(x) AS e, min(y) AS c, max(y) AS g, min(z) AS h, max(z) AS i FROM ring GROUP BY ALL) SELECT mesh, facet, a <= 6.3 AND e >= 1.7 AND c <= 4.4 AND g >= 1.6 AND h <= 1.2 AND i >= 0.3 AS hit FROM b")
def polygon_box3(spark, d):
    rings = _faces(spark, d).groupBy("mesh", "facet").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y", "z"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"))).alias("ring"))
    j = rings.join(dealt(op.frames(_faces(spark, d))), ["mesh", "facet"])
    n = lambda *x: tuple(F.lit(v) for v in x)
    return j.select("mesh", "facet", pr.polygon_hits_box3(F.col("ring"), vec.vec("n"), vec.vec("e"), vec.vec("f"), n(1.7, 1.6, 0.3), n(6.3, 4.4, 1.2)).alias("hit"))


@query("vec09_hit_shifts", f"WITH {fx.BOXES_SQL} SELECT mesh, vid, round((5 - z) * 0.1 / 1.0, 6) + 0.0 AS ax, round((5 - z) * 0.2 / 1.0, 6) + 0.0 AS ay, 0.0::DOUBLE AS az, 0.25::DOUBLE AS bx, 0.5::DOUBLE AS by_, 0.0::DOUBLE AS bz FROM vertices")
def hit_shifts(spark, d):
    """Rays straight up from vertices to the plane z = 5: a change of direction moves the hit by the distance, one of origin by itself."""
    b = mesh.box_vertices(fx.box_dims(spark, d))
    lit = lambda *x: tuple(F.lit(float(v)) for v in x)
    up = lit(0, 0, 1)
    a = vec.hit_direction_shift(up, lit(0, 0, 5), vec.vec(), up, lit(0.1, 0.2, 0))
    o = vec.hit_origin_shift(up, up, lit(0.25, 0.5, 0.75))
    return b.select("mesh", "vid", *(R(e).alias("a" + c) for c, e in zip("xyz", a)), *(R(e).alias("b" + c + ("_" if c == "y" else "")) for c, e in zip("xyz", o)))


@query("vec12_ray_shifts", f"WITH {fx.PIXELS_SQL} SELECT shot, ix, iy, t, round((ix - 15.5) / 20 + (iy - 15.5) / 25.0, 6) + 0.0 AS a, 0.0::DOUBLE AS b FROM pixels")
def ray_shifts(spark, d):
    """Unit directions stay unit ones: their shifts stand at right angles to them; hits on the plane z = -1 move a pixel's width."""
    lit = lambda *x: tuple(F.lit(float(v)) for v in x)
    p = (F.col("ix"), F.col("iy"), 20.0, 25.0, 15.5, 15.5)
    u, (right, down) = vec.pixel_ray(*p), vec.pixel_ray_shifts(*p)
    at = lambda c: vec.hit_direction_shift(lit(0, 0, 1), lit(0, 0, -1), lit(0, 0, 0), u, c)
    a = (F.col("ix") - 15.5) * at(right)[0] - (F.col("iy") - 15.5) * at(down)[1]
    return fx.pixels(spark, d).select("shot", "ix", "iy", "t", R(a).alias("a"), R(vec.dot(u, right) + vec.dot(u, down)).alias("b"))
