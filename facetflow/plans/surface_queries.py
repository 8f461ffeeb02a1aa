"""Queries of surfaces: files of meshes, texture fits, curvature, mirrored lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import mesh, surface as op
from ..session import cut, dealt, discard, table
from ..sources import fixtures as fx, stl, x3d
from .registry import query

W = f"WITH {fx.BOXES_SQL}"
R = lambda c, n=6: (F.round(c, n) + 0.0)


def _boxes(spark, d):
    b = fx.box_dims(spark, d)
    return mesh.box_corners(b), mesh.box_vertices(b)


def _numbered(meshes):
    """mesh, at: its place among all meshes, from 0. Ranges of meshes are numbered apart; a row a range says how many lie before it."""
    ids = meshes.where("mesh is not null").repartitionByRange("mesh").sortWithinPartitions("mesh").select("mesh", F.monotonically_increasing_id().alias("id"))
    ids = cut(ids.select("mesh", F.shiftright("id", 33).alias("part"), F.expr("id & 8589934591").alias("k")), "numbered-meshes")
    n = ids.groupBy("part").agg(F.count("*").alias("n"))
    before = n.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ids.join(F.broadcast(before), "part").select("mesh", (F.col("before") + F.col("k")).alias("at"))


@query("src03_x3d_vertices", f"{W} SELECT mesh, vid, x, y, z FROM vertices")
def x3d_vertices(spark, d):
    """All boxes written as X3D texts and read back."""
    found = x3d.shapes(x3d.texts(*_boxes(spark, d)).withColumnRenamed("mesh", "doc"))
    return x3d.vertices(found).select(F.col("mesh.doc").cast("long").alias("mesh"), F.col("vid").cast("int").alias("vid"), "x", "y", "z")


@query("snk01_x3d_polygons", f"{W} SELECT mesh, facet, facet * 5 AS start, count(*) AS size FROM corners GROUP BY ALL")
def x3d_polygons(spark, d):
    found = x3d.shapes(x3d.texts(*_boxes(spark, d)).withColumnRenamed("mesh", "doc"))
    p = mesh.packed_polygons(x3d.packed(found))
    return p.select(F.col("mesh.doc").cast("long").alias("mesh"), F.col("facet").cast("int").alias("facet"), "start", "size")


_AXES = "ax AS (SELECT * FROM (VALUES (0, 0, 0, -1), (1, 0, 0, 1), (2, 0, -1, 0), (3, 1, 0, 0), (4, 0, 1, 0), (5, -1, 0, 0)) a(facet, nx, ny, nz))"


@query("src03_x3d_attributes", f"{W}, {_AXES} SELECT mesh, facet, k, vid, (k IN (1, 2))::INTEGER::DOUBLE AS u, (k IN (2, 3))::INTEGER::DOUBLE AS v, nx::DOUBLE AS nx, ny::DOUBLE AS ny, nz::DOUBLE AS nz FROM corners JOIN ax USING (facet)")
def x3d_attributes(spark, d):
    """Boxes with texture coordinates and facet normals written as X3D and read back, corner by corner."""
    c, v = _boxes(spark, d)
    uv = c.withColumns({"u": F.col("k").isin(1, 2).cast("double"), "v": F.col("k").isin(2, 3).cast("double")})
    found = x3d.shapes(x3d.texts(uv, v, mesh.normals(mesh.corner_points(c, v))).withColumnRenamed("mesh", "doc"))
    out = x3d.corners(found).select(F.col("mesh.doc").cast("long").alias("mesh"), "facet", "k", "vid", "u", "v", *((F.col(n) + 0.0).alias(n) for n in ("nx", "ny", "nz")))
    return out


@query("src03_x3d_curvatures", f"{W} SELECT mesh, vid, round(1 / (vid + mesh + 1.0::DOUBLE), 6) AS k1, -0.5::DOUBLE * vid AS k2, 1.0::DOUBLE AS ax, 1.0::DOUBLE AS bz FROM vertices")
def x3d_curvatures(spark, d):
    """Principal curvatures and their tangents in X3D and back."""
    c, v = _boxes(spark, d)
    n = lambda x: F.lit(float(x))
    bent = v.select("mesh", "vid", (1 / (F.col("vid") + F.col("mesh") + 1.0)).alias("k1"), (F.col("vid") * -0.5).alias("k2"), n(2).alias("ax"), n(0).alias("ay"), n(0).alias("az"), n(0).alias("bx"), n(0).alias("by"), n(3).alias("bz"))
    found = x3d.shapes(x3d.texts(c, v, None, bent).withColumnRenamed("mesh", "doc"))
    return x3d.curvatures(found).select(F.col("mesh.doc").cast("long").alias("mesh"), F.col("vid").cast("int").alias("vid"), R("k1").alias("k1"), R("k2").alias("k2"), "ax", "bz")


@query("src01_stl_surfaces", f"{W}, {_AXES}, r AS (SELECT mesh, facet, k, x + mesh * 100 AS x, y, z FROM ring), s AS (SELECT mesh, facet, sum(x * w) / 6 AS cx, sum(y * w) / 6 AS cy, sum(z * w) / 6 AS cz FROM (SELECT *, CASE WHEN k IN (0, 2) THEN 2 ELSE 1 END AS w FROM r) GROUP BY ALL) SELECT mesh, 2 AS n, nx::DOUBLE AS nx, ny::DOUBLE AS ny, nz::DOUBLE AS nz, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy, round(cz, 4) + 0.0 AS cz FROM s JOIN ax USING (facet)")
def stl_surfaces(spark, d):
    """Boxes beside each other as triangles in STL texts in millimetres without normals; read in metres, normals made, coplanar triangles joined."""
    from ..session import fresh_path

    c, v = _boxes(spark, d)
    r = mesh.corner_points(c, v).withColumn("x", F.col("x") + F.col("mesh") * 100)
    half = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(k).alias("t")) for h, ks in ((0, (0, 1, 2)), (1, (0, 2, 3))) for k in ks)))
    t = r.withColumn("a", half).where("a.t = k").select("mesh", (F.col("facet") * 2 + F.col("a.h")).alias("facet"), "k", *((F.col(a) * 1000).alias(a) for a in "xyz"), *(F.lit(0.0).alias(n) for n in ("nx", "ny", "nz")))
    path = fresh_path(spark, "stl")
    stl.write_stl_text(t, path)
    read = cut(stl.read_stl_text(spark, path, 0.001), "stl-triangles")
    discard(path)  # read whole
    files = cut(_numbered(read.select("mesh").distinct()), "stl-files").withColumnRenamed("mesh", "file")  # a row a file: its path would go with each corner
    tri = cut(stl.with_normals(read.withColumnRenamed("mesh", "file").join(files, "file").drop("file").withColumnRenamed("at", "mesh")), "triangles")
    discard(read)
    means = {"nx": "nx", "ny": "ny", "nz": "nz", "x": "cx", "y": "cy", "z": "cz"}
    facets = tri.groupBy("mesh", "facet").agg(*(F.sum(a).alias(a) for a in means), F.count("*").alias("corners"))
    s = stl.surfaces(tri, 0.5).join(dealt(facets), ["mesh", "facet"])
    whole = s.groupBy("mesh", "surface").agg(F.count("*").cast("int").alias("n"), *((F.sum(a) / F.sum("corners")).alias(o) for a, o in means.items()))
    return whole.select(F.floor(F.col("cx") / 100 + 1e-9).alias("mesh"), "n", *(R(a).alias(a) for a in ("nx", "ny", "nz")), *(R(a, 4).alias(a) for a in ("cx", "cy", "cz")))


@query("src01_stl_binary", f"{W}, {_AXES}, t AS (SELECT mesh, facet, x, y, z, CASE WHEN k IN (0, 2) THEN 2 ELSE 1 END AS w FROM ring) SELECT mesh, facet, 2 AS n, nx::DOUBLE AS nx, ny::DOUBLE AS ny, nz::DOUBLE AS nz, round(sum(x * w) / 6, 3) + 0.0 AS cx, round(sum(y * w) / 6, 3) + 0.0 AS cy, round(sum(z * w) / 6, 3) + 0.0 AS cz FROM t JOIN ax USING (facet) GROUP BY ALL")
def stl_binary(spark, d):
    """Boxes as binary STL files, each read by many tasks, record by record; records stand in the order of meshes and facets."""
    from ..session import fresh_path

    c, v = _boxes(spark, d)
    half = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(k).alias("t"), F.lit(n).alias("j")) for h, ks in ((0, (0, 1, 2)), (1, (0, 2, 3))) for n, k in enumerate(ks))))
    t = mesh.corner_points(c, v).join(dealt(mesh.normals(mesh.corner_points(c, v))), ["mesh", "facet"]).withColumn("a", half).where("a.t = k")
    t = t.select("mesh", (F.col("facet") * 2 + F.col("a.h")).alias("facet"), F.col("a.j").alias("k"), *"xyz", "nx", "ny", "nz")
    path = fresh_path(spark, "stl-binary")
    files = stl.write_stl_binary(t, path)
    start = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("start"))  # a row a file
    back = stl.read_stl_binary(spark, path, 1.0, 100_000).withColumn("file", F.substring_index("mesh", "/", -1)).join(F.broadcast(start), "file")
    back = back.withColumn("facet", F.col("facet") + F.col("start"))
    out = back.groupBy(F.expr("facet div 12").alias("at"), F.expr("cast(facet % 12 div 2 as int)").alias("facet")).agg(F.count_distinct("facet").cast("int").alias("n"), *(F.avg(a).alias(o) for a, o in (("nx", "nx"), ("ny", "ny"), ("nz", "nz"), ("x", "cx"), ("y", "cy"), ("z", "cz"))))
    out = out.join(dealt(_numbered(fx.box_dims(spark, d).select("mesh"))), "at")
    return out.select("mesh", "facet", "n", *(R(a).alias(a) for a in ("nx", "ny", "nz")), *(R(a, 3).alias(a) for a in ("cx", "cy", "cz")))


@query("agg08_texture_fit", f"{W}, e AS (SELECT mesh, facet, list(struct_pack(x, y, z) ORDER BY k) AS r FROM ring GROUP BY ALL), n AS (SELECT mesh, facet, sqrt((r[2].x - r[1].x) ** 2 + (r[2].y - r[1].y) ** 2 + (r[2].z - r[1].z) ** 2) AS a, sqrt((r[3].x - r[2].x) ** 2 + (r[3].y - r[2].y) ** 2 + (r[3].z - r[2].z) ** 2) AS b FROM e) SELECT mesh, facet, round(1 / a, 6) AS a11, 0.0::DOUBLE AS a12, 0.0::DOUBLE AS a21, round(1 / b, 6) AS a22, 0.5::DOUBLE AS u0, 0.5::DOUBLE AS v0 FROM n")
def texture_fit(spark, d):
    """Each face of a box with the unit square as its texture: the fit's slopes are one over the sides."""
    k = F.col("k")
    ring = mesh.corner_points(*_boxes(spark, d)).withColumns({"u": k.isin(1, 2).cast("double"), "v": k.isin(2, 3).cast("double")})
    return op.texture_fit(ring).select("mesh", "facet", *(R(c).alias(c) for c in ("a11", "a12", "a21", "a22", "u0", "v0")))


@query("agg10_shape_operator", "WITH p AS (SELECT p_partkey, 1 + p_size / 50.0::DOUBLE AS e, (p_partkey % 7) / 10.0::DOUBLE AS f, 2.0::DOUBLE AS g, (p_partkey % 5)::DOUBLE AS l, (p_partkey % 3)::DOUBLE AS m, (p_partkey % 11)::DOUBLE AS n FROM part) SELECT p_partkey, round((g * l - f * m) / (e * g - f * f), 6) + 0.0 AS s11, round((g * m - f * n) / (e * g - f * f), 6) + 0.0 AS s12, round((e * m - f * l) / (e * g - f * f), 6) + 0.0 AS s21, round((e * n - f * m) / (e * g - f * f), 6) + 0.0 AS s22 FROM p")
def shape_operator(spark, d):
    from ..session import table

    k, mod = F.col("p_partkey"), lambda n: (F.col("p_partkey") % n).cast("double")
    s = op.shape_operator(1 + F.col("p_size") / 50.0, mod(7) / 10.0, F.lit(2.0), mod(5), mod(3), mod(11))
    return table(spark, d, "part").select(k, *(R(x).alias(n) for n, x in zip(("s11", "s12", "s21", "s22"), s)))


@query("agg11_tensor_at_point", f"{W}, c AS (SELECT *, CASE WHEN mesh % 5 <> 0 OR vid <> 6 THEN vid + 1.0::DOUBLE END AS t11, vid % 3 / 4.0::DOUBLE AS t12, 2.0::DOUBLE * vid AS t22 FROM ring), p AS (SELECT mesh, facet, avg(x) + 0.1::DOUBLE * (max(x) - min(x)) AS px, avg(y) + 0.2::DOUBLE * (max(y) - min(y)) AS py, avg(z) AS pz FROM ring GROUP BY ALL), j AS (SELECT *, sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) AS d FROM c JOIN p USING (mesh, facet)), w AS (SELECT *, 1 / (d + max(d) OVER (PARTITION BY mesh, facet) / 10000) AS w FROM j) SELECT mesh, facet, round(CASE WHEN count(t11) = 4 THEN sum(w * t11) / sum(w) END, 6) AS t11, round(CASE WHEN count(t11) = 4 THEN sum(w * t12) / sum(w) END, 6) AS t12, round(CASE WHEN count(t11) = 4 THEN sum(w * t22) / sum(w) END, 6) AS t22 FROM w GROUP BY ALL")
def tensor_at_point(spark, d):
    r = mesh.corner_points(*_boxes(spark, d))
    vid = F.col("vid")
    r = r.withColumns({"t11": F.when((F.col("mesh") % 5 != 0) | (vid != 6), vid + 1.0), "t12": vid % 3 / 4.0, "t22": vid * 2.0})
    off = lambda c, s: (F.avg(c) + s * (F.max(c) - F.min(c))).alias(c)
    p = r.groupBy("mesh", "facet").agg(off("x", 0.1), off("y", 0.2), off("z", 0.0)).withColumn("id", F.struct("mesh", "facet"))
    return op.tensor_at(p, r).select("id.mesh", "id.facet", *(R(t).alias(t) for t in ("t11", "t12", "t22")))


@query("agg16_mirrored_line_means", f"""WITH {fx.LINES_SQL}, {fx.PIXELS_SQL}, r AS (SELECT ix, iy, max(v) AS v FROM pixels GROUP BY ALL),
c AS (SELECT *, list_sort(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_filter([(0 - u1) / nullif(u2 - u1, 0), (1 - u1) / nullif(u2 - u1, 0), (0 - v1) / nullif(v2 - v1, 0), (1 - v1) / nullif(v2 - v1, 0)], lambda t: t > 0 AND t < 1))) AS ts FROM lines),
g AS (SELECT *, unnest(range(1, len(ts))) AS i FROM c), h AS (SELECT *, ts[i] AS t0, ts[i + 1] AS t1 FROM g WHERE ts[i] < ts[i + 1]),
k AS (SELECT line, i, u1 + t0 * (u2 - u1) AS a0, u1 + t1 * (u2 - u1) AS a1, v1 + t0 * (v2 - v1) AS b0, v1 + t1 * (v2 - v1) AS b1, u1 + (t0 + t1) / 2 * (u2 - u1) AS am, v1 + (t0 + t1) / 2 * (v2 - v1) AS bm FROM h),
s AS (SELECT line, i, a0, a1, b0, b1, am, bm, sqrt((a1 - a0) ** 2 + (b1 - b0) ** 2) AS length, floor(1 + 32 * sqrt((a1 - a0) ** 2 + (b1 - b0) ** 2))::INTEGER AS steps FROM k),
q AS (SELECT *, unnest(range(steps)) AS j FROM s), x AS (SELECT *, a0 + (j + 0.5::DOUBLE) / steps * (a1 - a0) AS a, b0 + (j + 0.5::DOUBLE) / steps * (b1 - b0) AS b FROM q),
m AS (SELECT line, i, length, avg(v) AS mean FROM (SELECT *, floor(32 * CASE WHEN am < 0 THEN -a WHEN am > 1 THEN 2 - a ELSE a END)::INTEGER AS ix, floor(32 * CASE WHEN bm < 0 THEN -b WHEN bm > 1 THEN 2 - b ELSE b END)::INTEGER AS iy FROM x) LEFT JOIN r USING (ix, iy) GROUP BY line, i, length)
SELECT line, count(*) AS pieces, round(sum(length), 6) AS length, round(sum(mean * length) / nullif(sum(CASE WHEN mean IS NOT NULL THEN length END), 0), 3) AS mean FROM m GROUP BY line""")
def mirrored(spark, d):
    r = fx.pixels(spark, d).groupBy("ix", "iy").agg(F.max("v").alias("v"))
    return op.mirrored_line_means(fx.lines(spark, d), r, 32).select("line", "pieces", R("length").alias("length"), R("mean", 3).alias("mean"))
