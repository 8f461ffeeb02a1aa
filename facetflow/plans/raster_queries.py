"""Queries of targets, rasters on disk, calibration images and merged curvatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mesh, surface
from ..session import dealt, fresh_path, table
from ..sources import fixtures as fx, rasters as op
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)


@query("src12_target_points", "WITH t AS (SELECT p_partkey AS image, ['asymmetric', 'asymmetric2', 'symmetric', 'chessboard'][p_partkey % 4 + 1] AS pattern, 2 + p_size % 5 AS nx, 2 + p_size % 3 AS ny, 25.4::DOUBLE + p_partkey % 3 AS spacing FROM part), r AS (SELECT *, unnest(range(ny)) AS row FROM t), c AS (SELECT *, unnest(range(nx)) AS col FROM r) SELECT image, pattern, row::INTEGER AS row, col::INTEGER AS col, round((col + CASE WHEN pattern LIKE 'asym%' AND row % 2 = 1 THEN 0.5 ELSE 0 END) * spacing, 6) AS x, round(row * CASE WHEN pattern LIKE 'asym%' THEN 0.5 ELSE 1 END * spacing, 6) AS y FROM c")
def targets(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    kinds = F.get(F.array(*map(F.lit, op.PATTERNS)), (k % 4).cast("int"))
    t = table(spark, d, "part").select(k.alias("image"), kinds.alias("pattern"), (2 + s % 5).cast("int").alias("nx"), (2 + s % 3).cast("int").alias("ny"), (25.4 + k % 3).alias("spacing"))
    return op.target_points(t).select("image", "pattern", "row", "col", R("x").alias("x"), R("y").alias("y"))


@query("src13_checkerboard", f"WITH {fx.PIXELS_SQL} SELECT DISTINCT shot, ix, iy, ((ix * 8 // 32) % 2 <> (iy * 8 // 32) % 2)::INTEGER AS v FROM pixels")
def board(spark, d):
    return fx.pixels(spark, d).select("shot", "ix", "iy", op.checkerboard(F.col("ix"), F.col("iy"), 32, 32, 8).alias("v")).distinct()


def _raster(spark, d):
    p = fx.pixels(spark, d).groupBy("shot", "t", "iy", "ix").agg(F.max("v").alias("value"))
    return p.select(F.concat(F.lit("C"), F.col("shot").cast("string")).alias("channel"), F.col("t").cast("int").alias("frame"), "iy", "ix", F.col("value").cast("double").alias("value"))


RASTER = f"WITH {fx.PIXELS_SQL}, raster AS (SELECT 'C' || shot AS channel, t::INTEGER AS frame, iy, ix, max(v)::DOUBLE AS value FROM pixels GROUP BY ALL)"


@query("snk03_snapshot", f"{RASTER} SELECT frame, iy, ix, value, channel FROM raster")
def snapshot(spark, d):
    """All channels written and read back."""
    r, path = _raster(spark, d), fresh_path(spark, "snapshot")
    channels = r.select("channel").distinct().withColumn("ord", F.substr("channel", F.lit(2)).cast("int")).withColumn("meta", F.create_map(F.lit("Units"), F.lit("m")))
    op.write_snapshot(r, channels, path)
    return op.read_snapshot(spark, path)[0]


@query("src14_extracted_image", f"{RASTER} SELECT 31 - iy AS iy, ix, value FROM raster WHERE channel = 'C1' AND frame = 3")
def image(spark, d):
    """One frame of a channel of a snapshot, upside down: only its folder is read."""
    r, path = _raster(spark, d), fresh_path(spark, "snapshot")
    op.write_snapshot(r, r.select("channel").distinct().withColumn("ord", F.lit(0)), path)
    return op.extract_image(op.read_snapshot(spark, path)[0], "C1", 3, 32)


@query("src17_grid_data", f"{RASTER} SELECT channel, frame, iy, ix, value, round(0.5 + substr(channel, 2)::INTEGER + ix * 0.25::DOUBLE, 6) AS x, round(-2.0 + (31 - iy) * 0.125::DOUBLE, 6) AS y FROM raster")
def grid_data(spark, d):
    r = _raster(spark, d)
    axes = r.select("channel").distinct().select("channel", (F.substr("channel", F.lit(2)).cast("int") + 0.5).alias("x_first"), F.lit(0.25).alias("x_step"), F.lit(-2.0).alias("y_first"), F.lit(0.125).alias("y_step"), F.lit(32).alias("ny"))
    return op.grid_data(r, axes).select("channel", "frame", "iy", "ix", "value", R("x").alias("x"), R("y").alias("y"))


@query("snk04_layers", f"{RASTER} SELECT frame AS layer, iy, ix, 0.5::DOUBLE * frame AS depth, round((max(value) - 4.3) / 2.0, 6) AS value FROM raster WHERE frame <> 2 GROUP BY ALL")
def layers(spark, d):
    """Layers with a depth, one folder each, values scaled."""
    s = _raster(spark, d).groupBy(F.col("frame").alias("layer"), "iy", "ix").agg(F.max("value").alias("value"))
    depths = s.select("layer").distinct().where("layer <> 2").withColumn("depth", F.col("layer") * 0.5)
    path = fresh_path(spark, "layers")
    op.write_layers(s, depths, path, 4.3, 2.0)
    return spark.read.schema("iy int, ix int, depth double, value double, layer int").parquet(path).select("layer", "iy", "ix", "depth", R("value").alias("value"))


@query("agg12_merged_curvature", """WITH c AS (SELECT l_partkey AS vid, l_linenumber AS s, 1.0 + l_partkey % 3 + CASE WHEN l_partkey % 5 = 0 THEN 0.4 * l_linenumber ELSE 0.001 * l_linenumber END AS t11, 0.25::DOUBLE AS t12, 0.5 + l_partkey % 2 AS t22, CASE WHEN l_partkey % 7 = 0 AND l_linenumber % 2 = 0 THEN -1.0 ELSE 1.0 END AS nz FROM lineitem),
a AS (SELECT vid, avg(t11) AS t11, avg(t12) AS t12, avg(t22) AS t22, avg(nz) AS nz, greatest(max(t11) - avg(t11), avg(t11) - min(t11)) AS off, greatest(max(nz) - avg(nz), avg(nz) - min(nz)) AS turn FROM c GROUP BY vid),
k AS (SELECT vid, (t11 + t22) / 2 AS h, sqrt((t11 - t22) ** 2 / 4 + t12 * t12) AS r, off <= 0.1 AND turn <= 0.05 AS ok FROM a)
SELECT vid, round(CASE WHEN ok THEN (h + r) * 1000 ELSE 0.5 * vid END, 4) AS k1, round(CASE WHEN ok THEN (h - r) * 1000 ELSE -0.5 * vid END, 4) AS k2 FROM k""")
def merged(spark, d):
    """Several curvature tensors a vertex, in 1/mm: the mean's where they agree, the mesh's own where they don't."""
    k, s = F.col("l_partkey"), F.col("l_linenumber")
    t = table(spark, d, "lineitem").select(k.alias("vid"), (1.0 + k % 3 + F.when(k % 5 == 0, s * 0.4).otherwise(s * 0.001)).alias("t11"), F.lit(0.25).alias("t12"), (0.5 + k % 2).alias("t22"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.when((k % 7 == 0) & (s % 2 == 0), -1.0).otherwise(1.0).alias("nz"))
    own = table(spark, d, "part").select(F.col("p_partkey").alias("vid"), (F.col("p_partkey") * 0.5).alias("k1"), (F.col("p_partkey") * -0.5).alias("k2"))
    return surface.merge_curvatures(t, 0.1, 0.05, 1000.0, own).select("vid", R("k1", 4).alias("k1"), R("k2", 4).alias("k2"))


@query("join23_inside_candidates", "WITH c AS (SELECT l_orderkey AS vid, l_linenumber AS surface, l_discount AS dist, l_tax < 0.05 AS inside FROM lineitem), h AS (SELECT vid, surface FROM c WHERE dist < 0.06 AND inside) SELECT o_orderkey AS vid, surface FROM orders LEFT JOIN h ON vid = o_orderkey")
def candidates(spark, d):
    """Vertices with the surfaces that they are near to and inside of; null where there are none."""
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("vid"))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("vid"), F.col("l_linenumber").alias("surface"), F.col("l_discount").alias("dist"), (F.col("l_tax") < 0.05).alias("inside"))
    return surface.candidates_inside(v, c, 0.06)


@query("src05_mesh_from_arrays", f"WITH {fx.BOXES_SQL}, c AS (SELECT mesh, facet, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM ring GROUP BY ALL) SELECT mesh, facet, count(*)::INTEGER AS n, round(max(cx), 6) AS cx, round(max(cy), 6) AS cy, round(max(cz), 6) AS cz, round(max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) AS maxradius FROM ring JOIN c USING (mesh, facet) GROUP BY ALL")
def from_arrays(spark, d):
    """Vertex arrays and packed polygons of a part to facets with their measures."""
    b = fx.box_dims(spark, d)
    v = mesh.box_vertices(b).groupBy("mesh").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"])).alias("points"))
    facets = mesh.from_arrays(v.join(dealt(mesh.pack(mesh.box_corners(b))), "mesh"))
    return facets.select("mesh", F.col("facet").cast("int").alias("facet"), F.col("n").cast("int").alias("n"), *(R(c).alias(c) for c in ("cx", "cy", "cz", "maxradius")))
