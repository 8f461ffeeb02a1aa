"""Queries of image files and of the smallest meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources import fixtures as fx, images as src, x3d
from .registry import query


@query("src18_images", f"WITH {fx.PIXELS_SQL}, m AS (SELECT shot, ix, iy, max(v) * 5 AS v FROM pixels WHERE ix < 30 GROUP BY ALL) SELECT s.shot, (i % 30)::INTEGER AS ix, (i // 30)::INTEGER AS iy, coalesce(v, 0)::INTEGER AS r, coalesce(v, 0)::INTEGER AS g, coalesce(v, 0)::INTEGER AS b FROM (SELECT DISTINCT shot FROM m) s CROSS JOIN range(960) q(i) LEFT JOIN m ON m.shot = s.shot AND m.ix = i % 30 AND m.iy = i // 30")
def images(spark, d):
    """A picture a shot, written as a PNG file and read back pixel by pixel, the bottom line first."""
    path = fresh_path(spark, "png")
    src.write_png(fx.pixels(spark, d).select(F.col("shot").alias("image"), "ix", "iy", (F.col("v") * 5).alias("v")), path, 30, 32)
    out = src.read_images(spark, path)
    return out.select(F.regexp_replace("file", r"\.png$", "").cast("long").alias("shot"), "ix", "iy", "r", "g", "b")


@query("src19_plates", f"WITH {fx.BOXES_SQL} SELECT mesh, k, u * length AS x, v * width AS y, 0.0::DOUBLE AS z, u, v FROM boxes, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)) c(k, u, v)")
def plates(spark, d):
    """A plate of one quadrilateral a part with texture coordinates: written as X3D, read, written and read again."""
    b = fx.box_dims(spark, d).select("mesh", "length", "width", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for k, (u, v) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))))).alias("c"))
    vertices = b.select("mesh", F.col("c.k").alias("vid"), (F.col("c.u") * F.col("length")).alias("x"), (F.col("c.v") * F.col("width")).alias("y"), F.lit(0.0).alias("z"))
    corners = b.select("mesh", F.lit(0).alias("facet"), "c.k", F.col("c.k").alias("vid"), "c.u", "c.v")
    for _ in range(2):
        found = x3d.shapes(x3d.texts(corners, vertices).withColumnRenamed("mesh", "doc"))
        mesh = F.col("mesh.doc").cast("long").alias("mesh")
        vertices = x3d.vertices(found).select(mesh, F.col("vid").cast("int").alias("vid"), "x", "y", "z")
        corners = x3d.corners(found).select(mesh, F.col("facet").cast("int").alias("facet"), F.col("k").cast("int").alias("k"), F.col("vid").cast("int").alias("vid"), "u", "v")
    return corners.join(vertices, ["mesh", "vid"]).select("mesh", "k", "x", "y", "z", "u", "v")
