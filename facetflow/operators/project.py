"""Projection onto UV grids: splatting pixels, the nearest surface along parallel rays, sums along lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt
from .locate import cells

#: Distance, in UV pixels, that a source pixel reaches.
REACH = 1.5


def splat(pixels: DataFrame, *frame: str, reach: float = REACH) -> DataFrame:
    """frame, iu, iv, sum_wv, sum_w from (frame, u, v, value, w): each pixel goes to the cells within reach with a raised-cosine
    weight. The cells of a pixel come from a constant array, so nothing but sums by cell is shuffled."""
    side = range(-math.ceil(reach) + 1, math.ceil(reach) + 1)
    cell = F.array(*(F.struct((F.floor("u") + a).cast("int").alias("iu"), (F.floor("v") + b).cast("int").alias("iv")) for a in side for b in side))
    p = pixels.where("w > 0 and value is not null and not isnan(value)").withColumn("cell", F.explode(cell)).select("*", "cell.*")
    x, y = F.col("iu") - F.col("u"), F.col("iv") - F.col("v")
    d2 = x * x + y * y
    c = F.col("w") * (0.5 + 0.5 * F.cos(F.sqrt(d2) * (0.4 * math.pi / math.sqrt(2))))
    p = p.where(d2 <= reach * reach).withColumn("c", c)
    return p.groupBy(*frame, "iu", "iv").agg(F.sum(F.col("c") * F.col("value")).alias("sum_wv"), F.sum("c").alias("sum_w"))


def nearest_hits(rays: DataFrame, faces: DataFrame, n: int) -> DataFrame:
    """id, facet, dist: the nearest face (u0, u1, v0, v1, dist) that each parallel ray (id, u, v) meets, the smallest facet of equally
    near ones; null where it meets none. Rays and faces meet by equi-join on the cells of an n x n division. Equal rays are one while they meet
    faces, and of equal faces only the nearest does: pairs grow with the different places, not with the rows."""
    p = rays.select("u", "v").distinct().withColumn("cu", F.floor(F.col("u") * n).cast("int")).withColumn("cv", F.floor(F.col("v") * n).cast("int"))
    side = ["u0", "u1", "v0", "v1"]
    nearest = faces.groupBy(*side).agg(F.min(F.struct("dist", "facet")).alias("near"))
    hit = p.join(dealt(cells(nearest, n)), ["cu", "cv"]).where("u between u0 and u1 and v between v0 and v1")
    near = hit.groupBy("u", "v").agg(F.min("near").alias("near"))
    return rays.select("id", "u", "v").join(near, ["u", "v"], "left").select("id", "near.facet", "near.dist")


def line_means(lines: DataFrame, raster: DataFrame, n: int) -> DataFrame:
    """line, steps, length, mean: the raster's mean over the midpoints of a segment's steps, about a cell of the n x n raster each. Steps
    outside the raster add length only; mean is null where all are."""
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    s = lines.withColumn("steps", F.floor(1 + F.sqrt(du * n * (du * n) + dv * n * (dv * n))).cast("int"))
    s = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    at = (F.col("k") + 0.5) / F.col("steps")
    s = s.select("line", "steps", F.sqrt(du * du + dv * dv).alias("length"), F.floor((F.col("u1") + at * du) * n).cast("int").alias("ix"), F.floor((F.col("v1") + at * dv) * n).cast("int").alias("iy"))
    return s.join(raster, ["ix", "iy"], "left").groupBy("line", "steps", "length").agg(F.avg("v").alias("mean"))
