"""Point location on UV meshes through cell keys: an equi-join on the cell, then the exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import in_quad


def grid_quads(spark, n: int, m: int) -> DataFrame:
    """facet and its four UV corners of an n x m grid on the unit square."""
    i, j = F.col("id") % n, F.expr(f"id div {n}")
    g = spark.range(n * m).select(F.col("id").alias("facet"), (i / n).alias("u0"), ((i + 1) / n).alias("u1"), (j / m).alias("v0"), ((j + 1) / m).alias("v1"))
    return g


def cells(quads: DataFrame, n: int) -> DataFrame:
    """A row for each cell of an n x n division that a quad's bounds touch."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) * n).cast("int"), F.floor(F.col(b) * n).cast("int"))
    return quads.withColumn("cu", F.explode(span("u0", "u1"))).withColumn("cv", F.explode(span("v0", "v1")))


def locate(points: DataFrame, quads: DataFrame, n: int) -> DataFrame:
    """points (id, u, v) with the smallest facet that holds each, null where none does."""
    p = points.withColumn("cu", F.floor(F.col("u") * n).cast("int")).withColumn("cv", F.floor(F.col("v") * n).cast("int"))
    corners = [(F.col("u0"), F.col("v0")), (F.col("u1"), F.col("v0")), (F.col("u1"), F.col("v1")), (F.col("u0"), F.col("v1"))]
    hit = p.join(cells(quads, n), ["cu", "cv"]).where(in_quad(corners, F.col("u"), F.col("v"))).groupBy("id").agg(F.min("facet").alias("facet"))
    return points.join(hit, "id", "left")
