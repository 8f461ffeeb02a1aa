"""Coordinate frames: each frame's 4 x 4 map to its parent, composed to the root by doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

_IDENTITY = [float(i % 5 == 0) for i in range(16)]


def product(a: Column, b: Column) -> Column:
    """Row-major 4 x 4 product of two arrays of doubles."""
    cell = lambda i: sum((F.get(a, i - i % 4 + k) * F.get(b, i % 4 + 4 * k) for k in range(1, 4)), F.get(a, i - i % 4) * F.get(b, i % 4))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def inverse(m: Column) -> Column:
    """Inverse of an affine 4 x 4 map by cofactors; null where it has none."""
    a = [[F.get(m, F.lit(4 * i + j)) for j in range(4)] for i in range(3)]
    co = [[a[(j + 1) % 3][(i + 1) % 3] * a[(j + 2) % 3][(i + 2) % 3] - a[(j + 1) % 3][(i + 2) % 3] * a[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
    det = a[0][0] * co[0][0] + a[0][1] * co[1][0] + a[0][2] * co[2][0]
    r = [[c / det for c in row] for row in co]
    rows = [x for i in range(3) for x in (*r[i], -(r[i][0] * a[0][3] + r[i][1] * a[1][3] + r[i][2] * a[2][3]))]
    return F.when(F.abs(det) > 0, F.array(*rows, *(F.lit(x) for x in _IDENTITY[12:])))


def is_rigid(m: Column, tolerance: float = 1e-5) -> Column:
    """Whether a map only turns and moves: last row 0 0 0 1 and orthonormal rows."""
    at = lambda i, j: F.get(m, F.lit(4 * i + j))
    last = sum((F.abs(at(3, j) - float(j == 3)) for j in range(4)), F.lit(0.0))
    rest = sum((F.pow(sum((at(i, k) * at(j, k) for k in range(3)), F.lit(0.0)) - float(i == j), F.lit(2.0)) for i in range(3) for j in range(i, 3)), F.lit(0.0))
    return (last <= tolerance) & (F.sqrt(rest) <= tolerance)


def to_root(edges: DataFrame) -> DataFrame:
    """frame, root, m, ambiguous from (frame, parent, m): the map from each frame to the root above it.

    A frame of several parents takes the smallest and is marked ambiguous. Rounds double the distance covered, so a chain of n frames
    takes log n joins; a circle raises ValueError. Rows with a null frame, parent or map are left out."""
    e = edges.where("frame is not null and parent is not null and m is not null")
    e = e.groupBy("frame").agg(F.min(F.struct("parent", "m")).alias("up"), (F.count_distinct("parent") > 1).alias("ambiguous"))
    e = e.select("frame", F.col("up.parent").alias("at"), "up.m", "ambiguous", F.lit(False).alias("top"))
    tops = edges.where("m is not null").select(F.col("parent").alias("frame")).where("frame is not null").distinct().join(e, "frame", "left_anti")
    s = cut(e.unionByName(tops.select("frame", F.col("frame").alias("at"), F.array(*map(F.lit, _IDENTITY)).alias("m"), F.lit(False).alias("ambiguous"), F.lit(True).alias("top"))), "frames")
    left = s.count()
    rounds = left.bit_length() + 1
    for _ in range(rounds):
        t = s.select(F.col("frame").alias("at"), F.col("at").alias("next"), F.col("m").alias("up"), F.col("top").alias("end"))
        s = cut(s.join(t, "at").select("frame", F.col("next").alias("at"), product(F.col("up"), F.col("m")).alias("m"), "ambiguous", F.col("end").alias("top")), "frames")
        if not s.where("not top").head(1):
            return s.select("frame", F.col("at").alias("root"), "m", "ambiguous")
    raise ValueError("frames go in a circle")


def between(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """pairs (src, dst) with m: the map from src to dst through their common root; null where they have none."""
    a = rooted.select(F.col("frame").alias("src"), F.col("root").alias("ra"), F.col("m").alias("ma"))
    b = rooted.select(F.col("frame").alias("dst"), F.col("root").alias("rb"), inverse(F.col("m")).alias("back"))
    j = pairs.join(a, "src", "left").join(b, "dst", "left")
    return j.select(*pairs.columns, F.when(F.col("ra") == F.col("rb"), product(F.col("back"), F.col("ma"))).alias("m"))
