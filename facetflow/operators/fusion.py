"""Rasters of many shots: weighted fusion, accumulation, background subtraction, comparison. All are sums by cell, so any order of shots gives the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("ix", "iy", "t")


def present(value: Column) -> Column:
    """Null and NaN are both missing."""
    return value.isNotNull() & ~F.isnan(value)


def fuse(pixels: DataFrame, cell=CELL) -> DataFrame:
    """Weighted mean and total weight of each cell, of positive weights and present values."""
    p = pixels.where((F.col("w") > 0) & present(F.col("v")))
    return p.groupBy(*cell).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.sum("w").alias("w"))


def accumulate(pixels: DataFrame, cell=CELL) -> DataFrame:
    """Raw sums that later shots can be added to."""
    return pixels.where(present(F.col("v"))).groupBy(*cell).agg(F.sum(F.col("w") * F.col("v")).alias("sum_wv"), F.sum("w").alias("sum_w"))


def merge(*sums: DataFrame, cell=CELL) -> DataFrame:
    """Accumulations added; a cell that one side lacks passes through."""
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out.groupBy(*cell).agg(F.sum("sum_wv").alias("sum_wv"), F.sum("sum_w").alias("sum_w"))


def normalize(sums: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Value of an accumulation; 0 under the validity threshold."""
    v = F.when(F.col("sum_w") < threshold, F.lit(0.0)).otherwise(F.try_divide("sum_wv", "sum_w"))
    return sums.withColumn("v", v)


def subtract_early_average(stack: DataFrame, last_early: int) -> DataFrame:
    """Each cell less the mean of its frames up to last_early; null where it has none."""
    w = Window.partitionBy("ix", "iy")
    early = F.avg(F.when(F.col("t") <= last_early, F.col("v"))).over(w)
    return stack.withColumn("background", early).withColumn("v", F.col("v") - F.col("background"))


def weight_drift(stack: DataFrame, first: int = 1) -> DataFrame:
    """t, drift: the norm of the difference from the first frame's weights over the first frame's norm; a missing weight is 0. The squared
    difference of a frame is the first frame's square plus what its own cells change of it: one join by cell."""
    w0 = stack.where(F.col("t") == first).select("ix", "iy", F.col("w").alias("w0"))
    norm = w0.agg(F.sum(F.col("w0") * F.col("w0")).alias("square"))
    j = stack.where(F.col("t") != first).join(w0, ["ix", "iy"], "left")
    d, o = F.coalesce("w0", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)), F.coalesce("w0", F.lit(0.0))
    change = j.groupBy("t").agg(F.sum(d * d - o * o).alias("change")).crossJoin(F.broadcast(norm))  # norm is one row
    return change.select("t", F.try_divide(F.sqrt(F.greatest(F.col("square") + F.col("change"), F.lit(0.0))), F.nullif(F.sqrt("square"), F.lit(0.0))).alias("drift"))


def measurement_files(measurements: DataFrame, files: DataFrame) -> DataFrame:
    """specimen, measurement, file, n_params, usable of every file (measurement, file) of measurements (specimen, measurement, param): a
    specimen is usable if all its measurements share one parameter value (null is none)."""
    params = measurements.groupBy("specimen").agg(F.countDistinct("param").alias("n_params"))
    j = measurements.select("specimen", "measurement").join(params, "specimen").join(files, "measurement")
    return j.select("specimen", "measurement", "file", "n_params", (F.col("n_params") == 1).alias("usable"))


def overlap(a: DataFrame, b: DataFrame, cell=CELL) -> DataFrame:
    """Each cell of either raster as both, only_old or only_new."""
    x, y = a.select(*cell).distinct().withColumn("old", F.lit(1)), b.select(*cell).distinct().withColumn("new", F.lit(1))
    j = x.join(y, list(cell), "full")
    return j.select(*cell, F.when(F.col("old").isNull(), "only_new").when(F.col("new").isNull(), "only_old").otherwise("both").alias("kind"))


def compare(a: DataFrame, b: DataFrame, cell=CELL, by=()) -> DataFrame:
    """A row for each value of the cell columns `by`, or one in all: cells that differ (missing equals missing) and the norm of the
    differences over the norm of a."""
    j = a.select(*cell, F.nanvl("v", F.lit(None)).alias("a")).join(b.select(*cell, F.nanvl("v", F.lit(None)).alias("b")), list(cell), "full")
    d = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return j.groupBy(*by).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_differ"), F.try_divide(F.sqrt(F.sum(d * d)), F.sqrt(F.sum(F.col("a") * F.col("a")))).alias("relative"))


def dense(raster: DataFrame, nx: int, ny: int, fill: float = 0.0, frame=()) -> DataFrame:
    """Every cell of the grid in each frame (values of the columns `frame`, not null), the raster's value or fill."""
    spark = raster.sparkSession
    n = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.expr(f"cast(id div {nx} as int)").alias("iy"))
    if frame:
        n = raster.select(*frame).distinct().crossJoin(n)
    return n.join(raster, [*frame, "ix", "iy"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def frame_range(frames: DataFrame, key: str) -> DataFrame:
    v = F.nanvl("v", F.lit(None))
    return frames.groupBy(key).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(~present(F.col("v"))).alias("n_missing"))


def opened(mask: DataFrame, frame=()) -> DataFrame:
    """Binary opening of a dense mask (frame, ix, iy, m) by the 4-neighbour cross, each frame alone; outside is false."""

    def cross(d: DataFrame, least: bool) -> DataFrame:
        f = F.min if least else F.max
        edge = F.lit(False)
        row, col = Window.partitionBy(*frame, "iy").orderBy("ix"), Window.partitionBy(*frame, "ix").orderBy("iy")
        near = [F.lag("m", 1).over(row), F.lead("m", 1).over(row), F.lag("m", 1).over(col), F.lead("m", 1).over(col)]
        all_ = [F.col("m"), *(F.coalesce(x, edge) for x in near)]
        return d.select(*frame, "ix", "iy", (F.least(*all_) if least else F.greatest(*all_)).alias("m"))

    return cross(cross(mask, True), False)


def slope_mismatch(depth: DataFrame, focal: tuple[float, float], frame=(), limit: float = math.pi / 5) -> DataFrame:
    """frame, ix, iy, m: cells of a dense depth raster (z, and dx, dy, the change of z that the surface there predicts a pixel on), each
    frame alone, whose slope angle to any of the four neighbours is off the predicted angle by limit or more. A pixel is
    z / focal wide, by the focal length of its axis. Edges and missing values always mismatch."""
    row, col = Window.partitionBy(*frame, "iy").orderBy("ix"), Window.partitionBy(*frame, "ix").orderBy("iy")
    d = depth.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in ("z", "dx", "dy")})
    z = F.col("z")
    steps = [("dx", z - F.lead("z").over(row), focal[0]), ("dx", F.lag("z").over(row) - z, focal[0]), ("dy", z - F.lead("z").over(col), focal[1]), ("dy", F.lag("z").over(col) - z, focal[1])]
    smooth = F.lit(True)
    for predicted, actual, f in steps:
        smooth = smooth & F.coalesce(F.abs(F.atan2(F.col(predicted), z / f) - F.atan2(actual, z / f)) < limit, F.lit(False))
    return d.select(*frame, "ix", "iy", (~smooth).alias("m"))
