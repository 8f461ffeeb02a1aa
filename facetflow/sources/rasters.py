"""Rasters and target patterns: calibration targets, checkerboards, grid data sets of image channels, snapshots and layers on disk.

Rasters are (channel, frame, iy, ix, value); channels are (channel, ord, meta map<string, string>). Null frames and channels match
nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of targets: rows of circles shifted by half a step every other row, beginning with the second; the same from the first row on
#: with rows half a step apart; square circles; the inner corners of a chessboard.
PATTERNS = ("asymmetric", "asymmetric2", "symmetric", "chessboard")


def target_points(targets: DataFrame) -> DataFrame:
    """The columns of targets (pattern, nx, ny, spacing, ...) with a row for each point: row, col, x, y, z, in target coordinates. Asymmetric rows
    are half a step apart and every other one is shifted by half a step; raises for other patterns than PATTERNS."""
    known = F.when(F.col("pattern").isin(*PATTERNS), F.col("pattern")).otherwise(F.raise_error(F.concat(F.lit("unknown pattern: "), F.coalesce("pattern", F.lit("null")))).cast("string"))
    t = targets.withColumn("pattern", known).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    half = F.col("pattern").isin("asymmetric", "asymmetric2")
    x = F.col("col") + F.when(half & (F.col("row") % 2 == 1), 0.5).otherwise(0.0)
    y = F.col("row") * F.when(half, 0.5).otherwise(1.0)
    return t.withColumns({"x": x * F.col("spacing"), "y": y * F.col("spacing"), "z": F.lit(0.0)})


def checkerboard(ix: Column, iy: Column, nx: int, ny: int, squares: int) -> Column:
    """1 or 0 of a pixel of a board of squares x squares over nx x ny pixels; the first square is 0."""
    part = lambda i, n: F.floor(i * squares / n) % 2
    return (part(ix, nx) != part(iy, ny)).cast("int")


def extract_image(raster: DataFrame, channel: str, frame: int, ny: int) -> DataFrame:
    """iy, ix, value of one frame of a channel, rows counted from the other end: the filter reaches the scan."""
    return raster.where((F.col("channel") == channel) & (F.col("frame") == frame)).select((ny - 1 - F.col("iy")).alias("iy"), "ix", "value")


def grid_data(raster: DataFrame, axes: DataFrame) -> DataFrame:
    """raster with the physical x, y of each pixel from its channel's axes (channel, x_first, x_step, y_first, y_step, ny); rows run against y."""
    j = raster.join(axes, "channel")
    x, y = F.col("x_first") + F.col("ix") * F.col("x_step"), F.col("y_first") + (F.col("ny") - 1 - F.col("iy")) * F.col("y_step")
    return j.select(*(raster[c] for c in raster.columns), x.alias("x"), y.alias("y"))


def write_snapshot(raster: DataFrame, channels: DataFrame, path: str) -> None:
    """Channels with their order and metadata, and their rasters by channel: a reader of one channel touches its folder only."""
    channels.write.parquet(f"{path}/channels")
    raster.write.partitionBy("channel").parquet(f"{path}/rasters")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raster, channels in their order) of a snapshot."""
    schema = "frame int, iy int, ix int, value double, channel string"
    return spark.read.schema(schema).parquet(f"{path}/rasters"), spark.read.parquet(f"{path}/channels").orderBy("ord")


def write_layers(stack: DataFrame, depths: DataFrame, path: str, offset: float, units: float) -> None:
    """layer, iy, ix, depth, value: a folder for each layer with its depth (layer, depth) and values scaled by offset and units; layers without a
    depth are left out."""
    j = stack.join(depths, "layer").withColumn("value", (F.col("value") - offset) / units)
    j.select("layer", "iy", "ix", "depth", "value").write.partitionBy("layer").parquet(path)
