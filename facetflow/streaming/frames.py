"""Streams of frames: grabbed ones only, projected by stored hits, stacks without their background, and the latest state of a command log.

Each gives what the same work over all rows at once gives, however the rows fall into batches. Rows with null keys pass as keys of
their own; an empty stream gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import run_batches


def grabbed(frames: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Frames marked grabbed, each key once within the time that rows may be late; older state is dropped by the watermark."""
    return frames.where("grabbed").withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def projected(pixels: DataFrame, hits: DataFrame) -> DataFrame:
    """Streamed pixels (image, ix, iy, ...) with what is stored of the surface behind them; others are left out. A stateless join: hits are
    made once for a pose and read by each batch."""
    return pixels.join(hits, ["image", "ix", "iy"])


def tap_sums(pixels: DataFrame, tap_map: DataFrame, *frame: str) -> DataFrame:
    """frame, ix, iy, s, c: sums of tap x weight x value and of tap x weight. Pixels without a value or weight count for nothing."""
    p = pixels.where("w > 0 and v is not null and not isnan(v)").select(*frame, F.col("ix").alias("px"), F.col("iy").alias("py"), F.col("v").cast("double").alias("v"), F.col("w").cast("double").alias("w"))
    c = F.col("tw") * F.col("w")
    return p.join(tap_map, ["px", "py"]).groupBy(*frame, "ix", "iy").agg(F.sum(c * F.col("v")).alias("s"), F.sum(c).alias("c"))


def undistorted(stream: DataFrame, tap_map: DataFrame, *frame: str, store: str | None = None) -> DataFrame:
    """frame, ix, iy, v: streamed pixels (frame, ix, iy, v, w) through a stored map of taps (ix, iy, px, py, tw) as the mean weighted by w and tap.
    The map is made once for a camera and read by each batch; batches leave sums, so a frame may come in any number of them."""
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"{f} {kinds[f]}" for f in frame), "ix int, iy int, s double, c double"])
    sums = each_batch(stream, lambda b: tap_sums(b, tap_map, *frame), "undistorted", schema, store)
    return sums.groupBy(*frame, "ix", "iy").agg((F.sum("s") / F.sum("c")).alias("v"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], name: str, schema: str, store: str | None = None) -> DataFrame:
    """work's rows over all there is now, one batch after another; with a store a job of this name goes on where it stopped."""
    return run_batches(stream, work, name, schema, store).drop("round")


def without_early(stream: DataFrame, last_early: int, *cell: str, store: str | None = None) -> DataFrame:
    """cell, t, v: each frame (the mean of a cell's values at t) less the mean of the cell's frames up to last_early; null where a cell has
    none of those. Batches leave partial sums by cell and frame, so a stack may come in any number of them."""
    kinds = dict(stream.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*cell, "t")), "sum_v double", "n long"])
    part = lambda b: b.where("v is not null and not isnan(v)").groupBy(*cell, "t").agg(F.sum(F.col("v").cast("double")).alias("sum_v"), F.count("*").alias("n"))
    sums = each_batch(stream, part, "stack-sums", schema, store)
    stack = sums.groupBy(*cell, "t").agg((F.sum("sum_v") / F.sum("n")).alias("v"))
    early = F.avg(F.when(F.col("t") <= last_early, F.col("v"))).over(Window.partitionBy(*cell))
    return stack.withColumn("early", early).select(*cell, "t", (F.col("v") - F.col("early")).alias("v"))


def latest_commands(log: DataFrame) -> DataFrame:
    """name, x, y, invalid of the landmarks that stand after a log (seq, command, name, x, y): set and invalid replace what was there, clear
    takes a name away, clear-all takes all; query and unknown commands change nothing. The last of equal seq by command counts."""
    wiped = F.max(F.when(F.col("command") == "clear-all", F.col("seq")))
    last = log.where(F.col("command").isin("set", "invalid", "clear") & F.col("name").isNotNull()).groupBy("name").agg(F.max(F.struct("seq", "command", "x", "y")).alias("last"))
    after = log.agg(F.coalesce(wiped, F.lit(-1)).alias("wiped"))  # one row
    out = last.crossJoin(F.broadcast(after)).where((F.col("last.seq") > F.col("wiped")) & (F.col("last.command") != "clear"))
    set_ = F.col("last.command") == "set"
    return out.select("name", F.when(set_, F.col("last.x")).alias("x"), F.when(set_, F.col("last.y")).alias("y"), (~set_).alias("invalid"))


def streamed_commands(log: DataFrame, store: str | None = None) -> DataFrame:
    """latest_commands of a stream. Each batch leaves the last command of each name that it holds, and its last clear-all: no batch is needed
    again, and what is left of all batches is folded at the end."""
    kinds = dict(log.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("seq", "command", "name", "x", "y"))

    def fold(batch: DataFrame) -> DataFrame:
        key = F.when(F.col("command") == "clear-all", F.lit(None)).otherwise(F.col("name"))
        some = batch.where(F.col("command").isin("set", "invalid", "clear", "clear-all"))
        return some.groupBy(key.alias("key")).agg(F.max(F.struct("seq", "command", "name", "x", "y")).alias("r")).select("r.*")

    return latest_commands(each_batch(log, fold, "commands", schema, store))


def posed(solved: DataFrame, manual: DataFrame) -> DataFrame:
    """key, pose, source: the manual pose (key, pose) where there is one, else the solved one; either may be missing."""
    j = solved.select("key", F.col("pose").alias("s")).join(manual.select("key", F.col("pose").alias("m")), "key", "full")
    return j.select("key", F.coalesce("m", "s").alias("pose"), F.when(F.col("m").isNotNull(), "manual").when(F.col("s").isNotNull(), "solved").alias("source"))


def with_landmarks(images: DataFrame, landmarks: DataFrame) -> DataFrame:
    """images (channel, meta map<string, string>) with the latest landmarks (channel, name, x, y) in their metadata, where these win."""
    pair = lambda a: F.struct(F.concat(F.lit("LANDMARK_"), "name", F.lit(f"_{a.upper()}")).alias("key"), F.col(a).cast("string").alias("value"))
    rows = landmarks.where("name is not null").select("channel", F.explode(F.array(pair("x"), pair("y"))).alias("e")).dropDuplicates(["channel", "e"])
    m = rows.groupBy("channel").agg(F.map_from_entries(F.collect_list("e")).alias("more"))
    j = images.join(m, "channel", "left")
    kept = F.map_filter("meta", lambda k, _: ~F.map_contains_key("more", k))
    return j.withColumn("meta", F.when(F.col("more").isNull(), F.col("meta")).otherwise(F.map_concat(kept, F.col("more")))).drop("more")
