"""The live graph: frames undistorted, projected and accumulated; rectified by corners set in a command log; contacts accumulated to a C-scan;
poses and geometry looked up by what they depend on; texture channels published again with their latest landmarks.

All sums are linear in the measured pixels, so a frame may come in any number of batches, in any order, and the result is that of one
batch over everything. Pixels and samples without a value count for nothing; empty streams give empty tables. `live_source` holds the
back-pressure: a batch takes no more files than it is told, and the next one starts when it is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import camera, fusion, project, waves
from ..session import cut
from . import frames


def live_source(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def chained_taps(second: DataFrame, first: DataFrame) -> DataFrame:
    """One map of taps (ix, iy, px, py, tw) for two resamplings after each other."""
    a = second.select("ix", "iy", F.col("px").alias("mx"), F.col("py").alias("my"), F.col("tw").alias("outer"))
    b = first.select(F.col("ix").alias("mx"), F.col("iy").alias("my"), "px", "py", "tw")
    return a.join(b, ["mx", "my"]).groupBy("ix", "iy", "px", "py").agg(F.sum(F.col("outer") * F.col("tw")).alias("tw"))


def accumulated_projection(stream: DataFrame, tap_map: DataFrame, hits: DataFrame, frame: str, store: str | None = None) -> DataFrame:
    """frame, iu, iv, sum_wv, sum_w: streamed pixels (image, frame, ix, iy, v, w) undistorted by a map of taps, put where the hits (image, ix,
    iy, hu, hv) of their image's pose say, and added up. The sums are what fusion.normalize takes."""
    kinds = dict(stream.dtypes)

    def part(batch: DataFrame) -> DataFrame:
        straight = frames.tap_sums(batch, tap_map, "image", frame).select("image", frame, "ix", "iy", (F.col("s") / F.col("c")).alias("value"), F.col("c").alias("w"))
        seen = frames.projected(straight, hits.select("image", "ix", "iy", "hu", "hv"))
        return project.splat(seen.select(frame, F.col("hu").alias("u"), F.col("hv").alias("v"), "value", "w"), frame)

    sums = frames.each_batch(stream, part, "live-projection", f"{frame} {kinds[frame]}, iu int, iv int, sum_wv double, sum_w double", store)
    return fusion.merge(sums, cell=(frame, "iu", "iv"))


def corner_row(log: DataFrame, names: list[str]) -> DataFrame:
    """One row x0, y0, x1, ... of the latest corners of a streamed command log; no row unless all are set."""
    now = frames.streamed_commands(log).where(F.col("name").isin(names) & ~F.col("invalid"))
    at = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c)))
    row = now.agg(*(at(n, c).alias(f"{c}{i}") for i, n in enumerate(names) for c in "xy"))
    return row.dropna()


def rectified(stream: DataFrame, log: DataFrame, names: list[str], undistortion: DataFrame, n: int, m: int, *frame: str) -> DataFrame:
    """frame, ix, iy, v: streamed frames undistorted, then the quadrilateral of the latest corners on an n x m grid. Both resamplings are one
    stored map, of a size that the grid sets."""
    corners = corner_row(log, names)
    places = camera.rectification_map(corners, corners.columns, F.lit(n), F.lit(m))
    both = cut(chained_taps(camera.taps(places, ["ix", "iy"]), undistortion), "rectify-taps")
    return frames.undistorted(stream, both, *frame)


def contact_scan(shots: DataFrame, e0: float, first: int, last: int, side: int, diameter: float, dt: float, t1: float, t2: float) -> DataFrame:
    """iu, iv, peak, n: streamed shots (wf, cu, cv, v array of samples) weighed by their contact (1 less the energy of samples first to last over
    e0, that of no contact), spread over a face around (cu, cv), accumulated, and the largest envelope between two times. A shot is one row;
    batches leave sums by cell and sample. Shots without contact leave nothing."""

    def part(batch: DataFrame) -> DataFrame:
        z = waves.analytic_rows(batch, "wf", "cu", "cv")
        gate = F.slice(F.arrays_zip("re", "im"), first, last - first + 1)
        energy = F.aggregate(gate, F.lit(0.0), lambda a, s: a + s["re"] * s["re"] + s["im"] * s["im"])
        z = z.withColumn("validity", waves.validity(1 - energy / F.lit(float(e0)))).where("validity > 0")
        samples = z.select("cu", "cv", "validity", F.posexplode(F.arrays_zip("re", "im")).alias("pos", "s")).select("cu", "cv", "validity", (F.col("pos") + 1).cast("long").alias("i"), "s.re", "s.im")
        on = waves.on_face(samples, side, diameter)
        return waves.accumulate_contacts(on.withColumn("w", F.col("w") * F.col("validity")))

    sums = frames.each_batch(shots, part, "contacts", "iu int, iv int, i long, re double, im double, validity double")
    stack = sums.groupBy("iu", "iv", "i").agg(*(F.sum(c).alias(c) for c in ("re", "im", "validity")))
    return waves.gate_peak(waves.envelope(stack).withColumn("at", (F.col("i") - 1) * dt), t1, t2, "iu", "iv")


def pose_keys(image_marks: DataFrame, part_marks: DataFrame, least: int = 4) -> DataFrame:
    """channel, n, pose_key: a digest of the landmarks that an image (channel, name, px, py) and the part (name, x, y, z) share, to a millionth;
    null where they are fewer than least. An image's landmarks are few: they are names that someone gave."""
    micro = lambda c: F.coalesce(F.round(F.col(c) * 1e6).cast("long").cast("string"), F.lit("-"))
    j = image_marks.join(part_marks.select("name", "x", "y", "z"), "name").select("channel", F.concat_ws(":", "name", *map(micro, ("px", "py", "x", "y", "z"))).alias("mark"))
    g = j.groupBy("channel").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("mark")), ",").alias("marks"))
    out = image_marks.select("channel").distinct().join(g, "channel", "left")
    return out.select("channel", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= least, F.sha2("marks", 256)).alias("pose_key"))


def solved_poses(keys: DataFrame, poses: DataFrame) -> DataFrame:
    """channel, n, pose, error: each image's pose from those solved before (pose_key, pose); what is missing is said in error, no row is lost."""
    j = keys.join(poses.dropDuplicates(["pose_key"]), "pose_key", "left")
    error = F.when(F.col("pose_key").isNull(), "too few landmarks").when(F.col("pose").isNull(), "no pose solved for these landmarks")
    return j.select("channel", "n", "pose", error.alias("error"))


def with_key(wanted: DataFrame, *parts: str) -> DataFrame:
    """wanted with cache_key, a digest of the columns that a stored result depends on."""
    return wanted.withColumn("cache_key", F.sha2(F.to_json(F.struct(*parts)), 256))


def stored_or_made(wanted: DataFrame, stored: DataFrame, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(wanted with the results of their cache_key, the newly made results): work runs once for each key that stored lacks. The second table is
    to be appended to what is stored."""
    lacking = wanted.dropDuplicates(["cache_key"]).join(stored.select("cache_key"), "cache_key", "left_anti")
    made = cut(work(lacking), "made")
    return wanted.join(stored.unionByName(made.select(*stored.columns)), "cache_key", "left"), made


def republished(log: DataFrame, channels: DataFrame) -> DataFrame:
    """channels (channel, meta) with the latest landmarks of a streamed log in their metadata; names in the log are channel/landmark."""
    now = frames.streamed_commands(log).where("not invalid")
    marks = now.select(F.substring_index("name", "/", 1).alias("channel"), F.expr("substring(name, instr(name, '/') + 1)").alias("name"), "x", "y")
    return frames.with_landmarks(channels, marks)
