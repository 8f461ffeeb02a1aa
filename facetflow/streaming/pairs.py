"""Two streams that meet: manual poses and solved ones, frames and the landmarks found in them, landmarks and the poses solved from them.

All are one outer join of streams on keys and time: a left row meets the right rows of its keys from `before` earlier to `after` later, and of
these the last counts. Batches leave the rows of both streams. When they are read, the rows of a key and a slice of time pass in order of time
once, and each takes the last one of the other side that has passed: the work grows with the rows, not with the pairs in reach of each other, and the
result is that of one join over all rows, however they fall into batches. A row that has met something is answered at once, one that has met nothing
when both streams are further on, by `late`, than it could be met from. With a store, a job that is started again goes on from its checkpoint.

Defined results: rows without time are left out; null keys meet nothing; left rows without id are left out, but show how far their stream is; of right rows at the same time the one with the greatest values
counts; repeated rows of the same id are one; empty streams give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .store import run_batches


def _passed(asked: DataFrame, until: Column, values: DataFrame, at: Column, keys: list[str], width: Column) -> DataFrame:
    """asked with `last`: of values (keys, value) with the same keys the one with the greatest time (at) not after `until`, then the greatest value.
    Both are dealt by keys and slices of time, a value to its own slice and the next: what is more than `width` before `until` may be missed."""
    micros = lambda c: F.unix_micros(c)
    slice_ = lambda c: F.floor(micros(c) / F.greatest(width, F.lit(1)))
    rest = F.struct(*(F.col(c) for c in asked.columns))
    q = asked.select(*keys, slice_(until).alias("_slice"), micros(until).alias("_t"), F.lit(1).alias("_kind"), rest.alias("_row"), F.lit(None).cast(values.schema["value"].dataType).alias("value"))
    v = values.select(*keys, F.explode(F.array(slice_(at), slice_(at) + 1)).alias("_slice"), micros(at).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), "value")
    known = v.dropna(subset=keys)
    order = Window.partitionBy(*keys, "_slice").orderBy("_t", "_kind", "value").rowsBetween(Window.unboundedPreceding, 0)
    return q.unionByName(known).withColumn("last", F.last("value", ignorenulls=True).over(order)).where("_kind = 1").select("_row.*", "last")


def last_within(left: DataFrame, right: DataFrame, keys: list[str], before: str, after: str, late: str, name: str, store: str | None = None, how: str = "leftOuter") -> DataFrame:
    """left (id, at, keys, ...) with `found`: the last row of right (at, keys, ...) in its time, as a struct, or null. With fullOuter also the
    right rows that no left row met, with nulls on the left."""
    columns = [c for c in left.columns if c not in ("id", "at")]
    row = {"l": F.struct("id", "at", *columns), "r": F.struct("at", *[c for c in right.columns if c != "at"])}
    sides = {k: df.where("at is not null").select(row[k].alias(k)) for k, df in (("l", left), ("r", right))}
    schema = ", ".join(f"{k} {df.dtypes[0][1]}" for k, df in sides.items())
    rows = run_batches(sides["l"].unionByName(sides["r"], allowMissingColumns=True).select("l", "r"), lambda p: p, name, schema, store).drop("round")

    gap = {k: F.expr(f"INTERVAL {x}") for k, x in (("before", before), ("after", after), ("late", late))}
    start = F.timestamp_seconds(F.lit(0))
    width = F.unix_micros(start + gap["before"] + gap["after"])
    ends = rows.agg(F.max("l.at").alias("l"), F.max("r.at").alias("r"))
    ends = ends.select(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.least("l", "r") - gap["late"]).alias("_end"))  # one row
    lefts = rows.where("l is not null").select("l.*").where("id is not null")
    rights = rows.where("r is not null").select(F.col("r").alias("found"), F.col("r.at").alias("at"), *(F.col("r")[k].alias(k) for k in keys))

    met = _passed(lefts, F.col("at") + gap["after"], rights.withColumnRenamed("found", "value"), F.col("at"), keys, width)
    met = met.withColumn("found", F.when(F.col("last")["at"] >= F.col("at") - gap["before"], F.col("last")))
    met = met.crossJoin(F.broadcast(ends)).where(F.col("found").isNotNull() | (F.col("at") + gap["after"] < F.col("_end")))
    met = met.groupBy("id").agg(F.any_value("at").alias("at"), *(F.any_value(c).alias(c) for c in columns), F.max("found").alias("found"))
    if how != "fullOuter":
        return met
    alone = _passed(rights, F.col("at") + gap["before"], lefts.select("at", *keys, F.struct("at").alias("value")), F.col("at"), keys, width)
    alone = alone.crossJoin(F.broadcast(ends)).where((F.col("last").isNull() | (F.col("last")["at"] < F.col("at") - gap["after"])) & (F.col("at") + gap["before"] < F.col("_end")))
    return met.unionByName(alone.select("found"), allowMissingColumns=True)


def posed(solved: DataFrame, manual: DataFrame, before: str, after: str, late: str, store: str | None = None) -> DataFrame:
    """id, key, pose, source of streamed solved poses (id, at, key, pose), where a manual pose (at, key, pose) near in time wins; and manual
    poses that no solved one is near to, without an id."""
    j = last_within(solved, manual, ["key"], before, after, late, "posed", store, "fullOuter")
    manual_pose = F.col("found")["pose"]
    return j.select("id", F.coalesce("key", F.col("found")["key"]).alias("key"), F.coalesce(manual_pose, "pose").alias("pose"), F.when(manual_pose.isNotNull(), "manual").when(F.col("pose").isNotNull(), "solved").alias("source"))


def with_landmarks(images: DataFrame, landmarks: DataFrame, before: str, late: str, store: str | None = None) -> DataFrame:
    """id, channel, meta of streamed images (id, at, channel, meta) with the landmarks (at, channel, marks array<struct<name, x, y>>) that were
    last projected into their channel, at most `before` earlier; these win over what meta holds."""
    j = last_within(images, landmarks, ["channel"], before, "0 seconds", late, "landmarked", store)
    marks = j.select(F.col("id").alias("channel"), F.explode(F.col("found")["marks"]).alias("m")).select("channel", "m.name", "m.x", "m.y")
    out = frames.with_landmarks(j.select(F.col("id").alias("channel"), F.col("channel").alias("image_channel"), "meta"), marks)
    return out.select(F.col("channel").alias("id"), F.col("image_channel").alias("channel"), "meta")


def solved(images: DataFrame, poses: DataFrame, before: str, after: str, late: str, least: int = 4, store: str | None = None) -> DataFrame:
    """id, channel, n, pose, error of streamed images (id, at, channel, n, pose_key) by streamed poses (at, pose_key, pose) that were solved for
    the same landmarks; what is missing is said in error, no image is lost."""
    j = last_within(images, poses, ["pose_key"], before, after, late, "solved", store)
    pose = F.col("found")["pose"]
    error = F.when(F.col("n") < least, "too few landmarks").when(pose.isNull(), "no pose solved for these landmarks")
    return j.select("id", "channel", "n", F.when(F.col("n") >= least, pose).alias("pose"), error.alias("error"))
