"""Queries of streams that go on where they stopped, and of streams that meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import fresh_path, table
from ..sources import fixtures as fx
from ..streaming import accumulate, live, pairs
from . import streaming_queries as sq
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)
PARTS, LATE, CLOSING = 4, "1 day", -1


def _timed(spark, df, name):
    """A stream of df (at, ...) by quarters of its time, one file a batch, and two rows, years later, with the keys CLOSING: the watermark follows
    the first and the batch of the second answers all rows before."""
    path = fresh_path(spark, name)
    seconds = F.col("at").cast("timestamp").cast("double")
    span = df.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    part = F.least(F.lit(PARTS - 1), F.floor((seconds - (span["a"] or 0.0)) / (((span["b"] or 0.0) - (span["a"] or 0.0)) / PARTS or 1.0)))
    df = df.withColumn("at", F.col("at").cast("timestamp"))
    for k in range(PARTS):
        df.where(part == k).coalesce(1).write.mode("append").parquet(path)
    for day in ("2100-01-01", "2100-01-02"):
        values = {c: F.to_timestamp(F.lit(day)) if c == "at" else F.lit(CLOSING if t in ("bigint", "int", "string") and c != "id" else None).cast(t) for c, t in df.dtypes}
        df.limit(1).select(*(v.alias(c) for c, v in values.items())).write.mode("append").parquet(path)
    return live.live_source(spark, path, df.schema)


def _events(spark, d):
    return table(spark, d, "events").withColumnRenamed("ts", "at")


@query("str05_stream_poses", """WITH s AS (SELECT event_id AS id, ts AS tm, user_id AS key, 'solved ' || event_id AS pose FROM events WHERE event_id % 2 = 0), m AS (SELECT ts AS tm, user_id AS key, 'manual ' || event_id AS pose FROM events WHERE event_id % 3 = 0),
j AS (SELECT s.id, coalesce(s.key, m.key) AS key, s.pose AS sp, m.pose AS mp, m.tm FROM s FULL JOIN m ON s.key = m.key AND m.tm >= s.tm - INTERVAL 6 HOUR AND m.tm <= s.tm + INTERVAL 2 HOUR),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tm DESC NULLS LAST, mp DESC) AS r FROM j WHERE id IS NOT NULL)
SELECT id, key, coalesce(mp, sp) AS pose, CASE WHEN mp IS NULL THEN 'solved' ELSE 'manual' END AS source FROM r WHERE r = 1 UNION ALL SELECT NULL, key, mp, 'manual' FROM j WHERE id IS NULL""")
def stream_poses(spark, d):
    """Solved poses against manual ones of the same key in a window of time: two streams, outer on both sides."""
    e, k = _events(spark, d), F.col("event_id")
    pose = lambda kind: F.concat(F.lit(f"{kind} "), k.cast("string")).alias("pose")
    solved = e.where(k % 2 == 0).select(k.alias("id"), "at", F.col("user_id").alias("key"), pose("solved"))
    manual = e.where(k % 3 == 0).select("at", F.col("user_id").alias("key"), pose("manual"))
    return pairs.posed(_timed(spark, solved, "solved"), _timed(spark, manual, "manual"), "6 hours", "2 hours", LATE).where(F.col("key") != CLOSING)


@query("str06_stream_landmarks", """WITH i AS (SELECT event_id AS id, ts AS tm, user_id AS channel FROM events WHERE event_id % 5 = 0), m AS (SELECT ts AS tm, user_id AS channel, event_id + 0.5::DOUBLE AS x FROM events WHERE event_id % 2 = 1),
j AS (SELECT i.*, m.x, row_number() OVER (PARTITION BY i.id ORDER BY m.tm DESC NULLS LAST, m.x DESC) AS r FROM i LEFT JOIN m ON m.channel = i.channel AND m.tm >= i.tm - INTERVAL 12 HOUR AND m.tm <= i.tm)
SELECT id, channel, 'kept' AS other, CASE WHEN x IS NULL THEN 'old' ELSE x::VARCHAR END AS ax, (x / 2)::VARCHAR AS ay FROM j WHERE r = 1""")
def stream_landmarks(spark, d):
    """Images with the landmark that was last projected into their channel, at most twelve hours before."""
    e, k = _events(spark, d), F.col("event_id")
    meta = F.create_map(F.lit("LANDMARK_A_X"), F.lit("old"), F.lit("Other"), F.lit("kept")).alias("meta")
    images = e.where(k % 5 == 0).select(k.alias("id"), "at", F.col("user_id").alias("channel"), meta)
    marks = F.array(F.struct(F.lit("A").alias("name"), (k + 0.5).cast("double").alias("x"), ((k + 0.5) / 2).cast("double").alias("y"))).alias("marks")
    found = e.where(k % 2 == 1).select("at", F.col("user_id").alias("channel"), marks)
    out = pairs.with_landmarks(_timed(spark, images, "images"), _timed(spark, found, "found-marks"), "12 hours", LATE)
    at = lambda key: F.element_at("meta", key)
    return out.select("id", "channel", at("Other").alias("other"), at("LANDMARK_A_X").alias("ax"), at("LANDMARK_A_Y").alias("ay"))


@query("str12_stream_poses", """WITH i AS (SELECT event_id AS id, ts AS tm, user_id AS channel, 2 + event_id % 5 AS n, md5((user_id % 20) || ':' || (2 + event_id % 5)) AS pose_key FROM events WHERE event_id % 3 = 0),
p AS (SELECT ts AS tm, md5((event_id % 20) || ':' || (2 + user_id % 6)) AS pose_key, 'pose ' || event_id AS pose FROM events WHERE event_id % 4 <> 0),
j AS (SELECT i.*, p.pose, row_number() OVER (PARTITION BY i.id ORDER BY p.tm DESC NULLS LAST, p.pose DESC) AS r FROM i LEFT JOIN p ON p.pose_key = i.pose_key AND p.tm >= i.tm - INTERVAL 10 HOUR AND p.tm <= i.tm + INTERVAL 2 HOUR)
SELECT id, channel, n, CASE WHEN n >= 4 THEN pose END AS pose, CASE WHEN n < 4 THEN 'too few landmarks' WHEN pose IS NULL THEN 'no pose solved for these landmarks' END AS error FROM j WHERE r = 1""")
def stream_solved(spark, d):
    """Images by their landmarks' digest against the poses that a solver gives for digests, earlier or a little later."""
    e, k, u = _events(spark, d), F.col("event_id"), F.col("user_id")
    digest = lambda a, b: F.md5(F.concat((a % 20).cast("string"), F.lit(":"), b.cast("string"))).alias("pose_key")
    images = e.where(k % 3 == 0).select(k.alias("id"), "at", u.alias("channel"), (2 + k % 5).alias("n"), digest(u, 2 + k % 5))
    poses = e.where(k % 4 != 0).select("at", digest(k, 2 + u % 6), F.concat(F.lit("pose "), k.cast("string")).alias("pose"))
    return pairs.solved(_timed(spark, images, "posed-images"), _timed(spark, poses, "poses"), "10 hours", "2 hours", LATE)


def _two_runs(spark, df, name, run):
    """What run(stream, store) gives after a first run over some files and a second one, by the same store, once more have come."""
    path, store = fresh_path(spark, f"{name}-in"), fresh_path(spark, f"{name}-store")
    half = F.pmod(F.xxhash64(*df.columns), F.lit(2))
    df.where(half == 0).repartition(2).write.parquet(path)
    run(live.live_source(spark, path, df.schema), store)
    df.where(half == 1).repartition(2).write.mode("append").parquet(path)
    return run(live.live_source(spark, path, df.schema), store)


@query("str02_resumed_accumulation", f"WITH {fx.PIXELS_SQL} SELECT ix, iy, t, CASE WHEN sum(w) < 0.01 THEN 0.0 ELSE round(sum(w * v) / sum(w), 6) END + 0.0 AS v, round(sum(w), 6) + 0.0 AS w FROM pixels WHERE w > 0 GROUP BY ALL")
def resumed_accumulation(spark, d):
    """Accumulation stopped half way and started again: the sums are in the checkpoint, files are read once."""
    p = fx.pixels(spark, d).select("ix", "iy", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"), F.col("w").cast("double").alias("w"))
    return accumulate.normalized(_two_runs(spark, p, "accumulate", lambda s, store: accumulate.run_available(accumulate.accumulate_stream(s), "sums", store=store)))


@query("str08_resumed_background", f"WITH {fx.PIXELS_SQL}, s AS (SELECT shot, ix, iy, t, avg(v) AS v FROM pixels GROUP BY ALL), b AS (SELECT shot, ix, iy, avg(v) AS early FROM s WHERE t <= 2 GROUP BY ALL) SELECT shot, ix, iy, t, round(v - early, 6) + 0.0 AS v FROM s LEFT JOIN b USING (shot, ix, iy)")
def resumed_background(spark, d):
    """Stacks less their background, the stream stopped half way and started again."""
    cell = ("shot", "ix", "iy")
    p = fx.pixels(spark, d).select(*cell, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"), F.monotonically_increasing_id().alias("n"))
    out = _two_runs(spark, p, "background", lambda s, store: sq.frames.without_early(s.select(*cell, "t", "v"), 2, *cell, store=store))
    return out.select(*cell, "t", R("v").alias("v"))


@query("agg26_by_revision", f"""WITH {fx.PIXELS_SQL}, r AS (SELECT l_orderkey % 4 AS channel, l_orderkey // 4 % 5 AS revision, l_linenumber AS t, (l_partkey % 64)::INTEGER AS ix, (l_suppkey % 64)::INTEGER AS iy, l_quantity AS v, 1 - l_discount * 10 AS w FROM lineitem WHERE 1 - l_discount * 10 > 0 AND l_suppkey % 64 // 16 + l_orderkey // 4 % 5 < 6),
m AS (SELECT channel, ix // 16 AS tx, iy // 16 AS ty, max(revision) AS revision FROM r GROUP BY ALL)
SELECT channel, revision, t, ix, iy, round(sum(w * v), 4) + 0.0 AS sum_wv, round(sum(w), 4) + 0.0 AS sum_w FROM r JOIN m ON r.channel = m.channel AND r.revision = m.revision AND ix // 16 = tx AND iy // 16 = ty GROUP BY r.channel, r.revision, t, ix, iy""".replace("SELECT channel, revision, t, ix", "SELECT r.channel, r.revision, t, ix"))
def by_revision(spark, d):
    """Sums that a new revision of the geometry resets, tile by tile, over two runs; tiles end at different revisions."""
    n = table(spark, d, "lineitem")
    whole = lambda e: F.expr(e).cast("int")
    p = n.where("1 - l_discount * 10 > 0 AND l_suppkey % 64 div 16 + l_orderkey div 4 % 5 < 6").select((F.col("l_orderkey") % 4).alias("channel"), F.expr("l_orderkey div 4 % 5").alias("revision"), F.col("l_linenumber").cast("long").alias("t"), whole("l_partkey % 64").alias("ix"), whole("l_suppkey % 64").alias("iy"), F.col("l_quantity").cast("double").alias("v"), (1 - F.col("l_discount") * 10).cast("double").alias("w"))
    out = _two_runs(spark, p, "revisions", lambda s, store: accumulate.by_revision(s, store=store))
    return out.select("channel", "revision", "t", "ix", "iy", R("sum_wv", 4).alias("sum_wv"), R("sum_w", 4).alias("sum_w"))
