"""Queries that read their table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import camera
from ..session import cut, table
from ..sources import fixtures as fx
from ..streaming import accumulate as op, frames
from . import camera_queries
from .registry import query


@query("str02_stream_accumulate", f"WITH {fx.PIXELS_SQL} SELECT ix, iy, t, CASE WHEN sum(w) < 0.01 THEN 0.0 ELSE round(sum(w * v) / sum(w), 6) END + 0.0 AS v, round(sum(w), 6) + 0.0 AS w FROM pixels WHERE w > 0 GROUP BY ALL")
def stream_accumulate(spark, d):
    schema = table(spark, d, "lineitem").schema
    n = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    p = n.select((F.col("l_partkey") % 32).cast("int").alias("ix"), (F.col("l_suppkey") % 32).cast("int").alias("iy"), F.col("l_linenumber").alias("t"), F.col("l_quantity").alias("v"), (1 - F.col("l_discount") * 10).alias("w"))
    return op.normalized(op.run_available(op.accumulate_stream(p), "stream-accumulate"))


def _events(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("str03_grabbed_frames", "SELECT DISTINCT event_id AS frame FROM events WHERE event_id % 4 = 0")
def grabbed(spark, d):
    """Every fourth event is a grabbed frame that comes twice and counts once."""
    e = _events(spark, d).select(F.col("event_id").alias("frame"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 4 == 0).alias("grabbed"))
    twice = e.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return frames.each_batch(frames.grabbed(twice, "frame", "at", "4000 days").select("frame"), lambda b: b, "grabbed", "frame long")


@query("str08_stream_background", f"WITH {fx.PIXELS_SQL}, s AS (SELECT shot, ix, iy, t, avg(v) AS v FROM pixels GROUP BY ALL), b AS (SELECT shot, ix, iy, avg(v) AS early FROM s WHERE t <= 2 GROUP BY ALL) SELECT shot, ix, iy, t, round(v - early, 6) + 0.0 AS v FROM s LEFT JOIN b USING (shot, ix, iy)")
def stream_background(spark, d):
    """Stacks less the mean of their first two frames."""
    cell = ("shot", "ix", "iy")
    out = frames.without_early(_pixels(spark, d).select(*cell, "t", "v"), 2, *cell)
    return out.select(*cell, "t", (F.round("v", 6) + 0.0).alias("v"))


def _pixels(spark, d):
    n = spark.readStream.schema(table(spark, d, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)
    return n.select((F.col("l_orderkey") % 4).alias("shot"), (F.col("l_partkey") % 32).cast("int").alias("ix"), (F.col("l_suppkey") % 32).cast("int").alias("iy"), F.col("l_linenumber").cast("long").alias("t"), F.col("l_quantity").cast("double").alias("v"), (1 - F.col("l_discount") * 10).alias("w"))


LOG = "c AS (SELECT event_id AS seq, 'L' || user_id % 20 AS name, value AS x, value / 2 AS y, CASE WHEN event_id = (SELECT max(event_id) // 2 FROM events) THEN 'clear-all' WHEN event_id % 7 = 0 THEN 'clear' WHEN event_id % 11 = 0 THEN 'invalid' WHEN event_id % 13 = 0 THEN 'query' ELSE 'set' END AS command FROM events)"


@query("str04_stream_commands", f"WITH {LOG}, l AS (SELECT name, max(seq) AS seq FROM c WHERE command IN ('set', 'invalid', 'clear') AND seq > coalesce((SELECT max(seq) FROM c WHERE command = 'clear-all'), -1) GROUP BY name) SELECT name, CASE WHEN command = 'set' THEN x END AS x, CASE WHEN command = 'set' THEN y END AS y, command = 'invalid' AS invalid FROM l JOIN c USING (name, seq) WHERE command <> 'clear'")
def commands(spark, d):
    """A log of set, clear, invalid, query and clear-all commands read as a stream."""
    middle = table(spark, d, "events").agg(F.expr("max(event_id) div 2").alias("m")).first()["m"]
    k = F.col("event_id")
    command = F.when(k == middle, "clear-all").when(k % 7 == 0, "clear").when(k % 11 == 0, "invalid").when(k % 13 == 0, "query").otherwise("set")
    log = _events(spark, d).select(k.alias("seq"), command.alias("command"), F.concat(F.lit("L"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"))
    return frames.streamed_commands(log)


@query("str05_poses", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'manual ' || p_brand ELSE 'solved ' || p_brand END AS pose, CASE WHEN p_partkey % 3 = 0 THEN 'manual' ELSE 'solved' END AS source FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
def poses(spark, d):
    """A manual pose wins over the solved one."""
    p = table(spark, d, "part")
    pose = lambda kind: p.select(F.col("p_partkey").alias("key"), F.concat(F.lit(f"{kind} "), "p_brand").alias("pose"))
    return frames.posed(pose("solved").where("key % 2 = 0"), pose("manual").where("key % 3 = 0"))


@query("str06_landmarks_in_metadata", "SELECT p_partkey AS channel, 'kept' AS other, CASE WHEN n_nationkey IS NULL THEN 'old' ELSE n_regionkey::DOUBLE::VARCHAR END AS x, CASE WHEN n_nationkey IS NOT NULL THEN (n_nationkey + 0.5)::DOUBLE::VARCHAR END AS y FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 40")
def landmarks_in_metadata(spark, d):
    """The latest landmark A of a channel in the channel's metadata, over what stood there."""
    k = F.col("p_partkey")
    images = table(spark, d, "part").select(k.alias("channel"), F.create_map(F.lit("LANDMARK_A_X"), F.lit("old"), F.lit("Other"), F.lit("kept")).alias("meta"))
    n = table(spark, d, "nation").select("n_nationkey", F.lit("A").alias("name"), F.col("n_regionkey").cast("double").alias("x"), (F.col("n_nationkey") + 0.5).cast("double").alias("y"))
    marks = table(spark, d, "part").join(n, F.col("n_nationkey") == k % 40).select(k.alias("channel"), "name", "x", "y")
    out = frames.with_landmarks(images, marks)
    at = lambda key: F.element_at("meta", key)
    return out.select("channel", at("Other").alias("other"), at("LANDMARK_A_X").alias("x"), at("LANDMARK_A_Y").alias("y"))


@query("str07_stream_projection", f"WITH {fx.PIXELS_SQL}, h AS (SELECT DISTINCT shot, ix, iy, (ix * 0.7::DOUBLE + 0.15::DOUBLE) AS u, (iy * 0.7::DOUBLE + 0.15::DOUBLE) AS z FROM pixels WHERE (ix + iy) % 5 <> 0), p AS (SELECT t, u, z, v, w FROM pixels JOIN h USING (shot, ix, iy) WHERE w > 0), k AS (SELECT t, u, z, v, w, floor(u)::INTEGER + a.d AS iu, floor(z)::INTEGER + b.d AS iv FROM p, (VALUES (-1), (0), (1), (2)) a(d), (VALUES (-1), (0), (1), (2)) b(d)), c AS (SELECT t, iu, iv, v, w * (0.5 + 0.5 * cos(sqrt((iu - u) * (iu - u) + (iv - z) * (iv - z)) * 0.4 * pi() / sqrt(2))) AS c FROM k WHERE (iu - u) * (iu - u) + (iv - z) * (iv - z) <= 2.25) SELECT t, iu, iv, round(sum(c * v), 4) + 0.0 AS sum_wv, round(sum(c), 4) + 0.0 AS sum_w FROM c GROUP BY ALL")
def stream_projection(spark, d):
    """Streamed frames on what stored hits say is behind their pixels; every batch leaves sums by texel, and these are added."""
    from ..operators import fusion, project

    hits = fx.pixels(spark, d).where("(ix + iy) % 5 <> 0").select(F.col("shot").alias("image"), "ix", "iy", (F.col("ix") * 0.7 + 0.15).alias("hu"), (F.col("iy") * 0.7 + 0.15).alias("hv")).distinct()
    stream = _pixels(spark, d).withColumnRenamed("shot", "image").withColumnRenamed("v", "value")
    work = lambda b: project.splat(frames.projected(b, hits).select("t", F.col("hu").alias("u"), F.col("hv").alias("v"), "value", "w"), "t")
    sums = frames.each_batch(stream, work, "projection", "t long, iu int, iv int, sum_wv double, sum_w double")
    out = fusion.merge(sums, cell=("t", "iu", "iv"))
    return out.select("t", "iu", "iv", *((F.round(c, 4) + 0.0).alias(c) for c in ("sum_wv", "sum_w")))


_C = camera_queries


@query("str09_stream_undistort", f"""WITH {fx.PIXELS_SQL}, n AS (SELECT i AS ix, j AS iy, (i - {_C.CX}) / {_C.FX} AS x, (j - {_C.CY}) / {_C.FY} AS y FROM range(32) a(i), range(32) b(j)),
places AS (SELECT ix, iy, {_C._X} * {_C.FX} + {_C.CX} AS sx, {_C._Y} * {_C.FY} + {_C.CY} AS sy FROM n), {_C._TAPS}
SELECT t4.ix::INTEGER AS ix, t4.iy::INTEGER AS iy, t, round(sum(tw * w * v) / sum(tw * w), 6) + 0.0 AS v FROM t4 JOIN pixels f ON f.ix = px AND f.iy = py WHERE tw > 0 AND w > 0 GROUP BY ALL""")
def stream_undistort(spark, d):
    """Streamed frames through the stored undistortion map of their camera."""
    grid = fx.texels(spark, 32, 32).select(F.col("iu").alias("ix"), F.col("iv").alias("iy"))
    tap_map = cut(camera.taps(camera.undistortion_map(grid, _C.FOCAL, _C.CENTRE, _C.LENS), ["ix", "iy"]), "taps")
    return frames.undistorted(_pixels(spark, d), tap_map, "t").select("ix", "iy", "t", (F.round("v", 6) + 0.0).alias("v"))
