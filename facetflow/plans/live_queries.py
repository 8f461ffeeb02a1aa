"""Queries of the live graph. Streams take one file for each task a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import camera
from ..session import cut, fresh_path, table
from ..sources import fixtures as fx
from ..streaming import live as op
from . import camera_queries as cam
from .fusion_queries import ANALYTIC
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)


def _stream(spark, df, name, batches):
    """df written as files and read back as a stream of so many batches, whose files are as many as tasks run at once."""
    path, tasks = fresh_path(spark, name), spark.sparkContext.defaultParallelism
    df.repartition(batches * tasks).write.parquet(path)
    return op.live_source(spark, path, df.schema, tasks)


def _pixels(spark, d):
    p = fx.pixels(spark, d).select("shot", "ix", "iy", F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"), F.col("w").cast("double").alias("w"))
    return _stream(spark, p, "live-pixels", 3)


def _undistortion(spark):
    grid = fx.texels(spark, 32, 32).select(F.col("iu").alias("ix"), F.col("iv").alias("iy"))
    return cut(camera.taps(camera.undistortion_map(grid, cam.FOCAL, cam.CENTRE, cam.LENS), ["ix", "iy"]), "taps")


_UNDISTORT = f"""un AS (SELECT i AS ix, j AS iy, (i - {cam.CX}) / {cam.FX} AS x, (j - {cam.CY}) / {cam.FY} AS y FROM range(32) a(i), range(32) b(j)),
uplaces AS (SELECT ix, iy, {cam._X} * {cam.FX} + {cam.CX} AS sx, {cam._Y} * {cam.FY} + {cam.CY} AS sy FROM un), {cam._TAPS.replace("t4 AS", "u4 AS").replace("places p", "uplaces p")}"""


@query("str01_live_graph", f"""WITH {fx.PIXELS_SQL}, {_UNDISTORT},
s AS (SELECT shot, t, u4.ix, u4.iy, sum(tw * w * v) / sum(tw * w) AS v, sum(tw * w) AS w FROM u4 JOIN pixels f ON f.ix = px AND f.iy = py WHERE tw > 0 AND w > 0 GROUP BY ALL),
p AS (SELECT t, ix * 0.7::DOUBLE + 0.15::DOUBLE + shot * 0.01::DOUBLE AS u, iy * 0.7::DOUBLE + 0.15::DOUBLE AS z, v, w FROM s WHERE (ix + iy) % 5 <> 0),
k AS (SELECT t, u, z, v, w, floor(u)::INTEGER + a.d AS iu, floor(z)::INTEGER + b.d AS iv FROM p, (VALUES (-1), (0), (1), (2)) a(d), (VALUES (-1), (0), (1), (2)) b(d)),
c AS (SELECT t, iu, iv, v, w * (0.5 + 0.5 * cos(sqrt((iu - u) * (iu - u) + (iv - z) * (iv - z)) * 0.4 * pi() / sqrt(2))) AS c FROM k WHERE (iu - u) * (iu - u) + (iv - z) * (iv - z) <= 2.25)
SELECT t, iu, iv, round(sum(c * v), 4) + 0.0 AS sum_wv, round(sum(c), 4) + 0.0 AS sum_w FROM c GROUP BY ALL""")
def live_graph(spark, d):
    """Streamed frames of all shots undistorted, projected through the hits of each shot's pose, and accumulated."""
    grid = fx.texels(spark, 32, 32).select(F.col("iu").alias("ix"), F.col("iv").alias("iy")).where("(ix + iy) % 5 <> 0")
    shots = fx.pixels(spark, d).select(F.col("shot").alias("image")).distinct()
    place = {"hu": F.col("ix") * 0.7 + 0.15 + F.col("image") * 0.01, "hv": F.col("iy") * 0.7 + 0.15}
    hits = cut(shots.crossJoin(F.broadcast(grid)).withColumns(place), "hits")  # the grid is one camera's pixels
    out = op.accumulated_projection(_pixels(spark, d).withColumnRenamed("shot", "image"), _undistortion(spark), hits, "t")
    return out.select("t", "iu", "iv", R("sum_wv", 4).alias("sum_wv"), R("sum_w", 4).alias("sum_w"))


CONTACT_FACE = "f AS (SELECT i, (wf % 16 + q % 3 - 1)::INTEGER AS iu, (wf // 16 % 16 + q // 3 - 1)::INTEGER AS iv, re, im, validity * exp(-((q % 3 - 1) * (q % 3 - 1) + (q // 3 - 1) * (q // 3 - 1)) / 1.0::DOUBLE) AS w FROM z JOIN c USING (wf), range(9) g(q) WHERE validity > 0)"


@query("str10_live_contacts", f"""WITH {fx.WAVES_SQL}, {ANALYTIC}, r AS (SELECT max(e) AS e0 FROM (SELECT sum(v * v) AS e FROM waves GROUP BY wf)),
e AS (SELECT wf, coalesce(sum(re * re + im * im) FILTER (i BETWEEN 5 AND 20), 0) AS e FROM z GROUP BY wf), b AS (SELECT wf, 1 - e / e0 AS c FROM e, r),
c AS (SELECT wf, CASE WHEN c < 0.1 THEN 0 WHEN c < 0.4 THEN c * c / 0.4 ELSE c END AS validity FROM b), {CONTACT_FACE},
s AS (SELECT iu, iv, i, sqrt(sum(w * re) ** 2 + sum(w * im) ** 2) / sum(w) AS env FROM f GROUP BY ALL)
SELECT iu, iv, round(max(env), 4) AS peak, count(*) AS n FROM s WHERE (i - 1) * 0.25 BETWEEN 1.0 AND 20.0 GROUP BY ALL""")
def live_contacts(spark, d):
    """Each user's events as one shot; the reference energy is that of the strongest waveform."""
    w = fx.waves(spark, d)
    e0 = w.groupBy("wf").agg(F.sum(F.col("v") * F.col("v")).alias("e")).agg(F.max("e").cast("double")).first()[0]
    samples = F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("v").cast("double").alias("v")))), lambda s: s["v"])
    shots = w.groupBy("wf").agg(samples.alias("v")).select("wf", (F.col("wf") % 16).alias("cu"), F.expr("wf div 16 % 16").alias("cv"), "v")
    out = op.contact_scan(_stream(spark, shots, "shots", 3), e0 or 1.0, 5, 20, 3, 3.0, 0.25, 1.0, 20.0)
    return out.select("iu", "iv", R("peak", 4).alias("peak"), "n")


_MICRO = "coalesce(round({} * 1e6)::BIGINT::VARCHAR, '-')"
_MARKS = "image AS (SELECT user_id % 97 AS channel, 'L' || event_id % 30 AS name, arg_max(value, event_id) AS px, min(value) AS py FROM events GROUP BY ALL), part3 AS (SELECT 'L' || n_nationkey AS name, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y, 0.5::DOUBLE AS z FROM nation)"


@query("str12_pose_lookup", f"""WITH {_MARKS}, j AS (SELECT channel, concat_ws(':', name, {", ".join(_MICRO.format(c) for c in ("px", "py", "x", "y", "z"))}) AS mark FROM image JOIN part3 USING (name)),
g AS (SELECT channel, count(*) AS n FROM j GROUP BY channel)
SELECT channel, coalesce(n, 0) AS n, CASE WHEN n >= 4 AND channel % 3 <> 0 THEN 'pose ' || channel END AS pose, CASE WHEN coalesce(n, 0) < 4 THEN 'too few landmarks' WHEN channel % 3 = 0 THEN 'no pose solved for these landmarks' END AS error FROM (SELECT DISTINCT channel FROM image) LEFT JOIN g USING (channel)""")
def pose_lookup(spark, d):
    """Poses looked up by the landmarks that they were solved from; every third image has none yet."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 97).alias("channel"), F.concat(F.lit("L"), (F.col("event_id") % 30).cast("string")).alias("name")).agg(F.max_by("value", "event_id").alias("px"), F.min("value").alias("py"))
    p = table(spark, d, "nation").select(F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"), F.lit(0.5).alias("z"))
    keys = cut(op.pose_keys(e, p), "pose-keys")
    poses = keys.where("pose_key is not null and channel % 3 <> 0").select("pose_key", F.concat(F.lit("pose "), F.col("channel").cast("string")).alias("pose"))
    return op.solved_poses(keys, poses)


_CORNER = {"C0": (2.2, 3.1), "C1": (27.3, 1.4), "C2": (28.1, 27.2), "C3": (4.6, 26.7)}
_CORNERS_SQL = "q AS (SELECT " + ", ".join(f"{at!r}::DOUBLE + (SELECT max(event_id) % 7 FROM events WHERE event_id % 4 = {i}) * {step!r}::DOUBLE AS {c}{i}" for i, corner in enumerate(_CORNER.values()) for c, at, step in zip("xy", corner, (0.1, 0.05))) + ")"


@query("str13_live_rectification", f"""WITH {fx.PIXELS_SQL}, {_UNDISTORT}, {_CORNERS_SQL},
k AS (SELECT *, x0 - x1 + x2 - x3 AS sx_, y0 - y1 + y2 - y3 AS sy_, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS det FROM q),
h AS (SELECT *, (sx_ * (y3 - y2) - (x3 - x2) * sy_) / det AS g, ((x1 - x2) * sy_ - sx_ * (y1 - y2)) / det AS h FROM k),
w AS (SELECT h.*, i AS ix, j AS iy, (i + 0.5::DOUBLE) / 16 AS u, (j + 0.5::DOUBLE) / 12 AS z FROM h, range(16) a(i), range(12) b(j)),
places AS (SELECT ix, iy, ((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * z + x0) / (g * u + h * z + 1) AS sx, ((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * z + y0) / (g * u + h * z + 1) AS sy FROM w), {cam._TAPS},
m AS (SELECT t4.ix, t4.iy, u4.px, u4.py, sum(t4.tw * u4.tw) AS tw FROM t4 JOIN u4 ON t4.px = u4.ix AND t4.py = u4.iy WHERE t4.tw > 0 AND u4.tw > 0 GROUP BY ALL)
SELECT m.ix::INTEGER AS ix, m.iy::INTEGER AS iy, t, round(sum(tw * f.w * v) / sum(tw * f.w), 6) + 0.0 AS v FROM m JOIN pixels f ON f.ix = px AND f.iy = py WHERE f.w > 0 GROUP BY ALL""")
def live_rectification(spark, d):
    """Corners set again and again by a log, the last ones count; streamed frames undistorted and rectified by them."""
    k = F.col("event_id")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % 4).cast("int"))
    x, y = ([c[i] for c in _CORNER.values()] for i in (0, 1))
    log = table(spark, d, "events").select(k.alias("seq"), F.lit("set").alias("command"), pick(list(_CORNER)).alias("name"), (pick(x) + k % 7 * 0.1).alias("x"), (pick(y) + k % 7 * 0.05).alias("y"))
    out = op.rectified(_pixels(spark, d), _stream(spark, log, "corner-log", 3), list(_CORNER), _undistortion(spark), 16, 12, "t")
    return out.select("ix", "iy", "t", R("v").alias("v"))


@query("str14_republished_landmarks", """WITH e AS (SELECT user_id % 50 AS c, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS name, event_id, value FROM events),
l AS (SELECT c, name, arg_max(value, event_id) AS x, max(event_id) AS seq FROM e GROUP BY ALL), m AS (SELECT * FROM l WHERE seq % 9 <> 0)
SELECT 'T' || p_partkey AS channel, p_name AS title, CASE WHEN a.c IS NULL THEN 'old' ELSE round(a.x, 6)::VARCHAR END AS ax, round(b.x, 6)::VARCHAR AS bx FROM part LEFT JOIN m a ON a.c = p_partkey AND a.name = 'A' LEFT JOIN m b ON b.c = p_partkey AND b.name = 'B'""")
def republished(spark, d):
    """Texture channels with the landmarks that stand after the log; every ninth command clears."""
    k = F.col("event_id")
    name = F.concat(F.lit("T"), (F.col("user_id") % 50).cast("string"), F.lit("/"), F.when(k % 2 == 0, "A").otherwise("B"))
    log = table(spark, d, "events").select(k.alias("seq"), F.when(k % 9 == 0, "clear").otherwise("set").alias("command"), name.alias("name"), F.round("value", 6).alias("x"), F.lit(0.5).alias("y"))
    channels = table(spark, d, "part").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("channel"), F.create_map(F.lit("Title"), F.col("p_name"), F.lit("LANDMARK_A_X"), F.lit("old")).alias("meta"))
    out = op.republished(_stream(spark, log, "landmark-log", 3), channels)
    at = lambda key: F.element_at("meta", key)
    return out.select("channel", at("Title").alias("title"), at("LANDMARK_A_X").alias("ax"), at("LANDMARK_B_X").alias("bx"))


@query("str15_cached_geometry", "SELECT p_partkey AS channel, p_size * 2 + p_partkey % 3 AS geometry, p_size % 2 = 1 AS made FROM part")
def cached_geometry(spark, d):
    """Geometry that depends on revision and pose: what is stored (even revisions) isn't made again."""
    wanted = op.with_key(table(spark, d, "part").select(F.col("p_partkey").alias("channel"), F.col("p_size").cast("long").alias("revision"), (F.col("p_partkey") % 3).cast("long").alias("pose")), "revision", "pose")
    work = lambda keys, made: keys.select("cache_key", (F.col("revision") * 2 + F.col("pose")).alias("geometry"), F.lit(made).alias("made"))
    stored = work(wanted.where("revision % 2 = 0").dropDuplicates(["cache_key"]), False)
    return op.stored_or_made(wanted, stored, lambda keys: work(keys, True))[0].select("channel", "geometry", "made")
