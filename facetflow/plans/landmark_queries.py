"""Queries of landmarks that are replaced, of calibration images, and of facets that reach behind the camera."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import camera, landmarks as op
from ..session import cut, dealt, spread, table
from ..sources import calibration_images as src, fixtures as fx
from . import camera_queries as cam
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)
_MARKS = "f AS (SELECT user_id AS mesh, 'L' || event_id % 10 AS name, min(value) AS u FROM events WHERE event_id % 3 = 0 GROUP BY ALL), s AS (SELECT user_id AS mesh, 'L' || event_id % 10 AS name, min(value) AS x FROM events WHERE event_id % 3 = 1 GROUP BY ALL), n AS (SELECT user_id AS mesh, 'L' || event_id % 10 AS name, min(value) AS x FROM events WHERE event_id % 15 = 2 GROUP BY ALL)"


def _marks(spark, d):
    """Landmarks on textures, in space, and new ones in space, many of the same names."""
    e = table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("user_id").alias("mesh"), F.concat(F.lit("L"), (F.col("event_id") % 10).cast("string")).alias("name"), F.col("value").cast("double").alias("x"))
    part = lambda cond, places: e.where(cond).select("mesh", "name", *(F.col("x").alias(p) for p in places))
    return part("k % 3 = 0", "uv"), part("k % 3 = 1", "xyz"), part("k % 15 = 2", "xyz")


@query("join08_upsert", f"WITH {_MARKS} SELECT '2d' AS kind, mesh, name, round(u, 6) + 0.0 AS at FROM f ANTI JOIN n USING (mesh, name) UNION ALL SELECT '3d', mesh, name, round(x, 6) + 0.0 FROM (SELECT * FROM s ANTI JOIN n USING (mesh, name) UNION ALL SELECT * FROM n)")
def upsert(spark, d):
    """Both tables after new landmarks in space, which take their names from either."""
    flat, solid = op.upsert(*_marks(spark, d))
    rows = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), "mesh", "name", R(c).alias("at"))
    return rows(flat, "2d", "u").unionByName(rows(solid, "3d", "x"))


@query("join08_present", f"WITH {_MARKS}, a AS (SELECT p_partkey AS mesh, 'L' || p_size % 13 AS name FROM part) SELECT DISTINCT a.mesh, a.name, CASE WHEN s.mesh IS NOT NULL THEN '3d' WHEN f.mesh IS NOT NULL THEN '2d' END AS kind FROM a LEFT JOIN s USING (mesh, name) LEFT JOIN f USING (mesh, name)")
def present(spark, d):
    flat, solid, _ = _marks(spark, d)
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), F.concat(F.lit("L"), (F.col("p_size") % 13).cast("string")).alias("name"))
    return op.present(asked, flat, solid)


@query("join08_in_frame", f"WITH {_MARKS} SELECT mesh, name, round(2 * x - 1.5 * x + mesh % 7, 6) + 0.0 AS x, round(x + 0.5, 6) + 0.0 AS y, CASE WHEN mesh % 4 <> 0 THEN round(-x, 6) + 0.0 END AS z FROM s".replace("round(2 * x - 1.5 * x + mesh % 7, 6) + 0.0 AS x, round(x + 0.5, 6) + 0.0 AS y", "CASE WHEN mesh % 4 <> 0 THEN round(2 * x - 1.5 * x + mesh % 7, 6) + 0.0 END AS x, CASE WHEN mesh % 4 <> 0 THEN round(x + 0.5, 6) + 0.0 END AS y"))
def in_frame(spark, d):
    """Landmarks in space in the frame of their mesh; every fourth mesh has none."""
    _, solid, _ = _marks(spark, d)
    n = lambda x: F.lit(float(x))
    k = F.col("mesh")
    m = {"m00": n(2), "m01": n(-1.5), "m02": n(0), "m03": (k % 7).cast("double"), "m10": n(0), "m11": n(1), "m12": n(0), "m13": n(0.5), "m20": n(0), "m21": n(0), "m22": n(-1), "m23": n(0)}
    frames = solid.select("mesh").distinct().where("mesh % 4 <> 0").withColumns(m)
    one = op.upsert(solid.selectExpr("mesh", "name", "x as u", "y as v").limit(0), solid, solid.limit(0))[1]
    return op.in_frame(one, frames).select("mesh", "name", *(R(c).alias(c) for c in "xyz"))


def _images(spark, d):
    """A calibration image a part with a point for each line item of it. Points are dealt by image to all tasks, which make and read the texts: these are
    long, but short when packed, so that few tasks would be made for them."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size")
    n = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    place = F.struct("l_orderkey", "l_linenumber", (F.col("l_quantity") * 12.5).cast("double").alias("x"), (F.col("l_discount") * 4000).cast("double").alias("y"))
    points = spread(n.select("id", place.alias("q")), "id").groupBy("id").agg(F.sort_array(F.collect_list("q")).alias("q"))
    j = spread(p, "id").join(dealt(points), "id", "left")
    lit = lambda x: F.lit(x)
    return j.select(
        "id", F.concat(lit("file:///images/"), F.col("id").cast("string")).alias("input"), F.col("p_brand").alias("channel_name"), F.when(F.col("id") % 3 == 0, F.col("p_size").cast("int")).alias("frame_number"),
        (F.col("id") % 5 * 0.25).alias("offset"), lit(0.5).alias("units_per_intensity"), (F.col("id") % 2 == 0).alias("invert"), F.when(F.col("id") % 4 == 0, F.array(lit("CALIB_CB_FAST_CHECK"), lit("CALIB_CB_FILTER_QUADS"))).alias("cvflags"),
        lit("chessboard").alias("pattern_type"), lit(7).alias("pattern_num_x"), lit(5).alias("pattern_num_y"), lit(0.03).alias("pattern_spacing"), lit("meters").alias("spacing_units"),
        F.transform("q", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), F.lit(0.0).alias("z"))).alias("object_points"), F.transform("q", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"))).alias("image_points"), lit("2015-06-14T12:00:00-05:00").alias("at"),
    )


def _spoilt(texts):
    """Every tenth text has a parameter of an unknown name, every eleventh a number that is none."""
    k = F.col("id")
    return texts.withColumn("text", F.when(k % 10 == 0, F.replace("text", F.lit("<invert>"), F.lit("<mirror>1</mirror><invert>"))).when(k % 11 == 0, F.replace("text", F.lit("<pattern_num_x>7"), F.lit("<pattern_num_x>seven"))).otherwise(F.col("text")))


@query("src15_calibration_images", """WITH q AS (SELECT l_partkey AS id, count(*) AS n, sum(l_quantity * 12.5) AS x, sum(l_discount * 4000) AS y FROM lineitem GROUP BY ALL)
SELECT p_partkey AS id, p_brand AS channel_name, CASE WHEN p_partkey % 3 = 0 THEN p_size::INTEGER END AS frame_number, p_partkey % 5 * 0.25::DOUBLE AS "offset", p_partkey % 2 = 0 AS invert, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS flags, 0.03::DOUBLE AS pattern_spacing, 'meters' AS spacing_units, n::INTEGER AS points, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, NULL AS reason
FROM part LEFT JOIN q ON q.id = p_partkey WHERE p_partkey % 10 <> 0 AND p_partkey % 11 <> 0
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN p_partkey % 10 = 0 THEN 'unknown parameter: mirror' ELSE 'not a number: pattern_num_x' END FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 11 = 0""")
def calibration_images(spark, d):
    """Calibration images written as XML and read back, with the rejects."""
    good, rejects = src.read_images(cut(_spoilt(src.write_images(_images(spark, d))), "image-texts"))
    total = lambda c: R(F.aggregate("image_points", F.lit(0.0), lambda a, p: a + p[c]), 3).alias(c)
    good = good.select("id", "channel_name", "frame_number", "offset", "invert", F.size("cvflags").alias("flags"), "pattern_spacing", "spacing_units", F.when(F.col("image_points").isNotNull(), F.size("image_points")).alias("points"), total("x"), total("y"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rejects, allowMissingColumns=True)


@query("set04_calibration_coverage", "WITH p AS (SELECT l_partkey AS id, l_quantity * 12.5 AS x, l_discount * 4000 AS y FROM lineitem WHERE l_partkey % 10 <> 0 AND l_partkey % 11 <> 0) SELECT floor(x * 8 / 640)::INTEGER AS cx, floor(y * 6 / 480)::INTEGER AS cy, count(*) AS points, count(DISTINCT id) AS images FROM p WHERE x < 640 AND y < 480 GROUP BY ALL")
def calibration_coverage(spark, d):
    """Images appended to those of odd ids, and what all their points cover of the picture."""
    good, _ = src.read_images(cut(_spoilt(src.write_images(_images(spark, d))), "image-texts"))
    return src.coverage(src.appended(good.where("id % 2 = 1"), good), 640, 480, 8, 6)


@query("pred11_near_plane", f"""{cam._SLOPES.split(", f AS")[0]}, w AS (SELECT s_suppkey AS facet, 0.5::DOUBLE + s_suppkey / 500.0::DOUBLE AS h FROM supplier), h AS (SELECT p.image, p.ix, p.iy, w.facet, w.h / abs(sy) AS z FROM p, w WHERE -sy < -1e-9 AND w.h / abs(sy) <= 4 + w.facet % 5),
m AS (SELECT image, ix, iy, arg_min(facet, z) AS facet, min(z) AS z FROM h GROUP BY ALL) SELECT p.image, p.ix, p.iy, facet, round(z * sqrt(1 + sx * sx + sy * sy), 6) AS dist FROM p LEFT JOIN m USING (image, ix, iy)""")
def near_plane(spark, d):
    """Floors under the camera, wide strips from behind it to some depth in front: one below the other, the nearest is seen."""
    pixels = fx.pixels(spark, d).withColumnRenamed("shot", "image")
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("facet"), (-(0.5 + F.col("s_suppkey") / 500.0)).alias("y"), (-(4.0 + F.col("s_suppkey") % 5)).alias("far"))
    corner = lambda x, z: F.struct(F.lit(float(x)).alias("x"), F.col("y").alias("y"), z.alias("z"))
    ring = F.array(corner(-50, F.lit(5.0)), corner(50, F.lit(5.0)), corner(50, F.col("far")), corner(-50, F.col("far")))
    faces = f.crossJoin(F.broadcast(pixels.select("image").distinct())).select("image", "facet", ring.alias("ring"), F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(0.0).alias("nz"))  # four images
    hits = camera.pinhole_hits(pixels, faces, cam.FOCAL, cam.CENTRE, 4)
    return hits.select("image", "ix", "iy", "facet", R("dist").alias("dist"))
