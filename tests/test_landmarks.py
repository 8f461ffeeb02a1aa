"""Landmarks, calibration images and clipped rings on odd input."""

import random

from pyspark.sql import functions as F

from facetflow.functions import predicates
from facetflow.operators import landmarks
from facetflow.sources import calibration_images as src

FLAT, SOLID = "mesh long, name string, u double, v double", "mesh long, name string, x double, y double, z double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_landmarks_in_space_take_names_over(spark):
    flat = spark.createDataFrame([(1, "a", 0.1, 0.2), (1, "b", 0.3, 0.4), (1, "b", 0.2, 0.9), (2, "a", 0.5, 0.5), (None, "a", 0.0, 0.0), (1, None, 0.0, 0.0)], FLAT)
    solid = spark.createDataFrame([(1, "c", 1.0, 1.0, 1.0), (1, "d", 2.0, 2.0, 2.0)], SOLID)
    new = spark.createDataFrame([(1, "a", 9.0, 9.0, 9.0), (1, "a", 8.0, 9.0, 9.0), (1, "c", 7.0, 7.0, 7.0), (None, "b", 1.0, 1.0, 1.0)], SOLID)
    f, s = landmarks.upsert(flat, solid, new)
    assert rows(f) == [(1, "b", 0.2, 0.9), (2, "a", 0.5, 0.5)]
    assert rows(s) == [(1, "a", 8.0, 9.0, 9.0), (1, "c", 7.0, 7.0, 7.0), (1, "d", 2.0, 2.0, 2.0)]
    f, s = landmarks.upsert(flat.limit(0), solid.limit(0), new.limit(0))
    assert f.count() == s.count() == 0
    asked = spark.createDataFrame([(1, "b"), (1, "c"), (1, "q"), (1, "b"), (None, "a")], "mesh long, name string")
    assert rows(landmarks.present(asked, flat, solid)) == sorted([(1, "b", "2d"), (1, "c", "3d"), (1, "q", None), (None, "a", None)], key=repr)
    turn = spark.createDataFrame([(1, *map(float, (0, -1, 0, 5, 1, 0, 0, 6, 0, 0, 1, 7)))], "mesh long, " + ", ".join(f"{m} double" for m in landmarks.MATRIX))
    both = solid.unionByName(spark.createDataFrame([(2, "e", 1.0, 1.0, 1.0)], SOLID)).withColumn("m", F.lit(3))
    assert rows(landmarks.in_frame(both, turn)) == [(1, "c", 4.0, 7.0, 8.0, 3), (1, "d", 3.0, 8.0, 9.0, 3), (2, "e", None, None, None, 3)]


PREFIXED = """<snci:calibration_image xmlns:snci="urn:a" xmlns:xlink="urn:b"><snci:calibration_image_params><snci:input xlink:href="x.dgs"/><snci:offset>1.5</snci:offset>{}
<snci:invert> Yes </snci:invert><snci:pattern_num_x> 7 </snci:pattern_num_x></snci:calibration_image_params>{}<snci:image_points_timestamp>now</snci:image_points_timestamp></snci:calibration_image>"""
POINTS = "<snci:object_points><a:arrayshape xmlns:a='urn:c'>2 3</a:arrayshape><a:arraydata xmlns:a='urn:c'>0 0 0\n1 0 0</a:arraydata></snci:object_points><snci:image_points><arrayshape>2 1 2</arrayshape><arraydata>{}</arraydata></snci:image_points>"


def test_calibration_images_that_cannot_be_read(spark):
    texts = {
        "good": PREFIXED.format("", POINTS.format("1 2 3 4")), "none": None, "broken": "<a", "other": "<b/>", "empty": PREFIXED.format("", ""),
        "tag": PREFIXED.format("<snci:mirror/>", ""), "number": PREFIXED.format("<snci:frame_number>first</snci:frame_number>", ""), "flag": PREFIXED.format("<snci:cvflags>CALIB_CB_FAST_CHECK|NO</snci:cvflags>", ""),
        "pairs": PREFIXED.format("", POINTS.format("1 2 3")), "word": PREFIXED.format("", POINTS.format("1 2 3 x")), "few": PREFIXED.format("", POINTS.format("1 2")),
    }
    good, bad = src.read_images(spark.createDataFrame(list(texts.items()), "id string, text string"))
    got = {r.id: r for r in good.collect()}
    assert set(got) == {"good", "empty"} and got["empty"].image_points is None and got["empty"].cvflags == []
    g = got["good"]
    assert (g.input, g.offset, g.invert, g.pattern_num_x, g.frame_number, g.at) == ("x.dgs", 1.5, True, 7, None, "now")
    assert [tuple(p) for p in g.image_points] == [(1, 2), (3, 4)] and [tuple(p) for p in g.object_points] == [(0, 0, 0), (1, 0, 0)]
    assert {r.id: r.reason.split(":")[0] for r in bad.collect()} == {
        "none": "no calibration image", "broken": "no calibration image", "other": "no calibration image", "tag": "unknown parameter", "number": "not a number", "flag": "unknown flag",
        "pairs": "image points are no pairs", "word": "image points are no pairs", "few": "as many object points as image points are needed",
    }
    back, none = src.read_images(src.write_images(good))
    assert rows(back) == rows(good) and none.count() == 0
    assert rows(src.appended(good.where("id = 'good'"), good).select("id")) == [("empty",), ("good",)]
    assert rows(src.coverage(good, 4, 5, 2, 1)) == [(0, 0, 1, 1), (1, 0, 1, 1)] and src.coverage(good.limit(0), 4, 5, 2, 1).count() == 0


def plain_clip(ring, near):
    out = []
    for a, b in zip(ring, ring[1:] + ring[:1]):
        t = (-near - a[2]) / (b[2] - a[2]) if b[2] != a[2] else None
        cross = t is not None and (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]), -near)
        first, second = a[2] <= -near, b[2] <= -near
        out += [a, cross] if first and not second else [a] if first else [cross] if second else []
    return out


def test_rings_clipped_in_front_of_the_camera(spark):
    rng = random.Random(3)
    rings = [[tuple(rng.choice((rng.uniform(-2, 2), float(rng.randrange(-1, 2)))) for _ in range(3)) for _ in range(rng.randrange(3, 6))] for _ in range(60)] + [[(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (0.0, 1.0, 2.0)]]
    df = spark.createDataFrame(list(enumerate(rings)), "id int, ring array<struct<x:double,y:double,z:double>>")
    for r in df.select("id", predicates.clip_front(F.col("ring"), F.lit(0.25)).alias("c")).collect():
        want = plain_clip(rings[r.id], 0.25)
        assert len(want) == len(r.c) and all(abs(x - y) < 1e-9 for p, q in zip(r.c, want) for x, y in zip(p, q))


def test_products_of_pixels_on_tilted_facets(spark):
    """Texture coordinates and their changes, and that of z, against rays met with the plane one by one."""
    import numpy as np

    from facetflow.operators import camera, uv

    f, c = (12.0, 13.0), (4.2, 3.8)
    corners = np.array([(-1.0, -1.0, -3.0), (1.2, -0.9, -4.0), (1.1, 1.0, -4.4), (-1.1, 0.9, -3.4)])
    corners[3] = corners[0] + corners[2] - corners[1]  # planar
    tex = np.array([(0.1, 0.1), (0.7, 0.2), (0.8, 0.9), (0.2, 0.8)])
    ring = spark.createDataFrame([(1, 0, k, *map(float, (*p, *q))) for k, (p, q) in enumerate(zip(corners, tex))], "mesh long, facet long, k int, x double, y double, z double, u double, v double")
    n = np.cross(corners[1] - corners[0], corners[2] - corners[1])
    n /= np.linalg.norm(n)
    faces = spark.createDataFrame([("i", 0, [tuple(map(float, p)) for p in corners], *map(float, n))], "image string, facet long, ring array<struct<x:double,y:double,z:double>>, nx double, ny double, nz double")
    pixels = spark.createDataFrame([("i", x, y) for x in range(9) for y in range(8)], "image string, ix int, iy int")
    hits = camera.pinhole_hits(pixels, faces, f, c).withColumn("mesh", F.lit(1).cast("long"))
    got = camera.pixel_products(hits, uv.frames(ring), f, c).collect()
    assert len(got) == hits.where("facet is not null").count() > 10
    fit = np.linalg.lstsq(np.hstack((corners[:, :2], np.ones((4, 1)))), tex, rcond=None)[0]  # x, y tell a place of the plane

    def meet(x, y):
        ray = np.array([(x - c[0]) / f[0], -(y - c[1]) / f[1], -1.0])
        p = ray * (n @ corners[0]) / (n @ ray)
        return np.array([p[0], p[1], 1]) @ fit, p[2]

    for r in got:
        (u, v), z = meet(r.ix, r.iy)
        (uh, vh), zh = meet(r.ix + 1, r.iy)
        (uv_, vv), zv = meet(r.ix, r.iy + 1)
        want = (u, v, uh - u, vh - v, zh - z, uv_ - u, vv - v, zv - z)
        assert np.allclose((r.u, r.v, r.du_h, r.dv_h, r.dz_h, r.du_v, r.dv_v, r.dz_v), want, atol=1e-9)
    assert camera.pixel_products(hits.limit(0), uv.frames(ring), f, c).count() == 0
