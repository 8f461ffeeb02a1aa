"""X3D with nested transforms and reuse, odd calibration records, frame circles, curvature of a sphere, pixel hits against brute force."""

import numpy as np
import pytest

from facetflow.operators import camera, frames
from facetflow.operators.curvature import principal
from facetflow.sources import calibration, x3d

NESTED = """<X3D xmlns="http://www.web3d.org/specifications/x3d-3.0.xsd"><Scene>
<Transform translation="1 0 0" rotation="0 0 1 1.5707963267948966"><Transform scale="2 3 4">
<Shape DEF="one"><Appearance><ImageTexture url="#skin"/></Appearance><IndexedFaceSet coordIndex="0, 1 2">
<Coordinate DEF="points" point="1 0 0, 0 1 0, 0 0 1"/><TextureCoordinate point="0 0 1 0 1 1"/></IndexedFaceSet></Shape></Transform></Transform>
<Shape><IndexedFaceSet coordIndex="2 1 0 -1 0 1 2 -1"><Coordinate USE="points"/></IndexedFaceSet></Shape></Scene></X3D>"""


def test_x3d_transforms_and_reuse(spark):
    docs = spark.createDataFrame([("a", NESTED), ("none", None), ("empty", "<X3D/>")], "doc string, text string")
    found = x3d.shapes(docs)
    rows = sorted(found.collect(), key=lambda r: r["shape"])
    assert [(r["doc"], r["shape"], r["name"], r["texture"], r["uv"]) for r in rows] == [("a", 0, "one", "#skin", "0 0 1 0 1 1"), ("a", 1, None, None, None)]
    got = {(r["mesh"]["shape"], r["vid"]): (r["x"], r["y"], r["z"]) for r in x3d.vertices(found).collect()}
    want = {(0, 0): (1, 2, 0), (0, 1): (-2, 0, 0), (0, 2): (1, 0, 4), (1, 0): (1, 0, 0), (1, 1): (0, 1, 0), (1, 2): (0, 0, 1)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    index = {r["mesh"]["shape"]: r["index"] for r in x3d.packed(found).collect()}
    assert index == {0: [0, 1, 2], 1: [2, 1, 0, -1, 0, 1, 2, -1]}


def test_odd_calibration_records(spark):
    whole = "<c:r xmlns:c='urn:c'><c:sizex>4</c:sizex><c:sizey>3</c:sizey><c:cameramatrix><c:arraydata> 1 0 2\n 0 1 2 0 0 1 </c:arraydata></c:cameramatrix><c:distcoeffs><c:arraydata>-.2 .1 0 0 0</c:arraydata></c:distcoeffs></c:r>"
    texts = [(1, whole), (2, None), (3, "<r><sizex>4</sizex>"), (4, whole.replace("-.2", "x")), (5, "")]
    got = {r["id"]: r for r in calibration.read_intrinsics(spark.createDataFrame(texts, "id int, text string")).collect()}
    assert {i: r["ok"] for i, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert got[1]["k"] == [1, 0, 2, 0, 1, 2, 0, 0, 1] and got[1]["dist"] == [-0.2, 0.1, 0, 0, 0]


def test_frames_in_a_circle_ambiguous_and_apart(spark):
    m = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    schema = "frame string, parent string, m array<double>"
    rooted = frames.to_root(spark.createDataFrame([("a", "b", m(1.0)), ("a", "c", m(9.0)), ("b", "r", m(2.0)), ("z", "y", m(3.0))], schema))
    got = {r["frame"]: (r["root"], r["m"][3], r["ambiguous"]) for r in rooted.collect()}
    assert got == {"a": ("r", 3.0, True), "b": ("r", 2.0, False), "r": ("r", 0.0, False), "c": ("c", 0.0, False), "z": ("y", 3.0, False), "y": ("y", 0.0, False)}
    pairs = spark.createDataFrame([("a", "b"), ("r", "a"), ("a", "z"), ("a", "nowhere")], "src string, dst string")
    assert {(r["src"], r["dst"]): r["m"] and r["m"][3] for r in frames.between(pairs, rooted).collect()} == {("a", "b"): 1.0, ("r", "a"): -3.0, ("a", "z"): None, ("a", "nowhere"): None}
    with pytest.raises(ValueError):
        frames.to_root(spark.createDataFrame([("a", "b", m(1.0)), ("b", "a", m(1.0))], schema))


def test_curvature_of_a_sphere():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(30, 3)) * 0.05
    p[:, 2] = np.sqrt(4 - p[:, 0] ** 2 - p[:, 1] ** 2) - 2
    assert np.allclose(principal(np.array([0, 0, 3.0]), p), -0.5, atol=1e-3)


def test_pixel_hits_are_those_of_brute_force(spark):
    """Tilted triangles, one reaching behind the camera, against every ray and facet."""
    rng = np.random.default_rng(9)
    tri = rng.uniform(-2, 2, (40, 3, 3)) + [0, 0, -4]
    tri[0] = [[-1.1, -0.9, 1], [1.2, -0.8, 1], [0.1, 0.7, -6]]
    normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    normal /= np.linalg.norm(normal, axis=1)[:, None]
    rows = [("i", k, [tuple(map(float, q)) for q in t], *map(float, n)) for k, (t, n) in enumerate(zip(tri, normal))]
    faces = spark.createDataFrame(rows, "image string, facet int, ring array<struct<x:double,y:double,z:double>>, nx double, ny double, nz double")
    pixels = spark.createDataFrame([("i", x, y) for x in range(20) for y in range(16)], "image string, ix int, iy int")
    want = {}
    for x in range(20):
        for y in range(16):
            d = np.array([(x - 9.3) / 12, -(y - 7.6) / 13, -1.0])
            d /= np.linalg.norm(d)
            for k, (t, n) in enumerate(zip(tri, normal)):
                s = (n @ t[0]) / (n @ d)
                inside = [np.cross(t[(i + 1) % 3] - t[i], s * d - t[i]) @ n for i in range(3)]
                if s > 0 and min(inside) > 0 and s < want.get((x, y), (np.inf,))[0]:
                    want[x, y] = (s, k)
    got = {(r["ix"], r["iy"]): (r["dist"], r["facet"]) for r in camera.pinhole_hits(pixels, faces, (12.0, 13.0), (9.3, 7.6)).collect()}
    assert len(got) == 320 and {p for p, h in got.items() if h[1] is not None} == set(want)
    assert all(got[p][1] == k and np.isclose(got[p][0], s) for p, (s, k) in want.items()) and 0 in {k for _, k in want.values()}
