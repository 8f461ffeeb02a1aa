"""Curvature of all vertices against least squares, tensors and line sums against plain loops, and odd input."""

import math

import numpy as np
import pytest

from facetflow.operators import curvature, tensors, uv

N = 7


def patch(spark, heights, mesh_id=1):
    """A grid of N x N vertices over the plane, quads between them."""
    points = {j * N + i: (i * 0.1, j * 0.1, heights(i * 0.1, j * 0.1)) for i in range(N) for j in range(N)}
    v = spark.createDataFrame([(mesh_id, k, *map(float, p)) for k, p in points.items()], "mesh long, vid long, x double, y double, z double")
    c = spark.createDataFrame([(mesh_id, j * (N - 1) + i, k, j * N + i + o) for i in range(N - 1) for j in range(N - 1) for k, o in enumerate((0, 1, N + 1, N))], "mesh long, facet long, k int, vid long")
    return points, v, c


def least_squares(points, vid):
    """The curvatures of a vertex by the surface of powers up to two each way that fits the points within two edges."""
    near = lambda a: [b for b in points if abs(a % N - b % N) + abs(a // N - b // N) == 1]
    ring = {b for a in near(vid) for b in [a, *near(a)]} - {vid}
    p = {k: np.array(q) for k, q in points.items()}
    n = np.zeros(3)
    for di, dj in ((0, 0), (-1, 0), (0, -1), (-1, -1)):
        i, j = vid % N + di, vid // N + dj
        if 0 <= i < N - 1 and 0 <= j < N - 1:
            face = [j * N + i, j * N + i + 1, (j + 1) * N + i + 1, (j + 1) * N + i]
            at = face.index(vid)
            n += np.cross(p[face[(at + 1) % 4]] - p[vid], p[face[at - 1]] - p[vid])
    n /= np.linalg.norm(n)
    a = np.cross(n, np.eye(3)[np.argmin(np.abs(n))])
    a /= np.linalg.norm(a)
    x, y, z = np.array([(0, 0, 0)] + [((p[k] - p[vid]) @ a, (p[k] - p[vid]) @ np.cross(n, a), (p[k] - p[vid]) @ n) for k in ring]).T
    s = max(np.abs(x).max(), np.abs(y).max())
    design = np.stack([(x / s) ** i * (y / s) ** j for i in range(3) for j in range(3)], 1)
    c, _, rank, _ = np.linalg.lstsq(design, z / s, rcond=1e-6)
    zx, zy, zxx, zxy, zyy = c[3], c[1], 2 * c[6], c[4], 2 * c[2]
    shape = np.linalg.solve([[1 + zx * zx, zx * zy], [zx * zy, 1 + zy * zy]], [[zxx, zxy], [zxy, zyy]]) / math.sqrt(1 + zx * zx + zy * zy) / s
    k = np.linalg.eigvals(shape).real
    return k.max(), k.min(), rank


def test_curvature_of_all_vertices(spark):
    points, v, c = patch(spark, lambda x, y: 0.4 * math.sin(3 * x) * math.cos(2 * y) + x * y)
    got = {r.vid: (r.k1, r.k2) for r in curvature.vertex_curvature(v, c).collect()}
    assert len(got) == N * N
    for vid in points:
        k1, k2, rank = least_squares(points, vid)
        if rank == 9:
            assert got[vid] == pytest.approx((k1, k2), rel=1e-5, abs=1e-6)
        assert got[vid][0] >= got[vid][1]
    ball, v, c = patch(spark, lambda x, y: math.sqrt(9 - (x - 0.3) ** 2 - (y - 0.3) ** 2))
    inner = [r for r in curvature.vertex_curvature(v, c).collect() if 2 <= r.vid % N <= 4 and 2 <= r.vid // N <= 4]
    assert all(r.k1 == pytest.approx(-1 / 3, abs=2e-3) and r.k2 == pytest.approx(-1 / 3, abs=2e-3) for r in inner) and inner


def test_curvature_where_there_is_none(spark):
    _, v, c = patch(spark, lambda x, y: 0.0)
    alone = v.unionByName(spark.createDataFrame([(1, 999, 0.0, 0.0, 0.0), (2, 0, 1.0, 1.0, 1.0)], v.schema))
    got = {(r.mesh, r.vid): (r.k1, r.k2) for r in curvature.vertex_curvature(alone, c).collect()}
    assert got[1, 999] == got[2, 0] == (None, None) and got[1, 24] == pytest.approx((0, 0))
    wanted = spark.createDataFrame([(1, 24), (1, 24), (1, 999)], "mesh long, vid long")
    assert sorted(r.vid for r in curvature.vertex_curvature(alone, c, wanted).collect()) == [24, 999]
    line = spark.createDataFrame([(3, k, float(k), 0.0, 0.0) for k in range(3)], v.schema)
    flat = spark.createDataFrame([(3, 0, k, k) for k in range(3)], c.schema)
    assert {(r.k1, r.k2) for r in curvature.vertex_curvature(line, flat).collect()} == {(None, None)}
    assert curvature.vertex_curvature(v.limit(0), c.limit(0)).count() == 0


def test_tensor_of_a_turned_frame(spark):
    """A cylinder's tangents at 30 degrees in the face: the shape operator has its curvatures as eigenvalues, whatever the texture's stretch."""
    a = math.pi / 6
    ring = spark.createDataFrame([(1, 0, k, k, float(x), float(y), 0.0, u, v) for k, (x, y, u, v) in enumerate(((0, 0, 0.1, 0.1), (4, 0, 0.9, 0.2), (4, 2, 0.8, 0.7), (0, 2, 0.0, 0.6)))], "mesh long, facet long, k int, vid long, x double, y double, z double, u double, v double")
    bent = spark.createDataFrame([(1, k, 0.5, 0.0, math.cos(a), math.sin(a), 0.0, -math.sin(a), math.cos(a), 7.0) for k in range(4)], "mesh long, vid long, k1 double, k2 double, ax double, ay double, az double, bx double, by double, bz double")
    frames = uv.frames(ring)
    points = spark.createDataFrame([(1, 0, "p", 0.4, 0.4), (1, 5, "nowhere", 0.4, 0.4)], "mesh long, facet long, id string, u double, v double")
    (r,) = tensors.texture_tensors(points, tensors.corner_tensors(ring, bent, frames), frames).collect()
    assert sorted(np.linalg.eigvals([[r.c11, r.c12], [r.c21, r.c22]]).real) == pytest.approx([0.0, 0.5], abs=1e-9)
    missing = tensors.corner_tensors(ring, bent.where("vid > 0"), frames)
    (r,) = tensors.texture_tensors(points, missing, frames).collect()
    assert r.c11 is None and r.c22 is None
    leaves = uv.cells(uv.polygons(ring.select("mesh", "facet", "k", "u", "v")))
    lines = spark.createDataFrame([(1, 1, 0.3, 0.3, 0.6, 0.5), (1, 2, 0.3, 0.3, 0.3, 0.3), (1, 3, 0.3, 0.3, 2.0, 0.3), (1, 4, None, 0.3, 0.5, 0.5)], "mesh long, line int, u1 double, v1 double, u2 double, v2 double")
    got = {x.line: x for x in tensors.facet_line_curvature(lines, leaves, frames, tensors.corner_tensors(ring, bent, frames), 0.1, 0.1).collect()}
    assert sorted(got) == [1, 2, 3] and got[3].length is None and got[3].curvature is None
    assert (got[2].length, got[2].curvature, got[2].cross) == (0.0, pytest.approx(0.5), pytest.approx(0.0, abs=1e-9)) and got[1].length > 0
    lost = {x.line: x.curvature for x in tensors.facet_line_curvature(lines, leaves, frames, missing, 0.1, 0.1).collect()}
    assert lost == {1: None, 2: None, 3: None}


def test_lines_over_rasters(spark):
    raster = spark.createDataFrame([(i, j, 1.0 + i, 0.5, 0.25, 2.0 - j, 0.3, 0.2) for i in range(4) for j in range(4) if (i, j) != (2, 2)] + [(2, 2, None, 0.0, 0.0, 0.0, 1.0, 1.0)], "ix int, iy int, c11 double, c12 double, c21 double, c22 double, su double, sv double")
    lines = [("a", 0.05, 0.1, 0.45, 0.15), ("off", 0.9, 0.9, 1.93, 0.9), ("out", -3.0, -3.0, -2.0, -3.0), ("still", 0.1, 0.1, 0.1, 0.1), ("lost", 0.5, 0.5, 0.7, 0.7), ("null", None, 0.1, 0.2, 0.2)]
    df = spark.createDataFrame(lines, "line string, u1 double, v1 double, u2 double, v2 double")
    got = {r.line: r for r in tensors.raster_line_curvature(df, raster, 4, 4, 0.125, 0.125).collect()}
    assert set(got) == {"a", "off", "out", "still", "lost"} and got["lost"].length is None
    tensor = {(r.ix, r.iy): r for r in raster.collect()}
    for name, u1, v1, u2, v2 in lines[:3]:
        steps = 1 + int(math.hypot((u2 - u1) / 0.125, (v2 - v1) / 0.125))
        su, sv = (u2 - u1) / steps, (v2 - v1) / steps
        a, b = su / math.hypot(su, sv), sv / math.hypot(su, sv)
        length = bend = across = 0.0
        for k in range(steps):
            u, v = u1 + (k + 0.5) * su, v1 + (k + 0.5) * sv
            t = tensor.get((math.floor(u * 4), math.floor(v * 4))) if 0 <= u < 1 and 0 <= v < 1 else None
            d = math.hypot(t.su * su * 4, t.sv * sv * 4) if t else math.hypot(su, sv)
            length += d
            if t:
                m = np.array([[t.c11, t.c12], [t.c21, t.c22]])
                bend += d * np.array([a, b]) @ m @ np.array([a, b])
                across += d * np.array([b, -a]) @ m @ np.array([b, -a])
        r = got[name]
        assert (r.steps, r.length, r.curvature, r.cross, r.theta) == (steps, pytest.approx(length), pytest.approx(bend / length), pytest.approx(across / length), pytest.approx(math.atan2(v2 - v1, u2 - u1)))
    k = np.linalg.eigvals([[1.0, 0.5], [0.25, 2.0]]).real
    assert (got["still"].length, got["still"].curvature, got["still"].cross) == (0.0, pytest.approx(k.max()), pytest.approx(k.min()))
    mirrored = {r.line: r for r in tensors.mirrored_line_curvature(df.where("line in ('a', 'off')"), raster, 4, 4, 0.125, 0.125).collect()}
    assert mirrored["a"].curvature == pytest.approx(got["a"].curvature) and mirrored["off"].curvature != pytest.approx(got["off"].curvature)
    assert tensors.raster_line_curvature(df.limit(0), raster, 4, 4, 0.1, 0.1).count() == 0


