"""Binary files in ranges, leaders along chains and growth from seeds, against plain loops and on odd input."""

import itertools
import math
import random

import numpy as np

from facetflow.operators import mesh
from facetflow.sources import stl


def binary(n, rng, extra=b""):
    r = np.zeros(n, stl._RECORD)
    r["n"], r["v"] = rng.normal(size=(n, 3)), rng.normal(size=(n, 3, 3))
    return b"solid of bytes".ljust(80) + np.array([n], "<u4").tobytes() + r.tobytes() + extra, r


def test_binary_stl_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for name, n in (("a.stl", 2503), ("b.STL", 1), ("none.stl", 0), ("deep/c.stl", 1000)):
        data, r = binary(n, rng)
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
        want[name.lower()] = r
    (tmp_path / "long.stl").write_bytes(binary(5, rng, b"x")[0])
    (tmp_path / "short.stl").write_bytes(b"solid")
    (tmp_path / "other.txt").write_bytes(binary(5, rng)[0])
    df = stl.read_stl_binary(spark, str(tmp_path), 2.0, 100)
    assert df.rdd.getNumPartitions() == 26 + 1 + 10
    got = {}
    for x in df.collect():
        got.setdefault(x.mesh.lower()[len(str(tmp_path)) + 1 :], {})[x.facet, x.k] = (x.x, x.y, x.z, x.nx, x.ny, x.nz)
    assert {k: len(v) for k, v in got.items()} == {k: 3 * len(r) for k, r in want.items() if len(r)}
    for name, rows in got.items():
        r = want[name]
        for (facet, k), numbers in rows.items():
            assert np.allclose(numbers, [*(2.0 * r["v"][facet, k].astype(float)), *r["n"][facet].astype(float)])
    whole = {(x.facet, x.k, x.x, x.nz) for x in stl.read_stl(spark, str(tmp_path / "a.stl"), 2.0).collect()}
    assert whole == {(x.facet, x.k, x.x, x.nz) for x in stl.read_stl_binary(spark, str(tmp_path / "a.stl"), 2.0, 999).collect()}
    assert stl.read_stl_binary(spark, str(tmp_path / "none.stl")).count() == 0


def test_binary_stl_written_and_read(spark, tmp_path):
    rng = random.Random(2)
    rows = [(m, f, k, rng.random(), float(k), float(f), 0.0, 0.0, 1.0) for m in (1, 2) for f in range(20) for k in range(3)]
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "mesh long, facet long, k int, x double, y double, z double, nx double, ny double, nz double")
    files = stl.write_stl_binary(t, str(tmp_path / "out"), 3).collect()
    assert sum(f.n for f in files) == 40 and len(list((tmp_path / "out").glob("*.stl"))) == len(files)
    back = stl.read_stl_binary(spark, str(tmp_path / "out"), 1.0, 4).collect()
    assert sorted((round(r.x, 5), r.y, r.z, r.nz) for r in back) == sorted((round(r[3], 5), r[4], r[5], r[8]) for r in rows)


def leaders(points, tolerance):
    led, out = [], {}
    for i, *p in sorted(points):
        near = [j for j, q in led if sum((a - b) ** 2 for a, b in zip(p, q)) <= tolerance * tolerance]
        if near:
            out[i] = min(near)
        else:
            led.append((i, p))
            out[i] = i
    return out


def test_leaders_of_clouds_and_borders(spark):
    rng = random.Random(3)
    points = [(i, *(rng.choice((rng.random(), round(rng.random(), 1))) - 0.5 for _ in range(3))) for i in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(points + [(7001, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    for tolerance, tile in ((0.1, 2), (0.1, 64), (0.02, 3)):
        first = {}
        for i, *p in sorted(points):
            first.setdefault(tuple(p), i)
        want = leaders([(i, *p) for p, i in first.items()], tolerance)
        got = {r.id: r.leader for r in mesh.merge_close(df, tolerance, tile).collect()}
        assert got == {i: want[first[tuple(p)]] for i, *p in points}
    assert mesh.merge_close(df.limit(0), 0.1).count() == 0


def test_a_chain_of_ten_thousand_points_settles(spark):
    """Each point is near the one before only: every other one leads."""
    df = spark.range(10_000).selectExpr("id", "id * 0.9 as x", "0.0 as y", "0.0 as z")
    got = {r.id: r.leader for r in mesh.merge_close(df, 1.0, 2048).collect()}
    assert got == {i: i - i % 2 for i in range(10_000)}


def plain_growth(pairs, normals, angle):
    near = {f: set() for f in normals}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    surface = {}
    for seed in sorted(normals):
        if seed in surface:
            continue
        surface[seed], todo = seed, [seed]
        while todo:
            for o in near[todo.pop()] - set(surface):
                if normals[seed] is not None and normals[o] is not None and np.dot(normals[seed], normals[o]) > math.cos(angle):
                    surface[o] = seed
                    todo.append(o)
    return surface


def test_growth_from_seeds(spark):
    """Meshes of random adjacency: facets are rings of edges that they share, normals random, some missing."""
    rng = np.random.default_rng(4)
    corners, normals, want = [], [], {}
    for m in (1, 2):
        pairs = {tuple(sorted(p)) for p in rng.integers(0, 40, (70, 2)).tolist() if p[0] != p[1]} - {(38, 39)}
        unit = {}
        for f in range(42):
            n = rng.normal(size=3) * (0.6, 0.6, 1.0) + (0, 0, 0.8)
            unit[f] = n / np.linalg.norm(n) if f % 13 else None
            ring = [int(v) for p, v in itertools.chain(((p, 1000 + 2 * i) for i, p in enumerate(sorted(pairs)) if f in p))]
            ids = [x for v in ring for x in (v, v + 1, 5000 + 100 * f + len(ring) + v)] or [f * 3 + 9000, f * 3 + 9001, f * 3 + 9002]
            corners += [(m, f, k, v) for k, v in enumerate(ids)]
            normals.append((m, f, *(map(float, unit[f]) if unit[f] is not None else (None,) * 3)))
        for f, s in plain_growth(pairs, unit, 0.9).items():
            want[m, f] = s
    c = spark.createDataFrame(corners, "mesh long, facet long, k int, vid long")
    n = spark.createDataFrame(normals, "mesh long, facet long, nx double, ny double, nz double")
    assert {(r.mesh, r.facet): r.surface for r in mesh.grown_segments(c, n, 0.9).collect()} == want
    assert len(set(want.values())) > 5 and mesh.grown_segments(c.limit(0), n.limit(0), 0.9).count() == 0
