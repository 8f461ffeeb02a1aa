"""What grows with the input is neither sent whole through the driver nor left to a few tasks."""

import os

import pytest
from pyspark.sql import functions as F

from facetflow.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DEALT = "agg04_centroid_radius agg05_normals agg32_mesh_centre join09_corner_points pred04_polygon_hits_box3 pred08_vertices_in_box set02_two_hop_set src05_mesh_from_arrays vec17_uv_to_xyz vec19_step_sizes".split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", DEALT)
def test_no_made_table_is_broadcast(spark, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, SF))


def test_leaves_and_components_are_dealt(spark):
    from facetflow.operators import graph, uv

    e = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    pairs = e.select(F.col("a").alias("node"), F.col("b").alias("other"))
    assert "Broadcast" not in plan(graph._star(pairs, True)) + plan(graph._star(pairs, False))
    points = spark.createDataFrame([(0, 1, 0.5, 0.5)], "mesh int, id int, u double, v double")
    corners = spark.createDataFrame([(0, 7, k, float(k in (1, 2)), float(k in (2, 3))) for k in range(4)], "mesh int, facet int, k int, u double, v double")
    out = uv.locate(points, uv.cells(uv.polygons(corners)))
    assert out.first().facet == 7 and "Broadcast" not in plan(out)


def test_facets_stay_while_pixels_are_few(spark, monkeypatch):
    from facetflow.operators import camera

    seen = []
    for sent in (camera.SENT, 0):
        monkeypatch.setattr(camera, "SENT", sent)
        out = registry.QUERIES["join05_pinhole_hits"](spark, SF)
        text = plan(out)
        seen.append((sorted(map(tuple, out.collect()), key=repr), text))
    assert seen[0][0] == seen[1][0]
    assert "BuildLeft" in seen[0][1] and seen[1][1].count("BroadcastHashJoin") == 1  # the extents, a row an image


def test_equal_rays_and_equal_faces_meet_once(spark):
    from facetflow.operators.project import nearest_hits

    rays = spark.range(40).select("id", (F.col("id") % 2 / 2.0 + 0.1).alias("u"), F.lit(0.1).alias("v")).unionByName(spark.createDataFrame([(99, None, 0.1)], "id long, u double, v double"))
    faces = spark.range(30).select(F.col("id").alias("facet"), F.lit(0.0).alias("u0"), F.lit(0.2).alias("u1"), F.lit(0.0).alias("v0"), F.lit(0.2).alias("v1"), (5.0 - F.col("id") % 3).alias("dist"))
    out = nearest_hits(rays, faces, 4)
    assert {tuple(r) for r in out.collect()} == {(i, None if i % 2 else 2, None if i % 2 else 3.0) for i in range(40)} | {(99, None, None)}
    join = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    below = out._jdf.queryExecution().optimizedPlan().toString().split(join)[1]
    assert below.count("Aggregate [") == 2  # of rays and of faces, before they meet


@pytest.mark.parametrize("name", ["win06_first_facet", "top01_nearest_vertex", "join17_vertex_neighbours"])
def test_boxes_are_dealt_before_they_multiply(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert f"REPARTITION_BY_NUM" in text and f", {n})" in text and text.rindex("Exchange") > text.rindex("Generate")


@pytest.mark.parametrize("name", ["agg15_raster_line_curvature", "agg16_mirrored_line_curvature"])
def test_steps_of_lines_stay(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a raster that is made from a large table
    try:
        text = plan(registry.QUERIES[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [ix" in text and "hashpartitioning(ix" not in text[: text.index("BroadcastHashJoin [ix")]


def test_a_batch_of_the_live_graph_is_many_files(spark, monkeypatch):
    from facetflow.plans import live_queries as q

    seen = {}
    monkeypatch.setattr(q.op, "live_source", lambda spark, path, schema, files=1: seen.update(read=spark.read.parquet(path), files=files))
    q._stream(spark, spark.range(1000), "many", 3)
    tasks = spark.sparkContext.defaultParallelism
    assert seen["files"] == tasks and len(seen["read"].inputFiles()) == 3 * tasks and seen["read"].count() == 1000


def test_a_chain_meets_only_what_is_referred_to(spark, monkeypatch):
    from facetflow.operators import metadata

    met = []
    monkeypatch.setattr(metadata, "cut", lambda df, name: met.append(df) or df)
    refs = spark.range(100).select(F.concat(F.lit("O"), "id").alias("channel"), F.lit("C").alias("target"), F.lit("o.").alias("prefix"))
    refs = refs.unionByName(spark.createDataFrame([("C", "P", "c.")], "channel string, target string, prefix string"))
    out = metadata.reference_chain(refs)
    assert {tuple(r) for r in out.where("channel <> 'C'").collect()} == {(f"O{i}", "P", "o.c.") for i in range(100)} and out.where("channel = 'C'").first().prefix == "c."
    assert "LeftSemi" in met[0]._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_a_tile_pass_by_in_batches():
    """Two tiles, a point whose pairs stand in several batches: the same points are decided as from one batch, and none waits for a whole tile."""
    import numpy as np
    import pandas as pd

    from facetflow.operators import mesh

    rng = np.random.default_rng(5)
    at = {t: rng.uniform(0, 4, 60) for t in (0, 1)}
    rows = [(t, 0, 0, 100 * t + i, 100 * t + j, None) for t in at for i in range(60) for j in range(i) if abs(at[t][i] - at[t][j]) <= 0.5]
    rows = [(*r[:5], 1.0 if not any(q[3] == r[4] for q in rows) else None) for r in rows]
    pairs = pd.DataFrame(rows, columns=["tx", "ty", "tz", "id", "other", "known"])
    left = {i for i in pairs.id}
    want = {}
    for i in sorted(left):
        near = [want.get(o, k) for o, k in zip(pairs.other[pairs.id == i], pairs.known[pairs.id == i])]
        want[i] = 0 if 1 in near else 1
    read = []

    def frames(size):
        for k in range(0, len(pairs), size):
            read.append(k)
            yield pairs[k : k + size].reset_index(drop=True)

    for size in (3, 7, len(pairs)):
        out, early = [], None
        for f in mesh._decided(["point", "known"])(frames(size)):
            out.append(f)
            early = early or (len(f) and max(read))
        assert dict(pd.concat(out).itertuples(index=False, name=None)) == want
        assert size == len(pairs) or early < len(pairs) // 2
        read.clear()


def test_no_group_of_pairs_is_made(spark, monkeypatch):
    from facetflow.operators import mesh

    seen, cut = [], mesh.cut
    monkeypatch.setattr(mesh, "cut", lambda df, name: seen.append((name, plan(df))) or cut(df, name))
    points = spark.range(300).select("id", (F.col("id") % 20 * 0.001).alias("x"), (F.col("id") % 50 * 0.02).alias("y"), F.lit(0.0).alias("z"))
    assert mesh.merge_close(points, 0.03).count() == 300
    rounds = [p for n, p in seen if n == "decided"][1:]
    assert rounds and all("MapInPandas" in p and "FlatMapGroups" not in p for p in rounds)


def test_binary_files_are_bounded_and_in_order(spark, tmp_path):
    """no task holds more than a file, whatever a range is; facets without a normal are written; parts may be numbered with gaps."""
    from facetflow.sources import stl

    rows = [(m, f, k, float(10 * m + f), float(k), 0.0, 0.0, 0.0, None if f == 3 else 1.0) for m in (2, 1) for f in range(20) for k in range(3)]
    t = spark.createDataFrame(rows, "mesh long, facet long, k int, x double, y double, z double, nx double, ny double, nz double")
    files = {r.file: r.n for r in stl.write_stl_binary(t, str(tmp_path / "out"), 1, 7).collect()}
    assert [files[f] for f in sorted(files)] == [7, 7, 7, 7, 7, 5]
    back = stl.read_stl_binary(spark, str(tmp_path / "out")).where("k = 0").orderBy("mesh", "facet").collect()
    assert [(r.x, r.nz) for r in back] == [(10.0 * m + f, 0.0 if f == 3 else 1.0) for m in (1, 2) for f in range(20)]
    part = spark.createDataFrame([(k, k % 5 + 1) for k in (3, 10, 500)], "p_partkey long, p_size int")
    part.write.parquet(str(tmp_path / "sf" / "part.parquet"))
    found = registry.QUERIES["src01_stl_binary"](spark, str(tmp_path / "sf")).collect()
    assert {(r.mesh, r.facet) for r in found} == {(m, f) for m in (3, 10, 500) for f in range(6)} and {r.cx for r in found if r.facet == 3} == {4.0, 1.0}


@pytest.mark.parametrize("name", "join01_space_cells join02_uv_cells join08_landmark_places join16_segments join19_grid_attributes src03_x3d_attributes src03_x3d_vertices vec13_hit_uv".split())
def test_no_step_broadcasts_a_made_table(spark, name):
    """nor do the steps that are written in between."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def ran() -> dict:
        bus.waitUntilEmpty()
        every = store.executionsList()
        return {e.executionId(): e.physicalPlanDescription() for e in (every.apply(i) for i in range(every.size()))}

    before = max(ran(), default=-1)
    registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    final = [text.split("== Initial Plan ==")[0] for i, text in ran().items() if i > before]
    assert any("SortMergeJoin" in t for t in final) and not any("BroadcastExchange" in t for t in final)


def test_a_mesh_is_written_to_one_text_file(spark, tmp_path):
    """facets dealt over many tasks came to lie in several files, which are several meshes to the reader."""
    from facetflow.sources import stl

    rows = [(m, f, k, float(m), float(f), float(k), 0.0, 0.0, 1.0) for m in range(6) for f in range(12) for k in range(3)]
    t = spark.createDataFrame(rows, "mesh long, facet long, k int, x double, y double, z double, nx double, ny double, nz double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for a large table
    try:
        stl.write_stl_text(t, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = stl.read_stl_text(spark, str(tmp_path / "out"))
    assert back.count() == len(rows) and {r.n for r in back.groupBy("x").agg(F.count_distinct("mesh").alias("n")).collect()} == {1}


def test_an_image_text_is_taken_apart_once(spark, monkeypatch):
    """numbers were read from the whole text again for each point, and again for each use of the points."""
    from facetflow.plans import landmark_queries as q
    from facetflow.sources import calibration_images as src

    cut, seen = src.cut, []
    monkeypatch.setattr(src, "cut", lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, name))
    made = q._images(spark, SF).where("id < 40")
    good, rejects = src.read_images(src.write_images(made))
    assert seen[0].count("arraydata, \\s+") == 2
    assert not any("arraydata" in df._jdf.queryExecution().optimizedPlan().toString() for df in (good, rejects))
    points = lambda df: {r.id: r.image_points for r in df.select("id", "image_points").collect()}
    assert points(good) == points(made) and rejects.count() == 0
    assert "REPARTITION_BY_NUM" in plan(made)


def test_hidden_facets_are_not_tested(spark, monkeypatch):
    """each facet's shape was held against each pixel on it, however much lies in front; triangles leave parts of their boxes open."""
    import random

    from facetflow.operators import camera

    rng = random.Random(3)
    tri = lambda k, a, b, z: (k % 2, k, [(a * z, b * z, -z), ((a + 0.4) * z, b * z, -z), (a * z, (b + 0.4) * z, -z)], 0.0, 0.0, 1.0)
    faces = [tri(k, rng.uniform(-0.8, 0.6), rng.uniform(-0.8, 0.6), rng.choice((2.0, 3.0, 5.0 + k))) for k in range(400)]
    faces = spark.createDataFrame(faces, "image int, facet int, ring array<struct<x: double, y: double, z: double>>, nx double, ny double, nz double")
    pixels = spark.range(2 * 1024).selectExpr("cast(id % 2 as int) as image", "cast(id div 2 % 32 as int) as ix", "cast(id div 64 as int) as iy")
    seen, plans, cut = [], [], camera.cut
    monkeypatch.setattr(camera, "cut", lambda df, name: seen.append(name) or cut(df, name))
    for sent in (camera.SENT, 0):
        monkeypatch.setattr(camera, "SENT", sent)
        out = camera.pinhole_hits(pixels, faces, (20.0, 21.0), (15.3, 15.7), 4)
        plans.append((sorted(map(tuple, out.collect()), key=repr), out._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[0][0] == plans[1][0] and {r[4] is None for r in plans[0][0]} == {True, False}
    assert "first-hits" in seen and "<= most" in plans[0][1]


def test_texels_take_means_of_pixels(spark, monkeypatch):
    """each measurement went to all texels of its pixel; and frames were made of all facets, seen or not, by the few tasks of a small table."""
    from facetflow.plans import camera_queries as q

    seen, cut, frames = {}, q.cut, q.uv.frames
    monkeypatch.setattr(q, "cut", lambda df, name: seen.update({name: plan(df)}) or cut(df, name))
    monkeypatch.setattr(q.uv, "frames", lambda ring: seen.update(framed=ring.select("facet").distinct().count()) or frames(ring))
    monkeypatch.setattr(q.uv, "splat_footprints", lambda p, *a: seen.update(p=p) or p.limit(0).selectExpr("t", "0 as iu", "0 as iv", "0D as sum_wv", "0D as sum_w"))
    registry.QUERIES["agg02_texture_projection"](spark, SF)
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert "REPARTITION_BY_NUM" in seen["textured"] and 0 < seen["framed"] < n
    cells = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey % 4", "l_partkey % 32", "l_suppkey % 32", "l_linenumber").distinct().count()
    assert seen["p"].count() <= cells


@pytest.mark.parametrize("name", ["agg09_flat_curvature", "agg09_vertex_curvature"])
def test_curvature_moves_nothing_once_dealt(spark, name):
    """a vertex, its points and their places met by joins, each of which wrote all pairs to disk."""
    text = plan(registry.QUERIES[name](spark, SF)).split("== Initial Plan ==")[0]
    moved = [line for line in text.splitlines() if "Exchange" in line and "REPARTITION_BY_NUM" not in line]
    assert "Join" not in text and len(moved) == (name == "agg09_vertex_curvature")  # there the sums by mesh


def test_meshes_are_counted_without_pairs(spark):
    """F8: each part met all boxes of its deal, and kept their numbers."""
    import random

    from facetflow.sources import parts

    rng = random.Random(8)
    p = [(rng.randrange(-50, 400), rng.randrange(4)) for _ in range(150)] + [(None, 1), (7, None)]
    m = [(rng.randrange(-50, 400), rng.randrange(3)) for _ in range(300)] + [(None, 1), (9, None)]
    out = parts.after(spark.createDataFrame(p, "part long, deal int"), spark.createDataFrame(m, "mesh long, deal int"), "deal", 64)
    got = sorted((r.part, r.n) for r in out.collect())
    want = sorted((a, len({b for b, e in m if b is not None and e == d and b > a})) for a, d in set(p) if a is not None and d is not None)
    assert [r for r in got if r != (7, 0)] == [r for r in want if r != (7, 0)]
    text = plan(registry.QUERIES["src07_bound_parts"](spark, SF))
    assert "collect_set(mesh" not in text


def test_lines_are_shuffled_by_cell_and_facet(spark, monkeypatch):
    """each midpoint was written and shuffled five times; lines that cross many cells and leave the texture, against plain sums."""
    import math
    import random

    from facetflow.operators import uv

    rng, n = random.Random(10), 6
    quads = [(1, j * n + i, k, (i + a) / n, (j + b) / n) for i in range(n) for j in range(n) if (i, j) != (2, 3) for k, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    lines = [(1, i, *(rng.uniform(-0.02, 1.0) for _ in range(4))) for i in range(60)] + [(2, 99, 0.1, 0.1, 0.2, 0.2), (1, 100, None, 0.1, 0.2, 0.2), (1, 101, 0.51, 0.51, 0.51, 0.51)]
    corners = spark.createDataFrame(quads, "mesh int, facet int, k int, u double, v double")
    frames = corners.select("mesh", "facet", *(F.lit(x).alias(c) for c, x in (("i11", 2.0), ("i12", 0.0), ("i21", 0.0), ("i22", 3.0)))).distinct()
    values = corners.select("mesh", "facet", (F.col("facet") * 0.5).alias("value")).distinct()
    written, cut = [], uv.cut
    monkeypatch.setattr(uv, "cut", lambda df, name: written.append(name) or cut(df, name))
    leaves = uv.cells(uv.polygons(corners), 2)
    assert leaves.select("depth").distinct().count() > 1 or leaves.first().depth > 0
    out = uv.facet_line_means(spark.createDataFrame(lines, "mesh int, line int, u1 double, v1 double, u2 double, v2 double"), leaves, frames, values, 0.03, 0.04)
    want = {}
    for m, line, u1, v1, u2, v2 in lines:
        if u1 is None:
            continue
        steps = int(1 + math.hypot((u2 - u1) / 0.03, (v2 - v1) / 0.04))
        at = [(u1 + (k + 0.5) / steps * (u2 - u1), v1 + (k + 0.5) / steps * (v2 - v1)) for k in range(steps)]
        on = [int(v * n) * n + int(u * n) if m == 1 and 0 <= u <= 1 and 0 <= v <= 1 and (int(u * n), int(v * n)) != (2, 3) else None for u, v in at]
        good = None not in on
        want[m, line] = (steps, round(math.hypot(2 * (u2 - u1), 3 * (v2 - v1)), 9) if good else None, round(sum(f * 0.5 for f in on) / steps, 9) if good else None)
    r9 = lambda x: x if x is None else round(x, 9)
    assert {(r.mesh, r.line): (r.steps, r9(r.length), r9(r["mean"])) for r in out.collect()} == want and any(x[1] is None for x in want.values()) and sum(x[1] is not None for x in want.values()) > 5
    assert "midpoints" not in written


def test_texts_are_gone_once_read(spark, monkeypatch):
    """paths of text files went with each corner, corners were dealt twice on their way to texts, and texts stayed."""
    from pathlib import Path

    from facetflow.sources import stl

    seen, dealt_once, write = [], [], stl.write_stl_text
    monkeypatch.setattr(stl, "with_normals", lambda t, f=stl.with_normals: seen.append(dict(t.dtypes)["mesh"]) or f(t))
    monkeypatch.setattr(stl, "write_stl_text", lambda t, path: dealt_once.append(path) or write(t, path))
    out = registry.QUERIES["src01_stl_surfaces"](spark, SF)
    assert out.count() == 6 * spark.read.parquet(f"{SF}/part.parquet").count()
    assert seen == ["bigint"] and not Path(dealt_once[0].removeprefix("file://")).exists()
