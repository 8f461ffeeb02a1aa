"""Streams that are stopped and started again, and streams that meet, against the same work over all rows."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetflow.streaming import accumulate, frames, live, pairs

PIXELS = "channel long, revision long, t long, ix int, iy int, v double, w double"


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def pixel_files(seed=1, n=4):
    rng = random.Random(seed)
    out = [[(rng.randrange(2), rng.randrange(4), rng.randrange(3), rng.randrange(-20, 40), rng.randrange(40), rng.random(), rng.choice((0.0, 0.5, 1.0))) for _ in range(150)] for _ in range(n)]
    out[-1] += [(0, 3, 1, 1, 1, None, 1.0), (0, 9, 1, None, 1, 1.0, 1.0), (None, 9, 1, 1, 1, 1.0, 1.0), (0, None, 1, 1, 1, 1.0, 1.0), (1, 9, 1, 1, 1, float("nan"), 1.0)]
    return out


def put(spark, path, part, schema=PIXELS):
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_accumulation_goes_on(spark, tmp_path):
    """Two of four files, then the rest: each file is read once, the sums are those of all."""
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    parts = pixel_files()
    run = lambda: accumulate.run_available(accumulate.accumulate_stream(live.live_source(spark, path, spark.createDataFrame([], PIXELS).schema).dropna(subset=["v"]).where("not isnan(v)")), "sums", store=store)
    for part in parts[:2]:
        put(spark, path, part)
    some = rows(run())
    assert rows(run()) == some  # nothing new, nothing lost
    for part in parts[2:]:
        put(spark, path, part)
    every = spark.createDataFrame(sum(parts, []), PIXELS).where("w > 0 and v is not null and not isnan(v)")
    want = every.groupBy("ix", "iy", "t").agg(F.sum(F.col("w") * F.col("v")).alias("sum_wv"), F.sum("w").alias("sum_w"))
    assert rows(run().select("ix", "iy", "t", "sum_wv", "sum_w")) == rows(want)
    read = spark.read.parquet(f"{store}/sums/rows").groupBy("round").count().collect()
    assert len([r for r in read if r["round"] >= 0]) == 4


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_revisions_reset_tiles_in_any_order(spark, tmp_path, order):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    parts = pixel_files(2)
    run = lambda: accumulate.by_revision(live.live_source(spark, path, spark.createDataFrame([], PIXELS).schema), store=store)
    for k in order[:2]:
        put(spark, path, parts[k])
    run()
    for k in order[2:]:
        put(spark, path, parts[k])
    good = [p for p in sum(parts, []) if None not in p and p[5] == p[5] and p[6] > 0]
    tile = lambda p: (p[0], p[3] // accumulate.TILE, p[4] // accumulate.TILE)
    newest = {}
    for p in good:
        newest[tile(p)] = max(newest.get(tile(p), -1), p[1])
    want = {}
    for p in good:
        if p[1] == newest[tile(p)]:
            a = want.setdefault((p[0], p[1], p[2], p[3], p[4]), [0, 0])
            a[0] += p[5] * p[6]
            a[1] += p[6]
    assert rows(run().select("channel", "revision", "t", "ix", "iy", "sum_wv", "sum_w")) == sorted(((*k, round(a, 6), round(b, 6)) for k, (a, b) in want.items()), key=repr)


def test_tiles_are_forgotten_after_their_time(spark, tmp_path):
    class State:
        def __init__(self):
            self.now, self.hasTimedOut = None, False

        exists = property(lambda self: self.now is not None)
        get = property(lambda self: self.now)

        def update(self, x):
            self.now = x

        def remove(self):
            self.now = None

    state = State()
    frame = pd.DataFrame({"revision": [2, 2, 1], "t": [0, 0, 0], "cell": [3, 3, 4], "v": [1.0, 2.0, 9.0], "w": [1.0, 1.0, 1.0]})
    (out,) = accumulate._tile((1, 0, 0), iter([frame]), state)
    assert out["cells"].tolist() == [[3]] and out["sum_wv"].tolist() == [[3.0]]
    (out,) = accumulate._tile((1, 0, 0), iter([frame]), state)
    assert out["sum_wv"].tolist() == [[6.0]]
    assert list(accumulate._tile((1, 0, 0), iter([frame.assign(revision=1)]), state)) == [] and state.exists
    state.hasTimedOut = True
    assert list(accumulate._tile((1, 0, 0), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    (out,) = accumulate._tile((1, 0, 0), iter([frame]), state)
    assert out["sum_wv"].tolist() == [[3.0]]
    put(spark, str(tmp_path / "in"), pixel_files(3, 1)[0])  # and the timeout is accepted by a stream
    stream = lambda: live.live_source(spark, str(tmp_path / "in"), spark.createDataFrame([], PIXELS).schema)
    assert rows(accumulate.by_revision(stream(), ttl_ms=3_600_000)) == rows(accumulate.by_revision(stream()))


def test_other_streams_go_on(spark, tmp_path):
    parts = pixel_files(4)
    cell, path, store = ("channel", "ix", "iy"), str(tmp_path / "in"), str(tmp_path / "store")
    source = lambda p: live.live_source(spark, p, spark.createDataFrame([], PIXELS).schema)
    hits = spark.range(60).selectExpr("cast(id - 20 as int) as ix", "id * 0.5 as hu").crossJoin(spark.range(40).selectExpr("cast(id as int) as iy", "id * 0.25 as hv")).crossJoin(spark.range(2).selectExpr("id as image"))
    taps = hits.where("image = 0").selectExpr("ix", "iy", "ix as px", "iy as py", "1.0 as tw")
    work = {
        "background": lambda p, s: frames.without_early(source(p).select(*cell, "t", "v"), 0, *cell, store=s),
        "undistorted": lambda p, s: frames.undistorted(source(p).select("t", "ix", "iy", "v", "w"), taps, "t", store=s),
        "projection": lambda p, s: live.accumulated_projection(source(p).withColumnRenamed("channel", "image"), taps, hits, "t", store=s),
    }
    for part in parts[:2]:
        put(spark, path, part)
    for run in work.values():
        run(path, store)
    for part in parts[2:]:
        put(spark, path, part)
    for name, run in work.items():
        got = rows(run(path, store))
        assert got == rows(run(path, None)) and got, name


T0 = datetime.datetime(2024, 1, 1)


def timed(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def meet(spark, tmp_path, lefts, rights, run, left_schema, right_schema, restart):
    """run(left, right, store) over files that come one by one, with a restart between; the closing rows come last, twice."""
    paths, store = (str(tmp_path / "left"), str(tmp_path / "right")), str(tmp_path / "store")
    schemas = left_schema, right_schema
    source = lambda k: live.live_source(spark, paths[k], spark.createDataFrame([], schemas[k]).schema)
    out = None
    for at, (a, b) in enumerate(zip(lefts, rights)):
        put(spark, paths[0], a, left_schema)
        put(spark, paths[1], b, right_schema)
        if at in restart:
            out = run(source(0), source(1), store)
    return out


def test_poses_that_come_late(spark, tmp_path):
    """Rows up to an hour late, in two orders of files, with a restart: the answers are those of one join."""
    rng = random.Random(6)
    left = [(i, timed(rng.uniform(0, 600)), rng.choice(("a", "b", None)), f"solved {i}") for i in range(120)]
    right = [(timed(rng.uniform(0, 600)), rng.choice(("a", "b", "c", None)), f"manual {i}") for i in range(60)]
    right += [(None, "a", "never"), (right[0][0], right[0][1], "manual 0 again")]
    want = set()
    met = set()
    for i, at, key, pose in left:
        near = [(t, p) for t, k, p in right if t and k == key and key is not None and at - datetime.timedelta(minutes=20) <= t <= at + datetime.timedelta(minutes=10)]
        met |= {(t, p) for t, p in near}
        want.add((i, key, max(near)[1] if near else pose, "manual" if near else "solved"))
    want |= {(None, k, p, "manual") for t, k, p in right if t and (t, p) not in met}
    for run in range(2):
        def parts(rows, at):
            jitter = {r: rng.uniform(0, 50) for r in rows}
            files = [[] for _ in range(4)]
            for r in rows:  # a row comes up to 50 minutes after its time
                files[min(3, int(((r[at] or T0) - T0).total_seconds() / 60 + jitter[r]) // 165)].append(r)
            return files
        closing = [[(None, timed(10_000 + d), "z", None)] for d in (0, 500)], [[(timed(10_000 + d), "y", "close")] for d in (0, 500)]
        lefts, rights = parts(left, 1) + closing[0], parts(right, 0) + closing[1]
        got = meet(spark, tmp_path / str(run), lefts, rights, lambda a, b, s: pairs.posed(a, b, "20 minutes", "10 minutes", "4 hours", s), "id long, at timestamp, key string, pose string", "at timestamp, key string, pose string", (1, 5))
        assert {tuple(r) for r in got.where("key is null or key <> 'y'").collect()} == want


def test_landmarks_and_solved_poses(spark, tmp_path):
    meta = {"LANDMARK_A_X": "old", "Other": "kept"}
    images = [[(1, timed(10), "c", meta), (2, timed(50), "c", meta)], [(3, timed(200), "d", None), (4, timed(201), None, meta)], [(None, timed(9000), "z", None)], [(None, timed(9500), "z", None)]]
    marks = [[(timed(5), "c", [("A", 1.0, 2.0)]), (timed(9), "c", [("A", 3.0, None), (None, 1.0, 1.0)])], [(timed(205), "d", [("B", 1.0, 1.0)])], [(timed(9000), "y", None)], [(timed(9500), "y", None)]]
    got = meet(spark, tmp_path / "m", images, marks, lambda a, b, s: pairs.with_landmarks(a, b, "30 minutes", "1 hour", s), "id long, at timestamp, channel string, meta map<string,string>", "at timestamp, channel string, marks array<struct<name string, x double, y double>>", (0, 3))
    assert {r.id: r.meta for r in got.collect()} == {1: {"Other": "kept", "LANDMARK_A_X": "3.0"}, 2: meta, 3: None, 4: meta} or {r.id: r.meta for r in got.collect()} == {1: {"Other": "kept", "LANDMARK_A_X": "3.0", "LANDMARK_A_Y": None}, 2: meta, 3: None, 4: meta}
    seen = [[(1, timed(1), "c", 5, "k1"), (2, timed(2), "c", 3, "k1"), (3, timed(3), "d", 6, "k2"), (4, timed(4), "e", 0, None)], [(None, timed(9000), "z", 0, "z")], [(None, timed(9500), "z", 0, "z")]]
    poses = [[(timed(2), "k1", "P"), (timed(3), "k1", "Q")], [(timed(9000), "y", None)], [(timed(9500), "y", None)]]
    got = meet(spark, tmp_path / "p", seen, poses, lambda a, b, s: pairs.solved(a, b, "1 hour", "1 hour", "1 hour", store=s), "id long, at timestamp, channel string, n int, pose_key string", "at timestamp, pose_key string, pose string", (2,))
    assert {tuple(r) for r in got.collect()} == {(1, "c", 5, "Q", None), (2, "c", 3, None, "too few landmarks"), (3, "d", 6, None, "no pose solved for these landmarks"), (4, "e", 0, None, "too few landmarks")}


def test_nothing_meets_nothing(spark, tmp_path):
    schemas = "id long, at timestamp, key string, pose string", "at timestamp, key string, pose string"
    assert meet(spark, tmp_path, [[]], [[]], lambda a, b, s: pairs.posed(a, b, "1 hour", "1 hour", "1 hour", s), *schemas, (0,)).count() == 0


def test_a_row_does_not_meet_all_that_is_near(spark, tmp_path, monkeypatch):
    """all rows of a key within reach of each other were written as pairs; now each row is written once, and passes twice."""
    lefts = [(i, timed(i % 7), "c", 5, "k") for i in range(200)] + [(None, timed(9000), "z", 0, "z")]
    rights = [(timed(j % 5), "k", f"P{j:03}") for j in range(200)] + [(timed(9000), "y", None)]
    left, right = "id long, at timestamp, channel string, n int, pose_key string", "at timestamp, pose_key string, pose string"
    kept, run = [], pairs.run_batches
    monkeypatch.setattr(pairs, "run_batches", lambda *a, **b: kept.append(run(*a, **b)) or kept[-1])
    got = meet(spark, tmp_path, [lefts], [rights], lambda a, b, s: pairs.solved(a, b, "1 hour", "2 minutes", "1 hour", store=s), left, right, (0,))
    last = {m: max((t, p) for t, k, p in rights if t <= timed(m + 2) and k == "k")[1] for m in range(7)}
    assert {(r.id, r.pose) for r in got.collect()} == {(i, last[i % 7]) for i in range(200)}
    assert kept[0].count() == 402 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
