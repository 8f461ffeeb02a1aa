"""The live graph and parts on odd and empty input."""

from facetflow.sources import parts, x3d
from facetflow.streaming import live


def test_contacts_of_odd_shots_and_none(spark, tmp_path):
    schema = "wf int, cu int, cv int, v array<double>"
    wave = [0.0, 1.0, 0.0, -1.0] * 8
    rows = [(1, 3, 3, [x * 0.5 for x in wave]), (2, 3, 3, None), (3, 3, 3, [1.0, None, 2.0]), (4, 3, 3, []), (5, 9, 9, [x * 2 for x in wave])]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "shots"))
    scan = lambda p: live.contact_scan(live.live_source(spark, str(tmp_path / p), spark.createDataFrame([], schema).schema), 32.0, 1, 32, 1, 3.0, 1.0, 0.0, 31.0).collect()
    got = [(r["iu"], r["iv"], round(r["peak"], 6), r["n"]) for r in scan("shots") if r["peak"]]
    assert got == [(3, 3, 0.5, 32)]  # a shot louder than the reference has no contact
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert scan("none") == []


def test_corners_that_are_missing(spark, tmp_path):
    log = spark.createDataFrame([(1, "set", "A", 1.0, 2.0), (2, "set", "B", 3.0, 4.0), (3, "clear", "B", None, None)], "seq long, command string, name string, x double, y double")
    log.write.parquet(str(tmp_path / "log"))
    stream = lambda: live.live_source(spark, str(tmp_path / "log"), log.schema)
    assert live.corner_row(stream(), ["A", "B"]).count() == 0
    assert [tuple(r) for r in live.corner_row(stream(), ["A"]).collect()] == [(1.0, 2.0)]


def test_stored_results_are_not_made_again(spark):
    wanted = live.with_key(spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id int, pose string"), "pose")
    stored = wanted.where("id = 1").selectExpr("cache_key", "'old' as value")
    out, made = live.stored_or_made(wanted, stored, lambda keys: keys.selectExpr("cache_key", "'new' as value"))
    assert sorted((r["id"], r["value"]) for r in out.collect()) == [(1, "old"), (2, "old"), (3, "new"), (4, "new")] and made.count() == 1


def test_poses_that_are_missing(spark):
    marks = spark.createDataFrame([(1, n, 1.0, None) for n in "abcd"] + [(2, "a", 1.0, 1.0), (3, "q", 1.0, 1.0), (3, None, 1.0, 1.0)], "channel int, name string, px double, py double")
    part = spark.createDataFrame([(n, 0.0, 0.0, 0.0) for n in "abcd"], "name string, x double, y double, z double")
    keys = live.pose_keys(marks, part)
    got = sorted((r["channel"], r["n"], r["error"]) for r in live.solved_poses(keys, spark.createDataFrame([], "pose_key string, pose string")).collect())
    assert got == [(1, 4, "no pose solved for these landmarks"), (2, 1, "too few landmarks"), (3, 0, "too few landmarks")]


def test_parts_without_anything(spark):
    p = spark.createDataFrame([(1, "f"), (2, None)], "part int, frame string")
    marks = spark.createDataFrame([(1, "m", 2.0, 0.0, 0.0), (1, "m", 1.0, 9.0, 9.0), (1, None, 1.0, 1.0, 1.0)], "part int, name string, x double, y double, z double")
    got = {r["part"]: (r["surfaces"], {k: v["x"] for k, v in r["landmarks"].items()}) for r in parts.bind(p, spark.createDataFrame([], "part int, mesh long"), marks).collect()}
    assert got == {1: ([], {"m": 1.0}), 2: ([], {})}


def test_channels_whose_references_end_nowhere(spark):
    text = '<X3D><head><unit category="length" conversionFactor="0.001"/></head><Scene><Shape><IndexedFaceSet coordIndex="0 1 2"><Coordinate point="1000 0 0 0 0 0 0 1 0"/><Normal vector="0 0 2 0 0 2 0 0 2"/></IndexedFaceSet></Shape></Scene></X3D>'
    meta = [("a", {"X3DGeomRef": "b", "TexChanPrefix": "1"}), ("b", {"X3DGeom": text, "TexChanPrefix": "2"}), ("c", {"X3DGeomRef": "gone"}), ("d", None), ("e", {"X3DGeom": ""})]
    bound, found = parts.channel_geometry(spark.createDataFrame(meta, "channel string, meta map<string,string>"))
    assert sorted(map(tuple, bound.collect())) == [("a", "b", "12"), ("b", "b", "2")]
    assert {round(r["x"], 9) for r in x3d.vertices(found).collect()} == {0.0, 1.0}
    assert {(r["nx"], r["ny"], r["nz"], r["u"]) for r in x3d.corners(found).collect()} == {(0.0, 0.0, 1.0, None)}
