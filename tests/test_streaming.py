"""Streams of several micro-batches give what the batch over all files gives."""

import pytest
from pyspark.sql import functions as F

from facetflow.operators import fusion
from facetflow.plans import registry
from facetflow.sources import fixtures
from facetflow.streaming import accumulate, frames

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def pixels(spark, tmp_path_factory):
    """(stream of eight files, one a batch, and the same rows as a table): stacks span files."""
    path = str(tmp_path_factory.mktemp("pixels") / "in")
    p = fixtures.pixels(spark, SF).select("shot", "ix", "iy", F.col("t").cast("long").alias("t"), "v", "w")
    odd = spark.createDataFrame([(0, 1, 1, 1, None, 0.5), (0, 1, 1, 1, float("nan"), 0.5), (None, 1, 1, 1, 2.0, 0.5)], p.schema)
    p = p.unionByName(odd)
    p.repartition(8).write.parquet(path)
    stream = lambda: spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream, spark.read.parquet(path)


def test_accumulation(spark, pixels):
    stream, table = pixels
    out = accumulate.run_available(accumulate.accumulate_stream(stream()), "test")
    assert rows(out.select("ix", "iy", "t", F.round("sum_wv", 6), F.round("sum_w", 6))) == rows(fusion.accumulate(table.where("w > 0")).select("ix", "iy", "t", F.round("sum_wv", 6), F.round("sum_w", 6)))


def test_background_of_stacks_that_span_batches(pixels):
    stream, table = pixels
    cell = ("shot", "ix", "iy")
    stack = table.where("v is not null and not isnan(v)").groupBy(*cell, "t").agg(F.avg("v").alias("v"))
    early = stack.where("t <= 2").groupBy(*cell).agg(F.avg("v").alias("e")).withColumnsRenamed({c: "e" + c for c in cell})
    same = F.lit(True)
    for c in cell:
        same = same & stack[c].eqNullSafe(early["e" + c])
    want = stack.join(early, same, "left").select(*cell, "t", (F.col("v") - F.col("e")).alias("v"))
    assert rows(frames.without_early(stream().select(*cell, "t", "v"), 2, *cell)) == rows(want)


def test_commands(spark, tmp_path):
    log = [(k, ["set", "set", "clear", "invalid", "query", "set"][k % 6], f"L{k * 7 % 5}", float(k), float(-k)) for k in range(1, 60)]
    log += [(25, "clear-all", None, None, None), (60, "other", "L1", 1.0, 1.0), (61, "set", None, 1.0, 1.0)]
    df = spark.createDataFrame(log, "seq long, command string, name string, x double, y double")
    df.repartition(6).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    state = {}
    for _, command, name, x, y in sorted(log):
        if command == "clear-all":
            state = {}
        elif command == "clear":
            state.pop(name, None)
        elif command in ("set", "invalid") and name:
            state[name] = (x, y, False) if command == "set" else (None, None, True)
    want = sorted(((n, *s) for n, s in state.items()), key=repr)
    assert rows(frames.latest_commands(df)) == rows(frames.streamed_commands(stream)) == want
    assert frames.latest_commands(df.limit(0)).count() == 0


def test_projection_and_undistortion(spark, pixels):
    stream, table = pixels
    hits = table.select(F.col("shot").alias("image"), "ix", "iy").distinct().where("ix % 2 = 0").withColumn("place", F.col("ix") + 100)
    got = frames.each_batch(stream().withColumnRenamed("shot", "image"), lambda b: frames.projected(b, hits).select("image", "t", "place"), "test", "image long, t long, place int")
    assert rows(got) == rows(frames.projected(table.withColumnRenamed("shot", "image"), hits).select("image", "t", "place")) and got.count() > 0
    taps = spark.createDataFrame([(0, 0, 1, 1, 0.25), (0, 0, 2, 1, 0.75), (5, 5, 3, 4, 1.0)], "ix int, iy int, px int, py int, tw double")
    good = table.where("w > 0 and v is not null and not isnan(v)").withColumnsRenamed({"ix": "px", "iy": "py"}).join(taps, ["px", "py"])
    want = good.groupBy("t", "ix", "iy").agg((F.sum(F.col("tw") * F.col("w") * F.col("v")) / F.sum(F.col("tw") * F.col("w"))).alias("v"))
    got = frames.undistorted(stream().select("t", "ix", "iy", "v", "w"), taps, "t")
    assert rows(got.select("t", "ix", "iy", F.round("v", 6))) == rows(want.select("t", "ix", "iy", F.round("v", 6))) and got.count() > 0


def test_grabbed_frames_once(spark):
    assert registry.QUERIES["str03_grabbed_frames"](spark, SF).count() == registry.QUERIES["str03_grabbed_frames"](spark, SF).distinct().count() > 0
