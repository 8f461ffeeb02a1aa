"""Queries of landmark logs, channels and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata as meta
from ..session import table
from .registry import query


@query("str04_latest_landmarks", "WITH e AS (SELECT event_id, 'L' || (user_id % 20) AS name, event_type, value FROM events), c AS (SELECT name, coalesce(max(event_id) FILTER (event_type = 'view'), -1) AS cleared FROM e GROUP BY name) SELECT e.name, arg_max(value, event_id) AS x, arg_max(value / 2, event_id) AS y FROM e JOIN c USING (name) WHERE event_id > cleared GROUP BY e.name")
def latest(spark, d):
    """The last set of each landmark after its last clear; one aggregate, so a log of any length is folded on the map side."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("L"), (F.col("user_id") % 20).cast("string")).alias("name"), "event_type", "value")
    g = e.groupBy("name").agg(F.max(F.struct("event_id", "event_type", "value")).alias("last"))
    g = g.where("last.event_type <> 'view'")
    return g.select("name", F.col("last.value").alias("x"), (F.col("last.value") / 2).alias("y"))


IMAGE = "image AS (SELECT 'L' || user_id % 40 AS name, arg_max(value, event_id) AS px, min(value) AS py FROM events GROUP BY ALL), part3 AS (SELECT 'L' || n_nationkey AS name, n_nationkey::DOUBLE AS x, n_regionkey::DOUBLE AS y, 0.5::DOUBLE AS z FROM nation)"


def _landmarks(spark, d):
    """The landmarks of an image from a log, those of a part from the nations."""
    e = table(spark, d, "events").groupBy(F.concat(F.lit("L"), (F.col("user_id") % 40).cast("string")).alias("name")).agg(F.max_by("value", "event_id").alias("px"), F.min("value").alias("py"))
    p = table(spark, d, "nation").select(F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"), F.lit(0.5).alias("z"))
    return meta.landmark_pairs(e, p)


@query("join07_landmark_pairs", f"WITH {IMAGE} SELECT name, px, py, x, y, z FROM image JOIN part3 USING (name) WHERE (SELECT count(*) FROM image JOIN part3 USING (name)) >= 4")
def pairs(spark, d):
    return _landmarks(spark, d)[0]


@query("join07_unmatched", f"WITH {IMAGE} SELECT name FROM image WHERE name NOT IN (SELECT name FROM part3)")
def unmatched(spark, d):
    return _landmarks(spark, d)[1]


@query("pred16_enough_landmarks", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 4")
def enough(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 4")


@query("agg28_texture_names", "SELECT p_brand, string_agg(DISTINCT ltrim('#' || p_type, '#'), '|' ORDER BY ltrim('#' || p_type, '#')) AS names FROM part GROUP BY p_brand")
def textures(spark, d):
    p = table(spark, d, "part").select("p_brand", F.regexp_replace(F.concat(F.lit("#"), "p_type"), "^#+", "").alias("t"))
    return p.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("t")), "|").alias("names"))


@query("sf02_prefix_names", "SELECT p_partkey, array_to_string(list_transform(string_split(replace(p_name, ' ', '|'), '|'), lambda x: 'PRE_' || x), '|') AS names FROM part")
def prefixed(spark, d):
    names = F.transform(F.split(F.translate("p_name", " ", "|"), r"\|"), lambda x: F.concat(F.lit("PRE_"), x))
    return table(spark, d, "part").select("p_partkey", F.array_join(names, "|").alias("names"))


@query("sf14_round_to_second", "SELECT event_id, date_trunc('second', ts + INTERVAL 500 MILLISECONDS) AS ts FROM events")
def rounded(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("cast(date_trunc('second', ts + interval 500 milliseconds) as timestamp_ntz)").alias("ts"))
