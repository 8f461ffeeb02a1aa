"""Queries of channel metadata, fields and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import metadata as op
from ..session import table
from .registry import query

FLAGS = {"adaptive": 1, "normalize": 2, "filter": 4, "fast": 8}


@query("sf01_landmarks", "SELECT p_partkey AS channel, 'LANDMARK' AS kind, 'A_' || (p_partkey % 3) AS name, p_size::DOUBLE AS x, (p_partkey % 11)::DOUBLE AS y FROM part")
def landmarks(spark, d):
    key = F.concat(F.lit("LANDMARK_A_"), (F.col("p_partkey") % 3).cast("string"))
    pairs = F.concat(key, F.lit("_X")), F.col("p_size").cast("string"), F.concat(key, F.lit("_Y")), (F.col("p_partkey") % 11).cast("string"), F.lit("Step1"), F.lit("0.5")
    return op.landmarks(table(spark, d, "part").select(F.col("p_partkey").alias("channel"), F.create_map(*pairs).alias("meta")))


@query("sf05_number_rows", "WITH l AS (SELECT p_partkey AS mesh, [p_size, p_partkey % 7, p_partkey % 3, p_size + 1, p_partkey % 5, p_partkey % 2] AS v FROM part), e AS (SELECT mesh, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS i FROM l) SELECT mesh, (i // 3)::INTEGER AS row, (i % 3)::INTEGER AS k, value::DOUBLE AS value FROM e")
def number_rows(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    text = F.format_string(" %d, %d %d,%d  %d\n%d ", s, k % 7, k % 3, s + 1, k % 5, k % 2)
    return op.number_rows(table(spark, d, "part").select(k.alias("mesh"), text.alias("text")), 3)


@query("sf11_flags", "SELECT p_partkey, concat_ws('|', CASE WHEN p_size & 1 <> 0 THEN 'adaptive' END, CASE WHEN p_size & 2 <> 0 THEN 'normalize' END, CASE WHEN p_size & 4 <> 0 THEN 'filter' END, CASE WHEN p_size & 8 <> 0 THEN 'fast' END) AS names, (p_size & 15)::INTEGER AS mask FROM part")
def flags(spark, d):
    """Flags to names, and from the names back to flags."""
    p = table(spark, d, "part").select("p_partkey", op.flag_names(F.col("p_size").cast("int"), FLAGS).alias("names"))
    return p.withColumn("mask", op.flag_mask(F.col("names"), FLAGS))


@query("sf12_truth", "SELECT p_partkey, p_partkey % 4 < 2 AS truth FROM part")
def truth(spark, d):
    words = F.array(*(F.lit(w) for w in ("true", " Yes", "no", "False")))
    return table(spark, d, "part").select("p_partkey", op.truth(F.get(words, (F.col("p_partkey") % 4).cast("int"))).alias("truth"))


@query("sf13_time_stamps", "SELECT event_id, epoch_us(ts) - 5400000000 AS at FROM events")
def time_stamps(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSSSSS"), F.lit("+0130"))
    return table(spark, d, "events").select("event_id", F.unix_micros(op.time_stamp(text)).alias("at"))


@query("join11_reference_chain", "SELECT 'C' || c_custkey AS channel, 'root' AS root, 'c:' || n_name || ':' || r_name || ':' AS prefix FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'N' || n_nationkey, 'root', n_name || ':' || r_name || ':' FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'R' || r_regionkey, 'root', r_name || ':' FROM region")
def reference_chain(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c = table(spark, d, "customer").select(name("C", "c_custkey").alias("channel"), name("N", "c_nationkey").alias("target"), F.lit("c:").alias("prefix"))
    n = table(spark, d, "nation").select(name("N", "n_nationkey").alias("channel"), name("R", "n_regionkey").alias("target"), F.concat("n_name", F.lit(":")).alias("prefix"))
    r = table(spark, d, "region").select(name("R", "r_regionkey").alias("channel"), F.lit("root").alias("target"), F.concat("r_name", F.lit(":")).alias("prefix"))
    return op.reference_chain(c.unionByName(n).unionByName(r))


@query("set05_merge_metadata", "SELECT p_partkey AS channel, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS title, p_size::VARCHAR AS size FROM part")
def merge_metadata(spark, d):
    """Maps merged without a session setting: a key of both sides takes the right one's value."""
    p = table(spark, d, "part")
    left = F.create_map(F.lit("title"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    right = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("title"), F.col("p_brand"))).otherwise(F.create_map().cast("map<string,string>"))
    both = p.select(F.col("p_partkey").alias("channel"), left.alias("a"), right.alias("b"))
    kept = F.map_filter("a", lambda k, v: ~F.map_contains_key("b", k))
    m = both.select("channel", F.map_concat(kept, F.col("b")).alias("m"))
    return m.select("channel", F.element_at("m", F.lit("title")).alias("title"), F.element_at("m", F.lit("size")).alias("size"))


def _part(spark, d):
    return table(spark, d, "part")


@query("sf03_names", "SELECT p_partkey, p_name AS name, replace(replace(p_name, ' ', '_'), '-', '_') AS identifier, replace(p_name, ' ', '.') AS base FROM part")
def names_of(spark, d):
    """Prefixes and endings put on and taken off, identifiers, base names of paths."""
    k, n = F.col("p_partkey"), F.col("p_name")
    ending = F.when(k % 3 == 0, "_tex").when(k % 3 == 1, "_curvature").otherwise("_UV")
    full = F.concat(F.lit("pre-"), n, ending)
    path = F.concat(F.lit("/a.b/c/"), F.translate("p_name", " ", "."), F.lit(".x3d"))
    return _part(spark, d).select("p_partkey", names.without_ending(names.without_prefix(full, F.lit("pre-"))).alias("name"), names.identifier(n).alias("identifier"), names.base_name(path).alias("base"))


@query("sf04_quoted_strings", r"""SELECT p_partkey, len(string_split(p_name, ' '))::INTEGER AS n, p_name AS joined, '"' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: x || '\\\"' || x), '" "') || '"' AS text FROM part""".replace("\\\\\\", "\\\\\\"))
def quoted(spark, d):
    """Words that hold a backslash and a quote, written and read back."""
    words = F.split("p_name", " ")
    odd = F.transform(words, lambda w: F.concat(w, F.lit('\\"'), w))
    text = names.quote_strings(odd)
    back = F.transform(names.parse_strings(text), lambda w: F.substring_index(w, '\\"', 1))
    return _part(spark, d).select("p_partkey", F.size(back).alias("n"), F.array_join(back, " ").alias("joined"), text.alias("text"))


@query("sf06_json_params", "SELECT p_partkey, p_size::DOUBLE AS size, p_brand AS brand, p_partkey % 7 AS first FROM part")
def json_params(spark, d):
    """Nested parameters to JSON and back."""
    kind = "struct<landmarks:map<string,array<double>>,scaling:struct<size:double,brand:string>>"
    at = F.array((F.col("p_partkey") % 7).cast("double"), F.lit(0.5))
    record = F.struct(F.create_map(F.lit("A"), at).alias("landmarks"), F.struct(F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("brand")).alias("scaling"))
    back = F.from_json(F.to_json(record), kind)
    return _part(spark, d).select("p_partkey", back["scaling"]["size"].alias("size"), back["scaling"]["brand"].alias("brand"), F.element_at(back["landmarks"], "A")[0].cast("long").alias("first"))


@query("sf07_texture_params", "SELECT p_partkey, -1.5 + p_partkey % 4 - CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE p_size / 8.0 END / 2 AS lower, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE p_size / 8.0 END * 16 AS whole FROM part")
def texture_params(spark, d):
    """Lower edge and length of a texture axis from metadata; a step that is no number counts as 1 (SF-07, 08, 09)."""
    k = F.col("p_partkey")
    step = F.when(k % 5 == 0, "none").otherwise((F.col("p_size") / 8.0).cast("string"))
    meta = F.create_map(F.lit("IniVal1"), (k % 4 - 1.5).cast("string"), F.lit("Step1"), step)
    lower, whole = names.texture_scale(names.meta_number(meta, "IniVal1", 0), names.meta_number(meta, "Step1", 1), F.lit(16))
    return _part(spark, d).select("p_partkey", lower.cast("double").alias("lower"), whole.cast("double").alias("whole"))


@query("sf10_shift_axis", "SELECT p_partkey, p_size::VARCHAR AS initial, p_brand AS step, 2::INTEGER AS n FROM part")
def shift_axis(spark, d):
    """The fourth axis becomes the third, whose own keys go."""
    m = F.create_map(F.lit("IniVal3"), F.lit("old"), F.lit("IniVal4"), F.col("p_size").cast("string"), F.lit("Step4"), F.col("p_brand"))
    out = names.shift_axis(m, 4, 3)
    return _part(spark, d).select("p_partkey", F.element_at(out, "IniVal3").alias("initial"), F.element_at(out, "Step3").alias("step"), F.size(out).alias("n"))


@query("sf35_appearance", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'texture' WHEN p_partkey % 3 = 1 THEN 'color' ELSE 'default' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'changed' END AS value FROM part")
def appearance(spark, d):
    """Texture before colour before the default, a record that is copied with a changed value (SF-25)."""
    k = F.col("p_partkey")
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    default = names.updated(one("default", F.lit("grey")), value=F.lit("changed"))
    a = names.appearance(F.when(k % 3 == 0, one("texture", F.col("p_name"))), F.when(k % 3 == 1, one("color", F.col("p_brand"))), default)
    return _part(spark, d).select("p_partkey", a["kind"].alias("kind"), a["value"].alias("value"))


@query("pred14_processed_channels", "SELECT p_partkey AS channel, p_partkey AS ord, CASE WHEN p_size % 4 IN (2, 3) AND p_partkey % 6 = 2 THEN 'done ' || p_name ELSE p_name END AS value FROM part")
def processed(spark, d):
    """Channels of two or three dimensions with the right size are worked on, others pass; the order stays (SET-06, TOP-06)."""
    dims = F.slice(F.array((F.col("p_partkey") % 6).cast("long"), F.lit(5).cast("long"), F.lit(7).cast("long")), 1, F.col("p_size") % 4)
    c = _part(spark, d).select(F.col("p_partkey").alias("channel"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("value"), dims.alias("dims"))
    out = op.process_some(c, op.processable("dims", 2, 5), lambda x: x.withColumn("value", F.concat(F.lit("done "), "value")))
    return out.select("channel", "ord", "value")


@query("pred15_same_geometry", "SELECT p_partkey AS channel, p_size FROM part WHERE p_size % 8 IN (SELECT n_nationkey % 8 FROM nation WHERE n_regionkey = 2)")
def same_geometry(spark, d):
    """Channels whose axis geometry is one of the wanted ones."""
    axis = lambda n: F.struct(n.cast("long").alias("len"), F.lit(0.5).alias("step"))
    want = table(spark, d, "nation").where("n_regionkey = 2").select(axis(F.col("n_nationkey") % 8).alias("axis"))
    c = _part(spark, d).select(F.col("p_partkey").alias("channel"), "p_size", axis(F.col("p_size") % 8).alias("axis"))
    return op.with_geometry(c, want).select("channel", "p_size")


@query("join10_texture_scales", "SELECT p_partkey, coalesce(n_regionkey, 0)::DOUBLE AS lower, coalesce(n_nationkey, 1)::DOUBLE AS whole FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 50")
def texture_scales(spark, d):
    """Scaling by texture name; (0, 1) where a texture has none."""
    t = _part(spark, d).select("p_partkey", F.concat(F.lit("#t"), (F.col("p_partkey") % 50).cast("string")).alias("texture"))
    s = table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("texture"), F.col("n_regionkey").cast("double").alias("lower"), F.col("n_nationkey").cast("double").alias("whole"))
    return op.scales(t, s).select("p_partkey", "lower", "whole")


@query("join25_matched_surfaces", "SELECT p_partkey AS part, i::INTEGER AS ord, p_size + i AS old_mesh, p_size * 10 + i AS new_mesh FROM part, range(3) r(i)")
def matched(spark, d):
    """Old and new surfaces of a part by their order; a part whose counts differ raises (SNK-06)."""
    one = _part(spark, d).withColumn("ord", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    old = one.select(F.col("p_partkey").alias("part"), "ord", (F.col("p_size") + F.col("ord")).alias("mesh"))
    new = one.select(F.col("p_partkey").alias("part"), "ord", (F.col("p_size") * 10 + F.col("ord")).alias("mesh"))
    return op.replace_surfaces(old, new)


@query("top04_largest_pattern", "SELECT l_orderkey AS image, arg_max(l_linenumber, l_linenumber * 1000 + l_quantity) AS nx FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey")
def largest(spark, d):
    """Of the pattern sizes found in an image the one of most points."""
    n = table(spark, d, "lineitem")
    f = n.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("nx"), (F.lit(1000) + F.col("l_quantity") / F.col("l_linenumber")).alias("ny"), (F.col("l_returnflag") == "N").alias("found"))
    return op.largest_pattern(f).select("image", "nx")
