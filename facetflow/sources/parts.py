"""Parts: a mesh bound to a frame and landmarks, and channels that carry geometry or refer to one that does.

Defined results: a part without a mesh, frame or landmarks has null or empty ones; a channel whose references end at no geometry has no
shapes; a circle of references raises. Of repeated landmark names of a part the smallest place counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.metadata import reference_chain
from ..session import cut, dealt
from . import x3d

#: Metadata keys of channels with geometry.
GEOMETRY, TEXTURES, REFERENCE, PREFIX = "X3DGeom", "TextureChans", "X3DGeomRef", "TexChanPrefix"


def bind(parts: DataFrame, surfaces: DataFrame, landmarks: DataFrame) -> DataFrame:
    """part, frame, surfaces (sorted array of meshes), landmarks (map of name to x, y, z) from parts (part, frame), surfaces (part, mesh) and
    landmarks (part, name, x, y, z). A part's landmarks and surfaces are few: people name them. Surfaces that a rule gives are many for each part:
    they come counted (part, n), and surfaces is their number."""
    counted = "n" in surfaces.columns
    s = surfaces.select("part", F.col("n").alias("surfaces")) if counted else surfaces.groupBy("part").agg(F.sort_array(F.collect_set("mesh")).alias("surfaces"))
    marks = landmarks.where("name is not null").groupBy("part", "name").agg(F.min(F.struct("x", "y", "z")).alias("at"))
    marks = marks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("name", "at"))).alias("landmarks"))
    j = parts.select("part", "frame").join(s, "part", "left").join(marks, "part", "left")
    return j.select("part", "frame", F.coalesce("surfaces", F.lit(0) if counted else F.array()).alias("surfaces"), F.coalesce("landmarks", F.create_map().cast(marks.schema["landmarks"].dataType)).alias("landmarks"))


def after(parts: DataFrame, meshes: DataFrame, key: str, block: int = 1 << 16) -> DataFrame:
    """part, n: how many different meshes (mesh, key) of a part's key (part, key) have a larger number than the part. Numbers are cut in blocks: those of
    a part's block pass in order, of later blocks only their counts; no pair is made. Null parts and meshes count for nothing."""
    in_block = lambda c: F.floor(F.col(c) / block).alias("block")
    p = parts.where("part is not null").select(key, in_block("part"), F.col("part").alias("at"), F.lit(0).alias("n")).distinct()
    m = meshes.where("mesh is not null").select(key, in_block("mesh"), F.col("mesh").alias("at"), F.lit(1).alias("n")).distinct()
    rows = p.unionByName(m)
    larger = Window.partitionBy(key, "block").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(key, "block", "at")
    here = rows.withColumn("n_here", F.sum("n").over(larger) - F.sum("n").over(equal)).where("n = 0")
    later = Window.partitionBy(key).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "block").agg(F.sum("n").alias("n")).withColumn("n_later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return here.join(dealt(blocks.select(key, "block", "n_later")), [key, "block"]).select(F.col("at").alias("part"), (F.col("n_here") + F.col("n_later")).alias("n"))


def channel_geometry(channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channel, root, prefix of each of channels (channel, meta), shapes of the roots): references are followed to the channel with geometry,
    and texture prefixes are joined on the way, that of the end included. A text is parsed once for all channels that refer to it."""
    at = lambda key: F.element_at("meta", key)
    own = F.coalesce(at(GEOMETRY), F.lit("")) != ""
    c = channels.select("channel", at(GEOMETRY).alias("text"), own.alias("own"), at(REFERENCE).alias("target"), F.coalesce(at(PREFIX), F.lit("")).alias("prefix"))
    ends = c.where("own").select("channel", F.col("channel").alias("root"), "prefix", "text")
    hops = reference_chain(c.where("not own and target is not null").select("channel", "target", "prefix"))
    more = ends.select("root", F.col("prefix").alias("more"))
    far = hops.join(more, "root").select("channel", "root", F.concat("prefix", "more").alias("prefix"))
    bound = cut(ends.select("channel", "root", "prefix").unionByName(far), "geometry")
    used = ends.join(bound.select("root").distinct(), "root", "left_semi")
    return bound, x3d.shapes(used.select(F.col("root").alias("doc"), "text"))


def geometry_channels(texts: DataFrame, textures: DataFrame) -> DataFrame:
    """channel, meta from texts (channel, text) and textures (channel, url): the geometry and the names of the textures inside the document
    (those that begin with #), each once, in order."""
    inside = textures.where("url like '#%'").select("channel", F.expr("substring(url, 2)").alias("name"))
    t = inside.groupBy("channel").agg(F.array_join(F.sort_array(F.collect_set("name")), "|").alias("names"))
    meta = F.create_map(F.lit(GEOMETRY), F.col("text"), F.lit(TEXTURES), F.coalesce("names", F.lit("")))
    return texts.select("channel", "text").join(t, "channel", "left").select("channel", meta.alias("meta"))
