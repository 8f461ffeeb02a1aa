"""Channel metadata: landmarks in key names, number lists, flags, truth values, time stamps, and references between channels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

_LANDMARK = "^(LANDMARK|FIDUCIAL)_(.+)_([XY])$"
#: Doublings of a chain; 2**20 references in a row are a cycle.
MAX_DOUBLINGS = 20


def landmarks(channels: DataFrame) -> DataFrame:
    """channel, kind, name, x, y from (channel, meta map): values that are no numbers are null."""
    m = channels.select("channel", F.explode("meta").alias("key", "value"))
    m = m.where(F.col("key").rlike(_LANDMARK))
    kind, name, axis = (F.regexp_extract("key", _LANDMARK, i) for i in (1, 2, 3))
    m = m.select("channel", kind.alias("kind"), name.alias("name"), axis.alias("axis"), F.expr("try_cast(value as double)").alias("value"))
    return m.groupBy("channel", "kind", "name").agg(*(F.max(F.when(F.col("axis") == a, F.col("value"))).alias(a.lower()) for a in "XY"))


def number_rows(texts: DataFrame, width: int) -> DataFrame:
    """mesh, row, k, value from (mesh, text): numbers parted by commas or spaces, width of them a row."""
    tokens = F.filter(F.split(F.translate("text", ",", " "), r"\s+"), lambda x: x != "")
    p = texts.select("mesh", F.posexplode(tokens).alias("pos", "token"))
    return p.select("mesh", F.expr(f"cast(pos div {width} as int)").alias("row"), (F.col("pos") % width).alias("k"), F.expr("try_cast(token as double)").alias("value"))


def flag_names(mask: Column, flags: dict[str, int]) -> Column:
    return F.concat_ws("|", *(F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in flags.items()))


def flag_mask(names: Column, flags: dict[str, int]) -> Column:
    """Names that aren't known add nothing."""
    have, out = F.split(names, r"\|"), F.lit(0)
    for name, bit in flags.items():
        out = out.bitwiseOR(F.when(F.array_contains(have, name), F.lit(bit)).otherwise(F.lit(0)))
    return out


def truth(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "yes")


def time_stamp(text: Column) -> Column:
    """ISO-8601 with a dot or comma before the fraction and offsets with or without a colon; null where it is neither."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d\d)(\d\d)$", "$1:$2"))


def reference_chain(refs: DataFrame) -> DataFrame:
    """channel, root, prefix of each row of (channel, target, prefix), prefixes joined along the way. The known part of every chain
    doubles in each round, so a chain of n references takes about log2(n) joins."""
    cur = refs.select("channel", F.col("target").alias("root"), "prefix")
    for _ in range(MAX_DOUBLINGS):
        far = cur.select(F.col("channel").alias("root"), F.col("root").alias("far"), F.col("prefix").alias("more"))
        far = far.join(cur.select("root").distinct(), "root", "left_semi")  # most rows are referred to by none
        joined = cut(cur.join(far, "root", "left"), "chain")
        cur = joined.select("channel", F.coalesce("far", "root").alias("root"), F.concat("prefix", F.coalesce("more", F.lit(""))).alias("prefix"))
        if joined.where("far is not null").isEmpty():
            return cur
    raise ValueError("channels refer to each other in a circle")


def processable(dims: str, least: int, second: int) -> Column:
    """Whether an array of dimensions has two or three of them and begins with these two."""
    return F.size(dims).between(2, 3) & (F.get(dims, F.lit(0)) == least) & (F.get(dims, F.lit(1)) == second)


def process_some(channels: DataFrame, which: Column, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work on the channels that `which` holds for; all others, nulls included, pass. The order is the column `ord`, sorted when read."""
    yes = F.coalesce(which, F.lit(False))
    return work(channels.where(yes)).unionByName(channels.where(~yes))


def with_geometry(channels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Channels whose `axis` is among those of wanted."""
    return channels.join(wanted.select("axis").distinct(), "axis", "left_semi")


def scales(textures: DataFrame, scaling: DataFrame) -> DataFrame:
    """textures with lower and whole of their texture (a leading # doesn't count); 0 and 1 where none is given. Of repeated scalings one counts."""
    s = scaling.dropDuplicates(["texture"]).select(F.col("texture").alias("name"), "lower", "whole")
    j = textures.withColumn("name", F.regexp_replace("texture", "^#", "")).join(s, "name", "left").drop("name")
    return j.withColumns({"lower": F.coalesce("lower", F.lit(0.0)), "whole": F.coalesce("whole", F.lit(1.0))})


def replace_surfaces(old: DataFrame, new: DataFrame) -> DataFrame:
    """part, ord, old_mesh, new_mesh of surfaces (part, ord, mesh) matched by order; raises where a surface lacks its partner."""
    j = old.select("part", "ord", F.col("mesh").alias("old_mesh")).join(new.select("part", "ord", F.col("mesh").alias("new_mesh")), ["part", "ord"], "full")
    lone = F.col("old_mesh").isNull() | F.col("new_mesh").isNull()
    checked = F.when(lone, F.raise_error(F.concat(F.lit("surfaces of a part differ in number: "), F.col("part").cast("string"))).cast("string"))
    return j.where(checked.isNull())


def largest_pattern(found: DataFrame) -> DataFrame:
    """image, nx, ny of the pattern of most points of those found (image, nx, ny, found)."""
    return found.where("found").groupBy("image").agg(F.max_by(F.struct("nx", "ny"), F.col("nx") * F.col("ny")).alias("p")).select("image", "p.nx", "p.ny")


def landmark_pairs(image: DataFrame, part: DataFrame, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """(name, px, py, x, y, z of landmarks of both an image (name, px, py) and a part (name, x, y, z), names of the image's that the part lacks).
    There are no pairs at all if fewer than `least` match. Names are unique in each."""
    j = image.select("name", "px", "py").join(part.select("name", "x", "y", "z"), "name")
    enough = j.agg((F.count("*") >= least).alias("enough"))
    return j.crossJoin(F.broadcast(enough)).where("enough").drop("enough"), image.select("name").join(part, "name", "left_anti")  # enough is one row
