"""Calibration images as records: parameters of the picture and its pattern, the pattern's points and their places in the picture, to XML
and back, with what can't be read set apart.

Defined results: tag prefixes are ignored; a text that is null, no XML, has a parameter of an unknown name, a parameter that its type can't
read, points that are no whole triples or pairs, or as many object as image points is a row of the rejects and says why; points that are
missing stay null; repeated ids stay; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: The parameters' tags with their types, and the names of pattern flags.
TEXTS = ("channel_name", "pattern_type")
NUMBERS = {"frame_number": "int", "offset": "double", "units_per_intensity": "double", "pattern_num_x": "int", "pattern_num_y": "int"}
OTHERS = ("input", "invert", "cvflags", "pattern_spacing")
FLAGS = ("CALIB_CB_ADAPTIVE_THRESH", "CALIB_CB_NORMALIZE_IMAGE", "CALIB_CB_FILTER_QUADS", "CALIB_CB_FAST_CHECK", "CALIB_CB_CLUSTERING")
_ARRAY = "struct<arrayshape: string, arraydata: string>"
_PARAMS = ", ".join([*(f"{c}: string" for c in (*TEXTS, *NUMBERS, "invert", "cvflags")), "input: struct<_href: string>", "pattern_spacing: struct<_VALUE: string, _units: string>"])
_RECORD = f"calibration_image_params struct<{_PARAMS}>, object_points {_ARRAY}, image_points {_ARRAY}, image_points_timestamp string, broken string"
_POINT = {3: "array<struct<x: double, y: double, z: double>>", 2: "array<struct<x: double, y: double>>"}


def write_images(records: DataFrame) -> DataFrame:
    """id, text from records (id, input, channel_name, frame_number, offset, units_per_intensity, invert, cvflags array, pattern_type,
    pattern_num_x, pattern_num_y, pattern_spacing, spacing_units, object_points array of x, y, z, image_points array of x, y, at)."""
    params = F.struct(
        F.when(F.col("input").isNotNull(), F.struct(F.col("input").alias("_href"))).alias("input"),
        *(F.col(c) for c in (*TEXTS, *NUMBERS)),
        F.when(F.col("invert"), "True").when(~F.col("invert"), "False").alias("invert"),
        F.when(F.size("cvflags") > 0, F.array_join("cvflags", "|")).alias("cvflags"),
        F.when(F.col("pattern_spacing").isNotNull(), F.struct(F.col("pattern_spacing").cast("string").alias("_VALUE"), F.col("spacing_units").alias("_units"))).alias("pattern_spacing"),
    )

    def points(c: str, axes: str) -> Column:
        data = F.array_join(F.flatten(F.transform(c, lambda p: F.array(*(p[a].cast("string") for a in axes)))), " ")
        return F.when(F.col(c).isNotNull(), F.struct(F.concat(F.size(c).cast("string"), F.lit(f" {len(axes)}")).alias("arrayshape"), data.alias("arraydata"))).alias(c)

    record = F.struct(params.alias("calibration_image_params"), points("object_points", "xyz"), points("image_points", "xy"), F.col("at").alias("image_points_timestamp"))
    return records.select("id", F.to_xml(record, {"rowTag": "calibration_image"}).alias("text"))


def _points(c: Column, n: int) -> Column:
    """points, and whether the text is fit, of an array's text, as a struct. The text is taken apart once, not for each number."""
    axes = "xyz"[:n]
    words = F.transform(F.filter(F.split(c["arraydata"], r"\s+"), lambda w: w != ""), lambda w: w.try_cast("double"))

    def of(numbers: Column) -> Column:
        fit = (F.size(numbers) % n == 0) & ~F.exists(numbers, lambda x: x.isNull())
        at = lambda i, k: F.get(numbers, i * n + k)
        many = F.size(numbers) / n
        rows = F.when(many >= 1, F.transform(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0)).cast("int")), lambda i: F.struct(*(at(i, k).alias(a) for k, a in enumerate(axes))))).otherwise(F.array().cast(_POINT[n]))
        return F.struct(F.when(c.isNotNull() & c["arraydata"].isNotNull(), rows).alias("points"), F.coalesce(fit, F.lit(True)).alias("fit"))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def read_images(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records as write_images takes them, rejects: id, reason) from (id, text)."""
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "valueTag": "_VALUE"}
    inside = F.regexp_extract("text", r"(?s)<(?:[\w.-]+:)?calibration_image_params\b[^>]*>(.*)</(?:[\w.-]+:)?calibration_image_params\s*>", 1)
    tags = F.array_distinct(F.regexp_extract_all(inside, F.lit(r"<(?:[\w.-]+:)?([\w.-]+)"), F.lit(1)))
    unknown = F.array_except(tags, F.array(*map(F.lit, (*TEXTS, *NUMBERS, *OTHERS))))
    r = F.from_xml("text", _RECORD, options)
    r = texts.select("id", F.col("text").isNull().alias("none"), r.alias("r"), unknown.alias("unknown"))
    r = r.select("id", "none", "unknown", *(F.col("r")[c].alias(c) for c in ("calibration_image_params", "image_points_timestamp")), (F.col("r").isNull() | F.col("r")["broken"].isNotNull()).alias("broken"), _points(F.col("r")["object_points"], 3).alias("solid"), _points(F.col("r")["image_points"], 2).alias("flat"))
    r = cut(r, "calibration-images")  # parsed once, without the texts
    p = F.col("calibration_image_params")
    flags = F.filter(F.split(F.trim(p["cvflags"]), r"\|"), lambda f: f != "")
    numbers = {c: F.trim(p[c]).try_cast(kind) for c, kind in NUMBERS.items()}
    spacing = F.trim(p["pattern_spacing"]["_VALUE"]).try_cast("double")
    (solid, fit3), (flat, fit2) = ((F.col(c)["points"], F.col(c)["fit"]) for c in ("solid", "flat"))
    wrong = lambda raw, value: F.trim(raw).isNotNull() & (F.trim(raw) != "") & value.isNull()
    bad = F.filter(F.array(*(F.when(wrong(p[c], v), F.lit(c)) for c, v in numbers.items()), F.when(wrong(p["pattern_spacing"]["_VALUE"], spacing), F.lit("pattern_spacing"))), lambda x: x.isNotNull())
    other = F.array_except(F.coalesce(flags, F.array().cast("array<string>")), F.array(*map(F.lit, FLAGS)))
    reason = (
        F.when(F.col("none") | F.col("broken") | p.isNull(), "no calibration image")
        .when(F.size("unknown") > 0, F.concat(F.lit("unknown parameter: "), F.array_join("unknown", ", ")))
        .when(F.size(bad) > 0, F.concat(F.lit("not a number: "), F.array_join(bad, ", ")))
        .when(F.size(other) > 0, F.concat(F.lit("unknown flag: "), F.array_join(other, ", ")))
        .when(~fit3, "object points are no triples")
        .when(~fit2, "image points are no pairs")
        .when(solid.isNotNull() & flat.isNotNull() & (F.size(solid) != F.size(flat)), "as many object points as image points are needed")
    )
    out = r.withColumn("reason", reason)
    good = out.where("reason is null").select(
        "id",
        p["input"]["_href"].alias("input"),
        *(p[c].alias(c) for c in TEXTS),
        *(v.alias(c) for c, v in numbers.items()),
        F.lower(F.trim(p["invert"])).isin("true", "yes").alias("invert"),
        F.coalesce(flags, F.array().cast("array<string>")).alias("cvflags"),
        spacing.alias("pattern_spacing"),
        p["pattern_spacing"]["_units"].alias("spacing_units"),
        solid.alias("object_points"),
        flat.alias("image_points"),
        F.col("image_points_timestamp").alias("at"),
    )
    return good, out.where("reason is not null").select("id", "reason")


def appended(images: DataFrame, more: DataFrame) -> DataFrame:
    """A set of images with more of them; an image whose id the set has already is left out of `more`."""
    return images.unionByName(more.join(images.select("id").distinct(), "id", "left_anti"))


def coverage(images: DataFrame, width: float, height: float, n: int, m: int) -> DataFrame:
    """cx, cy, points, images: how many image points of how many images are in each cell of an n x m division of the picture; points beside it and
    cells without points are left out."""
    p = images.select("id", F.explode("image_points").alias("p")).where(f"p.x >= 0 and p.x < {float(width)} and p.y >= 0 and p.y < {float(height)}")
    cell = {"cx": F.floor(F.col("p.x") * n / float(width)).cast("int"), "cy": F.floor(F.col("p.y") * m / float(height)).cast("int")}
    return p.withColumns(cell).groupBy("cx", "cy").agg(F.count("*").alias("points"), F.count_distinct("id").alias("images"))
