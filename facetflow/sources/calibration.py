"""Camera calibration records as XML texts, and landmark lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The record's tags. Arrays hold a shape and numbers parted by white space, row by row.
_ARRAY = "struct<arrayshape: string, arraydata: string>"
_RECORD = f"sizex string, sizey string, cameramatrix {_ARRAY}, distcoeffs {_ARRAY}, reprojection_error string, calculationtimestamp string, broken string"


def _doubles(text):
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: w.try_cast("double"))


def read_intrinsics(texts: DataFrame) -> DataFrame:
    """id, sizex, sizey, k (9 doubles), dist (5), error, at, ok from (id, text). Tag prefixes are ignored. A record that can't be read
    or lacks its sizes or 9 and 5 numbers is kept with ok = false."""
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    r = texts.select("id", F.from_xml("text", _RECORD, options).alias("r"))
    k, dist = _doubles(F.col("r.cameramatrix.arraydata")), _doubles(F.col("r.distcoeffs.arraydata"))
    full = lambda a, n: (F.size(a) == n) & ~F.exists(a, lambda x: x.isNull())
    out = r.select("id", F.trim("r.sizex").try_cast("int").alias("sizex"), F.trim("r.sizey").try_cast("int").alias("sizey"), k.alias("k"), dist.alias("dist"), F.trim("r.reprojection_error").try_cast("double").alias("error"), F.trim("r.calculationtimestamp").alias("at"))
    return out.withColumn("ok", F.coalesce(F.col("sizex").isNotNull() & F.col("sizey").isNotNull() & full(F.col("k"), 9) & full(F.col("dist"), 5), F.lit(False)))


def write_intrinsics(records: DataFrame) -> DataFrame:
    """id, text from (id, sizex, sizey, k, dist, error, at)."""
    array = lambda c, shape: F.struct(F.lit(shape).alias("arrayshape"), F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias("arraydata"))
    record = F.struct("sizex", "sizey", array("k", "3 3").alias("cameramatrix"), array("dist", "1 5").alias("distcoeffs"), F.col("error").alias("reprojection_error"), F.col("at").alias("calculationtimestamp"))
    return records.select("id", F.to_xml(record, {"rowTag": "intrinsic_calibration"}).alias("text"))


def landmark_lines(texts: DataFrame) -> DataFrame:
    """The columns of texts but value, and name, x, y of each line `LANDMARK NAME (x,y)`; other lines are left out."""
    number = r"\s*([-+0-9.eE]+)\s*"
    found = F.regexp_extract_all("value", F.lit(r"^\s*LANDMARK\s+(\S+)\s+\(" + number + "," + number + r"\)\s*$"), F.lit(0))
    part = lambda i: F.regexp_extract("value", r"^\s*LANDMARK\s+(\S+)\s+\(" + number + "," + number + r"\)\s*$", i)
    t = texts.where(F.size(found) == 1)
    return t.select(*(c for c in texts.columns if c != "value"), part(1).alias("name"), part(2).try_cast("double").alias("x"), part(3).try_cast("double").alias("y"))
