"""Curvature tensors on facets: made from corners' principal curvatures, taken to any point, and summed along lines.

A tensor is symmetric in a facet's in-plane basis (t11, t12, t22); in texture coordinates it is the shape operator c11, c12, c21, c22, so that
for a unit step n along a line n.c.n is the curvature along it and, with n turned a quarter, that across it.

Defined results: a point whose facet lacks the curvature of any corner has nulls, and so has what a line sums over it; facets without texture
area have null tensors there; a line of no length has the eigenvalues at its place; steps off a raster add their plain length and no
curvature; lines with a null end are left out; repeated lines of one name are summed; empty tables give empty results; extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..session import cut, dealt
from . import uv
from .mesh import FACET
from .surface import mirrored_pieces, tensor_at

#: Cells of a raster that are sent to all tasks; those of more are dealt by cell.
SENT = 1_000_000


def corner_tensors(ring: DataFrame, bent: DataFrame, facet_frames: DataFrame) -> DataFrame:
    """mesh, facet, x, y, z, t11, t12, t22 of every corner (mesh, facet, k, vid, x, y, z): V K V^T of its vertex's principal curvatures k1, k2
    (bent: mesh, vid, k1, k2, tangents ax .. bz), the tangents laid into the facet's plane and made unit vectors."""
    j = ring.select("mesh", "facet", "vid", "x", "y", "z").join(dealt(bent.select("mesh", "vid", "k1", "k2", *(a + c for a in "ab" for c in "xyz"))), ["mesh", "vid"], "left")
    j = j.join(dealt(facet_frames.select(*FACET, *(a + c for a in "ef" for c in "xyz"))), list(FACET))
    sides = {}
    for a in "ab":
        p, q = vec.dot(vec.vec(a), vec.vec("e")), vec.dot(vec.vec(a), vec.vec("f"))
        size = F.nullif(F.hypot(p, q), F.lit(0.0))
        sides |= {a + "1": F.try_divide(p, size), a + "2": F.try_divide(q, size)}
    j = j.withColumns(sides)
    c = F.col
    t = lambda m, n: (c("k1") * c("a" + m) * c("a" + n) + c("k2") * c("b" + m) * c("b" + n)).alias(f"t{m}{n}")
    return j.select(*FACET, "x", "y", "z", t("1", "1"), t("1", "2"), t("2", "2"))


def texture_tensors(points: DataFrame, corners: DataFrame, facet_frames: DataFrame) -> DataFrame:
    """mesh, facet, id, c11, c12, c21, c22 at points (mesh, facet, id, u, v), from corner_tensors: means by inverse distance, in texture
    coordinates (a t a^-1 of the facet's fit a)."""
    at = cut(uv.to_xyz(points.select(*FACET, "id", "u", "v"), facet_frames).select("id", *FACET, "x", "y", "z"), "tensor-points")
    t = tensor_at(at, corners)
    j = at.select("id", *FACET).join(dealt(t), "id").join(dealt(facet_frames.select(*FACET, *(k + n for k in "ai" for n in ("11", "12", "21", "22")))), list(FACET))
    c = F.col
    m = {"11": c("a11") * c("t11") + c("a12") * c("t12"), "12": c("a11") * c("t12") + c("a12") * c("t22"), "21": c("a21") * c("t11") + c("a22") * c("t12"), "22": c("a21") * c("t12") + c("a22") * c("t22")}
    out = {f"c{i}{k}": m[i + "1"] * c("i1" + k) + m[i + "2"] * c("i2" + k) for i in "12" for k in "12"}
    return j.select(*FACET, "id", *(e.alias(n) for n, e in out.items()))


def _along(du, dv) -> tuple:
    """(curvature along, curvature across) for a direction, from c11 .. c22; null for none."""
    c, size = F.col, F.nullif(F.hypot(du, dv), F.lit(0.0))
    a, b = F.try_divide(du, size), F.try_divide(dv, size)
    form = lambda x, y: x * (c("c11") * x + c("c12") * y) + y * (c("c21") * x + c("c22") * y)
    return form(a, b), form(b, -a)


def _steps(lines: DataFrame, du: float, dv: float) -> DataFrame:
    """The midpoints u, v of the 1 + floor of a segment's length in steps of du and dv, with su, sv of a step."""
    a, b = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    s = lines.dropna(subset=["u1", "v1", "u2", "v2"]).withColumn("steps", F.floor(1 + F.sqrt(a / du * (a / du) + b / dv * (b / dv))).cast("int"))
    s = s.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    t = (F.col("step") + 0.5) / F.col("steps")
    return s.withColumns({"u": F.col("u1") + t * a, "v": F.col("v1") + t * b, "su": a / F.col("steps"), "sv": b / F.col("steps")})


def _sums(steps: DataFrame, *key: str) -> DataFrame:
    """key, steps, length, curvature, cross from rows (along, bend, across, k1, k2, lost): means by length; eigenvalues where there is none."""
    lost = F.bool_or("lost")
    length = F.sum("along")
    mean = lambda c, still: F.when(lost, F.lit(None)).when(length > 0, F.sum(F.col(c) * F.col("along")) / length).otherwise(F.max(still))
    return steps.groupBy(*key).agg(F.count("*").cast("int").alias("steps"), F.when(~lost, length).alias("length"), mean("bend", "k1").alias("curvature"), mean("across", "k2").alias("cross"))


def facet_line_curvature(lines: DataFrame, leaves: DataFrame, facet_frames: DataFrame, corners: DataFrame, du: float, dv: float) -> DataFrame:
    """mesh, line, steps, length, curvature, cross of segments (mesh, line, u1, v1, u2, v2), facet by facet: null where a midpoint is on no facet
    or on one that lacks a curvature."""
    p = _steps(lines.select("mesh", "line", "u1", "v1", "u2", "v2"), du, dv).select("mesh", F.struct("line", "step").alias("id"), "u", "v", "su", "sv")
    p = cut(p, "midpoints")
    at = cut(uv.locate(p.select("mesh", "id", "u", "v"), leaves), "located")
    key = F.struct("mesh", "id").alias("id")
    bent = texture_tensors(at.where("facet is not null").select("mesh", "facet", key, "u", "v"), corners, facet_frames)
    bent = bent.select(F.col("id")["mesh"].alias("mesh"), F.col("id")["id"].alias("id"), "facet", "c11", "c12", "c21", "c22")
    c = F.col
    j = p.join(dealt(bent), ["mesh", "id"], "left").join(dealt(facet_frames.select(*FACET, "i11", "i12", "i21", "i22")), list(FACET), "left")
    along = F.hypot(c("i11") * c("su") + c("i12") * c("sv"), c("i21") * c("su") + c("i22") * c("sv"))
    bend, across = _along(c("su"), c("sv"))
    k1, k2 = vec.eigvals2(c("c11"), c("c12"), c("c21"), c("c22"))
    rows = j.select("mesh", c("id.line").alias("line"), along.alias("along"), bend.alias("bend"), across.alias("across"), k1.alias("k1"), k2.alias("k2"), c("c11").isNull().alias("lost"))
    return _sums(rows, "mesh", "line")


def _raster_steps(lines: DataFrame, raster: DataFrame, nu: int, nv: int, du: float, dv: float, *key: str) -> DataFrame:
    """Rows for _sums of segments (key, u1, v1, u2, v2) over the nu x nv raster (ix, iy, c11 .. c22, su and sv: how long a cell is)."""
    c = F.col
    s = _steps(lines, du, dv).withColumns({"ix": F.floor(c("u") * nu).cast("int"), "iy": F.floor(c("v") * nv).cast("int")})
    r = raster.select("ix", "iy", "c11", "c12", "c21", "c22", c("su").alias("wide"), c("sv").alias("high"))
    if nu * nv <= SENT:
        r = F.broadcast(r)  # steps are many more than cells: they stay where they are, and only sums by line are shuffled
    on = F.when((c("u") >= 0) & (c("v") >= 0) & c("wide").isNotNull(), F.lit(True))
    j = s.select(*key, "ix", "iy", "u", "v", "su", "sv").join(r, ["ix", "iy"], "left")
    bend, across = _along(c("su"), c("sv"))
    k1, k2 = vec.eigvals2(c("c11"), c("c12"), c("c21"), c("c22"))
    along = F.when(on, F.hypot(c("wide") * c("su") * nu, c("high") * c("sv") * nv)).otherwise(F.hypot("su", "sv"))
    none = F.lit(0.0)
    return j.select(*key, along.alias("along"), *(F.when(on, e).otherwise(none).alias(n) for n, e in (("bend", bend), ("across", across), ("k1", k1), ("k2", k2))), (F.coalesce(on, F.lit(False)) & c("c11").isNull()).alias("lost"))


def _theta():
    return F.atan2(F.col("v2") - F.col("v1"), F.col("u2") - F.col("u1"))


def raster_line_curvature(lines: DataFrame, raster: DataFrame, nu: int, nv: int, du: float, dv: float) -> DataFrame:
    """line, steps, length, curvature, cross, theta of segments (line, u1, v1, u2, v2) over a raster of the unit square."""
    out = _sums(_raster_steps(lines.select("line", "u1", "v1", "u2", "v2"), raster, nu, nv, du, dv, "line"), "line")
    return out.join(lines.groupBy("line").agg(F.max(_theta()).alias("theta")), "line")


def mirrored_line_curvature(lines: DataFrame, raster: DataFrame, nu: int, nv: int, du: float, dv: float) -> DataFrame:
    """The columns of raster_line_curvature for segments that the unit square's sides reflect: cut at the sides, pieces outside folded back,
    and summed; theta is that of the whole segment."""
    pieces = mirrored_pieces(lines.select("line", "u1", "v1", "u2", "v2"))
    out = _sums(_raster_steps(pieces, raster, nu, nv, du, dv, "line"), "line")
    return out.join(lines.groupBy("line").agg(F.max(_theta()).alias("theta")), "line")
