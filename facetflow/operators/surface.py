"""Surface measures: in-plane frames and texture fits of facets, curvature, and line means in a mirrored box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..session import dealt
from .mesh import FACET, centroids, normals
from .project import line_means


def texture_fit(ring: DataFrame) -> DataFrame:
    """mesh, facet, a11, a12, a21, a22, u0, v0: (u, v) = a (p, q) + (u0, v0) by least squares over a facet's corners, where p runs along
    the first edge and q is normal to it in the plane, both from the centroid. ring: mesh, facet, k, x, y, z, u, v. All are null for a
    degenerate facet."""
    first = F.min(F.struct("k", "x", "y", "z"))
    second = F.min(F.when(F.col("k") > 0, F.struct("k", "x", "y", "z")))
    edge = ring.groupBy(*FACET).agg(first.alias("a"), second.alias("b")).select(*FACET, *((F.col(f"b.{c}") - F.col(f"a.{c}")).alias("e" + c) for c in "xyz"))
    r = ring.join(dealt(centroids(ring)), list(FACET)).join(dealt(normals(ring)), list(FACET)).join(dealt(edge), list(FACET))
    e = vec.unit(vec.vec("e"))
    d = vec.sub(vec.vec(), vec.vec("c"))
    r = r.select(*FACET, "u", "v", vec.dot(d, e).alias("p"), vec.dot(d, vec.cross(vec.vec("n"), e)).alias("q"))
    s = r.groupBy(*FACET).agg(F.avg("u").alias("u0"), F.avg("v").alias("v0"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("pp", "pq", "qq", "pu", "qu", "pv", "qv")))
    c = F.col
    det = F.nullif(c("pp") * c("qq") - c("pq") * c("pq"), F.lit(0.0))
    solve = lambda w: (F.try_divide(c("p" + w) * c("qq") - c("q" + w) * c("pq"), det), F.try_divide(c("q" + w) * c("pp") - c("p" + w) * c("pq"), det))
    (a11, a12), (a21, a22) = solve("u"), solve("v")
    return s.select(*FACET, a11.alias("a11"), a12.alias("a12"), a21.alias("a21"), a22.alias("a22"), *(F.when(det.isNotNull(), c(n)).alias(n) for n in ("u0", "v0")))


def shape_operator(e: Column, f: Column, g: Column, l: Column, m: Column, n: Column) -> tuple[Column, Column, Column, Column]:  # noqa: E741
    """The 2 x 2 shape operator of the first (e, f, g) and second (l, m, n) fundamental forms; null where the first is singular."""
    det = F.nullif(e * g - f * f, F.lit(0.0))
    return tuple(F.try_divide(x, det) for x in (g * l - f * m, g * m - f * n, e * m - f * l, e * n - f * m))


def tensor_at(points: DataFrame, corners: DataFrame) -> DataFrame:
    """id and the mean of the corners' tensors t11, t12, t22 by 1 / (d + largest d / 10^4); null if a corner lacks its tensor.

    points: id, mesh, facet, x, y, z. corners: mesh, facet, x, y, z, t11, t12, t22. Where all corners lie on the point, they count alike."""
    d = vec.norm(vec.sub(vec.vec("p"), vec.vec("")))
    j = points.select("id", *FACET, *(F.col(c).alias("p" + c) for c in "xyz")).join(dealt(corners), list(FACET)).withColumn("d", d)
    j = j.join(dealt(j.groupBy("id").agg(F.max("d").alias("far"))), "id")
    w = F.when(F.col("far") == 0, 1.0).otherwise(F.try_divide(F.lit(1.0), F.col("d") + F.col("far") / 1e4))
    missing = F.bool_or(F.col("t11").isNull() | F.col("t12").isNull() | F.col("t22").isNull() | F.isnan("t11") | F.isnan("t12") | F.isnan("t22"))
    return j.withColumn("w", w).groupBy("id").agg(*(F.when(~missing, F.sum(F.col("w") * F.col(t)) / F.sum("w")).alias(t) for t in ("t11", "t12", "t22")))


def mirrored_pieces(lines: DataFrame) -> DataFrame:
    """line, piece, u1, v1, u2, v2: segments cut where they cross a side of the unit square, pieces outside folded back by one reflection."""
    du, dv = F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1")
    cross = [F.try_divide(F.lit(float(b)) - F.col(c), F.nullif(d, F.lit(0.0))) for c, d in (("u1", du), ("v1", dv)) for b in (0, 1)]
    times = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.array(*cross), lambda t: (t > 0) & (t < 1)))))
    s = lines.withColumn("times", times).withColumn("piece", F.explode(F.sequence(F.lit(0), F.size("times") - 2)))
    s = s.withColumns({"t0": F.get("times", "piece"), "t1": F.get("times", F.col("piece") + 1)})
    ends = {}
    for c, d in (("u", du), ("v", dv)):
        at = lambda t, c=c, d=d: F.col(c + "1") + t * d
        middle = at((F.col("t0") + F.col("t1")) / 2)
        fold = lambda x, middle=middle: F.when(middle < 0, -x).when(middle > 1, 2 - x).otherwise(x)
        ends |= {c + "1": fold(at(F.col("t0"))), c + "2": fold(at(F.col("t1")))}
    return s.select("line", "piece", *(x.alias(k) for k, x in ends.items()))


def mirrored_line_means(lines: DataFrame, raster: DataFrame, n: int) -> DataFrame:
    """line, pieces, length, mean: the raster's mean along a segment that the unit square's sides reflect, by length.

    Length counts all pieces; pieces that see no raster cell carry no weight in the mean."""
    pieces = mirrored_pieces(lines).select(F.struct("line", "piece").alias("line"), "u1", "v1", "u2", "v2")
    m = line_means(pieces, raster, n)
    seen = F.when(F.col("mean").isNotNull(), F.col("length"))
    return m.groupBy(F.col("line.line").alias("line")).agg(F.count("*").alias("pieces"), F.sum("length").alias("length"), F.try_divide(F.sum(F.col("mean") * F.col("length")), F.nullif(F.sum(seen), F.lit(0.0))).alias("mean"))


def merge_curvatures(tensors: DataFrame, tensor_tolerance: float, normal_tolerance: float, unit: float = 1.0, fallback: DataFrame | None = None) -> DataFrame:
    """vid, k1, k2 (k1 >= k2) of vertices with several tensors (vid, t11, t12, t22, nx, ny, nz): the eigenvalues of the mean tensor, times unit, where
    all tensors and normals are within tolerance of their means; else what fallback (vid, k1, k2) has, or null. A missing value never agrees."""
    names = ("t11", "t12", "t22", "nx", "ny", "nz")
    g = tensors.groupBy("vid").agg(*(F.avg(c).alias(c) for c in names), *(F.min(c).alias("lo_" + c) for c in names), *(F.max(c).alias("hi_" + c) for c in names), F.bool_or(F.lit(False) | F.concat(*(F.col(c).cast("string") for c in names)).isNull()).alias("missing"))
    ok = ~F.col("missing")
    for c in names:
        bound = tensor_tolerance if c[0] == "t" else normal_tolerance
        ok = ok & (F.greatest(F.col("hi_" + c) - F.col(c), F.col(c) - F.col("lo_" + c)) <= bound)
    half, off = (F.col("t11") + F.col("t22")) / 2, (F.col("t11") - F.col("t22")) / 2
    root = F.sqrt(off * off + F.col("t12") * F.col("t12"))
    out = g.select("vid", F.when(ok, (half + root) * unit).alias("k1"), F.when(ok, (half - root) * unit).alias("k2"))
    if fallback is None:
        return out
    f = fallback.select("vid", F.col("k1").alias("f1"), F.col("k2").alias("f2"))
    return out.join(f, "vid", "left").select("vid", F.coalesce("k1", "f1").alias("k1"), F.coalesce("k2", "f2").alias("k2"))


def candidates_inside(vertices: DataFrame, candidates: DataFrame, tolerance: float) -> DataFrame:
    """vid, surface of the candidates (vid, surface, dist, inside) that a vertex is inside of and nearer to than tolerance; one row with a null
    surface where there are none."""
    good = candidates.where((F.col("dist") < tolerance) & F.col("inside")).select("vid", "surface")
    return vertices.select("vid").join(good, "vid", "left")
