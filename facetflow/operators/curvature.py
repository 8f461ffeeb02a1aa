"""Principal curvatures of mesh vertices from the points two edges around them.

A surface is fitted to the points by moments: Spark brings a vertex's points together, tasks sum the products of powers of their places in the vertex's
basis and solve the normal equations of a batch of vertices at once.

Defined results: a vertex without facets or normal, or whose points all lie on its normal, has nulls; where the points don't determine
a fit, that with the smallest coefficients counts; repeated vertices of one number are an error of the caller's; empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..session import dealt, ship

#: Powers of x and y in the fitted surface.
POWERS = [(i, j) for i in range(3) for j in range(3)]
#: What is summed: x^i y^j, and z times them; the largest reach scales all.
MOMENTS = [(i, j) for i in range(5) for j in range(5)]


def solve_fits(moments: np.ndarray, heights: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Larger and smaller curvature (n x 2), positive where the surface bends to its normal, from sums of x^i y^j (n x 25), of z x^i y^j
    (n x 9), both with the vertex itself at 0, and the largest |x| or |y|."""
    s = np.where(size > 0, size, 1.0)[:, None]
    m = moments / s ** [i + j for i, j in MOMENTS]
    h = heights / s ** [i + j + 1 for i, j in POWERS]
    at = {p: k for k, p in enumerate(MOMENTS)}
    a = np.stack([np.stack([m[:, at[i + k, j + l]] for k, l in POWERS], 1) for i, j in POWERS], 1)
    fit = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=1e-11, hermitian=True), h)
    c = {p: fit[:, k] for k, p in enumerate(POWERS)}
    p, q, r, t, w = c[1, 0], c[0, 1], 2 * c[2, 0], c[1, 1], 2 * c[0, 2]
    grow = 1 + p * p + q * q
    mean = ((1 + q * q) * r - 2 * p * q * t + (1 + p * p) * w) / (2 * grow**1.5)
    gauss = (r * w - t * t) / grow**2
    off = np.sqrt(np.maximum(mean * mean - gauss, 0.0))
    out = np.stack((mean + off, mean - off), 1) / s
    out[~(size > 0)] = np.nan
    return out


def principal(normal: np.ndarray, offsets: np.ndarray) -> tuple[float, float]:
    """Larger and smaller curvature of one vertex with its normal and the places of the points around it."""
    n = normal / np.linalg.norm(normal)
    a = np.cross(n, np.eye(3)[np.argmin(np.abs(n))])
    a /= np.linalg.norm(a)
    x, y, z = (offsets @ np.stack((a, np.cross(n, a), n), axis=1)).T
    m = np.array([[(x**i * y**j).sum() + (i + j == 0) for i, j in MOMENTS]])
    return tuple(solve_fits(m, np.array([[(z * x**i * y**j).sum() for i, j in POWERS]]), np.array([max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))]))[0].tolist())


def _fits(batches):
    """Batches (mesh, vid, n, o as x, y, z, near: points with repeats) to mesh, vid, k1, k2: places in the basis of the normal, their moments, the fits."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        n, o = (np.stack([b.column(a + c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1) for a in "no")
        near = b.column("near")
        points = near.flatten()
        row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False))
        there = np.all([pc.is_valid(points.field(c)).to_numpy(zero_copy_only=False) for c in "xyz"], axis=0)
        size = np.linalg.norm(n, axis=1)
        points, row = points.filter(pa.array(there & (size[row] > 0))), row[there & (size[row] > 0)]
        other = points.field("vid").to_numpy(zero_copy_only=False)
        order = np.lexsort((other, row))
        row, other = row[order], other[order]
        once = other != b.column("vid").to_numpy(zero_copy_only=False)[row]
        once[1:] &= (row[1:] != row[:-1]) | (other[1:] != other[:-1])
        order, row = order[once], row[once]
        k = np.full((len(b), 2), np.nan)
        if len(row):
            d = np.stack([points.field(c).to_numpy(zero_copy_only=False)[order] for c in "xyz"], 1) - o[row]
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            some = row[start]
            n = n[some] / size[some, None]
            u = np.cross(n, np.eye(3)[np.argmin(np.abs(n), axis=1)])  # the axis that the normal is farthest from
            u /= np.linalg.norm(u, axis=1)[:, None]
            at = np.repeat(np.arange(len(some)), np.diff(np.r_[start, len(row)]))
            x, y, z = ((d * w[at]).sum(1) for w in (u, np.cross(n, u), n))
            total = lambda c: np.add.reduceat(c, start)
            m = np.stack([total(x**i * y**j) + (i + j == 0) for i, j in MOMENTS], 1)
            h = np.stack([total(z * x**i * y**j) for i, j in POWERS], 1)
            k[some] = solve_fits(m, h, np.maximum.reduceat(np.maximum(np.abs(x), np.abs(y)), start))
        yield pa.RecordBatch.from_arrays([b.column("mesh"), b.column("vid"), pa.array(k[:, 0], from_pandas=True), pa.array(k[:, 1], from_pandas=True)], ["mesh", "vid", "k1", "k2"])


def vertex_curvature(vertices: DataFrame, corners: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """mesh, vid, k1, k2 (k1 >= k2) of the wanted vertices (mesh, vid), or of all; null for a vertex without facets or normal.

    The normal sums the cross products of a vertex's edges, facet by facet. A vertex sends the points around it to each of these, so that all within two
    edges meet theirs. Rows meet in windows and groups and not by joins, each of which would shuffle them: with tables dealt by mesh (or by less) nothing
    moves any more; others are shuffled by facet and by vertex, however large a mesh is."""
    ship(vertices.sparkSession)
    v, place = vec.vec, ["x", "y", "z"]
    own = Window.partitionBy("mesh", "vid")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    c = corners.where("mesh is not null").select("mesh", "vid", "facet", "k", *(none(vertices, a) for a in place), F.lit(True).alias("corner"))
    c = c.unionByName(vertices.where("mesh is not null and vid is not null").select("mesh", "vid", none(corners, "facet"), none(corners, "k"), *place, F.lit(False).alias("corner")))
    c = c.withColumns({"o" + a: F.max(a).over(own) for a in place}).where("corner")

    ring = Window.partitionBy("mesh", "facet").orderBy("k")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct("vid", *(F.col("o" + a).alias(a) for a in place))
    sides = F.array(F.coalesce(F.lead(point).over(ring), F.first(point).over(whole)), F.coalesce(F.lag(point).over(ring), F.last(point).over(whole)))
    e = c.select("mesh", "facet", "vid", *("o" + a for a in place), sides.alias("sides")).where("vid is not null")
    e = e.select("mesh", "facet", "vid", *("o" + a for a in place), F.posexplode("sides").alias("side", "p")).where("p.vid is not null")
    # the cross products of all next with all last vertices of a corner are that of their sums
    turn = [F.sum(F.when(F.col("side") == s, F.col("p." + a) - F.col("o" + a))).alias(f"{w}{a}") for s, w in enumerate("ab") for a in place]
    f = e.groupBy("mesh", "facet", "vid", *("o" + a for a in place)).agg(*turn, F.collect_set("p").alias("p"))
    f = f.select("mesh", "vid", *("o" + a for a in place), *(F.when(F.col("facet").isNotNull(), n).alias("n" + a) for a, n in zip(place, vec.cross(v("a"), v("b")))), F.posexplode("p").alias("i", "p"))
    normal = [F.sum(F.when(F.col("i") == 0, F.col("n" + a))).alias("n" + a) for a in place]
    around = f.groupBy("mesh", "vid", *("o" + a for a in place)).agg(*normal, F.collect_set("p").alias("near"))

    to = F.explode(F.array_union(F.array("vid"), F.col("near.vid"))).alias("to")
    sent = around.select("mesh", F.col("vid").alias("mid"), *("n" + a for a in place), *("o" + a for a in place), "near", to)
    mine = F.col("to") == F.col("mid")
    sent = sent.select("mesh", F.col("to").alias("vid"), *(F.when(mine, F.col(w + a)).alias(w + a) for w in "no" for a in place), "near", F.lit(False).alias("asked"))
    every = (vertices if wanted is None else wanted).select("mesh", "vid")
    if wanted is not None:
        sent = sent.join(dealt(every.distinct()), ["mesh", "vid"], "left_semi")
    asked = every.select("mesh", "vid", *(F.lit(None).cast("double").alias(w + a) for w in "no" for a in place), F.lit(None).cast(sent.schema["near"].dataType).alias("near"), F.lit(True).alias("asked"))
    g = sent.unionByName(asked).groupBy("mesh", "vid").agg(*(F.max(w + a).alias(w + a) for w in "no" for a in place), F.flatten(F.collect_list("near")).alias("near"), F.bool_or("asked").alias("asked"))
    kinds = {c: g.schema[c].dataType.simpleString() for c in ("mesh", "vid")}
    out = g.where("asked").drop("asked").mapInArrow(_fits, f"mesh {kinds['mesh']}, vid {kinds['vid']}, k1 double, k2 double")
    return out.withColumns({k: F.nullif(F.col(k), F.lit(float("nan"))) for k in ("k1", "k2")})
