"""Surfaces with texture coordinates: adaptive cells, point location, places on facets, splatting by footprints, lines over facets.

Polygons are (mesh, facet, ring of x, y = u, v, and their bounds lo_u, hi_u, lo_v, hi_v).

Defined results: points without coordinates or outside the unit square, and polygons outside it, meet nothing; of several facets that
hold a point the smallest counts; facets without texture area have a null inverse, and so null places; repeated points each get
their row where ids differ; empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import scalars as sc
from ..functions import vec
from ..session import cut, dealt
from .mesh import FACET, centroids, normals


def adaptive_cells(boxes: DataFrame, dims: tuple[str, ...], key: tuple[str, ...], most: int = 6, max_depth: int = 18) -> DataFrame:
    """boxes (key, lo_<d> and hi_<d> from 0 to 1, ...) once for each leaf cell that they overlap: depth, c_<d> (cell number at that depth).

    A cell splits in half along each dimension while it wholly encloses more than `most` boxes; counts are aggregated on the map side, and
    each round is written, so a skewed table costs rounds, not a task."""
    cell = [f"c_{d}" for d in dims]
    cur = boxes
    for d in dims:
        cur = cur.where((F.col(f"lo_{d}") <= 1) & (F.col(f"hi_{d}") >= 0)).withColumn(f"c_{d}", F.lit(0).cast("long"))
    leaves = None
    for depth in range(max_depth + 1):
        inside = F.lit(True)
        for d in dims:
            inside = inside & (F.col(f"lo_{d}") * 2.0**depth >= F.col(f"c_{d}")) & (F.col(f"hi_{d}") * 2.0**depth <= F.col(f"c_{d}") + 1)
        full = cur.groupBy(*key, *cell).agg(F.count_if(inside).alias("n")).where(F.col("n") > most).select(*key, *cell, F.lit(True).alias("split"))
        cur = cut(cur.join(dealt(full), [*key, *cell], "left"), "cells")
        some = F.col("split").isNull() if depth < max_depth else F.lit(True)
        leaf = cur.where(some).drop("split").withColumn("depth", F.lit(depth))
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        cur = cur.where(~some).drop("split")
        if depth == max_depth or cur.isEmpty():
            break
        for d in dims:
            cur = cur.withColumn(f"c_{d}", F.explode(F.array(F.col(f"c_{d}") * 2, F.col(f"c_{d}") * 2 + 1)))
            cur = cur.where((F.col(f"lo_{d}") * 2.0 ** (depth + 1) <= F.col(f"c_{d}") + 1) & (F.col(f"hi_{d}") * 2.0 ** (depth + 1) >= F.col(f"c_{d}")))
    return leaves


def polygons(corners: DataFrame) -> DataFrame:
    """Rings and bounds of (mesh, facet, k, u, v)."""
    p = corners.groupBy(*FACET).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "u", "v"))), lambda q: F.struct(q["u"].alias("x"), q["v"].alias("y"))).alias("ring"),
        *(f(c).alias(n + c) for c in "uv" for f, n in ((F.min, "lo_"), (F.max, "hi_"))),
    )
    return p.where("size(ring) > 2")


def cells(polys: DataFrame, most: int = 6, max_depth: int = 18) -> DataFrame:
    """The polygons of each leaf cell of their mesh's unit square that they touch."""
    c = adaptive_cells(polys, ("u", "v"), ("mesh",), most, max_depth)
    size = F.pow(F.lit(0.5), F.col("depth"))
    u, v = F.col("c_u") * size, F.col("c_v") * size
    return c.where(pr.polygon_touches_box2(F.col("ring"), u, v, u + size, v + size))


def locate(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """points (mesh, id, u, v) with the smallest facet that holds each, null where none does. A point meets the polygons of its leaf cell by
    equi-join, at each depth that there is."""
    leaves = cut(leaves, "leaf-cells")
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most max_depth + 1 numbers
    some = points.where("u between 0 and 1 and v between 0 and 1").withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>")))
    at = lambda c: F.least(F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("depth"))), F.pow(F.lit(2.0), F.col("depth")) - 1).cast("long")
    j = some.withColumns({"c_u": at("u"), "c_v": at("v")}).join(dealt(leaves), ["mesh", "depth", "c_u", "c_v"])
    j = j.where("u between lo_u and hi_u and v between lo_v and hi_v").where(pr.in_polygon(F.col("ring"), F.col("u"), F.col("v")))
    hit = j.groupBy("mesh", "id").agg(F.min("facet").alias("facet"))
    return points.join(dealt(hit), ["mesh", "id"], "left").select("mesh", "id", "u", "v", "facet")


def frames(ring: DataFrame) -> DataFrame:
    """mesh, facet, centroid cx.., in-plane unit vectors ex.. (along the first edge) and fx.., normal nx.., the texture fit (u, v) = a (p, q) +
    (u0, v0) of in-plane coordinates from the centroid (a11, a12, a21, a22) and its inverse (i11, i12, i21, i22; null without texture area).
    ring: mesh, facet, k, x, y, z, u, v."""
    corner = F.struct("k", "x", "y", "z")
    edge = ring.groupBy(*FACET).agg(F.min(corner).alias("a"), F.min(F.when(F.col("k") > 0, corner)).alias("b"))
    edge = edge.select(*FACET, *(e.alias("e" + c) for c, e in zip("xyz", vec.unit(vec.sub(vec.vec("b."), vec.vec("a."))))))
    g = centroids(ring).join(dealt(normals(ring)), list(FACET)).join(dealt(edge), list(FACET))
    g = g.withColumns(dict(zip(("fx", "fy", "fz"), vec.cross(vec.vec("n"), vec.vec("e")))))
    d = vec.sub(vec.vec(), vec.vec("c"))
    r = ring.join(dealt(g), list(FACET)).select(*FACET, "u", "v", vec.dot(d, vec.vec("e")).alias("p"), vec.dot(d, vec.vec("f")).alias("q"))
    s = r.groupBy(*FACET).agg(F.avg("u").alias("u0"), F.avg("v").alias("v0"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("pp", "pq", "qq", "pu", "qu", "pv", "qv")))
    c = F.col
    det = F.nullif(c("pp") * c("qq") - c("pq") * c("pq"), F.lit(0.0))
    fit = {}
    for i, w in (("1", "u"), ("2", "v")):
        fit |= {f"a{i}1": F.try_divide(c("p" + w) * c("qq") - c("q" + w) * c("pq"), det), f"a{i}2": F.try_divide(c("q" + w) * c("pp") - c("p" + w) * c("pq"), det)}
    s = s.select(*FACET, "u0", "v0", *(e.alias(n) for n, e in fit.items()))
    area = F.nullif(c("a11") * c("a22") - c("a12") * c("a21"), F.lit(0.0))
    back = {"i11": F.try_divide("a22", area), "i12": F.try_divide(-c("a12"), area), "i21": F.try_divide(-c("a21"), area), "i22": F.try_divide("a11", area)}
    return g.drop("maxradius", "refsize").join(dealt(s.withColumns(back)), list(FACET))


def to_xyz(points: DataFrame, facet_frames: DataFrame) -> DataFrame:
    """points (mesh, facet, u, v, ...) with x, y, z on the facet."""
    j = points.join(dealt(facet_frames), list(FACET))
    c = F.col
    p = c("i11") * (c("u") - c("u0")) + c("i12") * (c("v") - c("v0"))
    q = c("i21") * (c("u") - c("u0")) + c("i22") * (c("v") - c("v0"))
    return j.select(*(j[n] for n in points.columns), *((c("c" + n) + p * c("e" + n) + q * c("f" + n)).alias(n) for n in "xyz"))


def to_uv(hits: DataFrame, facet_frames: DataFrame, shifts: dict[str, tuple] | None = None) -> DataFrame:
    """hits (mesh, facet, x, y, z, ...) with u, v, and for each named shift of the place (Columns of hits) du_<name>, dv_<name>."""
    j = hits.join(dealt(facet_frames), list(FACET))
    c = F.col

    def turn(d):
        p, q = vec.dot(d, vec.vec("e")), vec.dot(d, vec.vec("f"))
        return c("a11") * p + c("a12") * q, c("a21") * p + c("a22") * q

    u, v = turn(vec.sub(vec.vec(), vec.vec("c")))
    out = {"u": c("u0") + u, "v": c("v0") + v}
    for name, shift in (shifts or {}).items():
        out |= dict(zip((f"du_{name}", f"dv_{name}"), turn(shift)))
    return j.select(*(j[n] for n in hits.columns), *(e.alias(n) for n, e in out.items()))


def step_sizes(facet_frames: DataFrame, nx: int, ny: int) -> DataFrame:
    """mesh, facet, du, dv: how long a pixel of an nx x ny texture is on the facet, along u and along v."""
    return facet_frames.select(*FACET, (F.hypot("i11", "i21") / nx).alias("du"), (F.hypot("i12", "i22") / ny).alias("dv"))


def grid_attributes(meshes: DataFrame, leaves: DataFrame, attributes: DataFrame, nx: int, ny: int) -> DataFrame:
    """mesh, ix, iy and the attributes (mesh, facet, ...) of the facet under each texel's centre of each mesh; null where there is none."""
    g = meshes.select("mesh").distinct().withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))))
    ix, iy = (F.col("id") % nx).cast("int"), F.expr(f"cast(id div {nx} as int)")
    points = g.select("mesh", "id", ((ix + 0.5) / nx).alias("u"), ((iy + 0.5) / ny).alias("v"))
    out = locate(points, leaves).join(dealt(attributes), list(FACET), "left")
    return out.select("mesh", ix.alias("ix"), iy.alias("iy"), "facet", *(c for c in attributes.columns if c not in FACET))


def landmark_places(landmarks2: DataFrame, landmarks3: DataFrame, leaves: DataFrame, facet_frames: DataFrame) -> DataFrame:
    """mesh, name, x, y, z, kind of every landmark: its place in space (mesh, name, x, y, z) where it has one, else that of its texture
    coordinates (mesh, name, u, v); kind is 3d, 2d, or null where these are on no facet."""
    flat = locate(landmarks2.select("mesh", F.col("name").alias("id"), "u", "v"), leaves).where("facet is not null")
    flat = to_xyz(flat, facet_frames).select("mesh", F.col("id").alias("name"), F.struct("x", "y", "z").alias("p2"))
    every = landmarks2.select("mesh", "name").unionByName(landmarks3.select("mesh", "name")).distinct()
    j = every.join(dealt(landmarks3.select("mesh", "name", F.struct("x", "y", "z").alias("p3"))), ["mesh", "name"], "left").join(dealt(flat), ["mesh", "name"], "left")
    p = F.coalesce("p3", "p2")
    return j.select("mesh", "name", *(p[c].alias(c) for c in "xyz"), F.when(F.col("p3").isNotNull(), "3d").when(F.col("p2").isNotNull(), "2d").alias("kind"))


def facet_line_means(lines: DataFrame, leaves: DataFrame, facet_frames: DataFrame, values: DataFrame, du: float, dv: float) -> DataFrame:
    """mesh, line, steps, length, mean of segments (mesh, line, u1, v1, u2, v2): length on the surface and mean facet value (mesh, facet, value)
    over the midpoints of 1 + floor of the length in steps of du and dv; length and mean are null if a midpoint is on no facet.

    What is shuffled is a row for each cell that a line passes, then for each facet, with how many midpoints lie there: a line is straight, so those in a
    cell follow each other, and all steps of a line are alike. Midpoints themselves are made where they meet the facets."""
    leaves = cut(leaves, "leaf-cells")
    depths = [r.depth for r in leaves.select("depth").distinct().collect()]  # at most max_depth + 1 numbers
    c = F.col
    a, b = c("u2") - c("u1"), c("v2") - c("v1")
    ends = ["u1", "v1", "u2", "v2"]
    s = lines.select("mesh", "line", *ends, F.floor(1 + F.sqrt(a / du * (a / du) + b / dv * (b / dv))).cast("int").alias("steps")).where("steps is not null")
    t = (c("k") + 0.5) / c("steps")
    place = {"u": c("u1") + t * a, "v": c("v1") + t * b}
    cell = ["mesh", "depth", "c_u", "c_v"]
    at = lambda x: F.least(F.floor(c(x) * F.pow(F.lit(2.0), c("depth"))), F.pow(F.lit(2.0), c("depth")) - 1).cast("long")
    inside = "u between 0 and 1 and v between 0 and 1"
    p = s.withColumn("k", F.explode(F.sequence(F.lit(0), c("steps") - 1))).withColumns(place).where(inside)
    p = p.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>"))).withColumns({"c_u": at("u"), "c_v": at("v")})
    passed = p.groupBy(*cell, "line", *ends, "steps").agg(F.min("k").alias("k1"), F.max("k").alias("k2"))
    j = passed.join(dealt(leaves.select(*cell, "facet", "ring", "lo_u", "hi_u", "lo_v", "hi_v")), cell)
    j = j.withColumn("k", F.explode(F.sequence("k1", "k2"))).withColumns(place).where("u between lo_u and hi_u and v between lo_v and hi_v").where((at("u") == c("c_u")) & (at("v") == c("c_v")))
    j = j.where(pr.in_polygon(c("ring"), c("u"), c("v")))
    hit = j.groupBy(*cell, "line", *ends, "steps", "k").agg(F.min("facet").alias("facet"))  # all that holds a point is in its one leaf cell
    on = hit.groupBy("mesh", "facet", "line", *ends, "steps").agg(F.count("*").alias("n"))
    su, sv = a / c("steps"), b / c("steps")
    along = F.hypot(c("i11") * su + c("i12") * sv, c("i21") * su + c("i22") * sv)
    on = on.join(dealt(facet_frames.select(*FACET, "i11", "i12", "i21", "i22")), list(FACET), "left").join(dealt(values.select(*FACET, "value")), list(FACET), "left")
    on = on.select("mesh", "line", "steps", "n", (along * c("n")).alias("along"), (c("value") * c("n")).alias("value"))
    every = s.select("mesh", "line", "steps", F.lit(0).cast("long").alias("n"), *(F.lit(None).cast("double").alias(x) for x in ("along", "value")))
    whole = F.sum("n") == c("steps")
    known = F.sum(F.when(c("value").isNotNull(), c("n")))
    return on.unionByName(every).groupBy("mesh", "line", "steps").agg(F.when(whole, F.sum("along")).alias("length"), F.when(whole, F.sum("value") / known).alias("mean"))


def splat_footprints(pixels: DataFrame, nx: int, ny: int, *frame: str, reach_uv: float = 1.5, reach_source: float = 1.5, cell_weights: DataFrame | None = None) -> DataFrame:
    """frame, iu, iv, sum_wv, sum_w of pixels (frame, u, v from 0 to 1, value, w, and how u and v change a source pixel to the right and down:
    du_h, dv_h, du_v, dv_v). A pixel goes to all texels within reach_uv texels or reach_source source pixels of it, by the raised cosine
    of its distance in source pixels, its weight, and the texel's (iu, iv, cw), 0 where that isn't listed."""
    c = F.col
    pu, pv = c("u") * nx - 0.5, c("v") * ny - 0.5
    wide = F.greatest(F.lit(reach_uv), F.hypot("du_h", "du_v") * (reach_source * nx))
    high = F.greatest(F.lit(reach_uv), F.hypot("dv_h", "dv_v") * (reach_source * ny))
    p = pixels.where((c("w") > 0) & ~sc.missing(c("value")) & c("u").isNotNull() & c("v").isNotNull())
    span = lambda at, half, n: F.filter(F.sequence(F.greatest(F.ceil(at - half), F.lit(0)).cast("int"), F.least(F.floor(at + half), F.lit(n - 1)).cast("int")), lambda i: (i >= at - half) & (i <= at + half))
    p = p.where((pu + wide >= 0) & (pu - wide <= nx - 1) & (pv + high >= 0) & (pv - high <= ny - 1))
    p = p.withColumn("iu", F.explode(span(pu, wide, nx))).withColumn("iv", F.explode(span(pv, high, ny)))
    x, y = c("iu") - pu, c("iv") - pv
    det = F.nullif(c("du_h") * c("dv_v") - c("du_v") * c("dv_h"), F.lit(0.0))
    sx, sy = F.try_divide(c("dv_v") * x / nx - c("du_v") * y / ny, det), F.try_divide(c("du_h") * y / ny - c("dv_h") * x / nx, det)
    r2 = sx * sx + sy * sy
    p = p.where((x * x + y * y <= reach_uv * reach_uv) | (r2 <= reach_source * reach_source)).withColumn("c", c("w") * sc.raised_cosine(F.sqrt(r2))).where("c is not null")
    if cell_weights is not None:
        p = p.join(cell_weights.select("iu", "iv", "cw"), ["iu", "iv"]).withColumn("c", c("c") * c("cw"))
    return p.groupBy(*frame, "iu", "iv").agg(F.sum(c("c") * c("value")).alias("sum_wv"), F.sum("c").alias("sum_w"))


def box_column(ring: Column, axis: str) -> tuple[Column, Column]:
    return F.array_min(F.transform(ring, lambda q: q[axis])), F.array_max(F.transform(ring, lambda q: q[axis]))


def space_cells(rings: DataFrame, most: int = 10, max_depth: int = 18, eps: float = 1e-4) -> DataFrame:
    """mesh, facet, depth, c_x, c_y, c_z: the cells in space, of each mesh's box widened by eps of its diagonal, that facets' boxes overlap.
    rings: mesh, facet, ring of x, y, z."""
    b = rings.select(*FACET, *(f.alias(n + a) for a in "xyz" for n, f in zip(("l_", "h_"), box_column(F.col("ring"), a))))
    m = b.groupBy("mesh").agg(*(f(n + a).alias("m" + n + a) for a in "xyz" for n, f in (("l_", F.min), ("h_", F.max))))
    far = vec.norm(tuple(F.col("mh_" + a) - F.col("ml_" + a) for a in "xyz")) * eps
    j = b.join(dealt(m), "mesh")
    part = lambda n, a: F.try_divide(F.col(n + a) - F.col("ml_" + a) + far, F.nullif(F.col("mh_" + a) - F.col("ml_" + a) + 2 * far, F.lit(0.0)))
    unit = j.select(*FACET, *(F.coalesce(part(n, a), F.lit(0.5)).alias(k + a) for a in "xyz" for n, k in (("l_", "lo_"), ("h_", "hi_"))))
    return adaptive_cells(unit, ("x", "y", "z"), ("mesh",), most, max_depth).select(*FACET, "depth", "c_x", "c_y", "c_z")
