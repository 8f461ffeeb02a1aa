"""Surface meshes as tables: vertices (mesh, vid, x, y, z) and corners (mesh, facet, k, vid).

Defined results: rows with a null mesh, facet or vid join with nothing; a repeated corner row counts as one more corner; a facet of fewer
than three corners, or of parallel edges only, has null measures; empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..session import cut, dealt, discard
from .graph import components

FACET = ("mesh", "facet")
#: Corners of the unit box and its six outward faces; fixed values of the generator.
BOX_VERTICES = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
BOX_FACES = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]


def grid_meshes(dims: DataFrame, n: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(vertices with u and v, corners) of a height field for each row of dims (mesh, amplitude): n x m vertices on the unit square, quads
    turning left seen from above, z = amplitude sin(3 x) cos(2 y)."""
    one = dims.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    x, y = F.col("i") / F.lit(float(n - 1)), F.col("j") / F.lit(float(m - 1))
    vertices = one.select("mesh", (F.col("j") * n + F.col("i")).alias("vid"), x.alias("x"), y.alias("y"), (F.col("amplitude") * F.sin(3 * x) * F.cos(2 * y)).alias("z"), x.alias("u"), y.alias("v"))
    q = one.where((F.col("i") < n - 1) & (F.col("j") < m - 1))
    turn = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("j") * n + F.col("i") + d).alias("vid")) for k, d in enumerate((0, 1, n + 1, n))])
    corners = q.select("mesh", (F.col("j") * (n - 1) + F.col("i")).alias("facet"), F.explode(turn).alias("c")).select("mesh", "facet", "c.*")
    return vertices, corners


def box_vertices(dims: DataFrame) -> DataFrame:
    corner = F.array(*[F.struct(F.lit(i).alias("vid"), *(F.lit(float(c)).alias(n) for c, n in zip(v, "xyz"))) for i, v in enumerate(BOX_VERTICES)])
    d = dims.withColumn("c", F.explode(corner))
    return d.select("mesh", "c.vid", (F.col("c.x") * F.col("length")).alias("x"), (F.col("c.y") * F.col("width")).alias("y"), (F.col("c.z") * F.col("thickness")).alias("z"))


def box_corners(dims: DataFrame) -> DataFrame:
    corner = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(k).alias("k"), F.lit(v).alias("vid")) for f, face in enumerate(BOX_FACES) for k, v in enumerate(face)])
    return dims.select("mesh", F.explode(corner).alias("c")).select("mesh", "c.*")


def corner_points(corners: DataFrame, vertices: DataFrame) -> DataFrame:
    return corners.join(dealt(vertices), ["mesh", "vid"])


def centroids(ring: DataFrame) -> DataFrame:
    """mesh, facet, cx, cy, cz, maxradius, refsize (root of summed squared distances to the centroid)."""
    c = ring.groupBy(*FACET).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    d = vec.sub(vec.vec(), vec.vec("c"))
    return ring.join(dealt(c), list(FACET)).groupBy(*FACET, "cx", "cy", "cz").agg(F.max(vec.norm(d)).alias("maxradius"), F.sqrt(F.sum(vec.dot(d, d))).alias("refsize"))


def normals(ring: DataFrame, least: float = 1e-3) -> DataFrame:
    """mesh, facet, nx, ny, nz: the unit cross product at the first corner whose edges aren't parallel; null for degenerate facets. The
    next two corners come by window and the first good corner by aggregate, both dealt by facet: one shuffle, compiled arithmetic."""
    turn = Window.partitionBy(*FACET).orderBy("k")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cols = {}
    for c in "xyz":
        first, second = F.first(c).over(whole), F.nth_value(c, 2).over(whole)
        cols["p" + c] = F.coalesce(F.lead(c, 1).over(turn), first)
        cols["q" + c] = F.coalesce(F.lead(c, 2).over(turn), F.when(F.lead(c, 1).over(turn).isNull(), second).otherwise(first))
    r = ring.select(*FACET, "k", "x", "y", "z", *(e.alias(n) for n, e in cols.items()))
    a, b = vec.sub(vec.vec("p"), vec.vec()), vec.sub(vec.vec("q"), vec.vec("p"))
    r = r.select(*FACET, "k", *(e.alias("c" + n) for n, e in zip("xyz", vec.cross(a, b))), (vec.norm(a) * vec.norm(b)).alias("size"))
    ok = vec.norm(vec.vec("c")) > least * F.col("size")
    n = r.groupBy(*FACET).agg(F.min(F.when(ok, F.struct("k", "cx", "cy", "cz"))).alias("n"))
    return n.select(*FACET, *(e.alias(k) for k, e in zip(("nx", "ny", "nz"), vec.unit(vec.vec("n.c")))))


def best_fit_frames(ring: DataFrame) -> DataFrame:
    """mesh, facet, centroid cx, cy, cz, basis e1 and e2 (ax..az, bx..bz), normal nx, ny, nz, off (root of the summed squared distances
    to the plane), refsize: the plane that fits a facet's corners best, right-handed, its normal on the side of the facet's normal.

    Spark sums each facet's moments; tasks solve the 3 x 3 eigenproblems of a batch at once."""
    import numpy as np
    import pandas as pd

    c = ring.groupBy(*FACET).agg(*(F.avg(a).alias("c" + a) for a in "xyz"))
    d = ring.join(dealt(c), list(FACET))
    part = {a: F.col(a) - F.col("c" + a) for a in "xyz"}
    moments = d.groupBy(*FACET, "cx", "cy", "cz").agg(*(F.sum(part[a] * part[b]).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))
    rows = moments.join(dealt(normals(ring).select(*FACET, *(F.col("n" + a).alias("r" + a) for a in "xyz"))), list(FACET))

    def run(frames):
        for f in frames:
            m = f[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            good = np.isfinite(m).all((1, 2)) & f[["rx", "ry", "rz"]].notna().all(axis=1).to_numpy()
            w, v = np.linalg.eigh(np.where(good[:, None, None], m, np.eye(3)))
            n, a = v[:, :, 0], v[:, :, 2]
            n = n * np.where((n * f[["rx", "ry", "rz"]].to_numpy(float)).sum(1) < 0, -1, 1)[:, None]
            out = np.concatenate((a, np.cross(n, a), n, np.sqrt(np.maximum(w[:, :1], 0)), np.sqrt(np.maximum(w.sum(1, keepdims=True), 0))), 1)
            out[~good] = np.nan
            yield pd.concat([f[[*FACET, "cx", "cy", "cz"]], pd.DataFrame(out, columns=names, index=f.index)], axis=1)

    names = ["ax", "ay", "az", "bx", "by", "bz", "nx", "ny", "nz", "off", "refsize"]
    kinds = dict(ring.dtypes)
    out = rows.mapInPandas(run, f"mesh {kinds['mesh']}, facet {kinds['facet']}, cx double, cy double, cz double, " + ", ".join(f"{n} double" for n in names))
    return out.select(*FACET, "cx", "cy", "cz", *(F.nanvl(n, F.lit(None)).alias(n) for n in names))


def planar_parameters(ring: DataFrame, facet_surface: DataFrame) -> DataFrame:
    """mesh, surface, mean point mx, my, mz, mean unit normal nx, ny, nz, u axis ux, uy, uz (the first edge of the surface's smallest facet
    less its part along the normal) and v axis vx, vy, vz = n x u; null where the first edge runs along the normal."""
    r = ring.join(dealt(facet_surface), list(FACET))
    first = F.min(F.when(F.col("k") <= 1, F.struct("facet", "k", "x", "y", "z")))
    second = F.min(F.when(F.col("k") == 1, F.struct("facet", "k", "x", "y", "z")))
    g = r.groupBy("mesh", "surface").agg(*(F.avg(c).alias("m" + c) for c in "xyz"), first.alias("p"), second.alias("q"))
    n = normals(ring).join(dealt(facet_surface), list(FACET)).groupBy("mesh", "surface").agg(*(F.avg("n" + c).alias("n" + c) for c in "xyz"))
    j = g.join(dealt(n), ["mesh", "surface"]).withColumns(dict(zip(("tx", "ty", "tz"), vec.unit(vec.vec("n")))))
    t, e = vec.vec("t"), vec.sub(vec.vec("q."), vec.vec("p."))
    u = vec.unit(vec.add_scaled(e, t, -vec.dot(e, t)))
    j = j.withColumns(dict(zip(("ux", "uy", "uz"), u)))
    return j.select("mesh", "surface", "mx", "my", "mz", *(F.col("t" + c).alias("n" + c) for c in "xyz"), "ux", "uy", "uz", *(x.alias("v" + c) for c, x in zip("xyz", vec.cross(t, vec.vec("u")))))


def bounds(vertices: DataFrame, eps: float = 1e-4) -> DataFrame:
    """mesh and its box, widened by eps of the diagonal."""
    b = vertices.groupBy("mesh").agg(*(f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo_"), (F.max, "hi_"))))
    diagonal = vec.norm(vec.sub(vec.vec("hi_"), vec.vec("lo_")))
    return b.withColumns({n + c: F.col(n + c) + s * eps * diagonal for c in "xyz" for n, s in (("lo_", -1), ("hi_", 1))})


def centre(facets: DataFrame) -> DataFrame:
    """mesh and the mean of facet centroids weighted by squared radius."""
    w = F.col("maxradius") * F.col("maxradius")
    return facets.groupBy("mesh").agg(*((F.sum(F.col("c" + c) * w) / F.sum(w)).alias(c) for c in "xyz"))


def edges(corners: DataFrame) -> DataFrame:
    """mesh, facet, k, a, b: each corner's vertex and the next one's, with wrap-around."""
    w = Window.partitionBy(*FACET).orderBy("k")
    all_ = Window.partitionBy(*FACET).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return corners.select(*FACET, "k", F.col("vid").alias("a"), F.coalesce(F.lead("vid").over(w), F.first("vid").over(all_)).alias("b"))


def neighbours(corners: DataFrame) -> DataFrame:
    """mesh, vid, other: vertices joined by an edge."""
    e = edges(corners)
    both = e.select("mesh", F.col("a").alias("vid"), F.col("b").alias("other")).unionByName(e.select("mesh", F.col("b").alias("vid"), F.col("a").alias("other")))
    return both.distinct()


def adjacency(corners: DataFrame) -> DataFrame:
    """mesh, facet, other: facets that share an edge. An edge's facets, two on a manifold, meet in one row; one shuffle before the last."""
    e = edges(corners).groupBy("mesh", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.collect_set("facet").alias("f")).where("size(f) > 1")
    e = e.select("mesh", "f", F.explode("f").alias("facet")).select("mesh", "facet", F.explode("f").alias("other")).where("facet <> other")
    return e.distinct()


def segments(corners: DataFrame, facet_normals: DataFrame, angle: float) -> DataFrame:
    """mesh, facet, surface: facets joined across edges where the normals of both are within angle; a surface is named by its smallest
    facet. Neighbours are compared, not a surface's first facet, so the order of facets changes nothing."""
    n = cut(facet_normals, "normals")
    pairs = adjacency(corners).where("facet < other").join(dealt(n), list(FACET)).join(dealt(n.select("mesh", F.col("facet").alias("other"), *(F.col(c).alias("o" + c) for c in ("nx", "ny", "nz")))), ["mesh", "other"])
    near = pairs.where(vec.dot(vec.vec("n"), vec.vec("on")) > F.cos(F.lit(angle)))
    key = lambda f: F.struct(F.col("mesh"), F.col(f).alias("facet"))
    comp = components(near.select(key("facet").alias("a"), key("other").alias("b"))).select("node.mesh", "node.facet", F.col("component.facet").alias("surface"))
    return corners.select(*FACET).distinct().join(dealt(comp), list(FACET), "left").select(*FACET, F.coalesce("surface", "facet").alias("surface"))


def packed_polygons(packed: DataFrame) -> DataFrame:
    """mesh, facet, start, size from (mesh, index array with -1 ends); a missing last end is allowed."""
    p = packed.select("mesh", F.posexplode("index").alias("pos", "vid"))
    run = F.coalesce(F.sum((F.col("vid") == -1).cast("int")).over(Window.partitionBy("mesh").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return p.withColumn("facet", run).where("vid <> -1").groupBy("mesh", "facet").agg(F.min("pos").alias("start"), F.count("*").alias("size"))


def pack(corners: DataFrame) -> DataFrame:
    """mesh, index: polygons one after another, each ended by -1."""
    f = corners.groupBy(*FACET).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "vid"))), lambda c: c["vid"]).alias("ids"))
    f = f.groupBy("mesh").agg(F.array_sort(F.collect_list(F.struct("facet", "ids"))).alias("polys"))
    return f.select("mesh", F.flatten(F.transform("polys", lambda p: F.concat(p["ids"], F.array(F.lit(-1))))).alias("index"))


def _decided(names: list[str]):
    """Tables of pairs (tx, ty, tz, id, other, known: 1 leader, 0 member, null unknown), sorted by tile and id: the points that can be decided, in
    the order of their ids. A point is a member where a smaller one near it leads, a leader where all of these are members. Pairs pass
    by; held are one batch and what was found of a tile's points."""
    import numpy as np
    import pandas as pd

    def run(frames):
        tile = point = None
        led = unsure = False
        status: dict = {}
        kind = object
        for f in frames:
            if not len(f):
                continue
            tiles, ids = f[["tx", "ty", "tz"]].to_numpy(), f["id"].to_numpy()
            kind = ids.dtype
            edge = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (tiles[1:] != tiles[:-1]).any(axis=1), [True]))).tolist()
            others, known = f["other"].tolist(), f["known"].fillna(-1).astype(int).tolist()
            found = []
            for first, last in zip(edge[:-1], edge[1:]):
                here, now = tuple(tiles[first]), ids[first]
                if (here, now) != (tile, point):
                    if tile is not None and (led or not unsure):
                        status[point] = int(not led)
                        found.append(point)
                    if here != tile:  # what was found goes before the tile does
                        yield pd.DataFrame({names[0]: found, names[1]: [status[p] for p in found]}).astype({names[0]: kind, names[1]: int})
                        found, status = [], {}
                    tile, point, led, unsure = here, now, False, False
                seen = [known[k] if known[k] >= 0 else status.get(others[k], -1) for k in range(first, last)]
                led, unsure = led or 1 in seen, unsure or -1 in seen
            yield pd.DataFrame({names[0]: found, names[1]: [status[p] for p in found]}).astype({names[0]: kind, names[1]: int})
        if tile is not None and (led or not unsure):
            yield pd.DataFrame({names[0]: [point], names[1]: [int(not led)]}).astype({names[0]: kind, names[1]: int})

    return run


def merge_close(points: DataFrame, tolerance: float, tile: int = 64) -> DataFrame:
    """id, leader: a point with no smaller leader within tolerance is a leader; others have the smallest leader within it.

    Equal points are one to begin with. Pairs within tolerance are found through cells as wide as it. Points are decided in the order of
    their ids, inside tiles of `tile` cells a side; what hangs on another tile's points waits for the next round, so rounds follow the borders
    that a chain of points crosses and not its length. Every round decides the smallest undecided point, so they end. A tile's pairs
    pass through one task, sorted, batch by batch; null ids and places are left out."""
    p = points.select("id", *(F.col(c).cast("double").alias(c) for c in "xyz")).where("id is not null and x is not null and y is not null and z is not null")
    own = p.groupBy("x", "y", "z").agg(F.min("id").alias("id"))
    cell = {"g" + c: F.floor(F.col(c) / tolerance) for c in "xyz"}
    own = own.withColumns(cell)
    near = own
    for n in "xyz":
        near = near.withColumn("g" + n, F.explode(F.array(F.col("g" + n) - 1, F.col("g" + n), F.col("g" + n) + 1)))
    of = lambda g: [F.floor(F.col(g + c) / tile) for c in "xyz"]
    o = own.select(F.col("id").alias("other"), *(F.col(c).alias("o" + c) for c in "xyz"), "gx", "gy", "gz")
    d = vec.sub(vec.vec(), vec.vec("o"))
    home = {"tx": F.floor(F.floor(F.col("x") / tolerance) / tile), "ty": F.floor(F.floor(F.col("y") / tolerance) / tile), "tz": F.floor(F.floor(F.col("z") / tolerance) / tile)}
    pairs = near.join(dealt(o), ["gx", "gy", "gz"]).where((F.col("other") < F.col("id")) & (vec.dot(d, d) <= tolerance * tolerance))
    same = F.lit(True)
    for k, t in zip(("tx", "ty", "tz"), of("g")):
        same = same & (F.col(k) == t)
    pairs = cut(pairs.withColumns(home).select("tx", "ty", "tz", "id", "other", same.alias("local")), "near-points")
    # what has no smaller point near it leads
    free = pairs.select("other").distinct().join(dealt(pairs.select(F.col("id").alias("other")).distinct()), "other", "left_anti")
    known = cut(free.select(F.col("other").alias("point"), F.lit(1).alias("known")), "decided")
    kind = dict(own.dtypes)["id"]
    left, tables = pairs.withColumn("known", F.lit(None).cast("int")), [known]
    while True:
        now = left.join(dealt(known.select(F.col("point").alias("other"), F.col("known").alias("new"))), "other", "left")
        now = now.withColumn("known", F.coalesce("known", "new")).drop("new")
        now = cut(now.join(dealt(known.select(F.col("point").alias("id"))), "id", "left_anti"), "near-points")
        if left is not pairs:
            discard(left)
        if now.isEmpty():
            break
        rows = now.repartition("tx", "ty", "tz").sortWithinPartitions("tx", "ty", "tz", "id").select("tx", "ty", "tz", "id", "other", "known")
        known = cut(rows.mapInPandas(_decided(["point", "known"]), f"point {kind}, known int"), "decided")
        tables.append(known)
        left = now
    decided = tables[0]
    for t in tables[1:]:
        decided = decided.unionByName(t)
    # a member may be within tolerance of several leaders: the smallest counts
    leads = decided.where("known = 1").select(F.col("point").alias("other"))
    members = pairs.join(dealt(decided.where("known = 0").select(F.col("point").alias("id"))), "id").join(dealt(leads), "other").groupBy("id").agg(F.min("other").alias("leader"))
    one = own.select("x", "y", "z", F.col("id").alias("own")).join(dealt(members.withColumnRenamed("id", "own")), "own", "left")
    return p.join(dealt(one), ["x", "y", "z"]).select("id", F.coalesce("leader", "own").alias("leader"))


def grown_segments(corners: DataFrame, facet_normals: DataFrame, angle: float) -> DataFrame:
    """mesh, facet, surface: surfaces that grow from seeds. The smallest facet without a surface is a seed; its surface is all facets without one
    that edges join to it by way of facets whose normals are within angle of the seed's; then the next seed follows.

    Facets that no edge joins can't meet, so each connected part of what is left grows a surface in every round; a part and what grows in it
    are components of a graph. Rounds are as many as surfaces lie one after another in a part. A facet without a normal is a surface of its
    own; facets that are listed twice are one; an empty mesh has no rows."""
    facets = corners.select(*FACET).distinct()
    order = facets.join(dealt(facet_normals.dropDuplicates(list(FACET))), list(FACET), "left").repartitionByRange(*FACET).sortWithinPartitions(*FACET)
    left = numbered = cut(order.select(*FACET, "nx", "ny", "nz", F.monotonically_increasing_id().alias("id")), "numbered-facets")  # ids in the order of mesh and facet
    name = numbered.select(*FACET, "id")
    pairs = adjacency(corners).where("facet < other").join(dealt(name), list(FACET)).select("mesh", "other", F.col("id").alias("a"))
    edges_left = cut(pairs.join(dealt(name.withColumnsRenamed({"facet": "other", "id": "b"})), ["mesh", "other"]).select("a", "b"), "facet-pairs")
    grown = []
    while not left.isEmpty():
        part = components(edges_left).select(F.col("node").alias("id"), F.col("component").alias("seed"))
        now = left.join(dealt(part), "id", "left").withColumn("seed", F.coalesce("seed", "id"))
        n = left.select(F.col("id").alias("seed"), *(F.col(c).alias("s" + c) for c in ("nx", "ny", "nz")))
        within = (F.col("id") == F.col("seed")) | F.coalesce(vec.dot(vec.vec("n"), vec.vec("sn")) > F.cos(F.lit(angle)), F.lit(False))
        near = cut(now.join(dealt(n), "seed").where(within).select("id", "seed"), "near-seeds")
        inside = near.select("id")
        sub = edges_left.join(dealt(inside.withColumnRenamed("id", "a")), "a", "left_semi").join(dealt(inside.withColumnRenamed("id", "b")), "b", "left_semi")
        reach = components(sub).select(F.col("node").alias("id"), "component")
        mine = cut(near.join(dealt(reach), "id", "left").where(F.coalesce("component", "id") == F.col("seed")).select("id", "seed"), "surfaces")
        grown.append(mine)
        left = cut(left.join(dealt(mine), "id", "left_anti"), "facets-left")
        edges_left = cut(edges_left.join(dealt(mine.select(F.col("id").alias("a"))), "a", "left_anti").join(dealt(mine.select(F.col("id").alias("b"))), "b", "left_anti"), "facet-pairs")
    out = None
    for mine in grown:
        out = mine if out is None else out.unionByName(mine)
    if out is None:
        return facets.withColumn("surface", F.col("facet"))
    return name.join(dealt(out), "id").join(dealt(name.select(F.col("id").alias("seed"), F.col("facet").alias("surface"))), "seed").select(*FACET, "surface")


def from_arrays(meshes: DataFrame) -> DataFrame:
    """mesh, facet, n (corners), cx, cy, cz, maxradius, refsize from (mesh, points array of x, y, z, index with -1 ends)."""
    vertices = meshes.select("mesh", F.posexplode("points").alias("vid", "p")).select("mesh", "vid", *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    run = F.coalesce(F.sum((F.col("vid") == -1).cast("int")).over(Window.partitionBy("mesh").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    corners = meshes.select("mesh", F.posexplode("index").alias("pos", "vid")).withColumn("facet", run).where("vid <> -1").select(*FACET, F.col("pos").alias("k"), "vid")
    ring = corner_points(corners, vertices)
    return centroids(ring).join(dealt(ring.groupBy(*FACET).agg(F.count("*").alias("n"))), list(FACET))
