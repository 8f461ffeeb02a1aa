"""Queries over the box meshes of parts."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import mesh as op
from ..session import cut, dealt, table
from ..sources import fixtures as fx
from .registry import query

R = lambda c, n=6: (F.round(c, n) + 0.0)
W = f"WITH {fx.BOXES_SQL}"
EDGES = "edges AS (SELECT mesh, facet, k, vid AS a, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS b FROM corners WINDOW w AS (PARTITION BY mesh, facet ORDER BY k))"


def _v(spark, d):
    return op.box_vertices(fx.box_dims(spark, d))


def _c(spark, d):
    return op.box_corners(fx.box_dims(spark, d))


def _ring(spark, d):
    return op.corner_points(_c(spark, d), _v(spark, d))


query("src09_box_vertices", f"{W} SELECT mesh, vid, x, y, z FROM vertices")(_v)
query("src09_box_corners", f"{W} SELECT mesh, facet, k, vid FROM corners")(_c)
query("join09_corner_points", f"{W} SELECT mesh, vid, facet, k, x, y, z FROM ring")(_ring)


@query("src10_layer", f"{W} SELECT mesh, k, u * length AS x, v * width AS y, thickness AS z, u, v FROM boxes, (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)) c(k, u, v)")
def layer(spark, d):
    q = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for k, (u, v) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    b = fx.box_dims(spark, d).withColumn("c", F.explode(q)).select("*", "c.*")
    return b.select("mesh", "k", (F.col("u") * F.col("length")).alias("x"), (F.col("v") * F.col("width")).alias("y"), F.col("thickness").alias("z"), "u", "v")


@query("agg04_centroid_radius", f"{W}, c AS (SELECT mesh, facet, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM ring GROUP BY ALL) SELECT mesh, facet, cx, cy, cz, round(max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) AS maxradius, round(sqrt(sum((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) AS refsize FROM ring JOIN c USING (mesh, facet) GROUP BY ALL")
def centroid(spark, d):
    return op.centroids(_ring(spark, d)).withColumns({"maxradius": R("maxradius"), "refsize": R("refsize")})


@query("agg05_normals", f"{W}, p AS (SELECT mesh, facet, list(struct_pack(x := x, y := y, z := z) ORDER BY k) AS r FROM ring GROUP BY ALL), e AS (SELECT mesh, facet, r[2].x - r[1].x AS ax, r[2].y - r[1].y AS ay, r[2].z - r[1].z AS az, r[3].x - r[2].x AS bx, r[3].y - r[2].y AS by_, r[3].z - r[2].z AS bz FROM p), n AS (SELECT mesh, facet, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz FROM e) SELECT mesh, facet, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nz FROM n")
def facet_normals(spark, d):
    return op.normals(_ring(spark, d)).select("mesh", "facet", *(R(c).alias(c) for c in ("nx", "ny", "nz")))


@query("agg32_mesh_centre", f"{W} SELECT mesh, round(length / 2, 6) AS x, round(width / 2, 6) AS y, round(thickness / 2, 6) AS z FROM boxes")
def centre(spark, d):
    return op.centre(op.centroids(_ring(spark, d))).select("mesh", *(R(c).alias(c) for c in "xyz"))


@query("agg33_bounding_box", f"{W} SELECT mesh, {', '.join(f'round({v} - 1e-4 * sqrt(length * length + width * width + thickness * thickness), 6) + 0.0 AS lo_{c}, round({e} + 1e-4 * sqrt(length * length + width * width + thickness * thickness), 6) AS hi_{c}' for c, v, e in (('x', '0', 'length'), ('y', '0', 'width'), ('z', '0', 'thickness')))} FROM boxes")
def bounding_box(spark, d):
    b = op.bounds(_v(spark, d))
    return b.select("mesh", *(R(n + c).alias(n + c) for c in "xyz" for n in ("lo_", "hi_")))


@query("win01_ring_edges", f"{W}, {EDGES} SELECT mesh, facet, k, a, b FROM edges")
def ring_edges(spark, d):
    return op.edges(_c(spark, d))


@query("join17_vertex_neighbours", f"{W}, {EDGES} SELECT DISTINCT mesh, a AS vid, b AS other FROM edges UNION SELECT DISTINCT mesh, b, a FROM edges")
def neighbours(spark, d):
    return op.neighbours(_c(spark, d))


@query("set02_two_hop_set", f"{W}, {EDGES}, n AS (SELECT mesh, a AS vid, b AS other FROM edges UNION SELECT mesh, b, a FROM edges) SELECT mesh, vid, other FROM n UNION SELECT x.mesh, x.vid, y.other FROM n x JOIN n y ON x.mesh = y.mesh AND x.other = y.vid WHERE x.vid <> y.other")
def two_hop(spark, d):
    n = op.neighbours(_c(spark, d))
    far = n.join(dealt(n.select("mesh", F.col("vid").alias("other"), F.col("other").alias("far"))), ["mesh", "other"]).where("vid <> far")
    return n.unionByName(far.select("mesh", "vid", F.col("far").alias("other"))).distinct()


@query("join16_adjacency", f"{W}, {EDGES}, e AS (SELECT DISTINCT mesh, facet, least(a, b) AS lo, greatest(a, b) AS hi FROM edges) SELECT DISTINCT x.mesh, x.facet, y.facet AS other FROM e x JOIN e y ON x.mesh = y.mesh AND x.lo = y.lo AND x.hi = y.hi AND x.facet <> y.facet")
def adjacency(spark, d):
    return op.adjacency(_c(spark, d))


GRID = f"""WITH {fx.GRIDS_SQL}, p AS (SELECT mesh, facet, list(struct_pack(x := x, y := y, z := z) ORDER BY k) AS r FROM gcorners JOIN gvertices USING (mesh, vid) GROUP BY ALL),
d AS (SELECT mesh, facet, r, r[2].x - r[1].x AS ax, r[2].y - r[1].y AS ay, r[2].z - r[1].z AS az, r[3].x - r[2].x AS bx, r[3].y - r[2].y AS by_, r[3].z - r[2].z AS bz FROM p),
c AS (SELECT mesh, facet, r, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz FROM d),
n AS (SELECT mesh, facet, r, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz FROM c)"""
ADJACENT = "g AS (SELECT mesh, facet, vid AS a, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS b FROM gcorners WINDOW w AS (PARTITION BY mesh, facet ORDER BY k)), h AS (SELECT DISTINCT mesh, facet, least(a, b) AS lo, greatest(a, b) AS hi FROM g), adj AS (SELECT DISTINCT x.mesh, x.facet, y.facet AS other FROM h x JOIN h y ON x.mesh = y.mesh AND x.lo = y.lo AND x.hi = y.hi AND x.facet <> y.facet)"
STEEP = math.radians(12)


def _grids(spark, d):
    return op.grid_meshes(fx.grid_dims(spark, d), fx.GRID_N, fx.GRID_M)


@query("src11_grid_meshes", f"WITH {fx.GRIDS_SQL} SELECT mesh, facet, k, vid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) + 0.0 AS z, round(u, 6) AS u, round(v, 6) AS v FROM gcorners JOIN gvertices USING (mesh, vid)")
def grids(spark, d):
    v, c = _grids(spark, d)
    return op.corner_points(c, v).select("mesh", "facet", "k", "vid", *(R(n).alias(n) for n in "xyzuv"))


@query("join16_segments", GRID.replace("WITH", "WITH RECURSIVE", 1) + f""", {ADJACENT}, near AS (SELECT a.mesh, a.facet, a.other FROM adj a JOIN n x ON x.mesh = a.mesh AND x.facet = a.facet JOIN n y ON y.mesh = a.mesh AND y.facet = a.other WHERE x.nx * y.nx + x.ny * y.ny + x.nz * y.nz > cos({STEEP!r}::DOUBLE)),
r(mesh, facet, other) AS (SELECT mesh, facet, facet FROM n UNION SELECT r.mesh, r.facet, e.other FROM r JOIN near e ON e.mesh = r.mesh AND e.facet = r.other) SELECT mesh, facet, min(other) AS surface FROM r GROUP BY ALL""")
def segments(spark, d):
    """Height fields of several steepnesses: smooth parts merge, steep steps part them."""
    v, c = _grids(spark, d)
    return op.segments(c, op.normals(op.corner_points(c, v)), STEEP)


@query("join16_box_segments", f"{W} SELECT mesh, c.facet, c.facet AS surface FROM boxes, (VALUES (0), (1), (2), (3), (4), (5)) c(facet)")
def box_segments(spark, d):
    """Faces of a box stand at right angles: 80 degrees part them all."""
    return op.segments(_c(spark, d), op.normals(_ring(spark, d)), math.radians(80))


_TURNS = math.radians(65)


@query("join16_grown_segments", f"""WITH RECURSIVE c AS (SELECT p_partkey AS mesh, 6 + p_partkey % 7 AS sides FROM part), f AS (SELECT mesh, sides, unnest(range(sides)) AS facet, 2 * pi() / sides AS step FROM c), k AS (SELECT DISTINCT sides, greatest(1, floor({_TURNS!r}::DOUBLE / (2 * pi() / sides) + 1e-9)::BIGINT) AS reach FROM c),
g(sides, seed, lo, hi) AS (SELECT sides, 0::BIGINT, CASE WHEN 2 * pi() / sides < {_TURNS!r}::DOUBLE - 1e-9 THEN -floor(({_TURNS!r}::DOUBLE - 1e-9) / (2 * pi() / sides))::BIGINT ELSE 0 END, CASE WHEN 2 * pi() / sides < {_TURNS!r}::DOUBLE - 1e-9 THEN floor(({_TURNS!r}::DOUBLE - 1e-9) / (2 * pi() / sides))::BIGINT ELSE 0 END FROM (SELECT DISTINCT sides FROM c)
UNION ALL SELECT sides, hi + 1, lo, least(hi + 1 + floor(({_TURNS!r}::DOUBLE - 1e-9) / (2 * pi() / sides))::BIGINT, sides + lo0 - 1) FROM (SELECT g.sides, g.seed, g.lo, g.hi, -floor(({_TURNS!r}::DOUBLE - 1e-9) / (2 * pi() / g.sides))::BIGINT AS lo0 FROM g) WHERE hi + 1 < sides + lo0)
SELECT f.mesh, f.facet, max(g.seed) AS surface FROM f JOIN g ON g.sides = f.sides AND ((f.facet BETWEEN greatest(g.seed, 0) AND g.hi AND g.seed > 0) OR (g.seed = 0 AND (f.facet <= g.hi OR f.facet - f.sides >= g.lo))) GROUP BY ALL""")
def grown(spark, d):
    """A prism of 6 to 12 sides a part: facets turn by equal angles, so surfaces of a seed's reach follow each other around it, the first to both
    sides of its seed. Neighbours alone would join all sides of the finer ones."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("mesh"), (6 + F.col("p_partkey") % 7).cast("long").alias("sides"))
    f = p.withColumn("facet", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    turn = 2 * math.pi * F.col("facet") / F.col("sides")
    normals = f.select("mesh", "facet", F.cos(turn).alias("nx"), F.sin(turn).alias("ny"), F.lit(0.0).alias("nz"))
    nxt = (F.col("facet") + 1) % F.col("sides")
    corners = f.select("mesh", "facet", F.posexplode(F.array(F.col("facet"), nxt, nxt + F.col("sides"), F.col("facet") + F.col("sides"))).alias("k", "vid"))
    return op.grown_segments(corners, normals, _TURNS)


@query("agg05_normals_skip_parallel", f"{W}, c AS (SELECT mesh, facet, CASE WHEN k > 0 THEN k + 1 ELSE k END AS k, x, y, z FROM ring UNION ALL SELECT a.mesh, a.facet, 1, (a.x + b.x) / 2, (a.y + b.y) / 2, (a.z + b.z) / 2 FROM ring a JOIN ring b ON a.mesh = b.mesh AND a.facet = b.facet AND a.k = 0 AND b.k = 1), p AS (SELECT mesh, facet, list(struct_pack(x := x, y := y, z := z) ORDER BY k) AS r FROM c GROUP BY ALL), e AS (SELECT mesh, facet, r[3].x - r[2].x AS ax, r[3].y - r[2].y AS ay, r[3].z - r[2].z AS az, r[4].x - r[3].x AS bx, r[4].y - r[3].y AS by_, r[4].z - r[3].z AS bz FROM p), n AS (SELECT mesh, facet, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz FROM e) SELECT mesh, facet, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS nz FROM n")
def skip_parallel(spark, d):
    """Each face with one more corner in the middle of its first edge: its first two edges are parallel."""
    r = _ring(spark, d)
    a, b = r.where("k = 0"), r.where("k = 1").select("mesh", "facet", *(F.col(c).alias("o" + c) for c in "xyz"))
    middle = a.join(dealt(b), ["mesh", "facet"]).select("mesh", "facet", F.lit(1).alias("k"), *(((F.col(c) + F.col("o" + c)) / 2).alias(c) for c in "xyz"))
    ring = r.select("mesh", "facet", F.when(F.col("k") > 0, F.col("k") + 1).otherwise(F.col("k")).alias("k"), "x", "y", "z").unionByName(middle)
    return op.normals(ring).select("mesh", "facet", *(R(c).alias(c) for c in ("nx", "ny", "nz")))


@query("agg06_best_fit_frames", f"{W}, c AS (SELECT mesh, facet, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM ring GROUP BY ALL), s AS (SELECT mesh, facet, sqrt(sum((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS refsize FROM ring JOIN c USING (mesh, facet) GROUP BY ALL) SELECT mesh, facet, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, f.nx, f.ny, f.nz, 0.0::DOUBLE AS off, round(refsize, 6) AS refsize, 1.0::DOUBLE AS handed FROM s JOIN c USING (mesh, facet) JOIN (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, -1.0::DOUBLE), (1, 0.0, 0.0, 1.0), (2, 0.0, -1.0, 0.0), (3, 1.0, 0.0, 0.0), (4, 0.0, 1.0, 0.0), (5, -1.0, 0.0, 0.0)) f(facet, nx, ny, nz) USING (facet)")
def frames(spark, d):
    f = op.best_fit_frames(_ring(spark, d))
    handed = vec.dot(vec.cross(vec.vec("a"), vec.vec("b")), vec.vec("n"))
    return f.select("mesh", "facet", *(R(c, 5).alias(c) if c == "off" else R(c).alias(c) for c in ("cx", "cy", "cz", "nx", "ny", "nz", "off", "refsize")), R(handed).alias("handed"))


@query("snk01_pack", f"{W}, f AS (SELECT mesh, facet, list(vid ORDER BY k) AS ids FROM corners GROUP BY ALL) SELECT mesh, string_agg(array_to_string(ids, ' ') || ' -1', ' ' ORDER BY facet) AS text FROM f GROUP BY mesh")
def packed(spark, d):
    return op.pack(_c(spark, d)).select("mesh", F.array_join(F.transform("index", lambda i: i.cast("string")), " ").alias("text"))


@query("agg27_unpack", f"{W} SELECT mesh, facet, facet * 5 AS start, count(*) AS size FROM corners GROUP BY ALL")
def unpacked(spark, d):
    """Packed and read back; the last end mark is taken away."""
    p = op.pack(_c(spark, d)).select("mesh", F.expr("slice(index, 1, size(index) - 1)").alias("index"))
    return op.packed_polygons(p).select("mesh", F.col("facet").cast("int").alias("facet"), F.col("start").cast("int").alias("start"), "size")


@query("set01_with_copies", f"{W} SELECT mesh, facet, k, vid, 0 AS copy_id FROM corners UNION ALL SELECT mesh, facet, k, vid, 1 FROM corners WHERE facet < 2")
def copies(spark, d):
    c = _c(spark, d)
    return c.withColumn("copy_id", F.lit(0)).unionByName(c.where("facet < 2").withColumn("copy_id", F.lit(1)))


@query("win06_first_facet", f"{W} SELECT mesh, vid, min(facet) AS facet FROM corners GROUP BY ALL")
def first_facet(spark, d):
    return _c(spark, d).groupBy("mesh", "vid").agg(F.min("facet").alias("facet"))


@query("agg13_planar_parameters", f"""{GRID}, s AS (SELECT mesh, facet, facet // 11 % 3 AS surface, nx, ny, nz, r FROM n), m AS (SELECT mesh, surface, avg(nx) AS nx, avg(ny) AS ny, avg(nz) AS nz, arg_min(r, facet) AS r FROM s GROUP BY ALL),
q AS (SELECT mesh, surface, avg(p.x) AS mx, avg(p.y) AS my, avg(p.z) AS mz FROM (SELECT mesh, surface, unnest(r) AS p FROM s) GROUP BY ALL),
t AS (SELECT mesh, surface, nx / sqrt(nx * nx + ny * ny + nz * nz) AS nx, ny / sqrt(nx * nx + ny * ny + nz * nz) AS ny, nz / sqrt(nx * nx + ny * ny + nz * nz) AS nz, r[2].x - r[1].x AS ex, r[2].y - r[1].y AS ey, r[2].z - r[1].z AS ez FROM m),
w AS (SELECT *, ex - (ex * nx + ey * ny + ez * nz) * nx AS wx, ey - (ex * nx + ey * ny + ez * nz) * ny AS wy, ez - (ex * nx + ey * ny + ez * nz) * nz AS wz FROM t),
u AS (SELECT *, wx / sqrt(wx * wx + wy * wy + wz * wz) AS ux, wy / sqrt(wx * wx + wy * wy + wz * wz) AS uy, wz / sqrt(wx * wx + wy * wy + wz * wz) AS uz FROM w)
SELECT mesh, surface, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('mx', 'my', 'mz', 'nx', 'ny', 'nz', 'ux', 'uy', 'uz'))}, round(ny * uz - nz * uy, 6) + 0.0 AS vx, round(nz * ux - nx * uz, 6) + 0.0 AS vy, round(nx * uy - ny * ux, 6) + 0.0 AS vz FROM u JOIN q USING (mesh, surface)""")
def planar(spark, d):
    """Height fields whose rows of facets belong to three surfaces in turn."""
    v, c = _grids(spark, d)
    ring = cut(op.corner_points(c, v), "ring")
    surface = c.select("mesh", "facet", F.expr("facet div 11 % 3").alias("surface")).distinct()
    p = op.planar_parameters(ring, surface)
    return p.select("mesh", "surface", *(R(a + b).alias(a + b) for a in "mnuv" for b in "xyz"))


@query("pred09_all_in_set", f"{W} SELECT mesh, facet, bool_and(vid < 4) AS inside FROM corners GROUP BY ALL")
def all_in(spark, d):
    return _c(spark, d).groupBy("mesh", "facet").agg(F.bool_and(F.col("vid") < 4).alias("inside"))


@query("pred08_vertices_in_box", f"{W} SELECT mesh, facet, bool_and(x BETWEEN 0 AND 10 AND y BETWEEN 0 AND 4 AND z BETWEEN 0 AND 2) AS inside FROM ring GROUP BY ALL")
def in_box(spark, d):
    inside = F.col("x").between(0, 10) & F.col("y").between(0, 4) & F.col("z").between(0, 2)
    return _ring(spark, d).groupBy("mesh", "facet").agg(F.bool_and(inside).alias("inside"))


def _vector(name, sql, make):
    @query(name, f"{W} SELECT mesh, vid, {sql} FROM vertices")
    def run(spark, d):
        out = make(vec.vec())
        out = out if isinstance(out, tuple) else (out,)
        return _v(spark, d).select("mesh", "vid", *(R(c).alias(n) for c, n in zip(out, ("a", "b", "c"))))


def one():
    return F.lit(1.0), F.lit(2.0), F.lit(3.0)


n3 = "sqrt(x * x + y * y + z * z)"
_vector("vec03_dot", "round(x + 2 * y + 3 * z, 6) + 0.0 AS a", lambda p: vec.dot(p, one()))
_vector("vec03_cross", "round(y * 3 - z * 2, 6) + 0.0 AS a, round(z - x * 3, 6) + 0.0 AS b, round(x * 2 - y, 6) + 0.0 AS c", lambda p: vec.cross(p, one()))
_vector("vec03_cross2", "round(x * 2 - y, 6) + 0.0 AS a", lambda p: vec.cross2(p[:2], one()[:2]))
_vector("vec04_norm", f"round({n3}, 6) AS a", vec.norm)
_vector("vec04_unit", f"round(x / nullif({n3}, 0), 6) + 0.0 AS a, round(y / nullif({n3}, 0), 6) + 0.0 AS b, round(z / nullif({n3}, 0), 6) + 0.0 AS c", vec.unit)
_vector("vec04_add_scaled", "round(x + 0.5, 6) AS a, round(y + 1.0, 6) AS b, round(z + 1.5, 6) AS c", lambda p: vec.add_scaled(p, one(), 0.5))
_vector("vec04_sign", "CASE WHEN x < 1 THEN -1.0 ELSE 1.0 END AS a", lambda p: vec.sign(p[0] - 1).cast("double"))
_vector("vec02_matrix3", "round(2 * x + y, 6) AS a, round(y - z, 6) + 0.0 AS b, round(3 * z, 6) AS c", lambda p: vec.mat_vec([2, 1, 0, 0, 1, -1, 0, 0, 3], p))
_vector("vec01_matrix23", "round(x + 2 * y, 6) AS a, round(0.5 * z, 6) AS b", lambda p: vec.mat_vec([1, 2, 0, 0, 0, 0.5], p))
_vector("vec05_affine_point", "round(-y + 1, 6) + 0.0 AS a, round(x + 2, 6) AS b, round(z + 3, 6) AS c", lambda p: vec.affine([0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1], p))
_vector("vec05_affine_direction", "round(-y, 6) + 0.0 AS a, round(x, 6) AS b, round(z, 6) AS c", lambda p: vec.affine([0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1], p, 0))
_vector("vec15_axis_angle", "round(x * cos(0.7) - y * sin(0.7), 6) + 0.0 AS a, round(x * sin(0.7) + y * cos(0.7), 6) + 0.0 AS b, round(z, 6) AS c", lambda p: vec.affine(vec.axis_angle((0, 0, 1), 0.7), p))
_vector("vec07_eigenvalues", "round((x + y) / 2 + sqrt((x - y) * (x - y) / 4 + z * z), 6) + 0.0 AS a, round((x + y) / 2 - sqrt((x - y) * (x - y) / 4 + z * z), 6) + 0.0 AS b", lambda p: vec.eigvals2(p[0], p[2], p[2], p[1]))
_vector("vec08_plane_distance", "round((5 - z) / nullif(y, 0), 6) + 0.0 AS a", lambda p: vec.plane_distance((F.lit(0.0), F.lit(0.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0), F.lit(5.0)), p, (F.lit(1.0), F.lit(0.0), p[1])))
_vector("vec16_project_landmark", "round(20 * x / (z + 3) + 11.5, 6) AS a, round(-20 * y / (z + 3) + 8.5, 6) AS b", lambda p: (20 * p[0] / (p[2] + 3) + 11.5, -20 * p[1] / (p[2] + 3) + 8.5))
_vector("sf28_axis_flip", "round(x, 6) AS a, round(-y, 6) + 0.0 AS b, round(-z, 6) + 0.0 AS c", lambda p: vec.mat_vec([1, 0, 0, 0, -1, 0, 0, 0, -1], p))


@query("vec06_rms", f"{W} SELECT mesh, round(sqrt(sum(x * x + y * y + z * z) / count(*)), 6) AS rms FROM vertices GROUP BY mesh")
def rms(spark, d):
    p = vec.vec()
    return _v(spark, d).groupBy("mesh").agg(R(F.sqrt(F.sum(vec.dot(p, p)) / F.count("*"))).alias("rms"))


@query("join15_merge_close", """WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
go(k, leaders) AS (SELECT 0::BIGINT, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)[] UNION ALL SELECT p.k, CASE WHEN len(list_filter(leaders, lambda a: (a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2 <= 0.03 * 0.03)) = 0 THEN list_append(leaders, {'id': p.id, 'x': p.x, 'y': p.y, 'z': p.z}) ELSE leaders END FROM go JOIN p ON p.k = go.k + 1),
l AS (SELECT unnest(leaders) AS a FROM (SELECT leaders FROM go ORDER BY k DESC LIMIT 1))
SELECT p.id, min(a.id) AS leader FROM p JOIN l ON a.id <= p.id AND (a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2 <= 0.03 * 0.03 GROUP BY p.id""")
def merge_close(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))
    return op.merge_close(e, 0.03)


@query("top01_nearest_vertex", f"{W} SELECT mesh, arg_min(vid, (x - 5) ** 2 + (y - 2) ** 2 + (z - 1) ** 2 + vid * 1e-9) AS vid FROM vertices GROUP BY mesh")
def nearest(spark, d):
    p = vec.sub(vec.vec(), (F.lit(5.0), F.lit(2.0), F.lit(1.0)))
    return _v(spark, d).groupBy("mesh").agg(F.min(F.struct(vec.dot(p, p).alias("d"), "vid")).alias("m")).select("mesh", "m.vid")


@query("sf30_axis_rank", f"{W} SELECT mesh, vid, row_number() OVER (PARTITION BY mesh ORDER BY x DESC, y DESC, z DESC) AS r FROM vertices")
def ranks(spark, d):
    w = Window.partitionBy("mesh").orderBy(F.desc("x"), F.desc("y"), F.desc("z"))
    return _v(spark, d).select("mesh", "vid", F.row_number().over(w).cast("long").alias("r"))
