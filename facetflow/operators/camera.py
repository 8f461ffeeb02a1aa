"""Cameras: undistortion and rectification as resampling, reprojection errors, and the nearest facet behind each pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import vec
from ..session import cut, dealt

#: Pixels that hits send to all tasks; more are dealt by tile.
SENT = 1_000_000
#: Groups of a tile's facets of which the nearest are tested before all others.
FIRST = 16


def distorted(x: Column, y: Column, k: list) -> tuple[Column, Column]:
    """Where a lens moves the normalized point (x, y); k holds k1, k2, p1, p2, k3 as numbers or Columns."""
    k1, k2, p1, p2, k3 = (c if isinstance(c, Column) else F.lit(float(c)) for c in k)
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def undistortion_map(pixels: DataFrame, f: tuple, c: tuple, k: list) -> DataFrame:
    """pixels (ix, iy, ...) with sx, sy: the place in the distorted picture that each comes from."""
    x, y = distorted((F.col("ix") - c[0]) / f[0], (F.col("iy") - c[1]) / f[1], k)
    return pixels.withColumns({"sx": x * f[0] + c[0], "sy": y * f[1] + c[1]})


def rectification_map(images: DataFrame, corners: list[str], n: Column, m: Column) -> DataFrame:
    """images with ix, iy (an n x m grid over the quadrilateral) and sx, sy. corners names x0, y0, ... x3, y3 in turn around it: the
    map is the closed-form homography of the unit square. Grid rows come from sequences, no join is needed."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((F.col(a), F.col(b)) for a, b in zip(corners[::2], corners[1::2]))
    sx, sy, ax, ay, bx, by = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3, x1 - x2, y1 - y2, x3 - x2, y3 - y2
    det = F.nullif(ax * by - bx * ay, F.lit(0.0))
    g, h = F.try_divide(sx * by - bx * sy, det), F.try_divide(ax * sy - sx * ay, det)
    d = images.withColumns({"g": g, "h": h}).withColumn("ix", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("iy", F.explode(F.sequence(F.lit(0), m - 1)))
    u, v, g, h = (F.col("ix") + 0.5) / n, (F.col("iy") + 0.5) / m, F.col("g"), F.col("h")
    w = F.nullif(g * u + h * v + 1, F.lit(0.0))
    at = lambda o, a, b: F.try_divide((a - o + g * a) * u + (b - o + h * b) * v + o, w)
    return d.withColumns({"sx": at(x0, x1, x3), "sy": at(y0, y1, y3)}).drop("g", "h")


def taps(places: DataFrame, place: list[str]) -> DataFrame:
    """place, px, py, tw: the up to four pixels that a place (sx, sy) is read from, with their bilinear weights."""
    fx, fy = F.col("sx") - F.floor("sx"), F.col("sy") - F.floor("sy")
    four = [(a, b, (fx if a else 1 - fx) * (fy if b else 1 - fy)) for a in (0, 1) for b in (0, 1)]
    tap = F.array(*(F.struct((F.floor("sx") + a).cast("int").alias("px"), (F.floor("sy") + b).cast("int").alias("py"), w.alias("tw")) for a, b, w in four))
    return places.select(*place, F.explode(tap).alias("tap")).select(*place, "tap.*").where("tw > 0")


def resample(places: DataFrame, frames: DataFrame, place: list[str], keys: list[str] = []) -> DataFrame:
    """place, the other columns of frames, v: frames (ix, iy, v, ...) read bilinearly at places (sx, sy), joined on keys and pixel.
    Pixels that aren't there count as 0; a place that sees none has no row, and a result of exactly 0 is null."""
    p = taps(places, [*place, *(k for k in keys if k not in place)])
    other = [c for c in frames.columns if c not in ("ix", "iy", "v", *keys)]
    source = frames.where("v is not null and not isnan(v)").select(*keys, *other, F.col("ix").alias("px"), F.col("iy").alias("py"), "v")
    out = p.join(source, [*keys, "px", "py"]).groupBy(*place, *other).agg(F.sum(F.col("tw") * F.col("v")).alias("v"))
    return out.withColumn("v", F.nullif("v", F.lit(0.0)))


def reprojection_rms(points: DataFrame, f: tuple, c: tuple, k: list) -> DataFrame:
    """image, n, rms: seen pixels (px, py) against the projections of points (x, y, z before the camera, z > 0)."""
    x, y = distorted(F.col("x") / F.col("z"), F.col("y") / F.col("z"), k)
    dx, dy = x * f[0] + c[0] - F.col("px"), y * f[1] + c[1] - F.col("py")
    return points.where("z > 0").groupBy("image").agg(F.count("*").alias("n"), F.sqrt(F.avg(dx * dx + dy * dy)).alias("rms"))


def _drop_axis(axis: Column, p) -> tuple[Column, Column]:
    x, y, z = p
    return F.when(axis == 0, y).otherwise(x), F.when(axis == 2, y).otherwise(z)


def pinhole_hits(pixels: DataFrame, faces: DataFrame, f: tuple, c: tuple, tile: int = 8, perspective: bool = True) -> DataFrame:
    """image, ix, iy, dist, facet, cosine: the nearest facet on each pixel's ray, the smallest of equally near ones, null on a miss.

    faces: image, facet, ring (array of x, y, z in camera coordinates; the camera looks along -z), normal nx, ny, nz. Pixels and
    facets meet on the square tiles that a facet's picture touches; of a facet that reaches behind the camera this is the picture of its part in
    front, from a billionth of its depth on. Facets are many: they stay where they are while up to SENT pixels (counted) are sent to them, else both are
    dealt by tile. Facets that stay are tested twice: some near ones of each tile first, then all, but only where these are as near as what the pixel has
    met. The exact test is done in the coordinate plane that the facet faces most. Degenerate facets (null normal) are never hit."""
    p = cut(pixels.select("image", "ix", "iy").distinct(), "pixels")
    extent = p.groupBy("image").agg(*(g(F.floor(F.col(n) / tile)).cast("int").alias(a + n) for n in ("ix", "iy") for a, g in (("lo_", F.min), ("hi_", F.max))))
    z_far = F.array_max(F.transform("ring", lambda q: q["z"]))
    z_near = F.array_min(F.transform("ring", lambda q: q["z"]))
    deep = (lambda q: -q["z"]) if perspective else (lambda q: F.lit(1.0))
    picture = {"x": lambda q: c[0] + f[0] * q["x"] / deep(q), "y": lambda q: c[1] - f[1] * q["y"] / deep(q)}
    near = F.greatest(F.abs(z_near), F.abs(z_far)) * 1e-9
    front = F.when(z_far < -near, F.col("ring")).otherwise(pr.clip_front(F.col("ring"), near)) if perspective else F.col("ring")
    side = {}
    for n, at in picture.items():
        seen = F.transform("front", at)
        for a, g in (("lo_", F.array_min), ("hi_", F.array_max)):
            t = F.floor(g(seen) / tile)
            side[a + n] = F.least(F.greatest(t, F.col(f"lo_i{n}") - int(a == "hi_")), F.col(f"hi_i{n}") + int(a == "lo_")).cast("int")  # a picture beside the pixels has no tile
    n, first = vec.vec("n"), F.get("ring", F.lit(0))
    axis = F.when((F.abs("nx") >= F.abs("ny")) & (F.abs("nx") >= F.abs("nz")), 0).when(F.abs("ny") >= F.abs("nz"), 1).otherwise(2)
    flat = F.transform("ring", lambda r: F.struct(*(e.alias(a) for e, a in zip(_drop_axis(F.col("axis"), (r["x"], r["y"], r["z"])), "xy"))))
    q = faces.where((z_near < 0) & F.col("nx").isNotNull()).withColumn("front", front).where("size(front) > 0").join(F.broadcast(extent), "image")  # a row an image
    q = q.withColumns({f"t_{k}": v for k, v in side.items()} | {"axis": axis, "plane": vec.dot(n, (first["x"], first["y"], first["z"]))})
    q = q.where("t_lo_x <= t_hi_x and t_lo_y <= t_hi_y").withColumn("flat", flat)
    q = q.withColumns({f"{g}_{a}": f(F.col("flat." + a)) for a in "xy" for g, f in (("lo", F.array_min), ("hi", F.array_max))})
    q = q.withColumn("tx", F.explode(F.sequence("t_lo_x", "t_hi_x"))).withColumn("ty", F.explode(F.sequence("t_lo_y", "t_hi_y")))
    q = q.select("image", "tx", "ty", "facet", "nx", "ny", "nz", "axis", "plane", "flat", "lo_x", "hi_x", "lo_y", "hi_y", z_far.alias("z_far"))
    tiled = p.withColumns({"tx": F.floor(F.col("ix") / tile).cast("int"), "ty": F.floor(F.col("iy") / tile).cast("int")})
    at = (F.col("ix"), F.col("iy"), *map(float, (*f, *c)))
    origin, direction = ((F.lit(0.0),) * 3, vec.pixel_ray(*at)) if perspective else vec.orthographic_ray(*at)
    tiled = tiled.withColumns(dict(zip(("dx", "dy", "dz"), direction)) | dict(zip(("ox", "oy", "oz"), origin)))
    d, o = vec.vec("d"), vec.vec("o")
    facing = vec.dot(n, d)
    hx, hy = _drop_axis(F.col("axis"), vec.add_scaled(o, d, F.col("dist")))
    key = ["image", "ix", "iy"]

    def nearest(met: DataFrame) -> DataFrame:
        j = met.withColumn("dist", F.try_divide(F.col("plane") - vec.dot(n, o), F.nullif(facing, F.lit(0.0)))).where("dist > 0")
        if "most" in met.columns:
            j = j.where("most is null or dist <= most")
        # the box of the facet first: it is compiled, and few rows are left for the exact test
        hit = j.where(hx.between(F.col("lo_x"), F.col("hi_x")) & hy.between(F.col("lo_y"), F.col("hi_y")) & pr.in_polygon(F.col("flat"), hx, hy))
        return hit.groupBy(*key).agg(F.min(F.struct("dist", "facet", F.abs(facing).alias("cosine"))).alias("near"))

    if p.count() <= SENT:
        groups = q.groupBy("image", "tx", "ty", F.pmod(F.xxhash64("facet"), F.lit(FIRST)).alias("g")).agg(F.max("z_far").alias("z"))
        some = cut(groups.groupBy("image", "tx", "ty").agg(F.min("z").alias("z")), "near-depths")  # a row a tile
        first = q.join(F.broadcast(some), ["image", "tx", "ty"]).where("z_far >= z").drop("z")
        first = cut(nearest(F.broadcast(tiled).join(first, ["image", "tx", "ty"])).select(*key, F.col("near")["dist"].alias("most")), "first-hits")
        met = F.broadcast(tiled.join(F.broadcast(first), key, "left")).join(q, ["image", "tx", "ty"])
    else:
        met = tiled.join(dealt(q), ["image", "tx", "ty"])
    return p.join(dealt(nearest(met)), key, "left").select(*key, "near.dist", "near.facet", "near.cosine")


def orthographic_hits(pixels: DataFrame, faces: DataFrame, f: tuple, c: tuple, tile: int = 8) -> DataFrame:
    """pinhole_hits for parallel rays along -z: pixel (ix, iy) starts at ((ix - c) / f, -(iy - c) / f, 0)."""
    return pinhole_hits(pixels, faces, f, c, tile, perspective=False)


def pixel_products(hits: DataFrame, facet_frames: DataFrame, f: tuple, c: tuple) -> DataFrame:
    """image, ix, iy, mesh, facet, dist, cosine of pinhole hits with a mesh, and on the facet's plane: u, v by its own texture fit, and how u, v
    and z change a pixel to the right and a pixel down (du_h, dv_h, dz_h, du_v, dv_v, dz_v). Frames (uv.frames) are in camera coordinates; a
    neighbour's ray that runs along the plane has null changes, a miss is left out."""
    from .uv import to_uv

    keys = ["image", "ix", "iy", "mesh", "facet", "dist", "cosine"]
    j = hits.select(*keys).where("facet is not null").join(dealt(facet_frames.select("mesh", "facet", *(a + b for a in "cn" for b in "xyz"))), ["mesh", "facet"])
    n = vec.vec("n")
    plane = vec.dot(n, vec.vec("c"))
    intrinsic = tuple(map(float, (*f, *c)))
    here = tuple(F.col("dist") * r for r in vec.pixel_ray(F.col("ix"), F.col("iy"), *intrinsic))
    places = dict(zip("xyz", here))
    for name, (dx, dy) in {"h": (1, 0), "v": (0, 1)}.items():
        ray = vec.pixel_ray(F.col("ix") + dx, F.col("iy") + dy, *intrinsic)
        far = F.try_divide(plane, F.nullif(vec.dot(n, ray), F.lit(0.0)))
        places |= {f"{name}{a}": far * r - o for a, r, o in zip("xyz", ray, here)}
    j = j.withColumns(places).select(*keys, *places)
    out = to_uv(j, facet_frames, {name: tuple(F.col(name + a) for a in "xyz") for name in "hv"})
    return out.select(*keys, "u", "v", "du_h", "dv_h", F.col("hz").alias("dz_h"), "du_v", "dv_v", F.col("vz").alias("dz_v"))


def weight_map(projected: DataFrame, angles: DataFrame, nx: int, ny: int, dx: float, dy: float, frame=(), threshold: float = 0.01, tile: int = 64) -> DataFrame:
    """frame, iu, iv, weight on the texels of an nx x ny texture: the projected agreement of the depths (sums sum_wv, sum_w of frame, iu, iv; less
    than threshold of weight counts as none), spread by clamped diffusion from 1 over dx and dy texels, times the projected factor of the
    angles (the same sums)."""
    from .diffusion import diffuse
    from .fusion import dense, normalize

    on = lambda s: normalize(s, threshold).select(*frame, F.col("iu").alias("ix"), F.col("iv").alias("iy"), "v")
    upper = dense(on(projected), nx, ny, frame=frame).select(*frame, "ix", "iy", F.col("v").alias("upper"), F.lit(1.0).alias("v"))
    blurred = diffuse(upper, nx, ny, dx, dy, tile, frame) if dx > 0 and dy > 0 else upper.select(*frame, "ix", "iy", F.col("upper").alias("v"))
    j = blurred.join(on(angles).withColumnRenamed("v", "a"), [*frame, "ix", "iy"], "left")
    return j.select(*frame, F.col("ix").alias("iu"), F.col("iy").alias("iv"), (F.col("v") * F.coalesce("a", F.lit(0.0))).alias("weight"))
