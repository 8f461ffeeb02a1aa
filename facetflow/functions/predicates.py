"""Geometric predicates as Column expressions over rings (arrays of struct x, y; in space x, y, z).

Null coordinates give null. Edges and corners are inside, and boxes are closed.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Array of struct(a, b): each corner with the next, the last with the first."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def side(ax, ay, bx, by, px, py) -> Column:
    """Positive where p lies to the left of a-b."""
    return (bx - ax) * (py - ay) - (px - ax) * (by - ay)


def _step(a, b, px, py) -> Column:
    s = side(a["x"], a["y"], b["x"], b["y"], px, py)
    up = (a["y"] <= py) & (b["y"] > py) & (s > 0)
    down = (a["y"] > py) & (b["y"] <= py) & (s < 0)
    return F.when(up, 1).when(down, -1).otherwise(0)


def _on(a, b, px, py) -> Column:
    s = side(a["x"], a["y"], b["x"], b["y"], px, py)
    return (s == 0) & (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"])) & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"]))


def in_polygon(ring: Column, px: Column, py: Column, tolerance: float = 0.0) -> Column:
    """Winding number test; corners and edges, and what is within tolerance of an edge, are inside."""
    e = _edges(ring)
    wind = F.aggregate(e, F.lit(0), lambda n, x: n + _step(x["a"], x["b"], px, py))
    near = (lambda x: _edge_distance2(x["a"], x["b"], px, py) <= tolerance * tolerance) if tolerance else (lambda x: _on(x["a"], x["b"], px, py))
    return (wind != 0) | F.exists(e, near)


def _edge_distance2(a, b, px, py) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.try_divide((px - a["x"]) * dx + (py - a["y"]) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0)))
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    x, y = a["x"] + t * dx - px, a["y"] + t * dy - py
    return x * x + y * y


def winding(ring: Column, px: Column, py: Column) -> Column:
    """Turns of the ring around a point, by its edges' angles; null on a corner or an edge."""
    e = F.transform(_edges(ring), lambda s: F.struct((s["a"]["x"] - px).alias("ax"), (s["a"]["y"] - py).alias("ay"), (s["b"]["x"] - px).alias("bx"), (s["b"]["y"] - py).alias("by")))
    det, dot = lambda s: s["ax"] * s["by"] - s["bx"] * s["ay"], lambda s: s["ax"] * s["bx"] + s["ay"] * s["by"]
    on = F.exists(e, lambda s: (det(s) == 0) & (dot(s) <= 0))
    return F.when(~on, F.aggregate(e, F.lit(0.0), lambda n, s: n + F.atan2(det(s), dot(s))) / (2 * math.pi))


def inside_by_winding(turns: Column) -> Column:
    """On the ring, or around it by a thousandth of a turn at least: what is no whole turn comes from rounding near an edge."""
    return turns.isNull() | (F.abs(turns) >= 0.001)


def in_polygon3(ring: Column, point: tuple, first: tuple, second: tuple) -> Column:
    """in_polygon for a planar ring in space, in the plane of two in-plane vectors."""
    flat = lambda x, y, z, e: x * e[0] + y * e[1] + z * e[2]
    r = F.transform(ring, lambda q: F.struct(flat(q["x"], q["y"], q["z"], first).alias("x"), flat(q["x"], q["y"], q["z"], second).alias("y")))
    return in_polygon(r, flat(*point, first), flat(*point, second))


def clip_front(ring: Column, near: Column) -> Column:
    """The part of a ring in camera coordinates that lies in front of the plane z = -near (the camera looks along -z), corner by corner and edge
    by edge in their order: an edge that crosses the plane leaves its place there. Empty where nothing is in front."""
    none = F.array().cast("array<struct<x:double,y:double,z:double>>")

    def part(s):
        a, b = s["a"], s["b"]
        t = (-near - a["z"]) / F.nullif(b["z"] - a["z"], F.lit(0.0))
        point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"), p["z"].cast("double").alias("z"))
        cross = F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"), (-near).alias("z"))
        first, second = a["z"] <= -near, b["z"] <= -near
        return F.when(first & second, F.array(point(a))).when(first, F.array(point(a), cross)).when(second, F.array(cross)).otherwise(none)

    return F.flatten(F.transform(_edges(ring), part))


def vertices_in_box(ring: Column, low: dict, high: dict) -> Column:
    """Whether all corners are in a closed box; low and high by axis name, two or three of them."""
    inside = lambda q: functools.reduce(lambda a, b: a & b, [(q[n] >= low[n]) & (q[n] <= high[n]) for n in low])
    return F.forall(ring, inside)


def polygon_hits_box2(ring: Column, bx0, by0, bx1, by1) -> Column:
    """Whether an edge meets the box."""
    return F.exists(_edges(ring), lambda s: segment_hits_box2(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], bx0, by0, bx1, by1))


def box_in_polygon2(ring: Column, bx0, by0, bx1, by1) -> Column:
    """Whether all four corners of the box are inside."""
    return functools.reduce(lambda a, b: a & b, [in_polygon(ring, x, y) for x in (bx0, bx1) for y in (by0, by1)])


def polygon_touches_box2(ring: Column, bx0, by0, bx1, by1) -> Column:
    """Whether a polygon and a box have a point in common: corners in the box, an edge that meets it, or the box inside."""
    return vertices_in_box(ring, {"x": bx0, "y": by0}, {"x": bx1, "y": by1}) | polygon_hits_box2(ring, bx0, by0, bx1, by1) | box_in_polygon2(ring, bx0, by0, bx1, by1)


def segment_hits_box(a: tuple, b: tuple, low: tuple, high: tuple) -> Column:
    """Slab method for a segment in two or three dimensions."""
    enter, leave, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q, lo, hi in zip(a, b, low, high):
        d = q - p
        t0, t1 = F.try_divide(lo - p, F.nullif(d, F.lit(0.0))), F.try_divide(hi - p, F.nullif(d, F.lit(0.0)))
        enter, leave = F.greatest(enter, F.least(t0, t1)), F.least(leave, F.greatest(t0, t1))  # nulls, where d is 0, are passed over
        ok = ok & ((d != 0) | ((p >= lo) & (p <= hi)))
    return ok & (enter <= leave)


def polygon_hits_box3(ring: Column, normal: tuple, first: tuple, second: tuple, low: tuple, high: tuple) -> Column:
    """Whether a planar polygon meets a box: an edge does, or one of the box's diagonals goes through the polygon. normal and the two
    in-plane vectors are Columns."""
    xyz = lambda q: (q["x"], q["y"], q["z"])
    edge = F.exists(_edges(ring), lambda s: segment_hits_box(xyz(s["a"]), xyz(s["b"]), low, high))
    p0, through = F.get(ring, F.lit(0)), F.lit(False)
    plane = sum(n * c for n, c in zip(normal, xyz(p0)))
    for flip in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)):
        a = tuple(h if f else lo for f, lo, h in zip(flip, low, high))
        d = tuple((lo if f else h) - c for f, lo, h, c in zip(flip, low, high, a))
        t = F.try_divide(plane - sum(n * c for n, c in zip(normal, a)), F.nullif(sum(n * c for n, c in zip(normal, d)), F.lit(0.0)))
        at = tuple(c + t * s for c, s in zip(a, d))
        through = through | F.coalesce(t.between(0, 1) & in_polygon3(ring, at, first, second), F.lit(False))
    return edge | through


def in_quad(corners: list[tuple[Column, Column]], px: Column, py: Column) -> Column:
    """in_polygon for a fixed number of corner columns: no arrays, so all of it is compiled."""
    wind, on = F.lit(0), F.lit(False)
    for a, b in zip(corners, corners[1:] + corners[:1]):
        a, b = {"x": a[0], "y": a[1]}, {"x": b[0], "y": b[1]}
        wind, on = wind + _step(a, b, px, py), on | _on(a, b, px, py)
    return (wind != 0) | on


def segment_hits_box2(x1, y1, x2, y2, bx0, by0, bx1, by1) -> Column:
    """Separating axes: both box axes, and the segment's normal."""
    cx, cy, hx, hy = (bx0 + bx1) / 2, (by0 + by1) / 2, (bx1 - bx0) / 2, (by1 - by0) / 2
    mx, my, dx, dy = (x1 + x2) / 2 - cx, (y1 + y2) / 2 - cy, (x2 - x1) / 2, (y2 - y1) / 2
    return (F.abs(mx) <= hx + F.abs(dx)) & (F.abs(my) <= hy + F.abs(dy)) & (F.abs(mx * dy - my * dx) <= hx * F.abs(dy) + hy * F.abs(dx))


def segments_cross(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    """Proper crossing only; touching and collinear segments don't cross."""
    return (side(x1, y1, x2, y2, x3, y3) * side(x1, y1, x2, y2, x4, y4) < 0) & (side(x3, y3, x4, y4, x1, y1) * side(x3, y3, x4, y4, x2, y2) < 0)


def ray_hits_box(origin, direction, low, high) -> Column:
    """Slab method; a zero component must start inside its slab, boxes behind are missed."""
    enter, leave, ok = F.lit(0.0), F.lit(float("inf")), F.lit(True)
    for o, d, a, b in zip(origin, direction, low, high):
        flat = d == 0
        t0, t1 = F.try_divide(a - o, d), F.try_divide(b - o, d)
        enter = F.when(flat, enter).otherwise(F.greatest(enter, F.least(t0, t1)))
        leave = F.when(flat, leave).otherwise(F.least(leave, F.greatest(t0, t1)))
        ok = ok & (~flat | ((o >= a) & (o <= b)))
    return ok & (enter <= leave)
