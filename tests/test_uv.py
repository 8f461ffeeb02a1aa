"""Point location in polygons of three to seven corners against the winding number, and on odd input."""

import random

from facetflow.operators import uv


def winds(ring, x, y):
    """Whether a point is in a ring or on it."""
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        s = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if s == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        n += (ay <= y < by and s > 0) - (by <= y < ay and s < 0)
    return n != 0


def test_points_in_polygons_of_all_sizes(spark):
    rng = random.Random(1)
    grid = lambda: rng.randrange(17) / 16
    rings = {(m, f): [(grid(), grid()) for _ in range(rng.choice((3, 4, 4, 5, 7)))] for m in (1, 2) for f in range(25)}
    corners = [(m, f, k, x, y) for (m, f), ring in rings.items() for k, (x, y) in enumerate(ring)] + [(1, 99, 0, 0.1, 0.1), (1, 99, 1, 0.9, 0.9)]
    points = [(m, i, grid(), grid()) if i % 2 else (m, i, rng.random(), rng.random()) for m in (1, 2, 3) for i in range(150)] + [(1, 900, None, 0.5), (1, 901, -0.1, 0.5), (1, 902, 1.0, 1.0), (1, 903, float("nan"), 0.5)]
    c = spark.createDataFrame(corners, "mesh long, facet long, k int, u double, v double")
    p = spark.createDataFrame(points, "mesh long, id long, u double, v double")
    got = {(r.mesh, r.id): r.facet for r in uv.locate(p, uv.cells(uv.polygons(c))).collect()}
    assert len(got) == len(points)
    for m, i, x, y in points:
        inside = [f for (n, f), ring in rings.items() if n == m and x is not None and 0 <= x <= 1 and winds(ring, x, y)]
        assert got[m, i] == min(inside, default=None), (m, i, x, y)
    assert all(r.facet is None for r in uv.locate(p, uv.cells(uv.polygons(c.limit(0)))).collect())
    few = uv.cells(uv.polygons(c.where("mesh = 1 and facet < 3 and k < 4")))
    assert uv.locate(p.limit(0), few).count() == 0
