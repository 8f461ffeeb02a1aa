"""Vectors as tuples of Columns: plain arithmetic that Spark compiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(prefix: str = "", names: str = "xyz") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in names)


def dot(a, b) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def cross(a, b) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def cross2(a, b) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def sub(a, b):
    return tuple(x - y for x, y in zip(a, b))


def add_scaled(a, b, s):
    return tuple(x + y * s for x, y in zip(a, b))


def scale(a, s):
    return tuple(x * s for x in a)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a):
    """The vector over its length; null for a zero vector."""
    n = norm(a)
    return tuple(F.try_divide(x, n) for x in a)


def sign(x: Column) -> Column:
    """-1 or 1; zero counts as positive."""
    return F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))


def mat_vec(m: list, v) -> tuple[Column, ...]:
    """Row-major matrix of Columns or numbers times a vector."""
    n = len(v)
    col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return tuple(dot([col(x) for x in m[i : i + n]], v) for i in range(0, len(m), n))


def affine(m: list, p, w: float = 1.0):
    """A 4 x 4 frame transform of a point (w = 1) or a direction (w = 0)."""
    x, y, z, h = mat_vec(m, (*p, F.lit(float(w))))
    return (x, y, z) if w == 0 else (F.try_divide(x, h), F.try_divide(y, h), F.try_divide(z, h))


def axis_angle(axis: tuple[float, float, float], angle: float) -> list[float]:
    """Rotation by Rodrigues' formula, 4 x 4, row-major."""
    import math

    n = math.sqrt(sum(c * c for c in axis))
    x, y, z = (c / n for c in axis)
    c, s, k = math.cos(angle), math.sin(angle), 1 - math.cos(angle)
    return [c + x * x * k, x * y * k - z * s, x * z * k + y * s, 0, y * x * k + z * s, c + y * y * k, y * z * k - x * s, 0, z * x * k - y * s, z * y * k + x * s, c + z * z * k, 0, 0, 0, 0, 1]


def eigvals2(a, b, c, d) -> tuple[Column, Column]:
    """Eigenvalues of [[a, b], [c, d]] from trace and determinant, the larger first; null where they aren't real."""
    half, det = (a + d) / 2, a * d - b * c
    root = F.when(half * half - det >= 0, F.sqrt(F.greatest(half * half - det, F.lit(0.0))))
    return half + root, half - root


def plane_distance(normal, centre, origin, direction) -> Column:
    """Distance along a ray to a plane; null where they are parallel."""
    return F.try_divide(dot(normal, sub(centre, origin)), F.nullif(dot(normal, direction), F.lit(0.0)))


def pixel_ray(px, py, fx: float, fy: float, cx: float, cy: float):
    """Unit direction of a pinhole pixel, y and z turned from the image's to the scene's sense."""
    return unit(((px - cx) / fx, -(py - cy) / fy, F.lit(-1.0)))


def hit_direction_shift(normal, centre, origin, direction, change):
    """How the place where a ray meets a plane moves with its direction's change; null where they are parallel."""
    facing = F.nullif(dot(direction, normal), F.lit(0.0))
    far = F.try_divide(dot(normal, sub(centre, origin)), facing * facing)
    return tuple(far * (c * facing - dot(change, normal) * d) for c, d in zip(change, direction))


def hit_origin_shift(normal, direction, change):
    """How the place where a ray meets a plane moves with its origin's change; null where they are parallel."""
    t = F.try_divide(dot(change, normal), F.nullif(dot(direction, normal), F.lit(0.0)))
    return tuple(c - t * d for c, d in zip(change, direction))


def orthographic_ray(px, py, fx: float, fy: float, cu: float, cv: float):
    """(origin, direction) of a pixel without perspective."""
    return ((px - cu) / fx, -(py - cv) / fy, F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(-1.0))


def pixel_ray_shifts(px, py, fx: float, fy: float, cx: float, cy: float):
    """How the unit direction of a pinhole pixel changes a pixel to the right, and a pixel down."""
    raw = ((px - cx) / fx, -(py - cy) / fy, F.lit(-1.0))
    n = norm(raw)
    u = tuple(x / n for x in raw)
    out = []
    for step in ((F.lit(1 / fx), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(-1 / fy), F.lit(0.0))):
        along = dot(u, step)
        out.append(tuple((s - along * c) / n for s, c in zip(step, u)))
    return tuple(out)


def project(point, pose: list, fx: float, fy: float, cx: float, cy: float):
    """Pixel of a point: the pose (4 x 4, row by row, numbers or Columns) takes it before the camera, which looks along -z; null where the
    point isn't before it."""
    x, y, z = affine(pose, point)
    deep = F.when(z < 0, -z)
    return x / deep * fx + cx, -y / deep * fy + cy


def rotation(rx, ry, rz) -> list:
    """The 4 x 4 rotation, row by row, about a rotation vector whose length is the angle (Columns); no rotation for a zero vector."""
    angle = F.sqrt(rx * rx + ry * ry + rz * rz)
    x, y, z = (F.coalesce(F.try_divide(c, F.nullif(angle, F.lit(0.0))), F.lit(0.0)) for c in (rx, ry, rz))
    c, s = F.cos(angle), F.sin(angle)
    k, zero, one = 1 - c, F.lit(0.0), F.lit(1.0)
    return [c + x * x * k, x * y * k - z * s, x * z * k + y * s, zero, y * x * k + z * s, c + y * y * k, y * z * k - x * s, zero, z * x * k - y * s, z * y * k + x * s, c + z * z * k, zero, zero, zero, zero, one]
