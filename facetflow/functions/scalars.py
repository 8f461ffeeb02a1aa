"""Pixel values, axes and layers as Column expressions.

Null and NaN values are both missing. An axis is (first value, step, length).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least and largest code of quantised pixels by bits; 0 stands for a missing value.
CODES = {8: (1, 255), 16: (10, 65535)}


def missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def quantize(v: Column, low: Column | float, high: Column | float, bits: int = 8) -> Column:
    """Codes of values between low and high, truncated; values beyond get the outermost codes, missing ones 0. Null where low = high."""
    a, b = CODES[bits]
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    code = F.floor(F.try_divide(v - low, high - low) * (b - a) + a)
    return F.when(missing(v), 0).when(v < low, a).when(v > high, b).otherwise(code).cast("int")


def dequantize(code: Column, low: Column | float, high: Column | float, bits: int = 8) -> Column:
    """Values of codes; null for 0, which stands for a missing value."""
    a, b = CODES[bits]
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(code != 0, (code.cast("double") - a) / (b - a) * (high - low) + low)


def invert(code: Column, bits: int = 8) -> Column:
    return CODES[bits][1] - code


def normalize(v: Column, offset: float, units: float) -> Column:
    """Offset becomes a half, offset + units one and a half."""
    return (v - offset) / units + 0.5


def scale(v: Column, offset: float, units: float) -> Column:
    return (v - offset) / units


def pixel_to_physical(i: Column, first: Column | float, step: Column | float) -> Column:
    return first + i * step


def physical_to_pixel(x: Column, first: Column | float, step: Column | float, n: int, flip: bool = True) -> Column:
    """Index of the pixel whose centre is nearest (upwards at a half), counted from the far end where flipped; not clipped."""
    i = F.floor((x - first) / step + 0.5).cast("int")
    return n - 1 - i if flip else i


def reverse(i: Column, n: int) -> Column:
    return n - 1 - i


def dots_per_inch(step_metres: Column) -> Column:
    return F.try_divide(F.lit(0.0254), F.nullif(step_metres, F.lit(0.0)))


def layer_text(depth_mm: Column) -> Column:
    return F.format_string("Depth = %f mm", depth_mm)


def layer_depth(frame: Column, reflectors: Column) -> Column:
    """0 for frame 0; frame k has the k-th reflector from the end; null beyond."""
    return F.when(frame == 0, F.lit(0.0)).otherwise(F.get(reflectors, F.size(reflectors) - frame))


def incidence_weight(a: tuple, b: tuple) -> tuple[Column, Column]:
    """(angle, weight) of two unit vectors, whatever their senses; weight 0 from 67.5 degrees on, else cos(4/3 angle)."""
    from .vec import dot

    angle = F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))
    return angle, F.when(angle > math.radians(67.5), F.lit(0.0)).otherwise(F.cos(angle * (4 / 3)))


def raised_cosine(r: Column, fraction: float = 0.4) -> Column:
    """1 at 0, falling to 0 where r reaches the kernel's width."""
    x = r * (fraction * math.pi / math.sqrt(2))
    return F.when(x > math.pi, F.lit(0.0)).otherwise(0.5 + 0.5 * F.cos(x))


def slice_axis(i: Column, n: int, start: int | None = None, stop: int | None = None, step: int = 1) -> tuple[Column, Column, tuple[int, int]]:
    """(whether pixel i is in the slice, its index there, (first kept pixel, length)). Negative bounds count from the end, bounds beyond
    the axis are clipped; step is positive and a rest shorter than a step is left out."""
    if step < 1:
        raise ValueError("step must be positive")
    a = 0 if start is None else min(max(start + n * (start < 0), 0), n - 1)
    b = n if stop is None else min(stop + n * (stop < 0), n)
    length = max(0, (b - a) // step)
    return (i >= a) & (i < a + length * step) & ((i - a) % step == 0), F.floor((i - a) / step).cast("int"), (a, length)


def orthographic_matrix(step_u: Column, first_u: Column, step_v: Column, first_v: Column) -> Column:
    """The 2 x 3 matrix, row by row, that takes physical coordinates to pixels of axes (first, step)."""
    over = lambda x, s: F.try_divide(x, F.nullif(s, F.lit(0.0)))
    return F.array(over(F.lit(1.0), step_u), F.lit(0.0), over(-first_u, step_u), F.lit(0.0), over(F.lit(1.0), step_v), over(-first_v, step_v))
