"""Clamped heat diffusion on a raster, in tiles with a halo as wide as the number of steps: one shuffle, whatever the steps.

Defined results: a null or NaN bound holds a cell at 0; beyond the raster the value is the edge's own; an empty raster stays empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diffusion_steps(dx: float, dy: float) -> tuple[int, float, float, float]:
    """(steps, time step, and what squared differences along x and y are multiplied by) for distances in pixels: the larger one sets a
    time step of a quarter over its square; at least eight steps, an even number, reach the time of a quarter."""
    far = max(dx, dy)
    steps = max(8, round(far * far))
    steps += steps % 2
    return steps, 0.25 / steps, dx * dx, dy * dy


def steps_on(v: np.ndarray, upper: np.ndarray, steps: int, dt: float, rx: float, ry: float) -> np.ndarray:
    """Explicit 5-point steps; values are held to upper at each step's start. Outside is read as the edge itself."""
    for _ in range(steps):
        v = np.minimum(v, upper)
        p = np.pad(v, 1, mode="edge")
        v = v + dt * ((p[1:-1, :-2] + p[1:-1, 2:] - 2 * v) * rx + (p[:-2, 1:-1] + p[2:, 1:-1] - 2 * v) * ry)
    return v


def diffuse(raster: DataFrame, nx: int, ny: int, dx: float, dy: float, tile: int = 64, frame=()) -> DataFrame:
    """frame, ix, iy, v of a dense raster (frame, ix, iy, v, upper) after diffusion over dx and dy pixels, each frame alone."""
    steps, dt, rx, ry = diffusion_steps(dx, dy)
    span = lambda c, n: F.sequence(F.floor(F.greatest(F.col(c) - steps, F.lit(0)) / tile), F.floor(F.least(F.col(c) + steps, F.lit(n - 1)) / tile))
    held = raster.withColumn("upper", F.coalesce(F.nanvl(F.col("upper").cast("double"), F.lit(0.0)), F.lit(0.0)))
    dealt = held.withColumn("tx", F.explode(span("ix", nx))).withColumn("ty", F.explode(span("iy", ny)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf.ix.min(), pdf.iy.min()
        v, upper = (np.zeros((pdf.iy.max() - y0 + 1, pdf.ix.max() - x0 + 1)) for _ in range(2))
        v[pdf.iy - y0, pdf.ix - x0], upper[pdf.iy - y0, pdf.ix - x0] = pdf.v, pdf.upper
        core = pdf[(pdf.ix // tile == pdf.tx) & (pdf.iy // tile == pdf.ty)]
        out = steps_on(v, upper, steps, dt, rx, ry)
        return pd.DataFrame({**{f: core[f] for f in frame}, "ix": core.ix, "iy": core.iy, "v": out[core.iy - y0, core.ix - x0]})

    kinds = dict(raster.dtypes)
    return dealt.groupBy(*frame, "tx", "ty").applyInPandas(run, ", ".join([*(f"{f} {kinds[f]}" for f in frame), "ix int, iy int, v double"]))
