"""Waveforms as rows (wf, i, t, v): the analytic signal, contact weights, face images, contact stacks, envelopes and C-scans.

Defined results: i numbers a waveform's samples; a waveform with a null or NaN value has a null analytic signal in all its samples; cells
without validity have a null envelope; empty tables give empty results. A waveform is one Fourier transform, so it is one task's: that
group is as large as a waveform is long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def hilbert(v: np.ndarray) -> np.ndarray:
    """The analytic signal of real samples, along the last axis, by the discrete Fourier transform."""
    n = v.shape[-1]
    keep = np.zeros(n)
    keep[0] = 1
    keep[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        keep[n // 2] = 1
    return np.fft.ifft(np.fft.fft(v) * keep)


def _transformed(t: pa.Table, starts: np.ndarray) -> pa.Table:
    """t with re and im of its waveforms, which begin at starts; those of equal length are transformed at once."""
    v = t["v"].to_numpy().astype(float)  # nulls become NaN, and so does a whole waveform that holds one
    z = np.empty(len(v), complex)
    lens = np.diff(np.append(starts, len(v)))
    for n in np.unique(lens).tolist():
        at = starts[lens == n][:, None] + np.arange(n)
        z[at] = hilbert(v[at])
    return t.drop_columns(["v"]).append_column("re", pa.array(z.real, from_pandas=True)).append_column("im", pa.array(z.imag, from_pandas=True))


def analytic(waves: DataFrame) -> DataFrame:
    """wf, i, t, re, im of every sample. Waveforms lie one after another in their partition; a task holds a batch of rows and the waveform that
    goes on behind it."""

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            code = t["wf"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            last = int(starts[-1])
            if last:
                yield from _transformed(t.slice(0, last), starts[:-1]).to_batches()
            rest = t.slice(last)
        if rest is not None:
            yield from _transformed(rest, np.zeros(1, int)).to_batches()

    ship(waves.sparkSession)
    kinds = dict(waves.dtypes)
    rows = waves.select("wf", "i", "t", "v").repartition("wf").sortWithinPartitions("wf", "i")
    return rows.mapInArrow(run, f"wf {kinds['wf']}, i {kinds['i']}, t {kinds['t']}, re double, im double")


def analytic_rows(shots: DataFrame, *keep: str) -> DataFrame:
    """keep, re, im (arrays) of waveforms that are rows with an array v: nothing is shuffled. An array that is null or holds a null or NaN gives nulls."""
    kinds = dict(shots.dtypes)

    def run(frames):
        for pdf in frames:
            z = [None if v is None else hilbert(np.asarray(v, float)) if len(v) else np.zeros(0, complex) for v in pdf.v]
            whole = [x is not None and bool(np.isfinite(x).all()) for x in z]
            yield pdf[list(keep)].assign(re=[x.real if ok else None for x, ok in zip(z, whole)], im=[x.imag if ok else None for x, ok in zip(z, whole)])

    return shots.select(*keep, "v").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "re array<double>, im array<double>"]))


def validity(c: Column) -> Column:
    """A contact's weight: c, less under 0.4 and 0 under 0.1."""
    return F.when(c < 0.1, F.lit(0.0)).when(c < 0.4, c * c / 0.4).otherwise(c)


def contact_weight(signal: DataFrame, no_contact: DataFrame, first: int, last: int) -> DataFrame:
    """wf, c, validity of each waveform: c is 1 less its energy between two samples over that of the waveform without contact (one waveform;
    all c are null if it is missing or silent); validity is c, less under 0.4 and 0 under 0.1."""
    energy = F.sum(F.when(F.col("i").between(first, last), F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    ref = no_contact.agg(energy.alias("e0"))
    c = signal.groupBy("wf").agg(energy.alias("e")).crossJoin(F.broadcast(ref))  # ref is one row
    c = c.select("wf", (1 - F.try_divide("e", F.nullif(F.col("e0"), F.lit(0.0)))).alias("c"))
    return c.withColumn("validity", validity(F.col("c")))


def on_face(signal: DataFrame, side: int, diameter: float) -> DataFrame:
    """signal (cu, cv, i, re, im, ...) on a square face around (cu, cv): iu, iv and the Gaussian validity w = exp(-r^2 / (diameter / 3)^2),
    r in cells. The face's cells come from a constant array, so nothing is shuffled."""
    half = side // 2
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for b in range(-half, side - half) for a in range(-half, side - half)))
    s = signal.withColumn("face", F.explode(cells))
    a, b = F.col("face.a"), F.col("face.b")
    return s.withColumns({"iu": (F.col("cu") + a).cast("int"), "iv": (F.col("cv") + b).cast("int"), "w": F.exp(-(a * a + b * b) / (diameter / 3) ** 2)}).drop("face")


def accumulate_contacts(faces: DataFrame) -> DataFrame:
    """iu, iv, i, re, im, validity: weighted sums over all shots, in any order."""
    weighed = lambda c: F.sum(F.col("w") * F.col(c)).alias(c)
    return faces.where("re is not null and im is not null").groupBy("iu", "iv", "i").agg(weighed("re"), weighed("im"), F.sum("w").alias("validity"))


def envelope(stack: DataFrame) -> DataFrame:
    """stack with env, the magnitude over the validity."""
    return stack.withColumn("env", F.try_divide(F.hypot("re", "im"), F.nullif(F.col("validity"), F.lit(0.0))))


def gate_peak(envelopes: DataFrame, t1: float, t2: float, *cell: str) -> DataFrame:
    """cell, peak, n: the largest envelope between two times (column `at`)."""
    return envelopes.where(F.col("at").between(t1, t2)).groupBy(*cell).agg(F.max("env").alias("peak"), F.count("*").alias("n"))
