"""Analytic signals of waveforms of any length, in any order of rows, against one transform a waveform."""

import random

import numpy as np
import pyarrow as pa

from facetflow.operators import waves


def test_analytic_signals(spark):
    rng = random.Random(1)
    rows = [(wf, i, i * 0.5, rng.gauss(0, 1)) for wf in range(40) for i in range((1, 2, 7, 8, 8, 31)[wf % 6])]
    rows += [(100, 0, 0.0, 1.0), (100, 1, 0.5, None), (101, 0, 0.0, float("nan")), (None, 0, 0.0, 1.0), (None, 1, 0.5, 2.0), (102, 0, None, 5.0)]
    mixed = rows[:]
    rng.shuffle(mixed)
    df = spark.createDataFrame(mixed, "wf long, i long, t double, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = {(r.wf, r.i): (r.t, r.re, r.im) for r in waves.analytic(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for wf in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == wf), key=lambda r: r[1])
        z = waves.hilbert(np.array([np.nan if r[3] is None else r[3] for r in mine]))
        for r, x in zip(mine, z):
            t, re, im = got[wf, r[1]]
            assert t == r[2] and ((re is None and im is None) if np.isnan(x) else np.allclose((re, im), (x.real, x.imag)))
    assert waves.analytic(df.limit(0)).count() == 0


def test_waveforms_of_one_length_at_once():
    v = np.random.default_rng(2).normal(size=(5, 12))
    t = pa.table({"wf": np.repeat(np.arange(5), 12), "v": v.ravel()})
    out = waves._transformed(t, np.arange(0, 60, 12))
    assert np.allclose(out["re"].to_numpy() + 1j * out["im"].to_numpy(), np.concatenate([waves.hilbert(x) for x in v]))
