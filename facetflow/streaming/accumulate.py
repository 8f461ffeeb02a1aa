"""Live accumulation: the state of a cell is its raw sums, so a stream gives what the batch over all its files gives.

A stream that is started again with the same store goes on from its checkpoint: sums and revisions of earlier runs are in the state. Pixels
with null keys are cells of their own; null values and weights count for nothing; an empty stream gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import fusion
from . import store as st

#: Cells of a tile's side: the state of `by_revision` is one array a tile and frame.
TILE = 16


def accumulate_stream(pixels: DataFrame) -> DataFrame:
    """Streaming sums of grabbed pixels (w > 0) by cell."""
    return fusion.accumulate(pixels.where("w > 0"))


def run_available(stream: DataFrame, name: str, cell: tuple[str, ...] = ("ix", "iy", "t"), store: str | None = None) -> DataFrame:
    """The state of an aggregated stream after all there is now. Each batch writes the cells that it changed, the newest row of a cell is
    read back, so work follows the input and not the state."""
    schema = ", ".join(f"{c} {kind}" for c, kind in stream.dtypes)
    rows = st.run_batches(stream, lambda b: b, name, schema, store, "update")
    return st.newest(rows, *cell).select(*stream.columns)


def normalized(sums: DataFrame) -> DataFrame:
    return fusion.normalize(sums).select("ix", "iy", "t", (F.round("v", 6) + 0.0).alias("v"), (F.round("sum_w", 6) + 0.0).alias("w"))


_OUT = "channel long, tx long, ty long, revision long, t long, cells array<int>, sum_wv array<double>, sum_w array<double>"
_STATE = "revision long, t array<long>, cell array<long>, sum_wv array<double>, sum_w array<double>"


def _tile(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Add a batch's pixels of a tile to its state. Pixels of an older revision than the state's are left out, those of a newer one start
    it anew."""
    if state.hasTimedOut:
        state.remove()
        return
    p = pd.concat(list(frames))
    t, cell = np.empty(0, np.int64), np.empty(0, np.int64)
    wv, w, revision = np.empty(0), np.empty(0), None
    if state.exists:
        revision, *old = state.get
        t, cell, wv, w = (np.asarray(x, kind) for x, kind in zip(old, (np.int64, np.int64, float, float)))
    newest = int(p["revision"].max())
    if revision is not None and newest < revision:
        return
    if revision is None or newest > revision:
        t, cell, wv, w, revision = t[:0], cell[:0], wv[:0], w[:0], newest
    p = p[p["revision"] == revision]
    touched = np.unique(p["t"].to_numpy(np.int64))
    both = np.stack((np.concatenate((t, p["t"].to_numpy(np.int64))), np.concatenate((cell, p["cell"].to_numpy(np.int64)))), 1)
    name, at = np.unique(both, axis=0, return_inverse=True)
    at = at.ravel()
    wv = np.bincount(at, np.concatenate((wv, (p["v"] * p["w"]).to_numpy(float))), len(name))
    w = np.bincount(at, np.concatenate((w, p["w"].to_numpy(float))), len(name))
    state.update((revision, name[:, 0].tolist(), name[:, 1].tolist(), wv.tolist(), w.tolist()))
    rows = []
    for frame in touched.tolist():
        mine = name[:, 0] == frame
        rows.append((*map(int, key), revision, frame, name[mine, 1].tolist(), wv[mine].tolist(), w[mine].tolist()))
    yield pd.DataFrame(rows, columns=["channel", "tx", "ty", "revision", "t", "cells", "sum_wv", "sum_w"])


def by_revision(pixels: DataFrame, name: str = "revisions", store: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """channel, revision, t, ix, iy, sum_wv, sum_w of streamed pixels (channel, revision, t, ix, iy, v, w): sums of the newest revision of the
    geometry that each tile of each channel has seen, whatever order the pixels come in. A new revision resets its tile.

    State is kept by tile, arrays of the cells seen; with ttl_ms a tile that gets no pixels for so long is forgotten, and later pixels of it
    begin anew. Rows without channel, revision, t or place are left out."""
    place = {"tx": F.floor(F.col("ix") / TILE), "ty": F.floor(F.col("iy") / TILE), "cell": (F.pmod("iy", F.lit(TILE)) * TILE + F.pmod("ix", F.lit(TILE))).cast("int")}
    p = pixels.where("w > 0 and v is not null and not isnan(v)").dropna(subset=["channel", "revision", "t", "ix", "iy"]).withColumns(place)
    p = p.select(F.col("channel").cast("long").alias("channel"), "tx", "ty", F.col("revision").cast("long").alias("revision"), F.col("t").cast("long").alias("t"), "cell", F.col("v").cast("double").alias("v"), F.col("w").cast("double").alias("w"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout

    def tile(key, frames, state):
        yield from _tile(key, frames, state)
        if ttl_ms and state.exists:
            state.setTimeoutDuration(ttl_ms)

    tiles = p.groupBy("channel", "tx", "ty").applyInPandasWithState(tile, _OUT, _STATE, "update", timeout)
    conf, idle = p.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(idle)
    if ttl_ms:
        conf.set(idle, "false")  # a timeout waits for the next pixels; else it would ask for empty batches without end
    try:
        rows = st.run_batches(tiles, lambda b: b, name, _OUT, store, "update")
    finally:
        conf.set(idle, before)
    now = st.newest(rows, "channel", "tx", "ty", "revision", "t")
    last = now.groupBy("channel", "tx", "ty").agg(F.max("revision").alias("revision"))
    cells = now.join(last, ["channel", "tx", "ty", "revision"]).withColumn("c", F.explode(F.arrays_zip("cells", "sum_wv", "sum_w")))
    at = lambda tile, c: (F.col(tile) * TILE + c).cast("int")
    return cells.select("channel", "revision", "t", at("tx", F.col("c.cells") % TILE).alias("ix"), at("ty", F.expr(f"c.cells div {TILE}")).alias("iy"), "c.sum_wv", "c.sum_w")
