"""Texts as byte arrays cut into pieces, with 64-bit piece hashes: the numpy helpers that the text operators share.

Equal pieces have equal hashes. A hash folds a piece's eight-byte lanes with a non-linear mixing step, so no structure of a text (as
there is for sums of powers) makes two pieces clash: pieces of up to eight bytes never share a hash with others of their length, longer
ones share it like random numbers do. Where a wrong result could follow, the callers compare bytes on top.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..session import ship

SENTINEL = 0xFF  # never a byte of UTF-8; stands after each text
CHUNK = 1 << 20

#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: 0-9, a-z and all of what is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = True
WORD[128:255] = True
#: For bytes.translate: lower case, and a space for every byte outside words.
TO_WORDS = bytes(int(LOWER[i]) if WORD[LOWER[i]] else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, in order."""
    return (text or "").encode().translate(TO_WORDS).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def release() -> None:
    """Give freed memory back to the machine: Spark keeps idle workers, and what their allocators hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def task(run):
    """A mapInArrow function that releases memory when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow with this package on the executors, and memory released when a task ends."""
    ship(df.sparkSession)
    return df.mapInArrow(task(run), schema)


_LANE = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_GOLD, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Longer pieces are hashed one at a time.
_MANY_LANES = 128


def hash_pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    lens = ends - starts
    h = mix((lanes[starts] & _LANE[np.minimum(lens, 8)]) ^ (lens.astype(np.uint64) * _FOLD))
    more = np.flatnonzero(lens > 8)
    long = more[lens[more] > _MANY_LANES]
    more = more[lens[more] <= _MANY_LANES]
    at = 8
    while len(more):
        left = np.minimum(lens[more] - at, 8)
        h[more] = mix((h[more] + _GOLD) ^ (lanes[starts[more] + at] & _LANE[left]))
        at += 8
        more = more[lens[more] > at]
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        h[long] = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return h


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each range, one range after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def chunks(texts: list[str | None], size: int = CHUNK):
    """(first, last, bytes of texts[first:last] with the sentinel after each), about size bytes at a time."""
    part, first, have = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode()
        part.append(b)
        have += len(b) + 1
        if have >= size:
            yield first, i + 1, np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8)
            part, first, have = [], i + 1, 0
    if part:
        yield first, len(texts), np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a chunk and, for each of its texts, where its words begin (one more entry than texts)."""
    low = LOWER[buf]
    starts, ends = runs(WORD[low])
    stops = np.flatnonzero(buf == SENTINEL)
    return hash_pieces(low, starts, ends), np.concatenate(([0], np.searchsorted(starts, stops)))


class PieceCache:
    """hash -> row number, as sorted arrays. The owner clears it, and what the rows stand for, when it is full."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.rows = np.empty(0, np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, found) for each hash."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.rows[at], self.keys[at] == h

    def add(self, h: np.ndarray) -> np.ndarray:
        """Give the new hashes the next rows."""
        first = len(self.keys)
        rows = np.arange(first, first + len(h))
        keys = np.concatenate((self.keys, h))
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], np.concatenate((self.rows, rows))[order]
        return rows


class Ragged:
    """Rows of values of any length in one growing buffer."""

    def __init__(self, dtype):
        self.flat = np.empty(1024, dtype)
        self.offsets = np.zeros(1, np.int64)

    def append(self, values: np.ndarray, lens: np.ndarray) -> None:
        used = int(self.offsets[-1])
        if used + len(values) > len(self.flat):
            grown = np.empty(max(2 * len(self.flat), used + len(values)), self.flat.dtype)
            grown[:used] = self.flat[:used]
            self.flat = grown
        self.flat[used : used + len(values)] = values
        self.offsets = np.concatenate((self.offsets, used + np.cumsum(lens)))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values one after another, and their lengths."""
        starts = self.offsets[rows]
        lens = self.offsets[rows + 1] - starts
        return self.flat[ragged(starts, lens)], lens
