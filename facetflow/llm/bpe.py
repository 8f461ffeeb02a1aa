"""Byte-level BPE: DuckDB recursion contracts words in each task, ordered aggregation decodes.

A text is cut into the pieces of the split pattern; each distinct piece that the task hasn't met is encoded once. A recursive
query holds every unfinished word as its list of tokens: token positions join the merge table, the word's minimum-rank pair
(the leftmost of equal ones) is contracted, and a word without a joinable pair has reached its fixpoint. Tokens of the words are
then joined to the vocabulary and their bytes aggregated in token order, which decodes them. Pieces longer than
max_recursive_bytes, whose recursion would take as many rounds as they have bytes, go through a heap in Python with the same rule.

Defined results: null and empty texts have no tokens; each row is encoded alone, so ties and repeated rows change nothing;
extra columns are left out. Pieces are looked up by hash and compared by bytes: what decodes to other bytes than the text's is encoded
anew without hashes. Memory: a megabyte of text at a time (a longer text alone), max_pieces cached pieces a task, and a recursive
query's rounds within ROUNDS_BYTES; DuckDB never spills to a local folder.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import SENTINEL, PieceCache, Ragged, arrow_map, chunks, hash_pieces, ragged

MAX_PIECES = 500_000
MAX_RECURSIVE_BYTES = 1_024
#: Words of one recursive query, and bytes of all their rounds, which it holds at once (a word's square, times two).
PART, ROUNDS_BYTES = 5_000, 64 << 20

_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:255] = _LETTER
_CLASS[48:58] = _NUMBER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[SENTINEL] = _END

_RARE = np.zeros(256, bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0x27]] = True
_RARE[128:255] = True
_RARE[0xC3] = False


def _plain(buf: np.ndarray) -> bool:
    """Whether a chunk is only ASCII without apostrophes and separators, and letters of Latin-1: array operations can cut it."""
    rare = np.flatnonzero(_RARE[buf])
    b = buf[rare]
    return bool(np.all((buf[rare - 1] == 0xC3) & (b >= 0x80) & (b <= 0xBF) & (b != 0x97) & (b != 0xB7))) and buf[0] not in range(128, 0xC3)


_ENCODE = """
WITH RECURSIVE step(round, word, tokens) AS (
  SELECT 0, word, tokens FROM words
  UNION ALL
  SELECT round + 1, s.word, tokens[1:spot - 1] || [merged] || tokens[spot + 2:]
  FROM step s JOIN (
    SELECT word, min(m.rank::BIGINT * 1048576 + spot) AS best, (best // 1048576)::INTEGER AS merged, (best % 1048576)::INTEGER AS spot
    FROM (SELECT word, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, generate_subscripts(tokens[2:], 1) AS spot FROM step) p
    JOIN merges m ON m.pair = p.a::BIGINT * 4294967296 + p.b
    GROUP BY word
  ) b ON b.word = s.word
)
SELECT word, arg_max(tokens, round) AS tokens FROM step GROUP BY word ORDER BY word
"""

_DECODE = """
SELECT word, unhex(string_agg(v.bytes, '' ORDER BY spot)) AS bytes
FROM (SELECT word, unnest(tokens) AS id, generate_subscripts(tokens, 1) AS spot FROM encoded) t JOIN vocabulary v USING (id)
GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One vocabulary with its merge table in DuckDB."""

    def __init__(self, path: str, pattern: str, max_recursive_bytes: int = MAX_RECURSIVE_BYTES):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.limit = max_recursive_bytes
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, ranks = [], []
        for b, rank in self.ranks.items():
            for cut in range(1, len(b)):
                x, y = self.ranks.get(b[:cut]), self.ranks.get(b[cut:])
                if x is not None and y is not None:
                    pairs.append((x << 32) + y)
                    ranks.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.db.register("t", pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(ranks, pa.int32())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM t")
        self.db.register("t", pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "bytes": [b.hex() for b in self.bytes_of.values()]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM t")
        self.decimal = Ragged(np.uint8)
        texts = [f"{i},".encode() for i in range(max(self.bytes_of) + 1)]
        self.decimal.append(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
        self.cache = PieceCache()
        self.clear()

    def clear(self) -> None:
        self.cache.clear()
        self.ids, self.text, self.decoded = Ragged(np.int32), Ragged(np.uint8), Ragged(np.uint8)

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _heap(self, word: bytes) -> list[int]:
        """The same contraction for one long word, with a heap of pairs over a linked list."""
        tok: list[int | None] = [int(self.first[c]) for c in word]
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = [(r, i) for i in range(len(word) - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(word) or self.ranks.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], tok[i], parts[j] = parts[i] + parts[j], rank, None
            after[i] = after[j]
            if after[i] < len(word):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < len(word) and (r := self.ranks.get(parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return [t for t, p in zip(tok, parts) if p is not None]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the words, one word after another, and how many each has."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        sizes = np.array([len(w) for w in words])
        lens = np.where(whole >= 0, 1, 0)
        parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        short = np.flatnonzero((whole < 0) & (sizes <= self.limit))
        heavy = np.cumsum(2 * sizes[short].astype(np.int64) ** 2)
        turn = np.maximum(np.arange(len(short)) // PART, heavy // ROUNDS_BYTES)
        for part in np.split(short, np.flatnonzero(np.diff(turn)) + 1) if len(short) else []:
            flat = pa.array(self.first[np.frombuffer(b"".join(words[i] for i in part), np.uint8)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes[part]))).astype(np.int32)), flat)
            self.db.register("words", pa.table({"word": pa.array(np.arange(len(part), dtype=np.int32)), "tokens": lists}))
            tokens = self.db.sql(_ENCODE).to_arrow_table().column("tokens").combine_chunks()
            lens[part] = np.diff(tokens.offsets.to_numpy())
            parts.append((part, tokens.flatten().to_numpy()))
        for i in np.flatnonzero((whole < 0) & (sizes > self.limit)):
            tokens = self._heap(words[i])
            lens[i] = len(tokens)
            parts.append((np.array([i]), np.array(tokens, np.int32)))
        starts = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), np.int32)
        for part, tokens in parts:
            out[ragged(starts[part], lens[part])] = tokens
        return out, lens

    def decode_words(self, tokens: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes that the token lists stand for, one list after another, and how many each has. No list is empty."""
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))).astype(np.int32)), pa.array(tokens))
        self.db.register("encoded", pa.table({"word": pa.array(np.arange(len(lens), dtype=np.int32)), "tokens": lists}))
        raw = self.db.sql(_DECODE).to_arrow_table().column("bytes").combine_chunks()
        sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4))
        return np.frombuffer(raw.buffers()[2], np.uint8)[: int(sizes.sum())], sizes

    def _fill(self, stores, words: list[bytes]) -> None:
        """A row for each word in the stores of ids, their decimal text and their decoded bytes."""
        tokens, lens = self.encode_words(words)
        digits, sizes = self.decimal.take(tokens)
        stores[0].append(tokens, lens)
        stores[1].append(digits, np.add.reduceat(sizes, np.cumsum(lens) - lens))
        stores[2].append(*self.decode_words(tokens, lens))

    def _by_bytes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Values and lengths from each store for pieces of which some share a hash: their bytes tell them apart."""
        names: dict[bytes, int] = {}
        rows = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(starts.tolist(), ends.tolist())])
        stores = Ragged(np.int32), Ragged(np.uint8), Ragged(np.uint8)
        self._fill(stores, list(names))
        return [store.take(rows) for store in stores]

    def _cut(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of plain texts, each followed by the sentinel."""
        kind = _CLASS[buf]
        start = np.empty(len(buf), bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        space = kind == _SPACE
        solid = ~space & (kind != _END)
        last = np.zeros(len(buf), bool)
        last[:-1] = space[:-1] & solid[1:]
        start |= last
        start[1:] &= ~(solid[1:] & last[:-1] & (buf[:-1] == 32))
        start[1:] |= kind[:-1] == _END
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(buf))
        real = kind[starts] != _END
        return starts[real], ends[real]

    def encode_chunk(self, texts: list[str | None], max_pieces: int) -> list[tuple[np.ndarray, bytes, bytes]]:
        return list(self.encode_each(texts, max_pieces))

    def encode_each(self, texts: list[str | None], max_pieces: int):
        """(ids, ids as decimal text with commas, decoded bytes) of each text, a chunk at a time."""
        for first, stop, buf in chunks(texts):
            part = [t or "" for t in texts[first:stop]]
            if _plain(buf):
                starts, ends = self._cut(buf)
            else:
                sizes, gap = [], []
                for t in part:
                    found = [len(p.encode()) for p in self.pattern.findall(t)]
                    sizes += found
                    gap += [0] * (len(found) - 1) + [1] if found else []
                    if not found:
                        gap, sizes = [*gap, 1], [*sizes, 0]
                ends = np.cumsum(np.array(sizes) + np.array(gap)) - np.array(gap)
                starts = ends - np.array(sizes)
                starts, ends = starts[ends > starts], ends[ends > starts]
            h = hash_pieces(buf, starts, ends)
            if len(self.cache.keys) > max_pieces:
                self.clear()
            distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            known = self.cache.find(distinct)[1]
            if not known.all():
                raw = buf.tobytes()
                self._fill((self.ids, self.text, self.decoded), [raw[starts[i] : ends[i]] for i in at[~known]])
                self.cache.add(distinct[~known])
            rows = self.cache.find(distinct)[0][inverse]
            edge = np.concatenate(([0], np.searchsorted(starts, np.flatnonzero(buf == SENTINEL))))
            got = [store.take(rows) for store in (self.ids, self.text, self.decoded)]
            if not (np.array_equal(got[2][1], ends - starts) and np.array_equal(got[2][0], buf[buf != SENTINEL])):
                got = self._by_bytes(buf.tobytes(), starts, ends)
            cuts = [np.concatenate(([0], np.cumsum(lens)))[edge] for _, lens in got]
            for k in range(len(part)):
                ids, text, raw = (flat[c[k] : c[k + 1]] for (flat, _), c in zip(got, cuts))
                yield ids, text[:-1].tobytes(), raw.tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec. Its merge table outlives a task where Spark reuses the worker; its cached pieces go with the task, so that idle workers hold little."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids = [x[0].copy() for x in c.encode_each(batch.column("text").to_pylist(), max_pieces)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        c.clear()

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids): tokens join the vocabulary and are aggregated in order. Bytes that are not UTF-8 become U+FFFD."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            full = [i for i, x in enumerate(ids) if x]
            texts = [None if x is None else "" for x in ids]
            if full:
                lens = np.array([len(ids[i]) for i in full])
                flat, sizes = c.decode_words(np.fromiter((t for i in full for t in ids[i]), np.int32, int(lens.sum())), lens)
                raw, at = flat.tobytes(), np.concatenate(([0], np.cumsum(sizes)))
                for k, i in enumerate(full):
                    texts[i] = raw[at[k] : at[k + 1]].decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, path: str, pattern: str, max_pieces: int = MAX_PIECES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs, from encoding it and decoding its ids."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [(len(i), hashlib.sha256(t).hexdigest(), hashlib.sha256(d).hexdigest()) for i, t, d in c.encode_each(texts, max_pieces)]
            n, a, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.clear()

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
