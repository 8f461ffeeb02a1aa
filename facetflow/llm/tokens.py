"""Token ids of a corpus in binary shards, compressed by a Re-Pair grammar, with random access.

Texts are dealt out by ranges of doc_id and sorted; each task encodes its texts, appends the end id to each, and writes files of
shards. In a shard, each round replaces the pairs of neighbouring ids that are as frequent as its bound by new symbols (never across two
documents); bounds fall from round to round until no pair stands in MIN_COUNT places, where a rule would take as much room as it saves.
Rules, their expansion lengths and the documents' places in the symbols are stored, so that any document, or any range of its ids, is
decoded without the rest.

A file is one shard after another. Shard layout, little-endian: b"RPI1", header length (u32), JSON header, then the arrays it lists:
rules (left, right), lengths, doc_ids, doc_null, counts, offsets (documents + 1, in symbols), symbols (of the header's `width` bits, the
lowest first, without gaps).

Defined results: null and empty texts hold the end id alone; null ids come first; equal ids are ordered by text; an empty table
has no shards; extra columns are left out. Memory: shard_tokens ids and one document, and the shards of a file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .pieces import SENTINEL, PieceCache, Ragged, chunks, hash_pieces, ragged

SHARD_TOKENS, FILE_BYTES = 4 << 20, 64 << 20
#: A rule takes two symbols and a length, a place saves a symbol; rarer pairs aren't frequent.
MIN_COUNT = 4
#: A round's bound for the frequency of its pairs is the last one's over this.
STEP = 4
#: Words that a worker keeps from task to task.
MAX_PIECES = 1_200_000

_PLAIN = re.compile(r"[\t\n\r\x20-&(-~À-ÖØ-öø-ÿ]*\Z")
_LETTER, _DIGIT, _MARK, _SPACE = range(4)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[97:123] = _CLASS[128:255] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 13, 32, SENTINEL]] = _SPACE


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


#: What a tokenizers file says before its model where _plain_chunk does the same to plain texts.
_PLAIN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Encoder:
    """A tokenizers file applied with a cache of words. Where the file's steps before the model are those that are known here, texts of
    ASCII and Latin-1 letters, which no normalizer step joins across words, are cut and lower-cased by array operations and each new
    word goes to the library's model; other texts, and all texts of other files, go whole to the library. Words are looked up by hash
    and compared by bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.known_steps = all(settings.get(k) == v for k, v in _PLAIN_STEPS.items())
        self.added = [t["content"] for t in settings.get("added_tokens") or [] if t["content"]]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.cache, self.ids, self.words = PieceCache(), Ragged(np.uint32), Ragged(np.uint8)

    def _fill(self, ids: Ragged, words: list[bytes]) -> None:
        letters, tokenize = self.letters, self.model.tokenize
        new = [[t.id for t in tokenize("".join([letters[b] for b in w]))] for w in words]
        lens = np.array([len(x) for x in new])
        ids.append(np.fromiter((i for x in new for i in x), np.uint32, int(lens.sum())), lens)

    def _plain_chunk(self, buf: np.ndarray, max_pieces: int) -> list[np.ndarray]:
        low = buf.copy()
        low[(buf >= 65) & (buf <= 90)] += 32
        second = np.flatnonzero(buf[:-1] == 0xC3) + 1
        second = second[(buf[second] <= 0x9E) & (buf[second] != 0x97)]
        low[second] += 32
        kind = _CLASS[low]
        start = np.empty(len(buf), bool)
        start[0] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(buf))
        solid = kind[starts] != _SPACE
        starts, ends = starts[solid], ends[solid]
        distinct, at, inverse = np.unique(hash_pieces(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.cache.keys) > max_pieces:
            self.clear()
        known = self.cache.find(distinct)[1]
        if not known.all():
            raw = low.tobytes()
            new = [raw[starts[i] : ends[i]] for i in at[~known]]
            self._fill(self.ids, new)
            self.words.append(np.frombuffer(b"".join(new), np.uint8), np.array([len(w) for w in new]))
            self.cache.add(distinct[~known])
        rows = self.cache.find(distinct)[0][inverse]
        flat, lens = self.ids.take(rows)
        same, sizes = self.words.take(rows)
        if not (np.array_equal(sizes, ends - starts) and np.array_equal(same, low[_CLASS[low] != _SPACE])):
            names, raw = {}, low.tobytes()  # words that share a hash are told apart by their bytes
            rows = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(starts.tolist(), ends.tolist())])
            ids = Ragged(np.uint32)
            self._fill(ids, list(names))
            flat, lens = ids.take(rows)
        stops = np.searchsorted(starts, np.flatnonzero(buf == SENTINEL))
        edge = np.concatenate(([0], np.cumsum(lens)))[np.concatenate(([0], stops))]
        return [flat[a:b] for a, b in zip(edge[:-1], edge[1:])]

    def _is_plain(self, text: str | None) -> bool:
        return not text or (_PLAIN.match(text) is not None and not any(t in text for t in self.added))

    def encode(self, texts: list[str | None], max_pieces: int = MAX_PIECES) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self._is_plain(t)] if self.known_steps else []
        for first, stop, buf in chunks([texts[i] for i in plain]):
            for i, ids in zip(plain[first:stop], self._plain_chunk(buf, max_pieces)):
                out[i] = ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = np.array(self.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _frequent(key: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the keys that stand in `least` places or more. Buckets of a hash tell most rare ones first, so few are sorted."""
    if least > 2:
        bits = min(20, max(10, len(key).bit_length()))
        bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
        key = key[(np.bincount(bucket, minlength=1 << bits) >= least)[bucket]]
    key = np.sort(key)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    n = np.diff(edge)
    return key[edge[:-1]][n >= least], n[n >= least]


def _slot(key: np.ndarray) -> np.ndarray:
    return (((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).view(np.int64)


def _places(key: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers of chosen pairs) to replace, from pairs and their positions. Of pairs that overlap every other one from the
    left is taken."""
    place = np.full(1 << 20, -1, np.int32)
    place[_slot(chosen)[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]  # of pairs in one slot the most frequent; others wait
    rule = place[_slot(key)]
    some = np.flatnonzero(rule >= 0)
    rule = rule[some]
    same = chosen[rule] == key[some]
    spot, rule = at[some[same]], rule[same]
    fresh = np.concatenate(([True], np.diff(spot) != 1))
    begin = spot[np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))]
    left = (spot - begin) % 2 == 0
    return spot[left], rule[left]


def compress(ids: np.ndarray, counts: np.ndarray, base: int, min_count: int = MIN_COUNT) -> dict[str, np.ndarray]:
    """The grammar of documents' ids: rules (n, 2), lengths (n), symbols, offsets (documents + 1). Symbols from base on are rules.

    The pairs of a round are at least as frequent as a bound, which falls to 1 / STEP from round to round, down to min_count, where it stays
    until no pair reaches it. Only places whose two symbols are both that frequent are looked at and, once a round has been at the lowest bound, only
    those of its new symbols and of pairs that it could not replace everywhere."""
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[np.cumsum(counts) - 1] = True
    seen = np.bincount(s, minlength=base)  # places of each symbol
    rules: list[np.ndarray] = []
    n_rules, least = 0, int(seen.max(initial=0))
    waiting: np.ndarray | None = None  # symbols of the pairs to look at
    while len(s) > 1:
        least = max(min_count, least // STEP)
        often = (seen >= least)[s]
        look = often[:-1] & often[1:] & ~last[:-1]
        if waiting is not None:
            fresh = s >= waiting[-1]
            waits = np.zeros(len(seen), bool)
            waits[waiting] = True
            waits = waits[s]
            look &= (waits[:-1] & waits[1:]) | fresh[:-1] | fresh[1:]
        at = np.flatnonzero(look)
        key = (s[at].astype(np.uint64) << np.uint64(32)) | s[at + 1]
        chosen, n = _frequent(key, least)
        if not len(chosen):
            if least == min_count:
                break
            continue
        order = np.argsort(-n, kind="stable")
        chosen, n = chosen[order], n[order]
        spot, rule = _places(key, at, chosen)
        uses = np.bincount(rule, minlength=len(chosen))
        used = np.flatnonzero(uses)
        pair = np.stack((chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)), 1).astype(np.int64)
        seen = np.concatenate((seen, uses[used]))
        np.subtract.at(seen, pair, uses[used, None])
        rest = chosen[uses < n]
        waiting = np.concatenate((rest >> np.uint64(32), rest & np.uint64(0xFFFFFFFF), [np.uint64(base + n_rules)])).astype(np.int64) if least == min_count else None
        name = np.zeros(len(chosen), np.uint32)
        name[used] = base + n_rules + np.arange(len(used))
        s[spot] = name[rule]
        last[spot] = last[spot + 1]
        keep = np.ones(len(s), bool)
        keep[spot + 1] = False
        s, last = s[keep], last[keep]
        rules.append(pair)
        n_rules += len(used)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    size = np.ones(base + len(table), np.int64)
    done = 0
    for r in rules:
        size[base + done : base + done + len(r)] = size[r[:, 0]] + size[r[:, 1]]
        done += len(r)
    return {"rules": table.astype(np.uint32), "lengths": size[base:].astype(np.uint32), "symbols": s, "offsets": np.concatenate(([0], np.flatnonzero(last) + 1)).astype(np.uint64)}


def to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Bytes that hold the lowest `width` bits of each value, one after another."""
    out = []
    for at in range(0, len(values), 1 << 16):
        bits = np.unpackbits(np.ascontiguousarray(values[at : at + (1 << 16)].astype("<u4"))[:, None].view(np.uint8), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :width], bitorder="little"))
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def from_bits(data: np.ndarray, width: int, first: int, last: int) -> np.ndarray:
    """values[first:last] of to_bits(values, width); only the bytes that hold them are read."""
    out = []
    for at in range(first, last, 1 << 16):
        stop = min(last, at + (1 << 16))
        skip = at * width % 8
        bits = np.unpackbits(data[at * width // 8 : -(-stop * width // 8)], bitorder="little")[skip : skip + (stop - at) * width]
        wide = np.zeros((stop - at, 32), np.uint8)
        wide[:, :width] = bits.reshape(-1, width)
        out.append(np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def pack(header: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """A shard; `symbols` go in as numbers and are stored in as few bits as all of them need."""
    width = max(1, int(header["base"] + len(arrays["rules"]) - 1).bit_length())
    arrays = arrays | {"symbols": to_bits(arrays["symbols"], width)}
    head = json.dumps(header | {"width": width, "arrays": [[k, v.dtype.str, list(v.shape)] for k, v in arrays.items()]}).encode()
    return b"".join([b"RPI1", struct.pack("<I", len(head)), head, *(np.ascontiguousarray(v).tobytes() for v in arrays.values())])


class Shard:
    """A shard's content, opened for random access; `end` is where it ends in data."""

    def __init__(self, data, start: int = 0):
        if bytes(data[start : start + 4]) != b"RPI1":
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<I", data, start + 4)
        self.header = json.loads(bytes(data[start + 8 : start + 8 + n]))
        at = start + 8 + n
        for name, kind, shape in self.header["arrays"]:
            size = int(np.prod(shape))
            setattr(self, name, np.frombuffer(data, np.dtype(kind), size, at).reshape(shape))
            at += size * np.dtype(kind).itemsize
        self.end = at
        self.base = self.header["base"]
        self._expand()

    def _expand(self) -> None:
        """All rules' ids, one after another; a rule uses earlier ones only."""
        self.rule_ids = Ragged(np.uint32)
        level = np.zeros(len(self.rules), np.int64)
        deep = np.zeros(self.base + len(self.rules), np.int64)
        for i, (a, b) in enumerate(self.rules.tolist()):
            deep[self.base + i] = level[i] = 1 + max(deep[a], deep[b])
        starts = np.cumsum(self.lengths.astype(np.int64)) - self.lengths
        flat = np.empty(int(self.lengths.sum()), np.uint32)
        for k in range(1, int(level.max(initial=0)) + 1):
            for side in (0, 1):
                i = np.flatnonzero(level == k)
                part = self.rules[i, side].astype(np.int64)
                shift = np.zeros(len(i), np.int64) if side == 0 else self._sizes(self.rules[i, 0].astype(np.int64))
                plain = part < self.base
                flat[starts[i[plain]] + shift[plain]] = part[plain]
                sub, to = part[~plain] - self.base, starts[i[~plain]] + shift[~plain]
                n = self.lengths[sub].astype(np.int64)
                flat[ragged(to, n)] = flat[ragged(starts[sub], n)]
        self.starts, self.flat = starts, flat

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        big = symbols >= self.base
        out[big] = self.lengths[symbols[big] - self.base]
        return out

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of symbols[first:last]."""
        symbols = from_bits(self.symbols, self.header["width"], first, last).astype(np.int64)
        sizes = self._sizes(symbols)
        out = np.repeat(symbols, sizes).astype(np.uint32)
        to = np.cumsum(sizes) - sizes
        big = np.flatnonzero(symbols >= self.base)
        n = sizes[big]
        out[ragged(to[big], n)] = self.flat[ragged(self.starts[symbols[big] - self.base], n)]
        return out

    def document(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids first to last of the k-th document; only the symbols that hold them are expanded."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        ends = np.cumsum(self._sizes(from_bits(self.symbols, self.header["width"], a, b).astype(np.int64)))
        last = int(ends[-1]) if last is None else min(last, int(ends[-1]))
        if first >= last:
            return np.empty(0, np.uint32)
        i, j = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last - 1, "right")) + 1
        skip = int(ends[i - 1]) if i else 0
        return self.ids(a + i, a + j)[first - skip : last - skip]


def write(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write the shards; (folder, manifest of file, part, seq, n_docs, n_tokens)."""

    def run(folder):
        def shards(batches):
            enc, part, seq = encoder(path), TaskContext.get().partitionId(), 0
            base = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
            have, size, packed, n_docs, n_tokens = [], 0, [], 0, 0

            def close():
                nonlocal have, size, n_docs, n_tokens
                counts = np.array([len(x) for _, x in have], np.int64)
                keys = [k for k, _ in have]
                ids = np.concatenate([x for _, x in have])
                have, size = [], 0
                arrays = compress(ids, counts, base) | {"doc_ids": np.array([k or 0 for k in keys], np.int64), "doc_null": np.array([k is None for k in keys], np.uint8), "counts": counts.astype(np.uint32)}
                packed.append(pack({"base": base, "end_id": end_id}, arrays))
                n_docs, n_tokens = n_docs + len(keys), n_tokens + len(ids)

            def flush():
                nonlocal seq, n_docs, n_tokens
                name = store.put(folder, f"shard-{part:06d}-{seq:06d}", b"".join(packed))
                row = pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [n_docs], "n_tokens": [n_tokens]})
                packed.clear()
                seq, n_docs, n_tokens = seq + 1, 0, 0
                return row

            for batch in batches:
                keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for first in range(0, len(texts), 256):
                    for k, ids in zip(keys[first : first + 256], enc.encode(texts[first : first + 256])):
                        have.append((k, np.append(ids, np.uint32(end_id))))
                        size += len(have[-1][1])
                        if size >= shard_tokens:
                            close()
                            if sum(map(len, packed)) >= file_bytes:
                                yield flush()
            if have:
                close()
            if packed:
                yield flush()

        return shards

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return store.write(ordered, run, "file string, part int, seq int, n_docs long, n_tokens long", "token-shards")


def file_starts(manifest: DataFrame, block: int = 1024) -> DataFrame:
    """The manifest with `file_start`, the ids in all files before. Sums by task and by block of tasks come first, so the one global
    window sees a row for each block of tasks."""
    m = manifest.withColumn("block", F.expr(f"part div {block}"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = m.groupBy("block", "part").agg(F.sum("n_tokens").alias("n"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block"), "n").alias("b"))
    parts = parts.select("block", "part", before(Window.partitionBy("block").orderBy("part"), "n").alias("p"))
    m = m.withColumn("f", before(Window.partitionBy("part").orderBy("seq"), "n_tokens"))
    return m.join(parts, ["block", "part"]).join(blocks, "block").select("file", (F.col("f") + F.col("p") + F.col("b")).alias("file_start"))


def read(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                data, at, done = data.as_buffer(), 0, 0
                data = memoryview(data)
                while at < len(data):
                    shard = Shard(data, at)
                    at, n = shard.end, shard.counts.astype(np.int64)
                    every = memoryview(shard.ids(0, int(shard.offsets[-1])).astype("<u4").tobytes())
                    edge = np.concatenate(([0], np.cumsum(n))) * 4
                    crc = [zlib.crc32(every[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                    ids = pa.array(shard.doc_ids, mask=shard.doc_null.astype(bool))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), ids, pa.array(done + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["file", "doc_id", "at", "n_tokens", "ids_crc32"])
                    done += int(n.sum())

    out = store.read(spark, folder, file_starts(manifest), run, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return out.select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
