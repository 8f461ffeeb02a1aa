"""Phrase collocations by top-order marginalisation.

Every word position gives one window: the word and the words that lead it by 1 to 4 places, padded where its piece ends. Tasks count equal
windows, Spark sums them, and a ROLLUP over (lang, w1 .. w5) sums successively shorter prefixes: a phrase of k words stands in as many places
as windows begin with it, so one count of longest windows gives the counts of all orders. Phrases that are frequent enough are then cut in
two, scored, freed of what longer ones account for, and ranked.

A window is padded, too, from where it can't belong to a candidate any more: all parts of a candidate are as frequent as itself. Tasks
count hashes (lang included) in a table of buckets first, of words and pairs, then of the longer phrases whose pairs all may be frequent; the merged
tables, one bit a bucket, tell what is certainly too rare. Phrases that share a bucket only make windows longer, so counts of phrases in
min_count places are exact whatever a table's size. Tables have a bucket for some BYTES_A_BUCKET bytes of text, up to MAX_BUCKETS (128 MB of
bits, which are broadcast); with more text than that they pad less.

Defined results: a null text is empty, a null lang is `und`; repeated documents count each; ties are ranked by phrase; an empty table
gives an empty result; extra columns are left out. Memory of a task: one Arrow batch of texts, the windows of a chunk, and the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .pieces import LOWER, SENTINEL, arrow_map, chunks, hash_pieces, mix, ragged, runs

ORDER, MIN_COUNT, PERCENT, TOP = 5, 100, 100, 2000
BYTES_A_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 32, 1 << 16, 1 << 30
#: Bytes of text that are counted at a time; rows that a table is sent in; hashes that a task keeps uncounted.
CHUNK, SLICES, HASHES = 2 << 20, 2048, 1 << 22
#: Languages whose word counts may be broadcast.
MAX_LANGS = 10_000
_WORD, _SPACE, _END = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = _SPACE
_KIND[[*b".,;:!?", 10, 11, 12, 13, SENTINEL]] = _END


class Words:
    """The words of a chunk of texts: numbers in the order of their hashes, hashes, pieces, texts."""

    def __init__(self, buf: np.ndarray):
        self.low = LOWER[buf]
        kind = _KIND[self.low]
        self.starts, self.ends = runs(kind == _WORD)
        self.hashes = hash_pieces(self.low, self.starts, self.ends)
        self.piece = np.cumsum(kind == _END)[self.starts]
        self.text = np.searchsorted(np.flatnonzero(buf == SENTINEL), self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def keys(self, langs: np.ndarray, order: int) -> list[np.ndarray]:
        """For k = 1 .. order a hash of the k words from each word on, whether or not they are in one piece."""
        own = mix(self.hashes ^ langs[self.text]) if len(self) else np.zeros(0, np.uint64)
        out = [own]
        for k in range(1, order):
            out.append(mix(out[-1][:-1] + self.hashes[k:]) ^ np.uint64(k) if len(out[-1]) else out[-1])
        return out

    def together(self) -> np.ndarray:
        """Whether the next word is in the same piece."""
        return self.piece[1:] == self.piece[:-1]

    def numbered(self) -> tuple[np.ndarray, list[bytes]]:
        """(number of each word, words): hashes find equal words, their bytes are compared."""
        _, at, number = np.unique(self.hashes, return_index=True, return_inverse=True)
        lens, raw = self.ends - self.starts, self.low.tobytes()
        same = self.starts[at][number]
        if not ((lens[at][number] == lens).all() and (self.low[ragged(same, lens)] == self.low[ragged(self.starts, lens)]).all()):
            names: dict[bytes, int] = {}
            number = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(self.starts.tolist(), self.ends.tolist())])
            return number, list(names)
        return number, [raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


def _lang_hashes(langs: list[str]) -> np.ndarray:
    raw = [x.encode() for x in langs]
    ends = np.cumsum([len(x) for x in raw]) if raw else np.zeros(0, np.int64)
    lens = np.array([len(x) for x in raw], np.int64)
    return mix(hash_pieces(np.frombuffer(b"".join(raw) + b"\0", np.uint8), ends - lens, ends))


def _chunks(batches):
    """(lang of each text, words) a chunk at a time."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for first, last, buf in chunks(texts, CHUNK):
            yield langs[first:last], Words(buf)


class Table:
    """One bit a bucket: unset where what has its hash there is certainly too rare."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = bucket_of(keys, 8 * len(self.bits))
        return ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def lengths(words: Words, langs: np.ndarray, order: int, pairs, longer=None) -> np.ndarray:
    """How many words from each word on may belong to a candidate: 0 where the word itself is too rare. `pairs` knows words and pairs,
    `longer` the other orders; without it only pairs decide."""
    n = len(words)
    keys = words.keys(langs, order if longer else 2)
    out = pairs(keys[0]).astype(np.int64)
    good: list[np.ndarray] = [out.astype(bool)]
    if order > 1 and n > 1:
        good.append(good[0][:-1] & good[0][1:] & words.together() & pairs(keys[1]))
        out[:-1] += good[1]
    for k in range(3, order + 1):
        if n < k:
            break
        both = good[-1][:-1] & good[-1][1:]
        if longer:
            at = np.flatnonzero(both)
            both[at] = longer(keys[k - 1][at])
        good.append(both)
        out[: n - k + 1] += both
    return out


def table_of(docs: DataFrame, keys, min_count: int, buckets: int) -> Table:
    """The table of the hashes that keys(words, hashes of the texts' langs) gives. Counts stop at min_count, where enough is known."""
    slices = min(SLICES, buckets // 8)
    width = buckets // slices
    place = np.dtype(np.uint16 if width <= 1 << 16 else np.uint32)
    kind = np.dtype(np.uint8 if min_count < 1 << 8 else np.uint32)

    def count(batches):
        at, n, have, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge():
            nonlocal at, n
            every, many = np.unique(np.concatenate(have), return_counts=True)
            both, where = np.unique(np.concatenate((at, every)), return_inverse=True)
            n = np.minimum(np.bincount(where, np.concatenate((n, many)), len(both)), min_count).astype(np.int64)
            at = both

        for langs, words in _chunks(batches):
            have.append(bucket_of(keys(words, _lang_hashes(langs)), buckets))
            size += len(have[-1])
            if size >= HASHES:
                merge()
                have, size = [], 0
        if size:
            merge()
        edge = np.searchsorted(at, np.arange(slices + 1) * width)
        some = np.flatnonzero(np.diff(edge))
        if len(some):
            part = (at % width).astype(place)
            rows = [(part[edge[i] : edge[i + 1]].tobytes(), n[edge[i] : edge[i + 1]].astype(kind).tobytes()) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["slice", "at", "n"])

    def merge(batches):
        at, total = None, None

        def bits():
            return pa.RecordBatch.from_pydict({"slice": pa.array([at], pa.int32()), "bits": [np.packbits(total >= min_count).tobytes()]})

        for batch in batches:
            for i, where, n in zip(batch.column("slice").to_pylist(), batch.column("at"), batch.column("n")):
                if i != at:
                    if at is not None:
                        yield bits()
                    at, total = i, np.zeros(width, np.int64)
                total[np.frombuffer(where.as_buffer(), place)] += np.frombuffer(n.as_buffer(), kind)
        if at is not None:
            yield bits()

    parts = arrow_map(docs, count, "slice int, at binary, n binary")
    merged = arrow_map(parts.repartition("slice").sortWithinPartitions("slice"), merge, "slice int, bits binary")
    out = np.zeros((slices, width // 8), np.uint8)
    for r in merged.toLocalIterator():  # buckets / 8 bytes in all, a bound that doesn't grow with docs
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return Table(out.ravel())


def tables(docs: DataFrame, min_count: int, order: int, buckets: int):
    """(the table of words and pairs, that of longer phrases), broadcast."""
    share = docs.sparkSession.sparkContext.broadcast

    def short(words: Words, langs: np.ndarray) -> np.ndarray:
        one, *two = words.keys(langs, min(2, order))
        return np.concatenate([one, *(k[words.together()] for k in two)])

    pairs = share(table_of(docs, short, min_count, buckets))
    if order < 3:
        return pairs, None

    def long(words: Words, langs: np.ndarray) -> np.ndarray:
        keys, n = words.keys(langs, order), lengths(words, langs, order, pairs.value)
        return np.concatenate([keys[k - 1][n[: len(keys[k - 1])] >= k] for k in range(3, order + 1)])

    return pairs, share(table_of(docs, long, min_count, buckets))


def lead_windows(docs: DataFrame, pairs, longer, order: int = ORDER) -> DataFrame:
    """lang, w1 .. w<order>, n: the distinct windows of each task's chunks with their number of places; pads are null."""
    names = [f"w{k}" for k in range(1, order + 1)]

    def run(batches):
        for langs, words in _chunks(batches):
            if not len(words):
                continue
            size = lengths(words, _lang_hashes(langs), order, pairs.value, longer and longer.value)
            lang_names, lang = np.unique(np.array(langs, object), return_inverse=True)
            number, distinct = words.numbered()
            window = []
            for k in range(order):  # the words that lead by k places
                column = np.full(len(words), -1)
                at = np.flatnonzero(size > k)
                column[at] = number[at + k]
                window.append(column)
            width, row, places = len(distinct) + 1, [], []
            group = lang[words.text] * width + window[0] + 1
            for k in range(order):  # windows of k + 1 words are told apart by order after order
                own = np.flatnonzero(size <= 1 if k == 0 else size == k + 1)
                _, first, count = np.unique(group[own], return_index=True, return_counts=True)
                row.append(own[first])
                places.append(count)
                if k + 1 < order:
                    more = np.flatnonzero(size > k + 1)
                    group[more] = np.unique(group[more], return_inverse=True)[1] * width + window[k + 1][more] + 1
            row, places = np.concatenate(row), np.concatenate(places)
            used = np.unique(np.concatenate([c[row] for c in window]))
            text = pa.array([distinct[i].decode() for i in used.tolist() if i >= 0], pa.string())
            used = used[used >= 0]
            cols = [text.take(pa.array(np.searchsorted(used, c[row]), mask=c[row] < 0)) for c in window]
            yield pa.RecordBatch.from_arrays([pa.array(lang_names.tolist(), pa.string()).take(pa.array(lang[words.text[row]])), *cols, pa.array(places)], ["lang", *names, "n"])

    return arrow_map(docs, run, ", ".join(["lang string", *(f"{w} string" for w in names), "n long"]))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, order: int = ORDER, buckets: int | None = None) -> DataFrame:
    """lang, k, phrase, f of every phrase of 1 to `order` words in min_count places or more, and k = 0 with all words of each lang. Written."""
    if buckets is not None and (buckets & (buckets - 1) or buckets < 8):
        raise ValueError("the number of buckets is a power of two from 8 on")
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [f"w{k}" for k in range(1, order + 1)]
    if buckets is None:
        size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (size // BYTES_A_BUCKET).bit_length()))
    windows = lead_windows(d, *tables(d, min_count, order, buckets), order).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    k = order - F.log2(F.col("g") + 1).cast("int")  # each of the last columns that is summed up sets a bit
    last = F.coalesce(*[F.when(F.col("k") == i, F.col(w).isNotNull()) for i, w in enumerate(names, 1)], F.lit(True))
    sums = sums.where(F.col("lang").isNotNull()).withColumn("k", k).where(last & ((F.col("k") == 0) | (F.col("f") >= min_count)))
    return cut(sums.select("lang", "k", F.concat_ws(" ", *names).alias("phrase"), "f"), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r, n, score of every phrase of two words and more, by its lowest cut."""
    words = F.split("phrase", " ", -1)
    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    f = lambda key, name: counts.where("k > 0").select("lang", F.col("phrase").alias(key), F.col("f").alias(name))
    cuts = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("words")).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("at")), "right": part(F.col("at") + 1, F.col("k") - F.col("at"))})
    langs = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    if langs.limit(MAX_LANGS + 1).count() <= MAX_LANGS:
        langs = F.broadcast(langs)
    cuts = cuts.join(f("left", "l"), ["lang", "left"]).join(f("right", "r"), ["lang", "right"]).join(langs, "lang")
    big = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})"))
    least = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "k", "a", "l", "r", "n")).alias("c"))
    return least.select("lang", "phrase", "c.k", "c.a", "c.l", "c.r", "c.n", "c.score")


def covered(counts: DataFrame) -> DataFrame:
    """lang, phrase, longer: the most places of a longer counted phrase that the phrase stands in."""
    long = counts.where("k > 2").select("lang", "k", F.split("phrase", " ", -1).alias("words"), "f")
    long = long.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    return long.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def ranked(rows: DataFrame, by: str, order: list, top: int) -> DataFrame:
    """The first `top` rows of each value of `by`, with their rank. Rows are sorted over ranges of all of them and numbered from where their
    value begins, so that no value's rows meet in one task."""
    rows = cut(rows, "unranked")
    spread = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    spread = cut(spread.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "sorted")
    parts = spread.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < top)
    out = spread.join(parts, [by, "_part"]).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return out.where(F.col("rank") <= top).drop("_part", "_at", "_first", "_rows", "_before")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, percent: int = PERCENT, top: int = TOP, order: int = ORDER, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer phrase accounts for to `percent`."""
    counts = phrase_counts(docs, min_count, order, buckets)
    rows = scored(counts).join(covered(counts), ["lang", "phrase"], "left").where(100 * F.coalesce("longer", F.lit(0)) < percent * F.col("a"))
    rows = ranked(rows.select("lang", "phrase", "a", "l", "r", "n", "score"), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
o AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i CROSS JOIN range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM o GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
x AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS i FROM c),
s AS (SELECT x.lang, x.k, x.phrase, a, x.i, l.f AS l, r.f AS r, n.n, (1000 * a * n.n) // (l.f * r.f) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:x.i], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[x.i + 1:x.k], ' ') JOIN n ON n.lang = x.lang),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS least FROM s),
y AS (SELECT lang, k, w, a, unnest(range(2, k)) AS size FROM c),
z AS (SELECT lang, k, w, a, size, unnest(range(1, k - size + 2)) AS i FROM y),
g AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer FROM z GROUP BY ALL),
q AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN g ON g.lang = m.lang AND g.phrase = m.phrase WHERE least = 1 AND 100 * coalesce(longer, 0) < 100 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= 2000
"""
