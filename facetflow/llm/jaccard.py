"""Similarity join of texts by the Jaccard coefficient of their word shingles: a chosen-path join.

Texts with the same shingle set are one class. A class has a signature of independent minimum hashes; a path picks two of its
coordinates at random (the same for all classes at a node) and every class follows each to a child named by the value there.
Children of one class end; small ones are leaves; larger ones split again, unless a split leaves most of them together: then
the node is dense and is a leaf itself. Of a pair of similarity s a share of the coordinates agrees, s in the mean. With the share a
it survives a level with odds 1 - (1 - a p)^2, p being the odds of survival below, so at a = 0.8 one run finds it with odds 0.9375 at
least, at any depth. All runs draw from one pool of coordinates, so the odds of a miss are averaged over the binomial share; `runs`
is the least number that reaches `recall` for pairs at the threshold itself, the hardest. In leaves all pairs are compared on their
shingle sets (of 64-bit hashes, see pieces.py). Leaves with equal members count once; a leaf is dealt out in blocks of bounded
classes and shingles, and a pair that several leaves hold is counted in the first of them only. Tasks give each class its links and
its root in the block, never pairs. Classes have numbers of their own; ids of documents name them at the end only.

Defined results: words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII; a text of fewer words than `shingle` has one shingle
of all; null and empty texts have no shingle, link with nothing and are their own class; a row without doc_id has a null class
and no links; rows that repeat a doc_id count as documents of their own, each by its text (copies where the text is equal, too); extra
columns are left out by join() and kept by representatives().
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut
from .pieces import arrow_map, chunks, mix, word_hashes

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
COORDINATES = 64
#: Classes of a leaf; larger nodes split again.
LEAF = 96
MAX_DEPTH = 16
#: Classes and shingles of one side of a block comparison.
BLOCK_CLASSES, BLOCK_SHINGLES = 768, 1_500_000

_MULTIPLY = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = mix(np.arange(1001, COORDINATES + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[str | None], shingle: int):
    """The sorted distinct shingle hashes of each text."""
    odd = mix(np.arange(7, 7 + shingle, dtype=np.uint64)) | np.uint64(1)
    for _, _, buf in chunks(texts):
        words, edge = word_hashes(buf)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            k = min(shingle, b - a)
            if not k:
                yield np.empty(0, np.uint64)
                continue
            h = np.full(b - a - k + 1, k, np.uint64)
            for i in range(k):
                h += words[a + i : b - k + 1 + i] * odd[i]
            yield np.unique(mix(h))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 16384):
        np.minimum(out, (s[None, at : at + 16384] * _MULTIPLY[:, None] + _ADD[:, None]).min(1), out=out)
    return (out >> np.uint64(33)).astype(np.int32)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a shingle set."""
    m = mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return int(np.bitwise_xor.reduce(m).view(np.int64)), int((m * np.uint64(0xC2B2AE3D27D4EB4F) ^ s).sum().view(np.int64))


def text_key() -> F.Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, fp1, fp2, n (shingles), sig of each row with an id."""

    def run(batches):
        for batch in batches:
            cols = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), shingle):
                for c, x in zip(cols, (*(fingerprint(s) if len(s) else (0, 0)), len(s), signature(s) if len(s) else None)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int32()))], ["doc_id", "text_key", "fp1", "fp2", "n", "sig"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return arrow_map(rows, run, "doc_id long, text_key long, fp1 long, fp2 long, n int, sig array<int>")


def _survival(share: float) -> float:
    """The fixpoint of p = 1 - (1 - share p)^2: the odds that one run, of any depth, keeps a pair together."""
    return (2 * share - 1) / share**2 if share > 0.5 else 0.0


def expected_recall(runs: int, similarity: float, coordinates: int = COORDINATES) -> float:
    n = coordinates
    miss = lambda k: (1 - _survival(k / n)) ** runs
    return 1 - sum(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) * miss(k) for k in range(n + 1))


def runs_for(recall: float, threshold: float) -> int:
    """Runs until the target recall."""
    for runs in range(1, COORDINATES // 2 + 1):
        if expected_recall(runs, threshold) >= recall:
            return runs
    raise ValueError("the coordinates can't hold pairs of so low a similarity with that recall")


def _children(nodes: DataFrame) -> DataFrame:
    """(path, rep, w, child): two coordinates of each path, the same for all that are there."""
    first = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDINATES))
    other = F.pmod(first + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES))
    step = lambda c: F.struct(c.alias("c"), F.get("sig", c.cast("int")).alias("v"))
    both = nodes.withColumn("s", F.explode(F.array(step(first), step(other))))
    return both.select("path", "rep", "w", F.xxhash64("path", "s.c", "s.v").alias("child"))


def leaves(classes: DataFrame, runs: int, leaf: int = LEAF, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(bucket, rep, w) of all leaves of two classes or more; classes: rep, sig, w (shingles)."""
    if 2 * runs > COORDINATES:
        raise ValueError("more runs than pairs of coordinates")
    start = F.array(*[F.struct(F.lit(c // 2).alias("run"), F.lit(c).alias("c"), F.get("sig", F.lit(c)).alias("v")) for c in range(2 * runs)])
    start = classes.select("rep", F.col("n").alias("w"), F.explode(start).alias("s"))  # runs begin with coordinates of their own
    frontier = start.select(F.col("s.run").cast("long").alias("path"), "rep", "w", F.xxhash64("s.run", "s.c", "s.v").alias("child"))
    sizes = None
    out = []
    for depth in range(max_depth):
        below = frontier.groupBy("path", "child").agg(F.count("*").alias("size")).where("size > 1")
        if sizes is not None:
            dense = below.join(sizes, "path").where("2 * size >= path_size").select("path").distinct()
            dense = cut(dense, "dense")
            if not dense.isEmpty():
                below = below.join(dense, "path", "left_anti")
                out.append(parents.join(dense, "path", "left_semi").select(F.col("path").alias("bucket"), "rep", "w"))
        kept = cut(frontier.join(below, ["path", "child"]).select("child", "rep", "w", "size"), "paths")
        small = F.lit(True) if depth == max_depth - 1 else F.col("size") <= leaf
        out.append(kept.where(small).select(F.col("child").alias("bucket"), "rep", "w"))
        large = kept.where(~small)
        if depth == max_depth - 1 or large.isEmpty():
            break
        parents = large.select(F.col("child").alias("path"), "rep", "w", F.col("size").alias("path_size"))
        sizes = parents.select("path", "path_size").distinct()
        frontier = cut(_children(parents.join(classes.select("rep", "sig"), "rep")), "frontier")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _once(found: DataFrame) -> DataFrame:
    """Of leaves with equal members one stays; with its number of blocks."""
    key = F.xxhash64("rep")
    b = found.groupBy("bucket").agg(F.count("*").alias("size"), F.sum(F.col("w").cast("long")).alias("total"), F.bit_xor(key).alias("x"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("y"))
    b = b.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket"), F.first("total").alias("total"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    return found.select("bucket", "rep").join(b.select("bucket", "size", blocks.alias("blocks")), "bucket")


def common(sets: list[np.ndarray], rows: int | None = None) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    if m == 2:
        c = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), c], [c, len(sets[1])]], np.float32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    name = np.cumsum(n > 1) - 1
    shared = (n > 1)[at]
    owner, col = owner[shared], name[at[shared]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((m, m), np.float32)
    width = max(256, (1 << 22) // m)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (lo, lo + width))
        part = np.zeros((m, min(width, int(col[j - 1]) - lo + 1)), np.float32)
        part[owner[i:j], col[i:j] - lo] = 1
        out += part @ part.T
    return out


def group_links(reps, copies, sides, sets, buckets, bucket: int, split: bool, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each class of a block: rows linked to it here and not in an earlier bucket, and the smallest rep it is linked to, directly or not."""
    m = len(reps)
    size = np.array([len(s) for s in sets], np.float64)
    ok = common(sets) >= share * (size[:, None] + size[None, :]) - 1e-6
    np.fill_diagonal(ok, False)
    if split:
        ok &= sides[:, None] != sides[None, :]
    root = np.arange(m)
    if ok.any():
        while True:
            low = np.where(ok, root[None, :], m).min(1)
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        earlier = [b[b < bucket] for b in buckets]
        if sum(len(b) > 0 for b in earlier) > 1:
            ok &= common(earlier) == 0 if m > 2 else len(np.intersect1d(*earlier)) == 0
    return ok @ copies, root


def verify(members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(rep, root, links) from rows (bucket, p, q, rep, copies, side, buckets, text), sorted by (bucket, p, q) in each partition."""
    t = Fraction(threshold).limit_denominator(10**6)
    share = float(t / (1 + t))

    def run(batches):
        key, rows, done = None, [], ([], [], [])

        def close():
            group = sorted(rows, key=lambda r: r[0])
            sets = list(shingle_sets([r[4] for r in group], shingle))
            reps = np.array([r[0] for r in group])
            links, root = group_links(reps, np.array([r[1] for r in group], np.float64), np.array([r[2] for r in group]), list(sets), [np.array(r[3]) for r in group], key[0], key[1] != key[2], share)
            for c, x in zip(done, (reps, reps[root], links.astype(np.int64))):
                c.append(x[(links > 0) | (root != np.arange(len(root)))])

        def emit():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in done], ["rep", "root", "links"])
            for c in done:
                c.clear()
            return out

        for batch in batches:
            names = ("rep", "copies", "side", "buckets", "text")
            for k, r in zip(zip(*(batch.column(c).to_pylist() for c in ("bucket", "p", "q"))), zip(*(batch.column(c).to_pylist() for c in names))):
                if k != key:
                    if len(rows) > 1:
                        close()
                    key, rows = k, []
                rows.append(r)
            if done[0]:
                yield emit()
        if len(rows) > 1:
            close()
        if done[0]:
            yield emit()

    return arrow_map(members, run, "rep long, root long, links long")


def _classes(rows: DataFrame) -> DataFrame:
    """rep (a number of its own), first (doc_id and text_key of the least row), copies, sig of each class of equal shingle sets. It is
    written before it is used, so a number stays what it is."""
    full = rows.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    return cut(full.withColumn("rep", F.monotonically_increasing_id()), "classes")


def _grouped(docs: DataFrame, shingle: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes with component_first, the least (doc_id, text_key) that they reach, and n_links)."""
    rows = cut(sketch(docs, shingle), "sketches")
    classes = _classes(rows)
    found = cut(_once(leaves(classes, runs_for(recall, threshold))), "leaves")
    per = found.groupBy("rep").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"), F.collect_set(F.struct("bucket", "blocks")).alias("at"))
    per = per.join(classes.select("rep", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")), "rep")
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").dropDuplicates(["doc_id", "text_key"])
    m = per.join(texts, ["doc_id", "text_key"]).withColumn("a", F.explode("at")).withColumn("side", F.pmod(F.xxhash64("rep", "a.bucket"), F.col("a.blocks")).cast("int"))
    m = m.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("a.blocks") - 1)))
    m = m.select(F.col("a.bucket").alias("bucket"), F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"), "rep", "copies", "side", "buckets", "text")
    parts = cut(verify(m.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q"), shingle, threshold), "links")
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(parts, "rep", "root").withColumnRenamed("node", "rep")
    named = classes.select("fp1", "fp2", "n", "rep", "first", "copies").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("first").alias("component_first"))
    named = named.join(least, "component").join(links, "rep", "left")
    return rows, named.select("fp1", "fp2", "n", "component_first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def join(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id that it reaches by links), n_links (other rows of similarity threshold or more), kept
    (whether it is its class) of every row of docs."""
    rows, named = _grouped(docs, shingle, threshold, recall)
    out = rows.select("doc_id", "fp1", "fp2", "n").join(named, ["fp1", "fp2", "n"], "left")
    out = out.select("doc_id", F.coalesce("component_first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    none = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def representatives(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class of linked texts: that of the least doc_id (of several such rows one text, once). Texts without
    shingles link with nothing, so all but repeated rows of them stay; so do all rows without an id."""
    rows, named = _grouped(docs, shingle, threshold, recall)
    firsts = named.select("component_first.*").distinct()
    lone = rows.where("n = 0").select("doc_id", "text_key").distinct()
    kept = firsts.unionByName(lone).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    some = docs.where("doc_id is not null")
    same = (some["doc_id"].cast("long") == kept["kept_id"]) & (F.xxhash64(F.coalesce(some["text"], F.lit(""))) == kept["kept_key"])
    return some.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null")).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 9 * c >= 4 * (nx.n + ny.n)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS class_id FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, m.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, d.doc_id = m.class_id AS kept
FROM documents d JOIN m ON m.x = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""
