"""Divergence audit of the sources of each language, by an Arrow compute pipeline.

Tasks lower-case whole texts (ascii_lower), split them (split_pattern_regex), encode the words as a dictionary and count them by hash
group_by: partial counts of (lang, source, term) with the documents that hold it. Spark sums the partial counts; terms in enough
documents of their language are kept and written as columns, dealt into shards by a hash of the term. A task reads a shard of a language as
one matrix of sources x terms and gives each pair of sources, and the best terms of each source, their part; Spark sums the parts and ranks.

Shares are p = 1 + floor(10^9 (count + 2) / (N + 2 V)), the divergence of a term is floor((p - q)^2 / (p + q)): all whole numbers.

Defined results: null text, lang and source count as ''; a group without terms has counts of 0; a language without kept terms has divergences
of 0 and no terms; repeated documents count each; an empty table gives an empty result; extra columns are left out. Memory of a task: one
Arrow batch of texts, FLUSH distinct (document, term) counts, or one shard: SHARD cells, at least one term of all sources of a language.
The pairs of all sources of a language are the result that is asked for; they are met shard by shard and summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .pieces import arrow_map

MIN_DOCUMENTS, TOP = 10, 10
#: What stands between terms, once A-Z is lower-cased.
NO_TERM = r"[\x00-\x60\x7B-\x7F]+"
BILLION = 1_000_000_000
#: Bytes of text that are split at a time; distinct partial counts that a task keeps; cells of a shard.
PART_BYTES, FLUSH, SHARD = 4 << 20, 1 << 19, 1 << 17
_KEYS = ["lang", "source", "term"]


def count_terms(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """lang, source, term, n (occurrences), docs (texts that hold it); and n = docs = 0 of the term '' for each group."""
    lists = pc.split_pattern_regex(pc.ascii_lower(text), NO_TERM)
    words = pc.list_flatten(lists).dictionary_encode()
    doc = pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(words.dictionary), 0).take(words.indices)
    t = pa.table({"doc": pc.cast(doc, pa.int64()).filter(real), "code": words.indices.filter(real)}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"], use_threads=False).aggregate([])
    names = {g: i for i, g in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist()))}
    group = pa.array([names[g] for g in zip(lang.to_pylist(), source.to_pylist())], pa.int64())
    t = pa.table({"group": group.take(t["doc"]), "code": t["code"], "n": t["count_all"]}).group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    counts = pa.table({"lang": groups["lang"].take(t["group"]), "source": groups["source"].take(t["group"]), "term": words.dictionary.take(t["code"].combine_chunks()), "n": t["n_sum"], "docs": t["count_all"]})
    nothing = pa.array(np.zeros(groups.num_rows, np.int64))
    marks = pa.table({"lang": groups["lang"], "source": groups["source"], "term": pa.array([""] * groups.num_rows, pa.string()), "n": nothing, "docs": nothing})
    return pa.concat_tables([counts, marks], promote_options="permissive")


def _partial(batches):
    have: list[pa.Table] = []
    size = 0

    def merged() -> pa.Table:
        t = pa.concat_tables(have).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + PART_BYTES, "right")))
            part = batch.slice(first, last - first)
            have.append(count_terms(*(part.column(c) for c in ("lang", "source", "text"))))
            size += have[-1].num_rows
            first = last
            if size > FLUSH:
                have = [merged()]
                if have[0].num_rows > FLUSH // 2:
                    yield from have[0].to_batches(max_chunksize=1 << 16)
                    have = []
                size = sum(t.num_rows for t in have)
    if have:
        yield from merged().to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs over all documents; the term '' stands for the group itself."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = arrow_map(docs.select(text("lang"), text("source"), text("text")), _partial, "lang string, source string, term string, n long, docs long")
    return parts.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 v)); total may be an array that fits count."""
    if int(np.max(total, initial=0)) + 2 * v < 9_000_000_000:
        return 1 + (BILLION * (count + 2)) // (total + 2 * v)
    return (1 + (BILLION * (count.astype(object) + 2)) // (np.asarray(total).astype(object) + 2 * v)).astype(np.int64)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_parts(sources: list[str], totals: np.ndarray, n_lang: int, v: int, terms: list[str], counts: np.ndarray, top: int = TOP):
    """('pair', i, j, value) of all i < j, summed over a shard's terms, and ('term', i, term, value) of the best terms of each source."""
    p = shares(counts, totals[:, None], v)
    q = shares(counts.sum(0), n_lang, v)
    for i in range(len(sources) - 1):
        step = max(1, SHARD // max(1, len(terms)))
        for first in range(i + 1, len(sources), step):
            for j, value in enumerate(_divergence(p[first : first + step], p[i]).sum(1).tolist(), first):
                yield "pair", sources[i], sources[j], value
    for i, s in enumerate(sources):
        at = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        value = _divergence(p[i, at], q[at])
        if len(at) > top:
            bound = np.partition(value, len(value) - top)[len(value) - top]
            at, value = at[value >= bound], value[value >= bound]
        for value, term in sorted((-x, terms[t].encode()) for x, t in zip(value.tolist(), at.tolist()))[:top]:
            yield "term", s, term.decode(), -value


def _shards(top: int):
    """Rows sorted by lang, shard and term; those of the sources come first, as the term ''."""

    def run(batches):
        key, have = None, []

        def close():
            t = pa.concat_tables(have)
            mark = pc.equal(t["term"], "")
            groups, t = t.filter(mark), t.filter(pc.invert(mark))
            sources = groups["source"].to_pylist()
            n_lang, v = groups["n_lang"][0].as_py(), groups["v"][0].as_py()
            if not t.num_rows:
                return None
            term = t["term"].combine_chunks().dictionary_encode()
            counts = np.zeros((len(sources), len(term.dictionary)), np.int64)
            counts[pc.index_in(t["source"], pa.array(sources)).to_numpy(), term.indices.to_numpy()] = t["n"].to_numpy()
            rows = [(key[0], *x) for x in shard_parts(sources, groups["n"].to_numpy(), n_lang, v, term.dictionary.to_pylist(), counts, top)]
            lang, part, source, item, value = zip(*rows) if rows else [()] * 5
            texts = [pa.array(c, pa.string()) for c in (lang, part, source, item)]
            return pa.RecordBatch.from_arrays([*texts, pa.array(value, pa.int64())], ["lang", "part", "source", "item", "value"])

        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("shard").to_pylist()))
            first = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[first]:
                    if keys[first] != key:
                        if have and (out := close()):
                            yield out
                        key, have = keys[first], []
                    have.append(pa.Table.from_batches([batch.slice(first, at - first)]))
                    first = at
        if have and (out := close()):
            yield out

    return run


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, shard_cells: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and the terms it has more of."""
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumn("docs", F.sum("docs").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    kept = cut(counted.where((F.col("term") == "") | (F.col("docs") >= min_documents)).select(*_KEYS, "n", "first"), "term-counts")
    groups = cut(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if((F.col("term") != "") & F.col("first")).alias("v")), "sources")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count("*").alias("sources"), F.sum("v").alias("v"))
    most = langs.agg(F.max(F.col("v") * F.col("sources"))).first()[0] or 0
    shards = max(1, -(-most // shard_cells))
    shard = F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    none = F.lit(None).cast("long")
    marks = groups.select("lang", "source", "n").join(langs.select("lang", "n_lang", "v"), "lang").where("v > 0").select("lang", every.alias("shard"), "source", F.lit("").alias("term"), "n", "n_lang", "v")
    rows = kept.where("term != ''").select("lang", shard.alias("shard"), "source", "term", "n", none.alias("n_lang"), none.alias("v"))
    dealt = marks.unionByName(rows).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "term", "source")
    parts = cut(arrow_map(dealt, _shards(top), "lang string, part string, source string, item string, value long"), "shard-divergences")
    halves = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = halves.select("lang", sides, "value").select("lang", "x.source", "x.item", "value")
    silent = groups.select("lang", "source").join(langs.where("v = 0").select("lang"), "lang")
    silent = silent.join(groups.select("lang", F.col("source").alias("item")), "lang").where("source != item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    every_pair = pairs.unionByName(silent).withColumn("part", F.lit("pair"))
    best = parts.where("part = 'term'").select("lang", "source", "item", "value", "part")
    out = every_pair.unionByName(best)
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return out.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(n)::HUGEINT AS n FROM gn GROUP BY lang),
lc AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * v.v) AS p
  FROM gn JOIN k ON k.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT lc.lang, lc.term, 1 + (1000000000 * (lc.n + 2)) // (ln.n + 2 * v.v) AS q FROM lc JOIN ln ON ln.lang = lc.lang JOIN v ON v.lang = lc.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tr AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM u WHERE part = 'pair' OR rank <= 10
"""
