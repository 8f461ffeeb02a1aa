"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows become a hash table that is broadcast while its counted size is under a bound. Every position of every
document is looked up by its first two words in the broadcast set of the windows' beginnings; what is left builds its window key, joins
the table and is verified word by word. Beyond the bound slim rows of keys meet the windows by shuffle, and candidates go back to their
documents to be verified. Words inside verified windows are flagged, cut out, or their documents removed. Windows that several items
hold are looked up once; their items come in at the end.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; an item without an id
is left out; rows that repeat a doc_id are judged each by its own text; extra columns, whatever their names, pass through untouched in
the filtering actions. Empty tables give empty or all-clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows of the benchmark that may be broadcast; at some 200 bytes each, 200 MB. More are joined by shuffle.
MAX_BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORDS), "")


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _text_key() -> Column:
    return F.xxhash64("text")


def windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(w_id, w_len, w_key, w_pair, w_one, w_words of each distinct window, (w_id, w_item) of the items that hold it); an item shorter than the
    window is one window. w_one hashes the first word, w_pair the first two."""
    b = benchmark.select(F.col("item_id").cast("string").alias("w_item"), words(F.col("text")).alias("ww")).where("w_item is not null and size(ww) > 0")
    b = b.withColumn("w_len", F.least(F.lit(window), F.size("ww")))
    b = b.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("ww") - F.col("w_len"))))
    held = cut(b.select("w_item", "w_len", F.slice("ww", F.col("at") + 1, F.col("w_len")).alias("w_words")).distinct(), "window-items")
    h = _hashes(F.col("w_words"))
    table = held.select("w_len", "w_words").distinct().select(F.monotonically_increasing_id().alias("w_id"), "w_len", F.xxhash64(h).alias("w_key"), F.xxhash64(F.slice(h, 1, 2)).alias("w_pair"), F.xxhash64(F.slice(h, 1, 1)).alias("w_one"), "w_words")
    table = cut(table, "windows")
    return table, held.join(table.select("w_id", "w_len", "w_words"), ["w_len", "w_words"]).select("w_id", "w_item")


def _keyed(positions: DataFrame, lengths: list[int]) -> DataFrame:
    """positions (with dh and at) once for each window length that fits, with its w_len and w_key."""
    p = positions.withColumn("w_len", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.col("at") + F.col("w_len") <= F.size("dh"))
    return p.withColumn("w_key", F.xxhash64(F.slice("dh", F.col("at") + 1, F.col("w_len"))))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document text with a verified window: doc_id, text_key, h_spans (sorted start, end in words), h_items (sorted ids)."""
    table, held = windows(benchmark, window)
    sizes = {r["w_len"]: r["n"] for r in table.groupBy("w_len").agg(F.count("*").alias("n")).collect()}  # a row for each length
    lengths = sorted(sizes) or [window]
    d = docs.select("doc_id", _text_key().alias("text_key"), words(F.col("text")).alias("dw"))
    p = d.withColumn("dh", _hashes(F.col("dw"))).select("*", F.posexplode("dh").alias("at", "h0"))
    same = F.slice("dw", F.col("at") + 1, F.col("w_len")) == F.col("w_words")
    if sum(sizes.values()) <= max_broadcast:
        start, key = ("w_one", F.xxhash64("h0")) if lengths[0] == 1 else ("w_pair", F.xxhash64("h0", F.get("dh", F.col("at") + 1)))
        p = p.withColumn("start", key).join(F.broadcast(table.select(F.col(start).alias("start")).distinct()), "start", "left_semi")
        found = _keyed(p, lengths).join(F.broadcast(table), ["w_key", "w_len"]).where(same).select("doc_id", "text_key", "at", "w_len", "w_id")
    else:
        keys = _keyed(p, lengths).select("doc_id", "text_key", "at", "w_len", "w_key").join(table.select("w_id", "w_len", "w_key", "w_words"), ["w_key", "w_len"])
        some = keys.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "w_len", "w_id", "w_words")).alias("c"))
        some = some.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), "c")
        text = docs.select("doc_id", _text_key().alias("text_key"), "text").dropDuplicates(["doc_id", "text_key"])
        back = text.join(some, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))).withColumn("dw", words(F.col("text")))
        found = back.select("doc_id", "text_key", "dw", F.explode("c").alias("c")).select("doc_id", "text_key", "dw", "c.*").where(same).select("doc_id", "text_key", "at", "w_len", "w_id")
    found = found.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("w_len")).alias("end")))).alias("h_spans"),
        F.collect_set("w_id").alias("w_ids"),
    )
    found = cut(found, "hits")
    items = found.select("doc_id", "text_key", F.explode("w_ids").alias("w_id")).join(held, "w_id").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("w_item")).alias("h_items"))
    items = items.select(F.col("doc_id").alias("i_id"), F.col("text_key").alias("i_key"), "h_items")
    return found.join(items, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("text_key") == F.col("i_key"))).select("doc_id", "text_key", "h_spans", "h_items")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(spans, none, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n")))["n"]


def _with_hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = found.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "h_spans", "h_items")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans of every row of docs."""
    base = docs.select("doc_id", _text_key().alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = _with_hits(base, hits(docs, benchmark, window))
    n_hit = F.coalesce(_covered(F.col("h_spans")), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("h_items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("h_items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("h_spans").alias("hit_spans"),
    )


def _rows_with_hits(docs: DataFrame, benchmark: DataFrame, window: int, how: str) -> DataFrame:
    """row (all of docs as one struct, so that no name of theirs can clash) joined to its hits."""
    found = hits(docs, benchmark, window).select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "h_spans")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("h_id")) & (F.xxhash64("row.text") == F.col("h_key")), how)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a benchmark window."""
    return _rows_with_hits(docs, benchmark, window, "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the words inside benchmark windows, and what separates them from the next word, cut from the text."""
    j = _rows_with_hits(docs, benchmark, window, "left")
    old = F.col("row.text")
    raw = F.regexp_extract_all(old, F.lit(RAW_WORDS), F.lit(0))
    gaps = F.split(old, RAW_WORDS, -1)
    inside = lambda i: F.exists("h_spans", lambda s: (i >= s["start"]) & (i < s["end"]))
    kept = F.transform(raw, lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    text = F.when(F.col("h_spans").isNull(), old).otherwise(F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, "")))
    return j.select(F.col("row").withField("text", text).alias("row")).select("row.*")


ORACLE = """
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id::VARCHAR AS item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dp AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
hit AS (SELECT dp.r, dp.i, l.n, bg.item FROM dp CROSS JOIN (SELECT DISTINCT n FROM bg) l JOIN bg ON bg.n = l.n AND bg.g = array_to_string(dp.w[dp.i:dp.i + l.n - 1], ' ') WHERE dp.i + l.n - 1 <= len(dp.w)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
