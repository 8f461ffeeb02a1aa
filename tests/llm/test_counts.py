"""Top-k search, divergence audit and collocations against brute force, on odd rows and beyond 64 bits."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetflow.llm import divergence, phrases, topk
from facetflow.session import ship

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def clamp(x):
    return min(HIGH, max(LOW, x))


def brute_topk(rows, k, every):
    """rows (id, {term: weight}); (query_id, rank, vec_id, score) of all rows whose id is divisible by `every`."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q is None or q % every:
            continue
        scores = [(clamp(sum(w * u.get(t, 0) for t, w in v.items())), c) for j, (c, u) in enumerate(rows) if j != i]
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r, c, s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def whole(v, scale=1024):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return {t: clamp(math.floor(scale * x)) if math.isfinite(scale * x) else (HIGH if x > 0 else LOW) for t, x in enumerate(v)}


def taken(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_topk(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.choice((-1.0, 0.0, 0.3, 0.5, 1.0)) for _ in range(6)]) for i in range(300)]
    vectors += [(7, vectors[7][1]), (50, [0.5] * 6), (50, [0.5] * 6), (None, [1.0] * 6), (301, None), (302, [1.0, None]), (303, [math.nan]), (304, [math.inf, 1.0]), (350, []), (306, [2.0]), (400, [0.25] * 9)]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in vectors], "vec_id long, embedding array<float>, row int, kind string")
    rows = [(i, whole([None if x is None else float(np.float32(x)) for x in v] if v is not None else None)) for i, v in vectors]
    rows = [r for r in rows if r[1] is not None]
    want = brute_topk(rows, 10, 50)
    sparse = topk.sparse_rows(df)
    assert taken(topk.search(sparse, F.col("vec_id") % 50 == 0)) == want
    assert taken(topk.search(sparse, F.col("vec_id") % 50 == 0, cell_rows=20, cell_queries=2)) == want
    assert taken(topk.search(sparse, F.col("vec_id") % 50 == 0, k=1000)) == brute_topk(rows, 1000, 50)
    assert topk.search(topk.sparse_rows(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1e3, 1e5, 1e6, 1e15, 1e308])
def test_topk_scores_are_exact_at_every_size(spark, size):
    rng = random.Random(2)
    vectors = [(i, [rng.uniform(-1, 1) * size for _ in range(5)]) for i in range(40)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert taken(topk.search(topk.sparse_rows(df), F.col("vec_id") % 10 == 0, k=5)) == brute_topk([(i, whole(v)) for i, v in vectors], 5, 10)


def test_topk_of_sparse_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(1000) if rng.random() < 0.8 else 5 for _ in range(8)], [float(rng.randrange(-3, 4)) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, at array<int>, x array<double>")
    sums = []
    for i, at, x in rows:
        v = Counter()
        for t, w in zip(at, x):
            v[t] += int(w)
        sums.append((i, v))
    assert taken(topk.search(topk.sparse_rows(df, "x", "at", 1), F.col("vec_id") % 20 == 0)) == brute_topk(sums, 10, 20)
    broken = spark.createDataFrame([(1, [1], [1.0, 2.0])], "vec_id long, at array<int>, x array<double>")
    with pytest.raises(Exception, match="each component needs a term"):
        topk.sparse_rows(broken, "x", "at")


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(docs, least, top):
    count, groups, held = defaultdict(Counter), set(), defaultdict(set)
    for i, (lang, source, text) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall(text or ""):
            count[lang, source][lower(t)] += 1
            held[lang, lower(t)].add(i)
    out = []
    for lang in {x for x, _ in groups}:
        terms = [t for (x, t), d in held.items() if x == lang and len(d) >= least]
        of = {s: count[lang, s] for x, s in groups if x == lang}
        total = Counter()
        for c in of.values():
            total.update(c)

        def p(c):
            n = sum(c[t] for t in terms)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(terms)) for t in terms}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        q, ps = p(total), {s: p(c) for s, c in of.items()}
        for s in of:
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in terms), o.encode()) for o in of if o != s)
            best = sorted((-f(ps[s][t], q[t]), t.encode()) for t in terms if of[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, rows in (("pair", pairs), ("term", best)) for r, (v, i) in enumerate(rows, 1)]
    return sorted(out)


def odd_texts():
    rng = random.Random(4)
    words = ["The", "cat", "É", "ß日本", "a1b", "x_y", "[z]", "`", "{k}", "naïve", "\x00nul\x7f", "I", "İ", "K"]
    docs = [(rng.choice(("en", "en", "en", "de", None, "")), rng.choice(("a", "a", "a", "b", "c", None, "É")), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(300)]
    return docs + docs[:5] + [("en", "silent", None), ("en", "silent", ""), ("en", "marks", "12 34 ..."), ("fr", "only", "un deux"), ("fr", "other", "trois"), ("xx", "alone", None), ("en", "long", "word " * 50_000), ("en", "long", "word")]


def test_divergence(spark):
    docs = odd_texts()
    df = spark.createDataFrame([(i, s, x, t, "m", 1) for i, (x, s, t) in enumerate(docs)], "doc_id long, source string, lang string, text string, term string, n int").repartition(3)
    for least, top, cells in ((10, 10, 1 << 17), (2, 3, 8), (1, 2, 40), (10_000, 10, 8)):
        got = sorted(tuple(r) for r in divergence.audit(df, least, top, cells).select("lang", "source", "part", "item", "value", "rank").collect())
        assert got == brute_audit(docs, least, top)
    assert divergence.audit(df.limit(0)).count() == 0


def test_partial_counts_in_small_parts(monkeypatch):
    docs = [tuple(x or "" for x in d) for d in odd_texts()]
    monkeypatch.setattr(divergence, "PART_BYTES", 50)
    monkeypatch.setattr(divergence, "FLUSH", 100)
    batches = [pa.RecordBatch.from_pydict(dict(zip(("lang", "source", "text"), map(list, zip(*docs[i : i + 64]))))) for i in range(0, len(docs), 64)]
    n, held, marks = Counter(), Counter(), set()
    for b in divergence._partial([*batches, batches[0].slice(0, 0)]):
        for r in b.to_pylist():
            key = r["lang"], r["source"], r["term"]
            if r["term"]:
                n[key] += r["n"]
                held[key] += r["docs"]
            else:
                assert r["n"] == r["docs"] == 0
                marks.add(key[:2])
    want, want_held = Counter(), Counter()
    for lang, source, text in docs:
        terms = [(lang, source, lower(t)) for t in TERM.findall(text)]
        want.update(terms)
        want_held.update(set(terms))
    assert n == want and held == want_held and marks == {d[:2] for d in docs}


def test_shares_beyond_64_bits():
    counts = np.array([[0, 10**13, 5], [7 * 10**12, 3, 10**17]])
    totals = counts.sum(1)[:, None]
    want = [[1 + 10**9 * (c + 2) // (sum(row) + 6) for c in row] for row in counts.tolist()]
    assert divergence.shares(counts, totals, 3).tolist() == want


def brute_phrases(docs, least, percent, top, order=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, order + 1):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        some = {p: a for p, a in c.items() if " " in p and a >= least}
        longer = Counter()
        for p, a in some.items():
            w = p.split(" ")
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    s = " ".join(w[i : i + k])
                    longer[s] = max(longer[s], a)
        rows = []
        for p, a in some.items():
            if p in longer and 100 * longer[p] >= percent * a:
                continue
            w = p.split(" ")
            score, _, left, right = min((1000 * a * n[lang] // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k, c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w)))
            rows.append((-score, -a, p.encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases(spark):
    rng = random.Random(5)
    stock = ["of the", "New York city hall Today", "as a matter of fact", "the the the", "É ß", "日本 語\t!x", "don't", "a-b", "\x00 q"]
    docs = [(rng.choice(("en", "en", "de", None, "")), rng.choice((" ", ". ", "\n", "\t", ",")).join(rng.choices(stock + [f"w{rng.randrange(40)}"], k=rng.randrange(15)))) for _ in range(400)]
    docs += docs[:20] + [("en", None), ("en", ""), ("fr", "...  \t"), ("en", "of the " * 20_000), ("de", "oneword"), ("en", "a b" + "x" * 5000)]
    df = spark.createDataFrame([(i, t, x, 1, "w") for i, (x, t) in enumerate(docs)], "doc_id long, text string, lang string, f int, w1 string").repartition(3)
    for least, percent, top, buckets in ((100, 100, 2000, None), (5, 100, 7, 1 << 16), (5, 60, 2000, 8), (1, 100, 2000, 1 << 16), (300, 100, 3, 1 << 16)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least, percent, top, buckets=buckets).select(*COLUMNS).collect())
        assert got == brute_phrases(docs, least, percent, top)
    for order in (2, 3):
        got = sorted(tuple(r) for r in phrases.collocations(df, 5, order=order, buckets=1 << 12).select(*COLUMNS).collect())
        assert got == brute_phrases(docs, 5, 100, 2000, order)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrases_whose_words_share_a_hash(monkeypatch):
    monkeypatch.setattr(phrases, "hash_pieces", lambda buf, a, b: np.zeros(len(a), np.uint64))
    words = phrases.Words(np.frombuffer(b"One two\xffthree one two\xff", np.uint8))
    number, names = words.numbered()
    assert [names[i] for i in number] == [b"one", b"two", b"three", b"one", b"two"]


def test_scores_beyond_64_bits(spark):
    ship(spark)
    big = 3 * 10**14
    rows = [("en", 0, "", 5 * 10**15), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 1, "c", 2 * big), ("en", 2, "a b", big - 2), ("en", 2, "b c", big - 3), ("en", 3, "a b c", big - 7)]
    got = {r.phrase: r for r in phrases.scored(spark.createDataFrame(rows, "lang string, k int, phrase string, f long")).collect()}
    f = {p: n for _, _, p, n in rows}
    for p, cuts in (("a b", [("a", "b")]), ("a b c", [("a", "b c"), ("a b", "c")])):
        score, _, left, right = min((1000 * f[p] * f[""] // (f[x] * f[y]), k, f[x], f[y]) for k, (x, y) in enumerate(cuts))
        assert (got[p].score, got[p].l, got[p].r) == (score, left, right)


def test_ranks_over_ranges(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 20}", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    got = sorted((r.g, r["rank"], r.x, r.i) for r in phrases.ranked(df, "g", [F.desc("x"), F.asc("i")], 700).collect())
    want = []
    for g in {r[0] for r in rows}:
        want += [(g, k, x, i) for k, (x, i) in enumerate(sorted(((x, i) for h, x, i in rows if h == g), key=lambda t: (-t[0], t[1]))[:700], 1)]
    assert got == sorted(want)
