"""The operators against brute force, exact round trips and held-out accuracy, and on nulls, empty and long texts, ties and empty tables."""

import hashlib
import random
import re
import timeit
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetflow.llm import bpe, chat, decontaminate, embed, jaccard, license, pieces, pii, tokens, toxicity, warc
from facetflow.session import ship, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch string"


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def odd_docs(spark):
    """Nulls, empty, repeated, very long, and an extra column whose name an operator might use."""
    long = "released under the mit license " * 4000
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (4, long), (5, long), (None, "a b c d e f"), (6, "ÀÉ ß日本 12 "), (7, "one two three four five"), (8, "One, two. three-four five!")]
    return spark.createDataFrame([(i, t, None, "s", None, "b") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    real = table(spark, SF, "documents").withColumn("batch", F.lit("b"))
    return real.unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 100_000)).cache()


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def found(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_decontaminate(spark, docs):
    items = [(i.item_id, WORD.findall(lower(i.text))) for i in table(spark, SF, "benchmark").collect()] + [(900, ["one", "two", "three"]), (901, [])]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "x"), (902, None)], "item_id long, text string")
    want = []
    for i, t in pairs(docs):
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for item, words in items:
            n = min(10, len(words))
            grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found(decontaminate.report(docs, bench), *cols) == sorted(want, key=repr)
    bad = [x for x in want if x[-1]]
    assert decontaminate.remove_documents(docs, bench).count() == len(want) - len(bad)
    cut = decontaminate.remove_spans(docs, bench)
    assert cut.columns == docs.columns and cut.count() == len(want)
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_pii_base_spans_follow_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@_-+ 0123456789()") for _ in range(rng.randint(0, 60)))
        want = [("email", m.start(), m.end()) for m in email.finditer(t)]
        want += [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in card.finditer(t):
            d = re.sub("[ -]", "", m[0])
            if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
                want.append(("card", m.start(), m.end()))
        want += [("phone", m.start(), m.end()) for m in phone.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert pii.base_spans(t) == want, t


def test_pii_disguises_and_redaction(spark, docs):
    cases = {"mail john dot doe at example dot com now": "john dot doe at example dot com", "to jane [at] site [dot] org": "jane [at] site [dot] org", "x j.doe＠exаmple．com y": "j.doe＠exаmple．com", "plus four four two zero seven nine four six zero nine five eight": "plus four four two zero seven nine four six zero nine five eight"}
    for text, part in cases.items():
        base, every = pii.all_spans(text)
        assert not base and [text[a:b] for _, a, b in every] == [part]
    assert pii.all_spans("We met at noon dot. He sat at the end") == ([], [])
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii.find(docs.limit(0)).count() == 0 and pii.find(docs).count() == docs.count()


def test_pii_few_number_words_plus_bare_at_and_long_chains():
    long = " dot ".join("abcdefghij")
    cases = {
        "call +1 415 five five 5 0199 now": ("phone", "+1 415 five five 5 0199"),
        "call +1 (415) five five 5-0199": ("phone", "+1 (415) five five 5-0199"),
        "host one two seven dot zero dot zero dot one up": ("ip", "one two seven dot zero dot zero dot one"),
        "host 10.zero.0.one up": ("ip", "10.zero.0.one"),
        "call plus 49 30 1234567 now": ("phone", "plus 49 30 1234567"),
        "write john at example.com now": ("email", "john at example.com"),
        f"mail {long} at example dot com.": ("email", f"{long} at example dot com"),
        f"mail: john at {long} dot com.": ("email", f"john at {long} dot com"),
        f"mail: john [at] {long.replace(' dot ', '.')}.com.": ("email", f"john [at] {long.replace(' dot ', '.')}.com"),
    }
    for text, (kind, part) in cases.items():
        base, every = pii.all_spans(text)
        assert not base and [(k, text[a:b]) for k, a, b in every] == [(kind, part)], text
    for text in ("One of us came at noon.It rained", "look at example.com", "two plus two", "at 5 one left", "we sat at the end. 10 came"):
        assert pii.all_spans(text) == ([], []), text
    assert [k for k, _, _ in pii.all_spans("one ４１１１ １１１１ １１１１ １１１１")[1]] == ["card"]


def test_pii_takes_linear_time():
    for part in ("a dot ", "a at ", "a.", "[at] ", "at dot ", "one dot ", "five 5 ", "plus 4 ", "x @ y.", " at a.com b", "[ ", "one, ", "plus 49 30 1234567 a@b.co "):
        seconds = []
        for n in (4_000, 32_000):
            seconds.append(min(timeit.repeat(lambda: pii.all_spans(part * n), number=1, repeat=2)))  # noqa: B023
        assert seconds[1] < 24 * seconds[0] + 0.2, (part, seconds)


def test_pii_columns_of_whole_rows(spark, docs):
    """n_*, base_sha256 and spans follow from the patterns and the spans; base spans always stay."""
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    want = []
    for i, t in pairs(docs):
        t = t or ""
        base = [("email", m.start(), m.end()) for m in email.finditer(t)] + [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        base += [("card", m.start(), m.end()) for m in card.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
        base += [("phone", m.start(), m.end()) for m in phone.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want.append((i, *(sum(k == n for k, _, _ in base) for n in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest()))
        every = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.all_spans(t)[1]).split(",")
        assert set(joined.split(",")) - {""} <= set(every)
    out = pii.find(docs).cache()
    assert found(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    assert out.where("all_email + all_ip + all_card + all_phone <> n_email + n_ip + n_card + n_phone + n_added").count() == 0
    assert out.where("all_email < n_email or all_ip < n_ip or all_card < n_card or all_phone < n_phone").count() == 0
    texts = {i: t or "" for i, t in pairs(docs)}
    for r in out.where("spans <> ''").select("doc_id", "spans").limit(50).collect():
        order = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(","))]
        assert order == sorted(order) and all(0 <= a < b <= len(texts[r.doc_id]) for _, a, b in order)


def test_byte_bpe(spark, docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in pairs(docs):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found(bpe.digests(docs, path, P.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert found(back, "doc_id", "text") == sorted(((i, t or "") for i, t in pairs(docs)), key=repr)
    c = bpe.codec(path, P.PATTERN)
    for t in ["x" * 3000, " " * 700, "ab" * 900, "it's  a\n\n b ", "a\x1cb"]:
        assert c.encode_chunk([t], 10**6)[0][0].tolist() == enc.encode_ordinary(t)


def test_toxicity_held_out(spark):
    d = table(ship(spark), "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    out = toxicity.score(d, labels)
    r = out.join(labels.dropDuplicates(["doc_id"]), "doc_id").toPandas()
    held = r[r.held_out]
    assert ((held.predicted == 1) & (held.toxic == 1)).sum() >= 0.7 * (held.toxic == 1).sum()
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.01 * (held.toxic == 0).sum()
    assert out.where("score < 0 or score > 1 or score is null").count() == 0
    assert (zlib.crc32(b"17") % 3 == 1) == out.where("doc_id = 17").first().held_out


def test_toxicity_edges_and_contexts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, none).count() == docs.count() and toxicity.score(docs.limit(0), none).count() == 0
    assert toxicity.drop_toxic(docs, none).columns == docs.columns
    h = toxicity._word_hash("idiot")[0].view(np.int64)
    reader = toxicity.Reader({int(h): 6.0})
    i, t = toxicity.INSULT, toxicity.THREAT
    cases = {
        "You idiot": (i, "t"), "idiot, you are": (i, "t"), "an idiot": (i, ""), "it is not an idiot": (i, "n"), "someone said an idiot came": (i, "r"),
        "an idiot, wrote someone": (i, "r"), "": None, "fine words": None, "not here. idiot": (i, ""), "I will kill you": (t, "t"), "I will not kill you": (t, "nt"),
        "John said Mary will kill you": (t, "rt"), "to kill a process": (t, ""),
    }
    sums = reader.sums([*cases, None])
    names = [[k for k, c in toxicity._COLUMN.items() if s[c]] for s in sums]
    assert names == [[r] if r else [] for r in [*cases.values(), None]]
    weigh = lambda text: float(reader.sums([text])[0] @ np.array(list(toxicity.READINGS.values())))
    assert weigh("I will kill you") > weigh("John said Mary will kill you") > weigh("I will not kill you") > weigh("to kill a process")


def plain_readings(words, insults):
    """The clause's best readings by looking at each word's neighbourhood."""
    sets = {k: set(w.split()) for k, w in ((toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS))}
    kind = [next((k for k, s in sets.items() if w in s), toxicity.INSULT if w in insults else toxicity.OTHER) for w in words]
    found = []
    for at, k in enumerate(kind):
        if k in (toxicity.INSULT, toxicity.THREAT):
            near = lambda mark, before, after, at=at: mark in kind[max(0, at - before) : at] or mark in kind[at + 1 : at + 1 + after]
            f = "n" * near(toxicity.NEGATION, toxicity.NEGATION_REACH, 0) + "r" * near(toxicity.REPORT, len(words), toxicity.REPORT_AFTER) + "t" * near(toxicity.TARGET, toxicity.TARGET_REACH, toxicity.TARGET_REACH)
            found.append((k, f))
    best = {}
    for r in found:
        if r[0] not in best or toxicity.READINGS[r] > toxicity.READINGS[best[r[0]]]:
            best[r[0]] = r
    return {r: sum(x[0] == r[0] and x[1].replace("t", "") == r[1].replace("t", "") for x in found) for r in best.values()}


def test_toxicity_grammar_equals_a_plain_reader():
    insults = ["moron", "scum"]
    reader = toxicity.Reader({int(h): 6.0 for h in toxicity._word_hash(" ".join(insults)).view(np.int64)})
    pool = [*insults * 3, "kill", "you", "they", "not", "said", "and", "the", "fine", "day", "töten", "dich", "nicht"]
    rng = random.Random(4)
    for _ in range(3000):
        clauses = [[rng.choice(pool) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 3))]
        want = {}
        for c in clauses:
            for r, x in plain_readings(c, insults).items():
                want[r] = want.get(r, 0) + x
        s = reader.sums([". ".join(" ".join(c) for c in clauses)])[0]
        assert {r: s[c] for r, c in toxicity._COLUMN.items() if s[c]} == want, clauses


def test_toxicity_lexicon_counts_families(spark):
    """Copies weigh as one in features and totals, and unrelated texts that share a word are families of their own."""
    ship(spark)
    rng, rows = random.Random(9), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    common = [word() for _ in range(12)]
    text = lambda *more: " ".join([w for c in zip(*[iter(rng.sample(common, 12))] * 2) for w in (word(), *c)] + [*more])
    for k in range(60):  # 60 toxic families of 20 copies
        rows += [(text(*["vexgrumble"] * (k < 12)), 1)] * 20
    rows += [(text(*["vexgrumble"] * (k < 3)), 0) for k in range(1500)]
    d = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, toxic int")
    lexicon = toxicity.learn_lexicon(d)
    h = int(toxicity._word_hash("vexgrumble")[0].view(np.int64))
    assert lexicon[h] == pytest.approx(np.log(12.5 / 61) - np.log(3.5 / 1501))
    assert not {int(x) for w in common for x in toxicity._word_hash(w).view(np.int64)} & set(lexicon)


def test_chat_round_trip(spark):
    rng = random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choice(["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "a", "<\\|", "<<SYS>>", "\n"]) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)
        f, a, b, _ = chat.format_turn("assistant", [{"type": "text", "text": t}])
        assert chat.parse_turn(f)[0] == "assistant" and chat.text_of(chat.parse_turn(f)[1]) == t and chat.unescape(f[a:b]) == t
    f, *_, refs = chat.format_turn("user", [{"type": "text", "text": "see"}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b", "seconds": 1.0}])
    assert "see<|image:0|><|audio:1|>" in f and [r["tokens"] for r in refs] == [4, 50]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])
    assert chat.parse_turn(f) == ("user", [{"type": "text", "text": "see"}, {"type": "image", "index": 0}, {"type": "audio", "index": 1}])
    looks = chat.format_turn("user", [{"type": "text", "text": "<"}, {"type": "text", "text": "|image:0|> <|image:7|>"}])[0]
    assert chat.parse_turn(looks) == ("user", [{"type": "text", "text": "<|image:0|> <|image:7|>"}])
    image = {"type": "image", "text": None, "ref": "a.png", "width": 28, "height": 15, "seconds": None, "pages": None}
    text = image | {"type": "text", "text": "see", "ref": None}
    turns = [(5, 0, "user", None, [text, image, image]), (5, 1, "assistant", "<|image:0|>", None), (5, 2, "user", None, [image | {"type": "document", "pages": 2}]), (5, 3, "user", None, [])]
    rows = spark.createDataFrame(turns, f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    out = chat.format_turns(rows).cache()
    by = {r.turn: r for r in out.collect()}
    assert [[a["index"] for a in by[k].attachments] for k in range(4)] == [[0, 1], [], [2], []] and "<|document:2|>" in by[2].formatted
    back = chat.read_back(out).first()
    assert (back.n_attachments, back.attachment_tokens, back.loss_chars) == (3, 4 + 4 + 1600, len("<|image:0|>"))
    assert back.turns_sha256 == hashlib.sha256(b"user\nsee\nassistant\n<|image:0|>\nuser\n\nuser\n\n").hexdigest()
    rows = spark.createDataFrame([(1, 1, "assistant", None, "x"), (1, 0, None, "q", "x"), (2, None, "user", "", "x"), (2, None, "user", "", "x")], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(rows)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"\nq\nassistant\n\n").hexdigest() and got[2].n_turns == 2 and got[1].loss_chars == 0
    assert chat.read_back(chat.format_turns(rows.limit(0))).count() == 0


def test_chat_tied_turns(spark):
    """Turns with the same number are in the order of role and text as they were, not as they are escaped and marked."""
    rng = random.Random(8)
    bits = ["ok", " then", "!", "<", "<|", "<\\|", "<a", "[INST]", "[", "[J", "</s>", "<0", "\n", "é", "\\", "<<SYS>>", "<image:0|>"]
    rows = [(1, 0, "user", "ok"), (1, 0, "user", "ok then"), (1, 0, "user", "ok!")]
    rows += [(c, rng.choice((None, 0, 0, 1)), rng.choice(("user", "assistant", "<|", "<a", None)), rng.choice((None, *bits)) and "".join(rng.choices(bits, k=rng.randrange(4)))) for c in range(2, 60) for _ in range(8)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in got:
        turns = sorted(((t is not None, t or 0, (r or "").encode(), (x or "").encode()) for i, t, r, x in rows if i == c))
        assert got[c].turns_sha256 == hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, _, r, x in turns)).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(b"".join(x for _, _, r, x in turns if r == b"assistant")).hexdigest()
    image = {"type": "image", "text": None, "ref": None, "width": 14, "height": 14, "seconds": None, "pages": None}
    text = lambda t: image | {"type": "text", "text": t}
    parts = [(1, 0, "user", None, p) for p in ([image], [text("!"), image], [text("a"), image], [text("\U0001f600")], [image, image])]
    back = chat.format_turns(spark.createDataFrame(parts, f"conv_id long, turn long, role string, text string, parts {chat.PARTS}"))
    order = [chat.parse_turn(r.formatted)[1] for r in chat.in_order(back).collect()]
    assert [p["index"] for turn in order for p in turn if p["type"] == "image"] == [0, 1, 2, 3, 4]
    assert [chat.text_of(p) for p in order] == ["!", "a", "", "", "\U0001f600"]


def test_warc(spark):
    ship(spark)
    html = [None, "", "<p>é</p>", "<p>é</p>", "same", "same", "same", "x" * 500_000]
    rows = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h, "d") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    folder, manifest = warc.write(rows)
    got = {r.page_id: r for r in warc.read(spark, folder, manifest, with_payload=True).collect()}
    assert [got[i].refers_to for i in range(8)] == [None, 0, None, 2, None, 4, 4, None]
    assert all(r.record_type == "revisit" or bytes(r.payload) == (html[i] or "").encode() for i, r in got.items())
    assert got[7].payload_bytes == 500_000 and got[3].payload_digest == got[2].payload_digest
    assert all(r.record_type == "response" for r in warc.read(spark, *warc.write(rows, min_revisit_bytes=10**6)).collect())
    assert warc.read(spark, *warc.write(rows.limit(0))).count() == 0
    odd = spark.createDataFrame([(None, None, "p"), (1, "u", "p"), (1, "v", "p"), (2, "u", "p"), (None, None, "q")], "page_id long, url string, html string")
    back = found(warc.read(spark, *warc.write(odd)), "page_id", "record_type", "refers_to", "payload_bytes")
    assert back == sorted([(None, "revisit", 1, 1), (1, "response", None, 1), (1, "response", None, 1), (2, "revisit", 1, 1), (None, "response", None, 1)], key=repr)


def test_token_shards(spark, docs):
    path = P.path("word_bpe_49k.json")
    tk, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for file_bytes in (1, 1 << 20):  # a shard a file, then many
        folder, manifest = tokens.write(docs, path, shard_tokens=20_000, file_bytes=file_bytes)
        assert manifest.count() > 2 or file_bytes > 1
        assert found(tokens.read(spark, folder, manifest), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert tokens.read(spark, *tokens.write(docs.limit(0), path)).count() == 0
    starts = spark.createDataFrame([(f"f{p}-{q}", p, q, 10 * p + q) for p in range(30) for q in range(2)], "file string, part int, seq int, n_tokens long")
    at = {r.file: r.file_start for r in tokens.file_starts(starts, block=4).collect()}
    n = 0
    for p in range(30):
        for q in range(2):
            assert at[f"f{p}-{q}"] == n
            n += 10 * p + q


def test_tokenizer_of_other_settings_goes_to_the_library(tmp_path):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    other = tmp_path / "other.json"
    other.write_text(text.replace('{"type":"Lowercase"}', '{"type":"NFKC"}').replace('{\n        "type": "Lowercase"\n      }', '{"type": "NFKC"}'), encoding="utf-8")
    a, b = tokens.Encoder(P.path("word_bpe_49k.json")), tokens.Encoder(str(other))
    assert a.known_steps and not b.known_steps
    for e, path in ((a, P.path("word_bpe_49k.json")), (b, str(other))):
        tk = Tokenizer.from_file(path)
        for t in ("The QUICK brown fox 12", "", "a<|endoftext|>b", "É é"):
            assert e.encode([t])[0].tolist() == tk.encode(t, add_special_tokens=False).ids


def thue_morse(n=11):
    x = "a"
    for _ in range(n):
        x += x.translate({97: 98, 98: 97})
    return x, x.translate({97: 98, 98: 97})


def test_pieces_that_sums_of_powers_confuse(spark):
    a, b = thue_morse()
    buf = np.frombuffer((a + b).encode(), np.uint8)
    assert len(set(pieces.hash_pieces(buf, np.array([0, 2048]), np.array([2048, 4096])).tolist())) == 2
    short = [np.frombuffer(w, np.uint8) for w in {bytes([x, y, z]) for x in range(9) for y in range(9) for z in range(9)}]
    joined = np.concatenate(short)
    at = np.arange(0, len(joined), 3)
    assert len(set(pieces.hash_pieces(joined, at, at + 3).tolist())) == len(short)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = bpe.codec(path, P.PATTERN).encode_chunk([a, b], 10**6)
    assert [(g[0].tolist(), g[2].decode()) for g in got] == [(enc.encode_ordinary(t), t) for t in (a, b)]
    tk = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert [x.tolist() for x in tokens.Encoder(P.path("word_bpe_49k.json")).encode([a, b])] == [tk.encode(t, add_special_tokens=False).ids for t in (a, b)]
    d = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert found(jaccard.join(d), "doc_id", "n_links") == [(1, 0), (2, 0)]


def test_hash_clashes_change_no_ids(monkeypatch):
    texts = ["the cat and the hat", "one two three four five six", "a b c dog pig", None, ""]
    weak = lambda buf, s, e: (e - s).astype(np.uint64) % np.uint64(3)
    monkeypatch.setattr(bpe, "hash_pieces", weak)
    monkeypatch.setattr(tokens, "hash_pieces", weak)
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for ids, digits, raw in [bpe.Codec(path, P.PATTERN).encode_chunk([t], 100)[0] for t in texts[:3]]:
        text = raw.decode()
        assert text in texts and ids.tolist() == enc.encode_ordinary(text) and digits.decode() == ",".join(map(str, ids))
    tk, e = Tokenizer.from_file(P.path("word_bpe_49k.json")), tokens.Encoder(P.path("word_bpe_49k.json"))
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [tk.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bits():
    rng = np.random.default_rng(1)
    for width in (1, 7, 17, 18, 32):
        v = rng.integers(0, 1 << width, 150_001, dtype=np.uint64).astype(np.uint32)
        b = tokens.to_bits(v, width)
        assert len(b) == -(-len(v) * width // 8)
        for i, j in ((0, len(v)), (0, 0), (5, 6), (65_535, 65_537), (70_001, 140_003)):
            assert (tokens.from_bits(b, width, i, j) == v[i:j]).all()


def most_frequent_pair(a):
    """Places of the most frequent pair of neighbours in a grammar's symbols, overlaps included."""
    ends = set((a["offsets"][1:].astype(int) - 1).tolist())
    s = a["symbols"].tolist()
    return max(Counter((s[k], s[k + 1]) for k in range(len(s) - 1) if k not in ends).values(), default=0)


@pytest.mark.parametrize("ids", [[7] * 100_000, [3] * 5, [7, 8] * 3000, list(range(3, 67)) * 6, [5], [3, 3, 3, 4] * 50 + [2]])
def test_grammar_of_one_id_and_of_one_phrase(ids):
    ids, counts = np.array(ids, np.uint32), np.array([len(ids)])
    a = tokens.compress(ids, counts, 100)
    assert most_frequent_pair(a) < tokens.MIN_COUNT
    assert len(a["symbols"]) <= max(12, len(ids) // 8) or len(ids) < 12
    shard = tokens.Shard(tokens.pack({"base": 100, "end_id": 2}, a | {"counts": counts.astype(np.uint32)}))
    assert (shard.document(0) == ids).all()


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(2)
    phrases = [rng.integers(3, 2000, n) for n in (150, 90, 40)]
    docs = [np.append(np.concatenate([phrases[rng.integers(3)] if rng.random() < 0.7 else rng.integers(3, 2000, 20) for _ in range(6)]), 2).astype(np.uint32) for _ in range(300)]
    counts = np.array([len(d) for d in docs])
    a = tokens.compress(np.concatenate(docs), counts, 2000)
    assert a["lengths"].max() > 64
    assert most_frequent_pair(a) < tokens.MIN_COUNT
    shard = tokens.Shard(tokens.pack({"base": 2000, "end_id": 2}, a | {"counts": counts.astype(np.uint32)}))
    for k in rng.integers(0, 300, 60):
        i, j = sorted(rng.integers(0, len(docs[k]) + 1, 2))
        assert (shard.document(k) == docs[k]).all() and (shard.document(k, i, j) == docs[k][i:j]).all()


def test_grammar_random_access():
    rng = np.random.default_rng(4)
    docs = [np.append(rng.choice(40, rng.integers(0, 400), p=np.r_[[0.5], np.full(39, 0.5 / 39)]), 2).astype(np.uint32) for _ in range(200)]
    counts = np.array([len(d) for d in docs])
    a = tokens.compress(np.concatenate(docs), counts, 50, min_count=8)
    more = {"doc_ids": np.arange(200), "doc_null": np.zeros(200, np.uint8), "counts": counts.astype(np.uint32)}
    s = tokens.Shard(tokens.pack({"base": 50, "end_id": 2}, a | more))
    assert len(s.rules) > 3 and s.offsets[-1] < counts.sum()
    for k, d in enumerate(docs):
        assert (s.document(k) == d).all() and (s.document(k, 3, 9) == d[3:9]).all()


def brute_links(docs):
    rows = []
    for i, t in pairs(docs):
        w = WORD.findall(lower(t))
        n = min(5, len(w))
        rows.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()))
    links, group = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if None not in (rows[a][0], rows[b][0]) and rows[a][1] and rows[b][1]:
                c = len(rows[a][1] & rows[b][1])
                if 5 * c >= 4 * (len(rows[a][1]) + len(rows[b][1]) - c):
                    links[a] += 1
                    links[b] += 1
                    group[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, least.get(top(k)), links[k]) for k, (i, _) in enumerate(rows)), key=repr)


def test_jaccard_join(spark, docs):
    assert found(jaccard.join(docs), "doc_id", "class_id", "n_links") == brute_links(docs)
    assert jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_repeated_ids_with_other_texts(spark):
    word = lambda k: [f"w{k}x{i}" for i in range(18)]
    a, b = word(1), word(2)
    near = lambda w: [*w[:17], "changed"]
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (3, word(3)), (4, a), (1, a), (2, word(4)), (5, word(3))]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert found(jaccard.join(d), "doc_id", "class_id", "n_links") == brute_links(d)
    kept = found(jaccard.representatives(d.withColumn("rep", F.lit("x"))), "doc_id", "text")
    assert kept == sorted(((i, " ".join(w)) for i, w in [(1, a), (1, b), (3, word(3)), (2, word(4))]), key=repr)


def test_jaccard_recall(spark, capsys):
    """Candidates for pairs at 0.80 to 0.82, all leaves split down to a few classes."""
    rng, n = np.random.default_rng(5), 1500
    texts = []
    for _ in range(n):
        shared, own = rng.integers(0, 1 << 62, 82 + 8), rng.integers(0, 1 << 62, 20)
        texts += [np.unique(np.concatenate((shared, own[:10]))).astype(np.uint64), np.unique(np.concatenate((shared, own[10:]))).astype(np.uint64)]
    assert all(0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.83 for a, b in zip(texts[::2], texts[1::2]))
    rows = [(k, len(s), [int(x) for x in jaccard.signature(s)]) for k, s in enumerate(texts)]
    classes = spark.createDataFrame(rows, "rep long, n int, sig array<int>").cache()
    met = lambda runs: jaccard.leaves(classes, runs, leaf=2).groupBy("bucket", (F.col("rep") / 2).cast("long").alias("p")).count().where("count = 2").select("p").distinct().count()
    runs = jaccard.runs_for(jaccard.RECALL, 0.8)
    got = {r: met(r) / n for r in (1, runs)}
    with capsys.disabled():
        print(f"\nchosen paths: pairs met at 0.80 to 0.83: {got}, expected at 0.8 {[round(jaccard.expected_recall(r, 0.8), 5) for r in got]}")
    assert got[runs] >= 0.999 and got[1] >= 0.85


def test_jaccard_large_groups_and_common_passages(spark, monkeypatch):
    """Nodes above the leaf size split, dense ones become leaves, and leaves are dealt out in blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 40)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(200)], " ".join(word() for _ in range(120))
    texts = [" ".join(w if k != rng.randrange(200) else word() for k, w in enumerate(base)) for _ in range(150)]
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(jaccard.join(d), "doc_id", "class_id", "n_links") == brute_links(d)


def test_embeddings(spark):
    ship(spark)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 16)), base[:5]])
    rows = [(i, [float(x) for x in v], int(i % 60 % 3), 0) for i, v in enumerate(near)]
    rows += [(200, None, 1, 0), (201, [0.0] * 16, 1, 0), (202, [float("nan")] * 16, 1, 0), (203, rows[0][1], None, 0), (None, rows[0][1], 0, 0), (204, [1.0, None], 1, 0), (205, [1.0, 2.0], 1, 0), (206, [2.0, 4.0], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(df).collect()}
    x = near / np.linalg.norm(near, axis=1, keepdims=True)
    ok = (x @ x.T >= 0.93) & (np.arange(95)[:, None] % 60 % 3 == np.arange(95)[None, :] % 60 % 3)
    assert [got[i][0] for i in range(95)] == (ok.sum(1) - 1).tolist()
    assert [got[i] for i in (200, 201, 202, 203, 204, None)] == [(0, 200), (0, 201), (0, 202), (0, 203), (0, 204), (0, None)]
    assert got[205] == got[206] == (1, 205)
    assert embed.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_repeated_ids(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [v[0] + 0.1, v[1] + 0.1, 0.0]
    rows = [(1, x, 0, "r"), (1, y, 0, "r"), (2, near(x), 0, "r"), (3, near(y), 0, "r"), (1, x, 0, "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string")
    assert found(embed.near_duplicates(df), "vec_id", "n_links", "component_id") == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_embedding_recall(spark, capsys):
    """20,000 vectors in clusters with planted partners at 0.93 to 0.95, many cells, one coarse level and several."""
    rng, n, dim = np.random.default_rng(3), 20_000, 32
    base = rng.standard_normal((60, dim))[rng.integers(0, 60, n - 4000)] + 0.9 * rng.standard_normal((n - 4000, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    at = rng.integers(0, n - 4000, 4000)
    side = rng.standard_normal((4000, dim))
    side -= (side * base[at]).sum(1, keepdims=True) * base[at]
    c = rng.uniform(0.931, 0.95, (4000, 1))
    x = np.concatenate((base, c * base[at] + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1, keepdims=True)))
    want = np.concatenate([(x[k : k + 2000] @ x.T >= 0.93).sum(1) - 1 for k in range(0, n, 2000)])
    df = spark.createDataFrame(zip(range(n), x.tolist(), [0] * n), "vec_id long, embedding array<double>, label int").repartition(8).cache()
    for name, more in (("one level", {}), ("two levels", {"level_centres": 16})):
        got = np.zeros(n, int)
        for r in embed.near_duplicates(df, **more).select("vec_id", "n_links").collect():
            got[r.vec_id] = r.n_links
        recall = got.sum() / want.sum()
        with capsys.disabled():
            print(f"\nproduct quantisation, {name}: {got.sum()} of {want.sum()} link ends, recall {recall:.4f}")
        assert (got <= want).all() and want.sum() >= 8000 and recall >= 0.95
    assert embed.level_sizes(20_000, 16_384, level_centres=16) == [16, 10] and embed.level_sizes(10**9, 16_384)[0] == 2_048
    assert np.prod(embed.level_sizes(10**9, 16_384), dtype=float) >= 10**9 / embed.CELL


def test_a_block_of_near_copies_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    x = np.ones((6000, 64)) + 0.01 * rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = embed.Quantiser(x[:1000], 1000, 0.93, 0.99)
    cell, probes, codes, err = model.assign(x)
    ids = np.arange(6000)
    cell[:] = 0
    index = {"rep": ids[:2000], "copies": np.ones(2000, int), "vec": x[:2000], "err": err[:2000], "probes": probes[:2000] * 0 + 1, "codes": codes[:2000]}
    probe = {"rep": ids[2000:], "copies": np.ones(4000, int), "vec": x[2000:], "cell": cell[2000:]}
    index["vec"] = index["vec"]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    links_i, links_q, root = embed.block_links(model, 0, index, probe, 0.93)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert (links_i == 4000).all() and (links_q == 2000).all() and (root == 0).all() and peak < 250e6


def test_licenses(spark, docs):
    want = []
    for i, t in pairs(docs):
        w, places, base = WORD.findall(lower(t)), [], set()
        for phrase, label in license.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))))
    out = license.scan(docs).cache()
    assert found(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert out.where("score < 0 or score > 1").count() == 0 and license.scan(docs.limit(0)).count() == 0
    s = license.Scanner().scan("Some words. Relased under the MIT licence, and more")
    assert s["n_base"] == 0 and s["labels"] == "mit" and 0 < s["score"] < 1 and s["spans"][0]["start"] == 2 and s["spans"][0]["end"] == 7


def test_license_spans_equal_the_regex_over_whole_texts():
    """Edited notices in noise: the seeds lose no match of the bounded-error pattern."""
    rng, scanner = random.Random(6), license.Scanner()
    letters = "abcdefghijklmnopqrstuvwxyz "
    for _ in range(250):
        n, label, e, pattern = rng.choice([x for x in scanner.notices if x[2] and x[0] not in scanner.names])
        t = list(n)
        for _ in range(rng.randint(0, e)):
            k = rng.randrange(1, len(t) - 1)
            t[k : k + 1] = rng.choice([[], [rng.choice(letters)], [t[k], rng.choice(letters)]])
        line = " ".join(" ".join(["".join(rng.choice("qxz") for _ in range(5)) for _ in range(6)] + ["".join(t).strip()] + ["zzz qq"]).split())
        got = {(a, b) for a, b, x, _ in scanner.fuzzy(line) if x == label}
        assert any(a == m.start() and b == m.end() for m in pattern.finditer(line) for a, b in got) == bool(pattern.search(line)), line


def test_licenses_misspelt_base_phrases():
    scan = license.Scanner().scan
    cases = {"available under the MIT licence": ("mit", 1, 5), "distributed under teh MIT license": ("mit", 1, 5), "see the Apache Licence, Version 2.0": ("apache-2", 2, 6)}
    for text, (label, a, b) in cases.items():
        s = scan(text)
        assert s["n_base"] == 0 and s["labels"] == label and 0 < s["score"] < 1, text
        assert [(x["start"], x["end"]) for x in s["spans"]] == [(a, b)]
    for text in ("under the MPL license", "under the BSD license", "Apache License, Version 1.1"):
        assert scan(text)["labels"] == "", text
    long = {"released under the MPL license": "", "licensed under the Apache License, Version 1.1": "", "licensed under CC BY-ND 4.0": "", "licensed under CC BY-SA 4.0": "cc-by-sa", "licenced under CC BY NC 4.0": "cc-by-nc", "relased under the MIT licence": "mit", "GNU Affero General Public Licence": "agpl"}
    assert {t: scan(t)["labels"] for t in long} == long
    s = scan("available under the MIT license")
    assert s["n_base"] == 1 and s["spans"] == [] and s["score"] == 0.5 + 0.5 * 4 / 5
    s = scan("under the MIT license or under the MIT licence or relased under the MIT licence")
    assert [(x["start"], x["end"]) for x in s["spans"]] == [(5, 9), (10, 15)]


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    docs = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == d.columns and docs.count() <= before.count()
        if name == "near_duplicates":
            reps = {c for _, c, _ in brute_links(before)}
            assert {r.doc_id for r in docs.collect()} == reps
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeated ids, extra columns and an empty table pass through all stages."""
    import corpus_pipeline

    odd = odd_docs(spark).withColumn("lang", F.lit("en"))
    for t in ("labels", "benchmark"):
        table(spark, SF, t).write.parquet(str(tmp_path / f"{t}.parquet"))
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        ids = sorted((r.doc_id for r in docs.collect()), key=repr)
        assert ids == sorted((r.doc_id for r in last.collect()), key=repr)
    assert ids == []
