"""Personal data with exact source offsets, also where it is disguised.

A text goes through three transducers that each keep, for every output character, the source range it came from: look-alike
characters to ASCII (invisible ones vanish), words for digits to digits, and "at"/"dot" in words or brackets to @ and a full
stop. Runs of three number words and more are always read as digits, then also shorter ones beside digits, a plus or a dot chain;
what only the second reading finds is added last. The identifier patterns then run on the output, and their spans go back through the ranges to source characters. The
plain patterns run on the source itself; their spans always stay, and a span from the transducers is added where it touches
none of them.

Defined results: a null text is empty; empty texts have no spans; the time is linear in a text's length; each row is judged
alone, so ties and repeated rows change nothing; extra columns are left out of find() and kept by redact().
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import arrow_map

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TLD = re.compile(r"\.[A-Za-z]{2,}$")  # asked of disguised addresses only


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local@domain: the local part reaches back from its @ to the end of the match before at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Look-alikes of ASCII characters (Cyrillic, Greek, punctuation), and characters that take no room.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅοαινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．。․﹒﹫‐‑‒–—−", "aeopcyxijsdhlABEKMHOPCTXIJSoaivpuABEZHIKMNOPTYX@....@------", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
#: Words for the digits 0 to 9 in four languages.
DIGIT_WORDS = {w: d for d, ws in enumerate(("zero oh null cero", "one eins un une uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for w in ws.split()}
#: At least three number words in a row, or number words beside digits, a plus or a dot chain, are read as digits.
_NUMBER = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_NUMBER})(?:[ ,-]{{1,2}}(?:{_NUMBER}|[0-9]+))*(?![^\W_])", re.I)
_SPELLED_WORD = re.compile(rf"(?:{_NUMBER})(?![^\W_])", re.I)
_PLUS = re.compile(r"\bplus[ -]+(?=[0-9])", re.I)
#: user (at) host (dot) tld, in brackets or as bare words; bare words count only as the whole chain.
_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_%+-]*"
_AT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_CHAIN = re.compile(rf"(?<![A-Za-z0-9_%+-]){_TOKEN}(?:{_DOT}{_TOKEN})*", re.I)
#: An "at" without the blanks around it; a part that ends where one begins; a domain after it.
_AT_CORE = re.compile(r"[\[({<]\s*(?:at|@)\s*[\])}>]|(?<=\s)at(?=\s)|@", re.I)
_DOMAIN_CHAIN = re.compile(rf"\s*({_TOKEN}(?:{_DOT}{_TOKEN})+)", re.I)
_BARE = re.compile(r"\s(?:at|dot)\s", re.I)
#: What a chain in bare words must end in, as "at" and "dot" are also plain words.
COMMON_ENDS = frozenset("com org net edu gov info io co biz dev ai uk us eu de fr es it nl ch at be ca au".split())
#: Ends that are also words, so that a capital after a full stop begins a sentence.
WORD_ENDS = frozenset("it be us at".split())
#: Words before a bare "at" and a plainly written host that tell where something is and are no local part.
PLACE_WORDS = frozenset("a about and are available be bought but find found go hosted i is it live look me more now off on online or out published read see shop site the them there this up us visit was we were".split())
_DOT_ONE = re.compile(_DOT, re.I)
_DISGUISED = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]|\sdot\s", re.I)
#: A bare "at" before a dotted name with a common end.
_AT_HOST = re.compile(rf"\sat\s+[A-Za-z0-9][A-Za-z0-9_%+.-]*\.(?:{'|'.join(sorted(COMMON_ENDS))})(?![A-Za-z0-9_%+-])", re.I)
_IP_DOTS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_BEFORE = re.compile(rf"(?:[0-9][ ,().-]{{1,3}}|\+[ (]?|(?<![^\W_])plus[ -]+|(?:[0-9]|(?<![^\W_])(?:{_NUMBER})){_DOT})\Z", re.I)
_BESIDE = re.compile(rf"[ ,().-]{{1,3}}[0-9]|{_DOT}(?:[0-9]|(?:{_NUMBER})(?![^\W_]))", re.I)
_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "！-～\U0001d400-\U0001d7ff٠-٩۰-۹]")


class Tape:
    """Text with, for each character, the source range that it stands for."""

    def __init__(self, text: str, start=None, end=None):
        self.text = text
        self.start = range(len(text)) if start is None else start
        self.end = range(1, len(text) + 1) if end is None else end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Each (start, end, new) replaces characters; a new character stands for the whole range replaced."""
        if not edits:
            return self
        out, s, e, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            s += [*self.start[at:a], *[self.start[a]] * len(new)]
            e += [*self.end[at:a], *[self.end[b - 1]] * len(new)]
            at = b
        out.append(self.text[at:])
        return Tape("".join(out), s + list(self.start[at:]), e + list(self.end[at:]))


def _unmask(c: str) -> str:
    import unicodedata

    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    n = unicodedata.normalize("NFKC", c)
    if n.isdigit() and not n.isascii():
        return str(unicodedata.digit(n))
    return n


def homoglyphs(tape: Tape) -> Tape:
    """A mark between letters of its own script only is left alone where the word has no ASCII letter or digit."""
    edits = []
    for m in re.finditer(r"\S+", tape.text):
        if _ODD.search(m[0]) and (any(c.isascii() and c.isalnum() for c in m[0]) or any(not c.isalpha() for c in m[0])):
            edits += [(i, i + 1, _unmask(tape.text[i])) for i in range(m.start(), m.end()) if _ODD.match(tape.text[i])]
    return tape.rewrite(edits)


def spelled_digits(tape: Tape, least: int = 3) -> Tape:
    """Runs of `least` number words and more as digits. Shorter ones are left alone at 3; at 1 they are read beside digits, a plus
    or a dot chain, and keep what stands between them and digits."""
    edits = []
    for m in _SPELLED.finditer(tape.text):
        found = list(_SPELLED_WORD.finditer(tape.text, m.start(), m.end()))
        few = len(found) < 3
        if few and (least >= 3 or not (_DIGIT.search(m[0]) or _BESIDE.match(tape.text, m.end()) or _BEFORE.search(tape.text[max(0, m.start() - 40) : m.start()]))):
            continue
        at, word = m.start(), False
        while at < m.end():
            w = _SPELLED_WORD.match(tape.text, at)
            if w:
                edits.append((at, w.end(), str(DIGIT_WORDS[w[0].lower()])))
                at, word = w.end(), True
            elif tape.text[at] in " ,-":
                b = at
                while b < m.end() and tape.text[b] in " ,-":
                    b += 1
                if not few or word and _SPELLED_WORD.match(tape.text, b):
                    edits.append((at, b, ""))
                at = b
            else:
                at, word = at + 1, False
    return tape.rewrite(edits)


def plus_sign(tape: Tape) -> Tape:
    return tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])


def _chains(text: str):
    """(start, end of the local part, start, end of the domain) of each local at domain. What lies between two "at" is read once for
    each of them, so the time is linear in the text."""
    cores = [(m.start(), m.end()) for m in _AT_CORE.finditer(text)]
    for k, (a, b) in enumerate(cores):
        free = cores[k - 1][1] if k else 0
        domain = _DOMAIN_CHAIN.match(text, b, cores[k + 1][0] if k + 1 < len(cores) else len(text))
        if domain:
            local = None
            for local in _CHAIN.finditer(text, free, a):
                pass
            if local and not text[local.end() : a].strip():
                yield local.start(), local.end(), domain.start(1), domain.end(1)


def at_dot(tape: Tape) -> Tape:
    edits, taken = [], 0
    for a, b, c, d in _chains(tape.text):
        whole, middle = tape.text[a:d], tape.text[b:c]
        if a < taken or not (_DISGUISED.search(whole) or _BARE.search(middle)):
            continue
        if _BARE.search(whole):
            end = whole.split(".")[-1].split()[-1]
            if end.lower() not in COMMON_ENDS:
                continue
            if not _DISGUISED.search(whole) and (end.lower() in WORD_ENDS and not end.islower() or tape.text[a:b].lower() in PLACE_WORDS):
                continue
        edits += [(x.start(), x.end(), ".") for x in _DOT_ONE.finditer(tape.text, a, b)]
        edits.append((b, c, "@"))
        edits += [(x.start(), x.end(), ".") for x in _DOT_ONE.finditer(tape.text, c, d)]
        taken = d
    for m in _IP_DOTS.finditer(tape.text):
        if m.start() >= taken and _DISGUISED.search(m[0]):
            edits += [(x.start(), x.end(), ".") for x in _DOT_ONE.finditer(tape.text, m.start(), m.end())]
    return tape.rewrite(sorted(edits))


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), each by kind and then start."""
    base = base_spans(text)
    tape = Tape(text)
    if _ODD.search(text):
        tape = homoglyphs(tape)
    tapes = [tape]
    if _SPELLED.search(tape.text):
        sure, more = spelled_digits(tape), spelled_digits(tape, 1)
        tapes = [sure, more] if more.text != sure.text else [sure]
    out = list(base)
    for tape in tapes:
        if _PLUS.search(tape.text):
            tape = plus_sign(tape)
        if _DISGUISED.search(tape.text) or _AT_HOST.search(tape.text):
            tape = at_dot(tape)
        if tape.text == text:
            continue
        starts, ends, new = [], [], []  # what the spans so far cover
        for a, b in sorted((a, b) for _, a, b in out):
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        for kind, a, b in base_spans(tape.text):
            if kind == "email" and not _TLD.search(tape.text[a:b]):
                continue
            a, b = tape.start[a], tape.end[b - 1]
            at = bisect_left(starts, b) - 1
            if at < 0 or ends[at] <= a:
                new.append((kind, a, b))
        out += new
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    return sorted(base, key=order), sorted(out, key=order)


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain patterns), base_sha256, spans, n_added, all_email, all_ip, all_card, all_phone
    (disguised ones included) of every row of docs."""
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *(f"all_{k}" for k in KINDS)]
    types = [pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in names]

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                base, every = all_spans(t or "")
                plain, found = [k for k, _, _ in base], [k for k, _, _ in every]
                rows.append((*map(plain.count, KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(every) - len(base), *map(found.count, KINDS)))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    kinds = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types))
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}")


def redacted(text: str) -> str:
    """The text with each span, the longest first where they overlap, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced; null stays null, all other columns pass."""

    def run(batches):
        for batch in batches:
            new = [None if t is None else redacted(t) for t in batch.column(text_col).to_pylist()]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return arrow_map(docs, run, docs.schema)
