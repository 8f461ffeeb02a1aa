"""License notices in texts, also misspelt ones: exact seeds by the pigeonhole principle, then bounded-error matching.

A text is read as its words (A-Z lower-cased) with one blank between them. A notice that may be matched with up to e edits is
split into e + 1 pieces: e edits leave one piece untouched, so an exact piece marks each place where the notice can stand; there
the regex library's bounded-error matching verifies it and gives the span. The three base phrases are matched word for word; those
of 20 characters and more are also searched with edits, and count there only where no exact or longer match with the same label does. What tells a license from its neighbours (mit, the version, nc)
has edits of its own: `released under the mpl license` is no misspelt mit.

Defined results: a null text is empty; an empty text has no words, no places and score 0; each row is judged alone, so ties and
repeated rows change nothing; extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import TO_WORDS, arrow_map

#: Phrases whose consecutive words count as places, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices that the fuzzy search looks for, with their labels.
NOTICES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license version 1 0": "boost",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "cc0 1 0 universal public domain dedication": "cc0",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: What tells a notice from those of other licenses (mpl, version 1, cc by sa), and the edits allowed in it.
NAMES = {
    "under the mit license": ("mit", 1),
    "released under the mit license": ("mit", 1),
    "apache license version 2": (" 2", 0),
    "licensed under the apache license version 2": (" 2", 0),
    "licensed under cc by nc 4 0": (" nc ", 0),
    "licensed under cc by sa 4 0": (" sa ", 0),
}


def edits_for(notice: str) -> int:
    """One edit for each ten characters, four at most; none in notices under 20."""
    return min(4, len(notice) // 10) if len(notice) >= 20 else 0


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of about equal length, with their offsets."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: dict[str, str] = NOTICES):
        import ahocorasick
        import regex

        self.notices = [(n, label, e := edits_for(n), regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n)}){{e<={e}}}(?![^ ])")) for n, label in notices.items()]
        self.names = {n: regex.compile(rf"(?:{regex.escape(name)}){{e<={e}}}{'(?![^ ])' * (not e and name[-1] != ' ')}") for n, (name, e) in NAMES.items()}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (n, _, e, _) in enumerate(self.notices):
            for at, piece in seeds(n, e):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def fuzzy(self, text: str, base: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of verified notices in a text of words and single blanks, leftmost first and each place once.
        Base phrases with edits are left out where they meet a span of base or of another notice with their label."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                n, _, e, _ = self.notices[k]
                a = max(0, end + 1 - size - at - e - 1)
                b = min(len(text), a + len(n) + 2 * e + 2)
                w = windows.setdefault(k, [])
                if w and a <= w[-1][1]:
                    w[-1][1] = max(w[-1][1], b)
                else:
                    w.append([a, b])
        out, short = set(), set()
        for k, spans in windows.items():
            n, label, _, pattern = self.notices[k]
            for a, b in spans:
                for m in pattern.finditer(text, a, b):
                    if n not in self.names or self.names[n].search(m[0]):
                        (short if n in BASE else out).add((m.start(), m.end(), label, sum(m.fuzzy_counts)))
        taken: dict[str, list[tuple[int, int]]] = {}
        for a, b, label, *_ in sorted([*base, *out] if short else ()):
            merged = taken.setdefault(label, [])
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        for a, b, label, e in short:
            at = bisect_left(taken.get(label, []), (b,)) - 1  # the last that starts before b
            if at < 0 or taken[label][at][1] <= a:
                out.add((a, b, label, e))
        return sorted(out)

    def scan(self, text: str | None) -> dict:
        words = (text or "").encode().translate(TO_WORDS).split()
        line = b" ".join(words).decode()
        padded = f" {line} "
        places, base, exact, held = [], set(), [], set()
        for phrase, label in BASE.items():
            seen, counted = 0, 0
            at = padded.find(f" {phrase} ")
            while at >= 0:
                counted += padded.count(" ", seen, at + 1)
                seen = at + 1
                places.append(counted - 1)
                base.add(label)
                exact.append((at, at + len(phrase), label))
                held.update(range(counted - 1, counted + phrase.count(" ")))
                at = padded.find(f" {phrase} ", at + 1)
        spans, fuzzy = [], self.fuzzy(line, exact)
        blanks = [i for i, c in enumerate(line) if c == " "] if fuzzy else []
        for a, b, label, e in fuzzy:
            spans.append({"start": bisect_left(blanks, a), "end": bisect_left(blanks, b) + 1, "label": label, "edits": e})
        labels = base | {x["label"] for x in spans}
        for x in spans:
            held.update(range(x["start"], x["end"]))
        best = max([1.0 if base else 0.0, *(1 - e / max(1, b - a) for a, b, _, e in fuzzy)])
        score = best * (0.5 + 0.5 * len(held) / max(1, len(words))) if labels else 0.0
        return {"n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": spans}


_scanner: list[Scanner] = []


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (first and last word, label, edits of fuzzy places) of every row."""
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))}

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())
        for batch in batches:
            found = [_scanner[0].scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[k] for f in found], t) for k, t in kinds.items())], ["doc_id", *kinds])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,edits:int>>")
