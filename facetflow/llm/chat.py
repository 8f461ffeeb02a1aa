"""Conversations as training text: a visitor over typed content parts, markers around turns, reversible escapes, a loss mask.

Each turn is formatted by itself, so that no conversation has to fit in memory: <|turn|>role<|text|>content<|end|>. A visitor
flattens the content's parts in order; image, audio and document parts become placeholders, numbered through the conversation, and
their references and the tokens that they expand to are recorded. Inside texts every control string gets a backslash after its first character, or
one more where backslashes stand there already; unescaping takes one away, so any text comes back as it was, and a text that looks
like a placeholder is never read as one.

Defined results: null text and null role are empty; an unknown part type raises ValueError; turns are ordered by turn (null
first), then role, then text (with U+FFFC for each attachment), then parts, and repeated rows stay; a null part type raises ValueError,
too; an empty table gives no conversations; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import arrow_map

#: Strings that mark turns here or in common templates. None ends as another begins.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_PLAIN = re.compile("|".join(f"({re.escape(c[0])}\\\\*){re.escape(c[1:])}" for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile("|".join(f"({re.escape(c[0])}\\\\*)\\\\{re.escape(c[1:])}" for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_PART = re.compile(r"<\|(image|audio|document):(\d+)\|>")
#: The same for Spark's readers: an escaped control, a placeholder, a turn.
_ESCAPED_COLUMN = r"(<\\*)\\(\||s>|/s>|<SYS>>|</SYS>>)|(\[\\*)\\(INST\]|/INST\])"
_PART_COLUMN = r"<\|(?:image|audio|document):\d+\|>"
_TURN_COLUMN = r"(?s)^<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>$"
ATTACHED = "\uFFFC"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: (a := m[m.lastindex]) + "\\" + m[0][len(a) :], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (a := m[m.lastindex]) + m[0][len(a) + 1 :], text)


class Flatten:
    """Visits a turn's parts in order. Expanded tokens: an image has one per 14-pixel patch, audio 50 a second, a document 800 a page; each rounds up."""

    def __init__(self, first: int = 0):
        self.out: list[str] = []
        self.texts: list[str] = []  # of neighbouring text parts, escaped as one
        self.refs: list[dict] = []
        self.next = first

    def visit(self, part: dict) -> None:
        visitor = getattr(self, f"visit_{part.get('type')}", None)
        if visitor is None:
            raise ValueError(f"unknown content part: {part.get('type')}")
        visitor(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def finish(self) -> str:
        """What has been visited so far, flat."""
        self.out.append(escape("".join(self.texts)))
        self.texts.clear()
        return "".join(self.out)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.finish()
        self.out.append(f"<|{kind}:{self.next}|>")
        self.refs.append({"index": self.next, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.next += 1

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / 14) * math.ceil((part.get("height") or 0) / 14))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * 50))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, math.ceil((part.get("pages") or 0) * 800))


def format_turn(role: str | None, parts: list[dict], first: int = 0) -> tuple[str, int, int, list[dict]]:
    """(formatted turn, loss start, loss end, attachments, numbered from first); the loss covers an assistant's content and nothing of the markers."""
    v = Flatten(first)
    for p in parts:
        v.visit(p)
    head, body = f"<|turn|>{escape(role or '')}<|text|>", v.finish()
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}<|end|>", *span, v.refs


def parse_content(content: str) -> list[dict]:
    """The parts of formatted content: texts as they were (neighbouring ones are one), attachments with their type and number."""
    parts, at = [], 0
    for m in _PART.finditer(content):
        if m.start() > at:
            parts.append({"type": "text", "text": unescape(content[at : m.start()])})
        parts.append({"type": m[1], "index": int(m[2])})
        at = m.end()
    if at < len(content):
        parts.append({"type": "text", "text": unescape(content[at:])})
    return parts


def text_of(parts: list[dict]) -> str:
    return "".join(p["text"] for p in parts if p["type"] == "text")


def parse_turn(formatted: str) -> tuple[str, list[dict]]:
    """(role, parts) as they were."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), parse_content(m[2])


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start, loss_end (code points in formatted), attachments of each row; content is taken from a
    column `parts` of type PARTS where there is one and it isn't null, else from `text`."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    if "parts" in conversations.columns:
        count = F.coalesce(F.size(F.filter("parts", lambda p: p["type"] != "text")), F.lit(0))
        flat = F.array_join(F.transform("parts", lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(ATTACHED))), "")
        before = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce(flat, F.col("text"), F.lit("")), "parts").rowsBetween(Window.unboundedPreceding, -1)
        rows = conversations.select(*cols, "parts").withColumn("count", F.when(F.col("parts").isNull(), 0).otherwise(count))
        rows = rows.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    else:
        rows = conversations.select(*cols)
    refs = pa.list_(pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches):
        for batch in batches:
            d = batch.to_pydict()
            n = batch.num_rows
            done = [format_turn(r, p if p is not None else [{"type": "text", "text": t}], k) for r, t, p, k in zip(d["role"], d["text"], d.get("parts") or [None] * n, d.get("first") or [0] * n)]
            f, a, b, x = zip(*done) if done else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(f, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(x, refs)], ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"])

    return arrow_map(rows, run, "conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments array<struct<index:int,type:string,ref:string,tokens:long>>")


def in_order(turns: DataFrame) -> DataFrame:
    """turns by conversation, each conversation's in order: by what their formatted texts stand for, as escapes and marks sort otherwise."""
    plain = lambda c: F.regexp_replace(c, _ESCAPED_COLUMN, "$1$3$2$4")
    keys = {"_role": plain(F.regexp_extract("formatted", _TURN_COLUMN, 1)), "_text": plain(F.regexp_replace(F.regexp_extract("formatted", _TURN_COLUMN, 2), _PART_COLUMN, ATTACHED)), "_first": F.get("attachments", F.lit(0))["index"]}
    return turns.repartition("conv_id").withColumns(keys).sortWithinPartitions("conv_id", "turn", *keys, "formatted").drop(*keys)


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments (placeholders read in the texts),
    attachment_tokens (what they expand to) of each conversation, from formatted turns. A turn's text is that of its text parts. One
    sort by conversation and turn; digests advance turn by turn, so a conversation of any length takes the memory of one turn."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        now, state, rows = None, None, []

        def close():
            if state:
                rows.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for conv, formatted, a, b, refs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachments"))):
                if now != (conv,):
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, parts = parse_turn(formatted)
                tokens = {r["index"]: r["tokens"] for r in refs or ()}
                state[0] += 1
                state[1].update(f"{role}\n{text_of(parts)}\n".encode())
                loss = text_of(parse_content(formatted[a:b]))
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
                found = [p["index"] for p in parts if p["type"] != "text"]
                state[5] += len(found)
                state[6] += sum(tokens[i] for i in found)
            if rows:
                yield emit()
                rows = []
        close()
        if rows:
            yield emit()

    ordered = in_order(turns.select("conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"))
    return arrow_map(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 23 + len(regexp_extract_all(role || chr(10) || text, '<\\*\||<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')))::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM c GROUP BY conv_id
"""
