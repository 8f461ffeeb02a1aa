"""Weights keep the order of the readings, scores equal a plain reader's, and the sample stays bounded where ids repeat."""

import math
import random
import re

import numpy as np
import pytest

from facetflow.llm import toxicity
from facetflow.session import ship

INSULTS = ["moron", "scum"]
SETS = {k: set(w.split()) for k, w in ((toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS), (toxicity.ADDRESS, toxicity.ADDRESSES))}


def in_order(w):
    of = dict(zip(toxicity.READINGS, w[1:]))
    for kind, chain in toxicity.CHAINS.items():
        values = [of[kind, f] for f in chain]
        assert all(a <= b + 1e-9 for a, b in zip(values, values[1:])) and values[-1] >= values[-2] + toxicity.MARGIN - 1e-9
    return of


def test_weights_keep_their_order():
    """Rows whose bare insults are always toxic and whose targeted ones seldom are can't turn the order round."""
    rng = np.random.default_rng(1)
    sums = np.zeros((2000, len(toxicity.READINGS)))
    bare, aimed = toxicity._COLUMN[toxicity.INSULT, ""], toxicity._COLUMN[toxicity.INSULT, "t"]
    sums[:700, bare] = rng.integers(1, 4, 700)
    sums[700:900, aimed] = 1
    sums[900:1000, toxicity._COLUMN[toxicity.THREAT, "n"]] = 1
    toxic = np.zeros(2000)
    toxic[:700] = toxic[900:1000] = 1
    of = in_order(toxicity.fit_weights(sums, toxic))
    assert of[toxicity.INSULT, "t"] > of[toxicity.INSULT, ""] > 1
    prior = [toxicity.BIAS, *toxicity.READINGS.values()]
    assert np.abs(toxicity.fit_weights(np.zeros((0, 16)), np.zeros(0)) - prior).max() < 1e-6
    free = np.zeros((400, 16))  # where the order holds by itself the fit is the plain one
    free[:200, aimed] = 2
    w = toxicity.fit_weights(free, (np.arange(400) < 200).astype(float))
    x = np.column_stack((np.ones(400), toxicity._inputs(free)))
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - (np.arange(400) < 200)) + 3 * (w - prior)
    assert np.abs(gradient[[0, 1 + aimed]]).max() < 1e-5


def plain_sums(text, strengths):
    """Readings of a text by looking at each word's neighbourhood, clause by clause."""
    out = {}
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause)
        kind = [next((k for k, s in SETS.items() if w in s), toxicity.INSULT if w in strengths else toxicity.OTHER) for w in words]
        found = []
        for at, k in enumerate(kind):
            if k in (toxicity.INSULT, toxicity.THREAT):
                near = lambda mark, before, after, at=at, kind=kind: mark in kind[max(0, at - before) : at] or mark in kind[at + 1 : at + 1 + after]
                aimed = near(toxicity.TARGET, toxicity.TARGET_REACH, toxicity.TARGET_REACH) or near(toxicity.ADDRESS, toxicity.ADDRESS_REACH, toxicity.ADDRESS_REACH)
                f = "n" * near(toxicity.NEGATION, toxicity.NEGATION_REACH, 0) + "r" * near(toxicity.REPORT, len(words), toxicity.REPORT_AFTER) + "t" * aimed
                found.append((k, f, strengths.get(words[at], 1.0)))
        for kind_ in {k for k, _, _ in found}:
            best = max((x[:2] for x in found if x[0] == kind_), key=toxicity.READINGS.get)
            out[best] = out.get(best, 0) + sum(s for k, f, s in found if k == kind_ and f.replace("t", "") == best[1].replace("t", ""))
    return out


def labelled(spark):
    rng, rows = random.Random(7), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    pool = ["you", "not", "said", "kill", "shut", "such", "the", "fine", "."]
    for i in range(600):
        toxic = i % 4 == 0
        words = [word() for _ in range(12)] + rng.choices(pool, k=4)
        if toxic:
            words.insert(rng.randrange(len(words)), "moron")
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    ship(spark)
    return rows, spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")


def test_scores_equal_a_plain_reader(spark):
    rows, docs, labels = labelled(spark)
    lexicon, w = toxicity.fit(docs, labels)
    of = in_order(w)
    reader = toxicity.Reader(lexicon)
    strength = {x: min(1.0, max(lexicon.get(int(h[0].view(np.int64)), 0.0) for h in toxicity._words(np.frombuffer(x.encode() + b"\xff", np.uint8))[1]) / 6) for x in INSULTS}
    assert len(lexicon) and all(strength.values())
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for i, text, _ in rows:
        z = w[0] + sum(of[r] * math.log2(1 + s) for r, s in plain_sums(text, strength).items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), text
    rate = lambda t: float(toxicity._inputs(reader.sums([t]))[0] @ w[1:])
    assert rate("You moron") == rate("shut up moron") == rate("such a moron") > rate("the moron") > rate("John said the moron came") >= rate("the man is not the moron")
    assert rate("I will kill you") > rate("he said they will kill you") > rate("I will never kill you") > rate("to kill a process") and rate("a fine day") == 0


def test_sample_is_bounded_where_ids_repeat(spark):
    _, docs, labels = labelled(spark)
    many = docs.where("doc_id < 40").unionByName(spark.range(3000).selectExpr("2L AS doc_id", "concat('zz ', id) AS text")).unionByName(spark.createDataFrame([(4, None)], docs.schema))
    twice = labels.unionByName(labels.selectExpr("doc_id", "quality", "1 - toxic AS toxic"))
    got = toxicity.training_rows(many, twice, 10_000).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 40 and {r.toxic for r in got} == {0}
    first = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == min(t for t in (first[r.doc_id], "zz 0" if r.doc_id == 2 else None) if t) for r in got)
    assert toxicity.training_rows(many, labels, 7).count() <= 7
