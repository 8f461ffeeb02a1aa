"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults (a lexicon learned from labelled rows), threats, targets, addresses (imperatives, verbs of the second
person, words of name-calling), negations and reporting verbs. Small transducers for negation, reported speech, target and address add
what they saw to insult and threat symbols; those that look back are composed into one machine that reads a clause from left to right,
those that look ahead into one that reads the result from right to left. A clause with an insult or a threat is a match, with one reading
for each of the two: at a target (or addressed) or not, negated or not, reported or not. Scores come from matched clauses alone: a
document's clauses are counted by reading, and the weights of the readings come from a logistic fit on these counts, held near prior weights
and in their order: a negated or reported clause never weighs more than the same one plain, and a clause with nothing but an insult
in it weighs MARGIN less than one at a target at least, whatever the labelled rows say.

Labels are read from rows whose crc32(doc_id) mod 3 isn't 1, at most `sample` of them (the least hashes of doc_id); all of a text is
scored. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have no match and get the score of the bias; a null doc_id is scored but never learned from,
its held_out is null; without labelled rows of both kinds the lexicon is empty and the prior weights hold; each row is scored alone, so
ties and repeated rows change nothing; extra columns are left out by score() and kept by drop_toxic().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import LOWER, SENTINEL, WORD, arrow_map, chunks, hash_pieces, mix, runs

SAMPLE = 20_000
#: What a word must show in the labelled sample to be an insult: families of toxic texts that hold it, and log-odds.
MIN_FAMILIES, MIN_LOG_ODDS = 6, 3.0
#: Bytes of the stems that stand for a word's inflections, and the log-odds that a stem must show.
STEMS, STEM_LOG_ODDS = (4, 5), 5.0
#: Words in a row by which copies are told.
SHINGLE = 5
CUT = 0.7

#: symbols' words in English, German, French and Spanish. Words that are also articles or pronouns of things are left out.
THREATS = (
    "kill murder hurt destroy stab shoot strangle punish beat slap punch burn hang choke crush rape execute slaughter behead drown poison lynch torture maim smash whip bury gut "
    "töten töte umbringen vernichten vernichte verletzen verletze erschießen erschieße erstechen ersteche schlagen schlage erwürgen erwürge verprügeln verprügle verbrennen ertränken vergiften foltern zusammenschlagen aufhängen abstechen abknallen totschlagen "
    "tuer tuerai tuerons frapper frapperai détruire détruirai étrangler étranglerai poignarder poignarderai brûler brûlerai égorger égorgerai massacrer massacrerai noyer empoisonner torturer pendre crever buter buterai casserai "
    "matar mataré mataremos golpear golpearé destruir destruiré estrangular estrangularé apuñalar apuñalaré quemar quemaré degollar degollaré ahogar envenenar torturar ahorcar reventar reventaré aplastar romperé"
)
TARGETS = (
    "you your yours yourself yourselves u ur he him his she her they them their theirs "
    "du dich dir dein deine deinen ihr euch euer eure er ihm ihn ihnen tu toi te ton tes vous votre vos lui leur elle elles ils "
    "usted ustedes tú ti tus vosotros vuestro ellos ellas"
)
ADDRESSES = (
    "shut shush scram begone hey oi such what bloody fucking damn total utter complete "
    "halt verpiss verschwinde zisch bist seid solch solche verdammter verdammte blöder blöde elender elende dreckiger dreckige "
    "ferme dégage dégagez casse tais taisez êtes espèce quel quelle sale sales pauvre "
    "cállate cállense lárgate lárguense vete váyanse piérdete eres sois qué pedazo maldito maldita sucio sucia"
)
NEGATIONS = "not never no nor nobody neither none without cannot isn aren wasn won don didn doesn wouldn shouldn couldn hardly scarcely nicht kein keine keinen keiner niemals nie niemand weder kaum keinesfalls ohne ne pas jamais aucun aucune personne sans guère nullement jamás nunca ningún ninguna nadie ni sin tampoco apenas"
REPORTS = (
    "said says saying say told tells wrote writes quoted quotes quote claimed claims called calls reported reports alleged allegedly according shouted yelled screamed replied stated argued asked texted posted tweeted testified "
    "sagte sagt sagten schrieb schreibt zitiert behauptete nannte meinte rief erklärte antwortete fragte berichtete laut dit disait écrit écrivait cité affirme appelé répondit déclara déclaré cria demanda raconte selon "
    "dijo dice dicen escribió escribe citó afirmó llamó respondió declaró gritó preguntó contó según"
)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, ADDRESS = range(7)
#: Words between a mark and what it bears on.
NEGATION_REACH, TARGET_REACH, REPORT_AFTER, ADDRESS_REACH = 4, 5, 3, 2
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?;\n"]] = True
_END[SENTINEL] = True


class Transducer:
    """Transitions (state, symbol) -> (state, symbol out); what isn't listed keeps the symbol and goes to `rest(state)`."""

    def __init__(self, start, arcs: dict, rest):
        self.start, self.arcs, self.rest = start, arcs, rest

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.rest(state), symbol)

    def run(self, symbols: list) -> list:
        state, out = self.start, []
        for symbol in symbols:
            state, symbol = self.step(state, symbol)
            out.append(symbol)
        return out


def compose(*parts: Transducer) -> Transducer:
    """One machine that feeds each part's output to the next; its states are built as they are met."""
    arcs: dict = {}

    def step(state, symbol):
        if (state, symbol) not in arcs:
            out, states = symbol, []
            for part, s in zip(parts, state):
                s, out = part.step(s, out)
                states.append(s)
            arcs[state, symbol] = (tuple(states), out)
        return arcs[state, symbol]

    machine = Transducer(tuple(p.start for p in parts), {}, None)
    machine.step = step
    return machine


FEATURES = ("", "n", "r", "t", "nr", "nt", "rt", "nrt")


def _with(features: str, one: str) -> str:
    return "".join(sorted({*features, one}))


def _near(mark: int, feature: str, reach: int) -> Transducer:
    """Adds a feature to insults and threats with fewer than `reach` words between them and a mark read before."""
    arcs = {}
    for s in range(reach + 1):
        arcs[s, (mark, "")] = (reach, (mark, ""))
        if s:
            for kind in (INSULT, THREAT):
                for had in FEATURES:
                    arcs[s, (kind, had)] = (s - 1, (kind, _with(had, feature)))
    return Transducer(0, arcs, lambda s: max(0, s - 1))


def _after(mark: int, feature: str) -> Transducer:
    """Adds a feature to all insults and threats of the clause after a mark."""
    arcs = {(s, (mark, "")): (1, (mark, "")) for s in (0, 1)}
    for kind in (INSULT, THREAT):
        for had in FEATURES:
            arcs[1, (kind, had)] = (1, (kind, _with(had, feature)))
    return Transducer(0, arcs, lambda s: s)


#: Read from left to right, then from right to left: "not kill", "said ... kill", "you ... idiot", "such an idiot"; "kill you", "idiot, shut up", "idiot, he said".
LOOK_BACK = compose(_near(NEGATION, "n", NEGATION_REACH), _after(REPORT, "r"), _near(TARGET, "t", TARGET_REACH), _near(ADDRESS, "t", ADDRESS_REACH))
LOOK_AHEAD = compose(_near(TARGET, "t", TARGET_REACH), _near(ADDRESS, "t", ADDRESS_REACH), _near(REPORT, "r", REPORT_AFTER))


def readings(kinds: list[int]) -> list[tuple[int, str]]:
    """(kind, features) of each word of a clause."""
    forth = LOOK_BACK.run([(k, "") for k in kinds])
    return LOOK_AHEAD.run(forth[::-1])[::-1]


#: Prior weight of a clause of each reading.
READINGS = {
    (INSULT, "t"): 3.0, (INSULT, ""): 1.0, (INSULT, "nt"): 0.3, (INSULT, "rt"): 0.6, (INSULT, "n"): 0.1, (INSULT, "r"): 0.3, (INSULT, "nr"): 0.1, (INSULT, "nrt"): 0.1,
    (THREAT, "t"): 3.0, (THREAT, ""): 0.2, (THREAT, "nt"): 0.4, (THREAT, "rt"): 0.6, (THREAT, "n"): 0.0, (THREAT, "r"): 0.1, (THREAT, "nr"): 0.0, (THREAT, "nrt"): 0.1,
}
#: Readings of a kind from the weakest to the strongest, and how much more the strongest weighs than the next at least.
CHAINS = {INSULT: ("nr", "n", "nrt", "r", "nt", "rt", "", "t"), THREAT: ("nr", "n", "r", "nrt", "", "nt", "rt", "t")}
MARGIN = 0.5
_COLUMN = {r: i for i, r in enumerate(READINGS)}
BIAS = -3.0


def clause_matches(kinds: list[int], strengths: list[float]) -> dict[tuple[int, str], float]:
    """The readings of a clause with their strengths: of its insults and of its threats the reading of the most prior weight, once each.
    Its strength adds up the words that are as much negated and reported."""
    best: dict[int, tuple[int, str]] = {}
    found = readings(kinds)
    for r in found:
        if r in READINGS and (r[0] not in best or READINGS[r] > READINGS[best[r[0]]]):
            best[r[0]] = r
    return {r: sum(s for x, s in zip(found, strengths) if x[0] == r[0] and x[1].replace("t", "") == r[1].replace("t", "")) for r in best.values()}


def _word_hash(words: str) -> np.ndarray:
    raw = [w.encode() for w in words.split()]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    return hash_pieces(buf, ends - [len(w) for w in raw], ends)


def _words(buf: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(word starts, hashes of words, then of their stems; 0 where a word is no longer than the stem)."""
    low = LOWER[buf]
    starts, ends = runs(WORD[low])
    out = [hash_pieces(low, starts, ends)]
    for n in STEMS:
        h = mix(hash_pieces(low, starts, np.minimum(ends, starts + n)) + np.uint64(n))
        out.append(np.where(ends - starts > n, h, np.uint64(0)))
    return starts, out


def _family(words: np.ndarray) -> int:
    """The least hash of SHINGLE words in a row, of a text's word hashes."""
    n = min(SHINGLE, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return int(h.min().view(np.int64))


def split_of(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of the bounded sample: a row for each id, with the least of its texts and labels."""
    ids = labels.where("doc_id is not null and toxic in (0, 1)").where(split_of("doc_id") != 1).select("doc_id", "toxic")
    ids = ids.orderBy(F.xxhash64("doc_id"), "toxic").limit(sample).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def learn_lexicon(rows: DataFrame) -> dict[int, float]:
    """Hash -> log-odds of the words and stems that mark toxic rows: all that pass the thresholds, so at most the sample's vocabulary.
    Words and totals count families, so that many copies of one text weigh as one. A family is the texts with the same least hash of SHINGLE words
    in a row (of all words in shorter texts)."""

    def run(batches):
        for batch in batches:
            toxic, cols = batch.column("toxic").to_pylist(), ([], [], [], [])
            for first, _, buf in chunks(batch.column("text").to_pylist()):
                starts, hashes = _words(buf)
                edge = np.concatenate(([0], np.searchsorted(starts, np.flatnonzero(buf == SENTINEL))))
                for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                    if a == b:
                        continue
                    part = [np.unique(h[a:b]) for h in hashes]
                    found = np.concatenate([np.zeros(1, np.uint64), *(h[h != 0] for h in part)])  # 0 stands for no word: its counts are the totals
                    stem = np.repeat([0, 0, *[1] * len(STEMS)], [1, *(np.count_nonzero(h) for h in part)])
                    family = _family(hashes[0][a:b])
                    for c, v in zip(cols, (found.view(np.int64), stem, np.full(len(found), family), np.full(len(found), toxic[first + k]))):
                        c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["feature", "stem", "family", "toxic"])

    found = arrow_map(rows, run, "feature long, stem long, family long, toxic long").distinct()
    counts = found.groupBy("feature", "stem").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).persist()
    try:
        total = counts.where("feature = 0").first()
        if not total or not total["pos"] or not total["neg"]:
            return {}
        odds = F.log((F.col("pos") + 0.5) / (total["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (total["neg"] + 1))
        top = counts.where((F.col("feature") != 0) & (F.col("pos") >= MIN_FAMILIES)).withColumn("odds", odds).where(F.col("odds") >= F.when(F.col("stem") == 1, STEM_LOG_ODDS).otherwise(MIN_LOG_ODDS))
        return {r["feature"]: r["odds"] for r in top.select("feature", "odds").collect()}
    finally:
        counts.unpersist()


class Reader:
    """Texts to sums of readings, with a lexicon."""

    def __init__(self, lexicon: dict[int, float]):
        keys = np.array(list(lexicon), np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], np.array(list(lexicon.values()), np.float64)[order]
        marks = {}
        for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (ADDRESS, ADDRESSES)):
            for h in _word_hash(words).tolist():
                marks[h] = kind
        self.mark_keys = np.array(sorted(marks), np.uint64)
        self.mark_kinds = np.array([marks[k] for k in sorted(marks)], np.uint8)

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """For each text, the sums of its matched clauses by reading: an insult has the strength of its log-odds over 6, at most 1; a
        threat has 1."""
        out = np.zeros((len(texts), len(READINGS)))
        for first, _, buf in chunks(texts):
            starts, hashes = _words(buf)
            if not len(starts):
                continue
            weight = np.zeros(len(starts))
            for h in hashes if len(self.keys) else ():
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                np.maximum(weight, np.where(self.keys[at] == h, self.weights[at], 0), out=weight)
            at = np.minimum(np.searchsorted(self.mark_keys, hashes[0]), len(self.mark_keys) - 1)
            kind = np.where(self.mark_keys[at] == hashes[0], self.mark_kinds[at], OTHER)
            kind[(weight > 0) & (kind == OTHER)] = INSULT
            hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
            if not len(hits):
                continue
            strength = np.where(kind == THREAT, 1.0, np.minimum(1.0, weight / 6))
            clause = np.searchsorted(np.flatnonzero(_END[buf]), starts)
            doc = np.searchsorted(np.flatnonzero(buf == SENTINEL), starts)
            for c in np.unique(clause[hits]).tolist():
                a, b = np.searchsorted(clause, (c, c + 1))
                row = out[first + int(doc[a])]
                for reading, x in clause_matches(kind[a:b].tolist(), strength[a:b].tolist()).items():
                    row[_COLUMN[reading]] += x
        return out


def _inputs(sums: np.ndarray) -> np.ndarray:
    return np.log1p(sums) / math.log(2)


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """(matrix from the bias and steps along the chains to the bias and weights, the least value of each step)."""
    m, least, at = np.zeros((1 + len(READINGS),) * 2), np.zeros(1 + len(READINGS)), 1
    m[0, 0], least[0] = 1.0, -np.inf
    for kind, chain in CHAINS.items():
        for k in range(len(chain)):
            for features in chain[k:]:
                m[1 + _COLUMN[kind, features], at] = 1.0
            least[at] = MARGIN if k == len(chain) - 1 else 0.0
            at += 1
    return m, least


def _bounded_step(h: np.ndarray, g: np.ndarray, least: np.ndarray, sweeps: int = 300) -> np.ndarray:
    """The s >= least with the smallest g s + s h s / 2, by coordinates."""
    s = np.maximum(0.0, least)
    for _ in range(sweeps):
        before = s.copy()
        for i in range(len(s)):
            s[i] = max(least[i], s[i] - (g[i] + h[i] @ s) / h[i, i])
        if np.abs(s - before).max() < 1e-12:
            break
    return s


def fit_weights(sums: np.ndarray, toxic: np.ndarray, rounds: int = 100, hold: float = 3.0) -> np.ndarray:
    """Bias and weights by Newton steps on the logistic loss plus hold/2 times the squared distance from the prior, within the order of CHAINS."""
    prior, (m, least) = np.array([BIAS, *READINGS.values()]), _steps()
    x = np.column_stack((np.ones(len(sums)), _inputs(sums)))

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - z @ toxic + hold / 2 * ((w - prior) ** 2).sum()

    d = np.maximum(least, np.linalg.solve(m, prior))
    for _ in range(rounds):
        w = m @ d
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) + hold * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w))
        step = _bounded_step(m.T @ h @ m, m.T @ grad, least - d)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(m @ (d + size * step)) > now:
            size /= 2
        d = np.maximum(least, d + size * step)
        if np.abs(step).max() < 1e-9 or size <= 1e-6:
            break
    return m @ d


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray]:
    """(lexicon, weights), from the bounded sample: its sums of readings, one short row a text, come to the driver."""
    rows = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(rows)

    def run(batches):
        reader = Reader(lexicon)
        for batch in batches:
            s = reader.sums(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int64()), pa.array(list(s), pa.list_(pa.float64()))], ["toxic", "sums"])

    got = arrow_map(rows, run, "toxic long, sums array<double>").toArrow()
    if not got.num_rows:
        return lexicon, np.array([BIAS, *READINGS.values()])
    sums = got.column("sums").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    order = np.lexsort((*sums.T, got.column("toxic").to_numpy()))  # the same rows in any order give the same weights
    return lexicon, fit_weights(sums[order], got.column("toxic").to_numpy()[order].astype(float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    lexicon, weights = fit(docs, labels, sample)

    def run(batches):
        reader = Reader(lexicon)
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(weights[0] + _inputs(reader.sums(batch.column("text").to_pylist())) @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    out = arrow_map(docs.select("doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", (split_of("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """docs without the rows whose text scores cut or more; texts are judged where they lie, so nothing is shuffled."""
    lexicon, weights = fit(docs, labels, sample)

    def run(batches):
        reader = Reader(lexicon)
        for batch in batches:
            z = weights[0] + _inputs(reader.sums(batch.column("text").to_pylist())) @ weights[1:]
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < cut))

    return arrow_map(docs, run, docs.schema)
