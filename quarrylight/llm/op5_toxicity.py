"""Toxicity: a composition of weighted finite-state transducers over clauses.

A clause is what stands between sentence marks and line ends. The transducers rewrite its words, each reading what the one
before has written:
  lexicon   words to symbols: INSULT with its learned weight, THREAT, TARGET, NEGATION, REPORT or PASS;
  ahead     from the clause's end: an insult that a target follows within NEAR symbols becomes AIMED, a threat that one
            follows becomes a HIT, any other threat a PASS;
  target    from its start, as the others: an insult within NEAR symbols after a target becomes AIMED;
  negation  what is weighted within NEAR symbols after a negation gets the negation arc;
  report    what is weighted after a verb of speech gets the report arc;
  weigh     AIMED gets the aim arc, an insult without a target the bare arc, a HIT weighs as much as the threat arc.
A symbol's weight is that of the lexicon times its arcs, a clause's the sum over its path. A document's score is a logistic
function of the sum of its clauses' weights and of the heaviest (as it is, and levelling off; neither below 0); no word counts but through its
clause. Arcs are free: each may raise, lower, cancel or turn what it weighs (VALUES), and is 1, which is no effect, unless another value makes
the labels of the second part likelier by GAIN. What insults without a target weigh is thus told by the labels too.
The composed machine is built state by state as clauses need it; only clauses with an insult or a threat are run.

Insults are words and beginnings of words that stand in toxic documents far more often than in others (G-test over the
labelled sample); beginnings because one stem has many endings. They are found by an Aho-Corasick automaton over the
lower-cased text, at starts of words. Threats, targets, negations and verbs of reported speech are short fixed lists.

Training rows: at most SAMPLE labelled documents of each class outside the held-out fold, chosen by a hash of their id,
each whole. Two thirds of them, by a hash of the text, choose the insults; only those that the others confirm stay, and arcs
and the logistic function are fitted on the others.

Defined cases: null and empty texts have no clause and the score of a text without a match; rows with a null id are scored
and not held out; labels, lang, source and ids are no inputs; texts of any length are read whole, one at a time; repeated rows score alike; without a label of either class
every score is the share of label 1 (0 without any); of several labels or texts of an id the least counts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, prod
from zlib import crc32

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed_texts, read_table, small_batches
from .op2_quality import CUT, held_out, labelled_sample

FOLDS, FOLD, SAMPLE, NEAR = 3, 1, 4000, 4
STEM_LEAST, STEM_MOST, G_LEAST, G_AGAIN, RATIO_LEAST = 3, 8, 12.0, 3.84, 8.0  # 3.84: one in twenty by chance
PASS, INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED, HIT = range(8)
_WEIGHTED = (INSULT, AIMED, HIT)

# Words of the closed lists, in English, French, German and Spanish.
LISTS = {
    THREAT: "kill hurt destroy beat stab shoot punish burn tuer frapper töten schlagen matar golpear",
    TARGET: "you your yours u he him she her they them people tu vous toi du dich ihr euch tú usted ustedes vosotros",
    NEGATION: "not no never neither nor isn't aren't wasn't don't ne pas jamais nicht kein keine nie nunca jamás",
    REPORT: "said says say wrote writes claimed claims called calls quoted according dit dire sagt sagte schrieb dijo dice escribió",
}
_CLOSED = {w: k for k, v in LISTS.items() for w in v.split()}
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


#: What arcs may be, and the log likelihood that a value must gain for its arc to leave 1.
ARCS, VALUES, GAIN = ("aim", "bare", "negation", "report", "threat"), (-1.0, -0.5, 0.0, 0.1, 0.25, 0.5, 0.75, 1.5, 2.0, 4.0), 2.0
#: What arcs are in a grammar that was not fitted; fitting begins at 1.
UNFITTED = {"aim": 1.5, "bare": 1.0, "negation": 0.4, "report": 0.5, "threat": 2.0}


def _near(opens: int, becomes: dict[int, int], otherwise: dict[int, int] | None = None):
    """Rewrites symbols up to NEAR symbols after `opens`, others by `otherwise`; the state counts down."""

    def step(state: int, s: int) -> tuple[int, int, tuple[str, ...]]:
        out = becomes.get(s, s) if state else (otherwise or {}).get(s, s)
        return NEAR if s == opens else max(state - 1, 0), out, ()

    return step


def _negation(state: int, s: int) -> tuple[int, int, tuple[str, ...]]:
    return NEAR if s == NEGATION else max(state - 1, 0), s, ("negation",) if state and s in _WEIGHTED else ()


def _report(state: int, s: int) -> tuple[int, int, tuple[str, ...]]:
    return max(state, int(s == REPORT)), s, ("report",) if state and s in _WEIGHTED else ()


def _weigh(state: int, s: int) -> tuple[int, int, tuple[str, ...]]:
    return 0, s, ("aim",) if s == AIMED else ("bare",) if s == INSULT else ("threat",) if s == HIT else ()


class Composed:
    """Transducers in series: step(state, symbol) gives the next state, the symbol for the next one, and arcs. States of the
    composition are made as they are met."""

    def __init__(self, *parts):
        self.parts, self.arcs = parts, {}

    def run(self, symbols: list[int]) -> list[tuple[int, tuple[str, ...]]]:
        """What comes out for each symbol, with the arcs on its way."""
        state, out = (0,) * len(self.parts), []
        for s in symbols:
            arc = self.arcs.get((state, s))
            if arc is None:
                states, now, labels = [], s, ()
                for part, q in zip(self.parts, state, strict=True):
                    q, now, own = part(q, now)
                    states.append(q)
                    labels += own
                arc = self.arcs[state, s] = tuple(states), now, labels
            state = arc[0]
            out.append(arc[1:])
        return out


def _machines() -> tuple[Composed, Composed]:
    """That which reads clauses from their end, and that which reads what it wrote from the start."""
    ahead = Composed(_near(TARGET, {INSULT: AIMED, THREAT: HIT}, {THREAT: PASS}))
    return ahead, Composed(_near(TARGET, {INSULT: AIMED}), _negation, _report, _weigh)


def _g(t: int, n: int, toxic: int, clean: int) -> float:
    total, share = t + n, toxic / (toxic + clean)
    return 2 * sum(x * log(x / (total * e)) for x, e in ((t, share), (n, 1 - share)) if x)


def confirmed(insults: dict[str, float], texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Those that stand in toxic texts of these more often than in others too, by the same ratio and a G of G_AGAIN."""
    seen = ({e: 0 for e in insults}, {e: 0 for e in insults})
    for text, label in zip(texts, y, strict=True):
        words = set(_WORD.findall(text.lower()))
        every = {f"{w[:k]}*" for w in words for k in range(STEM_LEAST, min(STEM_MOST, len(w)) + 1)} | words
        for e in every & insults.keys():
            seen[int(label)][e] += 1
    toxic, clean = int((y == 1).sum()), int((y == 0).sum())
    ratio = {e: (seen[1][e] + 0.5) / (toxic + 1) / ((seen[0][e] + 0.5) / (clean + 1)) for e in insults}
    return {e: w for e, w in insults.items() if ratio[e] >= RATIO_LEAST and _g(seen[1][e], seen[0][e], toxic, clean) >= G_AGAIN}


def learn_insults(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """Entries with their weight; one that ends in '*' is a beginning of words."""
    seen = (Counter(), Counter())
    for text, label in zip(texts, y, strict=True):
        words = set(_WORD.findall(text.lower()))
        seen[int(label)].update({f"{w[:k]}*" for w in words for k in range(STEM_LEAST, min(STEM_MOST, len(w)) + 1)} | {w for w in words if len(w) >= STEM_LEAST})
    toxic, clean = int((y == 1).sum()), int((y == 0).sum())
    out = {}
    for e, t in seen[1].items():
        n = seen[0][e]
        ratio = (t + 0.5) / (toxic + 1) / ((n + 0.5) / (clean + 1))
        if ratio >= RATIO_LEAST and _g(t, n, toxic, clean) >= G_LEAST:
            out[e] = log(ratio)
    # an entry gives way to a longer one that stands for nearly all of its toxic documents ...
    longest: dict[str, int] = {}
    for e in out:
        stem = e.rstrip("*")
        for k in range(STEM_LEAST, len(stem) + (not e.endswith("*"))):
            longest[stem[:k]] = max(longest.get(stem[:k], 0), seen[1][e])
    out = {e: w for e, w in out.items() if not e.endswith("*") or longest.get(e[:-1], 0) < 0.95 * seen[1][e]}
    # ... and of the others that begin alike the most general stands unless a longer one is cleaner
    keep = {}
    for e in sorted(out, key=len):
        stem = e.rstrip("*")
        above = [f"{stem[:k]}*" for k in range(STEM_LEAST, len(stem) + (not e.endswith("*"))) if f"{stem[:k]}*" in keep]
        if not above or out[e] > max(keep[a] for a in above) + 1.0:
            keep[e] = out[e]
    return keep


class Grammar:
    def __init__(self, insults: dict[str, float]):
        self.insults, self.weights, self.arcs = insults, np.zeros(4), dict(UNFITTED)
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _lexicon(self):
        if self._ready is None:
            found = ahocorasick.Automaton()
            for e, w in self.insults.items():
                stem = e.rstrip("*")
                old = found.get(stem, (stem, 0.0, 0.0))
                found.add_word(stem, (stem, w, old[2]) if e.endswith("*") else (stem, old[1], w))
            for w, k in _CLOSED.items():
                if k == THREAT and w not in self.insults:
                    found.add_word(w, (w, 0.0, -1.0))
            found.make_automaton()
            self._ready = found, _machines()
        return self._ready

    def matches(self, text: str) -> dict[int, float]:
        """Start of word: weight (0 for a threat), in the lower-cased text."""
        found, out = self._lexicon()[0], {}
        for end, (stem, begins, whole) in found.iter(text):
            start = end - len(stem) + 1
            if start and (text[start - 1].isalpha() or text[start - 1] == "'"):
                continue
            ends = end + 1 == len(text) or not text[end + 1].isalpha()
            w = max(begins, whole) if ends else begins
            if w > 0 or (whole < 0 and ends):
                out[start] = max(out.get(start, 0.0), w)
        return out

    def clauses(self, text: str) -> list[list[tuple[float, tuple[str, ...]]]]:
        """Of each clause with an insult or a threat the weighted symbols: their weight in the lexicon and their arcs."""
        text = text.lower()
        hits, out = self.matches(text), []
        (ahead, forward), starts = self._lexicon()[1], sorted(hits)
        i, end = 0, 0
        while i < len(starts):
            lo = starts[i]  # back to where the clause begins, not before the end of the last one
            while lo > end and text[lo - 1] not in ".!?;\n":
                lo -= 1
            m = _CLAUSE.search(text, starts[i])
            end = m.start() if m else len(text)
            words = list(_WORD.finditer(text, lo, end))
            weights = [hits.get(w.start(), 0.0) for w in words]
            symbols = [INSULT if x else _CLOSED.get(w.group(), PASS) for w, x in zip(words, weights, strict=True)]
            turned = [s for s, _ in ahead.run(symbols[::-1])][::-1]
            got = [(x if s != HIT else 1.0, arcs) for (s, arcs), x in zip(forward.run(turned), weights, strict=True) if s in _WEIGHTED]
            if got:
                out.append(got)
            i += 1
            while i < len(starts) and starts[i] < end:
                i += 1
        return out

    def weigh(self, clauses: list[list[tuple[float, tuple[str, ...]]]]) -> list[float]:
        """The weight of each clause: of its path through the composed transducers."""
        return [sum(w * prod(self.arcs[a] for a in arcs) for w, arcs in c) for c in clauses]

    def features(self, clauses: list) -> np.ndarray:
        own = self.weigh(clauses)
        most = max(own, default=0.0)
        most, total = max(most, 0.0), max(sum(own), 0.0)
        return np.array([np.log1p(total), most, 1 - np.exp(-most), 1.0])

    def fit(self, texts: list[str], y: np.ndarray, share: float) -> Grammar:
        """Arcs one after the other, each value by the likelihood of its best logistic function; twice, as they depend on each other."""
        read = [self.clauses(t) for t in texts]
        own = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))

        def logistic(arcs: dict[str, float]) -> tuple[float, np.ndarray]:
            self.arcs = arcs
            x = np.array([self.features(c) for c in read]).reshape(len(read), -1)
            w, ridge = np.zeros(x.shape[1]), np.array([0.3, 0.3, 0.3, 1e-6])
            for _ in range(30):  # Newton steps
                p = 1 / (1 + np.exp(-x @ w))
                h = (x.T * (own * p * (1 - p))) @ x + np.diag(ridge)
                w -= np.linalg.solve(h, x.T @ (own * (p - y)) + ridge * w)
            p = np.clip(1 / (1 + np.exp(-x @ w)), 1e-9, 1 - 1e-9)
            return float((own * -np.log(np.where(y == 1, p, 1 - p))).sum() + (ridge * w * w).sum() / 2), w

        met = {a for clauses in read for c in clauses for _, labels in c for a in labels}
        arcs = dict.fromkeys(ARCS, 1.0)
        best = logistic(arcs)
        for name in [a for a in ARCS if a in met] * 2:
            for value in VALUES:
                if value != arcs[name] and (got := logistic(arcs | {name: value}))[0] < best[0] - (GAIN if arcs[name] == 1.0 else 1e-9):
                    best, arcs = got, arcs | {name: value}
        self.arcs, self.weights = arcs, best[1]
        return self

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-(self.features(self.clauses(text)) @ self.weights))))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def score(self, text: str) -> float:
        return self.share


def train(texts: list[bytes], y: np.ndarray, share: float | None = None):
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.0)
    texts = [t.decode("utf-8", "replace") for t in texts]
    half = np.array([crc32(t.encode("utf-8", "replace")) % 3 < 2 for t in texts])
    if len(set(y[half].tolist())) < 2 or len(set(y[~half].tolist())) < 2:
        half[:] = True
    other = ~half if not half.all() else half
    again = [t for t, h in zip(texts, other, strict=True) if h]
    insults = confirmed(learn_insults([t for t, h in zip(texts, half, strict=True) if h], y[half]), again, y[other])
    return Grammar(insults).fit(again, y[other], y.mean() if share is None else share)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    docs = keyed_texts(docs, id_col, text_col)
    fit = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id", FOLDS, FOLD))
    share = fit.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    texts, y = labelled_sample(docs, labels, "toxic", FOLDS, FOLD, SAMPLE)
    model = spark.sparkContext.broadcast(train(texts, y, share))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            scores = [own.score(t.as_py() or "") for t in texts]
            yield pa.record_batch({"doc_id": b.column(b.schema.get_field_index("doc_id")), "score": pa.array(scores, pa.float64())})

    out = docs.mapInArrow(work, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
