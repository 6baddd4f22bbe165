"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon tags words as insult, threat, target, negation or report. Four letter-to-letter transducers rewrite the tags
of a clause and are composed into one table: negation weakens insults soon after it, reported speech weakens what
follows it in the clause, a target near an insult strengthens it, and a threat counts once its target follows. A clause
scores the weights of what comes out, so a word is judged by what stands around it.

The fixed word lists are short. Further insults, as words and as word beginnings, are learnt from a bounded sample of
labelled rows (``train_rows``) by their log odds less one standard error, at most ``lexicon_size`` of them. A logistic
curve over the strongest clause, the number of matched ones and what they add up to in a text of this length gives the
score; it is fitted on folds left out, and with it the least log odds that a learnt term needs. Scoring is one map over
the table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.arrow import mapped
from sondeo.llm.labelled import logistic, sample, sigmoid
from sondeo.llm.words import REMEMBERED, column, text_or_empty

TRAIN_ROWS = 12_000
LEXICON_SIZE = 5_000
# A learnt term stands in so many toxic documents; the least log odds are chosen among these.
LEAST_DOCUMENTS = 3
LEAST_ODDS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5)
PREFIXES = (4, 5, 6)
CUT = 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
# What the transducers write besides: an insult that is negated, reported or aimed at someone, and a threat that is aimed.
NEGATED, REPORTED, AIMED, AIMED_THREAT = range(6, 10)

#: Words by tag.
WORDS = {
    INSULT: "idiot idiots moron morons loser losers scum stupid pathetic worthless disgusting trash clown imbecile dumb".split(),
    THREAT: "kill hurt destroy beat burn shoot stab crush".split(),
    TARGET: "you your yours u he she they them him her".split(),
    NEGATION: "not never no nor without isn't aren't wasn't don't doesn't".split(),
    REPORT: "said says wrote writes called quoted reported claims claimed according".split(),
}
BASE_WEIGHT = 3.0
#: What each symbol that comes out weighs, as a multiple of the word's own weight.
OUTPUT = {INSULT: 1.0, AIMED: 1.5, NEGATED: 0.25, REPORTED: 0.4, AIMED_THREAT: 1.5}

REACH = 3  # words that negation and targets reach over

_STRIP = "\"'.,;:!?()[]{}*#$%&|<>-_"
_ENDS = frozenset(b".!?;:")


@dataclass
class Transducer:
    """Deterministic, letter to letter: ``arcs[state, symbol]`` is (next state, output); a missing arc copies and uses ``default``."""

    arcs: dict[tuple[int, int], tuple[int, int]]
    default: dict[int, int]  # next state on symbols without an arc
    symbols: int = 10

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        return self.arcs.get((state, symbol), (self.default.get(state, state), symbol))


def countdown(trigger: int, rewrite: dict[int, int]) -> Transducer:
    """After ``trigger``, rewrites symbols among the next REACH words."""
    arcs = {(s, trigger): (REACH, trigger) for s in range(REACH + 1)}
    arcs |= {(s, a): (s - 1, b) for s in range(1, REACH + 1) for a, b in rewrite.items()}
    return Transducer(arcs, {s: max(s - 1, 0) for s in range(REACH + 1)})


NEGATING = countdown(NEGATION, {INSULT: NEGATED, THREAT: OTHER})
REPORTING = Transducer({(0, REPORT): (1, REPORT), (1, INSULT): (1, REPORTED), (1, THREAT): (1, OTHER)}, {0: 0, 1: 1})
AIMING = countdown(TARGET, {INSULT: AIMED})
THREATENING = countdown(THREAT, {TARGET: AIMED_THREAT})


def composed(first: Transducer, second: Transducer) -> Transducer:
    """One transducer that does what ``second`` does with the output of ``first``."""
    numbers, arcs, queue = {(0, 0): 0}, {}, [(0, 0)]
    while queue:
        pair = queue.pop()
        for symbol in range(first.symbols):
            a, middle = first.step(pair[0], symbol)
            b, out = second.step(pair[1], middle)
            if (a, b) not in numbers:
                numbers[a, b] = len(numbers)
                queue.append((a, b))
            arcs[numbers[pair], symbol] = (numbers[a, b], out)
    return Transducer(arcs, {})


# threats are matched before targets are used up by insults
GRAMMAR = composed(composed(composed(NEGATING, REPORTING), THREATENING), AIMING)


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_STRIP)


class Tags(dict):
    """(tag, weight, ends a clause) of words, remembered while they repeat."""

    def __init__(self, learnt: dict[str, float]):
        self.fixed = {w: tag for tag, words in WORDS.items() for w in words}
        self.learnt = learnt

    def __missing__(self, word: bytes) -> tuple[int, float, bool]:
        text, ends = plain(word), word[-1] in _ENDS
        tag = self.fixed.get(text, OTHER)
        weight = BASE_WEIGHT if tag in (INSULT, THREAT) else 0.0
        if tag in (OTHER, INSULT):
            odds = max((self.learnt.get(t, 0.0) for t in terms(text)), default=0.0)
            if odds > weight:
                tag, weight = INSULT, odds
        value = self[word] = (tag, weight, ends)
        return value


def terms(text: str) -> list[str]:
    """A word and its beginnings, as they stand in the lexicon."""
    return [text, *(text[:n] + "*" for n in PREFIXES if len(text) > n)] if len(text) > 2 else []


def clauses(tags: Tags, data: bytes) -> list[tuple[float, int, int]]:
    """(score, first word, word after the last) of the clauses with a positive score."""
    if len(tags) > REMEMBERED:
        tags.clear()
    found = list(map(tags.__getitem__, data.split()))
    if not any(t[0] == INSULT or t[0] == THREAT for t in found):
        return []
    out, state, score, start, arcs = [], 0, 0.0, 0, GRAMMAR.arcs
    threat = 0.0
    for i, (tag, weight, ends) in enumerate(found):
        state, symbol = arcs[state, tag]
        if tag == THREAT:
            threat = weight
        if symbol in OUTPUT:
            score += OUTPUT[symbol] * (threat if symbol == AIMED_THREAT else weight)
        if ends or i == len(found) - 1:
            if score > 0:
                out.append((score, start, i + 1))
            state, score, start = 0, 0.0, i + 1
    return out


def summary(matched: list[tuple[float, int, int]], data: bytes) -> tuple[float, float, float]:
    """The strongest clause, the logarithm of the number of matched ones, and their sum for each hundred words or so."""
    total = sum(c[0] for c in matched)
    return max((c[0] for c in matched), default=0.0), float(np.log1p(len(matched))), 100 * total / (data.count(b" ") + 50)


@dataclass
class Model:
    learnt: dict[str, float]
    weights: np.ndarray  # of strongest clause, number of clauses, density, constant

    def score(self, matched: list[tuple[float, int, int]], data: bytes) -> float:
        return float(sigmoid(np.append(summary(matched, data), 1.0) @ self.weights))


def lexicon(rows: DataFrame, size: int) -> dict[str, float]:
    """Terms that toxic documents have far more often than others, with their log odds; ``rows``: label and t."""
    def make():
        counts = (Counter(), Counter())
        totals = [0, 0]

        def work(batch: pa.RecordBatch) -> dict:
            for label, data in zip(batch.column("label").to_pylist(), batch.column("t").to_pylist()):
                totals[label] += 1
                counts[label].update({t for w in set(data.split()) for t in terms(plain(w))})
            return {"term": [], "toxic": [], "clean": []}

        def last() -> dict:
            names = list(counts[0].keys() | counts[1].keys())
            return {"term": ["", *names], "toxic": [totals[1], *(counts[1][t] for t in names)], "clean": [totals[0], *(counts[0][t] for t in names)]}

        work.last = last
        return work

    sums = mapped(rows.select("label", "t"), make, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # the count of documents is the row of the empty term
    best = sums.filter((F.col("toxic") >= LEAST_DOCUMENTS) | (F.col("term") == "")).orderBy(F.desc(F.col("term") == ""), F.desc(F.col("toxic") / (F.col("clean") + 0.5)), "term").limit(size + 1).collect()
    if not best or best[0]["term"]:
        return {}
    toxic, clean = best[0]["toxic"], best[0]["clean"]
    odds = {}
    for r in best[1:]:
        a, b = r["toxic"] + 0.5, r["clean"] + 0.5
        odds[r["term"]] = float(np.log(a / (toxic + 1) / (b / (clean + 1))) - np.sqrt(1 / a + 1 / b))
    return {t: v for t, v in odds.items() if v >= LEAST_ODDS[0]}


def fit(docs: DataFrame, labels: DataFrame, label: str, excluded, train_rows: int = TRAIN_ROWS, lexicon_size: int = LEXICON_SIZE, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """A model of ``label`` from at most ``train_rows`` labelled documents; ``excluded`` takes an id column and marks rows never learnt from."""
    rows = sample(docs, labels, label, train_rows, excluded, id_column, text_column)
    learnt = lexicon(rows.filter("fold >= 3"), lexicon_size)

    def above(least: float) -> dict[str, float]:
        return {t: v for t, v in learnt.items() if v >= least}

    def make():
        each = [Tags(above(least)) for least in LEAST_ODDS]

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column("t").to_pylist()
            return {"label": batch.column("label"), "seen": [[v for tags in each for v in summary(clauses(tags, x), x)] for x in texts]}

        return work

    seen = sorted((r["label"], r["seen"]) for r in mapped(rows.filter("fold < 3"), make, "label int, seen array<double>").collect())
    y = np.array([label for label, _ in seen], int)
    if len(set(y.tolist())) < 2:  # nothing to fit: a base word in a clause of its own is just toxic
        return Model(above(LEAST_ODDS[-1]), np.array([1.0, 0.0, 0.0, -0.6 * BASE_WEIGHT]))
    fits = []
    for k, least in enumerate(LEAST_ODDS):
        x = np.array([values[3 * k : 3 * k + 3] for _, values in seen])
        weights = logistic(x, y, ridge=0.01)
        weights[:3] = np.maximum(weights[:3], 0.0)
        p = np.clip(sigmoid(np.column_stack([x, np.ones(len(x))]) @ weights), 1e-6, 1 - 1e-6)
        fits.append((-float(np.where(y == 1, np.log(p), np.log(1 - p)).mean()), least, weights))
    _, least, weights = min(fits, key=lambda f: f[:2])
    return Model(above(least), weights)


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (1 from ``cut`` on), matched clauses with score and span of words.

    Empty and null texts match nothing and get the score of that.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``lexicon_size`` terms

    def make():
        known = shared.value
        tags = Tags(known.learnt)

        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column("t").to_pylist()
            found = [clauses(tags, x) for x in texts]
            scores = [known.score(m, x) for m, x in zip(found, texts)]
            spans = [[{"score": s, "start": a, "end": b} for s, a, b in m] for m in found]
            return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": [int(s >= cut) for s in scores], "clauses": spans}

        return work

    source = docs.select(column(docs, id_column).alias("doc_id"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))
    return mapped(source, make, f"doc_id {id_type}, score double, predicted int, clauses array<struct<score:double,start:long,end:long>>")
