"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes log-count ratios.

The n-grams are runs of one to three word shapes: letter case, length, digits, inner symbols, trailing marks, and
whether the word repeats the one before. Shapes carry over to sources and languages that no label names. An indicator
is scaled by the log ratio of its smoothed shares in good and bad documents, rows are scaled to unit length, and the
model is fitted by dual coordinate descent. A logistic curve turns margins into scores; it is fitted on margins that each
half of the sample gets from a model of the other half.

The model is fitted on a bounded sample of labelled rows (``train_rows``); scoring is one map over the table, and what
each task carries is one array of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sondeo.llm.arrow import mapped
from sondeo.llm.labelled import logistic, sample, sigmoid
from sondeo.llm.words import REMEMBERED, column, mixed, text_or_empty

TRAIN_ROWS = 12_000
FEATURES = 1 << 18
ORDERS = 3
CUT = 0.7

_CODE_BITS = 11


def shape(word: str) -> int:
    """A number below 1024 for how a word looks."""
    core = word.rstrip(".,;:!?'\")]}*#%&$|-_=+~")
    tail = word[len(core):]
    letters = [c for c in core if c.isalpha()]
    if not letters:
        case = 0
    elif all(c.islower() for c in letters):
        case = 1
    elif len(letters) > 1 and all(c.isupper() for c in letters):
        case = 2
    elif letters[0].isupper() and all(c.islower() for c in letters[1:]):
        case = 3
    else:
        case = 4
    marks = 0 if not tail else 1 if tail == "," else 2 if tail == "." else 3 if len(tail) == 1 else 4 if set(tail) <= set("!?") else 5
    length = sum(len(core) > n for n in (0, 2, 5, 9, 15))
    digits = any(c.isdigit() for c in core)
    symbols = any(not c.isalnum() and c not in "'-." for c in core)
    return (((case * 6 + marks) * 6 + length) * 2 + digits) * 2 + symbols


class Shapes(dict):
    """Shapes of words, remembered while they repeat."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = shape(word.decode("utf-8", "replace")) << 1
        return value

    def features(self, data: bytes) -> np.ndarray:
        """The distinct feature numbers of a text: its runs of one to three shapes, hashed to a table of fixed size."""
        if len(self) > REMEMBERED:
            self.clear()
        words = data.split()
        if not words:
            return np.empty(0, np.int64)
        codes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        codes[1:] |= np.fromiter(map(eq, words, words[1:]), np.uint64, len(words) - 1)
        runs, parts = codes, []
        for n in range(1, ORDERS + 1):
            parts.append(np.unique(runs) | np.uint64(n << 60))
            if len(codes) <= n:
                break
            runs = (runs[:-1] << np.uint64(_CODE_BITS)) | codes[n:]
        return np.unique(mixed(np.concatenate(parts)) & np.uint64(FEATURES - 1)).astype(np.int64)


@dataclass
class Model:
    """The score of a text is a logistic curve of its margin; without two classes to learn from, a constant."""

    ratios: np.ndarray  # log-count ratio of each feature
    weights: np.ndarray  # of scaled indicators; the last one is the constant's
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        scale = self.ratios[features]
        norm = np.sqrt(scale @ scale) or 1.0
        return float(scale @ self.weights[features] / norm + self.weights[-1])


def coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (and a constant, last) that minimise |w|²/2 + cost * sum of hinge losses, one dual variable at a time."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    squared = np.array([v @ v + 1.0 for _, v in rows])
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        moved = 0.0
        for i in order:
            at, v = rows[i]
            slack = y[i] * (w[at] @ v + w[-1]) - 1.0
            value = min(max(alpha[i] - slack / squared[i], 0.0), cost)
            step = (value - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                w[-1] += step
                moved += abs(step)
                alpha[i] = value
        if moved < 1e-3 * len(rows) ** 0.5:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str, excluded, train_rows: int = TRAIN_ROWS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """A model of ``label`` from at most ``train_rows`` labelled documents; ``excluded`` takes an id column and marks rows never learnt from."""
    def make():
        shapes = Shapes()
        return lambda batch: {"label": batch.column("label"), "fold": batch.column("fold"), "features": [shapes.features(x) for x in batch.column("t").to_pylist()]}

    rows = mapped(sample(docs, labels, label, train_rows, excluded, id_column, text_column), make, "label int, fold int, features array<int>").toArrow()
    y = np.where(np.array(rows.column("label").to_pylist(), int) == 1, 1.0, -1.0)
    folds = np.array(rows.column("fold").to_pylist(), int)
    found = [np.array(x, np.int64) for x in rows.column("features").to_pylist()]
    # what the sample is read in depends on the tasks; the order of its rows must not
    order = sorted(range(len(found)), key=lambda i: (folds[i], y[i], found[i].tobytes()))
    y, folds, found = y[order], folds[order], [found[i] for i in order]
    known = set(y[folds < 5]) & set(y[folds >= 5])
    if len(known) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        return Model(np.zeros(FEATURES), np.zeros(FEATURES + 1), 0.0, float(np.log((share + 0.01) / (1.01 - share))))

    def trained(learn: np.ndarray) -> Model:
        good, bad = np.ones(FEATURES), np.ones(FEATURES)
        for i in learn:
            (good if y[i] > 0 else bad)[found[i]] += 1
        ratios = np.log((good / good.sum()) / (bad / bad.sum()))
        rows = [(found[i], ratios[found[i]] / (np.sqrt(ratios[found[i]] @ ratios[found[i]]) or 1.0)) for i in learn]
        return Model(ratios, coordinate_descent(rows, y[learn], FEATURES), 1.0, 0.0)

    # margins of each half come from the model of the other
    margins = np.zeros(len(y))
    for half in (folds < 5, folds >= 5):
        model = trained(np.flatnonzero(~half))
        margins[half] = [model.margin(found[i]) for i in np.flatnonzero(half)]
    slope, offset = logistic(margins[:, None], (y > 0).astype(int))
    model = trained(np.arange(len(y)))
    return Model(model.ratios, model.weights, float(slope), float(offset))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", cut: float = CUT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (1 from ``cut`` on). Empty and null texts get the score of no features."""
    id_type = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus

    def make():
        shapes, known = Shapes(), shared.value

        def work(batch: pa.RecordBatch) -> dict:
            margins = np.array([known.margin(shapes.features(x)) for x in batch.column("t").to_pylist()])
            scores = sigmoid(known.slope * margins + known.offset)
            return {"doc_id": batch.column("doc_id"), "score": scores, "predicted": (scores >= cut).astype(np.int32)}

        return work

    source = docs.select(column(docs, id_column).alias("doc_id"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))
    return mapped(source, make, f"doc_id {id_type}, score double, predicted int")
