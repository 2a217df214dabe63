"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text is the set of its n-grams: words, word pairs, and one- to three-grams of word shapes (which show shouting,
decoration, tables), with a mark where a word follows itself. An indicator is scaled by the log ratio of its smoothed
counts in the two classes, and a linear hinge-loss model over the scaled, length-normalised indicators is fitted by
dual coordinate descent. A logistic curve fitted on margins of documents left out of the fit turns margins into scores.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import scored
from .toxicity import labelled_sample

#: Bound of the labelled documents of each class that are learnt from, and of the hashed feature space.
SAMPLE_ROWS, SPACE = 3000, 1 << 18
TABLE_WORDS = 100_000
#: Hinge-loss cost, rounds of coordinate descent, smoothing of counts, share of the sample that only calibrates.
COST, ROUNDS, SMOOTHING, HELD = 1.0, 12, 1.0, 4
#: Odd multipliers that mix neighbouring hashes into one.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
UPPER, LOWER, DIGIT, RUNS = regex.compile(r"\p{Lu}"), regex.compile(r"[\p{L}--\p{Lu}]", regex.V1), regex.compile(r"\p{N}"), regex.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A word's letters as A or a and digits as 0, runs shortened to one; other characters as they are."""
    return RUNS.sub(r"\1", DIGIT.sub("0", LOWER.sub("a", UPPER.sub("A", word))))


class WordHashes(dict):
    """Hashes of a word's lower-case form and of its shape, packed as 16 bytes; bounded."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= TABLE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_digest(word.lower(), 1) + xxhash.xxh64_digest(shape(word), 2)
        return value


def indicators(text: str, table: WordHashes) -> np.ndarray:
    """Sorted distinct hashed n-grams of a whole text."""
    pieces = text.split()
    if not pieces:
        return np.zeros(0, dtype=np.int64)
    both = np.frombuffer(b"".join(map(table.__getitem__, pieces)), dtype=np.uint64).reshape(-1, 2)
    w, s = both[:, 0], both[:, 1]
    pairs, shapes = w[:-1] * MIX[0] + w[1:], s[:-1] * MIX[1] + s[1:]
    again = s[1:][w[1:] == w[:-1]] * MIX[2]
    triples = shapes[:-1] * MIX[0] + s[2:]
    grams = np.concatenate([w, pairs, s, shapes, triples, again])
    return np.unique((grams >> np.uint64(46)).astype(np.int64))


class Model(NamedTuple):
    """Score = 1 / (1 + exp(-(slope * margin + shift))), margin = bias + sum of weights of the indicators / their norm."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float


def _margins(rows: list[np.ndarray], weights: np.ndarray, squares: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[r].sum() / max(1e-9, np.sqrt(squares[r].sum())) if len(r) else 0.0 for r in rows]) + bias


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 10) -> Model:
    """Fit on indicator rows. With no rows of one class the other's score is given to everything."""
    y = np.where(labels == 1, 1.0, -1.0)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(SPACE), np.ones(SPACE), 0.0, 0.0, 0.0 if not len(labels) else float(4 * y[0]))
    order = np.random.default_rng(seed).permutation(len(rows))
    fit, held = order[len(order) // HELD :], order[: len(order) // HELD]
    if len(set(labels[fit].tolist())) < 2:
        fit = held = order
    count = {c: np.bincount(np.concatenate([rows[i] for i in fit if labels[i] == c] + [np.zeros(0, dtype=np.int64)]), minlength=SPACE) + SMOOTHING for c in (0, 1)}
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    squares = ratio * ratio
    w, bias = np.zeros(SPACE), 0.0
    alpha = np.zeros(len(rows))
    scale = np.array([1.0 / max(1e-9, np.sqrt(squares[r].sum())) for r in rows])
    share = {1.0: len(fit) / 2 / max(1, (y[fit] > 0).sum()), -1.0: len(fit) / 2 / max(1, (y[fit] < 0).sum())}
    rng = np.random.default_rng(seed + 1)
    for _ in range(ROUNDS):
        for i in rng.permutation(fit):
            x = ratio[rows[i]] * scale[i]
            grad = y[i] * (w[rows[i]] @ x + bias) - 1.0
            new = min(max(alpha[i] - grad / 2.0, 0.0), COST * share[y[i]])  # |x|^2 is 1, and 1 more for the bias
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * x
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    weights = w * ratio
    margin, goal = _margins([rows[i] for i in held], weights, squares, bias), (labels[held] == 1).astype(float)
    goal = np.where(goal == 1, (goal.sum() + 1) / (goal.sum() + 2), 1 / (len(goal) - goal.sum() + 2))  # Platt's targets
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g, h = p - goal, p * (1 - p) + 1e-9
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * margin).sum(), g.sum()]))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(weights, squares, float(bias), float(slope), float(shift))


def quality_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``rows`` labelled documents of each class; ``labels`` holds the rows that may be learnt from."""
    texts, y = labelled_sample(docs, labels, label_col, rows, id_col, text_col)
    table = WordHashes()
    return train([indicators(t, table) for t in texts], y)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """``id_col`` and ``score_col`` for every row, from the whole text. With ``keep`` all other columns as well.

    Null and empty texts have no indicators and get the score of the bare bias. Rows are scored on their own: repeated
    rows repeat. With ``keep``, a column that is already called ``score_col`` gives way; choose another name to have
    both. Needs no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.squares.astype(np.float32), *model[2:]))

    def task():
        m, table = sent.value, WordHashes()
        margin = lambda t: _margins([indicators(t, table)], m.weights, m.squares, m.bias)[0]
        return lambda texts: 1 / (1 + np.exp(-np.clip(m.slope * np.array([margin(t) for t in texts]) + m.shift, -30, 30)))

    return scored(docs, [c for c in docs.columns if c != score_col] if keep else [id_col], text_col, score_col, task)
