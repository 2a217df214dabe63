"""Toxicity by multiple-instance learning: only documents carry labels, sentences are scored.

A document is toxic if at least one of its sentences is: its probability is the noisy-or of its sentences'. A
sentence's logit is a bias and the sum of its distinct words' weights, a word's weight the sum of hashed features (the
word, its beginnings, its letter groups). The noisy-or likelihood is maximised over document labels, so the weights learn
which sentences carry the label, and the same weights then locate offending sentences.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scored

#: Bound of the labelled documents of each class that are learnt from, and of the hashed feature space.
SAMPLE_ROWS, SPACE = 3000, 1 << 18
#: Bound of the bytes of these texts, for each class.
SAMPLE_BYTES = 32 << 20
#: Entries a worker's table (of words, of beginnings, of letter groups) holds before it is emptied.
TABLE_WORDS = 100_000
EPOCHS, RATE, SHRINK = 16, 0.5, 2e-5
#: Sentences end at these characters, as long as something follows.
BREAKS = re.compile(r"[.!?\n\r  。！？]+")
LETTERS = re.compile(r"[^\W\d_]+")


def word_features(piece: str) -> list[int]:
    """Hashed features of a piece without white space: each run of letters, its beginnings and its letter groups."""
    out: list[int] = []
    for w in LETTERS.findall(piece.lower()):
        names = {f"w:{w}"}
        names.update(f"b:{w[:n]}" for n in (3, 4, 5, 6) if len(w) > n)
        marked = f"<{w}>"
        names.update(f"g:{marked[i : i + 4]}" for i in range(len(marked) - 3))
        out += [xxhash.xxh32_intdigest(n) % SPACE for n in names]
    return out


def sentences(text: str) -> list[str]:
    """The text's sentences: parts between sentence ends or line ends that hold a word."""
    return [s for s in BREAKS.split(text) if s and not s.isspace()]


class NameWeights(dict):
    """Weight of the feature that ``kind`` and a key name; bounded."""

    def __init__(self, weights: list[float], kind: str):
        super().__init__()
        self.weights, self.kind = weights, kind

    def __missing__(self, key: str) -> float:
        if len(self) >= TABLE_WORDS:
            self.clear()
        value = self[key] = self.weights[xxhash.xxh32_intdigest(self.kind + key) % SPACE]
        return value


class WordWeights(dict):
    """Sum of the weights of ``word_features``, looked up by the piece of text; bounded.

    Most new words are made of known beginnings and letter groups, so these have tables of their own.
    """

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()
        self.begins, self.groups = NameWeights(self.weights, "b:"), NameWeights(self.weights, "g:")

    def __missing__(self, piece: str) -> float:
        if len(self) >= TABLE_WORDS:
            self.clear()
        value, low = 0.0, piece.lower()
        for w in (low,) if low.isalpha() else LETTERS.findall(low):
            marked = f"<{w}>"
            value += self.weights[xxhash.xxh32_intdigest("w:" + w) % SPACE]
            value += sum(map(self.begins.__getitem__, [w[:n] for n in (3, 4, 5, 6) if len(w) > n]))
            value += sum(map(self.groups.__getitem__, {marked[i : i + 4] for i in range(len(marked) - 3)}))
        self[piece] = value
        return value


def train(texts: list[str], labels: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of the documents' labels, by adaptive gradient steps."""
    cols, owner, counts = array("i"), array("i"), array("i")
    n_sentences = 0
    table: dict[str, array] = {}
    for d, text in enumerate(texts):
        for s in sentences(text):
            before = len(cols)
            for piece in set(s.split()):
                known = table.get(piece)
                if known is None:
                    known = table[piece] = array("i", word_features(piece))
                cols.extend(known)
            if len(cols) > before:
                counts.append(len(cols) - before)
                owner.append(d)
                n_sentences += 1
    weights, bias = np.zeros(SPACE), -4.0
    if not n_sentences:
        return weights, bias
    cols, owner, counts = (np.frombuffer(x, dtype=np.int32) for x in (cols, owner, counts))
    counts = counts.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    by_doc = np.searchsorted(owner, np.arange(len(texts) + 1))  # a document's sentences stand together
    squares, square_b = np.full(SPACE, 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    docs = np.flatnonzero(np.diff(by_doc) > 0)
    batch = 64
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(docs), max(1, len(docs) // batch)):
            sents = np.concatenate([np.arange(by_doc[d], by_doc[d + 1]) for d in part])
            bag = np.repeat(np.arange(len(part)), by_doc[part + 1] - by_doc[part])
            width = counts[sents]
            at = np.repeat(starts[sents] - np.cumsum(width) + width, width) + np.arange(width.sum())
            feats, seg = cols[at], np.repeat(np.arange(len(sents)), width)
            logit = bias + np.bincount(seg, weights[feats], minlength=len(sents))
            p = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))
            none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(part))
            whole = -np.expm1(none)
            # d log-likelihood / d logit: p (1 - P) / P for toxic documents, -p for others
            grad = np.where(labels[part][bag] == 1, p * np.exp(none[bag]) / np.maximum(whole[bag], 1e-9), -p)
            touched, inv = np.unique(feats, return_inverse=True)
            g = np.bincount(inv, grad[seg], minlength=len(touched)) / len(part) - SHRINK * weights[touched]
            squares[touched] += g * g
            weights[touched] += RATE * g / np.sqrt(squares[touched])
            gb = grad.sum() / len(part)
            square_b += gb * gb
            bias += RATE * gb / np.sqrt(square_b)
    return weights, float(bias)


def sentence_scores(text: str, table: WordWeights, bias: float) -> np.ndarray:
    logit = bias + np.array([sum(map(table.__getitem__, set(s.split()))) for s in sentences(text)] or [-30.0 - bias])
    return 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts and ``most_bytes`` of each class, in the order of a hash of the id: what the driver holds.

    ``labels`` may be as large as it likes; only the chosen ids are joined with the texts. Texts of more than a
    sixteenth of ``most_bytes`` aren't learnt from.
    """
    chosen = None
    for value in (0, 1):
        part = labels.filter(F.col(label_col) == value).select(F.col(id_col).alias("id"), F.lit(value).alias("y")).filter("id is not null").distinct()
        part = part.orderBy(F.xxhash64("id"), "id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter(F.octet_length("t") <= most_bytes // 16)
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    # A window over a class's sample, which ``rows`` bounds.
    so_far = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    out_t, out_l = [], []
    for r in found.withColumn("sum", so_far).filter(F.col("sum") <= most_bytes).select("id", "y", "t").orderBy("id", "y").toLocalIterator():
        out_t.append(r["t"])
        out_l.append(r["y"])
    return out_t, np.array(out_l, dtype=np.int64)


def toxicity_model(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of labelled documents; ``labels`` holds the rows that may be learnt from."""
    texts, y = labelled_sample(docs, labels, label_col, rows, id_col, text_col)
    return train(texts, y)


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """``id_col`` and ``score_col`` for every row: the noisy-or over all its sentences. With ``keep`` all other columns as well.

    Null and empty texts, and texts without a word, get the score of one sentence without words. Rows are scored on
    their own: repeated rows repeat. With ``keep``, a column that is already called ``score_col`` gives way; choose
    another name to have both. Needs no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def task():
        weights, bias = sent.value
        table = WordWeights(weights)
        one = lambda t: -float(np.expm1(np.log1p(-np.minimum(sentence_scores(t, table, bias), 1 - 1e-12)).sum()))
        return lambda texts: np.clip([one(t) for t in texts], 0.0, 1.0)

    return scored(docs, [c for c in docs.columns if c != score_col] if keep else [id_col], text_col, score_col, task)


def offending_sentences(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, position, sentence, probability`` of every sentence whose own probability reaches ``threshold``.

    Positions count a text's sentences from 0. Null, empty and blank texts have none; whole texts are read, however long;
    rows that repeat an id, or have none, give their sentences each for itself; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = sent.value
        table = WordWeights(weights)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["id"], pdf["text"].fillna(""), strict=True):
                parts = sentences(text)
                p = sentence_scores(text, table, bias)
                out += [(doc, k, s.strip(), float(x)) for k, (s, x) in enumerate(zip(parts, p, strict=False)) if x >= threshold]
            yield pd.DataFrame(out, columns=["id", "position", "sentence", "probability"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, position int, sentence string, probability double").withColumnRenamed("id", id_col)
