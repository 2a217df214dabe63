"""Language-model scoring with log-bilinear models trained by noise-contrastive estimation.

Tokens are white-space words and one end per text. The most frequent words are classes of their own, all others fall
into classes by their ending. Two log-bilinear models share the work: one predicts a token's class from the classes of
the two words before it, the other predicts, inside an ending class, which of its words it is (tens of thousands of
frequent words have vectors of their own, the rest of a class shares one) from the word before. The words that share
a vector follow their smoothed counts. Every factor is normalised exactly, by matrix products over all contexts.

Counts cover the whole training corpus and stay distributed, keyed by a 64-bit hash of the word; only a bounded number
of frequent words is sent to the tasks, the rest is joined.

Training: each task reduces its part of the corpus to counts of class triples and of (word before, word) pairs. Rounds of
noise-contrastive estimation run where those counts are, starting from common parameters, which are then averaged by
how much each task saw of them. The word model samples its noise from the counts of the word's class. The classes are
few enough to take the class model's noise expectation over all of them, which is what ever more samples tend to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import hashes_and_endings

#: Words with a class of their own (the end among them), classes of all other words, width of the classes' vectors.
HEAD, ENDINGS, WIDTH = 200, 56, 24
#: Most frequent words: those that are a context of their own, and those with a vector; width of the words' vectors.
CONTEXT_WORDS, VECTOR_WORDS, WORD_WIDTH = 2000, 32_768, 16
#: Frequent words sent to the tasks: the bound of what is broadcast.
TABLE_ROWS = 200_000
#: Distinct keys a task counts before it hands word counts on, and new ones it takes in before it adds them up.
COUNTED, FRESH = 2_000_000, 1_000_000
#: Class model: noise per data token, rounds of averaging, passes over the counts in a round, step size, shrinkage.
NOISE, ROUNDS, PASSES, RATE, SHRINK = 20.0, 2, 4, 0.03, 1e-6
#: Word model: noise words sampled for each data word, pairs in a step, step size.
SAMPLED, BATCH, WORD_RATE = 5, 8192, 0.15
#: Parameters that travel as one row, and how many tasks' rows are first averaged together.
CHUNK, MERGED_TASKS = 1 << 16, 64
CLASSES = HEAD + ENDINGS
START = CLASSES  # the class before a text's first token
CONTEXTS = CONTEXT_WORDS + ENDINGS + 1  # contexts of the word model; the last is a text's start
#: Ending class of a word's last two bytes.
_ENDING = np.array([zlib.crc32(bytes([k & 255, k >> 8])) % ENDINGS for k in range(1 << 16)], dtype=np.int64)


class Counted:
    """Sorted distinct keys with their counts, added up as they come."""

    def __init__(self):
        self.keys, self.counts, self.fresh, self.n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.fresh.append(keys.astype(np.uint64, copy=False))
        self.n += len(keys)
        if self.n >= FRESH:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        if self.n:
            new = np.sort(np.concatenate(self.fresh))
            edge = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]]))
            keys, counts = np.concatenate([self.keys, new[edge]]), np.concatenate([self.counts, np.diff(np.append(edge, len(new)))])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.counts, self.fresh, self.n = keys[edge], np.add.reduceat(counts, edge), [], 0
        return self.keys, self.counts


def word_keys(text: str | None) -> np.ndarray:
    """A number for each word: 58 bits of its hash, and its ending class in the last six."""
    h, last = hashes_and_endings(text)
    return h & ~np.uint64(63) | _ENDING[last].astype(np.uint64)


def _ending_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(63)).astype(np.int64)


class Vocabulary(NamedTuple):
    """The frequent words by rank (falling count); ``slots`` are the words with a vector and a rest for each ending class."""

    hashes: np.ndarray  # sorted, with a last one that no rank belongs to
    ranks: np.ndarray
    counts: np.ndarray  # by rank
    slot_of_rank: np.ndarray  # -1: none
    slot_class: np.ndarray  # ending class of each slot; a class's slots stand together, its rest last
    first: np.ndarray  # first slot of each ending class, and the number of slots
    mass: np.ndarray  # tokens of each slot, smoothed

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes[:-1], keys)
        return np.where(self.hashes[at] == keys, self.ranks[at], -1)

    def classes(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < HEAD - 1), rank + 1, HEAD + ending)

    def contexts(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < CONTEXT_WORDS), rank, CONTEXT_WORDS + ending)

    def slots(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        own = self.slot_of_rank[rank]  # the last, for rank -1, is none
        return np.where(own >= 0, own, self.first[ending + 1] - 1)


def vocabulary(keys: np.ndarray, counts: np.ndarray, tail: np.ndarray) -> Vocabulary:
    """``keys, counts`` by rank; ``tail``: smoothed tokens of each ending class beyond the words with vectors."""
    by = np.argsort(keys, kind="stable")
    owned = np.arange(HEAD - 1, min(VECTOR_WORDS, len(keys)))
    kind = np.concatenate([_ending_of(keys[owned]), np.arange(ENDINGS)])
    rest = np.concatenate([np.zeros(len(owned)), np.ones(ENDINGS)])
    order = np.lexsort((rest, kind))
    slot_of_rank = np.full(len(keys) + 1, -1, dtype=np.int64)
    place = np.empty(len(kind), dtype=np.int64)
    place[order] = np.arange(len(kind))
    slot_of_rank[owned] = place[: len(owned)]
    mass = np.concatenate([counts[owned].astype(np.float64), tail])[order]
    first = np.searchsorted(kind[order], np.arange(ENDINGS + 1))
    return Vocabulary(np.append(keys[by], np.uint64(0)), np.append(by, -1), counts, slot_of_rank, kind[order], first, mass)


class Params(NamedTuple):
    context: np.ndarray  # (2, CLASSES + 1, WIDTH): a class's vector for each position before the token
    out: np.ndarray  # (CLASSES, WIDTH)
    bias: np.ndarray  # (CLASSES,)
    before: np.ndarray  # (CONTEXTS, WORD_WIDTH): a context's vector in the word model
    word: np.ndarray  # (slots, WORD_WIDTH)
    word_bias: np.ndarray  # (slots,)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self]).astype(np.float32)

    def like(self, flat: np.ndarray) -> Params:
        parts = np.split(flat.astype(np.float32), np.cumsum([x.size for x in self])[:-1])
        return Params(*[p.reshape(x.shape) for p, x in zip(parts, self, strict=True)])


def initial(unigram: np.ndarray, v: Vocabulary, seed: int = 3) -> Params:
    r = np.random.default_rng(seed)
    small = lambda *shape: (0.1 * r.standard_normal(shape)).astype(np.float32)
    return Params(small(2, CLASSES + 1, WIDTH), small(CLASSES, WIDTH), np.log(unigram).astype(np.float32), small(CONTEXTS, WORD_WIDTH), small(len(v.mass), WORD_WIDTH), np.log(shares(v)).astype(np.float32))


def shares(v: Vocabulary) -> np.ndarray:
    """Share of each slot in its ending class."""
    return v.mass / np.add.reduceat(v.mass, v.first[:-1])[v.slot_class]


def contrast(params: Params, triples: np.ndarray, counts: np.ndarray, noise: np.ndarray, seed: int) -> Params:
    """A few passes of noise-contrastive estimation over counted class triples (older * (C+1) + newer) * C + class."""
    context, target = np.divmod(triples, CLASSES)
    heads, begin = np.unique(context, return_index=True)
    ends = np.append(begin[1:], len(context))
    older, newer = np.divmod(heads, CLASSES + 1)
    lift = np.log(NOISE * noise).astype(np.float32)
    p = [x.copy() for x in params[:3]]
    squares = [np.full_like(x, 1e-8) for x in p]
    r = np.random.default_rng(seed)
    for _ in range(PASSES):
        order = r.permutation(len(heads))
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            width = ends[part] - begin[part]
            flat = np.repeat(begin[part] - np.cumsum(width) + width, width) + np.arange(width.sum())
            data = np.zeros((len(part), CLASSES), dtype=np.float32)
            data[np.repeat(np.arange(len(part)), width), target[flat]] = counts[flat]
            total = data.sum(axis=1, keepdims=True)
            q = p[0][0][newer[part]] + p[0][1][older[part]]
            real = 1 / (1 + np.exp(-np.clip(q @ p[1].T + p[2] - lift, -30, 30)))
            grad = (data * (1 - real) - total * (NOISE * noise) * real).astype(np.float32) / total.sum()
            gq = grad @ p[1]
            gc = np.zeros_like(p[0])
            np.add.at(gc[0], newer[part], gq)
            np.add.at(gc[1], older[part], gq)
            for k, g in enumerate((gc, grad.T @ q, grad.sum(axis=0))):
                g = g - SHRINK * p[k] if k < 2 else g
                squares[k] = 0.98 * squares[k] + 0.02 * g * g
                p[k] += RATE * g / (np.sqrt(squares[k]) + 1e-7) * (1.0 if k < 2 else 0.3)
    return params._replace(context=p[0], out=p[1], bias=p[2])


def contrast_words(params: Params, pairs: np.ndarray, counts: np.ndarray, v: Vocabulary, seed: int) -> Params:
    """One pass of noise-contrastive estimation with sampled noise over counted pairs: context * slots + slot."""
    before, slot = np.divmod(pairs, len(v.mass))
    share = shares(v)
    lift = np.log(SAMPLED * share).astype(np.float32)
    sums = np.cumsum(v.mass)
    low = np.concatenate([[0.0], sums])[v.first]
    p = [x.copy() for x in params[3:]]
    squares = [np.full_like(x, 1e-6) for x in p]
    r = np.random.default_rng(seed)

    def step(k: int, rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(rows[order]) != 0]))
        own, g = rows[order][edge], np.add.reduceat(grad[order], edge, axis=0)
        squares[k][own] += g * g
        p[k][own] += WORD_RATE * g / np.sqrt(squares[k][own])

    order = r.permutation(len(pairs))
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        c, kind = before[part], v.slot_class[slot[part]]
        drawn = low[kind][:, None] + r.random((len(part), SAMPLED)) * (low[kind + 1] - low[kind])[:, None]
        noise = np.clip(np.searchsorted(sums, drawn, side="right"), v.first[kind][:, None], v.first[kind + 1][:, None] - 1)
        rows = np.concatenate([slot[part][:, None], noise], axis=1)
        q, o = p[0][c], p[1][rows]
        real = 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", q, o) + p[2][rows] - lift[rows], -30, 30)))
        grad = -real
        grad[:, 0] += 1
        grad *= counts[part][:, None].astype(np.float32)
        step(0, c, np.einsum("nk,nkd->nd", grad, o))
        step(1, rows.ravel(), (grad[:, :, None] * q[:, None]).reshape(-1, WORD_WIDTH))
        step(2, rows.ravel(), grad.ravel())
    return params._replace(before=p[0], word=p[1], word_bias=p[2])


class Tables(NamedTuple):
    """Class log-probability = one[c1, c] + two[c2, c] + bias[c] - norm[c1, c2], natural logarithms.

    Log-probability of a slot in its class = before[context] . word[slot] + word_bias[slot] - word_norm[context, class].
    """

    one: np.ndarray
    two: np.ndarray
    bias: np.ndarray
    norm: np.ndarray
    before: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray
    word_norm: np.ndarray


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis=1, keepdims=True)))[:, 0]


def tables(p: Params, v: Vocabulary) -> Tables:
    one, two = p.context[0] @ p.out.T, p.context[1] @ p.out.T
    norm = np.stack([_log_sum(one[c1] + two + p.bias) for c1 in range(CLASSES + 1)])
    inner = np.stack([_log_sum(p.before @ p.word[a:b].T + p.word_bias[a:b]) for a, b in zip(v.first[:-1], v.first[1:], strict=True)], axis=1)
    return Tables(one, two, p.bias, norm, p.before, p.word, p.word_bias, inner)


class Model(NamedTuple):
    words: Vocabulary
    log_counts: np.ndarray  # log10(count + 1) by rank
    end_log_count: float
    tail_log: np.ndarray  # log10 of the smoothed tokens of each ending class beyond the words with vectors
    base_log: float  # log10(N + V + 1)
    tables: Tables


def _tokens(texts, v: Vocabulary) -> tuple[np.ndarray, ...]:
    """Of all tokens of all texts: key, rank (-1: not in the table), ending class; tokens of each text and its last; whether it is a word.

    A text's end is its last token.
    """
    got = [word_keys(t) for t in texts]
    sizes = np.array([len(h) + 1 for h in got], dtype=np.int64)
    last = np.cumsum(sizes) - 1
    word = np.ones(int(sizes.sum()), dtype=bool)
    word[last] = False
    keys = np.zeros(len(word), dtype=np.uint64)
    keys[word] = np.concatenate(got)
    return keys, v.rank(keys), np.minimum(_ending_of(keys), ENDINGS - 1), sizes, last, word


def _shifted(x: np.ndarray, by: int, sizes: np.ndarray, start: int) -> np.ndarray:
    """Each token's value of ``x`` ``by`` tokens before, ``start`` before a text's first."""
    out = np.concatenate([np.full(by, start), x])[: len(x)]
    first = np.cumsum(sizes) - sizes
    for k in range(by):
        out[first[sizes > k] + k] = start
    return out


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 100):
            yield pdf.iloc[at : at + 100]


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``h, c``: key and count of each word over all whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counted()
        give = lambda: pd.DataFrame({"h": seen.settle()[0].view(np.int64), "c": seen.counts})
        for part in _slices(batches):
            for text in part["text"]:
                seen.add(word_keys(text))
            if len(seen.keys) > COUNTED:
                yield give()
                seen = Counted()
        yield give()

    return texts.select(F.col(text_col).alias("text")).mapInPandas(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(keys.astype(np.int64), prepend=0).astype("<i8").tobytes() + counts.astype("<i4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, dtype="<i8", count=n)), np.frombuffer(raw, dtype="<i4", offset=8 * n).astype(np.float32)


def _averaged(rows: DataFrame) -> DataFrame:
    """Weighted means of chunks of parameters: first over groups of tasks, then over all."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        weight = np.sum([np.frombuffer(zlib.decompress(w), dtype="<f4") for w in pdf["w"]], axis=0, dtype=np.float64)
        value = np.sum([np.frombuffer(x, dtype="<f4").astype(np.float64) * np.frombuffer(zlib.decompress(w), dtype="<f4") for x, w in zip(pdf["x"], pdf["w"], strict=True)], axis=0)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "x": [(value / weight).astype("<f4").tobytes()], "w": [zlib.compress(weight.astype("<f4").tobytes(), 1)]})

    kind = "chunk int, x binary, w binary"
    return rows.groupBy("chunk", "some").applyInPandas(mean, kind).groupBy("chunk").applyInPandas(mean, kind)


def train(texts: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame, dict[str, int]]:
    """The model, the stored word counts, and N (tokens), V (distinct tokens) with the end counted as a token."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).alias("text"))
    counts = stored(word_counts(texts))
    n_texts = texts.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    stats = {"N": (sums["n"] or 0) + n_texts, "V": sums["v"] + (n_texts > 0)}
    # The least count of a frequent word, from how many words have each count (in steps that grow with the count).
    level = F.floor(F.log2("c") * 64)
    room, least = TABLE_ROWS, None
    for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).toLocalIterator():  # 64 rows at most for each doubling
        room -= r["n"]
        if room < 0:
            break
        least = r["k"]
    top = counts.filter(level >= (least if least is not None else 1 << 30)).toPandas()
    top = top.assign(h=top["h"].to_numpy(dtype=np.int64).view(np.uint64)).sort_values(["c", "h"], ascending=[False, True])
    keys, c = top["h"].to_numpy(dtype=np.uint64), top["c"].to_numpy(dtype=np.int64)
    total, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy(F.col("h").bitwiseAND(63).cast("int").alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        total[r["e"]], kinds[r["e"]] = r["n"], r["v"]
    own = slice(0, VECTOR_WORDS)
    of = lambda rows, weights=None: np.bincount(_ending_of(keys[rows]), weights, minlength=ENDINGS)
    tail = total - of(own, c[own]) + kinds - of(own) + 1.0  # one more for words never seen
    v = vocabulary(keys, c, tail)
    tokens = np.full(CLASSES, 0.5)
    tokens[0] += n_texts
    tokens[1 : min(HEAD, len(keys) + 1)] += c[: HEAD - 1]
    tokens[HEAD:] += total - of(slice(0, HEAD - 1), c[: HEAD - 1])
    unigram = (tokens / tokens.sum()).astype(np.float32)
    sent = spark.sparkContext.broadcast((v, unigram))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The task's counts of class triples, and of pairs of context and slot."""
        v, _ = sent.value
        triples, pairs = Counted(), Counted()
        for part in _slices(batches):
            _, rank, ending, sizes, _, word = _tokens(part["text"], v)
            kind = np.where(word, v.classes(rank, ending), 0)
            triples.add((_shifted(kind, 2, sizes, START) * (CLASSES + 1) + _shifted(kind, 1, sizes, START)) * CLASSES + kind)
            before = _shifted(v.contexts(rank, ending), 1, sizes, CONTEXTS - 1)
            inner = kind >= HEAD
            pairs.add(before[inner] * len(v.mass) + v.slots(rank[inner], ending[inner]))
        if triples.n or len(triples.keys):
            yield pd.DataFrame({"tokens": [float(triples.settle()[1].sum())], "triples": [_packed(*triples.settle())], "pairs": [_packed(*pairs.settle())]})

    parts = stored(texts.mapInPandas(gather, "tokens double, triples binary, pairs binary"))
    params = initial(unigram, v)
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(params)

        def fit(batches: Iterator[pd.DataFrame], now=now, k=k) -> Iterator[pd.DataFrame]:
            v, unigram = sent.value
            for pdf in batches:
                for some, n, triples, pairs in pdf.itertuples(index=False):
                    got = contrast(now.value, *_unpacked(triples), unigram, seed=k)
                    at, times = _unpacked(pairs)
                    got = contrast_words(got, at, times, v, seed=k) if len(at) else got
                    weight = [np.full(x.size, n, dtype=np.float32) for x in got[:3]]
                    seen = [np.bincount(x, times, minlength=m) + 1e-3 for x, m in ((at // len(v.mass), CONTEXTS), (at % len(v.mass), len(v.mass)))]
                    weight += [np.repeat(seen[0], WORD_WIDTH), np.repeat(seen[1], WORD_WIDTH), seen[1]]
                    x, w = got.flat(), np.concatenate(weight).astype("<f4")
                    at = range(0, len(x), CHUNK)
                    yield pd.DataFrame({"chunk": range(len(at)), "some": some, "x": [x[i : i + CHUNK].tobytes() for i in at], "w": [zlib.compress(w[i : i + CHUNK].tobytes(), 1) for i in at]})

        some = parts.select(F.floor(F.spark_partition_id() / MERGED_TASKS).alias("some"), "tokens", "triples", "pairs")
        mean = _averaged(some.mapInPandas(fit, "chunk int, some long, x binary, w binary")).select("chunk", "x").collect()  # the parameters
        if mean:
            params = params.like(np.concatenate([np.frombuffer(r["x"], dtype="<f4") for r in sorted(mean, key=lambda r: r["chunk"])]))
    model = Model(v, np.log10(c + 1.0), float(np.log10(n_texts + 1)), np.log10(tail), float(np.log10(stats["N"] + stats["V"] + 1)), tables(params, v))
    return model, counts, stats


def score_texts(docs: DataFrame, trained: tuple[Model, DataFrame, dict[str, int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` for every row, from its whole text.

    ``score`` is the model's log10 probability of the text with its end, ``base_score`` that of add-one unigrams. Null
    texts count as empty: they have one token, the end. Rows are scored on their own, so repeated rows repeat; other
    columns are ignored. Words outside the broadcast table are joined with the stored counts, after which one small
    row per text and task is added up.
    """
    model, counts, stats = trained
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        v, t = m.words, m.tables
        for part in _slices(batches):
            keys, rank, ending, sizes, last, word = _tokens(part["text"], v)
            first = last - sizes + 1
            c = np.where(word, v.classes(rank, ending), 0)
            c1, c2 = _shifted(c, 1, sizes, START), _shifted(c, 2, sizes, START)
            lm = (t.one[c1, c] + t.two[c2, c] + t.bias[c] - t.norm[c1, c2]).astype(np.float64)
            inner = np.flatnonzero(c >= HEAD)
            before, slot, e = _shifted(v.contexts(rank, ending), 1, sizes, CONTEXTS - 1)[inner], v.slots(rank[inner], ending[inner]), ending[inner]
            lm[inner] += np.einsum("nd,nd->n", t.before[before], t.word[slot]) + t.word_bias[slot] - t.word_norm[before, e]
            lm /= np.log(10)
            logs = np.where(rank >= 0, np.append(m.log_counts, 0.0)[rank], 0.0)
            logs[last] = m.end_log_count
            shared = inner[slot == v.first[e + 1] - 1]  # words without a vector of their own
            lm[shared] += logs[shared] - m.tail_log[ending[shared]]
            rare = word & (rank < 0)
            add = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            yield pd.DataFrame({"row": part["row"], "id": part["id"], "n_tokens": sizes, "known": add((~rare).astype(np.int64)), "lm": add(lm), "base": add(logs), "h": None})
            where = np.flatnonzero(rare)
            if len(where):
                owner = part["row"].to_numpy()[np.searchsorted(last, where)]
                yield pd.DataFrame({"row": owner, "id": None, "n_tokens": 0, "known": 0, "lm": 0.0, "base": 0.0, "h": keys[where].view(np.int64)}).astype({"id": "object"})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    told = stored(rows.mapInPandas(run, f"row long, id {kind}, n_tokens long, known long, lm double, base double, h long"))
    found = told.filter("h is not null").select("row", "h").join(counts.hint("merge"), "h")
    rest = found.groupBy("row").agg(F.sum(F.log10(F.col("c") + 1)).alias("s"), F.count("*").alias("k")).withColumnRenamed("row", "r")
    out = told.filter("h is null").join(rest, F.col("row") == F.col("r"), "left")
    more = F.coalesce("s", F.lit(0.0))
    known: Column = F.col("known") + F.coalesce("k", F.lit(0)) - F.lit(0 if stats["V"] else 1)
    return out.select(F.col("id").alias(id_col), "n_tokens", known.alias("n_known"), F.lit(stats["N"]).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * F.lit(model.base_log)).alias("base_score"), (F.col("lm") + more).alias("score"))
