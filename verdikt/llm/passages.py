"""Substring dedup: passages that recur across documents are found, compiled into automata, and located everywhere.

Equal texts collapse to the one with the smallest id. Of every window of words one short word sequence, the one with the
least hash, is its anchor, so windows that are equal have equal anchors wherever they stand; a table of anchors, a
fraction of the words, says which recur. Only windows with a recurring anchor are hashed (128 bits) and grouped; the
smallest id of a group owns the window. Runs of owned windows are the confirmed passages of a document, runs of windows
that another document owns are its claims on that one's passages.

Passages are dealt to shards by their owner, each with the claims on them; claims on a shard that many documents share
are dealt to several tasks. A task compiles the tiles of its passages (every half window, so that each window holds a
whole one) into an Aho-Corasick automaton over word symbols, streams all claims through it and extends each hit to the
longest common stretch, word by word: what is removed has been compared, never only hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .slabs import OTHER_CODE, SPACE, ranges, slabs, span_hashes, spans, texts_of
from .words import _CODE, mixed

#: Rows that a task turns into Python objects at once.
SLICE = 256
#: Words of passages in a shard on average, and of claims that one task streams through it.
SHARD_WORDS, CLAIM_WORDS = 50_000, 100_000
#: Symbols of one automaton: words have code points, without surrogates.
SYMBOLS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, from their hashes."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers_to(len(h))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    done = 1
    while 2 * done <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def whole_texts(texts: list[bytes], codes: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For groups of whole texts: the text of each word, and the word's hashes by ``codes``."""
    held: list[tuple[np.ndarray, list[np.ndarray]]] = []

    def joined() -> tuple[np.ndarray, list[np.ndarray]]:
        docs, hashes = zip(*held, strict=True)
        return np.concatenate(docs), [np.concatenate(x) for x in zip(*hashes, strict=True)]

    for slab in slabs(texts, SPACE):
        if slab.fresh and held:
            yield joined()
            held = []
        begin, end = spans(slab.raw, SPACE)
        doc = slab.rows[np.searchsorted(slab.starts, begin, side="right") - 1]
        held.append((doc, [span_hashes(slab.raw, begin, end, c) for c in codes]))
    if held:
        yield joined()


def anchors_of(doc: np.ndarray, h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows that lie within one text begin, and the anchor of each."""
    if len(h) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    gram = max(1, 2 * window // 5)
    least = least_of(rolled(h, gram), window - gram + 1)
    at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    return at, least[at]


def text_facts(docs: DataFrame, window: int) -> DataFrame:
    """``id, key, n_words, whole`` (digest of all words joined by a blank) and the ``anchors`` of ``docs`` (id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ranges(batch.num_rows, SLICE):
                texts = texts_of(batch.column(2)[part])
                split = [t.split() for t in texts]
                whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in split]
                own: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
                for doc, (h,) in whole_texts(texts, [_CODE]):
                    at, anchor = anchors_of(doc, h, window)
                    cuts = np.flatnonzero(np.diff(doc[at])) + 1
                    for k, some in zip(doc[at[np.append(0, cuts)]] if len(at) else (), np.split(anchor, cuts), strict=False):
                        own[k] = np.unique(some).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array([len(w) for w in split], pa.int64()), pa.array(whole), pa.array(own, pa.list_(pa.int64()))], names=["id", "key", "n_words", "whole", "anchors"])

    return docs.mapInArrow(run, "id long, key binary, n_words long, whole string, anchors array<long>")


def marked_windows(marked: DataFrame, window: int) -> DataFrame:
    """``no, id, pos, x, y`` of each window of ``marked`` (no, id, text, marks) whose anchor is among its marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, ids = (batch.column(c).to_numpy() for c in (0, 1))
            for part in ranges(batch.num_rows, SLICE):
                marks = batch.column(3)[part]
                own = np.unique(marks.flatten().to_numpy().view(np.uint64))
                for doc, (h, g) in whole_texts(texts_of(batch.column(2)[part]), [_CODE, OTHER_CODE]):
                    at, anchor = anchors_of(doc, h, window)
                    at = at[np.isin(anchor, own)]  # a mark of another text of the slice lets a window through that then recurs nowhere
                    begin = np.searchsorted(doc, doc[at])
                    x, y = rolled(h, window)[at].view(np.int64), rolled(g, window)[at].view(np.int64)
                    row = doc[at] + part.start
                    for some in ranges(len(at), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (no[row], ids[row], at - begin, x, y)], names=["no", "id", "pos", "x", "y"])

    return marked.select("no", "id", "text", "marks").mapInArrow(run, "no long, id long, pos long, x long, y long")


def _runs(pos: np.ndarray, *same: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of runs of consecutive positions with equal values."""
    if not len(pos):
        return []
    cut = np.flatnonzero(np.any([np.diff(pos) != 1, *[np.diff(s) != 0 for s in same]], axis=0)) + 1
    return list(zip([0, *cut.tolist()], [*(cut - 1).tolist(), len(pos) - 1], strict=True))


def routes(owned: DataFrame, window: int) -> DataFrame:
    """``owner, claim, no, start, n, words``: the passages a text owns, and its claims on those of others.

    ``owned``: no, id, text, windows (array of pos, owner, x).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for k in range(batch.num_rows):
                no, me = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                words = (batch.column(2)[k].as_py() or "").encode().split()
                table = batch.column(3)[k].values
                pos, owner, x = (table.field(c).to_numpy() for c in range(3))
                order = np.argsort(pos, kind="stable")
                pos, owner, x = pos[order], owner[order], x[order]
                mine = np.flatnonzero(owner == me)
                mine = mine[np.sort(np.unique(x[mine], return_index=True)[1])]  # of equal windows the first
                found = [(me, False, mine[a], mine[b]) for a, b in _runs(pos[mine])]
                other = np.flatnonzero(owner != me)
                found += [(int(owner[other[a]]), True, other[a], other[b]) for a, b in _runs(pos[other], owner[other])]
                for own, claim, a, b in found:
                    begin, end = int(pos[a]), int(pos[b]) + window
                    out.append((own, claim, no, begin, end - begin, b" ".join(words[begin:end]).decode()))
                    size += end - begin
                if size > 500_000:
                    yield _rows(out)
                    out, size = [], 0
            if out:
                yield _rows(out)

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["owner", "claim", "no", "start", "n", "words"]
    _rows = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    return owned.select("no", "id", "text", "windows").mapInArrow(run, "owner long, claim boolean, no long, start long, n long, words string")


class Phrases:
    """Passages of a shard, compiled: tiles of half a window over word symbols, and where each tile stands."""

    def __init__(self, window: int):
        self.window, self.tile = window, window - window // 2
        self.symbol: dict[str, int] = {}
        self.passages: list[np.ndarray] = []
        self.places: list[dict[int, list[tuple[int, int]]]] = []
        self.automaton = ahocorasick.Automaton()

    @staticmethod
    def text(codes: list[int]) -> str:
        return "".join([chr(c if c < 0xD800 else c + 0x800) for c in codes])

    def room(self, words: list[str]) -> bool:
        return not self.passages or len(self.symbol) + len(words) <= SYMBOLS

    def add(self, owner: int, words: list[str]) -> None:
        codes = [self.symbol.setdefault(w, len(self.symbol) + 1) for w in words]
        whole = self.text(codes)
        for at in range(0, len(codes) - self.tile + 1, max(1, self.window - self.tile)):
            tile = whole[at : at + self.tile]
            if tile not in self.automaton:
                self.automaton.add_word(tile, len(self.places))
                self.places.append({})
            self.places[self.automaton.get(tile)].setdefault(owner, []).append((len(self.passages), at))
        self.passages.append(np.array(codes, dtype=np.int32))

    def compiled(self) -> Phrases:
        self.automaton.make_automaton()
        return self

    def found(self, owner: int, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of ``words``, a window long at least, that are also in a passage of ``owner``."""
        codes = [self.symbol.get(w, 0) for w in words]
        own, out, done = np.array(codes, dtype=np.int32), [], {}
        for end, k in self.automaton.iter(self.text(codes)):
            begin = end - self.tile + 1
            for p, at in self.places[k].get(owner, ()):
                if done.get((p, begin - at), -1) > end:
                    continue
                there = self.passages[p]
                before, after = min(begin, at), min(len(own) - begin, len(there) - at)
                wrong = np.flatnonzero(own[begin - before : begin + after] != there[at - before : at + after])
                cut = int(np.searchsorted(wrong, before))
                low = begin - before + (int(wrong[cut - 1]) + 1 if cut else 0)
                high = begin - before + int(wrong[cut]) if cut < len(wrong) else begin + after
                done[p, begin - at] = high
                if high - low >= self.window:
                    out.append((low, high))
        return merged(out)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches."""
    out: list[list[int]] = []
    for low, high in sorted(found):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def located(dealt: DataFrame, window: int) -> DataFrame:
    """``no, start, stop``: stretches found. ``dealt``: shard, part, claim, owner, no, start, words; each shard's part together, passages first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard, open_ = None, [], False
        for batch in batches:
            out = []
            for s, part, claim, owner, no, start, words in zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True):
                if (s, part) != here:
                    here, shard, open_ = (s, part), [Phrases(window)], True
                split = words.split(" ")
                if not claim:
                    if not shard[-1].room(split):
                        shard.append(Phrases(window))
                    shard[-1].add(owner, split)
                    continue
                if open_:
                    shard, open_ = [p.compiled() for p in shard if p.passages], False
                out += [(no, start + a, start + b) for p in shard for a, b in p.found(owner, split)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["no", "start", "stop"])

    return dealt.mapInArrow(run, "no long, start long, stop long")


def kept_words(spanned: DataFrame) -> DataFrame:
    """``key, n_removed, spans, kept`` (digest of what stays) of ``spanned`` (key, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, found in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                words = (text or "").encode().split()
                cut = merged([(s["start"], s["stop"]) for s in found])
                stay = np.ones(len(words), dtype=bool)
                for a, b in cut:
                    stay[a:b] = False
                left = b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])
                out.append((key, int(len(words) - stay.sum()), [{"start": a, "stop": b} for a, b in cut], hashlib.sha256(left).hexdigest()))
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["key", "n_removed", "spans", "kept"])

    return spanned.select("key", "text", "spans").mapInArrow(run, "key binary, n_removed long, spans array<struct<start: long, stop: long>>, kept string")


def repeated_passages(df: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which words of each text lie in a window that also begins in a document with a smaller id.

    Returns for every row ``id_col, n_words, n_removed, spans`` (stretches of words to remove, from ``start`` up to
    before ``stop``; words count from 0) and ``kept_sha256`` (of the words that stay, joined by one blank). Words are
    runs of anything but ASCII white space, taken as they are. Windows are judged on the input.

    Null and blank texts have no words, texts shorter than a window lose none. Rows that repeat an id aren't smaller
    than one another; a row without an id loses nothing and takes nothing. Other columns are ignored; an empty table
    gives an empty result. Ids must be integers.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    facts = stored(text_facts(docs.select("id", "key", "text"), window))
    texts = stored(facts.filter((F.col("n_words") >= window) & F.col("id").isNotNull()).groupBy("key").agg(F.min("id").alias("id"), F.first("anchors").alias("anchors")))
    marks = texts.select("key", "id", F.explode("anchors").alias("anchor"))
    often = stored(marks.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("anchor"))
    marks = stored(marks.join(often.hint("merge"), "anchor", "left_semi").groupBy("key", "id").agg(F.collect_set("anchor").alias("marks")))
    found = docs.join(marks.hint("merge"), ["key", "id"])
    marked = stored(found.withColumn("no", F.monotonically_increasing_id()))
    if marked.count() != marks.count():  # rows that repeat both id and text
        was, marked = marked, stored(marked.dropDuplicates(["key", "id"]))
        forget(was)
    windows = marked_windows(marked, window)
    owners = stored(windows.groupBy("x", "y").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner < last").drop("last"))
    owned = windows.join(owners.hint("merge"), ["x", "y"]).groupBy("no").agg(F.collect_list(F.struct("pos", "owner", "x")).alias("windows"))
    dealt = stored(routes(marked.join(owned.hint("merge"), "no"), window))
    total = dealt.filter("not claim").agg(F.sum("n")).first()[0] or 0
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(max(1, -(-total // SHARD_WORDS)))).cast("long"))
    parts = dealt.filter("claim").groupBy("shard").agg(F.ceil(F.sum("n") / CLAIM_WORDS).alias("parts"))
    shared = dealt.join(parts, "shard")
    claims = shared.filter("claim").withColumn("part", F.pmod(F.xxhash64("no", "start"), F.col("parts")))
    passages = shared.filter("not claim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = claims.unionByName(passages).select("shard", "part", "claim", "owner", "no", "start", "words")
    hits = stored(located(both.repartition("shard", "part").sortWithinPartitions("shard", "part", "claim"), window))
    cut = marked.join(hits.groupBy("no").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).hint("merge"), "no")
    first = stored(texts.select("key", F.col("id").alias("first")).join(kept_words(cut).hint("merge"), "key", "left"))
    forget(texts, often, marks, marked, owners, hits)
    out = facts.join(first.hint("merge"), "key", "left")
    copy = (F.col("id") > F.col("first")) & (F.col("n_words") >= window)
    own = (F.col("id") == F.col("first")) & F.col("n_removed").isNotNull()
    none = F.array().cast("array<struct<start: long, stop: long>>")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(copy, F.col("n_words")).when(own, F.col("n_removed")).otherwise(0).alias("n_removed"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))).when(own, F.col("spans")).otherwise(none).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(own, F.col("kept")).otherwise(F.col("whole")).alias("kept_sha256"),
    )
