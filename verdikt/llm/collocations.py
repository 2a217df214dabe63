"""Phrases whose words stand together more often than chance has it, by merging sorted streams of counts.

A word has a number: a hash of its language and bytes, for which all distinct words are checked to be different (else
another seed is taken). Texts are read three times. First words are counted. Then hashes of word pairs are counted,
which only says what pairs can be frequent: those go into a bit filter. Then phrases are counted exactly whose pairs
all pass the filter, so what is shuffled is near what is frequent. Counts are added up in blocks of bounded size before
they leave a task.

The counts of words and phrases make one stream in prefix order (a word comes just before the phrases that it begins,
a phrase just before its extensions) and one in suffix order. Walking along a stream in lockstep gives each phrase the
counts of all its prefixes (suffixes), and each its most frequent extension to the right (left), without a hash join.
Streams are dealt by ranges; where a range begins inside a group, the counts that it continues are handed to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ranked, stored
from .slabs import LOWER, gathered, ranges, slabs, span_hashes, spans, texts_of
from .words import MIX, mixed

#: Bytes between the pieces of a text, and between words.
STOP = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
GAP = STOP | np.isin(np.arange(256), [0x20, 0x09])
#: Rows that a task turns into Python objects at once; n-grams and distinct words that it adds up before they leave it;
#: rows that leave at once.
SLICE, BLOCK, WORDS, SENT = 512, 1_000_000, 250_000, 100_000
#: Bits of the filter for each frequent pair, its greatest size in bits (64 MB; a fuller filter lets more phrases be
#: counted that turn out rare, the result stays the same), and bits that one row of it holds.
FILTER_BITS, FILTER_MOST, FILTER_ROW = 12, 1 << 29, 1 << 15
#: Rows of a stream that one task walks along, on average.
STREAM_ROWS = 200_000


def _codes(seed: int) -> np.ndarray:
    return np.random.default_rng([13, seed]).integers(1, 2**64, 256, dtype=np.uint64)


def _ids(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    """Numbers of words, from 1 to 2^62; ``lang``: the hash of each one's language."""
    return (mixed(span_hashes(raw, begin, end, _codes(seed)) ^ lang) >> np.uint64(2)) | np.uint64(1)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in langs], dtype=np.uint64)


def _runs(texts: list[bytes], langs: np.ndarray, seed: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Word numbers, whether a piece begins with each, and how many of them stood at the end of the run before."""
    ids, begins, open_ = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool), False
    for slab in slabs(texts, GAP):
        raw = LOWER[slab.raw]
        begin, end = spans(raw, GAP)
        stops = np.cumsum(STOP[raw])
        if slab.fresh:
            open_ = False
        if len(begin):
            doc = slab.rows[np.searchsorted(slab.starts, begin, side="right") - 1]
            at = stops[begin]
            fresh = np.concatenate([[not open_ or at[0] > 0], at[1:] != at[:-1]])
            held = len(ids)
            ids, begins = np.concatenate([ids, _ids(raw, begin, end, langs[doc], seed)]), np.concatenate([begins, fresh])
            yield ids, begins, held
            ids, begins = ids[-(longest - 1) :], begins[-(longest - 1) :]
            open_ = bool(stops[-1] == at[-1])
        elif len(stops) and stops[-1]:
            open_ = False


def _inside(begins: np.ndarray, held: int, n: int) -> np.ndarray:
    """Where phrases of ``n`` words begin that end beyond the first ``held`` words."""
    ok = np.ones(max(0, len(begins) - n + 1), dtype=bool)
    for k in range(1, n):
        ok &= ~begins[k : k + len(ok)]
    ok[: max(0, held - n + 1)] = False
    return np.flatnonzero(ok)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * MIX + right)


def _sent(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for part in ranges(len(columns[0]), SENT):
        yield pa.RecordBatch.from_arrays([pa.array(c[part].view(np.int64)) for c in columns], names=names)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """``lang, word, id, n`` of ``docs`` (lang, text)."""

    def summed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_batches(parts).group_by(["lang", "word", "id"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "word", "id", "n"]).to_batches(SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in ranges(batch.num_rows, SLICE):
                langs = batch.column(0)[part].to_pylist()
                names = sorted(set(langs))
                number = np.array([names.index(x) for x in langs], dtype=np.int64)
                salts = _lang_hashes(names)
                for slab in slabs(texts_of(batch.column(1)[part]), GAP):
                    raw = LOWER[slab.raw]
                    begin, end = spans(raw, GAP)
                    if not len(begin):
                        continue
                    lang = number[slab.rows[np.searchsorted(slab.starts, begin, side="right") - 1]]
                    data, cuts = gathered(raw, begin, end - begin)
                    held = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
                    _, first, n = np.unique(held.indices.to_numpy().astype(np.int64) * len(names) + lang, return_index=True, return_counts=True)
                    ids = _ids(raw, begin[first], end[first], salts[lang[first]], seed)
                    word = held.dictionary.take(held.indices.take(pa.array(first))).cast(pa.binary()).cast(pa.string())
                    parts.append(pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=object)[lang[first]], pa.string()), word, pa.array(ids.view(np.int64)), pa.array(n)], names=["lang", "word", "id", "n"]))
                    size += len(n)
                    if size > WORDS:
                        yield from summed(parts)
                        parts, size = [], 0
        if parts:
            yield from summed(parts)

    return docs.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, seed: int, longest: int, names: list[str], grams: Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]], key: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Sums of equal rows of what ``grams`` makes of each run. Rows are added up in blocks, ordered by ``key``."""

    def summed(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(key(columns))
        columns = [c[order] for c in columns]
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])  # rows of equal keys may interleave: Spark adds them up
        first = np.flatnonzero(new)
        yield from _sent([*[c[first] for c in columns], np.diff(np.append(first, len(new)))], [*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in ranges(batch.num_rows, SLICE):
                langs = _lang_hashes(batch.column(0)[part].to_pylist())
                for ids, begins, held in _runs(texts_of(batch.column(1)[part]), langs, seed, longest):
                    found = grams(ids, begins, held)
                    if len(found[0]):
                        parts.append(found)
                        size += len(found[0])
                    if size > BLOCK:
                        yield from summed(parts)
                        parts, size = [], 0
        if parts:
            yield from summed(parts)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n"))


def _places(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (pairs & np.uint64(bits - 1)).astype(np.int64), ((pairs >> np.uint64(34)) & np.uint64(bits - 1)).astype(np.int64)


def pair_filter(docs: DataFrame, seed: int, least: int, longest: int) -> np.ndarray:
    """Bits that are set for every pair of words that stands together ``least`` times."""

    def grams(ids: np.ndarray, begins: np.ndarray, held: int) -> list[np.ndarray]:
        at = _inside(begins, held, 2)
        return [_pair(ids[at], ids[at + 1])]

    often = stored(_counted(docs, seed, longest, ["g"], grams, lambda c: c[0]).filter(F.col("n") >= least).select("g"))
    bits = min(FILTER_MOST, max(FILTER_ROW, 1 << (FILTER_BITS * often.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // FILTER_ROW), pa.array((at % FILTER_ROW).astype(np.int32))], names=["block", "at"])

    def row(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(FILTER_ROW, dtype=np.uint8)
        marks[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "marks": [np.packbits(marks, bitorder="little").tobytes()]})

    out = np.zeros((bits // FILTER_ROW, FILTER_ROW // 8), dtype=np.uint8)
    for r in often.mapInArrow(places, "block long, at int").groupBy("block").applyInPandas(row, "block long, marks binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["marks"], dtype=np.uint8)
    forget(often)
    return out.ravel()


def phrase_counts(docs: DataFrame, seed: int, least: int, longest: int) -> DataFrame:
    """Phrases of 2 to ``longest`` words that occur ``least`` times: word numbers ``h1, h2, ...`` (0 behind the last) and ``n``."""
    names = [f"h{k + 1}" for k in range(longest)]
    sent = docs.sparkSession.sparkContext.broadcast(pair_filter(docs, seed, least, longest))

    def grams(ids: np.ndarray, begins: np.ndarray, held: int) -> list[np.ndarray]:
        marks = sent.value
        x, y = _places(_pair(ids[:-1], ids[1:]), 8 * len(marks))
        often = (marks[x >> 3] >> (x & 7).astype(np.uint8)) & (marks[y >> 3] >> (y & 7).astype(np.uint8)) & 1 == 1
        out = []
        for n in range(2, longest + 1):
            at = _inside(begins, held, n)
            for k in range(n - 1):
                at = at[often[at + k]]
            out.append([ids[at + k] if k < n else np.zeros(len(at), dtype=np.uint64) for k in range(longest)])
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    def key(columns: list[np.ndarray]) -> np.ndarray:
        out = columns[0]
        for c in columns[1:]:
            out = _pair(out, c)
        return out

    return _counted(docs, seed, longest, names, grams, key).filter(F.col("n") >= least)


def lockstep(stream: DataFrame, width: int, phrases: bool) -> tuple[DataFrame, DataFrame]:
    """Walks along ``stream`` (k1..k``width``: words in stream order, 0 behind the last; a, lang, first, further columns).

    Returns the rows with f1, f2, ... (the counts of the stream's rows that begin this one), ``ext`` (the greatest
    count among those it begins, one word longer) and ``lang`` and ``first`` taken from the word it begins with, or
    (``phrases``) ``phrase``, its first words joined from the last to the first; and, for rows whose extensions go on
    in later ranges, k1.. and ``ext`` of those. Whatever a row of the stream begins with must itself be a row.
    """
    spark = stream.sparkSession
    keys, counts = [f"k{k + 1}" for k in range(width)], [f"f{k + 1}" for k in range(width - 1)]
    rows = stored(stream)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // STREAM_ROWS))
    dealt = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    forget(rows)
    # What each range continues: the rows that its first row begins with, a few for each range.
    firsts = {r["_part"]: tuple(r["k"]) for r in dealt.groupBy("_part").agg(F.min_by(F.array(*keys), "_at").alias("k")).collect()}
    begun = lambda k: [k[:j] + (0,) * (width - j) for j in range(1, sum(x != 0 for x in k))]
    wanted = spark.createDataFrame(sorted({x for k in firsts.values() for x in begun(k)}), ", ".join(f"{c} long" for c in keys))
    found = {tuple(r[c] for c in keys): (r["a"], r["lang"], r["first"]) for r in dealt.join(F.broadcast(wanted), keys).collect()}
    sent = spark.sparkContext.broadcast({part: [found[x] for x in begun(k)] for part, k in firsts.items()})

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at").combine_chunks()
        n = table.num_rows
        before = sent.value[table.column("_part")[0].as_py()]
        k = np.stack([table.column(c).to_numpy() for c in keys], axis=1)
        a, depth = table.column("a").to_numpy(), (k != 0).sum(axis=1)
        ext, seams = np.zeros(n, dtype=np.int64), []
        first = table.column("first").to_numpy(zero_copy_only=False).astype(object)
        text, out = first.copy(), {}
        lang = table.column("lang").to_numpy(zero_copy_only=False).astype(object)
        continued = [x[2] for x in before]
        for j in range(1, width):
            head = np.maximum.accumulate(np.where(depth == j, np.arange(n), -1))
            given = before[j - 1] if j <= len(before) else (0, None, None)
            out[f"f{j}"] = pa.array(np.where(head >= 0, a[head], given[0]), mask=depth <= j)
            child = np.flatnonzero(depth == j + 1)
            np.maximum.at(ext, head[child[head[child] >= 0]], a[child[head[child] >= 0]])
            over = child[head[child] < 0]
            if len(over):
                seams.append((*k[over[0], :j].tolist(), *[0] * (width - j), int(a[over].max())))
            if phrases:
                whole = " ".join(x or "" for x in reversed(continued[:j]))
                text[child] = [f"{first[c]} {text[h] if h >= 0 else whole}" for c, h in zip(child.tolist(), head[child].tolist(), strict=True)]
            elif j == 1:
                under = depth > 1
                for name, column, own in (("lang", lang, given[1]), ("first", first, given[2])):
                    column[under] = np.where(head[under] >= 0, column[head[under]], own)
        out |= {"ext": pa.array(ext), "seam": pa.array(np.zeros(n, dtype=bool)), "lang": pa.array(lang, pa.string()), "first": pa.array(first, pa.string()), "phrase": pa.array(text if phrases else [None] * n, pa.string())}
        kept = pa.table({f.name: out.get(f.name, table.column(f.name) if f.name in table.column_names else None) for f in schema})
        if not seams:
            return kept
        *own, most = zip(*seams, strict=True)
        given_ = dict(zip(keys, own, strict=True)) | {"ext": most, "seam": [True] * len(seams)}
        return pa.concat_tables([kept, pa.table({f.name: pa.array(given_.get(f.name, [None] * len(seams)), f.type) for f in schema})])

    fields = [c for c in rows.columns if c not in ("lang", "first")]
    kinds = {"lang": "string", "first": "string", "phrase": "string", "seam": "boolean"}
    names = [*fields, *counts, "ext", "lang", "first", "phrase", "seam"]
    schema = pa.schema([(c, {"string": pa.string(), "boolean": pa.bool_()}.get(kinds.get(c, "long"), pa.int64())) for c in names])
    done = stored(dealt.groupBy("_part").applyInArrow(walk, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names)))
    forget(dealt)
    return done.filter("not seam").drop("seam", *([] if phrases else ["phrase"])), done.filter("seam").select(*keys, "ext")


def _with_ext(rows: DataFrame, seams: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with their greatest extension; ``seams`` has a few rows for each range of the stream."""
    more = F.broadcast(seams.groupBy(*keys).agg(F.max("ext").alias("_more")))
    return rows.join(more, keys, "left").withColumn(name, F.greatest("ext", F.coalesce("_more", F.lit(0)))).drop("ext", "_more")


def _distinct_ids(docs: DataFrame) -> tuple[DataFrame, int]:
    """Word counts under the first seed for which no two words share a number."""
    for seed in range(16):
        words = stored(word_counts(docs, seed))
        if words.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
            return words, seed
        forget(words)
    raise ValueError("no seed gives all words numbers of their own")


def collocations(df: DataFrame, least: int = 10, longest: int = 3, inside_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", scale: int = 1_000_000) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words.
    ``a`` is how often the phrase occurs (``least`` at least), ``n`` the language's number of words. Of all cuts of the
    phrase in two, the one with the least ``score = floor(scale * a * a / (l * r))`` counts (ties: the first), ``l`` and
    ``r`` being how often its parts occur. Phrases that a longer one contains with ``inside_percent`` percent of their
    count are dropped. Ranks go by score, then ``a``, then the phrase's bytes. Arithmetic is in decimals of 38 digits.

    A null text counts as empty, a null language as ``und``. Repeated rows count as often as they stand there. Other
    columns are ignored, an empty table gives an empty result. Whole texts are counted.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, seed = _distinct_ids(docs)
    h, k = [[f"{x}{j + 1}" for j in range(longest)] for x in "hk"]
    zero = F.lit(0).cast("long")
    single = words.filter(F.col("n") >= least).select(F.col("id").alias("h1"), *[zero.alias(c) for c in h[1:]], F.col("n").alias("a"), "lang", F.col("word").alias("first"))
    more = phrase_counts(docs, seed, least, longest).select(*h, F.col("n").alias("a"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("first"))
    # Prefix order: counts of all beginnings, and extensions to the right.
    rows, seams = lockstep(single.unionByName(more).toDF(*k, "a", "lang", "first"), longest, False)
    left = _with_ext(rows, seams, k, "right_ext").withColumnsRenamed({f"f{j}": f"l{j}" for j in range(1, longest)})
    # Suffix order: the same from the other end.
    depth = sum((F.col(c) != 0).cast("int") for c in k)
    turned = left.withColumn("_k", F.reverse(F.filter(F.array(*k), lambda x: x != 0))).withColumns({c: F.coalesce(F.get("_k", F.lit(j)), zero) for j, c in enumerate(k)}).drop("_k")
    rows, seams = lockstep(turned, longest, True)
    both = _with_ext(rows, seams, k, "left_ext").withColumn("m", depth).filter("m > 1")
    big = lambda c: F.col(c).cast("decimal(18,0)")

    def cut(at: int, m: int):
        score = F.call_function("div", F.lit(scale).cast("decimal(7,0)") * (big("a") * big("a")), big(f"l{at}") * big(f"f{m - at}"))
        return F.struct(score.alias("score"), F.lit(at).alias("at"), F.col(f"l{at}").alias("l"), F.col(f"f{m - at}").alias("r"))

    best = F.coalesce(*[F.when(F.col("m") == m, F.array_min(F.array(*[cut(at, m) for at in range(1, m)]))) for m in range(2, longest + 1)])
    apart = both.filter(100 * F.greatest("left_ext", "right_ext") < inside_percent * F.col("a")).withColumn("best", best)
    scored = apart.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    first = ranked(scored, [F.desc("score"), F.desc("a"), F.asc("phrase")], ["lang"]).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
