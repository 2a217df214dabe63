"""Exact Jaccard self-join on word n-grams with token-combination prefixes.

A document is the set of its hashed n-grams ("tokens"). All tokens are counted in a sketch of fixed size, which gives
a global order (tokens of fuller counters later) and says whether a token is rare or frequent. With at least ``o``
tokens in common, at most ``d = size - o`` of a set's tokens are missing in the other, so the prefix is extended until
no ``d`` missing tokens can spoil all its signatures: a rare token is a signature of its own, frequent tokens are
dealt to classes by their hash and make signatures in pairs inside a class, where the first of each class counts for
nothing. The number of classes follows the set's size in bands that double; a set near a band's edge emits the
signatures of both bands, so any two sets that can link have a band in common. Small sets use single tokens only.

Equal sets collapse to one. The sets that share a signature make a bucket. In a bucket, parity sketches (a bit for each
of twice as many places as tokens: whether an odd number of tokens fell there) give a lower bound of the number of
tokens that two sets do not share, so all pairs are ruled out or kept without a row for any of them: a large bucket is
cut into blocks that meet two by two. The first pass takes the largest bucket of each set and keeps a spanning forest of
each block's graph; the second takes all buckets that this left unconnected and keeps every pair between different
components, in the first bucket that holds both. What is kept is verified on the whole sets. So the components are
exact, and a group of near copies is never expanded into its pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, frees_shuffles, stored
from .words import MIX, hashes_of, mixed

#: Counters of the sketch (a power of two) and the fullest that are still rare. As a corpus fills the counters, fewer
#: tokens are rare and more go into pairs, which stay selective; the order keeps apart what exceeds chance.
COUNTERS, RARE_COUNT = 1 << 18, 8
#: Counters that travel as one row, and how many tasks' rows are first added up together.
COUNTER_BLOCK, MERGED_TASKS = 1 << 12, 256
#: Rows of a bucket that one block holds; two blocks meet in a task.
BLOCK_ROWS = 1024
#: Bits of a parity sketch for each token of the band's smallest set, and its least and greatest length.
SKETCH_BITS, SKETCH_LEAST, SKETCH_MOST = 2, 256, 1 << 15
#: Bits of the filter that keeps most texts out of the second reading.
FILTER_BITS = 1 << 23
#: Levels of the order beyond rare: each is twice the excess over what chance fills in.
LEVELS = 15
#: Size of the smallest set that uses pairs.
SMALL = 32
#: Sets that a task remembers, so as to sign equal ones once.
SEEN_SETS = 100_000
#: Least signatures of a set that travel with its rows, to give a pair in few of its buckets.
LEAST_SIGS = 8
SALT = 0x2545F4914F6CDD1D


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of all ``n``-word sequences (A-Z lower-cased, ASCII white space); the whole text if shorter."""
    h = hashes_of(text)
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mixed(out * MIX + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def counter_levels(counts: np.ndarray) -> np.ndarray:
    """Level of each counter: 0 for rare, 1 where chance explains its count, then one more for each doubling of the excess."""
    mean = counts.mean() if len(counts) else 0.0
    excess = (counts - mean) / (2.0 * np.sqrt(mean) + 16.0)
    level = np.clip(np.floor(np.log2(np.maximum(excess, 0.5))) + 2, 1, LEVELS)
    return np.where(counts <= RARE_COUNT, 0, level).astype(np.uint64)


def band_of(size: int) -> int:
    """-1 for small sets, then 0, 1, ... for sizes from SMALL, twice SMALL, ..."""
    return (size // SMALL).bit_length() - 1


def least_size(size: int, percent: int) -> int:
    """Tokens that a set of ``size`` has in common with another, if they link; also the least size of that other."""
    return -(-percent * size // 100)


def signatures(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set, so that any two sets with ``100 * common >= percent * union`` share one at least.

    The last five bits of a signature are its band, counted from 0. A signature may come more than once.
    """
    size = len(tokens)
    least = least_size(size, percent)
    missing = size - least
    level = levels[(tokens >> np.uint64(46)).astype(np.int64)]
    order = np.sort((level << np.uint64(60)) | (tokens >> np.uint64(4)))  # by level, then by hash
    ordered, n_rare = order & np.uint64((1 << 60) - 1), int(np.searchsorted(order, np.uint64(1 << 60)))
    out = []
    for band in range(band_of(least), band_of(size) + 1):  # the smaller of two linked sets is in one of these
        salt = np.uint64((SALT * (2 * band + 5)) & 0xFFFFFFFFFFFFFFFF)
        mark = lambda sigs, band=band: sigs & ~np.uint64(31) | np.uint64(band + 1)
        if band < 0:
            out.append(mark(mixed(ordered[: missing + 1] ^ salt)))
            continue
        out.append(mark(mixed(ordered[: min(n_rare, missing + 1)] ^ salt)))
        need = missing + 1 - n_rare  # tokens that aren't the first of their class
        if need <= 0:
            continue
        low = SMALL << band
        classes = max(1, min(375 * (100 - percent) * low // 10_000, percent * low // 100 - 2))
        rest = ordered[n_rare : n_rare + need + classes]
        kind = (rest % np.uint64(classes)).astype(np.int64)
        begins = np.full(classes, -1, dtype=np.int64)
        begins[kind[::-1]] = np.arange(len(rest) - 1, -1, -1)
        later = np.ones(len(rest), dtype=np.int64)
        later[begins[begins >= 0]] = 0
        rest = np.sort(rest[: int(np.searchsorted(np.cumsum(later), need)) + 1])
        kind = (rest % np.uint64(classes)).astype(np.int32)
        by = np.argsort(kind.astype(np.int16) if classes < 1 << 15 else kind, kind="stable")
        rest, kind = rest[by], kind[by]
        step = 1
        while step < len(rest) and (same := kind[step:] == kind[:-step]).any():
            out.append(mark(mixed(mixed(rest[:-step][same] ^ salt) * MIX + rest[step:][same])))
            step += 1
    return np.concatenate(out)


def parity_sketch(tokens: np.ndarray, band: int) -> bytes:
    """Bits that say where an odd number of tokens fell. Two sketches differ in no more bits than the sets differ in tokens."""
    bits = min(SKETCH_MOST, max(SKETCH_LEAST, SKETCH_BITS * (SMALL << band if band >= 0 else SMALL)))
    odd = np.bincount(((tokens >> np.uint64(13)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bounds(sketches: np.ndarray, size: np.ndarray, block: np.ndarray, component: np.ndarray, across: bool, percent: int) -> np.ndarray:
    """Least number of tokens that two sets differ in, as a share of their sizes' sum; infinite where they can't link.

    ``across``: only pairs of sets of different blocks count. Pairs inside a component are left out.
    """
    m, width = sketches.shape
    differ = np.empty((m, m), dtype=np.int64)
    step = max(1, 4_000_000 // (m * width))
    for at in range(0, m, step):
        differ[at : at + step] = np.bitwise_count(sketches[at : at + step, None] ^ sketches[None]).sum(axis=2, dtype=np.int64)
    both = size[:, None] + size[None]
    # 100 * common >= percent * (both - common)
    ok = (differ <= both - 2 * -(-percent * both // (100 + percent))) & (100 * np.minimum(size[:, None], size[None]) >= percent * np.maximum(size[:, None], size[None]))
    ok &= component[:, None] != component[None]
    if across:
        ok &= block[:, None] != block[None]
    return np.where(ok, differ / both, np.inf)


def forest(far: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs with finite distance, by nearest pairs (Prim)."""
    m = len(far)
    if m == 2:
        return [(0, 1)] if far[0, 1] < np.inf else []
    out, left, near, by = [], np.ones(m, dtype=bool), np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    for _ in range(m):
        at = int(np.where(left, near, np.inf).argmin())
        if not left[at] or near[at] == np.inf:
            at = int(left.argmax())
        else:
            out.append((int(by[at]), at))
        left[at] = False
        closer = left & (far[at] < near)
        near[closer], by[closer] = far[at][closer], at
    return out


def _candidates(percent: int, every: bool):
    """Pairs of each block that may link: all of them (``every``; rows have the least signatures of their set) or a spanning forest.

    Rows of a block (sig, p, q) stand together; a block may reach over batches. Of the buckets that hold a pair, the one
    of its least signature always gives it; another doesn't if the least signatures of both sets tell of an earlier one.
    """

    def pairs_of(table: pa.Table, cuts: np.ndarray) -> Iterator[np.ndarray]:
        sketch = table.column("sketch").chunk(0)
        at = np.frombuffer(sketch.buffers()[1], dtype=np.int32)[sketch.offset : sketch.offset + len(sketch) + 1] // 8
        data = np.frombuffer(sketch.buffers()[2], dtype=np.uint64)
        sig, ids, size, component, block, p, q = (table.column(c).chunk(0).to_numpy() for c in ("sig", "id", "size", "component", "block", "p", "q"))
        if every:
            lists = table.column("sigs").chunk(0)
            place = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1]
            values = lists.values.to_numpy()

        def first_met(pairs: np.ndarray) -> np.ndarray:
            """Pairs without those that a bucket with a smaller signature gives, as far as the least signatures tell."""
            if not every or not len(pairs):
                return pairs
            both = [np.intersect1d(values[place[i] : place[i + 1]], values[place[j] : place[j + 1]], assume_unique=True) for i, j in pairs.tolist()]
            return pairs[np.array([not len(x) or x[0] >= s for x, s in zip(both, sig[pairs[:, 0]].tolist(), strict=True)])]

        first, many = cuts[:-1], np.diff(cuts)
        twos = first[many == 2]
        for width in np.unique(at[twos + 1] - at[twos]):  # two sets: no matrix
            own = twos[at[twos + 1] - at[twos] == width]
            x, y = (data[at[k][:, None] + np.arange(width)] for k in (own, own + 1))
            both = size[own] + size[own + 1]
            ok = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= both - 2 * -(-percent * both // (100 + percent))
            ok &= (100 * np.minimum(size[own], size[own + 1]) >= percent * np.maximum(size[own], size[own + 1])) & (component[own] != component[own + 1]) & ((p[own] == q[own]) | (block[own] != block[own + 1]))
            yield ids[first_met(np.stack([own[ok], own[ok] + 1], axis=1))]
        for k, m in zip(first[many > 2].tolist(), many[many > 2].tolist(), strict=True):
            rows = slice(k, k + m)
            far = bounds(data[at[k] : at[k + m]].reshape(m, -1), size[rows], block[rows], component[rows], bool(p[k] != q[k]), percent)
            yield ids[first_met(k + (np.argwhere(np.triu(far < np.inf)) if every else np.array(forest(far), dtype=np.int64).reshape(-1, 2)))]

    def give(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, n = None, [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            if not table.num_rows:
                continue
            key = np.stack([table.column(c).chunk(0).to_numpy().astype(np.int64) for c in ("sig", "p", "q")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
            held = table.slice(cuts[-1])
            for pairs in pairs_of(table, cuts) if len(cuts) > 1 else ():
                found.append(pairs)
                n += len(pairs)
                if n > 200_000:
                    yield give(found)
                    found, n = [], 0
        if held is not None:
            held = held.combine_chunks()
            found += pairs_of(held, np.array([0, held.num_rows]))
        if found:
            yield give(found)

    return run


@frees_shuffles
def ngram_components(df: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every document: its set's size and the smallest id reachable by links.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of ``n``-word sequences. Documents
    without words (null, empty or blank texts) have no sequence and link with nothing. Rows that repeat an id count as
    one document (of differing texts the one with the fewest sequences, then the least hash); rows without an id are
    left out. Other columns are ignored; an empty table gives an empty result. Ids must be integers.

    Joins of tables that grow with the corpus are merge joins at every size.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each document, and the task's share of the sketch (rows with a block of counters)."""
        sketch = np.zeros(COUNTERS, dtype=np.int64)
        for pdf in batches:
            keys, sizes = [], []
            for text in pdf["text"]:
                s = shingle_set(text, n)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                at = (s >> np.uint64(46)).astype(np.int64)
                if len(s) > COUNTERS // 8:
                    sketch += np.bincount(at, minlength=COUNTERS)
                else:
                    np.add.at(sketch, at, 1)
            yield pd.DataFrame({"id": pdf["id"], "key": keys, "size": sizes, "block": -1, "counts": None})
        parts = np.flatnonzero(sketch.reshape(-1, COUNTER_BLOCK).any(axis=1))
        packed = [zlib.compress(sketch[k * COUNTER_BLOCK : (k + 1) * COUNTER_BLOCK].astype("<i8").tobytes(), 1) for k in parts]
        yield pd.DataFrame({"id": pd.Series([None] * len(parts), dtype="Int64"), "key": None, "size": 0, "block": parts, "counts": packed})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTER_BLOCK, dtype=np.int64)
        for packed in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(packed), dtype="<i8")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    both = stored(docs.mapInPandas(count, "id long, key binary, size long, block int, counts binary"))
    counts = np.zeros((COUNTERS // COUNTER_BLOCK, COUNTER_BLOCK))
    some = both.filter("block >= 0").select("block", "counts", F.floor(F.spark_partition_id() / MERGED_TASKS).alias("salt"))
    some = some.groupBy("block", "salt").applyInPandas(merged, "block int, counts binary").groupBy("block").applyInPandas(merged, "block int, counts binary")
    for r in some.collect():  # COUNTERS numbers
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), dtype="<i8")
    sent = spark.sparkContext.broadcast(counter_levels(counts.ravel()))
    base = stored(both.filter("block < 0").groupBy("id").agg(F.min(F.struct("size", "key")).alias("s")).select("id", "s.size", "s.key"))
    forget(both)
    sets = stored(base.filter("size > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("size").alias("size")))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Signatures with a short handle of their set, once for equal sets of a task as long as they are remembered.

        Sets whose handles collide are told apart by verification.
        """
        levels, seen = sent.value, set()
        for pdf in batches:
            sigs, handles, n_rows = [], [], 0
            for text in pdf["text"]:
                s = shingle_set(text, n)
                handle = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[8:], "big", signed=True)
                if not len(s) or handle in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(handle)
                sigs.append(signatures(s, levels, percent))
                handles.append(np.full(len(sigs[-1]), handle))
                n_rows += len(sigs[-1])
                if n_rows > 100_000:
                    yield pd.DataFrame({"sig": _long(np.concatenate(sigs)), "handle": np.concatenate(handles)})
                    sigs, handles, n_rows = [], [], 0
            if sigs:
                yield pd.DataFrame({"sig": _long(np.concatenate(sigs)), "handle": np.concatenate(handles)})

    signed = docs.select("text").mapInPandas(sign, "sig long, handle long")
    # One shuffle of two numbers a row; all but the shared signatures end here and are never written.
    of_sig = Window.partitionBy("sig")
    shared = signed.withColumn("low", F.min("handle").over(of_sig)).withColumn("high", F.max("handle").over(of_sig)).filter("low <> high").select("sig", "handle").distinct()
    named = sets.select(F.conv(F.hex(F.substring("key", 9, 8)), 16, -10).cast("long").alias("handle"), "id", "size")
    rows = stored(shared.join(named.hint("merge"), "handle").select("sig", "id", "size"))
    # Of buckets with the same members (128 bits of their ids' hashes tell) one is enough.
    members = rows.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    buckets = stored(rows.join(members.groupBy("n", "x", "y").agg(F.min("sig").alias("sig")).select("sig").hint("merge"), "sig", "left_semi"))
    forget(rows)

    wanted = buckets.select("id").distinct()
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    filled = wanted.select(spot.alias("s")).groupBy((F.col("s") / 8).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(s % 8 as int))")).alias("bits")).collect()  # FILTER_BITS at most
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    bits[[r["at"] for r in filled]] = [r["bits"] for r in filled]
    marked = spark.sparkContext.broadcast(bits)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets and sketches of the texts that pass the filter."""
        for pdf in batches:
            at = pdf["spot"].to_numpy()
            pdf = pdf[(marked.value[at >> 3] >> (at & 7).astype(np.uint8) & 1) == 1]
            for begin in range(0, len(pdf), 500):
                part = pdf.iloc[begin : begin + 500]
                rows = [shingle_set(t, n) for t in part["text"]]
                low = [band_of(least_size(len(r), percent)) for r in rows]
                made = [[parity_sketch(r, b) for b in range(k, band_of(len(r)) + 1)] for r, k in zip(rows, low, strict=True)]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "key": [xxhash.xxh3_128_digest(r.tobytes()) for r in rows], "tokens": [_long(r) for r in rows], "band": low, "sketches": made})

    again = docs.select("id", "text", spot.alias("spot")).mapInPandas(whole, "id long, key binary, tokens array<long>, band int, sketches array<binary>")
    # Of rows that repeat an id, the one that stands for it.
    stands = sets.join(wanted.hint("merge"), "id", "left_semi").select("id", F.col("key").alias("own"))
    tokens = stored(again.join(stands.hint("merge"), "id").filter("key = own").drop("own").dropDuplicates(["id"]))  # one shuffle, by id
    sketches = tokens.select("id", "band", F.posexplode("sketches").alias("k", "sketch")).select("id", (F.col("band") + F.col("k") + 1).alias("band"), "sketch")

    def candidates(rows: DataFrame, every: bool) -> DataFrame:
        """Pairs (a < b) to verify, of ``rows`` (sig, id, size, component)."""
        n_parts = F.ceil(F.count("*").over(of_sig) / BLOCK_ROWS).cast("int")
        rows = rows.withColumn("parts", n_parts).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("band", (F.col("sig").bitwiseAND(31)).cast("int"))
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("block", o).alias("p"), F.greatest("block", o).alias("q")))
        rows = rows.join(sketches.hint("merge"), ["id", "band"])
        if every:
            least_sigs = F.slice(F.array_sort(F.collect_set("sig")), 1, LEAST_SIGS)
            rows = rows.join(rows.groupBy("id").agg(least_sigs.alias("sigs")).hint("merge"), "id")
        one = rows.filter("parts = 1").withColumns({"p": F.lit(0), "q": F.lit(0)})
        more = rows.filter("parts > 1").withColumn("at", F.explode(meets)).withColumns({"p": F.col("at.p"), "q": F.col("at.q")})
        dealt = one.unionByName(more.drop("at")).select("sig", "p", "q", "id", "size", "component", "block", "sketch", *["sigs"] * every)
        dealt = dealt.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q")
        return dealt.mapInArrow(_candidates(percent, every), "a long, b long").distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a")
        joined = left.join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b")
        common = F.size(F.array_intersect("x", "y"))
        return joined.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")

    # First only the largest bucket of each set, which connects most of what links.
    homes = buckets.withColumn("n", F.count("*").over(of_sig)).groupBy("id").agg(F.max_by("sig", F.struct("n", "sig")).alias("sig")).select("sig").distinct()
    first = stored(candidates(buckets.join(homes.hint("merge"), "sig", "left_semi").withColumn("component", F.col("id")), False))
    links = stored(verified(first))
    labels = stored(components(links))
    rows = buckets.join(labels.hint("merge"), buckets["id"] == labels["node"], "left").select("sig", "id", "size", F.coalesce("component", "id").alias("component"))
    still = rows.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("sig")
    rest = stored(candidates(rows.join(still.hint("merge"), "sig", "left_semi"), True).join(first.hint("merge"), ["a", "b"], "left_anti"))
    more = stored(verified(rest))
    if not more.isEmpty():
        labels = stored(components(links.union(more)))
    forget(buckets, tokens, first, links, rest, more)
    per_set = sets.join(labels.hint("merge"), sets["id"] == labels["node"], "left").select("key", F.coalesce("component", "id").alias("component_id"))
    out = base.join(per_set.hint("merge"), "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
