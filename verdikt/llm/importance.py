"""Resampling by importance towards a target distribution, with hashed n-gram features.

Every feature falls into a bucket by the CRC of its bytes. Features of a slab are made distinct first; the distinct
ones are grouped by equal length into matrices of bytes, all checksums of a matrix are updated column by column, and
the buckets are scattered back to the features. Spark adds up two tables of bucket counts (as many numbers as there are
buckets); a document's weight is the mean log ratio of its features' buckets, and the sample is drawn by adding Gumbel
noise that comes from the document's id, so it doesn't depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked
from .slabs import LOWER, gathered, ranges, slabs, spans, texts_of

#: A byte of a word, after A-Z became a-z: digits, letters, everything beyond ASCII.
GAP = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Columns of a matrix at most: longer features are cut into pieces of so many bytes, whose checksums are combined.
COLUMNS = 256
#: Bytes of a matrix at most.
MATRIX = 1 << 22
#: Rows that a task turns into Python objects at once.
SLICE = 512
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = (_TABLE >> 1) ^ np.where(_TABLE & 1, np.uint32(0xEDB88320), np.uint32(0))


def _columns(matrix: np.ndarray, register: np.ndarray) -> np.ndarray:
    """The registers after each has taken in its row."""
    for column in np.ascontiguousarray(matrix.T):
        register = _TABLE[(register ^ column) & np.uint32(0xFF)] ^ (register >> np.uint32(8))
    return register


def _skip_tables() -> np.ndarray:
    """What ``COLUMNS`` zero bytes make of a register, as a table for each of its four bytes (the map is linear)."""
    every = (np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    return _columns(np.zeros((1024, COLUMNS), dtype=np.uint8), every).reshape(4, 256)


_SKIP = _skip_tables()


def crc32s(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of ``data``: matrices of equal length, worked on column by column."""

    def registers(begin: np.ndarray, length: np.ndarray, start: int) -> np.ndarray:
        out = np.full(len(begin), start, dtype=np.uint32)
        by = np.argsort(length, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(length[by])) + 1, [len(by)]])
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            n = int(length[by[low]]) if low < high else 0
            for part in ranges(high - low, max(1, MATRIX // max(n, 1))) if n else ():
                at = by[low:high][part]
                out[at] = _columns(data[begin[at][:, None] + np.arange(n)], out[at])
        return out

    head = np.where(length > COLUMNS, length % COLUMNS, length)
    register = registers(begin, head, 0xFFFFFFFF)
    long = np.flatnonzero(length > COLUMNS)
    if len(long):
        many = length[long] // COLUMNS
        first = np.concatenate([[0], np.cumsum(many)])
        places = np.repeat(begin[long] + head[long] - first[:-1] * COLUMNS, many) + np.arange(first[-1]) * COLUMNS
        own = registers(places, np.full(len(places), COLUMNS), 0)
        for k in range(int(many.max())):
            at = np.flatnonzero(many > k)
            r = register[long[at]]
            moved = _SKIP[0][r & 255] ^ _SKIP[1][r >> 8 & 255] ^ _SKIP[2][r >> 16 & 255] ^ _SKIP[3][r >> 24]
            register[long[at]] = moved ^ own[first[at] + k]
    return register ^ np.uint32(0xFFFFFFFF)


def feature_buckets(texts: list[bytes], buckets: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slabs of ``texts``: the bucket of each feature, the text it is in, and the number of words of each of ``texts``."""
    for slab in slabs(texts, GAP, *(() if most == 1 else (max(map(len, texts), default=1),))):
        raw = LOWER[slab.raw]
        begin, end = spans(raw, GAP)
        doc = slab.rows[np.searchsorted(slab.starts, begin, side="right") - 1]
        n_words = np.bincount(doc, minlength=len(texts))
        packed, offsets = gathered(np.append(raw, np.uint8(32)), begin, end - begin + 1)
        packed[offsets[1:] - 1] = 32  # one space behind each word
        for n in range(1, most + 1):
            whole = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
            length = offsets[whole + n] - 1 - offsets[whole]
            data, cuts = gathered(packed, offsets[whole], length)
            held = pa.Array.from_buffers(pa.large_binary(), len(whole), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
            at = np.frombuffer(held.dictionary.buffers()[1], dtype=np.int64)[: len(held.dictionary) + 1]
            content = held.dictionary.buffers()[2]
            distinct = crc32s(np.frombuffer(content, dtype=np.uint8) if content and at[-1] else np.zeros(0, dtype=np.uint8), at[:-1], np.diff(at)) % np.uint32(buckets) if len(whole) else np.zeros(0, dtype=np.uint32)
            yield distinct.astype(np.int64)[held.indices.to_numpy()], doc[whole], n_words if n == 1 else np.zeros_like(n_words)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = 10_000, most: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task adds up its own; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in ranges(batch.num_rows, SLICE):
                for bucket, _, _ in feature_buckets(texts_of(batch.column(0)[part]), buckets, most):
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in df.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of each bucket's smoothed share of the target and of the raw corpus, floored."""
    ratio = (target + 1.0) * (float(raw.sum()) + len(raw)) / ((raw + 1.0) * (float(target.sum()) + len(raw)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 1) -> DataFrame:
    """``id_col, n_words, n_features, weight``: the floored mean gain of each text's features, 0 where it has none."""
    sent = df.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            for part in ranges(batch.num_rows, SLICE):
                texts = texts_of(batch.column(1)[part])
                words, n, total = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
                for bucket, doc, n_words in feature_buckets(texts, len(gain), most):
                    words += n_words
                    n += np.bincount(doc, minlength=len(texts))
                    np.add.at(total, doc, gain[bucket])
                mean = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(words), pa.array(n), pa.array(mean)], names=["id", "n_words", "n_features", "weight"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return out.withColumnRenamed("id", id_col)


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, most: int = 1, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """Every row's ``id_col, n_features, weight, score, rank``; ``rank`` counts the rows drawn and is null for the others.

    Features are all runs of 1 to ``most`` words (ASCII letters lower-cased, digits, everything beyond ASCII). Of the
    rows with ``least_words`` words, the ``percent`` percent (rounded down) with the highest score are drawn, ties to
    the smaller id. A null text counts as empty; a row without an id has no score and is never drawn; rows that repeat
    an id are scored each for itself (their noise is the same). Other columns are dropped, an empty table gives an
    empty result, an empty target makes every bucket equally likely there. Texts are read whole; with ``most`` above 1
    a task holds the words of a whole text, else of a slab.
    """
    gain = gains(bucket_counts(df, text_col, buckets, most), bucket_counts(target, target_col, buckets, most))
    own = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((own + 0.5) / F.lit(4294967296.0))))
    scored = weights(df, gain, id_col, text_col, most).withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= least_words
    out = ranked(scored, [F.when(able, F.col("score")).desc_nulls_last(), F.col(id_col), F.col("n_features"), F.col("weight")])
    n = out.filter(able & F.col("score").isNotNull()).count()
    return out.select(id_col, "n_features", "weight", "score", F.when(able & F.col("score").isNotNull() & (F.col("rank") <= percent * n // 100), F.col("rank")).alias("rank"))
