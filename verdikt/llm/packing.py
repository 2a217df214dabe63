"""Packing token pieces into as few sequences as possible by minimum bin slack.

Pieces of one length are alike, so the search works on the histogram of lengths (as many entries as a sequence has
tokens) and the driver never sees a piece. A bin starts with the longest length left; subset-sum dynamic programming
over a bitset of the lengths still available finds the fullest combination that goes with it; that combination is
taken as often as the histogram allows and removed. Each round leaves less of some length than one such bin takes, so
the number of patterns is bounded by the sequence length and its logarithm. Pieces then look up their place by their number among the pieces of their length, which is counted per
bucket of a hash, so one common length is spread over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .tokens import ByteBpe

#: Rows of one length in one bucket, on average, when they are numbered: a common length is dealt to many.
BUCKET_ROWS = 2000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the lengths in ``counts`` that fills ``room`` best without passing it; longer lengths first.

    The bitset of reachable sums is kept after each length, and the way back takes as few of the later, shorter
    lengths as it must.
    """
    lengths = sorted((n for n in counts if n <= room and counts[n]), reverse=True)
    full, sums, layers = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        left = min(counts[n], room // n)
        take = 1
        while left > 0:  # powers of two of one length
            take = min(take, left)
            layers.append((n, take, sums))
            sums |= (sums << (n * take)) & full
            left -= take
            take *= 2
        if sums >> room & 1:
            break
    goal = sums.bit_length() - 1
    out: dict[int, int] = {}
    for n, take, before in reversed(layers):
        if not before >> goal & 1:
            out[n] = out.get(n, 0) + take
            goal -= n * take
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (lengths with how many of each, how many such bins); the number of bins may be large, the list is short."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        combo = fullest(left, capacity - longest)
        left[longest] += 1
        combo[longest] = combo.get(longest, 0) + 1
        times = min(left[n] // k for n, k in combo.items())
        out.append((combo, times))
        for n, k in combo.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def token_pieces(df: DataFrame, tokenizer: tuple[str, str, str], capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of ``capacity`` (the first takes what is left over).

    ``tokenizer``: paths of the tokenizer file and of its ranks, and the word pattern. Null texts count as empty. Other
    columns of ``df`` are dropped; rows that repeat an id are separate documents with pieces of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = ByteBpe(*tokenizer)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = coder.encode(text or "") + tail
                n = len(ids) // 4
                start, length = 0, n % capacity or capacity
                k = 0
                while start < n:
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(part), part if with_ids else None))
                    start, length, k = start + length, capacity, k + 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out.withColumnRenamed("id", id_col).drop(*[] if with_ids else ["ids"])


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every row gets a place, rows of a sequence follow one another without gaps.

    Lengths must lie in 1..capacity; rows with another or no length raise. Equal rows get places of their own. Columns
    may have any names; only a column that is already called ``sequence_id`` or ``offset`` gives way to the new one.
    """
    spark = pieces.sparkSession
    kept = [F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = stored(pieces.select(F.struct(*kept).alias("row"), F.col(f"`{length_col}`").cast("long").alias("n"), F.monotonically_increasing_id().alias("i")))
    by_length = rows.groupBy("n").agg(F.count("*").alias("c")).limit(capacity + 1).collect()
    if any(r["n"] is None or not 0 < r["n"] <= capacity for r in by_length):
        raise ValueError(f"a piece's length is not in 1..{capacity}")
    counts = {int(r["n"]): r["c"] for r in by_length}
    places, first_bin, taken = [], 0, dict.fromkeys(counts, 0)
    for combo, times in patterns(counts, capacity):
        at = 0
        for n, k in sorted(combo.items(), reverse=True):
            places.append((n, taken[n], taken[n] + k * times, k, first_bin, at))
            taken[n] += k * times
            at += n * k
        first_bin += times
    # Both tables' sizes depend on the capacity, not on the number of pieces.
    plan: dict[int, list[tuple]] = {n: [] for n in counts}
    for n, *entry in places:
        plan[n].append(tuple(entry))
    sent = spark.sparkContext.broadcast({n: np.array(sorted(p), dtype=np.int64) for n, p in plan.items()})
    parts = F.broadcast(spark.createDataFrame([(n, -(-c // BUCKET_ROWS)) for n, c in counts.items()], "n long, parts long"))
    rows = rows.join(parts, "n").withColumn("b", F.pmod(F.xxhash64("i"), F.col("parts")))
    sizes = rows.groupBy("n", "b").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("n", "b").orderBy("i")) - 1
    ranked = rows.withColumn("r", rank).join(sizes.select("n", "b", before.alias("before")), ["n", "b"]).select("row", "n", (F.col("r") + F.col("before")).cast("long").alias("r"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pattern of a piece is found by its number among the pieces of its length, by bisection."""
        for batch in batches:
            n, r = (batch.column(c).to_numpy() for c in (1, 2))
            sequence, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n).tolist():
                own = np.flatnonzero(n == length)
                low, _, k, first, at = sent.value[length].T
                hit = np.searchsorted(low, r[own], side="right") - 1
                within = r[own] - low[hit]
                sequence[own], offset[own] = first[hit] + within // k[hit], at[hit] + within % k[hit] * length
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    out = T.StructType([ranked.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, out).select("row.*", "sequence_id", "offset")
