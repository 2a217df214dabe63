"""Helpers that several corpus operators share: stored intermediates, scores of whole texts, the row folds, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import forget, frees_shuffles, shared_folder, stored

__all__ = ["components", "fold_of", "forget", "free_name", "frees_shuffles", "ranked", "scored", "shared_folder", "stored"]

#: Texts that a task turns into Python strings at once.
SLICE = 128


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scored(docs: DataFrame, keep: list[str], text_col: str, name: str, task: Callable[[], Callable[[list[str]], object]]) -> DataFrame:
    """Columns ``keep`` of every row and the double ``name``, which ``task()``'s function gives for a list of texts.

    A task calls ``task`` once. Rows stay in Arrow and only a slice of texts at a time becomes Python strings (null as
    the empty text), so memory follows the slice; a text that is kept isn't sent twice. Columns go by position: no name
    of the table can clash.
    """
    held = keep.index(text_col) if text_col in keep else None
    ins = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if held is not None else [F.col(f"`{text_col}`")]))
    ins = ins.toDF(*[f"c{k}" for k in range(len(ins.columns))])
    at, width = len(keep) if held is None else held, len(keep)
    out = T.StructType([*ins.schema.fields[:width], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = task()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                scores = pa.array(score([t or "" for t in part.column(at).to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns[:width], scores], names=out.names)

    return ins.mapInArrow(run, out).toDF(*keep, name)


def fold_of(id_col: str, folds: int) -> Column:
    """``crc32(id as text) mod folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def ranked(df: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in ``order``, within each value of the columns ``group`` (not null).

    Rows are dealt by ranges of the whole order, so neither a large group nor the whole table meets in one task; what
    lies in earlier ranges is known from a count for each range and group.
    """
    by = group or []
    rows = stored(df)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stored(rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    forget(rows)
    sizes = dealt.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = dealt.join(sizes.select("_part", *by, "_first", before.alias("_before")), ["_part", *by])
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large-star and small-star steps.

    Returns ``node, component`` (the smallest node of its component) for every node that has a link. Each step is two
    map-side combined minima and a join, so a hub with many links is never gathered in one task. Every round is
    written to the shared folder, the one before it removed, and rounds end when the edge set no longer changes.
    """
    pairs = lambda d: d.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = stored(pairs(edges.select("a", "b")))
    said = lambda d: tuple(d.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = said(state)
    while before[0]:
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).union(state.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b")
        was, state = state, stored(pairs(small))
        forget(was)
        after = said(state)
        if after == before:
            break
        before = after
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
