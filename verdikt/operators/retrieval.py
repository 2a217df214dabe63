"""Nearest neighbours of vectors from an allowed pool, and votes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in one block of the pool (32 MB), the size of a pool (in numbers) that goes to every executor instead of
#: being dealt, queries of one part, and queries that are compared at once.
BLOCK_NUMBERS, SENT_NUMBERS, PART_ROWS, STEP = 4_000_000, 4_000_000, 100_000, 1024


def usable_vectors(df: DataFrame, vec: str = "embedding", width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Vectors that are present, finite, not zero and of the common width; and the ids of all others."""
    x = F.col(vec)
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    ok = F.coalesce(ok & (F.size(x) == width) if width else ok, F.lit(False))
    return df.filter(ok), df.filter(~ok).select("item_id")


class Pool:
    """Vectors of length one in order of their ids, and the best of them for queries."""

    def __init__(self, ids: list, vectors: np.ndarray):
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = np.array([ids[k] for k in order])
        self.unit = vectors[order] / np.linalg.norm(vectors[order], axis=1, keepdims=True)

    def best(self, queries: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its ``wanted`` best, ties to the smaller id: number of the query, ids, scores."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        for at in range(0, len(unit), STEP):
            scores = unit[at : at + STEP] @ self.unit.T
            for k, row in enumerate(scores):
                n = min(int(wanted[at + k]), len(row))
                if n < len(row):  # everything above the n-th value, then what equals it from the left
                    edge = np.partition(row, len(row) - n)[len(row) - n]
                    above, equal = np.flatnonzero(row > edge), np.flatnonzero(row == edge)
                    some = np.concatenate([above, equal[: n - len(above)]])
                else:
                    some = np.arange(len(row))
                yield at + k, self.ids[some], row[some]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def knn(queries: DataFrame, pool: DataFrame, duplicates: DataFrame | None = None, k: int = 3, vec: str = "embedding", drop_duplicates: bool = False) -> DataFrame:
    """Cosine top ``k`` of the pool for each query: ``item_id, rank, neighbor_id, score``.

    Pool members never are queries. Near-duplicates of a query (``left_id, right_id``) rank last with score -inf: with
    ``k`` as large as the pool they still appear, unless ``drop_duplicates``. Vectors must be usable and of one length.

    A pool of bounded size is sent to every executor and queries stream past it: they aren't shuffled at all. A larger
    one is dealt to blocks of bounded size and the queries to parts; a task holds one block and streams one part's
    queries past it in Arrow batches. A task keeps the best ``k`` of a block for each query, and as many more as the
    query has duplicates (a count that is combined before it moves; duplicates are never gathered by query); a window
    merges the blocks. A pair is never a row before that.
    """
    spark = queries.sparkSession
    kind = queries.schema["item_id"].dataType.simpleString()
    queries = queries.join(pool.select("item_id"), "item_id", "left_anti").select("item_id", F.col(vec).cast("array<double>").alias("v"))
    pool = pool.select(F.col("item_id").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    if duplicates is not None:
        duplicates = duplicates.select(F.col("left_id").alias("item_id"), F.col("right_id").alias("neighbor_id")).distinct()
        more = duplicates.groupBy("item_id").agg(F.count("*").alias("more"))
        left = queries.join(more, "item_id", "left").select("item_id", "v", (F.coalesce("more", F.lit(0)) + k).alias("wanted"))
    else:
        left = queries.withColumn("wanted", F.lit(k).cast("long"))
    held = pool.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = held["n"], held["width"] or 1
    schema = f"item_id {kind}, neighbor_id {kind}, score double, block long"

    def rows(ids: pa.Array, found: Iterator[tuple[int, np.ndarray, np.ndarray]], block: int) -> Iterator[pa.RecordBatch]:
        got = list(found)
        if got:
            many = np.array([len(i) for _, i, _ in got])
            at = np.repeat(np.array([q for q, _, _ in got]), many)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(np.concatenate([i for _, i, _ in got]), ids.type), pa.array(np.concatenate([s for _, _, s in got])), pa.array(np.full(len(at), block))], names=["item_id", "neighbor_id", "score", "block"])

    if n * width <= SENT_NUMBERS:
        got = pool.collect()
        sent = spark.sparkContext.broadcast(Pool([r["id"] for r in got], np.array([r["v"] for r in got], dtype=np.float64).reshape(n, width)) if n else None)

        def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows if sent.value else 0, STEP):
                    part = batch.slice(at, STEP)
                    yield from rows(part.column(0), sent.value.best(_vectors(part.column(1), width), part.column(2).to_numpy()), 0)

        found = left.mapInArrow(past, schema)
    else:
        blocks, parts = -(-n * width // BLOCK_NUMBERS), max(1, -(-left.count() // PART_ROWS))
        deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
        each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        both = pool.select(F.lit(0).alias("kind"), F.col("id").alias("item_id"), "v", F.lit(0).cast("long").alias("wanted"), deal("id", blocks).alias("block")).withColumn("part", each(parts))
        both = both.unionByName(left.select(F.lit(1).alias("kind"), "item_id", "v", "wanted", deal("item_id", parts).alias("part")).withColumn("block", each(blocks)))
        dealt = both.repartition("block", "part").sortWithinPartitions("block", "part", "kind").select("block", "part", "kind", "item_id", "v", "wanted")

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each (block, part) the pool's rows come first; the queries behind them are never held."""
            here, ids, vectors, block = None, [], [], None
            for batch in batches:
                key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    if low == high:
                        continue
                    part, query = batch.slice(low, high - low), bool(key[low, 2])
                    if tuple(key[low, :2]) != here:
                        here, ids, vectors, block = tuple(key[low, :2]), [], [], None
                    if not query:
                        ids += part.column(3).to_pylist()
                        vectors.append(_vectors(part.column(4), width).copy())
                        continue
                    if block is None and ids:
                        block = Pool(ids, np.concatenate(vectors))
                    for at in range(0, part.num_rows if block else 0, STEP):
                        some = part.slice(at, STEP)
                        yield from rows(some.column(3), block.best(_vectors(some.column(4), width), some.column(5).to_numpy()), int(here[0]))

        found = dealt.mapInArrow(stream, schema)
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "neighbor_id"))
    if duplicates is not None:
        found = found.join(duplicates, ["item_id", "neighbor_id"], "left_anti")
        found = found.withColumn("rank", best("item_id", "block")).filter(F.col("rank") <= k)
        if not drop_duplicates:
            last = duplicates.join(pool.select(F.col("id").alias("neighbor_id")), "neighbor_id", "left_semi").join(queries.select("item_id"), "item_id", "left_semi")
            last = last.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("neighbor_id"))).filter(F.col("rank") <= k)
            found = found.select("item_id", "neighbor_id", "score").unionByName(last.select("item_id", "neighbor_id", F.lit(float("-inf")).alias("score")))
    return found.withColumn("rank", best("item_id")).filter(F.col("rank") <= k).select("item_id", "rank", "neighbor_id", "score")


def knn_vote(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """Majority label of each query's neighbours, ties to the label of the nearest, next to the query's own label."""
    named = neighbors.join(labels.select(F.col("item_id").alias("neighbor_id"), F.col("label").alias("n_label")), "neighbor_id")
    per = named.groupBy("item_id", "n_label").agg(F.count("*").alias("n"), F.min("rank").alias("near"))
    best = per.groupBy("item_id").agg(F.min_by("n_label", F.struct((-F.col("n")).alias("n"), F.col("near"))).alias("predicted"))
    return best.join(labels.select("item_id", "label"), "item_id")


def vote_accuracy(votes: DataFrame) -> DataFrame:
    """Queries that got a vote, and how many percent of those votes are the query's own label."""
    return votes.agg(F.count("*").alias("items"), (F.avg((F.col("predicted") == F.col("label")).cast("double")) * 100).alias("accuracy_pct"))


def neighbor_labels(neighbors: DataFrame, labels: DataFrame) -> DataFrame:
    """Each query's neighbours and their labels in order of nearness."""
    named = neighbors.join(labels.select(F.col("item_id").alias("neighbor_id"), "label"), "neighbor_id")
    lists = named.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "label"))).alias("s"))
    return lists.select("item_id", F.transform("s", lambda x: x["neighbor_id"]).alias("neighbors"), F.transform("s", lambda x: x["label"]).alias("labels"))
