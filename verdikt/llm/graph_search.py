"""Approximate nearest neighbours by inner product over robust-pruned directed graphs, one for each shard.

Rows are dealt to shards of bounded size by their vector's length and a hash of their id. In a shard, points are added
in growing batches: a greedy beam search over the graph so far proposes neighbours, relaxed distance pruning keeps a
diverse few, and reverse edges are pruned the same way. Queries stream past every shard of their length, beam
search finds candidates there, and a window merges the shards' nearest. Largest inner product is turned into smallest
distance by one more coordinate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .near_vectors import usable

#: Rows of a shard, on average.
SHARD_ROWS = 8192
#: Out-neighbours kept, beam while building, beam while searching, and how much longer an edge may be than a detour.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 64, 128, 1.2
#: Beam entries expanded in one step.
WIDTH = 4


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and squared distances of the ``beam`` nearest found for each query, nearest first."""
    n, q = len(points), len(queries)
    square, own = (points * points).sum(axis=1), (queries * queries).sum(axis=1)
    ids = np.full((q, beam), -1, dtype=np.int32)
    far = np.full((q, beam), np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = own + square[start] - 2 * (queries @ points[start])
    seen = np.zeros((q, n), dtype=bool)
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        open_far = np.where(done[live], np.inf, far[live])
        pick = np.argpartition(open_far, WIDTH - 1, axis=1)[:, :WIDTH] if beam > WIDTH else np.argsort(open_far, axis=1)
        ok = np.take_along_axis(open_far, pick, axis=1) < np.inf
        more = ok.any(axis=1)
        live, pick, ok = live[more], pick[more], ok[more]
        if not len(live):
            break
        rows = live[:, None]
        done[rows, pick] = True
        near = np.where(ok[:, :, None], graph[ids[rows, pick]], -1).reshape(len(live), -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[rows, np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        flat = near[r, c]
        seen[live[r], flat] = True
        d = np.full(near.shape, np.inf, dtype=np.float32)
        d[r, c] = own[live[r]] + square[flat] - 2 * np.einsum("ij,ij->i", queries[live[r]], points[flat])
        all_far = np.concatenate([far[live], d], axis=1)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_done = np.concatenate([done[live], ~fresh], axis=1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[live], ids[live], done[live] = (np.take_along_axis(a, best, axis=1) for a in (all_far, all_ids, all_done))
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)


def robust_prune(points: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Of each row's candidates (-1: none) at most ``degree``: the nearest left is kept and hides what lies closer to it."""
    cand = np.where(cand == of[:, None], -1, cand)
    vectors = points[np.maximum(cand, 0)]
    square = (vectors * vectors).sum(axis=2)
    centre = points[of]
    far = square + (centre * centre).sum(axis=1)[:, None] - 2 * np.einsum("ijk,ik->ij", vectors, centre)
    between = square[:, :, None] + square[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
    left = np.where(cand >= 0, far, np.inf)
    out = np.full((len(of), degree), -1, dtype=np.int32)
    at = np.arange(len(of))
    for k in range(degree):
        best = left.argmin(axis=1)
        ok = left[at, best] < np.inf
        if not ok.any():
            break
        out[ok, k] = cand[at[ok], best[ok]]
        hidden = relax * relax * between[at, best] <= far
        left[hidden & ok[:, None]] = np.inf
        left[at, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> tuple[np.ndarray, int]:
    """Neighbour lists (-1: none) over distinct points, and the point from which searches start."""
    n = len(points)
    graph = np.full((n, degree), -1, dtype=np.int32)
    centre = points.mean(axis=0)
    start = int(((points - centre) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = 1
    while at < n:
        new = order[at : at + max(16, min(512, at))]
        cand, _ = beam_search(points, graph, start, points[new], beam)
        graph[new] = robust_prune(points, new, cand, degree, relax)
        source = np.repeat(new, degree)
        target = graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        held = (graph[heads] >= 0).sum(axis=1)
        fits = held + count <= degree
        for h, f, c, k in zip(heads[fits], first[fits], count[fits], held[fits], strict=True):
            graph[h, k : k + c] = source[f : f + c]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(count[full], kind="stable")]
        for part in range(0, len(full), 128):
            some = full[part : part + 128]
            width = int(count[some].max())
            wide = first[some][:, None] + np.arange(width)
            more = np.where(np.arange(width) < count[some][:, None], source[np.minimum(wide, len(source) - 1)], -1)
            graph[heads[some]] = robust_prune(points, heads[some], np.concatenate([graph[heads[some]], more], axis=1), degree, relax)
        at += len(new)
    return graph, start


def _built(keep: int):
    def build(pdf: pd.DataFrame) -> tuple:
        """The shard's graph over distinct vectors. Of equal vectors the ``keep`` smallest ids stay: no more can be in a result."""
        pdf = pdf.sort_values("id", kind="stable")
        rows = np.array(pdf["vec"].tolist(), dtype=np.float64)
        distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
        ids = pdf["id"].to_numpy()
        by = np.argsort(inverse.ravel(), kind="stable")
        bounds = np.searchsorted(inverse.ravel()[by], np.arange(len(distinct) + 1))
        owners = [ids[by[bounds[k] : min(bounds[k + 1], bounds[k] + keep)]] for k in range(len(distinct))]
        lift = np.sqrt(np.maximum(pdf["largest"].iloc[0] - (distinct * distinct).sum(axis=1), 0.0))
        points = np.concatenate([distinct, lift[:, None]], axis=1).astype(np.float32)
        graph, start = build_graph(points)
        return distinct, points, graph, start, owners

    return build


def _searched(k: int):
    def search(index: tuple, queries: pd.DataFrame) -> pd.DataFrame:
        distinct, points, graph, start, owners = index
        out_q, out_v, out_s = [], [], []
        beam = min(len(points), max(SEARCH_BEAM, k + 1))
        for part in range(0, len(queries), 256):
            qs = np.array(queries["vec"].iloc[part : part + 256].tolist(), dtype=np.float64)
            found, _ = beam_search(points, graph, start, np.concatenate([qs, np.zeros((len(qs), 1))], axis=1).astype(np.float32), beam)
            for qid, q, hits in zip(queries["id"].iloc[part : part + 256], qs, found, strict=True):
                hits = hits[hits >= 0]
                score = distinct[hits] @ q
                best = np.argsort(-score, kind="stable")[: k + 1]
                ids = [owners[h] for h in hits[best]]
                v = np.concatenate(ids)
                s = np.repeat(score[best], [len(x) for x in ids])
                v, s = v[v != qid], s[v != qid]
                top = np.lexsort((v, -s))[:k]
                out_q.append(np.full(len(top), qid))
                out_v.append(v[top])
                out_s.append(s[top])
        return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return search


def _streamed(k: int):
    """Of each shard the rows come first and make its graph; the queries behind them stream past it and are never held."""
    build, search = _built(k + 1), _searched(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, index = None, [], None
        for pdf in batches:
            key = pdf[["size", "shard", "asking"]].to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                part, at = pdf.iloc[low:high], tuple(key[low, :2])
                if at != here:
                    here, held, index = at, [], None
                if not key[low, 2]:
                    held.append(part)
                    continue
                if index is None:
                    index, held = build(pd.concat(held)), []
                yield search(index, part)

    return run


def graph_neighbours(df: DataFrame, query_filter: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20) -> DataFrame:
    """The ``k`` nearest rows found, by largest inner product in double precision, for each row that ``query_filter`` picks.

    Returns ``query_id, rank, vec_id, score``, rank 1 the nearest, ties to the smaller id; the query's own row is never
    its candidate. Vectors are compared with those of their own length. All candidates come if there are fewer than
    ``k``. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without
    an id; rows that repeat an id count once (the smallest vector). Every row is indexed. An empty table gives no rows.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), query_filter.alias("asks")).filter("id is not null")
    base = base.filter(usable()).groupBy("id").agg(F.min("vec").alias("vec"), F.bool_or("asks").alias("asks"))
    base = stored(base.withColumn("size", F.size("vec")))
    lengths = base.groupBy("size").agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("largest"))
    # A row for each length: at most the square root of twice the number of all components.
    lengths = lengths.select("size", "largest", F.greatest(F.lit(1), F.bround(F.col("n") / SHARD_ROWS).cast("int")).alias("shards"))
    rows = base.join(F.broadcast(lengths), "size")
    own = rows.select("size", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int").alias("shard"), F.lit(0).alias("asking"), "id", "vec", "largest")
    asked = rows.filter("asks").select("size", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("asking"), "id", "vec", "largest")
    # A graph is used where it is built; only queries travel to every shard of their length.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(asked).repartition(n, "size", "shard").sortWithinPartitions("size", "shard", "asking", "id")
    merged = dealt.mapInPandas(_streamed(k), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
