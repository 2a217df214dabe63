"""Exact near-duplicate search among embedding vectors by dual traversal of cover trees.

Vectors are put into cells around pivots, as many as blocks are wanted, and cells into blocks of bounded size. Pairs of
cells whose covering radii rule links out are dropped before any vector moves. A cover tree with nested levels of
halving radii, from the whole sphere down, is built once for each block; both trees of a pair of blocks are traversed
at once, and node pairs too far apart for any link below them are pruned. What is left at the leaves is decided on the
exact cosine in double precision, so the links are exact whatever the pruning does. A pair of blocks gives the number
of links of each vector and the edges of a spanning forest, never its links one by one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: Rows a block holds on average; one task sees two blocks at once.
BLOCK_ROWS = 4096
#: Sampled rows for each pivot that is picked from them, and pivots at most: what the driver holds of the vectors.
PIVOT_SAMPLE, PIVOTS = 4, 4096
#: Links that a pair of blocks holds before it reduces them to a forest.
EDGES = 2_000_000
#: Pairs of children from which on a pair of nodes is a matrix product, and pairs gathered at once.
DENSE, GATHERED = 1 << 14, 1 << 16
#: Radius up to which a node counts as a point.
POINT = 1e-6
#: Slack of the pruning bounds against rounding. Decisions at the leaves use none.
SLACK = 1e-9


def usable(vec: str = "vec"):
    """Vectors that may link: not null, not empty, not zero, every component present and finite."""
    x = F.col(vec)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class CoverTree:
    """A cover tree over unit vectors, flat: node arrays in breadth-first order, children side by side.

    ``top`` is the covering radius below the root, the sphere's diameter; it halves from level to level, and a level
    that would not tell a node's points apart is passed over.
    """

    def __init__(self, units: np.ndarray, top: float = 2.0):
        self.units = units
        point, radius, span = [0], [0.0], [(0, 0)]
        todo = [(np.arange(len(units)), top)]
        at = 0
        while at < len(todo):
            members, scale = todo[at]
            todo[at] = (members[:0], scale)
            centre = point[at]
            near = _distances(units[members], units[centre : centre + 1])[:, 0]
            radius[at] = float(near.max())
            if len(members) > 1:
                reach = radius[at]
                while scale >= reach and scale > 1e-7:
                    scale /= 2
                owner = np.zeros(len(members), dtype=np.int64)
                centres = [centre]
                if scale <= 1e-7:  # as good as equal: every member is a leaf of its own
                    centres = members.tolist()
                    owner = np.arange(len(members))
                else:
                    while (far := int(near.argmax())) >= 0 and near[far] > scale:
                        d = _distances(units[members], units[members[far] : members[far] + 1])[:, 0]
                        closer = d < near
                        owner[closer] = len(centres)
                        near[closer] = d[closer]
                        owner[far], near[far] = len(centres), 0.0
                        centres.append(int(members[far]))
                span[at] = (len(point), len(point) + len(centres))
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(len(centres) + 1))
                for k, c in enumerate(centres):
                    point.append(c)
                    radius.append(0.0)
                    span.append((0, 0))
                    todo.append((members[order[bounds[k] : bounds[k + 1]]], scale))
            at += 1
        self.point, self.radius = np.array(point), np.array(radius)
        self.first, self.last = np.array([a for a, _ in span]), np.array([b for _, b in span])


def _forest(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest point that each of ``n`` points reaches by ``edges``."""
    low = np.arange(n)
    if not edges:
        return low
    a, b = np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges])
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, low):
            return low
        low = new[low]


def dual_links(x: CoverTree, y: CoverTree, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk two trees together: yields exact links as points of ``x`` and points of ``y``.

    With ``same`` both are one tree and each unordered pair of points comes once. Pairs of nodes wait in arrays: a pair
    with many children is a matrix product, the others are gathered and decided together.
    """
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    many = lambda t, k: np.maximum(t.last[k] - t.first[k], 1)
    begin = lambda t, k: np.where(t.last[k] > t.first[k], t.first[k], k)
    todo = [(np.array([0]), np.array([0]))]

    def least(own: np.ndarray | float, most: float) -> np.ndarray:
        """The least cosine at which nodes of radius ``own`` may hold links with any of radius ``most``."""
        reach = limit + SLACK + own + most
        return np.where(reach < 2.0, 1.0 - 0.5 * reach * reach, -2.0)

    def kept(r: np.ndarray, c: np.ndarray, cos: np.ndarray, twin: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Of node pairs those that may hold links, split into pairs to go on with and links. ``twin``: of one parent."""
        reach = limit + SLACK + x.radius[r] + y.radius[c]
        ok = (cos >= 1.0 - 0.5 * reach * reach) | (reach >= 2.0)
        if same:
            ok &= ~twin | (r <= c)
        r, c, cos = r[ok], c[ok], cos[ok]
        leaf = (x.last[r] == x.first[r]) & (y.last[c] == y.first[c])
        hit = leaf & (cos >= cosine)
        if same:
            hit &= x.point[r] != y.point[c]
        return r[~leaf], c[~leaf], (x.point[r[hit]], y.point[c[hit]])

    while todo:
        ps, qs = todo.pop()
        size = many(x, ps) * many(y, qs)
        for k in np.flatnonzero(size > DENSE):
            p, q = int(ps[k]), int(qs[k])
            rows, cols = (np.arange(b := int(begin(t, np.array([n]))[0]), b + int(many(t, np.array([n]))[0])) for t, n in ((x, p), (y, q)))
            step = max(1, 400_000 // len(cols))  # as much as a cache holds
            left, right = x.units[x.point[rows]], np.ascontiguousarray(y.units[y.point[cols]].T)
            own_r, own_c = x.radius[rows], y.radius[cols]
            wide_c, most_r, most_c = np.flatnonzero(own_c > POINT), own_r.max(), own_c.max()
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                cos = left[at : at + step] @ right
                # Nearly all nodes are points: one bound for all of them, then the few that have a radius on their own.
                wide_r = np.flatnonzero(own_r[at : at + step] > POINT)
                near = cos >= float(least(POINT, POINT))
                if len(wide_r):
                    near[wide_r] |= cos[wide_r] >= least(own_r[at + wide_r], most_c)[:, None]
                if len(wide_c):
                    near[:, wide_c] |= cos[:, wide_c] >= least(own_c[wide_c], most_r)
                r, c = np.divmod(np.flatnonzero(near), len(cols))
                r_, c_, links = kept(part[r], cols[c], cos[r, c], np.full(len(r), same and p == q))
                if len(links[0]):
                    yield links
                if len(r_):
                    todo.append((r_, c_))
        few = np.flatnonzero(size <= DENSE)
        sums = np.cumsum(size[few])
        for at in np.split(few, np.searchsorted(sums, np.arange(GATHERED, int(sums[-1]) if len(sums) else 0, GATHERED))) if len(few) else ():
            if not len(at):
                continue
            n, wide = size[at], many(y, qs[at])
            own = np.repeat(np.arange(len(at)), n)
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            r, c = begin(x, ps[at])[own] + place // wide[own], begin(y, qs[at])[own] + place % wide[own]
            cos = np.einsum("nd,nd->n", x.units[x.point[r]], y.units[y.point[c]])
            r_, c_, links = kept(r, c, cos, (ps[at] == qs[at])[own] if same else np.zeros(len(r), dtype=bool))
            if len(links[0]):
                yield links
            if len(r_):
                todo.append((r_, c_))


def _block_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rep", kind="stable")
    units = np.array(pdf["vec"].tolist(), dtype=np.float64)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    packed = pickle.dumps((pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), CoverTree(units)), protocol=5)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "tree": [packed]})


def _joined(edges: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges between ids as those of a forest that joins the same: one for an id at most."""
    if not edges:
        return []
    ends = [np.concatenate(side) for side in zip(*edges, strict=True)]
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    low = _forest(len(ids), [(at[: len(ends[0])], at[len(ends[0]) :])])
    own = np.flatnonzero(low != np.arange(len(ids)))
    return [(ids[low[own]], ids[own])]


def _pair_links(cosine: float):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:  # Spark bounds their bytes
            blocks, trees, others, mates = batch.columns
            for k in range(batch.num_rows):
                yield blocks[k].as_py(), trees[k].as_buffer(), others[k].as_py(), mates[k].as_buffer()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted link counts of the vectors of all pairs of blocks a task sees, and edges that join what is linked: one for a vector at most."""
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        forest: list[tuple[np.ndarray, np.ndarray]] = []
        block, own = None, (None, None, None)
        for at_x, tree, at_y, mate in pairs(batches):
            if at_x != block:
                block, own = at_x, pickle.loads(tree)
            same = at_x == at_y
            (ids_x, copies_x, x), (ids_y, copies_y, y) = own, own if same else pickle.loads(mate)
            behind = 0 if same else len(ids_x)  # where the other block's points begin
            ids = ids_x if same else np.concatenate([ids_x, ids_y])
            count, edges, held = np.zeros(len(ids), dtype=np.int64), [], 0
            for rows, cols in dual_links(x, y, same, cosine):
                np.add.at(count, rows, copies_y[cols])
                np.add.at(count, behind + cols, copies_x[rows])
                edges.append((rows, behind + cols))
                held += len(rows)
                if held > EDGES:
                    low = _forest(len(ids), edges)
                    edges = [(low[kept := np.flatnonzero(low != np.arange(len(ids)))], kept)]
                    held = len(kept)
            low = _forest(len(ids), edges)
            kept = np.flatnonzero(low != np.arange(len(ids)))
            forest.append((ids[low[kept]], ids[kept]))
            if sum(len(e) for e, _ in forest) > EDGES:
                forest = _joined(forest)
            for k, names, part in ((at_x, ids_x, count[: len(ids_x)]), *(() if same else ((at_y, ids_y, count[len(ids_x) :]),))):
                counts[k] = names, counts[k][1] + part if k in counts else part
        told = [(names[at], names[at], count[at]) for names, count in counts.values() for at in [np.flatnonzero(count)]]
        told += [(low, kept, np.zeros(len(kept), dtype=np.int64)) for low, kept in _joined(forest)]
        for columns in told:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "n"])

    return links


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Links between vectors whose cosine is ``cosine`` or more, counted exactly, and their connected components.

    Returns ``id_col, n_links, component_id, kept`` with one row for each id. Vectors that are null, empty or zero, or
    that hold null or non-finite components, link with nothing. Vectors of different lengths never link. Rows without
    an id are left out; rows that repeat an id count once (the smallest vector, if they differ). Equal vectors are
    collapsed to one representative with its number of copies before anything is compared, so a large group of copies
    is one point. Other columns of ``df`` are ignored; an empty table gives an empty result.

    Trees are stored once. A task reads two parts of them and takes the blocks of the one past those of the other, so a
    tree is read as often as there are parts, but nothing is written for a pair of blocks: a task gives counts and a
    forest over the vectors it saw. In high dimension, where the distances of unrelated
    vectors concentrate and no exact bound can rule cells out, all pairs of blocks meet; inside a pair, the trees'
    upper levels still prune groups of near vectors as wholes.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("id is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    base = stored(base.select("id", F.when(usable(), F.col("vec")).alias("vec")))
    groups = stored(base.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    total = groups.count()
    wanted = int(min(PIVOTS, max(1, total // BLOCK_ROWS)))
    sample = groups.orderBy(F.xxhash64("rep"), "rep").limit(max(512, PIVOT_SAMPLE * wanted)).select("vec").collect()
    by_size: dict[int, np.ndarray] = {}
    for (v,) in sample:
        by_size.setdefault(len(v), []).append(v)
    for k, rows in by_size.items():
        units = np.array(rows) / np.linalg.norm(np.array(rows), axis=1, keepdims=True)
        chosen = [0]
        near = _distances(units, units[:1])[:, 0]
        while len(chosen) < min(wanted, len(units)):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, _distances(units, units[chosen[-1] :][:1])[:, 0])
        by_size[k] = units[chosen]

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, far = np.zeros(len(pdf), dtype=np.int64), np.full(len(pdf), 2.0)
            sizes = pdf["vec"].map(len).to_numpy()
            for k in np.unique(sizes):
                at = np.flatnonzero(sizes == k)
                if k in by_size:
                    rows = np.array(pdf["vec"].iloc[at].tolist())
                    d = _distances(rows / np.linalg.norm(rows, axis=1, keepdims=True), by_size[k])
                    cell[at], far[at] = d.argmin(axis=1), d.min(axis=1)
            yield pdf.assign(size=sizes, cell=cell, far=far)

    if total == 0:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    celled = stored(groups.select("rep", "copies", "vec").mapInPandas(to_cells, "rep long, copies long, vec array<double>, size long, cell long, far double"))
    cells = celled.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each pivot at most, and length
    cells = sorted((r["size"], r["cell"], r["far"], -(-r["n"] // BLOCK_ROWS)) for r in cells)
    size, cell, far, number = (np.array(c) for c in zip(*cells, strict=True))
    start = np.concatenate([[0], np.cumsum(number)])  # of each cell's blocks
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    spark = df.sparkSession
    pivots = [by_size[k][c].tolist() if (k := int(n)) in by_size else None for n, c in zip(size, cell, strict=True)]
    rows = [(int(n), int(c), float(f), int(a), int(parts), p) for n, c, f, a, parts, p in zip(size, cell, far, start, number, pivots, strict=False)]
    place = spark.createDataFrame(rows, "size long, cell long, far double, start int, parts int, pivot array<double>").withColumnsRenamed({"far": "reach"})
    block = F.col("start") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    parts = min(int(start[-1]), int(spark.conf.get("spark.sql.shuffle.partitions")))
    grown = celled.join(F.broadcast(place.drop("reach", "pivot")), ["size", "cell"]).select(block.alias("block"), "rep", "copies", "vec")
    trees = stored(grown.repartition(parts, "block").groupBy("block").applyInPandas(_block_tree, "block int, tree binary"))
    own = (F.col("start") <= F.col("block")) & (F.col("block") < F.col("start") + F.col("parts"))
    trees = trees.join(F.broadcast(place), own).select("block", "tree", "size", "reach", "pivot")
    mates = trees.toDF(*[f"{c}_" for c in trees.columns])
    # A cell's covering radius bounds its vectors. Not an equality: those would deal all blocks of a length to one task.
    apart = F.sqrt(F.aggregate(F.zip_with("pivot", "pivot_", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, x: t + x))
    near = F.col("pivot").isNull() | F.col("pivot_").isNull() | (apart <= F.col("reach") + F.col("reach_") + limit + 1e-6)
    meets = (F.col("block") <= F.col("block_")) & (F.abs(F.col("size") - F.col("size_")) < 1) & ((F.col("block") == F.col("block_")) | near)
    pairs = trees.join(mates.hint("shuffle_replicate_nl"), meets).select("block", "tree", "block_", "tree_")
    found = stored(pairs.mapInArrow(_pair_links(cosine), "a long, b long, n long"))
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.filter("n = 0").select("a", "b"))
    told = groups.select("vec", "rep", "copies").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    per_vec = told.select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.join(per_vec, "vec", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))
