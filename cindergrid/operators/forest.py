"""Nearest neighbours in many dimensions: a forest of random projections, exact among the rows visited.

In many dimensions the triangle inequality rules nothing out, so :func:`cindergrid.operators.neighbors.nearest`
compares all blocks. Here every tree halves the rows again and again at the median of a random direction. A query
descends each tree to the few leaves whose cutting planes it is nearest to and is compared with their rows only;
candidates of all trees are ranked by exact distance. The number of distances per query is bounded by
``trees * cells * leaves * leaf`` (see :func:`nearest_forest`), whatever the number of rows.

The upper levels of a tree are cut on a bounded sample; each of their cells is one group of rows, whose lower levels are
cut inside the task that searches it. Cells that hold more than ``block`` rows are cut again by a hash, so that neither
skew nor a poor sample gives a task more; many queries of one cell are cut into chunks.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from cindergrid.operators.neighbors import _matrix, _nearest_in_block, give_back, prepared
from cindergrid.session import cut_lineage

# Send this module's functions to the Python workers themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 16384
SAMPLE = 65536


class Tree:
    """Cuts of a full binary tree: one unit direction a level and one median a node, nodes in heap order."""

    def __init__(self, rows: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = depth
        self.directions = rng.normal(size=(depth, rows.shape[1]))
        # Differences of rows follow the directions in which they vary; the random part keeps distinct rows apart
        # where many have equal places on a difference, as among vectors of few values.
        for level in range(depth):
            a, b = rng.integers(0, len(rows), 2)
            length = np.sqrt(((rows[a] - rows[b]) ** 2).sum())
            if length > 0:
                self.directions[level] *= 0.05 / math.sqrt(rows.shape[1])
                self.directions[level] += (rows[a] - rows[b]) / length
        self.directions /= np.sqrt((self.directions**2).sum(axis=1, keepdims=True))
        self.cuts = np.zeros((1 << depth) - 1)
        places = rows @ self.directions.T
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            order = np.lexsort((places[:, level], node))
            ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
            middle = np.minimum((ends[:-1] + ends[1:]) // 2, len(rows) - 1)
            self.cuts[(1 << level) - 1 : (2 << level) - 1] = places[order[middle], level]
            node = 2 * node + self._right(places[:, level], node, level)

    def _right(self, place, node, level):
        return (place >= self.cuts[(1 << level) - 1 + node]).astype(np.int64)

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        places = rows @ self.directions.T
        node = np.zeros(len(rows), np.int64)
        for level in range(self.depth):
            node = 2 * node + self._right(places[:, level], node, level)
        return node

    def closest(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Up to ``width`` leaves per row, those reached by crossing the least squared distance to cutting planes."""
        places = rows @ self.directions.T
        node, cost = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1))
        for level in range(self.depth):
            gap = places[:, level, None] - self.cuts[(1 << level) - 1 + node]
            side = (gap >= 0).astype(np.int64)
            node = np.concatenate([2 * node + side, 2 * node + 1 - side], axis=1)
            cost = np.concatenate([cost, cost + gap**2], axis=1)
            if node.shape[1] > width:
                keep = np.argsort(cost, axis=1, kind="stable")[:, :width]
                node, cost = np.take_along_axis(node, keep, 1), np.take_along_axis(cost, keep, 1)
        return node


def search_cell(q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, leaf: int, leaves: int, seed: int):
    """Query rows, base rows and squared distances of the ``k`` nearest base rows in the ``leaves`` closest leaves."""
    tree = Tree(b, max(0, math.ceil(math.log2(len(b) / leaf))), seed)
    at, near = tree.home(b), tree.closest(q, leaves)
    order = np.argsort(at, kind="stable")
    base_ends = np.searchsorted(at[order], np.arange((1 << tree.depth) + 1))
    visits = near.ravel()
    visitors = np.argsort(visits, kind="stable")
    query_ends = np.searchsorted(visits[visitors], np.arange((1 << tree.depth) + 1))
    found = []
    for node in range(1 << tree.depth):
        mine = order[base_ends[node] : base_ends[node + 1]]
        asked = visitors[query_ends[node] : query_ends[node + 1]] // near.shape[1]
        if len(mine) and len(asked):
            r, c, d = _nearest_in_block(q[asked], b[mine], ids[mine], k)
            found.append((asked[r], mine[c], d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    r, c, d = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids[c], d, r))
    r, c, d = r[order], c[order], d[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], d[keep]


def nearest_forest(queries: DataFrame, base: DataFrame, k: int, id: str = "id", vector: str = "vector",
                   exclude_self: bool = False, trees: int = 8, cells: int = 4, leaves: int = 8, leaf: int = 64,
                   block: int = BLOCK, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``query_id, neighbour_id, distance, rank``: nearest base rows of each query among the leaves it visits.

    Every tree shows a query its ``cells`` closest cells of at most ``block`` rows and in each of them its ``leaves``
    closest leaves of about ``leaf`` rows. Distances and ranks are exact among those rows, ties by neighbour id;
    neighbours that no tree shows are missed, and a query whose leaves hold fewer than ``k`` rows gets fewer. More
    trees, cells or leaves find more. ``sample`` bounds the rows, chosen by hash, on which the upper cuts are fitted.
    Null vectors and ids are left out.
    """
    if min(trees, cells, leaves, leaf) < 1:
        raise ValueError("trees, cells, leaves and leaf must be at least 1")
    kk = k + 1 if exclude_self else k
    queries, points, asked = prepared(queries, base, kk, id, vector)
    n_points, n_asked = points.count(), asked.count()
    if n_points == 0:
        raise ValueError("no base rows")
    # Half full on average, so that uneven cells rarely need the second cut. At least 16 sampled rows decide a cut.
    depth = min(max(0, math.ceil(math.log2(2 * n_points / block))), max(0, int(math.log2(max(1, sample // 16)))))
    if depth:
        drawn = points.select("v").orderBy(F.xxhash64("v", F.lit(seed))).limit(sample).toPandas()["v"]
        upper = [Tree(_matrix(drawn), depth, seed + t) for t in range(trees)]
    else:
        upper = []

    @F.pandas_udf("array<struct<tree: int, cell: int>>")
    def homes(v: pd.Series) -> pd.Series:
        at = np.stack([t.home(_matrix(v)) for t in upper], axis=1)
        return pd.Series([[{"tree": t, "cell": int(c)} for t, c in enumerate(row)] for row in at])

    @F.pandas_udf("array<struct<tree: int, cell: int>>")
    def visits(v: pd.Series) -> pd.Series:
        near = [t.closest(_matrix(v), cells) for t in upper]
        return pd.Series([[{"tree": t, "cell": int(c)} for t, at in enumerate(near) for c in at[i]] for i in range(len(v))])

    everywhere = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.lit(0).alias("cell")))
    placed = points.withColumn("at", F.explode(homes("v") if upper else everywhere)).select("id", "v", "at.*")
    visiting = asked.withColumn("at", F.explode(visits("v") if upper else everywhere)).select("q", "v", "at.*")

    # A row of sizes for each cell in use: how many parts its rows and its queries are cut into.
    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tree", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sizes = cut_lineage(parts(placed, "subs").join(parts(visiting, "chunks"), ["tree", "cell"]))

    def spread(df: DataFrame, key: str, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        """Each row goes to one part of its own side, copied to all parts of the other side."""
        return df.join(sizes, ["tree", "cell"]).withColumns({
            own: F.pmod(F.xxhash64(key, F.lit(7)), F.col(own_parts)).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1))}).drop("subs", "chunks")

    left = spread(visiting, "q", "chunk", "chunks", "sub", "subs")
    right = spread(placed, "id", "sub", "subs", "chunk", "chunks")

    def match(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q": [], "neighbour_id": [], "d2": []})
        # Rows arrive in any order: sorting makes the tree, and so the result, the same on every run.
        b = b.sort_values("id")
        ids = b["id"].to_numpy()
        r, c, d = search_cell(_matrix(a["v"]), _matrix(b["v"]), ids, kk, leaf, leaves, seed + 1000 + int(key[0]))
        return pd.DataFrame({"q": a["q"].to_numpy()[r], "neighbour_id": ids[c], "d2": d})

    group = ["tree", "cell", "sub", "chunk"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(match, "q bigint, neighbour_id bigint, d2 double")
    once = found.groupBy("q", "neighbour_id").agg(F.min("d2").alias("d2"))
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "neighbour_id"))).filter(F.col("rank") <= kk)
    return give_back(queries, asked, best, k, exclude_self)
