"""Boosted trees of second order: histograms of gradient and curvature, Newton leaves with a penalty.

Features are cut into bins at approximate quantiles once. Rows travel as blocks: one byte a feature, label, and margin so far. A
level of a tree is one pass: every task sums gradient and curvature of the log loss by node, feature and bin, Spark adds up
these sums, and the splits are chosen from them; their number depends on nodes, features and bins, never on rows. Margins
are written every ``REFRESH`` trees; the trees since then are evaluated on the way.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from cindergrid.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bin of missing values; others are numbered from 0.
MISSING = 255
#: Trees between two writes of the margins.
REFRESH = 10
#: Rows of a block.
ROWS = 8192
#: A split must gain this much more than nothing.
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes in order of their making; ``feature`` is -1 at leaves, children of a node lie next to each other."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> None:
        self.feature[node], self.cut[node], self.missing_left[node], self.child[node] = feature, cut, missing_left, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.missing_left.append(False)
            self.child.append(0)
            self.value.append(0.0)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The last node each row of ``bins`` reaches."""
        feature, cut, left, child = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.child))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            b = bins[rows, np.maximum(feature[at], 0)]
            goes_left = np.where(b == MISSING, left[at], b <= cut[at])
            at = np.where(inner, child[at] + ~goes_left, at)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Number of cuts below each value; a value equal to a cut belongs to the lower bin."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(c, x[:, j], side="left"))
    return out


def best_splits(g: np.ndarray, h: np.ndarray, penalty: float, least_weight: float) -> list[tuple[int, int, bool] | None]:
    """Feature, cut and side of missing values for every node, or None; sums are by node, feature and bin.

    Gains that differ by rounding only count as equal: the first feature, then the lowest cut wins."""
    total_g, total_h = (s[:, :1].sum(2, keepdims=True) for s in (g, h))
    parent = total_g**2 / (total_h + penalty)
    gains = []
    for missing_left in (False, True):
        left_g, left_h = (np.cumsum(s[:, :, :MISSING], 2) + (s[:, :, MISSING:] if missing_left else 0.0) for s in (g, h))
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - parent
        gains.append(np.where((left_h >= least_weight) & (right_h >= least_weight), gain, -np.inf))
    every = np.stack(gains, 3)
    out: list[tuple[int, int, bool] | None] = []
    for gain, scale in zip(every, parent.ravel()):
        best = gain.max()
        if not best > LEAST_GAIN:
            out.append(None)
            continue
        f, cut, side = (int(v[0]) for v in np.nonzero(gain >= best - 1e-9 * max(abs(scale), abs(best))))
        out.append((f, cut, bool(side)))
    return out


def _unpack(n: int, bins: bytes, label: bytes, margin: bytes):
    return np.frombuffer(bins, np.uint8).reshape(n, -1), np.frombuffer(label, np.uint8), np.frombuffer(margin, np.float64)


@dataclass
class SecondOrder:
    """Defaults as the risk classifier uses them; ``fit`` takes a vector column ``features`` and a 0/1 label."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 6
    subsample: float = 0.8
    positive_weight: float = 5.0
    penalty: float = 1.0
    least_weight: float = 1.0
    bins: int = 255
    seed: int = 42

    def cuts(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        shares = [i / self.bins for i in range(1, self.bins)]

        def known(j: int):
            return F.nanvl(F.col("x")[j], F.lit(None).cast("double"))

        one = rows.agg(*[F.percentile_approx(known(j), shares, 20 * self.bins).alias(f"c{j}") for j in range(width)]).first()
        return [np.unique(c if c is not None else []) for c in one]

    def fit(self, df: DataFrame, label: str = "label") -> SecondOrderModel:
        rows = df.select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        width = first[0]
        cuts = self.cuts(rows, width)

        def pack(batches):
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                for at in range(0, len(y), ROWS):
                    b, part = binned(x[at : at + ROWS], cuts), y[at : at + ROWS]
                    yield pa.record_batch([pa.array([len(part)], pa.int64()), pa.array([b.tobytes()], pa.binary()), pa.array([part.tobytes()], pa.binary()),
                                           pa.array([np.zeros(len(part)).tobytes()], pa.binary())], ["n", "bins", "label", "margin"])

        schema = "n long, bins binary, label binary, margin binary"
        blocks = cut_lineage(rows.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()))
        trees: list[Tree] = []
        fresh: list[Tree] = []  # trees that the written margins don't hold yet
        for turn in range(self.rounds):
            if len(fresh) == REFRESH:
                blocks, fresh = cut_lineage(_with_margins(blocks, fresh)), []
            tree = self._grow(blocks, width, fresh, turn)
            trees.append(tree)
            fresh.append(tree)
        return SecondOrderModel(trees, cuts)

    def _grow(self, blocks: DataFrame, width: int, fresh: list[Tree], turn: int) -> Tree:
        tree, open_nodes = Tree(), [0]
        for level in range(self.depth + 1):
            g, h = self._sums(blocks, width, fresh, tree, open_nodes, turn)
            splits = best_splits(g, h, self.penalty, self.least_weight) if level < self.depth else [None] * len(open_nodes)
            following = []
            for node, found, node_g, node_h in zip(open_nodes, splits, g[:, 0].sum(1), h[:, 0].sum(1)):
                if found is None:
                    tree.value[node] = float(-self.rate * node_g / (node_h + self.penalty))
                else:
                    tree.split(node, *found)
                    following += [tree.child[node], tree.child[node] + 1]
            open_nodes = following
            if not open_nodes:
                break
        return tree

    def _sums(self, blocks, width, fresh, tree, open_nodes, turn) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature by open node, feature and bin."""
        shape = (len(open_nodes), width, MISSING + 1)
        place = np.full(len(tree.feature), -1)
        place[open_nodes] = np.arange(len(open_nodes))

        def run(batches):
            total = np.zeros((2, *shape))
            for batch in batches:
                for n, *packed, block in zip(*(c.to_pylist() for c in batch.columns)):
                    bins, y, margin = _unpack(n, *packed)
                    margin = margin + sum(t.values(bins) for t in fresh)
                    p = 1 / (1 + np.exp(-margin))
                    weight = np.where(y == 1, self.positive_weight, 1.0)
                    at = place[tree.nodes(bins)]
                    if self.subsample < 1:
                        at = np.where(np.random.default_rng([self.seed, turn, block]).random(n) < self.subsample, at, -1)
                    used = at >= 0
                    bins, at = bins[used], at[used]
                    for k, v in enumerate(((p - y) * weight, p * (1 - p) * weight)):
                        for j in range(width):
                            total[k, :, j] += np.bincount(at * (MISSING + 1) + bins[:, j], v[used], shape[0] * shape[2]).reshape(shape[0], shape[2])
            i = np.flatnonzero(total[1].ravel())
            yield pa.record_batch([pa.array(i, pa.int64()), pa.array(total[0].ravel()[i]), pa.array(total[1].ravel()[i])], ["i", "g", "h"])

        sums = blocks.select("n", "bins", "label", "margin", "block").mapInArrow(run, "i long, g double, h double")
        found = sums.groupBy("i").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros((2, int(np.prod(shape))))
        i = found["i"].to_numpy()
        out[0, i], out[1, i] = found["g"].to_numpy(), found["h"].to_numpy()
        return out[0].reshape(shape), out[1].reshape(shape)


def _with_margins(blocks: DataFrame, fresh: list[Tree]) -> DataFrame:
    def run(batches):
        for batch in batches:
            margins = []
            for n, *packed in zip(*(batch.column(c).to_pylist() for c in ("n", "bins", "label", "margin"))):
                bins, _, margin = _unpack(n, *packed)
                margins.append((margin + sum(t.values(bins) for t in fresh)).tobytes())
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


@dataclass
class SecondOrderModel:
    trees: list[Tree]
    cuts: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        return sum((t.values(bins) for t in self.trees), np.zeros(len(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, a vector of both classes as other classifiers give it."""
        def positive(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-self.margin(np.stack(x.to_numpy())))) if len(x) else np.zeros(0))

        p = F.pandas_udf(positive, "double")(vector_to_array("features"))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")
