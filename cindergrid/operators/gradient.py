"""Boosted trees of first order, as MLlib's gradient boosting has them, trained for all folds by the same passes.

A model starts from a tree on labels of -1 and 1; every further tree is fitted to the negative gradient of the log loss
``2 log(1 + exp(-2 y F))`` and added times the rate. Trees split by the variance of at most 32 bins a feature. Rows travel as blocks
of bins, and a level of a tree is one pass for all models: a task sums weights and residuals by node, feature and bin, for the
lighter child of each node only, the other is what is left of its parent. What reaches the driver depends on models, nodes and
features, never on rows. Bins are cut once, on all rows given: a model left without a fold doesn't see its labels, but shares the cuts.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from cindergrid.operators.bagging import BINS, Forest, _numbers
from cindergrid.operators.boosting import Tree, binned
from cindergrid.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block, and trees between two writes of the margins.
ROWS, REFRESH = 1 << 15, 4
#: Rows worth a task.
LEAST_ROWS = 1 << 13
#: A split must lower the variance of its node by more than this.
LEAST_GAIN = 1e-9


def residuals(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree learns, of labels of -1 and 1; without a margin the labels."""
    return y if margin is None else 4 * y / (1 + np.exp(np.minimum(2 * y * margin, 700)))


def best_split(w: np.ndarray, g: np.ndarray) -> tuple[int, int] | None:
    """Feature and cut of the split that lowers the variance most, from weights and weighted residuals by feature and bin.

    Gains that differ by rounding only count as equal: the first feature, then the lowest cut wins."""
    left_w, left_g = np.cumsum(w, 1)[:, :-1], np.cumsum(g, 1)[:, :-1]
    whole_w, whole_g = w[0].sum(), g[0].sum()
    right_w, right_g = whole_w - left_w, whole_g - left_g
    some = (left_w > 0.5) & (right_w > 0.5)  # weights are 1 or more
    gain = np.where(some, left_g**2 / np.where(some, left_w, 1) + right_g**2 / np.where(some, right_w, 1) - whole_g**2 / whole_w, 0.0)
    top = gain.max()
    if not top > LEAST_GAIN * whole_w:
        return None
    f, cut = np.unravel_index(np.argmax(gain >= top - LEAST_GAIN * whole_w), gain.shape)
    return int(f), int(cut)


def bin_sums(bins: np.ndarray, pairs: np.ndarray, used: np.ndarray, slot: np.ndarray, w: np.ndarray, g: np.ndarray, slots: int) -> np.ndarray:
    """Weights and weighted residuals of the rows ``used`` by slot, feature and bin.

    ``pairs`` holds the bins of two features as one number. Many rows are summed by pairs, which halves the work a row; few by feature."""
    width = bins.shape[1]
    if len(used) < slots * BINS * BINS // 2:
        cell = ((slot[:, None] * width + np.arange(width)) * BINS + bins[used]).ravel()
        return np.stack([np.bincount(cell, np.repeat(v, width), slots * width * BINS) for v in (w, g)]).reshape(2, slots, width, BINS)
    out, at = np.empty((2, slots, 2 * len(pairs), BINS)), slot * BINS * BINS
    for j, p in enumerate(pairs):
        cell = p[used] + at
        for i, v in enumerate((w, g)):
            both = np.bincount(cell, v, slots * BINS * BINS).reshape(slots, BINS, BINS)
            out[i, :, 2 * j], out[i, :, 2 * j + 1] = both.sum(2), both.sum(1)
    return out[:, :, :width]


@dataclass
class GradientBoosted:
    """``fit`` takes a vector column ``features`` and a 0/1 label; defaults of the risk classifier."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 6
    subsample: float = 0.8
    positive_weight: float = 5.0
    seed: int = 42

    def fit(self, df: DataFrame, label: str = "label") -> GradientBoostedModel:
        return self.fit_without(df.withColumn("_none", F.lit(0)), "_none", [None], label)[0]

    def fit_without(self, df: DataFrame, fold: str, left_out: Sequence[int | None], label: str = "label") -> list[GradientBoostedModel]:
        """A model for each entry of ``left_out``, fitted on the rows of the other folds; None leaves out nothing."""
        y = F.col(label).cast("double")
        checked = F.when(y.isNull() | ~y.isin(0.0, 1.0), F.raise_error(F.lit("labels must be 0 or 1"))).otherwise(y).cast("int")
        rows = df.select(_numbers(df).alias("x"), checked.alias("y"), F.col(fold).cast("int").alias("fold"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        width, models = first[0], len(left_out)
        cuts = Forest().cuts(rows, width)

        def pack(batches):
            held = []
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                held.append((binned(x, cuts), *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int8) for i in (1, 2))))
                if sum(len(h[1]) for h in held) >= ROWS:
                    yield record(held)
                    held = []
            if held:
                yield record(held)

        def record(held):
            parts = [np.concatenate(h) for h in zip(*held)]
            return pa.record_batch([pa.array([len(parts[1])], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (
                *parts, np.zeros((models, len(parts[1])))))], ["n", "bins", "y", "fold", "margin"])

        even = rows.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // LEAST_ROWS))))
        table = cut_lineage(even.mapInArrow(pack, "n long, bins binary, y binary, fold binary, margin binary")
                            .withColumn("block", F.monotonically_increasing_id()))
        # Hundreds of short passes: without a query's plan each, they take a third of the time.
        blocks = table.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[list[Tree]] = [[] for _ in left_out]
        written = 0  # trees the margins hold
        try:
            for turn in range(self.rounds):
                fresh = [own[written:] for own in trees]  # only the trees that the margins lack go to the tasks
                if turn - written == REFRESH:
                    old, blocks = blocks, self._with_margins(blocks, fresh, written).persist(StorageLevel.MEMORY_AND_DISK)
                    blocks.count()
                    old.unpersist()
                    written, fresh = turn, [[] for _ in trees]
                for own, tree in zip(trees, self._grow(blocks, width, fresh, written, left_out, turn)):
                    own.append(tree)
        finally:
            blocks.unpersist()
        return [GradientBoostedModel(own, cuts, self.rate) for own in trees]

    def _margin(self, margin: np.ndarray, bins: np.ndarray, fresh: list[Tree], written: int) -> np.ndarray:
        return margin + sum((1.0 if i == 0 else self.rate) * t.values(bins) for i, t in enumerate(fresh, written))

    def _grow(self, blocks: RDD, width: int, fresh: list[list[Tree]], written: int, left_out: Sequence[int | None], turn: int) -> list[Tree]:
        """The next tree of every model."""
        new = [Tree() for _ in fresh]
        asked, sums, others = [(m, 0) for m in range(len(new))], {}, {}
        for level in range(self.depth):
            for at, found in zip(asked, self._sums(blocks, width, fresh, written, left_out, turn, new, asked)):
                sums[at] = found
            for (m, light), (other, parent) in others.items():
                sums[m, other] = parent - sums[m, light]
            asked, others, following = [], {}, {}
            for (m, node), (w, g) in sums.items():
                tree, total = new[m], w[0].sum()
                if level == 0:
                    tree.value[node] = g[0].sum() / total if total > 0 else 0.0
                split = best_split(w, g) if total > 0.5 else None
                if split is None:
                    continue
                f, cut = split
                tree.split(node, f, cut, False)
                child, weights = tree.child[node], (w[f, : cut + 1].sum(), w[f, cut + 1 :].sum())
                for i, part in enumerate((g[f, : cut + 1], g[f, cut + 1 :])):
                    tree.value[child + i] = part.sum() / weights[i]
                light = int(weights[1] < weights[0])
                asked.append((m, child + light))
                others[m, child + light] = child + 1 - light, np.stack([w, g])
            sums = following
            if not asked:
                break
        return new

    def _sums(self, blocks, width, fresh, written, left_out, turn, new, asked) -> np.ndarray:
        """Weights and weighted residuals by asked node, feature and bin."""
        own = {}
        for i, (m, node) in enumerate(asked):
            own.setdefault(m, []).append((node, i))
        def run(rows):
            total = np.zeros((2, len(asked), width, BINS))
            for n, bins, y, fold, margin, block in rows:
                bins, fold, margin = np.frombuffer(bins, np.uint8).reshape(n, -1), np.frombuffer(fold, np.int8), np.frombuffer(margin).reshape(-1, n)
                y = 2.0 * np.frombuffer(y, np.int8) - 1
                weight = np.where(y > 0, self.positive_weight, 1.0)
                second = bins[:, 1::2] if width % 2 == 0 else np.pad(bins[:, 1::2], ((0, 0), (0, 1)))
                pairs = np.ascontiguousarray((bins[:, ::2].astype(np.int64) * BINS + second).T)
                drawn = np.random.default_rng([self.seed, turn, block]).random(n) < self.subsample
                for m, held in own.items():
                    place = np.full(len(new[m].feature), -1)
                    place[[node for node, _ in held]] = np.arange(len(held))
                    used = np.flatnonzero(drawn if left_out[m] is None else drawn & (fold != left_out[m]))
                    slot = place[new[m].nodes(bins[used])]
                    used, slot = used[slot >= 0], slot[slot >= 0]
                    now = self._margin(margin[m][used], bins[used], fresh[m], written) if turn else None
                    w = weight[used]
                    total[:, [i for _, i in held]] += bin_sums(bins, pairs, used, slot, w, w * residuals(y[used], now), len(held))
            yield total.tobytes()

        found = np.zeros((2, len(asked), width, BINS))
        for part in blocks.mapPartitions(run).collect():
            found += np.frombuffer(part).reshape(found.shape)
        return np.moveaxis(found, 0, 1)

    def _with_margins(self, blocks: RDD, fresh: list[list[Tree]], written: int) -> RDD:
        def run(block):
            n, bins, y, fold, margin, number = block
            own = np.frombuffer(bins, np.uint8).reshape(n, -1)
            now = np.stack([self._margin(old, own, t, written) for old, t in zip(np.frombuffer(margin).reshape(-1, n), fresh)])
            return n, bins, y, fold, now.tobytes(), number

        return blocks.map(run)


@dataclass
class GradientBoostedModel:
    trees: list[Tree]
    cuts: list[np.ndarray]
    rate: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        return sum(((1.0 if i == 0 else self.rate) * t.values(bins) for i, t in enumerate(self.trees)), np.zeros(len(x)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, a vector of both classes as other classifiers give it."""
        def positive(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(np.minimum(-2 * self.margin(np.stack(x.to_numpy())), 700))) if len(x) else np.zeros(0))

        p = F.pandas_udf(positive, "double")(_numbers(df))
        return df.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_p")
