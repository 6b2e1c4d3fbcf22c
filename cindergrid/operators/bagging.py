"""Random forests: bagged trees of Gini splits on a random part of the features, grown by node and not by pass.

Features are cut into bins at approximate quantiles once; equal rows become one with a count, packed in blocks. A node of more than
``SMALL`` distinct rows is split from sums over all blocks, one pass a level for the nodes of all trees. The rows of a smaller
node go to one task, which grows all that is below it; so the passes depend on the levels above, and the rest is one shuffle of
rows by trees. What is grown there stays a table: rows are scored by a join with it, and the driver holds the upper nodes only.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, functions as F

from cindergrid.operators.boosting import binned
from cindergrid.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block, and distinct rows of a node that one task takes on.
ROWS, SMALL = 8192, 1 << 15
#: Nodes whose sums a pass, or a level in a task, holds at once.
MOST = 2048
#: Bins of a feature, as many as MLlib's.
BINS = 32
#: A split must gain more than this share of its node's weight, or it is rounding.
LEAST_GAIN = 1e-9
#: Probabilities are added up in steps of this part of one, so that sums don't depend on their order.
UNIT = 1 << 40


@dataclass
class Nodes:
    """Nodes of a tree, or of a part of one; ``feature`` is -1 at leaves, children lie next to each other, ``p`` is the share of class 1.

    ``group`` numbers the nodes that go on in a table of their own, and is -1 elsewhere."""

    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint8))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    p: np.ndarray = field(default_factory=lambda: np.zeros(1))
    group: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))

    def split(self, node: int, feature: int, cut: int) -> int:
        first = len(self.feature)
        self.feature[node], self.cut[node], self.child[node] = feature, cut, first
        for name, value in (("feature", -1), ("cut", 0), ("child", 0), ("p", 0), ("group", -1)):
            old = getattr(self, name)
            setattr(self, name, np.append(old, np.full(2, value, old.dtype)))
        return first

    def reached(self, bins: np.ndarray) -> np.ndarray:
        """The last node of each row."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[self.feature[at[rows]] >= 0]):
            here = at[rows]
            at[rows] = self.child[here] + (bins[rows, self.feature[here]] > self.cut[here])
        return at


def mixed(h: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def key(seed: int, tree: int, what: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, what]).integers(0, 1 << 63, 1, dtype=np.uint64)


def below_keys(keys: np.ndarray, right: np.ndarray | int) -> np.ndarray:
    """Keys of the nodes on one side below those of ``keys``: they depend on the way from the root only."""
    return mixed(keys + np.uint64(1) + np.asarray(right, np.uint64))


def times(hashes: np.ndarray, n: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often ``n`` equal rows are drawn for a tree: Poisson numbers of mean ``n``, which depend on the rows' hashes only."""
    h = mixed(hashes.view(np.uint64) ^ key(seed, tree, 0))
    share, out = (h >> np.uint64(11)) / float(1 << 53), np.zeros(len(n), np.int64)
    for mean in np.unique(n):
        some = np.flatnonzero(n == mean)
        if mean <= 64:
            k = np.arange(4 * int(mean) + 40)
            logs = k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])
            out[some] = np.searchsorted(np.cumsum(np.exp(logs)), share[some], side="right")
        else:
            out[some] = [np.random.default_rng(int(x)).poisson(mean) for x in h[some]]
    return out


def chosen(width: int, keys: np.ndarray) -> np.ndarray:
    """The features each node looks at: the square root of their number, rounded up, in an order drawn with them."""
    drawn = mixed(keys[:, None] ^ mixed(np.arange(1, width + 1, dtype=np.uint64)))
    return np.argsort(drawn, axis=1)[:, : math.ceil(math.sqrt(width))]


def sums(at: np.ndarray, features: np.ndarray, bins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of both classes and number of rows by node, chosen feature and bin, of rows at nodes ``at``."""
    nodes, k = features.shape
    cell = ((at[:, None] * k + np.arange(k)) * BINS + bins[np.arange(len(at))[:, None], features[at]]).ravel()
    length = nodes * k * BINS
    parts = [np.bincount(cell, np.repeat(v, k), length) for v in (weight * (y == 0), weight * (y == 1))]
    return np.stack([*parts, np.bincount(cell, minlength=length)], 1).reshape(nodes, k, BINS, 3)


def best(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the best feature, its cut, and the gain times the weight for each node; a gain of 0 is none.

    Gains that differ by rounding only count as equal: the feature drawn first, then the lowest cut wins. In small nodes many are
    equal, so an order by number would favour the first features."""
    left = np.cumsum(total, 2)
    whole = left[:, :, -1:]
    left = left[:, :, :-1]
    right = whole - left

    def purity(s):
        return (s[..., 0] ** 2 + s[..., 1] ** 2) / np.maximum(s[..., 0] + s[..., 1], 1e-300)

    gain = np.where((left[..., 2] > 0) & (right[..., 2] > 0), purity(left) + purity(right) - purity(whole), 0.0).reshape(len(total), -1)
    weight = whole[:, 0, 0, :2].sum(1)
    top = gain.max(1)
    place = np.argmax(gain >= (top - LEAST_GAIN * weight)[:, None], axis=1)
    return place // (BINS - 1), place % (BINS - 1), np.where(top > LEAST_GAIN * weight, top, 0.0)


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, root: np.ndarray) -> tuple[Nodes, np.ndarray]:
    """A tree of at most ``depth`` levels of splits on these rows below the key ``root``, and the gain of each feature."""
    gains, levels, first = np.zeros(bins.shape[1]), [], 0
    rows, at, size = np.arange(len(y)), np.zeros(len(y), np.int64), 1
    keys = root
    while size:
        both = np.bincount(at * 2 + y[rows], weight[rows], 2 * size).reshape(-1, 2)
        feature, cut, child = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size, np.int32)
        impure = np.flatnonzero(both.min(1) > 0) if len(levels) < depth else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        for a in range(0, len(impure), MOST):
            part = impure[a : a + MOST]
            some = order[np.searchsorted(at[order], part[0]) : np.searchsorted(at[order], part[-1], "right")]
            place = np.full(size, -1)
            place[part] = np.arange(len(part))
            some = some[place[at[some]] >= 0]
            looked, r = chosen(bins.shape[1], keys[part]), rows[some]
            k, c, gain = best(sums(place[at[some]], looked, bins[r], y[r], weight[r]))
            hit = gain > 0
            feature[part[hit]], cut[part[hit]] = looked[np.arange(len(part)), k][hit], c[hit]
            np.add.at(gains, feature[part[hit]], gain[hit])
        inner = feature >= 0
        child[inner] = first + size + 2 * np.arange(inner.sum())
        levels.append((feature, cut, child, both[:, 1] / np.maximum(both.sum(1), 1e-300)))
        kept = inner[at]
        rows, at = rows[kept], at[kept]
        at = child[at] + (bins[rows, feature[at]] > cut[at]) - first - size
        first, size, keys = first + size, 2 * int(inner.sum()), below_keys(np.repeat(keys[inner], 2), np.tile([0, 1], int(inner.sum())))
    return Nodes(*(np.concatenate(x) for x in zip(*levels))), gains


def _packed(rows: DataFrame, cuts: list[np.ndarray], columns: list[str], kinds: list) -> DataFrame:
    """Blocks of the bins of ``x`` and of the other columns."""
    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            rest = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(k) for i, k in enumerate(kinds)]
            for a in range(0, len(x), ROWS):
                cut = slice(a, a + ROWS)
                yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in (binned(x[cut], cuts), *(r[cut] for r in rest))], ["bins", *columns])

    return rows.select("x", *columns).mapInArrow(run, ", ".join(f"{c} binary" for c in ("bins", *columns)))


def _numbers(df: DataFrame):
    """``x`` of the vectors, which must be there and finite."""
    x = vector_to_array("features")
    weak = F.col("features").isNull() | F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(weak, F.raise_error(F.lit("features must not be null, NaN or infinite"))).otherwise(x)


@dataclass
class Forest:
    """``fit`` takes a vector column ``features``, a label of 0 and 1 and a column ``weight``."""

    trees: int = 100
    depth: int = 30
    seed: int = 42
    label: str = "label"

    def fit(self, df: DataFrame) -> ForestModel:
        y = F.col(self.label).cast("double")
        checked = F.when(y.isNull() | ~y.isin(0.0, 1.0), F.raise_error(F.lit("labels must be 0 or 1"))).otherwise(y).cast("int")
        rows = df.select(_numbers(df).alias("x"), checked.alias("y"), F.col("weight").cast("double").alias("weight"))
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        width = first[0]
        cuts = self.cuts(rows, width)
        same = rows.groupBy("x", "y", "weight").agg(F.count("*").alias("n")).withColumn("hash", F.xxhash64("x", "y"))
        blocks = cut_lineage(_packed(same, cuts, ["y", "weight", "n", "hash"], [np.uint8, np.float64, np.int64, np.int64]))
        upper, gains, below = self._upper(blocks, width)
        parts = cut_lineage(self._lower(blocks, width, upper, below)) if below else None
        if parts is not None:
            for r in parts.groupBy("tree").agg(*[F.sum(F.col("gain")[j]).alias(f"g{j}") for j in range(width)]).collect():  # a row a tree
                gains[r.tree] += r[1:]
        return ForestModel(cuts, upper, parts, gains, len(below))

    def cuts(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Between all values of a feature that has few, else about as many rows in each bin."""
        shares = [i / BINS for i in range(1, BINS)]
        some = rows.agg(*[F.percentile_approx(F.col("x")[j], shares, 10_000).alias(f"c{j}") for j in range(width)],
                        *[F.approx_count_distinct(F.col("x")[j]).alias(f"n{j}") for j in range(width)]).first()
        few = [j for j in range(width) if some[width + j] <= BINS]
        values = rows.agg(*[F.collect_set(F.col("x")[j]) for j in few]).first() if few else []
        out = [np.unique(c) for c in some[:width]]
        for j, held in zip(few, values):
            v = np.unique(held)
            if len(v) <= BINS:
                out[j] = (v[1:] + v[:-1]) / 2
        return out

    def _upper(self, blocks: DataFrame, width: int) -> tuple[list[Nodes], np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """The nodes above those that one task takes on; of these, (tree, levels left, key)."""
        upper, gains, below = [Nodes() for _ in range(self.trees)], np.zeros((self.trees, width)), []
        total = blocks.agg(F.sum(F.octet_length("y"))).first()[0]
        nodes = [(t, 0, total, key(self.seed, t, 1)) for t in range(self.trees)]
        for level in range(self.depth + 1):
            large = []
            for t, node, n, own in nodes:
                if n <= SMALL or level == self.depth:
                    upper[t].group[node] = len(below)
                    below.append((t, self.depth - level, own))
                else:
                    large.append((t, node, own))
            nodes = []
            for a in range(0, len(large), MOST):
                part = large[a : a + MOST]
                looked = chosen(width, np.concatenate([own for *_, own in part]))
                found = self._sums(blocks, width, upper, part, looked)
                for (t, node, own), f, k, c, gain, held in zip(part, looked, *best(found), found):
                    both = held[0].sum(0)
                    if not gain:
                        upper[t].p[node] = both[1] / both[:2].sum()
                        continue
                    child, left = upper[t].split(node, int(f[k]), int(c)), held[k, : c + 1].sum(0)
                    gains[t, f[k]] += gain
                    for i, side in enumerate((left, held[k].sum(0) - left)):
                        nodes.append((t, child + i, int(side[2]), below_keys(own, i)))
        return upper, gains, below

    def _sums(self, blocks, width, upper, part, looked) -> np.ndarray:
        """:func:`sums` of the nodes ``part`` over all blocks."""
        at_tree = {}
        for i, (t, node, _) in enumerate(part):
            at_tree.setdefault(t, []).append((node, i))
        shape, seed = (*looked.shape, BINS, 3), self.seed
        trees = {t: upper[t] for t in at_tree}

        def run(batches):
            total = np.zeros(shape)
            for batch in batches:
                for block in zip(*(c.to_pylist() for c in batch.columns)):
                    bins, y, weight, n, h = _unpacked(block, width)
                    for t, held in at_tree.items():
                        place = np.full(len(trees[t].feature), -1)
                        place[[node for node, _ in held]] = [i for _, i in held]
                        at, drawn = place[trees[t].reached(bins)], times(h, n, seed, t)
                        some = (at >= 0) & (drawn > 0)
                        used, own = np.unique(at[some], return_inverse=True)
                        if len(used):
                            total[used] += sums(own, looked[used], bins[some], y[some], (weight * drawn)[some])
            flat = total.reshape(-1, 3)
            i = np.flatnonzero(flat[:, 2])
            yield pa.record_batch([pa.array(i, pa.int64()), *(pa.array(flat[i, c]) for c in range(3))], ["i", "a", "b", "n"])

        rows = blocks.mapInArrow(run, "i long, a double, b double, n double").groupBy("i").agg(*[F.sum(c).alias(c) for c in "abn"]).toArrow()
        out = np.zeros((int(np.prod(shape[:-1])), 3))
        out[rows["i"].to_numpy()] = np.column_stack([rows[c].to_numpy() for c in "abn"])
        return out.reshape(shape)

    def _lower(self, blocks: DataFrame, width: int, upper: list[Nodes], below: list[tuple[int, int, np.ndarray]]) -> DataFrame:
        """What is grown below the upper nodes, a row each."""
        seed = self.seed

        def deal(batches):
            for batch in batches:
                for block in zip(*(c.to_pylist() for c in batch.columns)):
                    bins, y, weight, n, h = _unpacked(block, width)
                    for t, nodes in enumerate(upper):
                        drawn = times(h, n, seed, t)
                        group = np.where(drawn > 0, nodes.group[nodes.reached(bins)], -1)
                        out = [(int(g), h[r].tobytes(), bins[r].tobytes(), y[r].tobytes(), (weight * drawn)[r].tobytes())
                               for g in np.unique(group[group >= 0]) for r in [np.flatnonzero(group == g)]]
                        if out:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], ["group", "hash", "bins", "y", "weight"])

        def grown(by, table):
            group = by[0].as_py()
            h, bins, y, weight = (np.frombuffer(b"".join(table.column(c).to_pylist()), k) for c, k in (
                ("hash", np.int64), ("bins", np.uint8), ("y", np.uint8), ("weight", np.float64)))
            order, (tree, depth, root) = np.argsort(h, kind="stable"), below[group]
            nodes, gains = grow(bins.reshape(-1, width)[order], y[order], weight[order], depth, root)
            return pa.table([pa.array([group], pa.int32()), pa.array([tree], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (
                nodes.feature, nodes.cut, nodes.child, nodes.p)), pa.array([gains.tolist()])], ["group", "tree", "feature", "cut", "child", "p", "gain"])

        dealt = blocks.mapInArrow(deal, "group int, hash binary, bins binary, y binary, weight binary")
        return _by_group(dealt, len(below)).groupBy("group").applyInArrow(
            grown, "group int, tree int, feature binary, cut binary, child binary, p binary, gain array<double>")


def _unpacked(block: tuple, width: int) -> tuple[np.ndarray, ...]:
    bins, *rest = (np.frombuffer(b, k) for b, k in zip(block, (np.uint8, np.uint8, np.float64, np.int64, np.int64)))
    return bins.reshape(-1, width), *rest


def _by_group(df: DataFrame, groups: int) -> DataFrame:
    """Few bytes are much work here, so the number of tasks is fixed by groups and cores."""
    return df.repartition(min(groups, 8 * df.sparkSession.sparkContext.defaultParallelism), "group")


@dataclass
class ForestModel:
    """``parts`` is the table of what lies below the nodes of ``upper`` that have a group; ``gains`` is by tree and feature."""

    bounds: list[np.ndarray]
    upper: list[Nodes]
    parts: DataFrame | None
    gains: np.ndarray
    groups: int

    @property
    def featureImportances(self) -> DenseVector:  # as MLlib names it
        shares = self.gains / np.maximum(self.gains.sum(1, keepdims=True), 1e-300)
        return Vectors.dense(shares.sum(0) / max(shares.sum(), 1e-300))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, a vector of both classes as other classifiers give it; the mean of the trees' leaves."""
        upper, width = self.upper, len(self.bounds)
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        blocks = _packed(rows.select(_numbers(rows).alias("x"), F.col("_row").alias("row")), self.bounds, ["row"], [np.int64])

        def deal(batches):
            for batch in batches:
                for packed, row in zip(*(c.to_pylist() for c in batch.columns)):
                    bins, row, known = np.frombuffer(packed, np.uint8).reshape(-1, width), np.frombuffer(row, np.int64), 0
                    for nodes in upper:
                        at = nodes.reached(bins)
                        group, known = nodes.group[at], known + np.where(nodes.group[at] < 0, np.rint(nodes.p[at] * UNIT), 0).astype(np.int64)
                        out = [(int(g), row[r].tobytes(), bins[r].tobytes()) for g in np.unique(group[group >= 0]) for r in [np.flatnonzero(group == g)]]
                        if out:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["group", "row", "bins"])
                    alone = -1 - int((row[0] // ROWS + (row[0] >> 33)) % (1 << 20))  # any number below 0; they spread over tasks
                    yield pa.record_batch([pa.array([alone], pa.int32()), pa.array([row.tobytes()], pa.binary()), pa.array([known.tobytes()], pa.binary())], ["group", "row", "bins"])

        def value(batches):
            for batch in batches:
                for group, row, packed, *nodes in zip(*(c.to_pylist() for c in batch.columns)):
                    if group < 0:
                        found = np.frombuffer(packed, np.int64)
                    else:
                        own = Nodes(*(np.frombuffer(b, k) for b, k in zip(nodes, (np.int32, np.uint8, np.int32, np.float64))))
                        found = np.rint(own.p[own.reached(np.frombuffer(packed, np.uint8).reshape(-1, width))] * UNIT).astype(np.int64)
                    yield pa.record_batch([pa.array(np.frombuffer(row, np.int64)), pa.array(found)], ["_row", "p"])

        dealt = blocks.mapInArrow(deal, "group int, row binary, bins binary")
        none = [F.lit(None).cast("binary").alias(c) for c in ("feature", "cut", "child", "p")]
        if self.parts is None:
            joined = dealt.select("*", *none)
        else:
            # Both sides grow with rows and trees, so the plan doesn't count on either being small.
            joined = _by_group(dealt, self.groups).hint("merge").join(self.parts.select("group", "feature", "cut", "child", "p"), "group", "left")
        summed = joined.mapInArrow(value, "_row long, p long").groupBy("_row").agg((F.sum("p") / float(UNIT * len(upper))).alias("_p"))
        return rows.join(cut_lineage(summed).hint("merge"), "_row").withColumn(
            "probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_row", "_p")
