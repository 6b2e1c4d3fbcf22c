"""Dense networks: MLlib's multilayer perceptron, with its start, loss and optimizer, trained by passes over packed blocks.

Equal rows become one with a weight, so the loss stays the sum over all rows. Rows travel as blocks of numbers; an evaluation is
one pass, in which every task sums loss and gradient with matrix products, and the driver holds one gradient a task, whose length
depends on the layers only. The trained weights go back into a model of MLlib, which scores and can be saved.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cindergrid.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block.
ROWS = 4096
#: Steps the optimizer remembers, and iterations without progress that end it.
MEMORY = 10
PATIENCE = 20


def _parts(w: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the matrix (outputs by inputs) and offsets of each layer, in MLlib's order."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((w[at : at + a * b].reshape((b, a), order="F"), w[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def loss_and_gradient(w: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of sigmoid layers under a softmax, and its gradient."""
    parts, outputs = _parts(w, layers), [x]
    for m, b in parts[:-1]:
        outputs.append(0.5 + 0.5 * np.tanh(0.5 * (outputs[-1] @ m.T + b)))
    m, b = parts[-1]
    z = outputs[-1] @ m.T + b
    z -= z.max(axis=1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows = np.arange(len(y))
    delta = np.exp(logs)
    delta[rows, y] -= 1
    delta *= weight[:, None]
    gradient = np.empty_like(w)
    for i, (gm, gb) in reversed(list(enumerate(_parts(gradient, layers)))):
        gm[...] = delta.T @ outputs[i]
        gb[...] = delta.sum(axis=0)
        if i:
            delta = (delta @ parts[i][0]) * outputs[i] * (1 - outputs[i])
    return float(-(weight * logs[rows, y]).sum()), gradient


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS; steps meet the Wolfe conditions, found by doubling and halving."""
    value, gradient = f(w)
    first, past, seen = value, deque(maxlen=MEMORY), deque([value], maxlen=PATIENCE)
    for _ in range(max_iter):
        if np.linalg.norm(gradient) <= max(tol * abs(value), 1e-8):
            break
        direction, scales = -gradient, []
        for s, t, r in reversed(past):
            scales.append(r * (s @ direction))
            direction = direction - scales[-1] * t
        if past:
            s, t, _ = past[-1]
            direction = direction * ((s @ t) / (t @ t))
        for (s, t, r), a in zip(past, reversed(scales)):
            direction = direction + (a - r * (t @ direction)) * s
        slope = gradient @ direction
        if not slope < 0:
            past.clear()
            direction, slope = -gradient, -(gradient @ gradient)
        step, low, high = 1.0 if past else 1 / np.linalg.norm(gradient), 0.0, np.inf
        for _ in range(30):
            at, there = f(w + step * direction)
            if not at <= value + 1e-4 * step * slope:
                high = step
            elif there @ direction < 0.9 * slope:
                low = step
            else:
                break
            step = 2 * low if high == np.inf else (low + high) / 2
        if not at < value:
            break
        s, t = step * direction, there - gradient
        if s @ t > 0:
            past.append((s, t, 1 / (s @ t)))
        w, value, gradient = w + s, at, there
        if len(seen) == PATIENCE and np.mean(seen) - value <= tol * first:
            break
        seen.append(value)
    return w


@dataclass
class Perceptron:
    """``layers`` are the hidden ones; ``fit`` takes a vector column ``features`` and a label of two classes."""

    layers: Sequence[int] = (128, 64, 32)
    max_iter: int = 100
    seed: int = 42
    tol: float = 1e-6
    label: str = "label"

    def fit(self, df: DataFrame, label: str | None = None) -> MultilayerPerceptronClassificationModel:
        label, x = label or self.label, vector_to_array("features")
        one = df.select(F.col("features"), F.lit(0.0).alias(label)).limit(1).persist()
        try:
            first = one.select(F.size(x)).first()
            if first is None:
                raise ValueError("no rows to learn from")
            layers = [first[0], *self.layers, 2]
            # Without iterations MLlib gives its start back, and later makes a model of the trained weights.
            shell = MultilayerPerceptronClassifier(labelCol=label, layers=layers, maxIter=0, seed=self.seed)
            blocks = cut_lineage(_packed(df.select(x.alias("x"), F.col(label).cast("double").alias("y"))))
            total = blocks.agg(F.sum("n")).first()[0]
            w = minimise(lambda w: _evaluate(blocks, layers, w, total), shell.fit(one).weights.toArray(), self.max_iter, self.tol)
            return shell.setInitialWeights(w.tolist()).fit(one)
        finally:
            one.unpersist()


def _packed(rows: DataFrame) -> DataFrame:
    """Distinct rows and how often each occurs, in blocks."""
    weak = F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0)
    checked = rows.withColumn("y", F.when(weak, F.raise_error(F.lit("labels must be 0 or 1"))).otherwise(F.col("y")).cast("int"))

    def pack(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            for at in range(0, len(y), ROWS):
                cut = slice(at, at + ROWS)
                yield pa.record_batch([pa.array([int(n[cut].sum())], pa.int64()), *[pa.array([v[cut].tobytes()], pa.binary()) for v in (
                    x.astype(np.float64), y.astype(np.int64), n.astype(np.float64))]], ["n", "x", "y", "weight"])

    return checked.groupBy("x", "y").agg(F.count("*").alias("n")).mapInArrow(pack, "n long, x binary, y binary, weight binary")


def _evaluate(blocks: DataFrame, layers: Sequence[int], w: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Mean loss over all rows and its gradient."""
    def run(batches):
        loss, gradient = 0.0, np.zeros_like(w)
        for batch in batches:
            for x, y, weight in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(x).reshape(-1, layers[0])
                a, g = loss_and_gradient(w, layers, x, np.frombuffer(y, np.int64), np.frombuffer(weight))
                loss, gradient = loss + a, gradient + g
        yield pa.record_batch([pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["loss", "gradient"])

    found = blocks.select("x", "y", "weight").mapInArrow(run, "loss double, gradient binary").collect()
    return sum(r.loss for r in found) / n, sum(np.frombuffer(r.gradient) for r in found) / n
