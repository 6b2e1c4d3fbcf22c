"""The network against finite differences, and its passes by the rows they read."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from cindergrid.operators import models, perceptron


def test_gradient_is_that_of_the_loss():
    rng, layers = np.random.default_rng(1), [3, 4, 2]
    w, x, y, weight = rng.normal(size=26), rng.normal(size=(9, 3)), rng.integers(0, 2, 9), rng.integers(1, 5, 9).astype(float)
    _, gradient = perceptron.loss_and_gradient(w, layers, x, y, weight)
    for i, step in enumerate(np.eye(26) * 1e-6):
        up, down = (perceptron.loss_and_gradient(w + s, layers, x, y, weight)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def rows(spark, n):
    """A file of one row group; every 60 rows hold the same values again."""
    k = F.col("id") % 60
    return models.as_features(spark.range(n, numPartitions=1).select("id", F.array(k % 12 / 11.0, k % 5 / 4.0).alias("v"), (k % 12 > 8).cast("int").alias("label")), "v")


def test_passes_read_distinct_rows(spark, monkeypatch):
    """A hundred times the rows, all copies: as many rows in the blocks of every pass, whose weights are all rows."""
    held, real = [], perceptron._evaluate

    def watched(blocks, layers, w, n):
        if not held or held[-1][1] != n:
            held.append((sum(len(r.y) // 8 for r in blocks.select("y").collect()), n))
        return real(blocks, layers, w, n)

    monkeypatch.setattr(perceptron, "_evaluate", watched)
    fits = [models.perceptron((6, 4), 30).fit(rows(spark, n)).weights.toArray() for n in (60, 6000)]
    assert held == [(60, 60), (60, 6000)]
    assert fits[0] == pytest.approx(fits[1], rel=1e-3, abs=1e-3)


def test_no_worse_than_mllib(spark):
    """Same start and loss; after as many iterations the loss isn't above that of MLlib's own training."""
    df = rows(spark, 240)
    x, y = np.array([r.v for r in df.collect()]), np.array([r.label for r in df.collect()])

    def loss(w):
        return perceptron.loss_and_gradient(w, [2, 6, 4, 2], x, y, np.ones(len(y)))[0]

    own = models.perceptron((6, 4), 100).fit(df)
    theirs = MultilayerPerceptronClassifier(layers=[2, 6, 4, 2], maxIter=100, seed=42).fit(df)
    assert loss(own.weights.toArray()) <= loss(theirs.weights.toArray()) + 0.01 * len(y)
    assert models.score(own, df, "p").filter((F.col("p") >= 0.5).cast("int") != F.col("label")).count() == 0
