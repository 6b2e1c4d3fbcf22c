import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid.operators import gradient, models
from cindergrid.operators.gradient import GradientBoosted, best_split, bin_sums, residuals


def table(spark, n=600, dims=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id bigint, vector array<double>, label int")
    return x, y, models.as_features(rows, "vector")


@pytest.mark.parametrize("n,width", [(300, 4), (300, 5), (9000, 4), (9000, 5)])
def test_sums_hold_every_row(n, width):
    """Of few rows by feature, of many by pairs of features."""
    rng = np.random.default_rng(3)
    bins, slot, used = rng.integers(0, 32, (n, width)).astype(np.uint8), rng.integers(0, 4, n), np.arange(n)
    second = np.pad(bins[:, 1::2], ((0, 0), (0, width % 2)))
    w, g = np.ones(n), rng.normal(size=n)
    found = bin_sums(bins, (bins[:, ::2].astype(int) * 32 + second).T, used, slot, w, g, 4)
    for s in range(4):
        for j in range(width):
            at = bins[slot == s, j]
            assert found[0, s, j] == pytest.approx(np.bincount(at, minlength=32))
            assert found[1, s, j] == pytest.approx(np.bincount(at, g[slot == s], 32))


def test_split_lowers_the_variance_most():
    w, g = np.zeros((2, 32)), np.zeros((2, 32))
    w[0, [0, 5]], g[0, [0, 5]] = [2, 2], [-2, 2]
    w[1, [0, 1]], g[1, [0, 1]] = [3, 1], [-1, 1]
    assert best_split(w, g) == (0, 0)
    assert best_split(w, w * 0.5) is None


def test_first_tree_is_the_mean_of_labels_and_the_second_follows_the_gradient(spark):
    x, y, df = table(spark)
    fitted = GradientBoosted(rounds=2, depth=1, subsample=1.0, positive_weight=2.0).fit(df)
    s, weight = 2.0 * y - 1, np.where(y == 1, 2.0, 1.0)
    values = [t.values(gradient.binned(x, fitted.cuts)) for t in fitted.trees]
    for learned, value in ((s, values[0]), (residuals(s, values[0]), values[1])):
        for leaf in np.unique(value):
            at = value == leaf
            assert leaf == pytest.approx(np.average(learned[at], weights=weight[at]))
    p = {r.id: r.p for r in models.score(fitted, df, "p").collect()}
    assert [p[i] for i in range(len(y))] == pytest.approx(1 / (1 + np.exp(-2 * (values[0] + 0.1 * values[1]))))


def test_left_out_labels_change_nothing_and_all_models_share_the_passes(spark, monkeypatch):
    _, _, df = table(spark)
    parts = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    passes, real = [], GradientBoosted._sums
    monkeypatch.setattr(GradientBoosted, "_sums", lambda self, *a: passes.append(1) or real(self, *a))
    estimator = models.boosted(6, depth=3, subsample=1.0)
    fitted = estimator.fit_without(parts, "fold", [0, 1, 2, None])
    assert len(passes) <= 6 * 3
    flipped = parts.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    again = estimator.fit_without(flipped, "fold", [0, 1, 2, None])
    same = [[t.feature for t in a.trees] == [t.feature for t in b.trees] for a, b in zip(again, fitted)]
    assert same == [False, True, False, False]


def test_written_margins_are_those_of_the_trees(spark, monkeypatch):
    _, _, df = table(spark)
    fitted = []
    for refresh in (1, 50):
        monkeypatch.setattr(gradient, "REFRESH", refresh)
        fitted.append(models.boosted(7, depth=3).fit(df))
    assert [[t.feature for t in m.trees] for m in fitted][0] == [t.feature for t in fitted[1].trees]


def test_odd_width_and_odd_labels(spark):
    _, y, df = table(spark, dims=5)
    scored = models.score(models.boosted(10).fit(df), df, "p")
    assert scored.filter((F.col("p") >= 0.5).cast("int") != F.col("label")).count() < 30
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        models.boosted(1).fit(df.withColumn("label", F.lit(2)))
