"""The forest against a plain version that goes through all rows for every cut, and its work by the number of rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cindergrid.operators import bagging, models


def frame(spark, x, y):
    rows = [(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, v array<double>, label int").select("id", array_to_vector("v").alias("features"), "label")


def noise(spark, n):
    """Labels that no feature tells, so trees grow as deep as rows allow."""
    x = [(F.rand(i)).alias(f"x{i}") for i in range(4)]
    return spark.range(n, numPartitions=2).select("id", *x).select(
        "id", array_to_vector(F.array(*[f"x{i}" for i in range(4)])).alias("features"), (F.xxhash64("id") % 2 == 0).cast("int").alias("label"))


def scores(model, df):
    return {r.id: r.p for r in models.score(model, df, "p").collect()}


def plain(bins, y, weight, depth):
    """Share of class 1 of each row's leaf; of equal gains the first feature and the lowest cut."""
    def purity(r):
        w = weight[r].sum()
        return sum(weight[r][y[r] == k].sum() ** 2 for k in (0, 1)) / w

    out = np.zeros(len(y))

    def go(r, depth):
        found = None
        for j in range(bins.shape[1]):
            for c in range(bagging.BINS - 1):
                a, b = r[bins[r, j] <= c], r[bins[r, j] > c]
                if depth and len(a) and len(b):
                    gain = purity(a) + purity(b) - purity(r)
                    if gain > 1e-9 * weight[r].sum() and (found is None or gain > found[0] + 1e-9 * weight[r].sum()):
                        found = gain, a, b
        if found is None:
            out[r] = weight[r][y[r] == 1].sum() / weight[r].sum()
        else:
            go(found[1], depth - 1)
            go(found[2], depth - 1)

    go(np.arange(len(y)), depth)
    return out


@pytest.mark.parametrize("depth", [1, 3, 30])
def test_trees_by_definition(depth, monkeypatch):
    monkeypatch.setattr(bagging, "chosen", lambda width, keys: np.tile(np.arange(width), (len(keys), 1)))
    random = np.random.default_rng(5)
    bins, y, weight = random.integers(0, 8, (150, 2)).astype(np.uint8), random.integers(0, 2, 150), random.integers(1, 4, 150).astype(float)
    nodes, gains = bagging.grow(bins, y, weight, depth, bagging.key(1, 2, 3))
    assert np.allclose(nodes.p[nodes.reached(bins)], plain(bins, y, weight, depth))
    assert gains.sum() > 0


def test_jobs_do_not_grow_with_the_rows(spark):
    """Before, trees were grown by passes over all rows, and deeper trees took more of them."""
    scheduler, jobs = spark.sparkContext._jsc.sc().dagScheduler(), []
    for n in (300, 6_000):
        before = scheduler.numTotalJobs()
        models.forest(3).fit(noise(spark, n))
        jobs.append(scheduler.numTotalJobs() - before)
    assert jobs[0] == jobs[1]


def test_large_nodes_are_split_by_passes(spark, monkeypatch):
    """The same trees whether a task takes on nodes of at most 40 rows or the whole trees, and whatever the number of nodes of a pass."""
    random = np.random.default_rng(8)
    x = random.integers(0, 20, (500, 2))
    df = frame(spark, x, (x.sum(1) + random.integers(0, 9, 500) > 22)).repartition(3)
    whole = models.forest(4).fit(df)
    assert all(len(t.feature) == 1 for t in whole.upper)
    monkeypatch.setattr(bagging, "SMALL", 40)
    monkeypatch.setattr(bagging, "MOST", 3)
    cut = models.forest(4).fit(df.repartition(2))
    assert all(len(t.feature) > 1 for t in cut.upper)
    assert scores(cut, df) == pytest.approx(scores(whole, df), abs=1e-9)
    assert cut.featureImportances.toArray() == pytest.approx(whole.featureImportances.toArray())


def test_no_feature_is_favoured_by_its_place():
    """Of many features that split a small node equally well, any may be taken."""
    random = np.random.default_rng(3)
    gains = np.zeros(16)
    for t in range(300):
        gains += bagging.grow(random.integers(0, 32, (30, 16)).astype(np.uint8), random.integers(0, 2, 30), np.ones(30), 30, bagging.key(4, t, 1))[1]
    assert gains[:8].sum() == pytest.approx(gains[8:].sum(), rel=0.1)


def test_equal_rows_count(spark):
    df = frame(spark, [[0.0, 1.0]] * 90 + [[1.0, 1.0]] * 30, [0] * 60 + [1] * 30 + [1] * 30)
    model = models.forest(40).fit(df)
    got = scores(model, df)
    assert len(got) == 120 and got[0] == pytest.approx(1 / 3, abs=0.08) and got[119] == 1
    assert list(model.featureImportances.toArray()) == [1.0, 0.0]


def test_draws_are_poisson():
    hashes = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 20_000)
    for n in (1, 5, 100):
        drawn = bagging.times(hashes, np.full(len(hashes), n), 42, 3)
        assert drawn.mean() == pytest.approx(n, rel=0.03) and drawn.var() == pytest.approx(n, rel=0.06)


def test_one_class_and_rows_that_cannot_be_told_apart(spark):
    assert set(scores(models.forest(3).fit(frame(spark, [[1.0], [2.0]], [0, 0])), frame(spark, [[1.0]], [0])).values()) == {0.0}
    same = frame(spark, [[1.0]] * 4, [0, 1, 0, 1])
    model = models.forest(30).fit(same)
    assert scores(model, same)[0] == pytest.approx(0.5, abs=0.2) and model.featureImportances.toArray() == [0.0]


def test_weak_rows_are_refused(spark):
    for x, y in (([[float("nan")]], [1]), ([[float("inf")]], [1]), ([[1.0]], [2])):
        with pytest.raises(Exception, match="must"):
            models.forest(2).fit(frame(spark, x, y))
