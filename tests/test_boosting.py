"""Trees against a plain version that goes through all rows for every cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid.operators import boosting, models


def plain(x, y, model, options):
    """Margins of trees grown by the definition: best gain over features, cuts and sides of missing values."""
    margin = np.zeros(len(x))
    trees = []
    for _ in range(options.rounds):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, options.positive_weight, 1.0)
        g, h = (p - y) * w, p * (1 - p) * w
        made = []

        def grow(rows, depth):
            def worth(r):
                return g[r].sum() ** 2 / (h[r].sum() + options.penalty)

            best = None
            for j in range(x.shape[1]):
                for c in model.cuts[j]:
                    for left in (x[rows, j] <= c, (x[rows, j] <= c) | np.isnan(x[rows, j])):
                        a, b = rows[left], rows[~left]
                        if h[a].sum() < options.least_weight or h[b].sum() < options.least_weight:
                            continue
                        gain = worth(a) + worth(b) - worth(rows)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-7):
                            best = gain, j, float(c), a, b
            if best is None or depth == options.depth:
                margin[rows] += -options.rate * g[rows].sum() / (h[rows].sum() + options.penalty)
            else:
                made.append((depth, best[1], best[2]))
                grow(best[3], depth + 1)
                grow(best[4], depth + 1)

        grow(np.arange(len(x)), 0)
        trees.append(sorted(made))
    return margin, trees


def splits(tree, cuts):
    depth, out = {0: 0}, []
    for i, f in enumerate(tree.feature):
        if f >= 0:
            depth[tree.child[i]] = depth[tree.child[i] + 1] = depth[i] + 1
            out.append((depth[i], f, float(cuts[f][tree.cut[i]])))
    return sorted(out)


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return models.as_features(spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3), "v")


def test_trees_of_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 2)
    r = np.random.default_rng(1)
    x = r.normal(size=(1000, 3))
    x[r.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) * 2 + np.nan_to_num(x[:, 1], nan=1.5) ** 2 + r.normal(size=1000) > 1.5).astype(int)
    options = boosting.SecondOrder(rounds=5, depth=3, subsample=1.0, bins=20)
    fitted = options.fit(frame(spark, x, y))
    margin, trees = plain(x, y, fitted, options)
    assert [splits(t, fitted.cuts) for t in fitted.trees] == trees
    assert np.abs(fitted.margin(x) - margin).max() < 1e-9
    scored = {r.id: r.p for r in models.score(fitted, frame(spark, x, y), "p").collect()}
    assert [scored[i] for i in range(1000)] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_one_class_missing_features_and_no_rows(spark):
    x = np.array([[1.0, np.nan], [2.0, np.nan], [3.0, np.nan]] * 10)
    fitted = boosting.SecondOrder(rounds=3).fit(frame(spark, x, np.ones(30)))
    p = [r.p for r in models.score(fitted, frame(spark, x, np.ones(30)), "p").collect()]
    assert min(p) > 0.5 and all(t.feature == [-1] for t in fitted.trees)
    with pytest.raises(ValueError, match="no rows"):
        boosting.SecondOrder().fit(frame(spark, x, np.ones(30)).where("id < 0"))


def test_samples_rows_alike_on_every_run(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 2))
    df = frame(spark, x, x[:, 0] > 0).coalesce(1).orderBy("id")
    a, b = (boosting.SecondOrder(rounds=3, depth=2, subsample=0.5).fit(df) for _ in range(2))
    assert [splits(t, a.cuts) for t in a.trees] == [splits(t, b.cuts) for t in b.trees]
    assert np.allclose(a.margin(x), b.margin(x))
