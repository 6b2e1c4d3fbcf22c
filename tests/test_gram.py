import numpy as np
import pytest
from pyspark.ml.feature import PolynomialExpansion
from pyspark.sql import functions as F

from cindergrid.operators import gram, models


def frame(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, y double").repartition(4)


def some(n=300):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 2)) * [1.0, 30.0] + [1e6, -5.0]
    return x, 3 + x @ [2.0, -0.5] + r.normal(size=n)


def test_ridge_of_the_definition(spark):
    """Every penalty fitted on the rows of every four folds and measured on those of the fifth."""
    x, y = some()
    y = y + 40 * np.random.default_rng(4).normal(size=len(y))
    df = frame(spark, x, y)
    fold = {r.id: r.fold for r in models.with_fold(df, ["id"]).collect()}
    fold = np.array([fold[i] for i in range(len(x))])

    def fit(rows, alpha):
        m, my = x[rows].mean(0), y[rows].mean()
        w = np.linalg.solve((x[rows] - m).T @ (x[rows] - m) + alpha * np.eye(2), (x[rows] - m).T @ (y[rows] - my))
        return my - w @ m, w

    def error(alpha):
        each = []
        for f in range(5):
            b, w = fit(fold != f, alpha)
            each.append(np.sqrt(np.mean((y[fold == f] - b - x[fold == f] @ w) ** 2)))
        return np.mean(each)

    got = gram.ridge(df, ["a", "b"], "y", ["id"])
    assert got.alpha == min(gram.RIDGE_ALPHAS, key=error)
    b, w = fit(np.ones(len(x), bool), got.alpha)
    assert got.coefficients == pytest.approx(w, rel=1e-8) and got.intercept == pytest.approx(b, rel=1e-8)
    shown = got.transform(df).orderBy("id").select("prediction").toPandas().prediction.to_numpy()
    assert shown == pytest.approx(b + x @ w, rel=1e-9)


def test_large_means_and_missing_values(spark):
    x, y = some()
    df = frame(spark, x, y).unionByName(frame(spark, [[float("nan"), 1.0]], [1.0])).union(spark.createDataFrame([(0, None, 1.0, 1.0), (0, 1.0, 1.0, None)], "id long, a double, b double, y double"))
    got = gram.least_squares(df, ["a", "b"], "y")
    w, *_ = np.linalg.lstsq(np.column_stack([x - x.mean(0), np.ones(len(x))]), y, rcond=None)
    assert got.coefficients == pytest.approx(w[:2], rel=1e-7)


def test_terms_in_the_order_of_the_expansion(spark):
    df = spark.createDataFrame([(2.0, 3.0, 5.0)], "a double, b double, c double")
    for names in (["a"], ["a", "b"], ["a", "b", "c"]):
        for degree in (1, 2, 3):
            terms = gram.polynomial(gram.columns(df, names), degree)
            want = PolynomialExpansion(degree=degree, inputCol="v", outputCol="out").transform(models.as_features(df, names, "v")).first().out
            assert list(df.select(*[t.alias(f"t{i}") for i, t in enumerate(terms)]).first()) == want.toArray().tolist()


def test_repeated_and_constant_terms_and_no_rows(spark):
    df = spark.range(20).select((F.col("id") * 1.0).alias("a"), (F.col("id") * 1.0).alias("b"), F.lit(4.0).alias("c"), (F.col("id") * 3.0 + 1).alias("y"))
    got = gram.least_squares(df, ["a", "b", "c"], "y")
    assert got.coefficients == pytest.approx([1.5, 1.5, 0.0]) and got.intercept == pytest.approx(1)
    with pytest.raises(ValueError, match="no complete rows"):
        gram.least_squares(df.where("a < 0"), ["a"], "y")
