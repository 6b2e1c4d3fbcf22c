"""Clustering, classifiers and regressors: MLlib estimators with this project's defaults."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.operators.aggregates import with_class_weight
from cindergrid.operators.bagging import Forest
from cindergrid.operators.gram import ridge  # noqa: F401  a regressor like the others here
from cindergrid.operators.gradient import GradientBoosted
from cindergrid.operators.metrics import model_report
from cindergrid.operators.perceptron import Perceptron
from cindergrid.operators.sampling import with_fold

#: Jobs one call runs at the same time. A fit is hundreds of short jobs, most of whose time is scheduling.
AT_ONCE = 8


def together(jobs: Sequence[Callable]) -> list:
    """Results of independent ``jobs``, some of which run at the same time; the order is theirs."""
    with ThreadPool(min(AT_ONCE, len(jobs))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(job) for job in jobs], chunksize=1)


def as_features(df: DataFrame, columns: Sequence[str] | str, name: str = "features") -> DataFrame:
    """A vector column from numeric columns, or from one array column."""
    if isinstance(columns, str):
        return df.withColumn(name, array_to_vector(F.col(columns).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def cluster_cells(cell_days: DataFrame, k: int = 12, seed: int = 42, by: Sequence[str] = ("latitude", "longitude"),
                  name: str | None = None) -> DataFrame:
    """Cluster id of the coordinates as ``clusters_<k>``.

    Fits on distinct coordinates weighted by their number of rows, which gives the same objective as all
    rows at the size of the grid.
    """
    name = name or f"clusters_{k}"
    cells = as_features(cell_days.groupBy(*by).agg(F.count("*").cast("double").alias("_n")), list(by)).persist()
    try:
        model = KMeans(k=k, seed=seed, weightCol="_n", predictionCol=name).fit(cells)
    finally:
        cells.unpersist()
    return model.transform(as_features(cell_days, list(by))).drop("features")


def _score_column(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


class Weighted:
    """An estimator fitted with balanced class weights, or a fixed weight of the positive class."""

    def __init__(self, make: Callable[[DataFrame], Estimator], positive: float | None = None,
                 weighted: bool = True):
        self.make, self.positive, self.weighted = make, positive, weighted

    def fit(self, df: DataFrame, label: str = "label") -> Model:
        if self.positive is not None:
            df = df.withColumn("weight", F.when(F.col(label) == 1, self.positive).otherwise(1.0))
        elif self.weighted:
            df = with_class_weight(df, label)
        # Training passes over the rows many times; spilling partitions is fine, losing one recomputes it.
        df = df.persist()
        try:
            return self.make(df).fit(df)
        finally:
            df.unpersist()


def logistic(c: float = 1.0, max_iter: int = 1000, label: str = "label") -> Weighted:
    """Logistic regression, balanced weights; ``c`` is the inverse penalty over the summed loss."""
    return Weighted(lambda df: LogisticRegression(
        labelCol=label, weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * max(1, df.count())),
        standardization=False))


def forest(trees: int = 100, depth: int = 30, seed: int = 42, label: str = "label") -> Weighted:
    """Random forest, balanced weights; 30 levels stand in for no limit."""
    return Weighted(lambda df: Forest(trees, depth, seed, label))


def boosted(rounds: int = 100, rate: float = 0.1, depth: int = 6, subsample: float = 0.8,
            positive_weight: float = 5.0, seed: int = 42) -> GradientBoosted:
    return GradientBoosted(rounds, rate, depth, subsample, positive_weight, seed)


def perceptron(layers: Sequence[int] = (128, 64, 32), max_iter: int = 100, seed: int = 42,
               label: str = "label") -> Perceptron:
    """Dense network; it takes no weights, so balance the rows beforehand."""
    return Perceptron(tuple(layers), max_iter, seed, label=label)


def score(model: Model, df: DataFrame, name: str = "risk_score") -> DataFrame:
    """Probability of class 1 as ``name``; the model's other output columns are dropped."""
    return model.transform(df).withColumn("_score", _score_column()).select(
        *df.columns, F.col("_score").alias(name))


def importances(model: Model, names: Sequence[str], spark) -> DataFrame:
    """``feature, importance`` in descending order; one row per feature."""
    values = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def fold_models(estimator: Weighted, parts: DataFrame, left_out: Sequence[int | None], label: str = "label") -> list[Model]:
    """A model fitted without each fold of ``left_out``, None leaves out nothing; by the same passes where the estimator can."""
    if hasattr(estimator, "fit_without"):
        return estimator.fit_without(parts, "fold", left_out, label)

    def fitted(i: int | None) -> Model:
        return estimator.fit((parts if i is None else parts.filter(F.col("fold") != i)).drop("fold"), label)

    return together([partial(fitted, i) for i in left_out])


def held_out(fitted: Sequence[Model], parts: DataFrame, label: str = "label") -> DataFrame:
    """``fold, label, probability`` of every row, predicted by the model of its fold."""
    def scored(i: int, model: Model) -> DataFrame:
        rows = score(model, parts.filter(F.col("fold") == i), "probability")
        return rows.select("fold", F.col(label).alias("label"), "probability")

    return reduce(DataFrame.unionByName, together([partial(scored, i, model) for i, model in enumerate(fitted)]))


def out_of_fold(estimator: Weighted, df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 42,
                label: str = "label") -> DataFrame:
    """``fold, label, probability`` of every row, predicted by the model fitted without its fold."""
    parts = with_fold(df, keys, folds, seed)
    return held_out(fold_models(estimator, parts, range(folds), label), parts, label)


def cross_validate(estimator: Weighted, df: DataFrame, keys: Sequence[str], folds: int = 5, seed: int = 42,
                   label: str = "label") -> DataFrame:
    """One row of metrics averaged over folds."""
    scored = out_of_fold(estimator, df, keys, folds, seed, label)
    return model_report(scored.withColumn("model", F.lit("cv"))).drop("model")


def linear(df: DataFrame, features: Sequence[str] | str, label: str, degree: int = 1) -> Model:
    """Least squares on the features, or on their polynomial terms up to ``degree``."""
    data = as_features(df, features, "_base")
    expand = PolynomialExpansion(degree=degree, inputCol="_base", outputCol="features")
    return Pipeline(stages=[expand, LinearRegression(labelCol=label, solver="normal")]).fit(data)


def coefficients(model: Model, names: Sequence[str], spark) -> DataFrame:
    """``term, value`` of a linear model, with its intercept."""
    fitted = model.stages[-1] if hasattr(model, "stages") else model
    values = fitted.coefficients
    values = values.toArray() if hasattr(values, "toArray") else values
    rows = [("intercept", float(fitted.intercept)), *zip(names, map(float, values))]
    return spark.createDataFrame(rows, "term string, value double")
