"""Training, evaluation and scoring of fire-risk models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.operators.grid import CELL, CELL_DAY
from cindergrid.operators.metrics import model_report
from cindergrid.operators.models import Weighted, as_features, fold_models, held_out, score, together
from cindergrid.operators.neighbors import knn_classify
from cindergrid.operators.sampling import random_split, smote, with_fold
from cindergrid.operators.windows import flatten_window, lookback_samples, season_split
from cindergrid.session import cut_lineage


def samples(cell_days: DataFrame, features: Sequence[str], days: int = 14, horizon: int = 5,
            label: str = "is_fire_day", static: Sequence[str] = (), day=None) -> DataFrame:
    """One row per cell and start day: ``inputs`` (look-back features, then static columns), ``target``
    and ``target_date``."""
    out = lookback_samples(cell_days, features, days, horizon, label, day=day)
    flat = flatten_window(out, features, static)
    return as_features(flat.select(*CELL_DAY, "inputs", "target", "target_date"), "inputs").drop("inputs")


def score_days(model: Model, rows: DataFrame) -> DataFrame:
    """Score table ``date, cell, is_fire_day, risk_score``, dated by the predicted day."""
    scored = score(model, rows)
    return scored.select(F.col("target_date").alias("date"), *CELL, F.col("target").alias("is_fire_day"),
                         "risk_score")


def train_and_score(cell_days: DataFrame, features: Sequence[str], estimator: Weighted,
                    train_years: tuple[int, int], test_years: tuple[int, int] | int, days: int = 14,
                    horizon: int = 5, static: Sequence[str] = (), start_day: str = "02-24",
                    end_day: str = "09-25", day: Column | None = None) -> DataFrame:
    """Fit on the seasons of the train years and score every cell and day of the test seasons.

    ``day`` numbers the days of windows and horizons; pass ``windows.leapless_day()`` for tables without Feb 29."""
    rows = samples(cell_days, features, days, horizon, static=static, day=day)
    rows = season_split(rows, train_years, test_years, start_day, end_day)
    fitted = estimator.fit(rows.filter("split = 'train'").withColumnRenamed("target", "label"))
    return score_days(fitted, rows.filter("split = 'test'"))


def validation_days(days: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Season days split into training and validation; a day is never divided."""
    return random_split(days, ["date"], share, seed)


def knn_scores(queries: DataFrame, base: DataFrame, id: str, vector: str, label: str, k: int = 5) -> DataFrame:
    """``label, probability`` of the query rows by vote of their nearest base rows."""
    guessed = knn_classify(queries, base, k, id, vector, label)
    return guessed.join(queries.select(id, F.col(label).alias("label")), id).select("label", "probability")


def compare_models(df: DataFrame, id: str, vector: str, label: str, models: Mapping[str, Weighted],
                   folds: int = 5, seed: int = 42, balance: bool = True, neighbours: int | None = 5) -> DataFrame:
    """Report with a ``(CV)`` and a ``(Test)`` row per model.

    Rows are split 80/20, the train rows balanced with synthetic minority rows, every model is
    cross-validated on them and then fitted on all of them and evaluated on the held-out rows.
    """
    parts = random_split(df, [id], 0.2, seed)
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'").select(id, vector, label)
    if balance:
        grown = smote(train, id, vector, label, seed=seed)
        widest = grown.agg((F.max("copy") + 1).cast("bigint")).scalar()
        train = grown.withColumn("_n", widest).select(
            (F.col(id) * F.col("_n") + F.col("copy")).alias(id), vector, label)
    # Every fit reads the balanced rows again: keep them as a table.
    train = cut_lineage(train.select(id, vector, label))
    fit_rows, test_rows = as_features(train, vector), as_features(test, vector)
    scored = []

    def add(rows: DataFrame, name: str, fold: Column) -> None:
        scored.append(rows.select(F.lit(name).alias("model"), fold.cast("int").alias("fold"),
                                  F.col("label").cast("int"), "probability"))

    fit_parts = with_fold(fit_rows, [id], folds, seed)

    def scores(estimator: Weighted) -> tuple[DataFrame, DataFrame]:
        *parts, whole = fold_models(estimator, fit_parts, [*range(folds), None], label)
        return held_out(parts, fit_parts, label), score(whole, test_rows, "probability").withColumn("label", F.col(label))

    for name, (cross, held) in zip(models, together([partial(scores, estimator) for estimator in models.values()])):
        add(cross, f"{name} (CV)", F.col("fold"))
        add(held, f"{name} (Test)", F.lit(0))
    if neighbours:
        numbered = with_fold(train, [id], folds, seed)
        for i in range(folds):
            rest = numbered.filter(F.col("fold") != i)
            add(knn_scores(numbered.filter(F.col("fold") == i), rest, id, vector, label, neighbours), "KNN (CV)", F.lit(i))
        add(knn_scores(test, train, id, vector, label, neighbours), "KNN (Test)", F.lit(0))
    # Training and searching are done; the evaluation reads their output several times.
    return model_report(cut_lineage(reduce(DataFrame.unionByName, scored)))
