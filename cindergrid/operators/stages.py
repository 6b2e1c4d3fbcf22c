"""Imputing, scaling, encoding and weighting as ``pyspark.ml`` stages: fitted once, saved with a pipeline, applied to later rows.

A fitted stage holds its statistics as a parameter (one entry per column or class), so Spark's own writer stores them,
and adds plain columns when it transforms. Results are those of the operators in ``scaling`` and ``aggregates``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.operators.aggregates import class_weights
from cindergrid.operators.scaling import categories_of


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _known(name: str) -> Column:
    return F.nanvl(_q(name).cast("double"), F.lit(None).cast("double"))


class _Stage(Params):
    columns = Param(Params._dummy(), "columns", "columns the stage is about", TypeConverters.toListString)

    def __init__(self, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))

    def names(self) -> list[str]:
        return self.getOrDefault(self.columns)


class _Learner(_Stage, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns ``statistics`` and hands them to its ``fitted`` class."""

    fitted: type

    def _fit(self, dataset: DataFrame) -> Model:
        return self._copyValues(self.fitted(self.names())._set(statistics=self.learn(dataset)))


class _Fitted(_Stage, Model, DefaultParamsReadable, DefaultParamsWritable):
    statistics = Param(Params._dummy(), "statistics", "what was learned, one entry per column or class")

    def learned(self) -> dict:
        return self.getOrDefault(self.statistics)


class MeanImputed(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: F.coalesce(_known(c), F.lit(m)) for c, m in self.learned().items()})


class MeanImputer(_Learner):
    """Missing numbers become the mean of the rows it was fitted on."""

    fitted = MeanImputed

    def learn(self, df: DataFrame) -> dict:
        return dict(df.agg(*[F.avg(_known(c)).alias(c) for c in self.names()]).first().asDict()) if self.names() else {}


class Scaled(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: (_q(c) - F.lit(low)) / F.lit(width or 1.0) for c, (low, width) in self.learned().items()})


class StandardScaling(_Learner):
    """``(x - mean) / std`` with the population deviation; a constant column is only centred."""

    fitted = Scaled

    def learn(self, df: DataFrame) -> dict:
        if not self.names():
            return {}
        row = df.agg(*[F.array(F.avg(_q(c)), F.stddev_pop(_q(c))).alias(f"c{i}") for i, c in enumerate(self.names())]).first()
        return {c: list(row[f"c{i}"]) for i, c in enumerate(self.names())}


class RangeScaling(_Learner):
    """``(x - min) / (max - min)``; a constant column becomes 0."""

    fitted = Scaled

    def learn(self, df: DataFrame) -> dict:
        if not self.names():
            return {}
        row = df.agg(*[F.array(F.min(_q(c)).cast("double"), (F.max(_q(c)) - F.min(_q(c))).cast("double")).alias(f"c{i}") for i, c in enumerate(self.names())]).first()
        return {c: list(row[f"c{i}"]) for i, c in enumerate(self.names())}


class Encoded(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        flags = {f"{c}_{v}": F.coalesce((_q(c) == F.lit(v)).cast("int"), F.lit(0)) for c, values in self.learned().items() for v in values}
        return dataset.withColumns(flags)


class CategoryEncoder(_Learner):
    """0/1 columns ``<column>_<value>`` beside the column, without the first sorted value; values not seen when it was fitted
    and missing ones give all zeros. More than 1,000 values are an error."""

    fitted = Encoded

    def learn(self, df: DataFrame) -> dict:
        return {c: categories_of(df, c)[1:] for c in self.names()}


class Weighed(_Fitted):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        (label,), learned = self.names(), self.learned()
        weight = F.lit(None).cast("double")
        for value, w in zip(learned["classes"], learned["weights"]):
            weight = F.when(_q(label) == F.lit(value), w).otherwise(weight)
        return dataset.withColumn("weight", weight)


class ClassWeighting(_Learner):
    """Balanced weight of each row's class as ``weight``; NULL for a class that wasn't there when it was fitted."""

    fitted = Weighed

    def learn(self, df: DataFrame) -> dict:
        (label,) = self.names()
        rows = class_weights(df.where(_q(label).isNotNull()), label).orderBy(label).collect()  # one row per class
        return {"classes": [r[label] for r in rows], "weights": [r.balanced_weight for r in rows]}
