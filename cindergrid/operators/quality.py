"""Data-quality and exploration tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from cindergrid.operators.ranking import long_values, look_up, quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def existing(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns the table has, in the wanted order, each once."""
    return [c for c in dict.fromkeys(wanted) if c in df.columns]


def arranged(df: DataFrame, first: Sequence[str] = ("date",), drop: Sequence[str] = ()) -> DataFrame:
    """The columns ``first`` in front, the others in their order; helper columns ``drop`` go if present."""
    rest = [c for c in df.columns if c not in first and c not in drop]
    return df.select(*[f"`{c}`" for c in [*existing(df, first), *rest]])


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    c = F.col(f"`{column}`")
    floating = isinstance(df.schema[column].dataType, (DoubleType, FloatType))
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, n_null`` for every column, counted in one pass over the table."""
    columns = list(columns or df.columns)
    one = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"), F.count_if(is_missing(df, c)).alias("n_null"))
        for c in columns]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def rows_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.filter(reduce(Column.__or__, [is_missing(df, c) for c in columns or df.columns]))


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles and max per column."""
    values = long_values(df, columns)
    moments = values.groupBy("column").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                           F.min("value").alias("min"), F.max("value").alias("max"))
    return moments.join(quantiles(df, columns, QUARTILES), "column").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """``column, bin, low, high, n`` with equal-width bins between the column's extremes.

    Bins are half-open except the last, which includes the maximum; empty bins are listed with 0.
    """
    long = long_values(df, columns)
    ends = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.floor(F.try_divide(F.col("value") - F.col("lo"), width)).cast("int")
    binned = look_up(long, ends, ["column"], ["lo", "hi"]).select("column", F.least(F.coalesce(spot, F.lit(0)),
                                                                F.lit(bins - 1)).alias("bin"))
    counts = binned.groupBy("column", "bin").agg(F.count("*").alias("n"))
    empty = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (empty.join(counts, ["column", "bin"], "left")
            .select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("low"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def box_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR of the box) and number of outliers."""
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    box = quantiles(df, columns, QUARTILES).withColumns({"low_fence": F.col("q25") - reach, "high_fence": F.col("q75") + reach})
    v = F.col("value")
    inside = v.between(F.col("low_fence"), F.col("high_fence"))
    stats = ["q25", "q50", "q75"]
    values = look_up(long_values(df, columns), box, ["column"], [*stats, "low_fence", "high_fence"])
    return (values.groupBy("column", *stats)
            .agg(F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
                 F.sum(F.when(inside, 0).otherwise(1)).alias("n_outliers")))


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value lies beyond 1.5 IQR of the box."""
    box = quantiles(df, [column], {"q25": 0.25, "q75": 0.75})
    fence = box.select(F.struct((F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("low"),
                                (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("high"))).scalar()
    c = F.col(f"`{column}`")
    return (df.withColumn("_fence", fence)
            .filter((c < F.col("_fence.low")) | (c > F.col("_fence.high"))).drop("_fence"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered column pair as ``a, b, corr``, from one pass."""
    def c(name: str) -> Column:
        return F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(c(a), c(b)).alias("corr"))
                           for a, b in pairs]).alias("x"))
    half = one.select(F.explode("x").alias("x")).select("x.*")
    mirrored = F.array(F.struct("a", "b", "corr"),
                       F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("corr")))
    return (half.select(F.explode(F.when(F.col("a") == F.col("b"), F.slice(mirrored, 1, 1))
                                  .otherwise(mirrored)).alias("x")).select("x.*"))
