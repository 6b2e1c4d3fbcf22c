"""Scaling, encoding and imputation. Statistics stay on the executors: each is a one-row aggregate
read as a scalar subquery, or one row per group when grouped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.session import cut_lineage


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _with_stats(df: DataFrame, stats: Mapping[str, Column], by: Sequence[str],
                fit_on: Column | None) -> DataFrame:
    if not stats:
        return df
    source = df if fit_on is None else df.filter(fit_on)
    packed = F.struct(*[s.alias(n) for n, s in stats.items()]).alias("_stats")
    if by:
        # Written first: the join then broadcasts the statistics if their real size is small, so the
        # rows of a big group stay where they are.
        return df.join(cut_lineage(source.groupBy(*by).agg(packed)), list(by), "left")
    return df.withColumn("_stats", source.agg(packed).scalar())


def scale(df: DataFrame, standard: Sequence[str] = (), minmax: Sequence[str] = (), by: Sequence[str] = (),
          fit_on: Column | None = None) -> DataFrame:
    """:func:`standard_scale` of some columns and :func:`minmax_scale` of others, fitted in one pass."""
    twice = sorted(set(standard) & set(minmax))
    if twice:
        raise ValueError(f"columns to be scaled in two ways: {twice}")
    stats = {}
    for i, c in enumerate(standard):
        stats[f"m{i}"], stats[f"s{i}"] = F.avg(_q(c)), F.stddev_pop(_q(c))
    for i, c in enumerate(minmax):
        stats[f"lo{i}"], stats[f"hi{i}"] = F.min(_q(c)).cast("double"), F.max(_q(c)).cast("double")
    out = _with_stats(df, stats, by, fit_on)

    def over(c: str, low: Column, width: Column) -> Column:
        return (_q(c) - low) / F.when(width == 0, 1.0).otherwise(width)

    def stat(name: str) -> Column:
        return F.col(f"_stats.{name}")

    scaled = {c: over(c, stat(f"m{i}"), stat(f"s{i}")) for i, c in enumerate(standard)}
    scaled |= {c: over(c, stat(f"lo{i}"), stat(f"hi{i}") - stat(f"lo{i}")) for i, c in enumerate(minmax)}
    return (out.withColumns(scaled) if scaled else out).select(*[_q(c) for c in df.columns])


def standard_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                   fit_on: Column | None = None) -> DataFrame:
    """``(x - mean) / std`` with the population std; a constant column is only centred.

    ``by`` fits per group, ``fit_on`` restricts fitting to matching rows (for example the train split).
    """
    return scale(df, standard=columns, by=by, fit_on=fit_on)


def minmax_scale(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                 fit_on: Column | None = None) -> DataFrame:
    """``(x - min) / (max - min)``; a constant column becomes 0."""
    return scale(df, minmax=columns, by=by, fit_on=fit_on)


def impute_mean(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Missing numbers (NULL or NaN) replaced by the column mean."""
    def clean(c: str) -> Column:
        return F.nanvl(_q(c).cast("double"), F.lit(None).cast("double"))

    out = _with_stats(df, {f"m{i}": F.avg(clean(c)) for i, c in enumerate(columns)}, (), fit_on)
    filled = {c: F.coalesce(clean(c), F.col(f"_stats.m{i}")) for i, c in enumerate(columns)}
    return (out.withColumns(filled) if filled else out).select(*[_q(c) for c in df.columns])


def categories_of(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct values, which become column names; more than ``limit`` is an error."""
    rows = df.select(_q(column).alias("v")).filter("v is not null").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(r.v for r in rows)


def one_hot(df: DataFrame, columns: Sequence[str], categories: Mapping[str, Sequence] | None = None,
            drop_first: bool = True, keep: bool = False, limit: int = 1000) -> DataFrame:
    """0/1 columns ``<column>_<value>``, without the first sorted value; missing values give all zeros.

    Pass ``categories`` for columns whose values are known to avoid a pass over the data; others may have
    ``limit`` values, more are an error.
    """
    dummies = {}
    for c in columns:
        values = sorted((categories or {}).get(c) or categories_of(df, c, limit))
        for v in values[1:] if drop_first else values:
            dummies[f"{c}_{v}"] = F.coalesce((_q(c) == F.lit(v)).cast("int"), F.lit(0))
    out = df.withColumns(dummies)
    return out if keep else out.drop(*columns)
