"""Event and point aggregation onto the grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.operators.grid import CELL, CELL_DAY, Grid, period_key, scaffold
from cindergrid.operators.joins import static_fields

CATEGORIES = ["railway", "power_line", "highway", "aeroway", "waterway"]


def strikes_by_cellday(strikes: DataFrame, dates: DataFrame, grid: Grid) -> DataFrame:
    """Per date and cell: strike count, sum of absolute strength, sum of multiplicity.

    Every cell of every calendar date is present, with zeros where nothing struck; strikes off the
    grid or off the calendar are dropped before anything is moved. The zero rows are unioned in front of
    one aggregation, so scaffold and strikes share a single shuffle that both sides pre-aggregate for.
    """
    hits = strikes.select(F.to_date("date").alias("date"), "latitude", "longitude", "strength", "multiplicity")
    # The calendar has at most one row per day of its range.
    hits = grid.locate(hits.join(F.broadcast(dates.select("date")), "date", "left_semi"))
    events = hits.select(*CELL_DAY, F.lit(1).alias("n"), F.abs("strength").cast("double").alias("s"),
                         F.col("multiplicity").cast("bigint").alias("m"))
    zeros = scaffold(dates, grid).select(*CELL_DAY, F.lit(0).alias("n"), F.lit(0.0).alias("s"),
                                         F.lit(0).cast("bigint").alias("m"))
    return (events.unionByName(zeros).groupBy(*CELL_DAY)
            .agg(F.sum("n").alias("lightning_count"), F.sum("s").alias("absv_strength_sum"),
                 F.sum("m").alias("multiplicity_sum")))


def category_counts(points: DataFrame, grid: Grid, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Per cell: number of points of each category, as ``<category>_count``."""
    located = grid.locate(points)
    return located.groupBy(*CELL).agg(*[
        F.count(F.when(F.col("category") == c, 1)).alias(f"{c}_count") for c in categories])


def infrastructure(cell_days: DataFrame, points: DataFrame, grid: Grid,
                   categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Point counts of the cell on each of its days, zero where there are none."""
    return static_fields(cell_days, category_counts(points, grid, categories), grid, fill=0)


def flagged_per_period(cell_days: DataFrame, flag: str = "is_fire_day") -> DataFrame:
    """Number of flagged cell-days in each ``yyyymm`` batch."""
    return cell_days.groupBy(period_key().alias("period")).agg(
        F.sum(F.col(flag).cast("bigint")).alias("fire_days"), F.count("*").alias("n"))


def cell_rate(cell_days: DataFrame, flag: str = "is_fire_day") -> DataFrame:
    """Per cell: days, flagged days and their share."""
    return cell_days.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.sum(F.col(flag).cast("bigint")).alias("fires"),
        F.avg(F.col(flag)).alias("fire_rate"))


def daily_mean(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Mean, sample deviation and count of a value per date."""
    v = F.col(f"`{value}`")
    return df.groupBy(F.to_date(date).alias("date")).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    return df.agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"))


def value_counts(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, n_distinct`` without a wide distinct aggregate: one pass of (column, value) pairs."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns
    ])).alias("x")).select("x.*").filter("v is not null")
    return pairs.distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: count, 'balanced' weight ``n / (k * n_c)`` and the ratio ``n / n_c``."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_t", total).select(
        label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("balanced_weight"),
        (F.col("_t.n") / F.col("n")).alias("inverse_share"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Attach the balanced class weight to each row, looked up in a map with one entry per class."""
    entries = F.collect_list(F.struct(label, "balanced_weight"))
    weights = class_weights(df, label).agg(F.map_from_entries(entries)).scalar()
    return df.withColumn(name, weights[F.col(label)])
