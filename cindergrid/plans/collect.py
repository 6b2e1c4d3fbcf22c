"""From events, points, weather and incidents to the raw cell-day table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from cindergrid.operators.aggregates import infrastructure, strikes_by_cellday
from cindergrid.operators.grid import CELL_DAY, Grid, calendar, scaffold
from cindergrid.operators.joins import assemble, label_fires, left_fields
from cindergrid.operators.quality import arranged

Period = tuple[object, object]
Source = tuple[str, Callable[[SparkSession, DataFrame, Grid, Period], DataFrame | None]]


def within(df: DataFrame, period: Period, date: str = "date") -> DataFrame:
    """Rows from the first to the last day of ``period``, compared with literals, so that the scan can skip the rest."""
    first, last = (F.lit(day).cast("date") for day in period)
    return df.filter(F.col(date).between(first, last))


def on_calendar(df: DataFrame, dates: DataFrame, period: Period) -> DataFrame:
    """Rows of calendar days; the calendar has at most one row per day of its range."""
    return within(df, period).join(F.broadcast(dates), "date", "left_semi")


def weather_source(instant: DataFrame, accumulated: DataFrame | None, incident_table: DataFrame,
                   lat_tol: float = 1.0, lon_tol: float = 1.0) -> Source:
    """Weather cell-days of the calendar, accumulated fields attached, labelled with incidents."""
    def build(spark, dates, grid, period):
        located = grid.locate(on_calendar(instant, dates, period)).drop("latitude", "longitude")
        if accumulated is not None:
            sums = grid.locate(on_calendar(accumulated, dates, period)).drop("latitude", "longitude")
            located = left_fields(located, sums)
        return label_fires(located, within(incident_table, period), grid, lat_tol, lon_tol)

    return "weather", build


def lightning_source(strikes: DataFrame) -> Source:
    return "lightning", lambda spark, dates, grid, period: strikes_by_cellday(
        within(strikes.withColumn("date", F.to_date("date")), period), dates, grid)


def infrastructure_source(points: DataFrame) -> Source:
    return "infrastructure", lambda spark, dates, grid, period: infrastructure(scaffold(dates, grid), points, grid)


def cell_day_table(spark: SparkSession, grid: Grid, start, end, sources: list[Source],
                   incident_table: DataFrame, every: int = 1) -> DataFrame:
    """The assembled table over every ``every``-th day and all incident days of the range.

    Sources get the range besides the calendar and read no other days. One plan covers all periods; write it
    with ``sinks.write_periods``.
    """
    dates = calendar(spark, start, end, every, incident_table)
    bound = [(name, partial(_build, build, (start, end))) for name, build in sources]
    return arranged(assemble(spark, dates, grid, bound), [*CELL_DAY, "latitude", "longitude"])


def _build(build, period, spark, dates, grid):
    return build(spark, dates, grid, period)
