"""Joins on the cell-day key and spatial joins turned into equi-joins."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.operators.grid import CELL, CELL_DAY, Grid, e4, period_key

log = logging.getLogger(__name__)


def outer_fold(sources: Sequence[DataFrame], key: Sequence[str] = tuple(CELL_DAY)) -> DataFrame:
    """Full outer join of all sources on ``key``, which is unique within each source.

    A chain of outer joins would move the growing result again for every source, because its key is a
    mix of both sides. Here the sources are stacked, each in a struct column of its own, and grouped
    once; sources already grouped by the key are not moved at all. A repeated key is an error.
    """
    key = list(key)
    names = [[c for c in s.columns if c not in key] for s in sources]
    flat = [n for part in names for n in part]
    if len(flat) != len(set(flat)):
        raise ValueError(f"columns occur in several sources: {sorted({n for n in flat if flat.count(n) > 1})}")
    parts = [s.select(*key, F.struct(*[F.col(f"`{n}`") for n in part]).alias(f"_s{i}"))
             for i, (s, part) in enumerate(zip(sources, names)) if part]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    packed = [c for c in stacked.columns if c not in key]
    grouped = stacked.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in packed],
                                        *[F.count(c).alias(f"_n{c}") for c in packed])
    repeated = reduce(Column.__or__, [F.col(f"_n{c}") > 1 for c in packed])
    unique = F.when(repeated, F.raise_error(F.lit("a source has several rows for one cell-day"))).otherwise(F.lit(True))
    return grouped.filter(unique.cast("boolean")).select(*key, *[F.col(f"{c}.*") for c in packed])


def left_fields(main: DataFrame, fields: DataFrame, key: Sequence[str] = tuple(CELL_DAY)) -> DataFrame:
    """Left join of further fields of the same cell-days."""
    return main.join(fields, list(key), "left")


def static_fields(cell_days: DataFrame, static: DataFrame, grid: Grid,
                  fill: int | float | None = None) -> DataFrame:
    """Per-cell values (one row per cell) on every day of the cell."""
    out = cell_days.join(grid.per_cell(static), CELL, "left")
    names = [c for c in static.columns if c not in CELL]
    return out if fill is None else out.fillna(fill, names)


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b))


def cells_near(points: DataFrame, grid: Grid, lat_tol: float, lon_tol: float,
               lat="latitude", lon="longitude", keys: Sequence[str] = ("date",)) -> DataFrame:
    """Distinct ``keys + cell`` whose corner lies within the tolerances (inclusive) of a point.

    Corners sit on a regular grid, so the matching rows and columns are two integer ranges: a point
    expands to a fixed number of cells and no point is ever compared with a cell it does not match.
    Copies of a point collapse before the shuffle.
    """
    s, ta, to = grid.step_e4, round(lat_tol * 1e4), round(lon_tol * 1e4)
    a, o = e4(lat) - grid.lat0_e4, e4(lon) - grid.lon0_e4

    def span(x: Column, tol: int, n: int) -> tuple[Column, Column]:
        lo = F.greatest(-_floor_div(tol - x, s), F.lit(0).cast("bigint"))
        hi = F.least(_floor_div(x + tol, s), F.lit(n - 1).cast("bigint"))
        return lo, hi

    (r0, r1), (c0, c1) = span(a, ta, grid.n_rows), span(o, to, grid.n_cols)
    boxes = points.select(*keys, r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1"))
    boxes = boxes.filter("r0 <= r1 and c0 <= c1").distinct()
    rows = boxes.select(*keys, F.explode(F.sequence("r0", "r1")).alias("cell_r"), "c0", "c1")
    cells = rows.select(*keys, "cell_r", F.explode(F.sequence("c0", "c1")).alias("cell_c"))
    return cells.distinct()


def flag_cells(cell_days: DataFrame, marked: DataFrame, name: str,
               key: Sequence[str] = tuple(CELL_DAY)) -> DataFrame:
    """1 where the cell-day is in ``marked`` (distinct keys), else 0."""
    hits = marked.select(*key, F.lit(1).alias(name))
    return cell_days.join(hits, list(key), "left").fillna(0, [name])


def label_fires(cell_days: DataFrame, incidents: DataFrame, grid: Grid,
                lat_tol: float = 1.0, lon_tol: float = 1.0, name: str = "is_fire_day") -> DataFrame:
    """``is_fire_day``: an incident on the same date within the tolerances of the cell corner."""
    return flag_cells(cell_days, cells_near(incidents, grid, lat_tol, lon_tol), name)


def dilate(cell_days: DataFrame, tolerance: int, grid: Grid, flag: str = "is_fire_day",
           name: str = "fire_region") -> DataFrame:
    """Mask of all cells within ``tolerance`` rows and columns of a flagged cell of the same day.

    Only flagged cells are expanded, a fixed ``(2t+1)**2`` times, and clipped to the grid.
    """
    steps = F.sequence(F.lit(-tolerance).cast("bigint"), F.lit(tolerance).cast("bigint"))
    rows = (cell_days.filter(F.col(flag) == 1).select(*CELL_DAY)
            .withColumn("_dr", F.explode(steps)).withColumn("cell_r", F.col("cell_r") + F.col("_dr"))
            .filter(F.col("cell_r").between(0, grid.n_rows - 1)).select(*CELL_DAY).distinct())
    cells = (rows.withColumn("_dc", F.explode(steps)).withColumn("cell_c", F.col("cell_c") + F.col("_dc"))
             .filter(F.col("cell_c").between(0, grid.n_cols - 1)).select(*CELL_DAY).distinct())
    return flag_cells(cell_days, cells, name)


def period_counts(df: DataFrame, date: str = "date") -> DataFrame:
    return df.groupBy(period_key(date).alias("period")).agg(F.count("*").alias("n"))


def period_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per period: rows on each side and whether both sides have the period and agree in size."""
    a = period_counts(left).withColumnRenamed("n", "left_rows")
    b = period_counts(right).withColumnRenamed("n", "right_rows")
    status = (F.when(F.col("left_rows").isNull() | F.col("right_rows").isNull(), "unmatched")
              .when(F.col("left_rows") != F.col("right_rows"), "row counts differ").otherwise("merged"))
    return a.join(b, "period", "full_outer").withColumn("status", status)


def monthly_join(left: DataFrame, right: DataFrame, key: Sequence[str] = tuple(CELL_DAY),
                 overlap: Sequence[str] = ("lightning_count", "absv_strength_sum", "multiplicity_sum"),
                 ) -> tuple[DataFrame, DataFrame]:
    """Inner join of two monthly tables after dropping the overlapping measures of ``right``.

    A period is joined only when both sides have it with the same number of rows. Returns the joined
    rows and the per-period report.
    """
    for side in (left, right):
        if list(side.columns[:len(key)]) != list(key):
            raise ValueError(f"the first columns must be {list(key)}, found {side.columns[:len(key)]}")
    report = period_match(left, right)
    # One entry per month: a list to test against, so the rows need not move to be filtered.
    good = report.filter("status = 'merged'").agg(F.collect_set("period")).scalar()
    a = left.withColumn("period", period_key()).filter(F.array_contains(good, F.col("period")))
    b = right.drop(*overlap).withColumn("period", period_key())
    return a.join(b, ["period", *key], "inner"), report


def assemble(spark, dates: DataFrame, grid: Grid,
             sources: Sequence[tuple[str, Callable[..., DataFrame | None]]], on_error: str = "raise") -> DataFrame:
    """Run each source plug-in ``(spark, dates, grid) -> cell-day table`` and fold the outputs.

    An error of a plug-in is raised, so that no table lacks a source unnoticed. With ``on_error="skip"`` a plug-in that
    raises, returns None or lacks the key is left out and logged; with none left this is an error.
    """
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error is 'raise' or 'skip'")
    outputs, skipped = [], []
    for name, source in sources:
        try:
            out = source(spark, dates, grid)
            if out is None or any(k not in out.columns for k in CELL_DAY):
                raise ValueError(f"{name} gave no cell-day table")
            outputs.append(out)
        except Exception as error:
            if on_error == "raise":
                raise
            skipped.append(f"{name}: {error}")
            log.warning("left out source %s: %s", name, error)
    if not outputs:
        raise ValueError("no source gave data; " + "; ".join(skipped))
    return grid.with_corners(outer_fold(outputs))
