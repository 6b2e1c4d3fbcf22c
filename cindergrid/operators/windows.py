"""Per-cell operators over days.

Every window is partitioned by cell and by a block of ``span`` days. Rows near a block edge are
also copied into the neighbouring block, so a look-back sees its whole range while no task holds
more than one block of one cell, however long the record is. Ranges are in days, not rows: a missing
day never shifts a lag.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from cindergrid.operators.grid import CELL, CELL_DAY, Grid

SPAN = 366


def day_number(date: Column | str = "date") -> Column:
    """Days since 1970-01-01; consecutive dates differ by one."""
    return F.unix_date(date)


def leapless_day(date: Column | str = "date") -> Column:
    """Days since 1970-01-01 without counting any Feb 29: Feb 28 and Mar 1 are always adjacent.

    For tables from which leap days were removed; pass it as ``day``."""
    date = F.col(date) if isinstance(date, str) else date

    def leaps(year):
        return F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)

    past = (F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31))) == 366) & (F.dayofyear(date) > 60)
    return (F.unix_date(date) - (leaps(F.year(date) - 1) - leaps(F.lit(1969))) - past.cast("int")).cast("bigint")


def over_days(df: DataFrame, outputs: Mapping[str, Callable[[WindowSpec], Column]], before: int,
              after: int = 0, by: Sequence[str] = tuple(CELL), day: Column | None = None,
              span: int = SPAN) -> DataFrame:
    """Add ``outputs``, each built from a window over the cell's days ``[-before, +after]``.

    ``span`` must be at least as long as either reach; it is raised when it is not. Rows without a date
    have no place in a window and are left out.
    """
    span = max(span, before, after, 1)
    keep = df.columns
    day = day_number() if day is None else day
    tagged = df.withColumn("_day", day.cast("bigint"))
    first, last = F.floor((F.col("_day") - after) / span), F.floor((F.col("_day") + before) / span)
    tagged = tagged.withColumn("_block", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*by, "_block").orderBy("_day")
    out = tagged.withColumns({name: build(window) for name, build in outputs.items()})
    return (out.filter(F.col("_block") == F.floor(F.col("_day") / span))
            .select(*keep, *[n for n in outputs if n not in keep]))


def rolling_sum(df: DataFrame, value: str = "tp", days: int = 7, name: str = "rolling_precipitation",
                by: Sequence[str] = tuple(CELL), span: int = SPAN, day: Column | None = None) -> DataFrame:
    """Sum over the last ``days`` days of the cell, today included; short at the start of the record."""
    return over_days(df, {name: lambda w: F.sum(f"`{value}`").over(w.rangeBetween(1 - days, 0))},
                     before=days - 1, by=by, day=day, span=span)


def lagged(df: DataFrame, columns: Sequence[str], lags: Sequence[int] = (1, 2, 3),
           by: Sequence[str] = tuple(CELL), drop_incomplete: bool = True, span: int = SPAN, day: Column | None = None) -> DataFrame:
    """``<column>_lag_<k>``: the value ``k`` days earlier; incomplete rows are dropped by default."""
    outputs = {f"{c}_lag_{k}": (lambda w, c=c, k=k: F.max(f"`{c}`").over(w.rangeBetween(-k, -k)))
               for c in columns for k in lags}
    out = over_days(df, outputs, before=max(lags), by=by, day=day, span=span)
    return out.dropna("any", subset=list(outputs)) if drop_incomplete else out


def fire_before(df: DataFrame, days: int = 14, flag: str = "is_fire_day", name: str = "fire_before",
                by: Sequence[str] = tuple(CELL), span: int = SPAN, day: Column | None = None) -> DataFrame:
    """1 when the cell was flagged on any of the previous ``days`` days, else 0."""
    return over_days(df, {name: lambda w: F.coalesce(
        F.max(flag).over(w.rangeBetween(-days, -1)), F.lit(0))}, before=days, by=by, day=day, span=span)


def label_ahead(df: DataFrame, horizon: int = 5, label: str = "is_fire_day",
                by: Sequence[str] = tuple(CELL), day: Column | None = None, span: int = SPAN) -> DataFrame:
    """``target, target_date``: label and date ``horizon`` days after the row; rows without one drop."""
    out = over_days(df, {
        "target": lambda w: F.max(label).over(w.rangeBetween(horizon, horizon)),
        "target_date": lambda w: F.max("date").over(w.rangeBetween(horizon, horizon)),
    }, before=0, after=horizon, by=by, day=day, span=span)
    return out.filter("target_date is not null")


def lookback_samples(df: DataFrame, features: Sequence[str], days: int = 14, horizon: int = 5,
                     label: str = "is_fire_day", by: Sequence[str] = tuple(CELL),
                     day: Column | None = None, span: int = SPAN) -> DataFrame:
    """Training samples: ``window`` holds the features of the ``days`` days before the row's date, oldest
    first; ``target`` is the label ``horizon`` days after it.

    Only samples with every look-back day and a target day are kept. Input and label come from one sort.
    """
    row = F.struct(*[F.col(f"`{f}`").alias(f) for f in features])
    out = over_days(df, {
        "window": lambda w: F.collect_list(row).over(w.rangeBetween(-days, -1)),
        "target": lambda w: F.max(label).over(w.rangeBetween(horizon, horizon)),
        "target_date": lambda w: F.max("date").over(w.rangeBetween(horizon, horizon)),
    }, before=days, after=horizon, by=by, day=day, span=span)
    return out.filter((F.size("window") == days) & F.col("target_date").isNotNull())


def flatten_window(samples: DataFrame, features: Sequence[str], static: Sequence[str] = (),
                   name: str = "inputs") -> DataFrame:
    """One ``array<double>`` per sample: features day by day, then the static columns."""
    dynamic = F.flatten(F.transform("window", lambda x: F.array(*[x[f].cast("double") for f in features])))
    fixed = F.array(*[F.col(f"`{c}`").cast("double") for c in static]) if static else None
    return samples.withColumn(name, F.concat(dynamic, fixed) if static else dynamic)


def day_slice(df: DataFrame, index: DataFrame, start: int, days: int = 35,
              columns: Sequence[str] = ()) -> DataFrame:
    """``days`` consecutive day indices from ``start`` of the chosen columns."""
    run = index.filter(F.col("day_idx").between(start, start + days - 1))  # ``days`` rows
    return df.join(F.broadcast(run), "date").select(*CELL_DAY, "day_idx", *columns)


def season_split(dates: DataFrame, train_years: tuple[int, int], test_years: tuple[int, int] | int,
                 start_day: str = "02-24", end_day: str = "09-25", date: str = "date") -> DataFrame:
    """Rows whose day lies in the season of a train or test year, with ``split``; the rest drop."""
    first, last = (int(d.replace("-", "")) for d in (start_day, end_day))
    t0, t1 = (test_years, test_years) if isinstance(test_years, int) else test_years
    day = F.month(date) * 100 + F.dayofmonth(date)
    split = (F.when(F.year(date).between(*train_years), "train")
             .when(F.year(date).between(t0, t1), "test"))
    return dates.filter(day.between(first, last)).withColumn("split", split).filter("split is not null")


def gradient(df: DataFrame, value: str, x: str, by: Sequence[str], order: str, name: str, span: int = 4096) -> DataFrame:
    """Derivative of ``value`` along ``x`` within each line ``by``: second-order central differences for
    unequal spacing inside, one-sided at the ends, 0 on a line of one point.

    A line is cut into blocks of ``span`` positions of ``order``; each block is given the last point before
    it and the first after it, so no task holds a whole line.
    """
    point = F.struct(F.col(order).alias("o"), F.col(value).alias("f"), F.col(x).alias("x"))
    tagged = df.withColumn("_block", F.floor(F.col(order) / span))
    ends = tagged.groupBy(*by, "_block").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    line = Window.partitionBy(*by).orderBy("_block")
    ends = ends.select(*by, "_block", F.lag("last").over(line).alias("_before"), F.lead("first").over(line).alias("_after"))
    w = Window.partitionBy(*by, "_block").orderBy(order)
    out = tagged.join(ends, [*by, "_block"]).withColumns({
        "_prev": F.coalesce(F.lag(point).over(w), "_before"), "_next": F.coalesce(F.lead(point).over(w), "_after")})
    f, p, n = F.col(value), F.col("_prev.f"), F.col("_next.f")
    hs, hd = F.col(x) - F.col("_prev.x"), F.col("_next.x") - F.col(x)
    inner = F.try_divide(hs * hs * n + (hd * hd - hs * hs) * f - hd * hd * p, hs * hd * (hd + hs))
    one_sided = F.coalesce(F.try_divide(n - f, hd), F.try_divide(f - p, hs))
    return out.withColumn(name, F.coalesce(inner, one_sided, F.lit(0.0))).select(*df.columns, name)


METRES_PER_DEGREE = 111320


def slope(cell_days: DataFrame, grid: Grid, z: str = "z") -> DataFrame:
    """``elevation, slope`` per cell-day from geopotential ``z``.

    Terrain does not change with the date, so gradients run once over distinct cells: along each grid
    row for x and each grid column for y. The result joins back by cell.
    """
    cells = cell_days.groupBy(*CELL).agg(F.max(z).alias("_z"))
    lat, lon = grid.latitude(), grid.longitude()
    cells = cells.select(*CELL, (F.col("_z") / 9.8067).alias("elevation"),
                         (lon * METRES_PER_DEGREE * F.cos(F.radians(lat))).alias("_x"),
                         (lat * METRES_PER_DEGREE).alias("_y"))
    cells = gradient(cells, "elevation", "_x", ["cell_r"], "cell_c", "_gx")
    cells = gradient(cells, "elevation", "_y", ["cell_c"], "cell_r", "_gy")
    cells = cells.select(*CELL, "elevation",
                         F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")).alias("slope"))
    return cell_days.join(grid.per_cell(cells), CELL, "left")


def fire_season_mask(df: DataFrame, temp: str = "temp_c", start_above: float = 12.0,
                     end_below: float = 5.0, days: int = 3, by: Sequence[str] = tuple(CELL),
                     name: str = "in_season") -> DataFrame:
    """1 while the fire season lasts: it starts on the third of three consecutive days above
    ``start_above`` and ends on the third of three below ``end_below``; every year starts out of season.

    A window holds one cell and year, at most 366 days.
    """
    keep = df.columns
    w = Window.partitionBy(*by, F.year("date")).orderBy(day_number())
    run = w.rangeBetween(1 - days, 0)
    full = F.count(temp).over(run) == days
    signal = (F.when(full & (F.min(temp).over(run) > start_above), 1)
              .when(full & (F.max(temp).over(run) < end_below), 0))
    state = F.last("_signal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("_signal", signal).withColumn(name, F.coalesce(state, F.lit(0)))
            .select(*keep, name))
