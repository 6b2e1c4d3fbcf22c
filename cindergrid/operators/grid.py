"""Regular grid, calendar and cell-day scaffold.

Coordinates become integers (1/10,000 degree) before any cell arithmetic, so equal cells
compare equal; doubles are only produced again for output.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

E4 = 10_000
BROADCAST_CELLS = 100_000
CELL = ["cell_r", "cell_c"]
CELL_DAY = ["date", *CELL]


def e4(column: Column | str) -> Column:
    """Degrees as an integer number of 1/10,000 degrees."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column * E4).cast("bigint")


def _range(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def div(a: Column, b) -> Column:
    """Integer division (truncating, so callers keep ``a`` non-negative)."""
    return F.call_function("div", a, F.lit(b))


@dataclass(frozen=True)
class Grid:
    """Lower-left cell corners from ``(lat0, lon0)`` upwards, ``n_rows`` by ``n_cols`` cells."""

    lat0_e4: int
    lon0_e4: int
    step_e4: int
    n_rows: int
    n_cols: int

    @classmethod
    def over(cls, lat_range, lon_range, step: float) -> Grid:
        """Grid over half-open ranges: the upper bound is never a corner."""
        (a0, a1), (o0, o1) = ([round(v * E4) for v in r] for r in (lat_range, lon_range))
        s = round(step * E4)
        return cls(a0, o0, s, -((a0 - a1) // s), -((o0 - o1) // s))

    @property
    def size(self) -> int:
        return self.n_rows * self.n_cols

    def per_cell(self, table: DataFrame) -> DataFrame:
        """Mark a table of at most one row per cell for broadcast when the grid is small enough.

        The grid bounds its size; beyond ``BROADCAST_CELLS`` the join shuffles as usual.
        """
        return F.broadcast(table) if self.size <= BROADCAST_CELLS else table

    def inside(self, lat="latitude", lon="longitude") -> Column:
        """True for points in the covered box (lower edges in, upper edges out)."""
        a, o = e4(lat), e4(lon)
        return (
            (a >= self.lat0_e4)
            & (a < self.lat0_e4 + self.n_rows * self.step_e4)
            & (o >= self.lon0_e4)
            & (o < self.lon0_e4 + self.n_cols * self.step_e4)
        )

    def locate(self, df: DataFrame, lat="latitude", lon="longitude") -> DataFrame:
        """Keep points inside the grid and add their ``cell_r, cell_c`` (half-open cells).

        Pure arithmetic: a point-in-cell join never needs the grid as a table.
        """
        return df.filter(self.inside(lat, lon)).withColumns({
            "cell_r": div(e4(lat) - self.lat0_e4, self.step_e4),
            "cell_c": div(e4(lon) - self.lon0_e4, self.step_e4),
        })

    def latitude(self, row="cell_r") -> Column:
        return F.round((F.col(row) * self.step_e4 + self.lat0_e4) / E4, 2)

    def longitude(self, col="cell_c") -> Column:
        return F.round((F.col(col) * self.step_e4 + self.lon0_e4) / E4, 2)

    def with_corners(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"latitude": self.latitude(), "longitude": self.longitude()})

    def cells(self, spark: SparkSession) -> DataFrame:
        """One row per cell with its corner."""
        n = spark.range(self.size)
        return self.with_corners(
            n.select(div(F.col("id"), self.n_cols).alias("cell_r"),
                     (F.col("id") % self.n_cols).alias("cell_c"))
        )

    def on_each(self, df: DataFrame) -> DataFrame:
        """Every row of ``df`` on every cell of the grid.

        The grid is a range of numbers, so each row expands in place; no table is joined or broadcast.
        """
        rows = df.withColumn("cell_r", F.explode(_range(self.n_rows)))
        # A short calendar sits in one small partition: spread it before it grows, one task per
        # million cells of a year of days.
        tasks = min(-(-self.size * 366 // 1_000_000), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if tasks > 1:
            rows = rows.repartition(tasks, *df.columns, "cell_r")
        return rows.withColumn("cell_c", F.explode(_range(self.n_cols)))


def calendar(spark: SparkSession, start, end, every: int = 1,
             extra: DataFrame | None = None, extra_date: str = "date") -> DataFrame:
    """Every ``every``-th day from ``start`` to ``end`` plus the days of ``extra`` in that range."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    days = spark.range(1).select(
        F.explode(F.sequence(lo, hi, F.expr(f"interval {int(every)} days"))).alias("date"))
    if extra is not None:
        more = extra.select(F.to_date(extra_date).alias("date")).filter(F.col("date").between(lo, hi))
        days = days.union(more)
    return days.distinct()


def scaffold(dates: DataFrame, grid: Grid, zero: dict[str, str] | None = None) -> DataFrame:
    """One row per date and cell; ``zero`` maps measure names to types of zero-filled columns."""
    rows = grid.on_each(dates.select("date"))
    return rows.withColumns({c: F.lit(0).cast(t) for c, t in (zero or {}).items()})


def day_index(df: DataFrame, date: str = "date") -> DataFrame:
    """``date, day_idx``: position of each distinct date in date order, from 0.

    The set of distinct dates is the only thing gathered: one entry per calendar day.
    """
    days = df.agg(F.array_sort(F.collect_set(F.to_date(date))).alias("days"))
    return days.select(F.posexplode("days").alias("day_idx", "date"))


def with_period(df: DataFrame, freq: str = "M", date: str = "date", name: str = "period") -> DataFrame:
    """Period start of each date for ``D``, ``W`` (Monday), ``M`` or ``Y``."""
    unit = {"D": "day", "W": "week", "M": "month", "Y": "year"}[freq]
    return df.withColumn(name, F.to_date(F.date_trunc(unit, F.col(date).cast("timestamp_ntz"))))


def period_key(date="date") -> Column:
    """``yyyymm`` key that names one monthly batch."""
    return F.date_format(F.col(date), "yyyyMM")


def period_batches(dates: DataFrame, freq: str = "M") -> DataFrame:
    """First day, last day and number of days of each period."""
    return (with_period(dates, freq).groupBy("period")
            .agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                 F.count("*").alias("n_days")))


def bounding_box(df: DataFrame, north: float, west: float, south: float, east: float,
                 grid: Grid | None = None, lat="latitude", lon="longitude") -> DataFrame:
    """Rows within the closed box (area order N, W, S, E), optionally snapped to a grid."""
    out = df.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))
    return grid.with_corners(grid.locate(out, lat, lon)) if grid else out


def day_rows(df: DataFrame, features: list[str], grid: Grid) -> DataFrame:
    """Grid rows of each day: ``date, feature, cell_r, line`` with ``line[c]`` the value at column c.

    Cells without a row are NULL. Each group holds at most ``n_cols`` cells of one grid row.
    """
    long = df.select(*CELL_DAY, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("v"))
        for f in features])).alias("x")).select(*CELL_DAY, "x.feature", "x.v")
    one = long.groupBy("date", "feature", "cell_r").agg(
        F.map_from_entries(F.collect_set(F.struct("cell_c", "v"))).alias("m"))
    return one.select("date", "feature", "cell_r",
                      F.transform(_range(grid.n_cols), lambda c: F.col("m")[c]).alias("line"))


def day_images(df: DataFrame, features: list[str], grid: Grid, drop_last: bool = False,
               max_cells: int = 4_000_000) -> DataFrame:
    """Dense ``array<array<double>>`` (row-major, rows are latitudes) per day and feature.

    ``complete`` tells whether every cell had a row. An image is one value, so its size is checked
    against ``max_cells``; above that use :func:`day_rows`, which holds one grid row per value.
    """
    if grid.size > max_cells:
        raise ValueError(f"{grid.size} cells do not fit one image; use day_rows instead")
    lines = day_rows(df, features, grid)
    if drop_last:
        lines = lines.filter(F.col("date") < df.agg(F.max("date")).scalar())
    grouped = lines.groupBy("date", "feature").agg(
        F.map_from_entries(F.collect_list(F.struct("cell_r", "line"))).alias("m"))
    empty = F.array_repeat(F.lit(None).cast("double"), grid.n_cols)
    image = F.transform(_range(grid.n_rows), lambda r: F.coalesce(F.col("m")[r], empty))
    out = grouped.select("date", "feature", image.alias("image"))
    return out.withColumn("complete", ~F.exists(F.flatten("image"), lambda v: v.isNull()))


def image_rows(images: DataFrame, grid: Grid, value: str = "risk_score", image: str = "image") -> DataFrame:
    """Dense images back to one row per cell: array row is latitude, array column is longitude."""
    keep = [c for c in images.columns if c != image]
    lines = images.select(*keep, F.posexplode(image).alias("cell_r", "_line"))
    cells = lines.select(*keep, "cell_r", F.posexplode("_line").alias("cell_c", value))
    cells = cells.withColumns({c: F.col(c).cast("bigint") for c in CELL})
    return grid.with_corners(cells)
