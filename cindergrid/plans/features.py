"""From raw cell-days to the processed feature table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.functions import surface, temporal, weather
from cindergrid.functions.fireweather import fire_weather
from cindergrid.operators.grid import CELL, CELL_DAY, Grid
from cindergrid.operators.models import cluster_cells
from cindergrid.operators.quality import existing
from cindergrid.operators.scaling import one_hot, scale
from cindergrid.operators.windows import leapless_day, rolling_sum, slope
from cindergrid.session import cut_lineage
from cindergrid.sources.sinks import write_audit

DISABLE = ["DISABLE"]
TARGET = "is_fire_day"

# Default feature lists and their treatment.
RAW_FEATURES = ["10u", "10v", "2d", "2t", "cl", "cvh", "cvl", "fal", "lai_hv", "lai_lv", "lsm", "sp", "src",
                "stl1", "stl2", "stl3", "stl4", "e", "pev", "slhf", "sshf", "ssr", "ssrd", "str", "strd", "tp",
                "is_fire_day", "lightning_count", "absv_strength_sum", "railway_count", "power_line_count",
                "highway_count", "aeroway_count", "waterway_count"]
ENGINEERED_FEATURES = ["drought_code", "duff_moisture_code", "fine_fuel_moisture_code", "initial_spread_index",
                       "build_up_index", "fire_weather_index", "lightning_products", "lightning_ratios",
                       "rolling_precipitation", "relative_humidity", "atmospheric_dryness", "fuel_low",
                       "fuel_high", "soil", "surface_depth_waterheat", "elevation", "slope", "season",
                       "fire_season", "clusters_12", "clusters_30"]
STANDARD = ["2t", "2d", "10u", "10v", "sp", "tp", "e", "pev", "slhf", "sshf", "ssr", "ssrd", "str", "strd", "sf",
            "lightning_count", "absv_strength_sum", "stl1", "stl2", "stl3", "stl4", "drought_code",
            "duff_moisture_code", "fine_fuel_moisture_code", "initial_spread_index", "build_up_index",
            "fire_weather_index", "ltng_strength_prod", "relative_humidity", "atmospheric_dryness",
            "rolling_precipitation", "daily_water_sum", "daily_temp_sum"]
MINMAX = ["cl", "cvh", "cvl", "fal", "lai_hv", "lai_lv", "lsm", "src", "railway_count", "power_line_count",
          "highway_count", "aeroway_count", "waterway_count", "ltng_strength_ratio",
          *[f"surface_water_heat_{i}" for i in range(10)], "elevation", "slope", "fuel_low", "fuel_high",
          "is_fire_day"]
CATEGORICAL = ["soil", "season", "fire_season", "clusters_12", "clusters_30"]
KNOWN_CATEGORIES = {"soil": list(surface.SOIL), "season": temporal.SEASON_NAMES,
                    "fire_season": temporal.FIRE_SEASON_NAMES}

# Features that are plain columns of the row they describe.
ROW_FEATURES: dict[str, Callable[[], Mapping[str, Column]]] = {
    "lightning_products": lambda: {"ltng_strength_prod": weather.lightning_product()},
    "lightning_ratios": lambda: {"ltng_strength_ratio": weather.lightning_ratio()},
    "relative_humidity": lambda: {"relative_humidity": weather.relative_humidity()},
    "atmospheric_dryness": lambda: {"atmospheric_dryness": weather.atmospheric_dryness()},
    "fuel_low": lambda: {"fuel_low": surface.fuel_low()},
    "fuel_high": lambda: {"fuel_high": surface.fuel_high()},
    "soil": lambda: {"soil": surface.soil_class()},
    "surface_depth_waterheat": surface.depth_waterheat,
    "elevation": lambda: {"elevation": surface.elevation()},
    "season": lambda: {"season": temporal.season()},
    "fire_season": lambda: {"fire_season": temporal.fire_season()},
}
FIRE_INDICES = ENGINEERED_FEATURES[:6]


def clean(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Typed date; rows without a target drop."""
    return df.withColumn("date", F.to_date("date")).dropna(subset=[target])


def drop_leap_days(df: DataFrame) -> DataFrame:
    return df.filter(~temporal.is_leap_day())


def with_features(df: DataFrame, wanted: Sequence[str], grid: Grid, temp_offset: float = 0.0,
                  day: Column | None = None) -> DataFrame:
    """Add the engineered features; the cell-day rows stay as they are.

    All row-wise features go into one projection. ``day`` numbers the days of rolling sums.
    """
    unknown = [f for f in wanted if f not in ROW_FEATURES and f not in FIRE_INDICES
               and f not in ("rolling_precipitation", "slope") and not f.startswith("clusters_")]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    columns: dict[str, Column] = {}
    for name in wanted:
        if name in ROW_FEATURES:
            columns.update(ROW_FEATURES[name]())
    out = df.withColumns(columns) if columns else df
    indices = [f for f in wanted if f in FIRE_INDICES]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if indices and "rolling_precipitation" in wanted and grid.size >= 4 * tasks:
        # With enough cells, one move by cell serves both the days of a block and the days of a year.
        out = out.repartition(*CELL)
    if "rolling_precipitation" in wanted:
        out = rolling_sum(out, "tp", day=day)
    if indices:
        inputs = weather.fire_index_inputs(temp_offset)
        fresh = out.columns
        out = fire_weather(out.withColumns(inputs)).select(*[f"`{c}`" for c in fresh], *indices)
    if "slope" in wanted:
        keep = [c for c in out.columns if c != "elevation"]
        shown = [*keep, "elevation"] if "elevation" in wanted else keep
        out = slope(out.select(*[f"`{c}`" for c in keep]), grid).select(*[f"`{c}`" for c in shown], "slope")
    for name in wanted:
        if name.startswith("clusters_"):
            out = cluster_cells(out, int(name.split("_")[1]))
    return out


def select_features(df: DataFrame, grid: Grid, raw: Sequence[str] | None = None,
                    engineered: Sequence[str] | None = None, temp_offset: float = 0.0,
                    day: Column | None = None) -> DataFrame:
    """Keys, chosen raw columns and engineered features. None takes the defaults, ``['DISABLE']`` none."""
    raw = RAW_FEATURES if not raw else ([] if list(raw) == DISABLE else list(raw))
    engineered = ENGINEERED_FEATURES if not engineered else ([] if list(engineered) == DISABLE else list(engineered))
    out = with_features(df, engineered, grid, temp_offset, day)
    keys = [*CELL_DAY, *existing(df, ["latitude", "longitude"])]
    made = [c for c in out.columns if c not in df.columns]
    return out.select(*keys, *[f"`{c}`" for c in existing(df, [c for c in raw if c not in keys])],
                      *[f"`{c}`" for c in made])


def process(df: DataFrame, grid: Grid, raw: Sequence[str] | None = None,
            engineered: Sequence[str] | None = None, by: Sequence[str] = (), fit_on: Column | None = None,
            audit_path: str | None = None, drop_leap: bool = False) -> DataFrame:
    """Clean, choose and engineer features, scale numbers, encode categories: keys plus model inputs.

    ``by`` fits the scalers per group, for example per ``period``; ``fit_on`` fits them on some rows only.
    ``drop_leap`` removes each Feb 29 first; rolling sums then take Feb 28 and Mar 1 as adjacent.
    """
    rows = drop_leap_days(clean(df)) if drop_leap else clean(df)
    table = select_features(rows, grid, raw, engineered, day=leapless_day() if drop_leap else None)
    # The scalers read the features for their statistics and again for the result: compute them once.
    table = cut_lineage(table)
    if list(by) == ["period"]:
        table = table.withColumn("period", F.date_format("date", "yyyyMM"))
    audited = table
    table = scale(table, existing(table, STANDARD), existing(table, MINMAX), by, fit_on)
    table = one_hot(table, existing(table, CATEGORICAL), KNOWN_CATEGORIES)
    write_audit({"features": audited, "processed": table} if audit_path else {}, audit_path)
    return table.drop("period") if list(by) == ["period"] else table
