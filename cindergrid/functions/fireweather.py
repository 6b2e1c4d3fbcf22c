"""Daily fire-weather codes and indices (the published Canadian system).

Three moisture codes depend on the day before. Everything that depends only on the day's weather is
computed beforehand in ordinary columns; the day-to-day part is one fold over the at most 366 days of a
cell and year, because the codes restart each year.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cindergrid.operators.grid import CELL

# Start codes and the day-length tables by month.
FFMC_START, DMC_START, DC_START = 85.0, 6.0, 15.0
DMC_DAY_LENGTH = [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0]
DC_DAY_LENGTH = [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6]
MOISTURE = 147.2
#: Dry start: rain in mm above which a day is wet, and what each day since the last wet one adds to the start codes.
WET_DAY, DMC_DRY_FACTOR, DC_DRY_FACTOR = 1.5, 1.2, 5.0
#: Days folded at once; the codes of a block are joined to those before it once.
BLOCK = 19
INPUTS = ["temp_c", "humidity", "wind_kmh", "rain_mm"]


def _by_month(values: list[float], month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), month)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def day_terms() -> dict[str, Column]:
    """What one day's weather contributes, independent of the codes of the day before."""
    t, h, w, p, month = (F.col(c) for c in (*INPUTS, "_month"))
    r = p - 0.5
    wet = p > 0.5
    tail = 0.18 * (21.1 - t) * (1 - F.exp(-0.115 * h))
    rise = F.exp((h - 100) / 10)

    def rate(x: Column) -> Column:
        k = (0.424 * (1 - F.pow(x, F.lit(1.7))) + 0.0694 * F.sqrt(w) * (1 - F.pow(x, F.lit(8.0))))
        return F.pow(F.lit(10.0), -(k * 0.581 * F.exp(0.0365 * t)))

    pe = 0.5 * F.greatest(0.36 * (F.greatest(t, F.lit(-2.8)) + 2.8) + _by_month(DC_DAY_LENGTH, month), F.lit(0.0))
    dry = 1.894e-4 * (F.greatest(t, F.lit(-1.1)) + 1.1) * (100 - h) * _by_month(DMC_DAY_LENGTH, month)
    return {
        "rain": F.when(wet, 42.5 * r * (1 - F.exp(-6.93 / F.greatest(r, F.lit(1e-9))))).otherwise(0.0),
        "root": F.when(wet, F.sqrt(F.greatest(r, F.lit(0.0)))).otherwise(0.0),
        "ed": 0.942 * F.pow(h, F.lit(0.679)) + 11 * rise + tail,
        "ew": 0.618 * F.pow(h, F.lit(0.753)) + 10 * rise + tail,
        "drying": rate(h / 100), "wetting": rate((100 - h) / 100),
        "duff_rain": F.when(p > 1.5, 0.92 * p - 1.27).otherwise(0.0), "duff_dry": dry,
        "deep_rain": F.when(p > 2.8, 0.83 * p - 1.27).otherwise(0.0), "deep_dry": pe,
    }


def moisture_content(ffmc: Column) -> Column:
    """Fine fuel moisture content in percent that a fine fuel moisture code stands for."""
    return MOISTURE * (101 - ffmc) / (59.5 + ffmc)


def _fine(m0: Column, x: Column) -> Column:
    """Fine fuel moisture code after the day, from the moisture content before it."""
    soaked = F.least(F.lit(250.0), m0 + x["rain"] * F.exp(-100 / (251 - m0)) + F.when(
        m0 > 150, 0.0015 * (m0 - 150) * (m0 - 150) * x["root"]).otherwise(0.0))
    after = _let(soaked, lambda m: F.when(m > x["ed"], x["ed"] + (m - x["ed"]) * x["drying"])
                 .when(m < x["ew"], x["ew"] - (x["ew"] - m) * x["wetting"]).otherwise(m))
    return _let(after, lambda m: 59.5 * (250 - m) / (MOISTURE + m))


def _duff(p0: Column, x: Column) -> Column:
    """Duff moisture code after the day."""
    log = F.ln(F.greatest(p0, F.lit(1e-9)))
    b = (F.when(p0 <= 33, 100 / (0.5 + 0.3 * p0)).when(p0 <= 65, 14 - 1.3 * log).otherwise(6.2 * log - 17.2))
    mr = 20 + F.exp(5.6348 - p0 / 43.43) + 1000 * x["duff_rain"] / (48.77 + b * x["duff_rain"])
    rained = F.greatest(F.lit(0.0), 244.72 - 43.43 * F.ln(mr - 20))
    return F.when(x["duff_rain"] > 0, rained).otherwise(p0) + x["duff_dry"]


def _deep(d0: Column, x: Column) -> Column:
    """Drought code after the day."""
    q = 800 * F.exp(-d0 / 400) + 3.937 * x["deep_rain"]
    rained = F.greatest(F.lit(0.0), 400 * F.ln(800 / q))
    return F.when(x["deep_rain"] > 0, rained).otherwise(d0) + x["deep_dry"]


def indices(ffmc: Column, duff: Column, deep: Column, wind: Column) -> dict[str, Column]:
    """The six published codes and indices from the three codes and the wind."""
    moisture = moisture_content(ffmc)
    isi = 0.208 * F.exp(0.05039 * wind) * 91.9 * F.exp(-0.1386 * moisture) * (
        1 + F.pow(moisture, F.lit(5.31)) / 4.93e7)
    both = duff + 0.4 * deep
    bui = F.when(both.isNull(), None).when(both <= 0, 0.0).when(duff <= 0.4 * deep, 0.8 * duff * deep / both).otherwise(
        F.greatest(F.lit(0.0), duff - (1 - 0.8 * deep / both) * (0.92 + F.pow(0.0114 * duff, F.lit(1.7)))))
    fd = F.when(bui <= 80, 0.626 * F.pow(bui, F.lit(0.809)) + 2).otherwise(
        1000 / (25 + 108.64 * F.exp(-0.023 * bui)))
    b = 0.1 * isi * fd
    fwi = F.when(b > 1, F.exp(2.72 * F.pow(0.434 * F.ln(F.greatest(b, F.lit(1.0))), F.lit(0.647)))).otherwise(b)
    return {"fine_fuel_moisture_code": ffmc, "duff_moisture_code": duff, "drought_code": deep,
            "initial_spread_index": isi, "build_up_index": bui, "fire_weather_index": fwi}


def days_since_wet(df: DataFrame, by: Sequence[str], wet: float = WET_DAY, name: str = "days_dry") -> DataFrame:
    """Add the number of days since the last earlier day of more than ``wet`` mm; NULL where none is known.

    A window holds one cell and year; the last wet days of the years before come from one row a year.
    """
    last = F.max(F.when(F.col("rain_mm") > wet, F.col("date")))
    rows = df.withColumn("_y", F.year("date"))
    here = last.over(Window.partitionBy(*by, "_y").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    years = rows.groupBy(*by, "_y").agg(last.alias("_last"))
    ahead = Window.partitionBy(*by).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select(*by, "_y", F.max("_last").over(ahead).alias("_earlier"))
    # The day itself doesn't count: its own rain is part of its own codes.
    before = F.lag("_upto").over(Window.partitionBy(*by, "_y").orderBy("date"))
    out = rows.withColumn("_upto", here).withColumn("_before", before).join(years, [*by, "_y"])
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.date_diff("date", F.coalesce("_before", "_earlier")).alias(name))


def fire_weather(df: DataFrame, by: Sequence[str] = tuple(CELL), season: str | None = None,
                 starts: tuple[float, float, float] = (FFMC_START, DMC_START, DC_START), dry_start: bool = False,
                 wet: float = WET_DAY, dry_factors: tuple[float, float] = (DMC_DRY_FACTOR, DC_DRY_FACTOR)) -> DataFrame:
    """Add the six indices to daily rows with ``date, temp_c, humidity, wind_kmh, rain_mm``.

    Codes run day by day within a cell and year from ``starts``. With ``season`` (a 0/1 column) they run
    only on days in season, start anew at the first day of each season, and are NULL outside it. A day with missing weather has
    NULL codes and leaves the state as it was.

    With ``dry_start`` the duff moisture and drought codes of a season's first day, or of a year's without seasons,
    start at ``dry_factors`` times the days since the last day of more than ``wet`` mm, be it off season or in an
    earlier year; where no wet day is known, and for the fine fuel moisture code, at ``starts``.
    """
    keep = df.columns
    if dry_start:
        df = days_since_wet(df, by, wet, "_dry")
    duff, deep = (F.coalesce(factor * F.col("_dry"), F.lit(start)) if dry_start else F.lit(start) for factor, start in zip(dry_factors, starts[1:]))
    first = F.struct(F.lit(starts[0]).alias("f"), duff.cast("double").alias("p"), deep.cast("double").alias("d"))
    weather = df.withColumns({"_month": F.month("date"), "_year": F.year("date")}).withColumns(
        {f"_t_{k}": v for k, v in day_terms().items()})
    terms = F.struct(*[F.col(f"_t_{k}").alias(k) for k in day_terms()])
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in INPUTS])
    # 0 off season, 1 a day to compute, NULL a day without complete weather.
    on = F.when(F.coalesce(F.col(season), F.lit(0)) == 0, 0).when(known, 1) if season else F.when(known, 1)
    # The original columns other than the keys travel inside the array, so nothing is joined back.
    rest = F.struct(*[F.col(f"`{c}`") for c in keep if c not in by])
    days = weather.groupBy(*by, "_year").agg(F.array_sort(F.collect_list(F.struct(
        F.col("date").alias("_d"), on.alias("on"), terms.alias("x"), first.alias("first"), rest.alias("row")))).alias("_days"))

    nullable = "struct<f: double, p: double, d: double>"
    none = F.struct(*[F.lit(None).cast("double").alias(n) for n in ("f", "p", "d")])
    empty = F.array().cast(f"array<{nullable}>")

    def step(acc: Column, day: Column) -> Column:
        x = day["x"]
        # No codes: off season, or before the first day.
        s = F.when(acc["s"]["f"].isNull(), day["first"].cast(nullable)).otherwise(acc["s"])
        new = _let(s, lambda s: F.struct(_let(moisture_content(s["f"]), lambda m: _fine(m, x)).alias("f"), _duff(s["p"], x).alias("p"), _deep(s["d"], x).alias("d")))
        blank = F.concat(acc["out"], F.array(none)).alias("out")
        return (F.when(day["on"] == 0, F.struct(none.alias("s"), blank))
                .when(day["on"] == 1, _let(new, lambda n: F.struct(
                    n.alias("s"), F.concat(acc["out"], F.array(n)).alias("out"))))
                .otherwise(F.struct(acc["s"].alias("s"), blank)))

    def block(acc: Column, part: Column) -> Column:
        folded = F.aggregate(part, F.struct(acc["s"].alias("s"), empty.alias("out")), step)
        return _let(folded, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_days") - 1) / BLOCK).cast("int")), lambda i: F.slice("_days", i * BLOCK + 1, BLOCK))
    folded = F.aggregate(parts, F.struct(none.alias("s"), F.array().cast(f"array<array<{nullable}>>").alias("out")), block, lambda acc: F.flatten(acc["out"]))
    rows = days.select(*by, F.explode(F.arrays_zip(F.col("_days.row").alias("row"), folded.alias("code"))).alias("z"))
    out = rows.select(*by, "z.row.*", F.col("z.code.f").alias("_f"), F.col("z.code.p").alias("_p"),
                      F.col("z.code.d").alias("_dc"))
    six = indices(F.col("_f"), F.col("_p"), F.col("_dc"), F.col("wind_kmh"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in six.items()])
