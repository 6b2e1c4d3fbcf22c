import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid import Grid
from cindergrid.functions.fireweather import fire_weather
from cindergrid.operators import grid as g, windows
from helpers import rows

START = dt.date(2023, 12, 20)


def daily(spark, n, cells=2, value=lambda c, i: float(c * 1000 + i), skip=()):
    data = [(START + dt.timedelta(days=i), 0, c, value(c, i), int(i % 5 == 0))
            for c in range(cells) for i in range(n) if (c, i) not in skip]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, "date date, cell_r bigint, cell_c bigint, tp double, is_fire_day int")


@pytest.mark.parametrize("span", [6, 7, 10, 366])
def test_blocks_do_not_change_results(spark, span):
    df = daily(spark, 40)
    sums = windows.rolling_sum(df, days=7, span=span)
    assert sums.count() == 80
    for r in sums.collect():
        i = (r.date - START).days
        want = sum(r.cell_c * 1000 + j for j in range(max(0, i - 6), i + 1))
        assert r.rolling_precipitation == want
    out = windows.lookback_samples(df, ["tp"], 6, 3, span=span)
    assert out.count() == 2 * (40 - 6 - 3)
    for r in out.collect():
        i = (r.date - START).days
        assert [x.tp for x in r.window] == [r.cell_c * 1000 + j for j in range(i - 6, i)]
        assert r.target == int((i + 3) % 5 == 0) and r.target_date == START + dt.timedelta(days=i + 3)


def test_lags_count_days_not_rows(spark):
    df = daily(spark, 10, cells=1, skip={(0, 4)})
    kept = windows.lagged(df, ["tp"], (1, 2, 3))
    assert [(r.date - START).days for r in kept.orderBy("date").collect()] == [3, 8, 9]
    every = windows.lagged(df, ["tp"], (1,), drop_incomplete=False)
    assert every.filter("tp_lag_1 is null").count() == 2


def test_samples_need_every_day(spark):
    df = daily(spark, 12, cells=1, skip={(0, 5)})
    out = windows.lookback_samples(df, ["tp"], 3, 1)
    assert [(r.date - START).days for r in out.orderBy("date").collect()] == [3, 9, 10]


def test_dense_index_bridges_removed_days(spark):
    days = [dt.date(2024, 2, 27) + dt.timedelta(days=i) for i in range(5)]
    df = spark.createDataFrame([(d, 0, 0, 1.0, 0) for d in days if d != dt.date(2024, 2, 29)],
                               "date date, cell_r bigint, cell_c bigint, tp double, is_fire_day int")
    indexed = df.join(g.day_index(df), "date")
    assert windows.lookback_samples(df, ["tp"], 2, 1).count() == 0
    assert windows.lookback_samples(indexed, ["tp"], 2, 1, day=F.col("day_idx")).count() == 1


def test_fire_before_excludes_today(spark):
    df = daily(spark, 20, cells=1, value=lambda c, i: 0.0).withColumn(
        "is_fire_day", (F.col("date") == F.lit(START + dt.timedelta(days=3))).cast("int"))
    out = [r.fire_before for r in windows.fire_before(df).orderBy("date").collect()]
    assert out == [0] * 4 + [1] * 14 + [0] * 2


def test_flatten_orders_days_then_static(spark):
    out = windows.lookback_samples(daily(spark, 5, cells=1), ["tp", "is_fire_day"], 2, 1)
    flat = windows.flatten_window(out, ["tp", "is_fire_day"], ["cell_c"]).orderBy("date").first()
    assert flat.inputs == [0.0, 1.0, 1.0, 0.0, 0.0]


def test_gradient_matches_formula_on_uneven_spacing(spark):
    x, f = [0.0, 1.0, 3.0, 3.5], [0.0, 1.0, 9.0, 12.25]
    df = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(x, f))], "l int, i int, x double, f double")
    got = [r.d for r in windows.gradient(df, "f", "x", ["l"], "i", "d").orderBy("i").collect()]
    assert got == pytest.approx([1.0, 2.0, 6.0, 6.5])  # second order is exact for x squared
    lone = windows.gradient(df.filter("i = 0"), "f", "x", ["l"], "i", "d").first()
    assert lone.d == 0.0


def test_slope_is_static_per_cell(spark):
    grid = Grid.over((49, 50.2), (-120, -118.8), 0.3)
    dates = spark.createDataFrame([(START,), (START + dt.timedelta(days=1),)], "date date")
    cells = g.scaffold(dates, grid).withColumn("z", F.col("cell_r") * 9.8067 * 1000)
    out = windows.slope(cells, grid)
    assert out.count() == 32
    for r in out.collect():
        assert r.slope == pytest.approx(1000 / (0.3 * 111320)) and r.elevation == pytest.approx(1000 * r.cell_r)


def test_season_split_bounds(spark):
    days = [dt.date(y, m, d) for y in (2019, 2020, 2021, 2022) for m, d in ((2, 23), (2, 24), (9, 25), (9, 26))]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    got = {(r.date.year, r.date.month, r.date.day, r.split) for r in windows.season_split(df, (2019, 2020), 2021).collect()}
    assert got == {(y, m, d, "test" if y == 2021 else "train") for y in (2019, 2020, 2021) for m, d in ((2, 24), (9, 25))}


def weather(spark, values, start=dt.date(2024, 4, 13)):
    return spark.createDataFrame([(start + dt.timedelta(days=i), 0, 0, *v) for i, v in enumerate(values)],
                                 "date date, cell_r bigint, cell_c bigint, temp_c double, humidity double, wind_kmh double, rain_mm double")


def test_published_sample_day(spark):
    r = fire_weather(weather(spark, [(17.0, 42.0, 25.0, 0.0)])).first()
    # The sample row published with the system, to one digit: 87.7, 8.5, 19.0, 10.9, 8.5, 10.1.
    assert [round(v, 1) for v in (r.fine_fuel_moisture_code, r.duff_moisture_code, r.drought_code, r.initial_spread_index,
                                  r.build_up_index, r.fire_weather_index)] == [87.7, 8.5, 19.0, 10.9, 8.5, 10.1]


def test_codes_carry_over_and_restart_with_the_year(spark):
    day = (20.0, 40.0, 10.0, 0.0)
    start = dt.date(2023, 12, 30)
    got = [r.drought_code for r in fire_weather(weather(spark, [day] * 4, start)).orderBy("date").collect()]
    assert got[1] > got[0] and got[2] == pytest.approx(got[0]) and got[3] == pytest.approx(got[1])


def test_missing_weather_leaves_state(spark):
    day = (20.0, 40.0, 10.0, 0.0)
    full = [r.drought_code for r in fire_weather(weather(spark, [day] * 2)).orderBy("date").collect()]
    gap = [r.drought_code for r in fire_weather(weather(spark, [day, (None, 40.0, 10.0, 0.0), day])).orderBy("date").collect()]
    assert gap == [full[0], None, full[1]]


def test_season_starts_and_ends_on_third_day(spark):
    temps = [13.0, 13.0, 12.0, 13.0, 13.0, 13.0, 8.0, 4.0, 4.0, 4.0, 20.0]
    df = weather(spark, [(t, 50.0, 5.0, 0.0) for t in temps])
    got = [r.in_season for r in windows.fire_season_mask(df).orderBy("date").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0]
    codes = fire_weather(windows.fire_season_mask(df), season="in_season").orderBy("date").collect()
    assert [r.drought_code is None for r in codes] == [not s for s in got]


def test_dry_start_counts_days_since_the_last_wet_one(spark):
    """Over gaps and the turn of the year; the day's own rain doesn't count, nor does a day at the limit."""
    wet, dry, limit = (20.0, 40.0, 10.0, 9.0), (20.0, 40.0, 10.0, 0.0), (20.0, 40.0, 10.0, 1.5)
    start = dt.date(2023, 12, 26)

    def first(values, **options):
        df = weather(spark, values, start).withColumn("on", (F.col("date") >= dt.date(2024, 1, 1)).cast("int"))
        return fire_weather(df, season="on", **options).where("date = date'2024-01-01'").first()

    def alike(r, duff, deep, last):
        want = fire_weather(weather(spark, [last], dt.date(2024, 1, 1)), starts=(85.0, duff, deep)).first()
        assert (r.duff_moisture_code, r.drought_code, r.fine_fuel_moisture_code) == pytest.approx(
            (want.duff_moisture_code, want.drought_code, want.fine_fuel_moisture_code))

    days = [dry, wet, limit, dry, dry, dry, dry]
    alike(first(days, dry_start=True), 1.2 * 5, 5.0 * 5, dry)
    alike(first(days[:2] + days[-2:] + [dry, dry, wet], dry_start=True, dry_factors=(2.0, 3.0)), 2.0 * 5, 3.0 * 5, wet)
    alike(first([dry] * 7, dry_start=True), 6.0, 15.0, dry)
    alike(first(days), 6.0, 15.0, dry)


def test_dry_start_again_in_the_second_season(spark):
    values = [(20.0, 40.0, 10.0, 0.0)] * 3 + [(20.0, 40.0, 10.0, 8.0)] + [(20.0, 40.0, 10.0, 0.0)] * 46
    df = weather(spark, values, dt.date(2024, 6, 1)).withColumn("on", F.when(F.dayofmonth("date").between(10, 12), 0).otherwise(1))
    got = fire_weather(df, season="on", dry_start=True).orderBy("date").collect()
    want = fire_weather(weather(spark, values[12:30], dt.date(2024, 6, 13)), starts=(85.0, 1.2 * 9, 5.0 * 9)).orderBy("date").collect()
    assert [r.drought_code for r in got[9:12]] == [None] * 3
    assert [r.drought_code for r in got[12:30]] == pytest.approx([r.drought_code for r in want])


def test_windows_are_never_unpartitioned(spark):
    df = daily(spark, 20)
    for out in (windows.rolling_sum(df), windows.lagged(df, ["tp"]), windows.lookback_samples(df, ["tp"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan


def test_day_slice(spark):
    df = daily(spark, 10)
    got = windows.day_slice(df, g.day_index(df), 2, 3, ["tp"])
    assert sorted({r.day_idx for r in got.collect()}) == [2, 3, 4] and got.count() == 6
    assert rows(g.day_index(df), "date")[0] == (0, START)


def test_removed_leap_days_are_adjacent(spark):
    days = spark.sql("SELECT explode(sequence(date'1999-12-25', date'2004-03-10')) date").where("date_format(date, 'MM-dd') <> '02-29'")
    df = days.selectExpr("date", "0L cell_r", "0L cell_c", "1.0D tp", "cast(date = date'2004-02-28' as int) is_fire_day")
    numbers = [r.n for r in df.select(windows.leapless_day().alias("n"), "date").orderBy("date").collect()]
    assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
    on = {str(r.date): r for r in windows.fire_before(windows.rolling_sum(df, day=windows.leapless_day()), 2, day=windows.leapless_day()).collect()}
    assert on["2004-03-01"].rolling_precipitation == on["2000-03-03"].rolling_precipitation == 7.0
    assert [on[f"2004-03-0{i}"].fire_before for i in (1, 2, 3)] == [1, 1, 0]
    assert windows.lagged(df, ["tp"], (3,), day=windows.leapless_day()).count() == df.count() - 3


@pytest.mark.parametrize("span", [1, 3, 4096])
def test_gradient_over_block_edges_and_gaps(spark, span):
    rng = np.random.default_rng(4)
    at = np.sort(rng.choice(60, 25, replace=False))
    z, x = rng.normal(size=25), np.cumsum(rng.uniform(0.5, 2, 60))[at]
    df = spark.createDataFrame([(0, int(o), float(v), float(p)) for o, v, p in zip(at, z, x)] + [(1, 5, 2.0, 3.0)],
                               "line int, o int, z double, x double")
    got = {(r.line, r.o): r.g for r in windows.gradient(df, "z", "x", ["line"], "o", "g", span=span).collect()}
    want = np.gradient(z, x)
    assert all(got[0, int(o)] == pytest.approx(w) for o, w in zip(at, want)) and got[1, 5] == 0.0
