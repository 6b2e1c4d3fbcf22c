import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindergrid.functions import surface, temporal, values, weather
from cindergrid.operators import quality, scaling


def test_depth_weights_follow_linear_interpolation():
    w = np.array(surface.depth_weights())
    layers = np.array([4.0, -2.0, 9.0, 1.0])
    want = np.interp(np.linspace(0, 289, 10), [7, 28, 100, 289], layers)
    assert np.allclose(w @ layers, want) and np.allclose(w.sum(axis=1), 1)


def test_waterheat_is_zero_at_zero_temperature(spark):
    df = spark.range(1).select(*[F.lit(0.2).alias(f"swvl{i}") for i in range(1, 5)],
                               *[F.lit(0.0).alias(f"stl{i}") for i in range(1, 5)])
    r = df.select(*[c.alias(n) for n, c in surface.depth_waterheat().items()]).first()
    assert r.surface_water_heat_3 == 0.0 and r.daily_water_sum == pytest.approx(2.0) and len(r) == 12


def test_seasons_including_leap_day(spark):
    cases = {"2024-02-29": ("Winter", "off_season"), "2024-03-01": ("Winter", "off_season"), "2024-03-02": ("Winter", "on_season"),
             "2024-03-19": ("Winter", "on_season"), "2024-03-20": ("Spring", "on_season"), "2024-04-30": ("Spring", "on_season"),
             "2024-05-01": ("Spring", "core_season"), "2024-06-21": ("Summer", "core_season"), "2024-08-31": ("Summer", "core_season"),
             "2024-09-01": ("Summer", "on_season"), "2024-09-22": ("Autumn", "on_season"), "2024-10-01": ("Autumn", "off_season"),
             "2024-12-20": ("Autumn", "off_season"), "2024-12-21": ("Winter", "off_season")}
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in cases] + [(None,)], "date date")
    got = {str(r.date): (r.s, r.f) for r in df.select("date", temporal.season().alias("s"), temporal.fire_season().alias("f")).collect()}
    assert got == {**cases, "None": (None, None)}


def test_lightning_ratio_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0, 0.0), (4, 10.0)], "lightning_count int, absv_strength_sum double")
    got = [tuple(r) for r in df.select(weather.lightning_ratio(), weather.lightning_product()).collect()]
    assert got == [(0.0, 0.0), (2.5, 40.0)]


def test_soil_codes(spark):
    got = [r[0] for r in spark.range(9).select(surface.soil_class("id")).collect()]
    assert got == ["Non-soil", "Coarse", "Coarse", "Medium", "Medium", "Medium", "Organic", "Organic", None]


def test_finite_or_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(values.finite_or_zero("x")).collect()] == [0, 0, 0, 0, 2.5]


def test_risk_classes_open_at_the_bound(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.149, 0.15, 0.45, 0.6, 1.0)], "p double")
    assert [r[0] for r in df.select(values.risk_class("p")).collect()] == [0, 1, 1, 2, 5, 6, 6]


def test_tags(spark):
    tags = [{"railway": "rail"}, {"railway": "tram"}, {"highway": "primary"}, {"highway": "primary_link"},
            {"power": "line", "waterway": "x"}, {}, {"aeroway": "aerodrome"}]
    df = spark.createDataFrame([(t,) for t in tags], "tags map<string,string>")
    got = [r[0] for r in df.select(values.categories_of_tags("tags")).collect()]
    assert got == [["railway"], [], ["highway"], [], ["power_line", "waterway"], [], ["aeroway"]]


def test_element_points(spark):
    payload = '{"elements":[{"lat":1.5,"lon":2.5},{"center":{"lat":3.0,"lon":4.0}},{"lat":9.0},{"type":"x"}]}'
    got = spark.createDataFrame([(payload,)], "p string").select(F.inline(values.element_points("p"))).collect()
    assert [tuple(r) for r in got] == [(1.5, 2.5), (3.0, 4.0)]


def test_mixed_dates(spark):
    df = spark.createDataFrame([("2023/10/01 05:06:07",), ("2023-10-01",), ("10/01/2023 05:06",), ("soon",), (None,)], "t string")
    got = [r[0] for r in df.select(F.to_date(temporal.parse_date("t"))).collect()]
    assert got == [dt.date(2023, 10, 1)] * 3 + [None, None]


def test_scalers(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 8.0, 5.0)], "k int, x double, flat double")
    s = scaling.standard_scale(df, ["x", "flat"]).agg(F.avg("x"), F.stddev_pop("x"), F.max("flat")).first()
    assert s[0] == pytest.approx(0, abs=1e-12) and s[1] == pytest.approx(1) and s[2] == 0
    m = [tuple(r) for r in scaling.minmax_scale(df, ["x", "flat"]).orderBy("k").collect()]
    assert m == [(1, 0.0, 0.0), (2, pytest.approx(2 / 7), 0.0), (3, 1.0, 0.0)]
    fitted = scaling.minmax_scale(df, ["x"], fit_on=F.col("k") < 3).orderBy("k").collect()
    assert [r.x for r in fitted] == [0.0, 1.0, 3.5]


def test_one_hot_names_and_missing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    out = scaling.one_hot(df, ["k"], keep=True)
    assert out.columns == ["k", "k_b", "k_c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    with pytest.raises(ValueError):
        scaling.categories_of(spark.range(20), "id", limit=5)


def test_arranged(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, `2t` int, date int, helper int")
    assert quality.arranged(df, drop=["helper", "absent"]).columns == ["date", "a", "2t"]


def test_impute(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (5.0,)], "x double")
    assert [r[0] for r in scaling.impute_mean(df, ["x"]).collect()] == [1.0, 3.0, 3.0, 5.0]
