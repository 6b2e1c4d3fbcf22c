"""The stream against the batch fold: by the same days, over restarts, the year's end and late files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cindergrid.functions.fireweather import fire_weather
from cindergrid.streaming.codes import fire_weather_stream, last_codes, write_new_days

SCHEMA = "date date, cell_r bigint, cell_c bigint, temp_c double, humidity double, wind_kmh double, rain_mm double, on int"
SIX = ["fine_fuel_moisture_code", "duff_moisture_code", "drought_code", "initial_spread_index", "build_up_index", "fire_weather_index"]


def days(seed, start, n, cells=4):
    r = random.Random(seed)
    return [(start + dt.timedelta(days=i), c, 0, r.choice([None, 25.0, 18.0, 3.0, 12.0]), 20.0 + r.random() * 70, r.random() * 30,
             r.choice([0.0, 0.0, 1.0, 6.0, 20.0]), int(i % 9 not in (0, 1))) for i in range(n) for c in range(cells)]


def run(spark, tmp_path, files, initial=None, **options):
    """Each entry of ``files`` is a run of its own: three files written, then the stream taken on from its checkpoint."""
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).repartition(3, "cell_r").write.mode("append").parquet(source)
        stream = fire_weather_stream(spark.readStream.schema(SCHEMA).parquet(source), season="on", initial=initial, **options)
        write_new_days(stream, out, progress).awaitTermination()
    return spark.read.parquet(out)


def table(df):
    return {(r.cell_r, r.date): [r[c] for c in SIX] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert [x is None for x in got[k]] == [x is None for x in want[k]], k
        assert [x or 0.0 for x in got[k]] == pytest.approx([x or 0.0 for x in want[k]], rel=1e-9), k


def test_restarts_and_the_turn_of_the_year(spark, tmp_path):
    rows = days(4, dt.date(2023, 12, 20), 30)
    cut = [dt.date(2023, 12, 20), dt.date(2023, 12, 27), dt.date(2024, 1, 5), dt.date(2024, 2, 1)]
    files = [[r for r in rows if a <= r[0] < b] for a, b in zip(cut, cut[1:])]
    got = run(spark, tmp_path, files, dry_start=True)
    same(table(got), table(fire_weather(spark.createDataFrame(rows, SCHEMA), season="on", dry_start=True)))


def test_goes_on_from_the_batch_fold_and_leaves_out_late_days(spark, tmp_path):
    rows = days(6, dt.date(2024, 5, 1), 24)
    old = [r for r in rows if r[0] < dt.date(2024, 5, 15)]
    batch = fire_weather(spark.createDataFrame(old, SCHEMA), season="on")
    # The second run also brings days again that were already taken.
    files = [[r for r in rows if dt.date(2024, 5, 15) <= r[0] < dt.date(2024, 5, 20)], [r for r in rows if r[0] >= dt.date(2024, 5, 19)]]
    got = run(spark, tmp_path, files, initial=last_codes(batch))
    whole = table(fire_weather(spark.createDataFrame(rows, SCHEMA), season="on"))
    same(table(got), {k: v for k, v in whole.items() if k[1] >= dt.date(2024, 5, 15)})
    assert got.count() == len(whole) - len(old)


def test_cells_share_a_state(spark, tmp_path):
    """Forty cells in two states, over a restart and from the batch fold; some of them come only later."""
    rows = [r for r in days(8, dt.date(2024, 5, 1), 12, cells=40) if r[1] < 30 or r[0] > dt.date(2024, 5, 6)]
    cut = [dt.date(2024, 5, 5), dt.date(2024, 5, 8), dt.date(2024, 6, 1)]
    batch = fire_weather(spark.createDataFrame([r for r in rows if r[0] < cut[0]], SCHEMA), season="on", dry_start=True)
    files = [[r for r in rows if a <= r[0] < b] for a, b in zip(cut, cut[1:])]
    got = run(spark, tmp_path, files, initial=last_codes(batch), dry_start=True, buckets=2)
    whole = table(fire_weather(spark.createDataFrame(rows, SCHEMA), season="on", dry_start=True))
    same(table(got), {k: v for k, v in whole.items() if k[1] >= cut[0]})
