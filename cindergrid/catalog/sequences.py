"""Per-cell windows, images, seasons and fire weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.registry import (AREA, CELLDAYS_SQL, LIGHTNING_SQL, WIDE, celldays, event_days, query, rounded,
                                         strikes, table)
from cindergrid.functions.fireweather import fire_weather
from cindergrid.operators import grid as g, joins, windows
from cindergrid.operators.aggregates import strikes_by_cellday
from cindergrid.operators.sampling import shuffled_batches
from cindergrid.plans.features import drop_leap_days
from cindergrid.session import shared_folder
from cindergrid.streaming.codes import fire_weather_stream, last_codes, write_new_days

OVER = "OVER (PARTITION BY cell_r, cell_c ORDER BY date"


@query("rolling_precip", f"""
WITH {CELLDAYS_SQL} SELECT date, cell_r, cell_c,
  round(sum(tp) {OVER} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling_precipitation FROM celldays""")
def rolling_precip(spark, d):
    out = windows.rolling_sum(celldays(spark, d)).select(*g.CELL_DAY, "rolling_precipitation")
    return rounded(out, "rolling_precipitation")


@query("lags", f"""
WITH {CELLDAYS_SQL}, l AS (SELECT date, cell_r, cell_c,
  {', '.join(f'round(lag(tp, {k}) {OVER}), 6) AS tp_lag_{k}, lag(n_events, {k}) {OVER}) AS n_events_lag_{k}' for k in (1, 2, 3))} FROM celldays)
SELECT * FROM l WHERE tp_lag_3 IS NOT NULL""")
def lags(spark, d):
    names = [f"{c}_lag_{k}" for c in ("tp", "n_events") for k in (1, 2, 3)]
    out = windows.lagged(celldays(spark, d), ["tp", "n_events"]).select(*g.CELL_DAY, *names)
    return rounded(out, *names[:3])


@query("past_fire", f"""
WITH {CELLDAYS_SQL} SELECT date, cell_r, cell_c,
  coalesce(max(is_fire_day) {OVER} ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0) AS fire_before FROM celldays""")
def past_fire(spark, d):
    return windows.fire_before(celldays(spark, d)).select(*g.CELL_DAY, "fire_before")


#: Cell-days of the orders with many missing days and without leap days, numbered along a calendar that has none either.
GAPS_SQL = """
leapless AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (
  SELECT CAST(unnest(generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2010-12-31', INTERVAL 1 DAY)) AS DATE) AS date)
  WHERE NOT (month(date) = 2 AND day(date) = 29)),
gaps AS (SELECT l.date, l.i, o_custkey % 3 AS cell_r, o_custkey % 2 AS cell_c, sum(o_totalprice) AS tp,
    max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS is_fire_day
  FROM orders o JOIN leapless l ON l.date = CAST(o_orderdate AS DATE) GROUP BY ALL)"""


def gap_days(spark, d):
    o = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 3).alias("cell_r"), (F.col("o_custkey") % 2).alias("cell_c"),
        F.col("o_totalprice").alias("tp"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_fire_day"))
    return drop_leap_days(o).groupBy(*g.CELL_DAY).agg(F.sum("tp").alias("tp"), F.max("is_fire_day").alias("is_fire_day"))


@query("rolling_precip_leap", f"""
WITH {GAPS_SQL} SELECT date, cell_r, cell_c, round(sum(tp) OVER (PARTITION BY cell_r, cell_c ORDER BY i
  RANGE BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS rolling_precipitation FROM gaps""")
def rolling_precip_leap(spark, d):
    out = windows.rolling_sum(gap_days(spark, d), day=windows.leapless_day()).select(*g.CELL_DAY, "rolling_precipitation")
    return rounded(out, "rolling_precipitation", digits=2)


@query("lags_leap", f"""
WITH {GAPS_SQL} SELECT t.date, t.cell_r, t.cell_c, round(a.tp, 2) AS tp_lag_1, round(b.tp, 2) AS tp_lag_2
FROM gaps t LEFT JOIN gaps a ON a.cell_r = t.cell_r AND a.cell_c = t.cell_c AND a.i = t.i - 1
LEFT JOIN gaps b ON b.cell_r = t.cell_r AND b.cell_c = t.cell_c AND b.i = t.i - 2""")
def lags_leap(spark, d):
    out = windows.lagged(gap_days(spark, d), ["tp"], (1, 2), drop_incomplete=False, day=windows.leapless_day())
    return rounded(out.select(*g.CELL_DAY, "tp_lag_1", "tp_lag_2"), "tp_lag_1", "tp_lag_2", digits=2)


@query("windows_leap", f"""
WITH {GAPS_SQL} SELECT t.date, t.cell_r, t.cell_c, a.is_fire_day AS target, a.date AS target_date,
  coalesce((SELECT max(p.is_fire_day) FROM gaps p WHERE p.cell_r = t.cell_r AND p.cell_c = t.cell_c AND p.i BETWEEN t.i - 14 AND t.i - 1), 0) AS fire_before
FROM gaps t JOIN gaps a ON a.cell_r = t.cell_r AND a.cell_c = t.cell_c AND a.i = t.i + 5""")
def windows_leap(spark, d):
    days = windows.leapless_day()
    out = windows.label_ahead(windows.fire_before(gap_days(spark, d), day=days), 5, day=days)
    return out.select(*g.CELL_DAY, "target", "target_date", "fire_before")


@query("label_horizon", f"""
WITH {CELLDAYS_SQL}, l AS (SELECT date, cell_r, cell_c, lead(is_fire_day, 5) {OVER}) AS target,
  lead(date, 5) {OVER}) AS target_date FROM celldays) SELECT * FROM l WHERE target_date IS NOT NULL""")
def label_horizon(spark, d):
    return windows.label_ahead(celldays(spark, d), 5).select(*g.CELL_DAY, "target", "target_date")


@query("windows", f"""
WITH {CELLDAYS_SQL}, numbered AS (
  SELECT *, row_number() {OVER}) AS i, count(*) OVER (PARTITION BY cell_r, cell_c) AS n FROM celldays)
SELECT s.date, s.cell_r, s.cell_c, CAST(x.i - (s.i - 14) AS INTEGER) AS pos, round(x.tp, 6) AS tp, x.n_events,
  t.is_fire_day AS target, t.date AS target_date
FROM numbered s JOIN numbered x ON x.cell_r = s.cell_r AND x.cell_c = s.cell_c AND x.i BETWEEN s.i - 14 AND s.i - 1
JOIN numbered t ON t.cell_r = s.cell_r AND t.cell_c = s.cell_c AND t.i = s.i + 5
WHERE s.i > 14 AND s.i + 5 <= s.n""")
def windows_query(spark, d):
    out = windows.lookback_samples(celldays(spark, d), ["tp", "n_events"], 14, 5)
    rows = out.select(*g.CELL_DAY, "target", "target_date", F.posexplode("window").alias("pos", "x"))
    return rounded(rows.select(*g.CELL_DAY, "pos", "x.tp", "x.n_events", "target", "target_date"), "tp")


@query("flat_inputs", f"""
WITH {CELLDAYS_SQL}, numbered AS (
  SELECT *, row_number() {OVER}) AS i, count(*) OVER (PARTITION BY cell_r, cell_c) AS n FROM celldays),
long AS (
  SELECT s.date, s.cell_r, s.cell_c, 2 * (x.i - (s.i - 4)) AS pos, x.tp AS v FROM numbered s JOIN numbered x
    ON x.cell_r = s.cell_r AND x.cell_c = s.cell_c AND x.i BETWEEN s.i - 4 AND s.i - 1 WHERE s.i > 4 AND s.i + 2 <= s.n
  UNION ALL SELECT s.date, s.cell_r, s.cell_c, 2 * (x.i - (s.i - 4)) + 1, x.n_events FROM numbered s JOIN numbered x
    ON x.cell_r = s.cell_r AND x.cell_c = s.cell_c AND x.i BETWEEN s.i - 4 AND s.i - 1 WHERE s.i > 4 AND s.i + 2 <= s.n
  UNION ALL SELECT date, cell_r, cell_c, 8, user_id FROM numbered WHERE i > 4 AND i + 2 <= n)
SELECT date, cell_r, cell_c, CAST(count(*) AS INTEGER) AS width, round(sum(v * (pos + 1)), 4) AS weighted FROM long GROUP BY ALL""")
def flat_inputs(spark, d):
    out = windows.lookback_samples(celldays(spark, d), ["tp", "n_events"], 4, 2)
    flat = windows.flatten_window(out, ["tp", "n_events"], ["user_id"])
    weighted = F.aggregate(F.transform("inputs", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rounded(flat.select(*g.CELL_DAY, F.size("inputs").alias("width"), weighted.alias("weighted")), "weighted", digits=4)


@query("day_slice", f"""
WITH {CELLDAYS_SQL}, i AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day_idx FROM days)
SELECT date, cell_r, cell_c, day_idx, round(tp, 6) AS tp FROM celldays JOIN i USING (date) WHERE day_idx BETWEEN 3 AND 12""")
def day_slice(spark, d):
    base = celldays(spark, d)
    return rounded(windows.day_slice(base, g.day_index(event_days(spark, d)), 3, 10, ["tp"]), "tp")


@query("season_days", """
WITH dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)),
i AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day_idx FROM dates)
SELECT date, day_idx, CASE WHEN year(date) <= 1999 THEN 'train' ELSE 'test' END AS split FROM i
WHERE month(date) * 100 + day(date) BETWEEN 224 AND 925 AND year(date) BETWEEN 1995 AND 2001""")
def season_days(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    index = g.day_index(drop_leap_days(days))
    return windows.season_split(index, (1995, 1999), (2000, 2001)).select("date", "day_idx", "split")


@query("batches", f"""
WITH dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
i AS (SELECT row_number() OVER (ORDER BY date) - 1 AS day_idx FROM dates),
o AS (SELECT day_idx, row_number() OVER (ORDER BY CAST('0x' || substr(md5(CAST(day_idx AS VARCHAR) || '|42'), 1, 8) AS BIGINT), day_idx) - 1 AS pos,
  count(*) OVER () AS n FROM i)
SELECT CAST(day_idx AS INTEGER) AS day_idx, CAST(pos // 30 AS INTEGER) AS batch FROM o WHERE pos // 30 < n // 30""")
def batches(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return shuffled_batches(g.day_index(days), 30)


@query("dilation_mask", f"""
WITH {CELLDAYS_SQL}, fire AS (SELECT DISTINCT date, cell_r, cell_c FROM celldays WHERE is_fire_day = 1)
SELECT c.date, c.cell_r, c.cell_c, CASE WHEN EXISTS (SELECT 1 FROM fire f WHERE f.date = c.date
  AND f.cell_r BETWEEN c.cell_r - 2 AND c.cell_r + 2 AND f.cell_c BETWEEN c.cell_c - 2 AND c.cell_c + 2) THEN 1 ELSE 0 END AS fire_region
FROM celldays c""")
def dilation_mask(spark, d):
    return joins.dilate(celldays(spark, d), 2, WIDE).select(*g.CELL_DAY, "fire_region")


MEASURES = ["lightning_count", "absv_strength_sum"]


def _images(spark, d):
    lit = strikes_by_cellday(strikes(spark, d), event_days(spark, d), AREA)
    return g.day_images(lit, MEASURES, AREA)


@query("day_images", f"""
WITH {LIGHTNING_SQL}, long AS (
  SELECT date, 'lightning_count' AS feature, cell_r, cell_c, CAST(lightning_count AS DOUBLE) AS v FROM lightning
  UNION ALL SELECT date, 'absv_strength_sum', cell_r, cell_c, absv_strength_sum FROM lightning)
SELECT date, feature, 37 AS height, 34 AS width, 1 AS complete, sum(v * (cell_r * 100 + cell_c)) AS weighted FROM long GROUP BY 1, 2""")
def day_images(spark, d):
    """A checksum per image that depends on where every value sits."""
    lines = F.transform("image", lambda line, r: F.aggregate(
        F.transform(line, lambda v, c: v * (r * 100 + c)), F.lit(0.0), lambda a, b: a + b))
    return _images(spark, d).select(
        "date", "feature", F.size("image").alias("height"), F.size(F.col("image")[0]).alias("width"),
        F.col("complete").cast("int").alias("complete"),
        F.aggregate(lines, F.lit(0.0), lambda a, b: a + b).alias("weighted"))


@query("image_to_rows", f"""
WITH {LIGHTNING_SQL} SELECT date, 'lightning_count' AS feature, cell_r, cell_c, latitude, longitude,
  CAST(lightning_count AS DOUBLE) AS risk_score FROM lightning JOIN area USING (cell_r, cell_c)""")
def image_to_rows(spark, d):
    images = _images(spark, d).filter("feature = 'lightning_count'").drop("complete")
    return g.image_rows(images, AREA)


@query("image_lines", f"""
WITH {LIGHTNING_SQL} SELECT date, 'lightning_count' AS feature, cell_r, 34 AS width, CAST(sum(lightning_count * (cell_c + 1)) AS DOUBLE) AS weighted
FROM lightning GROUP BY 1, 3""")
def image_lines(spark, d):
    lit = strikes_by_cellday(strikes(spark, d), event_days(spark, d), AREA)
    weighted = F.aggregate(F.transform("line", lambda v, c: v * (c + 1)), F.lit(0.0), lambda a, b: a + b)
    return g.day_rows(lit, ["lightning_count"], AREA).select(
        "date", "feature", "cell_r", F.size("line").alias("width"), weighted.alias("weighted"))


@query("score_join", f"""
WITH {CELLDAYS_SQL} SELECT t.date, s.cell_r, s.cell_c, t.is_fire_day, ((s.user_id * 7919 + day(s.date)) % 100) / 100.0::DOUBLE AS risk_score
FROM celldays s JOIN celldays t ON t.cell_r = s.cell_r AND t.cell_c = s.cell_c AND t.date = s.date + 5""")
def score_join(spark, d):
    """Scores made on a day, attached to the rows of the day they predict."""
    base = celldays(spark, d)
    scores = base.select(F.date_add("date", 5).alias("date"), *g.CELL,
                         ((F.col("user_id") * 7919 + F.dayofmonth("date")) % 100 / 100).alias("risk_score"))
    return base.select(*g.CELL_DAY, "is_fire_day").join(scores, g.CELL_DAY)


def weather_days(spark, d):
    """Plausible daily weather per cell, wet on days with many events."""
    u, i = F.col("user_id"), F.dayofmonth("date")
    return celldays(spark, d).select(
        *g.CELL_DAY, ((u * 7 + i * 3) % 23 + F.when((u + g.div(i, 5)) % 2 == 0, 4).otherwise(-12)).cast("double").alias("temp_c"),
        ((u * 13 + i * 5) % 60 + 30).cast("double").alias("humidity"), ((u + i) % 30).cast("double").alias("wind_kmh"),
        F.when(F.col("n_events") > 2, F.col("n_events") * 2.5).otherwise(0.0).alias("rain_mm"))


WEATHER_SQL = f"""{CELLDAYS_SQL},
weather AS (
  SELECT date, cell_r, cell_c,
    CAST((user_id * 7 + day(date) * 3) % 23 + CASE WHEN (user_id + day(date) // 5) % 2 = 0 THEN 4 ELSE -12 END AS DOUBLE) AS t,
    CAST((user_id * 13 + day(date) * 5) % 60 + 30 AS DOUBLE) AS h, CAST((user_id + day(date)) % 30 AS DOUBLE) AS w,
    CAST(CASE WHEN n_events > 2 THEN n_events * 2.5 ELSE 0 END AS DOUBLE) AS p
  FROM celldays)"""

SEASON_SQL = f"""{WEATHER_SQL},
signals AS (
  SELECT *, CASE WHEN count(*) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN
    CASE WHEN min(t) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 12 THEN 1
         WHEN max(t) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) < 5 THEN 0 END END AS s FROM weather),
season AS (
  SELECT *, coalesce(last_value(s IGNORE NULLS) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS in_season FROM signals)"""


@query("fire_season_mask", f"WITH {SEASON_SQL} SELECT date, cell_r, cell_c, in_season FROM season")
def fire_season_mask(spark, d):
    return windows.fire_season_mask(weather_days(spark, d)).select(*g.CELL_DAY, "in_season")


def _fire_weather_sql(masked: bool, dry: bool = False) -> str:
    """The equations day by day as a recursive query; every level of sub-query is one named step."""
    on = "in_season" if masked else "1"
    since = f"date_diff('day', max(CASE WHEN p > 1.5 THEN date END) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), date)"
    duff, deep = (f"coalesce({factor} * {since}, {start})" if dry else str(start) for factor, start in ((1.2, 6), (5, 15)))
    return f"""WITH RECURSIVE {SEASON_SQL},
days_n AS (SELECT *, {on} AS active, row_number() {OVER}) AS i, {duff}::DOUBLE AS d0, {deep}::DOUBLE AS c0 FROM season),
codes AS (
  SELECT date, cell_r, cell_c, w, i, active, f, d, c, m FROM (
    SELECT DATE '1900-01-01' AS date, cell_r, cell_c, 0::DOUBLE AS w, 0::BIGINT AS i, 0 AS active,
      85::DOUBLE AS f, 6::DOUBLE AS d, 15::DOUBLE AS c, 0::DOUBLE AS m FROM days_n WHERE i = 1)
  UNION ALL
  SELECT date, cell_r, cell_c, w, i, active,
    CASE WHEN active = 1 THEN 59.5 * (250 - m2) / (147.2 + m2) ELSE 85 END,
    CASE WHEN active = 1 THEN CASE WHEN p > 1.5 THEN greatest(0, 244.72 - 43.43 * ln(mr - 20)) ELSE d END
      + 1.894e-4 * (greatest(t, -1.1) + 1.1) * (100 - h) * [6.5, 7.5, 9, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8, 7, 6][month(date)] ELSE 6 END,
    CASE WHEN active = 1 THEN CASE WHEN p > 2.8 THEN greatest(0, 400 * ln(800 / q)) ELSE c END
      + 0.5 * greatest(0, 0.36 * (greatest(t, -2.8) + 2.8)
        + [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5, 2.4, 0.4, -1.6, -1.6][month(date)]) ELSE 15 END, m2
  FROM (SELECT *, CASE WHEN m1 > ed THEN ed + (m1 - ed) * power(10, -kd) WHEN m1 < ew THEN ew - (ew - m1) * power(10, -kw) ELSE m1 END AS m2,
          20 + exp(5.6348 - d / 43.43) + 1000 * (0.92 * p - 1.27) / (48.77 + b * (0.92 * p - 1.27)) AS mr
   FROM (SELECT *, least(250, CASE WHEN p > 0.5 THEN m0 + 42.5 * (p - 0.5) * exp(-100 / (251 - m0)) * (1 - exp(-6.93 / (p - 0.5)))
           + CASE WHEN m0 > 150 THEN 0.0015 * (m0 - 150) * (m0 - 150) * sqrt(p - 0.5) ELSE 0 END ELSE m0 END) AS m1,
         0.942 * power(h, 0.679) + 11 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ed,
         0.618 * power(h, 0.753) + 10 * exp((h - 100) / 10) + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) AS ew,
         (0.424 * (1 - power(h / 100, 1.7)) + 0.0694 * sqrt(w) * (1 - power(h / 100, 8))) * 0.581 * exp(0.0365 * t) AS kd,
         (0.424 * (1 - power((100 - h) / 100, 1.7)) + 0.0694 * sqrt(w) * (1 - power((100 - h) / 100, 8))) * 0.581 * exp(0.0365 * t) AS kw,
         CASE WHEN d <= 33 THEN 100 / (0.5 + 0.3 * d) WHEN d <= 65 THEN 14 - 1.3 * ln(d) ELSE 6.2 * ln(d) - 17.2 END AS b,
         800 * exp(-c / 400) + 3.937 * (0.83 * p - 1.27) AS q
    FROM (SELECT n.*, s.f, CASE WHEN s.active = 1 THEN s.d ELSE n.d0 END AS d, CASE WHEN s.active = 1 THEN s.c ELSE n.c0 END AS c,
            147.2 * (101 - s.f) / (59.5 + s.f) AS m0
          FROM codes s JOIN days_n n ON n.cell_r = s.cell_r AND n.cell_c = s.cell_c AND n.i = s.i + 1)))),
content AS (SELECT * EXCLUDE (m), 147.2 * (101 - f) / (59.5 + f) AS m FROM codes WHERE i > 0),
spread AS (
  SELECT *, 0.208 * exp(0.05039 * w) * 91.9 * exp(-0.1386 * m) * (1 + power(m, 5.31) / 4.93e7) AS isi,
    CASE WHEN d + 0.4 * c <= 0 THEN 0 WHEN d <= 0.4 * c THEN 0.8 * d * c / (d + 0.4 * c)
         ELSE greatest(0, d - (1 - 0.8 * c / (d + 0.4 * c)) * (0.92 + power(0.0114 * d, 1.7))) END AS bui
  FROM content),
danger AS (
  SELECT *, 0.1 * isi * CASE WHEN bui <= 80 THEN 0.626 * power(bui, 0.809) + 2 ELSE 1000 / (25 + 108.64 * exp(-0.023 * bui)) END AS bb FROM spread)
SELECT date, cell_r, cell_c, {', '.join(f'CASE WHEN active = 1 THEN round({e}, 5) END AS {n}' for n, e in [
        ('fine_fuel_moisture_code', 'f'), ('duff_moisture_code', 'd'), ('drought_code', 'c'), ('initial_spread_index', 'isi'),
        ('build_up_index', 'bui'),
        ('fire_weather_index', 'CASE WHEN bb > 1 THEN exp(2.72 * power(0.434 * ln(bb), 0.647)) ELSE bb END')])} FROM danger"""


SIX = ["fine_fuel_moisture_code", "duff_moisture_code", "drought_code", "initial_spread_index", "build_up_index",
       "fire_weather_index"]


@query("fire_weather", _fire_weather_sql(False))
def fire_weather_query(spark, d):
    return rounded(fire_weather(weather_days(spark, d)).select(*g.CELL_DAY, *SIX), *SIX, digits=5)


@query("fire_weather_in_season", _fire_weather_sql(True))
def fire_weather_in_season(spark, d):
    masked = windows.fire_season_mask(weather_days(spark, d))
    return rounded(fire_weather(masked, season="in_season").select(*g.CELL_DAY, *SIX), *SIX, digits=5)


@query("fire_weather_dry_start", _fire_weather_sql(True, True))
def fire_weather_dry_start(spark, d):
    """Start codes of a season from the days since the last wet day."""
    masked = windows.fire_season_mask(weather_days(spark, d))
    return rounded(fire_weather(masked, season="in_season", dry_start=True).select(*g.CELL_DAY, *SIX), *SIX, digits=5)


@query("fire_weather_stream", _fire_weather_sql(True, True) + " WHERE day(date) > 12")
def fire_weather_stream_query(spark, d):
    """The first days by the batch fold, the others as a stream that goes on from it and is stopped and taken up once."""
    masked, path = windows.fire_season_mask(weather_days(spark, d)), shared_folder(spark)
    day, schema = F.dayofmonth("date"), masked.schema
    masked.write.parquet(f"{path}/all")
    days = spark.read.parquet(f"{path}/all")
    initial = last_codes(fire_weather(days.where(day <= 12), season="in_season", dry_start=True))
    initial.write.parquet(f"{path}/state")
    for new in (day.between(13, 20), day > 20):
        days.where(new).write.mode("append").parquet(f"{path}/in")
        stream = fire_weather_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), season="in_season", dry_start=True,
                                     initial=spark.read.parquet(f"{path}/state"))
        write_new_days(stream, f"{path}/out", f"{path}/progress").awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(f"{path}/out").select(*g.CELL_DAY, *SIX), *SIX, digits=5)
