"""Scalar features, scaling, encoding, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.registry import CELLDAYS_SQL, OBS_SQL, WIDE, celldays, observations, query, rounded, table
from cindergrid.functions import surface, temporal, values, weather
from cindergrid.operators.scaling import impute_mean, minmax_scale, one_hot, scale, standard_scale
from cindergrid.operators.windows import slope
from cindergrid.plans.features import clean, drop_leap_days, process, select_features

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

RH_SQL = """100 * (exp(17.625 * ("2d" - 273.15) / (243.04 + ("2d" - 273.15)))
             / exp(17.625 * ("2t" - 273.15) / (243.04 + ("2t" - 273.15))))"""


@query("weather_scalars", f"""
WITH {OBS_SQL}, rh AS (SELECT *, {RH_SQL} AS h FROM obs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(h, 6) AS relative_humidity, round("2t" - "2d", 6) AS atmospheric_dryness,
  round("2t" * h, 6) AS temp_humidity_interaction, round(sqrt("10u" * "10u" + "10v" * "10v") * 3.6, 6) AS wind_kmh
FROM rh""")
def weather_scalars(spark, d):
    o = observations(spark, d).withColumn("relative_humidity", weather.relative_humidity())
    out = o.select(*KEYS, "relative_humidity", weather.atmospheric_dryness().alias("atmospheric_dryness"),
                   weather.temp_humidity("`2t`", "relative_humidity").alias("temp_humidity_interaction"),
                   weather.wind_speed().alias("wind_kmh"))
    return rounded(out, "relative_humidity", "atmospheric_dryness", "temp_humidity_interaction", "wind_kmh")


@query("fire_index_inputs", f"""
WITH {OBS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round("2t" - 273.15, 6) AS temp_c, round({RH_SQL}, 6) AS humidity,
  round(sqrt("10u" * "10u" + "10v" * "10v") * 3.6, 6) AS wind_kmh, round(tp * 1000, 6) AS rain_mm FROM obs""")
def fire_index_inputs(spark, d):
    inputs = weather.fire_index_inputs()
    out = observations(spark, d).select(*KEYS, *[c.alias(n) for n, c in inputs.items()])
    return rounded(out, *inputs)


@query("fuel_soil", f"""
WITH {OBS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN tvl IN (1, 7, 10, 16, 17, 19) THEN 1 ELSE 0 END AS fuel_low,
  CASE WHEN tvh IN (3, 4, 5, 6, 18) THEN 1 ELSE 0 END AS fuel_high,
  CASE WHEN slt = 0 THEN 'Non-soil' WHEN slt <= 2 THEN 'Coarse' WHEN slt <= 5 THEN 'Medium'
       WHEN slt <= 7 THEN 'Organic' END AS soil,
  round(z / CAST('9.8067' AS DOUBLE), 6) AS elevation FROM obs""")
def fuel_soil(spark, d):
    out = observations(spark, d).select(*KEYS, surface.fuel_low().alias("fuel_low"),
                                        surface.fuel_high().alias("fuel_high"),
                                        surface.soil_class().alias("soil"), surface.elevation().alias("elevation"))
    return rounded(out, "elevation")


#: Share of the lower of two neighbouring layers (bottoms at 7, 28, 100 and 289 cm) at ten even depths.
DEPTH_SHARES = [(0, "1.0"), (2, "37.0 / 648"), (2, "326.0 / 648"), (2, "615.0 / 648"), (3, "256.0 / 1701"), (3, "545.0 / 1701"),
                (3, "834.0 / 1701"), (3, "1123.0 / 1701"), (3, "1412.0 / 1701"), (3, "1.0")]


def _depth_sql() -> str:
    def at(prefix: str, lower: int, share: str) -> str:
        part = f"CAST('{share.split(' / ')[0]}' AS DOUBLE) / {share.split(' / ')[1] if ' / ' in share else 1}"
        rest = "" if share == "1.0" else f" + {prefix}{lower} * (1 - {part})"
        return f"CAST({prefix}{lower + 1} * ({part}){rest} AS FLOAT)"

    inner = ", ".join([f"{at('swvl', *r)} AS w{i}, {at('stl', *r)} AS t{i}" for i, r in enumerate(DEPTH_SHARES)])
    total = {p: " + ".join(f"{p}{i}" for i in range(10)) for p in "wt"}
    ratios = ", ".join(f"round(CAST(CAST(CAST(w{i} AS DOUBLE) / t{i} AS FLOAT) AS DOUBLE), 6) AS surface_water_heat_{i}" for i in range(10))
    return f"""WITH {OBS_SQL}, deep AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {inner} FROM obs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST({total['w']} AS DOUBLE), 3) AS daily_water_sum,
  round(CAST({total['t']} AS DOUBLE), 2) AS daily_temp_sum, {ratios} FROM deep"""


@query("depth_waterheat", _depth_sql())
def depth_waterheat(spark, d):
    cols = surface.depth_waterheat()
    out = observations(spark, d).select(*KEYS, *[c.alias(n) for n, c in cols.items()])
    out = rounded(out, *[c for c in cols if c.startswith("surface")])
    return rounded(rounded(out, "daily_water_sum", digits=3), "daily_temp_sum", digits=2)


@query("slope", f"""
WITH {CELLDAYS_SQL},
cells AS (SELECT DISTINCT cell_r, cell_c, ((user_id * 7919) % 500) / CAST('9.8067' AS DOUBLE) AS f,
    round((490000 + 3000 * cell_r) / 10000.0, 2)::DOUBLE AS lat, round((-1200000 + 3000 * cell_c) / 10000.0, 2)::DOUBLE AS lon FROM celldays),
xy AS (SELECT *, lon * 111320 * cos(radians(lat)) AS x, lat * 111320 AS y FROM cells),
steps AS (SELECT *, lag(f) OVER r AS fp, lead(f) OVER r AS fn, x - lag(x) OVER r AS hs, lead(x) OVER r - x AS hd,
    lag(f) OVER c AS gp, lead(f) OVER c AS gn, y - lag(y) OVER c AS ks, lead(y) OVER c - y AS kd
  FROM xy WINDOW r AS (PARTITION BY cell_r ORDER BY cell_c), c AS (PARTITION BY cell_c ORDER BY cell_r)),
grads AS (SELECT *,
    coalesce((hs * hs * fn + (hd * hd - hs * hs) * f - hd * hd * fp) / (hs * hd * (hd + hs)), (fn - f) / hd, (f - fp) / hs, 0) AS gx,
    coalesce((ks * ks * gn + (kd * kd - ks * ks) * f - kd * kd * gp) / (ks * kd * (kd + ks)), (gn - f) / kd, (f - gp) / ks, 0) AS gy
  FROM steps)
SELECT d.date, d.cell_r, d.cell_c, round(g.f, 6) AS elevation, round(sqrt(gx * gx + gy * gy) * 1000, 6) AS slope_per_km
FROM celldays d JOIN grads g USING (cell_r, cell_c)""")
def slope_query(spark, d):
    z = celldays(spark, d).select("date", "cell_r", "cell_c", (F.col("user_id") * 7919 % 500).cast("double").alias("z"))
    out = slope(z, WIDE).select("date", "cell_r", "cell_c", "elevation", (F.col("slope") * 1000).alias("slope_per_km"))
    return rounded(out, "elevation", "slope_per_km")


@query("seasons", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)
SELECT o_orderkey, date,
  CASE WHEN md >= 1221 OR md < 320 THEN 'Winter' WHEN md < 621 THEN 'Spring' WHEN md < 922 THEN 'Summer' ELSE 'Autumn' END AS season,
  CASE WHEN md <= 301 OR md >= 1001 THEN 'off_season' WHEN md <= 430 OR md >= 901 THEN 'on_season' ELSE 'core_season' END AS fire_season,
  CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) < 6 THEN 'Spring' WHEN month(date) < 9 THEN 'Summer' ELSE 'Fall' END AS month_season,
  CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day FROM o""")
def seasons(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return o.withColumns({"season": temporal.season(), "fire_season": temporal.fire_season(),
                          "month_season": temporal.month_season(), **temporal.date_parts()})


@query("leap_days_dropped", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders
WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-15' AND DATE '2000-02-29' GROUP BY 1""")
def leap_days_dropped(spark, d):
    inside = F.col("o_orderdate").between(F.lit("1996-01-15").cast("timestamp_ntz"),
                                          F.lit("2000-02-29 23:59:59.999999").cast("timestamp_ntz"))
    o = table(spark, d, "orders").filter(inside).select(F.to_date("o_orderdate").alias("date"))
    by_day = drop_leap_days(o).groupBy("date").agg(F.count("*").alias("n"))
    return by_day.groupBy(F.year("date").alias("year")).agg(F.sum("n").alias("n"), F.count("*").alias("n_days"))


@query("parsed_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""")
def parsed_dates(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format(t, "yyyy/MM/dd HH:mm:ss")).when(k == 1, F.date_format(t, "yyyy-MM-dd"))
            .when(k == 2, F.date_format(t, "MM/dd/yyyy HH:mm")).otherwise(F.lit("not a date")))
    o = table(spark, d, "orders").select("o_orderkey", text.alias("text"))
    return o.select("o_orderkey", F.to_date(temporal.parse_date("text")).alias("date"))


@query("date_keys", """
SELECT strftime(o_orderdate, '%Y%m') AS period, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_iso,
  count(*) AS n, string_agg(DISTINCT strftime(o_orderdate, '%d'), ',' ORDER BY strftime(o_orderdate, '%d')) AS days
FROM orders GROUP BY 1""")
def date_keys(spark, d):
    from cindergrid.operators.grid import period_key

    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    by_day = o.groupBy("date").agg(F.count("*").alias("n"))
    return by_day.groupBy(period_key().alias("period")).agg(
        F.min(F.date_format("date", "yyyy-MM-dd")).alias("first_iso"), F.sum("n").alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.date_format("date", "dd"))), ",").alias("days"))


@query("finite_values", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(CASE WHEN l_discount = 0 THEN 0 ELSE l_tax / l_discount END, 6) AS ratio FROM lineitem""")
def finite_values(spark, d):
    ratio = F.try_divide("l_tax", "l_discount")
    shown = (F.when(F.col("l_discount") > 0, ratio).when(F.col("l_tax") == 0, float("nan"))
             .when(F.col("l_linenumber") % 2 == 0, float("inf")).otherwise(float("-inf")))
    return rounded(table(spark, d, "lineitem").select(*KEYS, values.finite_or_zero(shown).alias("ratio")), "ratio")


SCALED = ["2t", "10u", "tp"]


@query("scale_standard", f"""
WITH {OBS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(
    f'round(("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER (), 6) + 0.0 AS "{c}"' for c in SCALED)}, 0.0::DOUBLE AS flat FROM obs""")
def scale_standard(spark, d):
    o = observations(spark, d).select(*KEYS, *[f"`{c}`" for c in SCALED], F.lit(7.0).alias("flat"))
    return rounded(standard_scale(o, [*SCALED, "flat"]), *SCALED, "flat")


@query("scale_minmax", f"""
WITH {OBS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(
    f'round(("{c}" - min("{c}") OVER ()) / (max("{c}") OVER () - min("{c}") OVER ()), 6) + 0.0 AS "{c}"' for c in SCALED)},
  0.0::DOUBLE AS flat FROM obs""")
def scale_minmax(spark, d):
    o = observations(spark, d).select(*KEYS, *[f"`{c}`" for c in SCALED], F.lit(7.0).alias("flat"))
    return rounded(minmax_scale(o, [*SCALED, "flat"]), *SCALED, "flat")


@query("scale_by_period", f"""
WITH {OBS_SQL}, p AS (SELECT *, strftime(date, '%Y%m') AS period FROM obs)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, period,
  round(("2t" - avg("2t") OVER w) / CASE WHEN stddev_pop("2t") OVER w = 0 THEN 1 ELSE stddev_pop("2t") OVER w END, 6) + 0.0 AS "2t",
  round((tp - min(tp) OVER w) / CASE WHEN max(tp) OVER w = min(tp) OVER w THEN 1 ELSE max(tp) OVER w - min(tp) OVER w END, 6) + 0.0 AS tp
FROM p WINDOW w AS (PARTITION BY period)""")
def scale_by_period(spark, d):
    o = observations(spark, d).select(*KEYS, F.date_format("date", "yyyyMM").alias("period"), "`2t`", "tp")
    return rounded(scale(o, ["2t"], ["tp"], ["period"]), "2t", "tp")


@query("scale_fit_on_train", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders WHERE year(o_orderdate) < 2000)
SELECT o_orderkey, round((o_totalprice - m) / sd, 6) + 0.0 AS o_totalprice FROM orders, s""")
def scale_fit_on_train(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    out = standard_scale(o, ["o_totalprice"], fit_on=F.year("o_orderdate") < 2000).drop("o_orderdate")
    return rounded(out, "o_totalprice")


@query("onehot", """
SELECT o_orderkey, CASE WHEN md BETWEEN 320 AND 620 THEN 1 ELSE 0 END AS "season_Spring",
  CASE WHEN md BETWEEN 621 AND 921 THEN 1 ELSE 0 END AS "season_Summer",
  CASE WHEN md >= 1221 OR md < 320 THEN 1 ELSE 0 END AS "season_Winter",
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS "o_orderpriority_2-HIGH",
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS "o_orderpriority_3-MEDIUM",
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS "o_orderpriority_4-NOT SPECIFIED",
  CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS "o_orderpriority_5-LOW"
FROM (SELECT *, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)""")
def onehot(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", temporal.season("o_orderdate").alias("season"))
    return one_hot(o, ["season", "o_orderpriority"], {"season": temporal.SEASON_NAMES})


@query("impute", """
WITH o AS (SELECT *, nullif(l_discount, 0) AS x, nullif(l_tax, 0) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(x, avg(x) OVER ()), 6) AS x,
  round(coalesce(y, avg(y) OVER ()), 6) AS y FROM o""")
def impute(spark, d):
    x = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    y = F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax"))
    o = table(spark, d, "lineitem").select(*KEYS, x.alias("x"), y.alias("y"))
    return rounded(impute_mean(o, ["x", "y"]), "x", "y")


@query("feature_select", f"""
WITH {OBS_SQL}
SELECT date, CAST(l_partkey % 37 AS BIGINT) AS cell_r, CAST(l_suppkey AS BIGINT) AS cell_c, round("2t", 6) AS "2t", round(tp, 6) AS tp,
  round("2t" - "2d", 6) AS atmospheric_dryness, CASE WHEN tvl IN (1, 7, 10, 16, 17, 19) THEN 1 ELSE 0 END AS fuel_low
FROM obs WHERE slt < 7""")
def feature_select(spark, d):
    o = observations(spark, d).withColumns({
        "cell_r": F.col("l_partkey") % 37, "cell_c": F.col("l_suppkey"),
        "is_fire_day": F.when(F.col("slt") < 7, F.col("slt") % 2)})
    out = select_features(clean(o), WIDE, ["2t", "tp", "snow_depth"], ["atmospheric_dryness", "fuel_low"])
    return rounded(out, "2t", "tp", "atmospheric_dryness")


@query("processed_table", f"""
WITH {CELLDAYS_SQL}, r AS (
  SELECT date, cell_r, cell_c, tp, CAST(n_events AS DOUBLE) AS lightning_count, is_fire_day,
    sum(tp) OVER (PARTITION BY cell_r, cell_c ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_precipitation,
    month(date) * 100 + day(date) AS md FROM celldays)
SELECT date, cell_r, cell_c, {', '.join(
    f'round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) + 0.0 AS {c}' for c in ('tp', 'lightning_count', 'rolling_precipitation'))},
  CAST(is_fire_day AS DOUBLE) AS is_fire_day,
  CASE WHEN md BETWEEN 320 AND 620 THEN 1 ELSE 0 END AS "season_Spring", CASE WHEN md BETWEEN 621 AND 921 THEN 1 ELSE 0 END AS "season_Summer",
  CASE WHEN md >= 1221 OR md < 320 THEN 1 ELSE 0 END AS "season_Winter",
  CASE WHEN md <= 301 OR md >= 1001 THEN 1 ELSE 0 END AS "fire_season_off_season",
  CASE WHEN md BETWEEN 302 AND 430 OR md BETWEEN 901 AND 1000 THEN 1 ELSE 0 END AS "fire_season_on_season" FROM r""")
def processed_table(spark, d):
    """The feature pipeline as a whole over the cell-days of the events."""
    rows = celldays(spark, d).withColumn("lightning_count", F.col("n_events").cast("double"))
    out = process(rows, WIDE, ["tp", "lightning_count", "is_fire_day"], ["rolling_precipitation", "season", "fire_season"], drop_leap=True)
    return rounded(out, "tp", "lightning_count", "rolling_precipitation", digits=5)
