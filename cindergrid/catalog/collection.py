"""Grid, calendar, gridding, labels and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.registry import (AREA, AREA_SQL, CELLDAYS_SQL, DAYS_SQL, INCIDENTS_SQL, LIGHTNING_SQL,
                                         POINTS_SQL, STRIKES_SQL, WIDE, celldays, event_days, feature_points,
                                         incident_points, query, rounded, strikes, table)
from cindergrid.functions.values import categories_of_tags, element_points, round_coordinate
from cindergrid.functions.weather import lightning_product, lightning_ratio
from cindergrid.operators import aggregates, grid as g, joins
from cindergrid.plans.collect import cell_day_table, infrastructure_source, lightning_source, weather_source
from cindergrid.sources.readers import incidents, track_points


@query("grid_cells", f"""
WITH {STRIKES_SQL}, {AREA_SQL}
SELECT a.cell_r, a.cell_c, a.latitude, a.longitude, count(l.event_id) AS n_strikes
FROM area a LEFT JOIN located l ON l.cell_r = a.cell_r AND l.cell_c = a.cell_c GROUP BY ALL""")
def grid_cells(spark, d):
    hits = AREA.locate(strikes(spark, d)).groupBy(*g.CELL).agg(F.count("*").alias("n_strikes"))
    return AREA.cells(spark).join(hits, g.CELL, "left").fillna(0, ["n_strikes"])


@query("calendar", """
SELECT DISTINCT date FROM (
  SELECT CAST(unnest(generate_series(TIMESTAMP '1994-06-01', TIMESTAMP '1996-12-31', INTERVAL 4 DAY)) AS DATE) AS date
  UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders) WHERE date BETWEEN DATE '1994-06-01' AND DATE '1996-12-31'""")
def calendar(spark, d):
    return g.calendar(spark, "1994-06-01", "1996-12-31", 4, table(spark, d, "orders"), "o_orderdate")


@query("cellday_scaffold", f"""
WITH {AREA_SQL}, {DAYS_SQL}
SELECT date, cell_r, cell_c, latitude, longitude, CAST(0 AS BIGINT) AS lightning_count FROM days, area""")
def cellday_scaffold(spark, d):
    return AREA.with_corners(g.scaffold(event_days(spark, d), AREA, {"lightning_count": "bigint"}))


@query("day_index", """
SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS day_idx FROM (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
WHERE NOT (month(date) = 2 AND day(date) = 29)""")
def day_index(spark, d):
    from cindergrid.plans.features import drop_leap_days

    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    return g.day_index(drop_leap_days(days)).select("date", "day_idx")


@query("period_batches", """
WITH dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
keyed AS (SELECT u.freq, CAST(date_trunc(u.unit, date) AS DATE) AS period, date FROM dates,
  (VALUES ('D', 'day'), ('W', 'week'), ('M', 'month'), ('Y', 'year')) u(freq, unit))
SELECT freq, period, min(date) AS first_day, max(date) AS last_day, count(*) AS n_days FROM keyed GROUP BY ALL""")
def period_batches(spark, d):
    dates = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    parts = [g.period_batches(dates, f).withColumn("freq", F.lit(f)) for f in "DWMY"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("bbox_subset", f"""
WITH {POINTS_SQL}
SELECT c_custkey, cell_r, cell_c, round((490000 + 3000 * cell_r) / 10000.0, 2) AS latitude,
       round((-1200000 + 3000 * cell_c) / 10000.0, 2) AS longitude
FROM placed WHERE lat_e4 BETWEEN 520000 AND 560000 AND lon_e4 BETWEEN -1180000 AND -1130000""")
def bbox_subset(spark, d):
    box = g.bounding_box(feature_points(spark, d), 56, -118, 52, -113, AREA)
    return box.select("c_custkey", *g.CELL, "latitude", "longitude")


@query("static_replicated", f"""
WITH {AREA_SQL}, {DAYS_SQL}, {POINTS_SQL},
static AS (SELECT cell_r, cell_c, count(*) AS n_points FROM placed GROUP BY ALL)
SELECT d.date, s.cell_r, s.cell_c, s.n_points FROM static s, days d""")
def static_replicated(spark, d):
    static = AREA.locate(feature_points(spark, d)).groupBy(*g.CELL).agg(F.count("*").alias("n_points"))
    every_day = event_days(spark, d).agg(F.collect_set("date")).scalar()
    return static.select(F.explode(every_day).alias("date"), *g.CELL, "n_points")


@query("lightning_by_cellday", f"WITH {LIGHTNING_SQL} SELECT * FROM lightning")
def lightning_by_cellday(spark, d):
    return aggregates.strikes_by_cellday(strikes(spark, d), event_days(spark, d), AREA)


@query("strike_features", f"""
WITH {LIGHTNING_SQL}
SELECT date, cell_r, cell_c, round(lightning_count * absv_strength_sum, 6) AS ltng_strength_prod,
  round(CASE WHEN lightning_count = 0 THEN 0 ELSE absv_strength_sum / lightning_count END, 6) AS ltng_strength_ratio
FROM lightning""")
def strike_features(spark, d):
    out = lightning_by_cellday(spark, d).select(
        *g.CELL_DAY, lightning_product().alias("ltng_strength_prod"), lightning_ratio().alias("ltng_strength_ratio"))
    return rounded(out, "ltng_strength_prod", "ltng_strength_ratio")


@query("infra_tags", f"""
WITH {POINTS_SQL} SELECT category, count(*) AS n FROM points WHERE category IS NOT NULL GROUP BY 1""")
def infra_tags(spark, d):
    return categorised(spark, d).groupBy("category").agg(F.count("*").alias("n"))


def categorised(spark, d):
    return feature_points(spark, d).select("c_custkey", "latitude", "longitude",
                                           F.explode(categories_of_tags("tags")).alias("category"))


INFRA = ["railway", "power_line", "highway", "aeroway", "waterway"]


@query("infra_counts", f"""
WITH {AREA_SQL}, {DAYS_SQL}, {POINTS_SQL}
SELECT d.date, a.cell_r, a.cell_c, {', '.join(f"count(*) FILTER (p.category = '{c}') AS {c}_count" for c in INFRA)}
FROM days d CROSS JOIN area a LEFT JOIN placed p ON p.cell_r = a.cell_r AND p.cell_c = a.cell_c GROUP BY 1, 2, 3""")
def infra_counts(spark, d):
    return aggregates.infrastructure(g.scaffold(event_days(spark, d), AREA), categorised(spark, d), AREA)


LABEL_SQL = f"""{CELLDAYS_SQL}, {INCIDENTS_SQL},
labelled AS (
  SELECT c.date, c.cell_r, c.cell_c, CASE WHEN EXISTS (
    SELECT 1 FROM incidents i WHERE i.date = c.date
      AND abs(i.lat_e4 - (490000 + 3000 * c.cell_r)) <= 1500
      AND abs(i.lon_e4 - (-1200000 + 3000 * c.cell_c)) <= 1500) THEN 1 ELSE 0 END AS is_fire_day
  FROM celldays c)"""


@query("fire_label", f"WITH {LABEL_SQL} SELECT * FROM labelled")
def fire_label(spark, d):
    cells = celldays(spark, d).select(*g.CELL_DAY)
    return joins.label_fires(cells, incident_points(spark, d), WIDE, 0.15, 0.15)


@query("fires_per_period", f"""
WITH {LABEL_SQL} SELECT strftime(date, '%Y%m') AS period, CAST(sum(is_fire_day) AS BIGINT) AS fire_days,
  count(*) AS n FROM labelled GROUP BY 1""")
def fires_per_period(spark, d):
    return aggregates.flagged_per_period(fire_label(spark, d))


@query("incident_table", """
SELECT CAST(o_orderdate AS DATE) AS date, round(o_custkey / 1000.0, 6) AS latitude,
       round(o_totalprice / 1000, 6) AS longitude
FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""")
def incident_table(spark, d):
    o = table(spark, d, "orders")
    raw = o.select(F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"))
                   .otherwise("unknown").alias("fire_start_date"),
                   F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey") / 1000)
                   .alias("fire_location_latitude"),
                   (F.col("o_totalprice") / 1000).alias("fire_location_longitude"))
    return rounded(incidents(raw), "latitude", "longitude")


STRUCK_SQL = """
struck AS (SELECT date, cell_r, cell_c, count(*) AS lightning_count,
  CAST(sum(abs(strength)) AS BIGINT) AS absv_strength_sum FROM located GROUP BY ALL)"""


def struck(spark, d):
    return AREA.locate(strikes(spark, d)).groupBy(*g.CELL_DAY).agg(
        F.count("*").alias("lightning_count"), F.sum(F.abs("strength")).cast("bigint").alias("absv_strength_sum"))


@query("assemble_outer", f"""
WITH {CELLDAYS_SQL}, {STRIKES_SQL}, {STRUCK_SQL}, {POINTS_SQL},
rain AS (SELECT date, cell_r, cell_c, tp, n_events FROM celldays WHERE cell_c < 34),
rail AS (SELECT date, cell_r, cell_c, n FROM days, (SELECT cell_r, cell_c, count(*) AS n FROM placed GROUP BY ALL))
SELECT date, cell_r, cell_c, round((490000 + 3000 * cell_r) / 10000.0, 2) AS latitude,
       round((-1200000 + 3000 * cell_c) / 10000.0, 2) AS longitude,
       round(tp, 6) AS tp, n_events, lightning_count, absv_strength_sum, n
FROM rain FULL JOIN struck USING (date, cell_r, cell_c) FULL JOIN rail USING (date, cell_r, cell_c)""")
def assemble_outer(spark, d):
    def rain(_spark, _dates, _grid):
        return celldays(spark, d).filter(F.col("cell_c") < AREA.n_cols).select(*g.CELL_DAY, "tp", "n_events")

    def offline(_spark, _dates, _grid):
        raise ConnectionError("source not reachable")

    out = joins.assemble(spark, event_days(spark, d), AREA, [
        ("rain", rain), ("offline", offline), ("lightning", lambda *_: struck(spark, d)),
        ("points", lambda *_: static_replicated(spark, d).withColumnRenamed("n_points", "n"))], on_error="skip")
    return rounded(out, "tp")


@query("weather_left", f"""
WITH {CELLDAYS_SQL}, {STRIKES_SQL}, {STRUCK_SQL}
SELECT date, cell_r, cell_c, round(tp, 6) AS tp, lightning_count, absv_strength_sum
FROM celldays LEFT JOIN struck USING (date, cell_r, cell_c)""")
def weather_left(spark, d):
    main = celldays(spark, d).select(*g.CELL_DAY, "tp")
    return rounded(joins.left_fields(main, struck(spark, d)), "tp")


def _monthly(spark, d):
    o = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 37).alias("cell_r"),
        (g.div(F.col("o_custkey"), 37) % 34).alias("cell_c"), "o_totalprice", "o_orderstatus")
    left = o.groupBy(*g.CELL_DAY).agg(F.count("*").alias("lightning_count"))
    pending = (F.year("date") == 1996) & (F.col("o_orderstatus") == "P")
    right = o.filter(~pending).groupBy(*g.CELL_DAY).agg(
        F.sum("o_totalprice").alias("sp"), F.max(F.lit(0)).alias("lightning_count"))
    return joins.monthly_join(left, right)


MONTHLY_SQL = """
o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey % 37 AS cell_r, (o_custkey // 37) % 34 AS cell_c,
        o_totalprice, o_orderstatus FROM orders),
a AS (SELECT date, cell_r, cell_c, count(*) AS lightning_count FROM o GROUP BY ALL),
b AS (SELECT date, cell_r, cell_c, sum(o_totalprice) AS sp FROM o
      WHERE NOT (year(date) = 1996 AND o_orderstatus = 'P') GROUP BY ALL),
report AS (SELECT period, l.n AS left_rows, r.n AS right_rows,
    CASE WHEN l.n IS NULL OR r.n IS NULL THEN 'unmatched' WHEN l.n <> r.n THEN 'row counts differ'
         ELSE 'merged' END AS status
  FROM (SELECT strftime(date, '%Y%m') AS period, count(*) AS n FROM a GROUP BY 1) l
  FULL JOIN (SELECT strftime(date, '%Y%m') AS period, count(*) AS n FROM b GROUP BY 1) r USING (period))"""


@query("monthly_inner", f"""
WITH {MONTHLY_SQL}
SELECT strftime(date, '%Y%m') AS period, date, cell_r, cell_c, lightning_count, round(sp, 4) AS sp
FROM a JOIN b USING (date, cell_r, cell_c)
WHERE strftime(date, '%Y%m') IN (SELECT period FROM report WHERE status = 'merged')""")
def monthly_inner(spark, d):
    return rounded(_monthly(spark, d)[0], "sp", digits=4)


@query("period_match", f"WITH {MONTHLY_SQL} SELECT * FROM report")
def period_match(spark, d):
    return _monthly(spark, d)[1]


@query("coordinate_rounding", f"""
WITH {STRIKES_SQL} SELECT event_id, round(lat_e4 / 10000.0 + 0.000001, 2) AS latitude,
  round(lon_e4 / 10000.0 + 0.000001, 2) AS longitude FROM strikes""")
def coordinate_rounding(spark, d):
    s = strikes(spark, d)
    return s.select("event_id", round_coordinate(F.col("latitude") + 0.000001).alias("latitude"),
                    round_coordinate(F.col("longitude") + 0.000001).alias("longitude"))


@query("json_points", f"""
WITH {STRIKES_SQL} SELECT event_id, lat_e4 / 10000.0::DOUBLE AS lat, lon_e4 / 10000.0::DOUBLE AS lon
FROM strikes WHERE event_id % 5 <> 4
UNION ALL SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS DOUBLE), 0.5::DOUBLE FROM events""")
def json_points(spark, d):
    s = strikes(spark, d)
    at = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    k = F.from_json("props", "k int")["k"].cast("double")
    none = F.lit(None).cast("double")
    plain = F.when(F.col("event_id") % 5 < 2, at)
    centred = F.when(F.col("event_id") % 5 < 4, at)
    first = F.struct(plain["lat"].alias("lat"), plain["lon"].alias("lon"),
                     F.when(plain.isNull(), centred).alias("center"))
    second = F.struct(k.alias("lat"), F.lit(0.5).alias("lon"), F.struct(none.alias("lat"), none.alias("lon")).alias("center"))
    payload = F.to_json(F.struct(F.array(first, second).alias("elements")))
    return s.select("event_id", F.inline(element_points(payload)))


@query("arrays_to_rows", """
SELECT vec_id, round(CAST(embedding[1 + i] AS DOUBLE), 6) AS "Time", round(CAST(embedding[17 + i] AS DOUBLE), 6) AS "Latitude",
       round(CAST(embedding[33 + i] AS DOUBLE), 6) AS "Longitude", round(CAST(embedding[49 + i] AS DOUBLE), 6) AS "Elevation"
FROM embeddings, (SELECT unnest(range(16)) AS i)""")
def arrays_to_rows(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[
        F.slice("embedding", 1 + 16 * i, 16).alias(n) for i, n in enumerate(["time", "latitude", "longitude", "elevation"])])
    return rounded(track_points(e), "Time", "Latitude", "Longitude", "Elevation")


CELL_DAY_TABLE_SQL = f"""
WITH {LIGHTNING_SQL}, {INCIDENTS_SQL}, {POINTS_SQL},
calendar AS (
  SELECT DISTINCT date FROM (
    SELECT CAST(unnest(generate_series((SELECT CAST(min(date) AS TIMESTAMP) FROM days), (SELECT CAST(max(date) AS TIMESTAMP) FROM days), INTERVAL 4 DAY)) AS DATE) AS date
    UNION ALL SELECT date FROM incidents) WHERE date BETWEEN (SELECT min(date) FROM days) AND (SELECT max(date) FROM days)),
rain AS (SELECT CAST(ts AS DATE) AS date, user_id % 37 AS cell_r, (user_id // 37) % 34 AS cell_c,
           max(value) AS tp FROM events GROUP BY ALL),
weather AS (
  SELECT r.*, CASE WHEN EXISTS (
    SELECT 1 FROM incidents i WHERE i.date = r.date
      AND abs(i.lat_e4 - (490000 + 3000 * r.cell_r)) <= 1000
      AND abs(i.lon_e4 - (-1200000 + 3000 * r.cell_c)) <= 1000) THEN 1 ELSE 0 END AS is_fire_day
  FROM rain r JOIN calendar USING (date)),
strikes_all AS (
  SELECT c.date, a.cell_r, a.cell_c, coalesce(l.lightning_count, 0) AS lightning_count,
         coalesce(l.absv_strength_sum, 0) AS absv_strength_sum, coalesce(l.multiplicity_sum, 0) AS multiplicity_sum
  FROM calendar c CROSS JOIN area a LEFT JOIN lightning l USING (date, cell_r, cell_c)),
infra AS (
  SELECT a.cell_r, a.cell_c, {', '.join(f"count(*) FILTER (p.category = '{c}') AS {c}_count" for c in INFRA)}
  FROM area a LEFT JOIN placed p ON p.cell_r = a.cell_r AND p.cell_c = a.cell_c GROUP BY 1, 2)
SELECT s.date, s.cell_r, s.cell_c, a.latitude, a.longitude, round(w.tp, 6) AS tp, w.is_fire_day,
       s.lightning_count, s.absv_strength_sum, s.multiplicity_sum, {', '.join(f'i.{c}_count' for c in INFRA)}
FROM strikes_all s JOIN area a USING (cell_r, cell_c) LEFT JOIN weather w USING (date, cell_r, cell_c)
JOIN infra i USING (cell_r, cell_c)"""


@query("cell_day_table", CELL_DAY_TABLE_SQL)
def cell_day_table_query(spark, d):
    """The whole assembly: weather with labels, lightning and infrastructure over the days of the events."""
    fires, events = incident_points(spark, d), table(spark, d, "events")
    first, last = aggregates.date_range(events.select(F.to_date("ts").alias("date"))).first()
    rain = events.groupBy(
        F.to_date("ts").alias("date"), (F.col("user_id") % 37).alias("cell_r"),
        (g.div(F.col("user_id"), 37) % 34).alias("cell_c")).agg(F.max("value").alias("tp"))
    rain = AREA.with_corners(rain).drop(*g.CELL)
    out = cell_day_table(spark, AREA, first, last, [
        weather_source(rain, None, fires, 0.1, 0.1), lightning_source(strikes(spark, d)),
        infrastructure_source(categorised(spark, d))], fires, every=4)
    return rounded(out, "tp")
