"""Registry of queries and the adapters that give the driver tables a geography.

The driver tables hold no coordinates, so the adapters derive them with integer arithmetic that reads the
same in SQL. ``*_SQL`` are the matching WITH clauses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cindergrid.operators.grid import Grid, div

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The study area, and a grid of the same rows that is wide enough for any number of users.
AREA = Grid.over((49, 60), (-120, -110), 0.30)
WIDE = Grid(490000, -1200000, 3000, 37, 1_000_000_000)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, halves away from zero, without negative zero."""
    def near(c: str) -> Column:
        x, scale = F.col(f"`{c}`").cast("double"), float(10**digits)
        return F.signum(x) * (F.floor(F.abs(x) * scale + 0.5) / scale) + F.lit(0.0)

    return df.withColumns({c: near(c) for c in columns})


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strikes_of(table(spark, sf_dir, "events"))


def strikes_of(e: DataFrame) -> DataFrame:
    """Located strikes from a batch or a stream of events."""
    wiggle = F.col("event_id") % 300
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("date"),
        ((F.col("user_id") * 7919 % 130000 + wiggle + 480000) / 10000).alias("latitude"),
        ((F.col("user_id") * 104729 % 120000 + wiggle - 1210000) / 10000).alias("longitude"),
        (F.floor("value").cast("int") * sign).alias("strength"),
        (F.col("event_id") % 4).cast("int").alias("multiplicity"), "event_type", "props")


STRIKES_SQL = """
strikes AS (
  SELECT event_id, CAST(ts AS DATE) AS date,
         480000 + (user_id * 7919) % 130000 + event_id % 300 AS lat_e4,
         -1210000 + (user_id * 104729) % 120000 + event_id % 300 AS lon_e4,
         CAST(floor(value) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS strength,
         event_id % 4 AS multiplicity, event_type
  FROM events),
located AS (
  SELECT *, (lat_e4 - 490000) // 3000 AS cell_r, (lon_e4 + 1200000) // 3000 AS cell_c
  FROM strikes
  WHERE lat_e4 >= 490000 AND lat_e4 < 490000 + 37 * 3000
    AND lon_e4 >= -1200000 AND lon_e4 < -1200000 + 34 * 3000)"""

AREA_SQL = """
area AS (
  SELECT r.x AS cell_r, c.x AS cell_c, round((490000 + 3000 * r.x) / 10000.0, 2) AS latitude,
         round((-1200000 + 3000 * c.x) / 10000.0, 2) AS longitude
  FROM (SELECT unnest(range(37)) AS x) r, (SELECT unnest(range(34)) AS x) c)"""

DAYS_SQL = "days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)"

LIGHTNING_SQL = f"""{STRIKES_SQL}, {AREA_SQL}, {DAYS_SQL},
lightning AS (
  SELECT d.date, a.cell_r, a.cell_c, count(l.event_id) AS lightning_count,
         CAST(coalesce(sum(abs(l.strength)), 0) AS DOUBLE) AS absv_strength_sum,
         CAST(coalesce(sum(l.multiplicity), 0) AS BIGINT) AS multiplicity_sum
  FROM days d CROSS JOIN area a
  LEFT JOIN located l ON l.date = d.date AND l.cell_r = a.cell_r AND l.cell_c = a.cell_c
  GROUP BY 1, 2, 3)"""


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()


def celldays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per user, every day: rainfall, number of events and whether a purchase happened.

    Zero rows of every user and day are unioned in front of one aggregation.
    """
    e = table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("date"), (F.col("user_id") % 37).alias("cell_r"),
        div(F.col("user_id"), 37).alias("cell_c"), F.col("value").alias("tp"),
        (F.col("event_type") == "purchase").cast("int").alias("is_fire_day"), F.lit(1).alias("n_events"))
    days = e.agg(F.collect_set("date")).scalar()
    zeros = e.select("cell_r", "cell_c").distinct().select(
        "cell_r", "cell_c", F.explode(days).alias("date"), F.lit(0.0).alias("tp"), F.lit(0).alias("is_fire_day"),
        F.lit(0).alias("n_events"))
    sums = e.unionByName(zeros).groupBy("date", "cell_r", "cell_c").agg(
        F.sum("tp").alias("tp"), F.max("is_fire_day").alias("is_fire_day"), F.sum("n_events").alias("n_events"))
    return sums.withColumn("user_id", F.col("cell_c") * 37 + F.col("cell_r"))


CELLDAYS_SQL = f"""{DAYS_SQL},
sums AS (
  SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS tp, count(*) AS n_events,
         max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS is_fire_day
  FROM events GROUP BY 1, 2),
celldays AS (
  SELECT d.date, u.user_id % 37 AS cell_r, u.user_id // 37 AS cell_c, u.user_id,
         coalesce(s.tp, 0) AS tp, coalesce(s.is_fire_day, 0) AS is_fire_day,
         CAST(coalesce(s.n_events, 0) AS BIGINT) AS n_events
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN days d
  LEFT JOIN sums s ON s.user_id = u.user_id AND s.date = d.date)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather and surface columns derived from line items."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    t2 = q / 2 + 273.15
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"),
        t2.alias("2t"), (t2 - d * 100).alias("2d"), (F.col("l_tax") * 100).alias("10u"), (q / 10).alias("10v"),
        (d / 50).alias("tp"), *[(d * i).alias(f"swvl{i}") for i in range(1, 5)],
        *[(q / i + 270).alias(f"stl{i}") for i in range(1, 5)],
        (F.col("l_partkey") % 20).cast("int").alias("tvl"), (F.col("l_suppkey") % 20).cast("int").alias("tvh"),
        (F.col("l_partkey") % 9).cast("int").alias("slt"), (F.col("l_partkey") * 9.8067).alias("z"))


OBS_SQL = """
obs AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS date,
         l_quantity / 2 + 273.15 AS "2t", l_quantity / 2 + 273.15 - l_discount * 100 AS "2d",
         l_tax * 100 AS "10u", l_quantity / 10 AS "10v", l_discount / 50 AS tp,
         l_discount * 1 AS swvl1, l_discount * 2 AS swvl2, l_discount * 3 AS swvl3, l_discount * 4 AS swvl4,
         l_quantity / 1 + 270 AS stl1, l_quantity / 2 + 270 AS stl2, l_quantity / 3 + 270 AS stl3,
         l_quantity / 4 + 270 AS stl4, CAST(l_partkey % 20 AS INTEGER) AS tvl,
         CAST(l_suppkey % 20 AS INTEGER) AS tvh, CAST(l_partkey % 9 AS INTEGER) AS slt,
         l_partkey * CAST('9.8067' AS DOUBLE) AS z
  FROM lineitem)"""


def incident_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per order, on the days and in the area of the events."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 30).cast("int")).alias("date"),
        ((k * 7919 % 110000 + 490000) / 10000).alias("latitude"),
        ((k * 104729 % 100000 - 1200000) / 10000).alias("longitude"))


INCIDENTS_SQL = """
incidents AS (
  SELECT CAST(DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS date,
         490000 + (o_orderkey * 7919) % 110000 AS lat_e4, -1200000 + (o_orderkey * 104729) % 100000 AS lon_e4
  FROM orders)"""

# Tags by customer segment, so that the tag rules have something to sort.
SEGMENT_TAGS = {"AUTOMOBILE": ("railway", "rail"), "BUILDING": ("power", "line"),
                "MACHINERY": ("aeroway", "aerodrome"), "HOUSEHOLD": ("waterway", "river")}


def feature_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tagged feature point per customer; a road's class follows the nation."""
    k, roads = F.col("c_custkey"), ["motorway", "trunk", "primary", "secondary", "residential"]
    tags = F.create_map(F.lit("highway"), F.element_at(F.array(*[F.lit(r) for r in roads]),
                                                       (F.col("c_nationkey") % 5 + 1).cast("int")))
    for segment, (tag, value) in SEGMENT_TAGS.items():
        tags = F.when(F.col("c_mktsegment") == segment, F.create_map(F.lit(tag), F.lit(value))).otherwise(tags)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tags.alias("tags"), ((k * 7919 % 110000 + 490000) / 10000).alias("latitude"),
        ((k * 104729 % 100000 - 1200000) / 10000).alias("longitude"))


POINTS_SQL = """
points AS (
  SELECT c_custkey, 490000 + (c_custkey * 7919) % 110000 AS lat_e4,
         -1200000 + (c_custkey * 104729) % 100000 AS lon_e4,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'railway' WHEN 'BUILDING' THEN 'power_line'
              WHEN 'MACHINERY' THEN 'aeroway' WHEN 'HOUSEHOLD' THEN 'waterway'
              ELSE CASE WHEN c_nationkey % 5 < 4 THEN 'highway' END END AS category
  FROM customer),
placed AS (
  SELECT *, (lat_e4 - 490000) // 3000 AS cell_r, (lon_e4 + 1200000) // 3000 AS cell_c FROM points
  WHERE lat_e4 < 490000 + 37 * 3000 AND lon_e4 < -1200000 + 34 * 3000)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' probabilities for the labelled documents, with many ties."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"), (k * 7919 % 50 / 50).alias("probability"),
        (k * 104729 % 97 / 97).alias("p2"), (k * 31 % 11 / 11).alias("p3"))


SCORED_SQL = """
scored AS (
  SELECT doc_id, quality AS label, ((doc_id * 7919) % 50) / 50.0::DOUBLE AS probability,
         ((doc_id * 104729) % 97) / 97.0::DOUBLE AS p2, ((doc_id * 31) % 11) / 11.0::DOUBLE AS p3
  FROM labels)"""


def risk_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell-days with a risk score in steps of 1/1000 and the fire region around fire cells."""
    from cindergrid.operators.joins import dilate

    base = dilate(celldays(spark, sf_dir), 1, WIDE)
    return base.select("date", "cell_r", "cell_c", "is_fire_day", "fire_region",
                       ((F.col("user_id") * 7919 + F.dayofmonth("date") * 31) % 1000 / 1000).alias("risk_score"),
                       div(F.dayofmonth("date") - 1, 10).alias("batch"))


RISK_SQL = f"""{CELLDAYS_SQL},
fire AS (SELECT DISTINCT date, cell_r, cell_c FROM celldays WHERE is_fire_day = 1),
region AS (
  SELECT DISTINCT f.date, f.cell_r + a.x AS cell_r, f.cell_c + b.x AS cell_c
  FROM fire f, (SELECT unnest([-1, 0, 1]) AS x) a, (SELECT unnest([-1, 0, 1]) AS x) b),
risk AS (
  SELECT c.date, c.cell_r, c.cell_c, c.is_fire_day, CASE WHEN g.date IS NULL THEN 0 ELSE 1 END AS fire_region,
         ((c.user_id * 7919 + day(c.date) * 31) % 1000) / 1000.0::DOUBLE AS risk_score,
         (day(c.date) - 1) // 10 AS batch
  FROM celldays c LEFT JOIN region g ON g.date = c.date AND g.cell_r = c.cell_r AND g.cell_c = c.cell_c)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a rare positive class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"),
        (F.col("label") == 0).cast("int").alias("label"))


VECTORS_SQL = """
vectors AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label
  FROM embeddings)"""


def key_hash_sql(*parts: str, seed: int = 42) -> str:
    text = " || '|' || ".join([f"CAST({p} AS VARCHAR)" for p in parts] + [f"'{seed}'"])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
