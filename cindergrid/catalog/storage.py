"""Sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog import collection, evaluation
from cindergrid.catalog.registry import AREA, POINTS_SQL, SCORED_SQL, STRIKES_SQL, query, rounded, strikes, strikes_of, table
from cindergrid.operators import metrics
from cindergrid.session import shared_folder
from cindergrid.sources import readers, sinks
from cindergrid.streaming.strikes import strike_stream, write_closed_days

ORDER_SCHEMA = "o_orderkey bigint, date date, o_totalprice double, o_orderstatus string"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_totalprice",
                                            "o_orderstatus")


@query("csv_by_period", """
SELECT strftime(o_orderdate, '%Y%m') AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def csv_by_period(spark, d):
    path = shared_folder(spark)
    sinks.write_periods(_orders(spark, d), path, "csv")
    back = readers.read_directory(spark, path, ORDER_SCHEMA, recursive=True)
    out = back.groupBy(F.date_format("date", "yyyyMM").alias("period")).agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(out, "total", digits=2)


@query("one_period", """
SELECT o_orderstatus, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y%m') IN ('199602', '199603') GROUP BY 1""")
def one_period(spark, d):
    path = shared_folder(spark)
    sinks.write_periods(_orders(spark, d), path)
    return readers.read_period(spark, path, "199602", "199603").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("months_rewritten", """
SELECT strftime(o_orderdate, '%Y%m') AS period, count(*) AS n, round(sum(o_totalprice * CASE WHEN month(o_orderdate) = 3 THEN 2 ELSE 1 END), 2) AS total
FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) NOT IN (5, 11) GROUP BY 1""")
def months_rewritten(spark, d):
    """Monthly files with two months absent; one month is collected again and takes the place of its file."""
    path, day = shared_folder(spark), F.col("date")
    year = _orders(spark, d).filter((F.year(day) == 1996) & ~F.month(day).isin(5, 11))
    sinks.write_months(year, path)
    sinks.write_months(year.filter(F.month(day) == 3).withColumn("o_totalprice", F.col("o_totalprice") * 2), path)
    back = readers.read_months(spark, path, [1996], schema=ORDER_SCHEMA)
    out = back.groupBy(F.date_format("date", "yyyyMM").alias("period")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(out, "total", digits=2)


@query("split_files", "SELECT count(*) AS n, CAST(1 AS INTEGER) AS within_limit FROM lineitem")
def split_files(spark, d):
    path, limit = shared_folder(spark), 7000
    sinks.write_split_files(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), path, limit)
    back = spark.read.schema("l_orderkey bigint, l_quantity double").csv(path, header=True)
    files = sinks.largest_file_rows(back)
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= limit).cast("int").alias("within_limit"))


@query("mixed_headers", f"""
WITH {STRIKES_SQL} SELECT date, count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS with_fid, CAST(sum(strength) AS BIGINT) AS strength
FROM strikes GROUP BY 1""")
def mixed_headers(spark, d):
    """Strike files of two directories, one with an extra column and another date format."""
    path = shared_folder(spark)
    s = strikes(spark, d)
    plain = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_group"), "latitude", "longitude", "strength", "multiplicity"]
    with_fid = [F.col("event_id").alias("fid"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("date_group"), *plain[1:]]
    sinks.write_table(s.filter("event_id % 2 = 0").select(*with_fid), f"{path}/2023")
    sinks.write_table(s.filter("event_id % 2 = 1").select(*plain), f"{path}/2024")
    back = readers.read_strikes(spark, path, cache=f"{path}_merged")
    return back.groupBy("date").agg(F.count("*").alias("n"), F.count("fid").alias("with_fid"),
                                    F.sum("strength").alias("strength"))


@query("train_test_tables", """
SELECT CASE WHEN year(o_orderdate) < 2000 THEN 'train' ELSE 'test' END AS split, count(*) AS n,
  count(*) FILTER (o_orderstatus = 'F') AS positives FROM orders GROUP BY 1""")
def train_test_tables(spark, d):
    path = shared_folder(spark)
    o = table(spark, d, "orders").select("o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                                         F.when(F.year("o_orderdate") < 2000, "train").otherwise("test").alias("split"))
    sinks.write_train_test(o, path, "label")
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("positives"))


@query("scored_table", """
SELECT quality AS is_fire_day, count(*) AS n, round(sum(((doc_id * 7919) % 50) / 50.0::DOUBLE), 4) AS risk FROM labels GROUP BY 1""")
def scored_table(spark, d):
    """A score table and a report written as CSV, read back."""
    path = shared_folder(spark)
    rows = table(spark, d, "labels").select(F.col("quality").alias("is_fire_day"), (F.col("doc_id") * 7919 % 50 / 50).alias("risk_score"))
    sinks.write_table(rows, f"{path}/scores")
    sinks.write_table(metrics.prediction_stats(rows), f"{path}/report")
    back = readers.read_directory(spark, f"{path}/scores", "is_fire_day int, risk_score double")
    return rounded(back.groupBy("is_fire_day").agg(F.count("*").alias("n"), F.sum("risk_score").alias("risk")), "risk", digits=4)


@query("strike_stream", f"""
WITH {STRIKES_SQL} SELECT date, cell_r, cell_c, count(*) AS lightning_count, CAST(sum(abs(strength)) AS DOUBLE) AS absv_strength_sum,
  CAST(sum(multiplicity) AS BIGINT) AS multiplicity_sum
FROM located WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2, 3""")
def strike_stream_query(spark, d):
    """All events as a stream: the days the watermark has closed."""
    path = shared_folder(spark)
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counts = strike_stream(strikes_of(events).withColumn("ts", F.col("ts").cast("timestamp")), AREA)
    write_closed_days(counts, f"{path}/out", f"{path}/progress").awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/out")


@query("points_file", f"WITH {POINTS_SQL} SELECT category, count(*) AS n, round(sum(lat_e4 / 10000.0::DOUBLE), 2) AS total FROM points WHERE category IS NOT NULL GROUP BY 1")
def points_file(spark, d):
    """Pre-collected feature points written as CSV and read back."""
    path = shared_folder(spark)
    points = collection.categorised(spark, d).select("category", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    sinks.write_table(points, path)
    out = readers.read_points(spark, path).groupBy("category").agg(F.count("*").alias("n"), F.sum("latitude").alias("total"))
    return rounded(out, "total", digits=2)


@query("report_file", f"WITH {SCORED_SQL} {evaluation._report_sql()}")
def report_file(spark, d):
    """The model report written as CSV and read back."""
    path, measures = shared_folder(spark), [*evaluation.RATES, "roc_auc"]
    sinks.write_table(evaluation._report(spark, d), path)
    back = readers.read_directory(spark, path, ", ".join(["model string", *(f"{m} double" for m in measures)]))
    return rounded(back, *measures)


@query("audit_files", """
SELECT 'orders' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders
UNION ALL SELECT 'labels', count(*), CAST(sum(doc_id) AS BIGINT) FROM labels""")
def audit_files(spark, d):
    path, keys = shared_folder(spark), {"orders": "o_orderkey", "labels": "doc_id"}
    sinks.write_audit({name: table(spark, d, name).select(F.col(key).alias("key")) for name, key in keys.items()}, path)
    parts = [readers.read_directory(spark, f"{path}/{name}", "key bigint").agg(F.count("*").alias("n"), F.sum("key").alias("total"))
             .select(F.lit(name).alias("name"), "n", "total") for name in keys]
    return parts[0].unionByName(parts[1])


@query("run_settings", "SELECT CAST(min(year(o_orderdate)) AS INTEGER) AS first_year, CAST(max(year(o_orderdate)) AS INTEGER) AS last_year, count(*) AS n FROM orders")
def run_settings(spark, d):
    """A run configuration derived from the orders, stored as JSON, one key of it read back."""
    path, year = shared_folder(spark), F.year("o_orderdate")
    season = F.struct(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("n"))
    table(spark, d, "orders").agg(season.alias("season"), F.lit("no").alias("other")).write.json(path)
    chosen = readers.run_parameters(spark, path, "season")
    return spark.createDataFrame([(chosen["first_year"], chosen["last_year"], chosen["n"])], "first_year int, last_year int, n bigint")
