"""Quality and exploration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.registry import CELLDAYS_SQL, celldays, query, rounded, table
from cindergrid.operators import aggregates, quality

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _gappy(spark, d):
    """Line items whose zero discounts and taxes are missing, one as NULL and one as NaN."""
    return table(spark, d, "lineitem").select(
        *KEYS, "l_returnflag", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"))


@query("null_audit", """
SELECT * FROM (SELECT unnest(['l_returnflag', 'l_discount', 'l_tax']) AS "column",
  unnest([count(*) FILTER (l_returnflag IS NULL), count(*) FILTER (l_discount = 0), count(*) FILTER (l_tax = 0)]) AS n_null FROM lineitem)""")
def null_audit(spark, d):
    return quality.null_audit(_gappy(spark, d), ["l_returnflag", "l_discount", "l_tax"])


@query("null_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount = 0 OR l_tax = 0")
def null_rows(spark, d):
    return quality.rows_with_nulls(_gappy(spark, d)).select(*KEYS)


@query("complete_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount <> 0")
def complete_rows(spark, d):
    return _gappy(spark, d).dropna("any", subset=["l_returnflag", "l_discount"]).select(*KEYS)


@query("numeric_columns", "SELECT " + ", ".join(f"max({c}) AS {c}" for c in ["l_linenumber", *MEASURES]) + " FROM lineitem")
def numeric_columns(spark, d):
    li = table(spark, d, "lineitem")
    names = quality.numeric_columns(li, exclude=["l_orderkey", "l_partkey", "l_suppkey"])
    return li.agg(*[F.max(c).alias(c) for c in names])


def _each(template: str, columns, source: str) -> str:
    return " UNION ALL ".join(template.format(c=c, source=source) for c in columns)


@query("describe", _each("""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM {source}""", MEASURES, "lineitem"))
def describe(spark, d):
    out = quality.summary(table(spark, d, "lineitem"), MEASURES)
    return rounded(rounded(out, "mean", "std", digits=4), "q25", "q50", "q75")


@query("histogram", _each("""
SELECT '{c}' AS "column", CAST(b.x AS INTEGER) AS bin, round(lo + b.x * (hi - lo) / 30, 4) AS low, round(lo + (b.x + 1) * (hi - lo) / 30, 4) AS high,
  count(s.v) AS n
FROM (SELECT unnest(range(30)) AS x) b CROSS JOIN (SELECT min({c}) AS lo, max({c}) AS hi FROM {source})
LEFT JOIN (SELECT {c} AS v, least(CAST(floor(({c} - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin
  FROM {source}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {source})) s ON s.bin = b.x
GROUP BY b.x, lo, hi""", ["l_extendedprice", "l_quantity"], "lineitem"))
def histogram(spark, d):
    out = quality.histogram(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    return rounded(out, "low", "high", digits=4)


BOX_SQL = """
SELECT '{c}' AS "column", round(any_value(q1), 6) AS q25, round(any_value(q2), 6) AS q50, round(any_value(q3), 6) AS q75,
  round(min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (NOT (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers
FROM (SELECT {c} AS v FROM {source}),
     (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM {source})"""


@query("boxplot", _each(BOX_SQL, ["value", "user_id"], "events"))
def boxplot(spark, d):
    out = quality.box_stats(table(spark, d, "events"), ["value", "user_id"])
    return rounded(out, "q25", "q50", "q75", "whisker_low", "whisker_high")


@query("outlier_rows", """
SELECT event_id, value FROM events,
  (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows(spark, d):
    return quality.outlier_rows(table(spark, d, "events"), "value").select("event_id", "value")


@query("correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS corr FROM lineitem" for a in MEASURES for b in MEASURES))
def correlation(spark, d):
    return rounded(quality.correlations(table(spark, d, "lineitem"), MEASURES), "corr")


@query("class_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def class_counts(spark, d):
    return aggregates.value_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("month_counts", """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, count(*) FILTER (o_orderstatus = 'F') AS "F",
  count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def month_counts(spark, d):
    counts = aggregates.value_counts(table(spark, d, "orders"), F.month("o_orderdate").alias("month"), "o_orderstatus")
    return counts.groupBy("month").pivot("o_orderstatus", ["F", "O", "P"]).sum("n").fillna(0)


@query("distinct_counts", """
SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem""")
def distinct_counts(spark, d):
    return aggregates.distinct_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_shipdate", "l_partkey"])


@query("daily_mean", """
SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
  count(l_quantity) AS n FROM lineitem GROUP BY 1""")
def daily_mean(spark, d):
    return rounded(aggregates.daily_mean(table(spark, d, "lineitem"), "l_quantity", "l_shipdate"), "mean", "std")


@query("cell_rate", f"""
WITH {CELLDAYS_SQL} SELECT cell_r, cell_c, count(*) AS n, CAST(sum(is_fire_day) AS BIGINT) AS fires,
  round(avg(is_fire_day), 6) AS fire_rate FROM celldays GROUP BY 1, 2""")
def cell_rate(spark, d):
    return rounded(aggregates.cell_rate(celldays(spark, d)), "fire_rate")


@query("date_range", "SELECT CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem")
def date_range(spark, d):
    out = aggregates.date_range(table(spark, d, "lineitem"), "l_shipdate")
    return out.select(F.to_date("first_day").alias("first_day"), F.to_date("last_day").alias("last_day"))


@query("class_weights", """
WITH t AS (SELECT count(*) AS n, count(DISTINCT quality) AS k FROM labels)
SELECT quality, count(*) AS n, round(any_value(t.n) / (any_value(t.k) * count(*)), 6) AS balanced_weight,
  round(any_value(t.n) / count(*), 6) AS inverse_share FROM labels, t GROUP BY 1""")
def class_weights(spark, d):
    return rounded(aggregates.class_weights(table(spark, d, "labels"), "quality"), "balanced_weight", "inverse_share")


@query("first_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def first_rows(spark, d):
    """The preview of a sorted table."""
    return table(spark, d, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("union_missing", """
SELECT CAST(ts AS DATE) AS date, 'events' AS kind, count(*) AS n, round(sum(value), 4) AS value, CAST(NULL AS DOUBLE) AS price FROM events GROUP BY 1
UNION ALL SELECT CAST(o_orderdate AS DATE), 'orders', count(*), NULL, round(sum(o_totalprice), 4) FROM orders GROUP BY 1""")
def union_missing(spark, d):
    a = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.lit("events").alias("kind"), "value")
    b = table(spark, d, "orders").select(F.lit("orders").alias("kind"), F.to_date("o_orderdate").alias("date"),
                                         F.col("o_totalprice").alias("price"))
    both = a.unionByName(b, allowMissingColumns=True)
    out = both.groupBy("date", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.sum("price").alias("price"))
    return rounded(out, "value", "price", digits=4)
