"""Splits, thresholds, metrics, votes and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.registry import (RISK_SQL, SCORED_SQL, key_hash_sql, query, risk_days, rounded, scored, table)
from cindergrid.functions.values import over_threshold, risk_class
from cindergrid.operators import metrics, sampling

RATES = ["accuracy", "precision", "recall", "f1_score"]


def rates_sql(digits: int = 6) -> str:
    parts = [("accuracy", "(tp + tn)", "(tp + fp + fn + tn)"), ("precision", "tp", "(tp + fp)"),
             ("recall", "tp", "(tp + fn)"), ("f1_score", "(2 * tp)", "(2 * tp + fp + fn)")]
    return ", ".join(f"round(CASE WHEN {b} = 0 THEN 0 ELSE {a} / CAST({b} AS DOUBLE) END, {digits}) AS {n}" for n, a, b in parts)


def counts_sql(y: str, p: str) -> str:
    return (f"count(*) FILTER ({y} = 1 AND {p}) AS tp, count(*) FILTER ({y} <> 1 AND {p}) AS fp, "
            f"count(*) FILTER ({y} = 1 AND NOT ({p})) AS fn, count(*) FILTER ({y} <> 1 AND NOT ({p})) AS tn")


@query("hash_split", f"""
SELECT o_orderkey, CASE WHEN {key_hash_sql('o_orderkey')} < 858993459 THEN 'test' ELSE 'train' END AS split FROM orders""")
def hash_split(spark, d):
    return sampling.random_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("day_split", f"""
SELECT date, CASE WHEN {key_hash_sql('date')} < 644245094 THEN 'test' ELSE 'train' END AS split
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""")
def day_split(spark, d):
    from cindergrid.plans.training import validation_days

    return validation_days(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct())


@query("stratified_split", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {key_hash_sql('doc_id')}, doc_id) AS i,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN i <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"], "quality")


@query("kfold", f"SELECT o_orderkey, CAST({key_hash_sql('o_orderkey')} % 5 AS INTEGER) AS fold FROM orders")
def kfold(spark, d):
    return sampling.with_fold(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("thresholds", f"""
WITH {SCORED_SQL} SELECT doc_id, CASE WHEN probability > 0.515 THEN 1 ELSE 0 END AS strict,
  CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS inclusive FROM scored""")
def thresholds(spark, d):
    return scored(spark, d).select("doc_id", over_threshold("probability").alias("strict"),
                                   over_threshold("probability", 0.5, inclusive=True).alias("inclusive"))


@query("risk_class", f"""
WITH {SCORED_SQL} SELECT doc_id, CASE WHEN p2 < 0.05 THEN 0 WHEN p2 < 0.15 THEN 1 WHEN p2 < 0.25 THEN 2 WHEN p2 < 0.35 THEN 3
  WHEN p2 < 0.45 THEN 4 WHEN p2 < 0.6 THEN 5 ELSE 6 END AS risk_class FROM scored""")
def risk_class_query(spark, d):
    return scored(spark, d).select("doc_id", risk_class("p2").alias("risk_class"))


@query("confusion", f"""
WITH {SCORED_SQL}, c AS (SELECT {counts_sql('label', 'probability > 0.515')} FROM scored)
SELECT tp, fp, fn, tn, {rates_sql()} FROM c""")
def confusion(spark, d):
    at = scored(spark, d).withColumn("prediction", over_threshold("probability"))
    return rounded(metrics.confusion(at), *RATES)


def _sweep_sql(batch: bool) -> str:
    by = "batch, " if batch else ""
    scopes = ("SELECT batch, is_fire_day AS y, 'all' AS scope, risk_score AS p FROM risk UNION ALL "
              "SELECT batch, is_fire_day, 'region', risk_score * fire_region FROM risk UNION ALL "
              "SELECT batch, is_fire_day, 'fire', risk_score * is_fire_day FROM risk")
    values = ", ".join(f"({t}::DOUBLE)" for t in "0.1 0.15 0.2 0.3 0.35 0.4 0.45 0.5 0.51 0.53 0.55 0.6 0.7 0.515".split())
    inner = f"""WITH {RISK_SQL}, long AS ({scopes}),
c AS (SELECT {by}scope, threshold, {counts_sql('y', 'p > threshold')} FROM long, (VALUES {values}) v(threshold) GROUP BY ALL)"""
    if not batch:
        return f"{inner} SELECT scope, threshold, tp, fp, fn, tn, {rates_sql()} FROM c"
    return f"""{inner}, r AS (SELECT scope, threshold, {rates_sql(15)} FROM c)
SELECT scope, threshold, {', '.join(f'round(avg({m}), 6) AS {m}' for m in RATES)}, count(*) AS n_batches FROM r GROUP BY ALL"""


@query("sweep", _sweep_sql(False))
def sweep(spark, d):
    return rounded(metrics.threshold_sweep(risk_days(spark, d)), *RATES)


@query("sweep_by_batch", _sweep_sql(True))
def sweep_by_batch(spark, d):
    return rounded(metrics.threshold_sweep(risk_days(spark, d), batch="batch"), *RATES)


def _bce_sql(p: str) -> str:
    return (f"-(is_fire_day * CASE WHEN {p} > 0 THEN greatest(ln({p}), -100) ELSE -100 END + (1 - is_fire_day) * "
            f"CASE WHEN 1 - {p} > 0 THEN greatest(ln(1 - {p}), -100) ELSE -100 END)")


@query("bce", f"""
WITH {RISK_SQL}, l AS (SELECT avg({_bce_sql('risk_score')}) AS a, avg({_bce_sql('risk_score * fire_region')}) AS r,
  avg({_bce_sql('risk_score * is_fire_day')}) AS f FROM (SELECT is_fire_day, fire_region, risk_score FROM risk))
SELECT round(a, 6) AS full_loss, round(r, 6) AS region_loss, round(f, 6) AS fire_loss, round(0.2 * a + 0.8 * r, 6) AS scaled_loss FROM l""")
def bce(spark, d):
    return rounded(metrics.losses(risk_days(spark, d)), "full_loss", "region_loss", "fire_loss", "scaled_loss")


@query("pred_stats", f"""
WITH {RISK_SQL}, b AS (SELECT min(risk_score) AS lo, max(risk_score) AS hi, avg(risk_score) AS m FROM risk GROUP BY batch)
SELECT round(avg(lo), 6) AS min_pred, round(avg(hi), 6) AS max_pred, round(avg(m), 6) AS avg_pred FROM b""")
def pred_stats(spark, d):
    return rounded(metrics.prediction_stats(risk_days(spark, d), batch="batch"), "min_pred", "max_pred", "avg_pred")


AUC_SQL = """
auc AS (SELECT (sum(CASE WHEN label = 1 THEN r END) - any_value(np) * (any_value(np) + 1) / 2.0) / (any_value(np) * any_value(nn)) AS roc_auc,
    any_value(np) AS n_pos, any_value(nn) AS n_neg
  FROM (SELECT label, rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS r,
          sum(label) OVER () AS np, count(*) OVER () - sum(label) OVER () AS nn FROM scored))"""


@query("auc", f"""
WITH {SCORED_SQL}, {AUC_SQL.format(p='probability')}
SELECT round(roc_auc, 6) AS roc_auc, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM auc""")
def auc(spark, d):
    return rounded(metrics.auc(scored(spark, d)), "roc_auc")


CURVE_SQL = """
curve AS (SELECT probability AS threshold, sum(sum(label)) OVER w AS tp, sum(count(*) - sum(label)) OVER w AS fp
  FROM scored GROUP BY probability WINDOW w AS (ORDER BY probability DESC)),
pr AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / (tp + fp) AS p, tp / (SELECT sum(label) FROM scored) AS r FROM curve),
prf AS (SELECT *, 2 * p * r / (p + r + 1e-6) AS f1 FROM pr)"""


@query("precision_recall", f"""
WITH {SCORED_SQL}, {CURVE_SQL} SELECT threshold, tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM prf""")
def precision_recall(spark, d):
    return rounded(metrics.precision_recall(scored(spark, d)), "precision", "recall", "f1")


@query("best_threshold", f"""
WITH {SCORED_SQL}, {CURVE_SQL}, b AS (SELECT threshold FROM prf ORDER BY f1 DESC, threshold LIMIT 1),
c AS (SELECT b.threshold, {counts_sql('label', 'probability >= b.threshold')} FROM scored, b GROUP BY 1)
SELECT threshold, tp, fp, fn, tn, {rates_sql()} FROM c""")
def best_threshold(spark, d):
    return rounded(metrics.best_threshold(scored(spark, d)), *RATES)


@query("vote_soft", f"""
WITH {SCORED_SQL} SELECT doc_id, round((probability + p2 + p3) / 3, 6) AS probability,
  CASE WHEN (probability + p2 + p3) / 3 >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scored""")
def vote_soft(spark, d):
    s = scored(spark, d).withColumnRenamed("probability", "p1")
    return rounded(metrics.vote(s, ["p1", "p2", "p3"]).select("doc_id", "probability", "prediction"), "probability")


@query("vote_hard", f"""
WITH {SCORED_SQL} SELECT doc_id, CASE WHEN (probability > 0.515)::INT + (p2 > 0.515)::INT + (p3 > 0.515)::INT >= 2 THEN 1 ELSE 0 END AS prediction FROM scored""")
def vote_hard(spark, d):
    s = scored(spark, d).select("doc_id", *[over_threshold(c).alias(c) for c in ("probability", "p2", "p3")])
    return metrics.vote(s, ["probability", "p2", "p3"], "hard").select("doc_id", "prediction")


def _report(spark, d):
    s = scored(spark, d)
    rows = [metrics.long_report(metrics.evaluate_scores(s, "label", c, inclusive=True), name)
            for c, name in [("probability", "A (Test)"), ("p2", "B (Test)"), ("p3", "B (CV)")]]
    return metrics.report(rows[0].unionByName(rows[1]).unionByName(rows[2]))


def _report_sql() -> str:
    out = []
    for p, name in [("probability", "A (Test)"), ("p2", "B (Test)"), ("p3", "B (CV)")]:
        area = AUC_SQL.format(p=p).split("AS (", 1)[1].rsplit(")", 1)[0]
        out.append(f"""SELECT '{name}' AS model, {rates_sql()}, round((SELECT roc_auc FROM ({area})), 6) AS roc_auc
FROM (SELECT {counts_sql('label', f'{p} >= 0.5')} FROM scored)""")
    return " UNION ALL ".join(out)


@query("report", f"WITH {SCORED_SQL} {_report_sql()}")
def report(spark, d):
    return rounded(_report(spark, d), *RATES, "roc_auc")


@query("filter_report", f"""
WITH {SCORED_SQL}, r AS ({_report_sql()})
SELECT replace(model, ' (Test)', '') AS model, f1_score FROM r WHERE model LIKE '% (Test)' AND f1_score >= 0.6""")
def filter_report(spark, d):
    return rounded(metrics.passing_models(_report(spark, d), 0.6).select("model", "f1_score"), "f1_score")
