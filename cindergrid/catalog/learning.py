"""Clustering, neighbours, balancing, classifiers, regressors and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from cindergrid.catalog.registry import CELLDAYS_SQL, VECTORS_SQL, WIDE, celldays, key_hash_sql, query, rounded, table, vectors
from cindergrid.operators import boosting, gram, models, sampling, stages
from cindergrid.operators.forest import nearest_forest
from cindergrid.operators.metrics import confusion, evaluate_scores
from cindergrid.operators.neighbors import knn_classify, nearest
from cindergrid.session import shared_folder
from cindergrid.plans.training import compare_models, samples, score_days

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SPLIT_SQL = f"""{VECTORS_SQL},
parts AS (SELECT *, {key_hash_sql('id')} < 858993459 AS held FROM vectors)"""


@query("nearest_rows", f"""
WITH {VECTORS_SQL}, pairs AS (
  SELECT a.id AS query_id, b.id AS neighbour_id, list_distance(a.vector, b.vector) AS distance
  FROM vectors a JOIN vectors b ON a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, neighbour_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def nearest_rows(spark, d):
    v = vectors(spark, d)
    return rounded(nearest(v, v, 5, exclude_self=True), "distance")


@query("forest_recall", """
WITH asked AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 20 = 0), held AS (SELECT count(*) AS n FROM embeddings)
SELECT asked.n AS queries, asked.n * least(10, held.n - 1) AS pairs, true AS ranks_complete, true AS distances_exact,
       true AS recall_095 FROM asked, held""")
def forest_recall(spark, d):
    """What the forest finds of the ten nearest rows of every twentieth vector, against the exact search."""
    v = vectors(spark, d)
    asked = v.filter("id % 20 = 0")
    exact = nearest(asked, v, 10, exclude_self=True).select("query_id", "neighbour_id", F.col("distance").alias("exact"))
    found = nearest_forest(asked, v, 10, exclude_self=True, leaves=4)
    both = exact.join(found, ["query_id", "neighbour_id"], "full")
    hit = F.count_if(F.col("exact").isNotNull() & F.col("distance").isNotNull())
    return both.agg(
        F.count_distinct("query_id").alias("queries"), F.count("exact").alias("pairs"),
        (F.count("distance") == F.count("exact")).alias("ranks_complete"),
        F.coalesce(F.bool_and(F.abs(F.col("distance") - F.col("exact")) < 1e-9), F.lit(True)).alias("distances_exact"),
        (hit >= 0.95 * F.count("exact")).alias("recall_095"))


@query("knn", f"""
WITH {SPLIT_SQL}, pairs AS (
  SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vector, b.vector), b.id) AS rank
  FROM parts a JOIN parts b ON a.held AND NOT b.held)
SELECT id, round(avg(label), 6) AS probability, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END AS prediction
FROM pairs WHERE rank <= 5 GROUP BY id""")
def knn(spark, d):
    parts = sampling.random_split(vectors(spark, d), ["id"])
    out = knn_classify(parts.filter("split = 'test'"), parts.filter("split = 'train'"), 5)
    return rounded(out, "probability")


SMOTE_SQL = f"""{VECTORS_SQL},
sizes AS (SELECT count(*) FILTER (label = 1) AS few, count(*) FILTER (label = 0) AS many FROM vectors),
ranked AS (SELECT *, row_number() OVER (ORDER BY {key_hash_sql('id')}, id) AS i FROM vectors WHERE label = 1),
copies AS (
  SELECT id, vector, unnest(range(1, 1 + (many - few) // few + CASE WHEN i <= (many - few) % few THEN 1 ELSE 0 END)) AS copy
  FROM ranked, sizes),
picked AS (
  SELECT *, {key_hash_sql('id', 'copy', "'pick'")} % 5 + 1 AS pick, {key_hash_sql('id', 'copy', "'step'")} / 4294967296.0::DOUBLE AS step FROM copies),
near AS (
  SELECT a.id, b.vector AS target, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vector, b.vector), b.id) AS rank
  FROM ranked a JOIN ranked b ON a.id <> b.id),
grown AS (
  SELECT id, 0 AS copy, vector, label FROM vectors
  UNION ALL SELECT p.id, p.copy, list_transform(range(1, 1 + len(p.vector)), lambda i: p.vector[i] + p.step * (n.target[i] - p.vector[i])), 1
  FROM picked p JOIN near n ON n.id = p.id AND n.rank = p.pick)"""


@query("smote", f"""
WITH {SMOTE_SQL} SELECT id, CAST(copy AS INTEGER) AS copy, CAST(label AS INTEGER) AS label,
  round(list_sum(list_transform(range(1, 1 + len(vector)), lambda i: vector[i] * i)), 5) AS weighted FROM grown""")
def smote(spark, d):
    """A checksum per row that depends on every coordinate."""
    out = sampling.smote(vectors(spark, d))
    weighted = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rounded(out.select("id", "copy", "label", weighted.alias("weighted")), "weighted", digits=5)


@query("smote_enn", f"""
WITH {SMOTE_SQL},
keyed AS (SELECT id * (SELECT max(copy) + 1 FROM grown) + copy AS k, id, copy, vector, label FROM grown),
near3 AS (
  SELECT a.k, b.label, a.label AS mine, row_number() OVER (PARTITION BY a.k ORDER BY list_distance(a.vector, b.vector), b.k) AS rank
  FROM keyed a JOIN keyed b ON a.k <> b.k),
bad AS (SELECT DISTINCT k FROM near3 WHERE rank <= 3 AND label <> mine)
SELECT id, CAST(copy AS INTEGER) AS copy, CAST(label AS INTEGER) AS label FROM keyed WHERE k NOT IN (SELECT k FROM bad)""")
def smote_enn(spark, d):
    return sampling.smote_enn(vectors(spark, d)).select("id", "copy", "label")


@query("clusters")
def clusters(spark, d):
    """Cluster sizes for both cluster counts."""
    days = WIDE.with_corners(celldays(spark, d))
    both = models.cluster_cells(models.cluster_cells(days, 12), 30)
    return both.groupBy("clusters_12", "clusters_30").agg(F.count("*").alias("n"))


def _split(spark, d):
    parts = sampling.random_split(vectors(spark, d), ["id"])
    parts = models.as_features(parts, "vector").drop("vector")
    return parts.filter("split = 'train'"), parts.filter("split = 'test'")


def _evaluated(spark, d, estimator):
    train, test = _split(spark, d)
    return evaluate_scores(models.score(estimator.fit(train), test, "p"), "label", "p")


@query("logistic")
def logistic(spark, d):
    return _evaluated(spark, d, models.logistic())


@query("forest")
def forest(spark, d):
    return _evaluated(spark, d, models.forest())


@query("forest_importance")
def forest_importance(spark, d):
    train, _ = _split(spark, d)
    fitted = models.forest().fit(train)
    return models.importances(fitted, [f"x{i}" for i in range(64)], spark)


@query("boosted")
def boosted(spark, d):
    return _evaluated(spark, d, models.boosted())


@query("perceptron")
def perceptron(spark, d):
    """Balanced with synthetic rows, then a dense network."""
    parts = sampling.random_split(vectors(spark, d), ["id"])
    train = models.as_features(sampling.smote(parts.filter("split = 'train'")), "vector")
    test = models.as_features(parts.filter("split = 'test'"), "vector")
    fitted = models.perceptron().fit(train.select("features", "label"))
    scored = models.score(fitted, test.select("id", "label", "features"), "p")
    return confusion(scored.withColumn("prediction", (F.col("p") >= 0.5).cast("int")))


@query("linear", """
WITH m AS (SELECT var_samp(l_quantity) AS sa, var_samp(l_discount) AS sb, covar_samp(l_quantity, l_discount) AS ab,
    covar_samp(l_quantity, l_extendedprice) AS ay, covar_samp(l_discount, l_extendedprice) AS by_,
    avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
c AS (SELECT *, (ay * sb - by_ * ab) / (sa * sb - ab * ab) AS a, (by_ * sa - ay * ab) / (sa * sb - ab * ab) AS b FROM m)
SELECT 'l_quantity' AS term, round(a, 2) AS value FROM c UNION ALL SELECT 'l_discount', round(b, 2) FROM c
UNION ALL SELECT 'intercept', round(my - a * ma - b * mb, 2) FROM c""")
def linear(spark, d):
    names = ["l_quantity", "l_discount"]
    fitted = models.linear(table(spark, d, "lineitem"), names, "l_extendedprice")
    return rounded(models.coefficients(fitted, names, spark), "value", digits=2)


@query("polynomial", """
WITH t AS (SELECT l_quantity / 50 AS a, (l_quantity / 50) ** 2 AS b, (l_quantity / 50) ** 3 AS c, l_extendedprice AS y FROM lineitem),
m AS (SELECT var_samp(a) AS aa, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, var_samp(b) AS bb, covar_samp(b, c) AS bc, var_samp(c) AS cc,
    covar_samp(a, y) AS ay, covar_samp(b, y) AS by_, covar_samp(c, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM t),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
k AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS x,
    (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS x2,
    (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS x3 FROM d)
SELECT 'x' AS term, round(x, 2) AS value FROM k UNION ALL SELECT 'x2', round(x2, 2) FROM k UNION ALL SELECT 'x3', round(x3, 2) FROM k
UNION ALL SELECT 'intercept', round(my - x * ma - x2 * mb - x3 * mc, 2) FROM k""")
def polynomial(spark, d):
    """Degree 3 in the quantity."""
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x"), "l_extendedprice")
    fitted = models.linear(li, ["x"], "l_extendedprice", degree=3)
    return rounded(models.coefficients(fitted, ["x", "x2", "x3"], spark), "value", digits=2)


def _normal_sql(terms, source, label):
    """Least squares on ``terms`` by elimination: a row of the matrix is cleared of one column in each step."""
    n = len(terms)
    rows = ", ".join("[" + ", ".join([f"covar_pop(t{i}, t{j})" for j in range(n)] + [f"covar_pop(t{i}, y)"]) + "]" for i in range(n))
    return f"""WITH RECURSIVE t AS (SELECT {', '.join(f'({e}) AS t{i}' for i, e in enumerate(terms))}, {label} AS y FROM {source}),
steps AS (
  SELECT 1 AS k, [{rows}] AS m FROM t
  UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
    ELSE list_transform(m[k], lambda v, j: r[j] - r[k] * (v / m[k][k])) END) FROM steps WHERE k <= {n}),
done AS (SELECT m FROM steps WHERE k = {n + 1})
SELECT * FROM (SELECT 'term_' || i AS term, round(m[i + 1][{n + 1}], 1) AS value FROM done, (SELECT unnest(range({n})) AS i)
UNION ALL SELECT 'intercept', (SELECT round(avg(y){''.join(f' - any_value(m[{i + 1}][{n + 1}]) * avg(t{i})' for i in range(n))}, 1) FROM t, done))"""


@query("polynomial_pair", _normal_sql(["a", "a*a", "a*a*a", "b", "a*b", "a*a*b", "b*b", "a*b*b", "b*b*b"],
                                      "(SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_extendedprice FROM lineitem)", "l_extendedprice"))
def polynomial_pair(spark, d):
    """Degree 3 over two features: nine terms and the intercept."""
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), "l_extendedprice")
    fitted = gram.least_squares(li, ["a", "b"], "l_extendedprice", degree=3)
    return rounded(models.coefficients(fitted, [f"term_{i}" for i in range(9)], spark), "value", digits=1)


#: Cramer's rule for the three features, every penalty and every fold left out (or none: fold -1); errors on the rows themselves.
RIDGE_SQL = f"""
WITH t AS (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y,
    {key_hash_sql("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")} % 5 AS fold FROM lineitem),
left_out AS (SELECT unnest(range(-1, 5)) AS f),
m AS (SELECT f, count(*) * var_pop(a) AS aa0, count(*) * var_pop(b) AS bb0, count(*) * var_pop(c) AS cc0, count(*) * covar_pop(a, b) AS ab,
    count(*) * covar_pop(a, c) AS ac, count(*) * covar_pop(b, c) AS bc, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS by_,
    count(*) * covar_pop(c, y) AS cy, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM t JOIN left_out ON t.fold <> f GROUP BY f),
p AS (SELECT m.*, alpha, aa0 + alpha AS aa, bb0 + alpha AS bb, cc0 + alpha AS cc FROM m,
    (SELECT unnest([{", ".join(f"1e{e}" for e in range(-6, 7))}]::DOUBLE[]) AS alpha)),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM p),
k AS (SELECT f, alpha, ma, mb, mc, my, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS wa,
    (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS wb,
    (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS wc FROM d),
errors AS (SELECT alpha, f, sqrt(avg((y - my - wa * (a - ma) - wb * (b - mb) - wc * (c - mc)) ** 2)) AS e FROM k JOIN t ON t.fold = f GROUP BY 1, 2),
best AS (SELECT alpha FROM errors GROUP BY 1 ORDER BY avg(e), alpha LIMIT 1),
w AS (SELECT * FROM k WHERE f = -1 AND alpha = (SELECT alpha FROM best))
SELECT 'l_quantity' AS term, round(wa, 3) AS value FROM w UNION ALL SELECT 'l_discount', round(wb, 3) FROM w
UNION ALL SELECT 'l_tax', round(wc, 3) FROM w UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb - wc * mc, 3) FROM w"""


@query("ridge", RIDGE_SQL)
def ridge(spark, d):
    names = ["l_quantity", "l_discount", "l_tax"]
    fitted = gram.ridge(table(spark, d, "lineitem"), names, "l_extendedprice", KEYS)
    return rounded(models.coefficients(fitted, names, spark), "value", digits=3)


@query("stored_pipeline", """
WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_totalprice END AS price, o_custkey::DOUBLE AS custkey, o_orderstatus,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label FROM orders),
early AS (SELECT * FROM o WHERE year(o_orderdate) < 1999),
m AS (SELECT avg(price) AS mean FROM early),
f AS (SELECT avg(coalesce(price, mean)) AS mu, stddev_pop(coalesce(price, mean)) AS sd, min(custkey) AS lo, max(custkey) - min(custkey) AS width,
    count(*) / (2.0 * count(*) FILTER (label = 1)) AS w1, count(*) / (2.0 * count(*) FILTER (label = 0)) AS w0 FROM early, m)
SELECT o_orderkey, round((coalesce(price, mean) - mu) / sd, 6) + 0.0 AS price, round((custkey - lo) / width, 6) AS custkey,
  CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P",
  round(CASE WHEN label = 1 THEN w1 ELSE w0 END, 6) AS weight
FROM o, m, f WHERE year(o_orderdate) >= 1999""")
def stored_pipeline(spark, d):
    """Fitted on the early orders, saved, loaded, and applied to the later ones."""
    key = F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.when(key % 10 != 0, F.col("o_totalprice")).alias("price"), key.cast("double").alias("custkey"),
        "o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"))
    pipeline = Pipeline(stages=[stages.MeanImputer(["price"]), stages.StandardScaling(["price"]), stages.RangeScaling(["custkey"]),
                                stages.CategoryEncoder(["o_orderstatus"]), stages.ClassWeighting(["label"])])
    path = shared_folder(spark)
    pipeline.fit(rows.filter("year < 1999")).save(path)
    later = PipelineModel.load(path).transform(rows.filter("year >= 1999"))
    return rounded(later.select("o_orderkey", "price", "custkey", "o_orderstatus_O", "o_orderstatus_P", "weight"), "price", "custkey", "weight")


@query("model_report")
def model_report(spark, d):
    """Cross-validated and held-out metrics of a regression, the neighbour classifier, a forest and boosted trees, on
    balanced rows."""
    return compare_models(vectors(spark, d), "id", "vector", "label", {
        "Logistic Regression": models.logistic(), "Random Forest": models.forest(), "XGBoost": models.boosted()})


@query("score_season")
def score_season(spark, d):
    """Look-back samples of every cell, trained on the first days and scored on the later ones."""
    rows = samples(celldays(spark, d), ["tp", "n_events", "is_fire_day"], 14, 5, static=["cell_r", "cell_c"])
    early = F.col("date") <= F.lit("2024-01-18").cast("date")
    fitted = models.logistic().fit(rows.filter(early).withColumnRenamed("target", "label"))
    return score_days(fitted, rows.filter(~early))


#: Orders by a column that decides the label with a wide margin and two that don't; the held rows are those of hash_split.
MARGIN_SQL = f"SELECT o_orderkey, CAST(o_custkey % 2 AS INTEGER) AS label, {key_hash_sql('o_orderkey')} AS h FROM orders"


def _margin(spark, d):
    key, side = F.col("o_orderkey"), F.col("o_custkey") % 2
    rows = table(spark, d, "orders").select("o_orderkey", side.cast("int").alias("label"), F.array(
        (key % 8 + side * 12) / 19, F.floor(key / 8) % 5 / 4, F.floor(F.col("o_custkey") / 2) % 7 / 6).alias("vector"))
    return models.as_features(rows, "vector").drop("vector")


def _held_predictions(spark, d, estimator):
    """Fitted at full settings on the train rows: each held-out order with its label and prediction."""
    parts = sampling.random_split(_margin(spark, d), ["o_orderkey"])
    fitted = estimator.fit(parts.filter("split = 'train'").drop("split"))
    scored = models.score(fitted, parts.filter("split = 'test'"), "p")
    return scored.select("o_orderkey", "label", (F.col("p") >= 0.5).cast("int").alias("prediction"))


HELD_SQL = f"SELECT o_orderkey, label, label AS prediction FROM ({MARGIN_SQL}) WHERE h < 858993459"


@query("logistic_margin", HELD_SQL)
def logistic_margin(spark, d):
    return _held_predictions(spark, d, models.logistic())


@query("forest_margin", HELD_SQL)
def forest_margin(spark, d):
    return _held_predictions(spark, d, models.forest())


@query("boosted_margin", HELD_SQL)
def boosted_margin(spark, d):
    return _held_predictions(spark, d, models.boosted())


@query("second_order_margin", HELD_SQL)
def second_order_margin(spark, d):
    """Newton boosting, 30 trees at the default rate and depth."""
    return _held_predictions(spark, d, boosting.SecondOrder(rounds=30))


@query("perceptron_margin", HELD_SQL)
def perceptron_margin(spark, d):
    return _held_predictions(spark, d, models.perceptron())


@query("importance_margin", """
SELECT x.feature, CAST(x.feature = 'side' AND (SELECT count(*) FROM orders) > 0 AS INTEGER) AS decides FROM (VALUES ('side'), ('b'), ('c')) x(feature)""")
def importance_margin(spark, d):
    """Only the deciding column has more than half of the importance."""
    fitted = models.forest().fit(_margin(spark, d))
    return models.importances(fitted, ["side", "b", "c"], spark).select("feature", (F.col("importance") > 0.5).cast("int").alias("decides"))


@query("folds_margin", f"""
SELECT CAST(h % 5 AS INTEGER) AS fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos, CAST(0 AS BIGINT) AS n_wrong
FROM ({MARGIN_SQL}) GROUP BY 1""")
def folds_margin(spark, d):
    """Sizes of the five folds and the wrong predictions of the models fitted without them."""
    scored = models.out_of_fold(models.logistic(), _margin(spark, d), ["o_orderkey"])
    wrong = (F.col("probability") >= 0.5).cast("int") != F.col("label")
    return scored.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.count_if(wrong).alias("n_wrong"))


@query("cluster_totals", f"""
WITH {CELLDAYS_SQL} SELECT count(*) AS n, count(DISTINCT user_id) AS n_cells, least(12, count(DISTINCT user_id)) AS n_12, least(30, count(DISTINCT user_id)) AS n_30,
  CAST(0 AS BIGINT) AS n_split FROM celldays""")
def cluster_totals(spark, d):
    """Rows, cells, clusters of both counts (no more than cells), and cells that are in two clusters of a count."""
    days = WIDE.with_corners(celldays(spark, d))
    both = models.cluster_cells(models.cluster_cells(days, 12), 30)
    cells = both.groupBy("user_id").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("clusters_12", "clusters_30")],
                                        ((F.min("clusters_12") < F.max("clusters_12")) | (F.min("clusters_30") < F.max("clusters_30"))).alias("split"))
    return cells.agg(F.sum("n").alias("n"), F.count("*").alias("n_cells"), F.count_distinct("clusters_12").alias("n_12"),
                     F.count_distinct("clusters_30").alias("n_30"), F.count_if("split").alias("n_split"))


@query("season_targets", f"""
WITH {CELLDAYS_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY cell_r, cell_c ORDER BY date) AS i FROM celldays)
SELECT t.date, t.cell_r, t.cell_c, t.is_fire_day, 1 AS valid FROM numbered s
JOIN numbered t ON t.cell_r = s.cell_r AND t.cell_c = s.cell_c AND t.i = s.i + 5 WHERE s.i > 14 AND s.date > DATE '2024-01-18'""")
def season_targets(spark, d):
    """The scored cell-days of :func:`score_season` with their labels; every risk is a probability."""
    return score_season(spark, d).select("date", "cell_r", "cell_c", "is_fire_day", F.col("risk_score").between(0, 1).cast("int").alias("valid"))
