"""Evaluation of 0/1 predictions and risk scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cindergrid.functions.values import over_threshold, strip_suffix
from cindergrid.operators.ranking import running_totals

# Thresholds of the validation sweep; the last is the default threshold.
THRESHOLDS = [0.10, 0.15, 0.20, 0.30, 0.35, 0.40, 0.45, 0.50, 0.51, 0.53, 0.55, 0.60, 0.70, 0.515]
DEFAULT_THRESHOLD = 0.515
METRICS = ["accuracy", "precision", "recall", "f1_score"]


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1; an undefined rate is 0."""
    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return {"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn), "f1_score": ratio(2 * tp, 2 * tp + fp + fn)}


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction",
              by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates in one aggregation, per group of ``by``."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def evaluate_scores(df: DataFrame, label: str = "label", score: str = "probability",
                    threshold: float = 0.5, inclusive: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Rates at a threshold and the area under the ROC curve: one row, or one per group of ``by``."""
    rates_at = confusion(df.withColumn("_p", over_threshold(score, threshold, inclusive)), label, "_p", by)
    area = auc(df, label, score, by).select(*by, "roc_auc")
    return rates_at.join(area, list(by), "left") if by else rates_at.withColumn("roc_auc", area.scalar())


def score_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest down: true and false positives when cutting there.

    ``by`` names a few groups, such as folds or models.
    """
    groups = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    down = running_totals(groups.withColumn("_down", -F.col("threshold")), "_down", ["pos", "neg"], by)
    return down.select(*by, "threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                       "total_pos", "total_neg")


def auc(df: DataFrame, label: str = "label", score: str = "probability", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count half. NULL when a class is absent."""
    curve = score_curve(df, label, score, by)
    wins = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    sums = [F.sum(wins).alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    return curve.groupBy(*by).agg(*sums).select(
        *by, F.try_divide(F.col("_w"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("roc_auc"),
        "n_pos", "n_neg")


def _recall_curve(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    curve = score_curve(df, label, score)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("total_pos").cast("double")), F.lit(0.0))
    out = curve.select("threshold", "tp", "fp", "total_pos", "total_neg", p.alias("precision"), r.alias("recall"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-6)
    return out.withColumn("f1", f1)


def precision_recall(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """``threshold, precision, recall, f1`` at every distinct score (predicting ``score >= threshold``)."""
    return _recall_curve(df, label, score).drop("total_pos", "total_neg")


def best_threshold(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """The score with the best F1 and the rates when predicting at or above it; ties take the lowest.

    The counts at a threshold come with the curve, so nothing is evaluated a second time.
    """
    curve = _recall_curve(df, label, score)
    fields = ["tp", "fp", "total_pos", "total_neg"]
    pick = curve.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"), *fields)).alias("b"))
    c = pick.select((-F.col("b.t")).alias("threshold"), *[F.col(f"b.{f}").alias(f) for f in fields]).select(
        "threshold", "tp", "fp", (F.col("total_pos") - F.col("tp")).alias("fn"),
        (F.col("total_neg") - F.col("fp")).alias("tn"))
    return c.withColumns(rates(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]))


def threshold_sweep(df: DataFrame, label: str = "is_fire_day", score: str = "risk_score",
                    region: str = "fire_region", batch: str | None = None,
                    thresholds: Sequence[float] = tuple(THRESHOLDS)) -> DataFrame:
    """``scope, threshold`` with the four rates, averaged over batches when ``batch`` is given.

    Scopes: ``all`` predictions, predictions times the ``region`` mask, predictions times the ``fire``
    target (the masked scopes know the truth: they diagnose, they do not score). Each row is reduced to
    how many thresholds its three predictions exceed; the sweep then works on those counts, of which
    there are a fixed number per batch, so no row is repeated per threshold.
    """
    cuts = sorted(set(thresholds))
    p, y = F.col(score), F.col(label)
    by = [batch] if batch else []

    def passed(x: Column) -> Column:
        return sum([(x > t).cast("int") for t in cuts[1:]], (x > cuts[0]).cast("int"))

    counts = df.groupBy(*by, (y == 1).alias("y"), passed(p).alias("all"), passed(p * F.col(region)).alias("region"),
                        passed(p * y).alias("fire")).agg(F.count("*").alias("n"))
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(s).alias("passed")) for s in ("all", "region", "fire")])
    levels = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("level")) for i, t in enumerate(cuts)])
    long = counts.select(*by, "y", "n", F.explode(scopes).alias("s")).select(
        *by, "y", "n", "s.*", F.explode(levels).alias("l"))
    hit = F.col("passed") >= F.col("l.level")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    cells = long.groupBy(*by, "scope", F.col("l.threshold").alias("threshold")).agg(
        total(F.col("y") & hit).alias("tp"), total(~F.col("y") & hit).alias("fp"),
        total(F.col("y") & ~hit).alias("fn"), total(~F.col("y") & ~hit).alias("tn"))
    scored = cells.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))
    if not batch:
        return scored
    return scored.groupBy("scope", "threshold").agg(
        *[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n_batches"))


def prediction_stats(df: DataFrame, score: str = "risk_score", batch: str | None = None) -> DataFrame:
    """Minimum, maximum and mean prediction; with ``batch``, their means over batches."""
    one = df.groupBy(*([batch] if batch else [])).agg(
        F.min(score).alias("min_pred"), F.max(score).alias("max_pred"), F.avg(score).alias("avg_pred"))
    return one.agg(*[F.avg(c).alias(c) for c in ("min_pred", "max_pred", "avg_pred")])


def _clamped_log(x: Column) -> Column:
    return F.when(x > 0, F.greatest(F.ln(F.when(x > 0, x)), F.lit(-100.0))).otherwise(-100.0)


def cross_entropy(score: Column, label: Column) -> Column:
    """Binary cross-entropy of one prediction, logs clamped at -100."""
    return -(label * _clamped_log(score) + (1 - label) * _clamped_log(1 - score))


def losses(df: DataFrame, label: str = "is_fire_day", score: str = "risk_score",
           region: str = "fire_region") -> DataFrame:
    """Mean cross-entropy of all, region-masked and fire-masked predictions, and 0.2 all + 0.8 region."""
    p, y = F.col(score), F.col(label)
    out = df.agg(F.avg(cross_entropy(p, y)).alias("full_loss"),
                 F.avg(cross_entropy(p * F.col(region), y)).alias("region_loss"),
                 F.avg(cross_entropy(p * y, y)).alias("fire_loss"))
    return out.withColumn("scaled_loss", 0.2 * F.col("full_loss") + 0.8 * F.col("region_loss"))


def vote(df: DataFrame, probabilities: Sequence[str], voting: str = "soft") -> DataFrame:
    """Ensemble of model outputs in one row: ``probability`` (soft only) and ``prediction``.

    Soft voting averages probabilities and predicts from 0.5; hard voting takes 0/1 predictions and needs
    a strict majority.
    """
    columns = [F.col(c) for c in probabilities]
    total = sum(columns[1:], columns[0])
    if voting == "soft":
        mean = total / len(columns)
        return df.withColumns({"probability": mean, "prediction": (mean >= 0.5).cast("int")})
    if voting == "hard":
        return df.withColumn("prediction", (total > len(columns) / 2).cast("int"))
    raise ValueError("voting must be 'soft' or 'hard'")


def report(results: DataFrame, metrics: Sequence[str] = (*METRICS, "roc_auc")) -> DataFrame:
    """``model, metric, value`` rows as one row per model."""
    return results.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def long_report(table: DataFrame, model: str | None = None,
                metrics: Sequence[str] = (*METRICS, "roc_auc")) -> DataFrame:
    """Metrics as ``model, metric, value`` rows: of one row named ``model``, or of a ``model`` column."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in metrics if m in table.columns])
    name = F.lit(model) if model else F.col("model")
    return table.select(name.alias("model"), F.explode(pairs).alias("x")).select("model", "x.*")


def model_report(scored: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """One row per ``model`` of the predictions ``model, fold, label, score``: its metrics averaged over folds.

    All models and folds are evaluated together.
    """
    each = evaluate_scores(scored, label, score, by=["model", "fold"])
    names = [*METRICS, "roc_auc"]
    return each.groupBy("model").agg(*[F.avg(m).alias(m) for m in names])


def passing_models(reported: DataFrame, threshold: float, suffix: str = " (Test)",
                   metric: str = "f1_score") -> DataFrame:
    """Test rows of a report whose metric reaches the threshold, with the suffix stripped."""
    return (reported.filter(F.col("model").endswith(suffix) & (F.coalesce(metric, F.lit(0.0)) >= threshold))
            .withColumn("model", strip_suffix("model", suffix)))
