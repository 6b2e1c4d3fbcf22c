import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from cindergrid.operators import metrics, quality, ranking
from cindergrid.operators.ranking import from_image, look_up, quantiles, ranked, running_totals, with_image


def test_running_totals_over_many_blocks(spark):
    rng = random.Random(3)
    values = rng.sample(range(10_000), 500) + [10**9]
    df = spark.createDataFrame([(v, v % 7, v % 2) for v in values], "x bigint, w bigint, g bigint")
    for fan in (2, 3, 8, 32):
        got = {r.x: r.cum_w for r in running_totals(df, "x", ["w"], fan=fan).collect()}
        total = 0
        for v in sorted(values):
            total += v % 7
            assert got[v] == total
    per_group = running_totals(df, "x", ["w"], by=["g"], fan=3).collect()
    for r in per_group:
        assert r.cum_w == sum(v % 7 for v in values if v <= r.x and v % 2 == r.g)


def test_rank_with_ties_is_a_permutation(spark):
    df = spark.range(300).withColumn("h", F.lit(5) * (F.col("id") % 3))
    got = ranked(df, "h", ["id"], fan=3).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 301))
    assert [(r.h, r.id) for r in got] == sorted((r.h, r.id) for r in got)


def test_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=400), np.full(300, 0.25), rng.exponential(size=401)])
    df = spark.createDataFrame([(float(v), float(-v)) for v in values] + [(None, float("nan"))], "a double, b double")
    got = {r.column: r for r in quantiles(df, ["a", "b"], {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q99": 0.99}).collect()}
    for c, v in (("a", values), ("b", -values)):
        for name, q in (("q10", 0.1), ("q25", 0.25), ("q50", 0.5), ("q99", 0.99)):
            assert got[c][name] == pytest.approx(np.quantile(v, q))


EDGES = [0.0, -0.0, 5e-324, 1e-310, 2.2250738585072014e-308, 1.0, 2.0, 0.1, 3.0, 1.7976931348623157e308, float("inf"), 2.0**52, 2.0**-1000]


def test_images_are_the_bit_patterns(spark):
    """Also next to every power of two, where logarithms round."""
    near = [v for e in range(-1073, 1024, 7) for v in (2.0**e, float(np.nextafter(2.0**e, 0)), float(np.nextafter(2.0**e, np.inf)))]
    values = [s * v for v in EDGES + near for s in (1.0, -1.0)]
    df = with_image(spark.createDataFrame([(v,) for v in values], "x double"), "x", "code")
    for r in df.withColumn("back", from_image(F.col("code"))).collect():
        bits = int(np.float64(abs(r.x)).view(np.int64))
        assert r.code == (bits if r.x >= 0 else -bits) and r.back == r.x


@pytest.mark.parametrize("kind", ["hot", "distinct", "close", "wide"])
def test_selection_by_digits(spark, kind):
    """A value that holds a third of the rows, all values distinct, values that differ in their last bits, and all exponents."""
    rng = np.random.default_rng(8)
    v = {"hot": np.concatenate([np.full(1000, -7.5), rng.normal(size=2000)]), "distinct": rng.permutation(3001) - 1500.0,
         "close": 1.0 + np.arange(500) * 2.0**-52, "wide": np.concatenate([np.exp(rng.normal(size=999) * 200), -np.exp(rng.normal(size=500) * 200)])}[kind]
    df = spark.createDataFrame([(float(x), i % 2) for i, x in enumerate(v)], "v double, g int")
    qs = {"q0": 0.0, "q3": 0.3, "q50": 0.5, "q999": 0.999, "q100": 1.0}
    got = quantiles(df, ["v"], qs).first()
    for name, q in qs.items():
        assert got[name] == pytest.approx(np.quantile(v, q), rel=1e-12)
    for r in quantiles(df, ["v"], qs, by=["g"]).collect():
        assert r.q50 == pytest.approx(np.quantile(v[r.g :: 2], 0.5), rel=1e-12)


def test_selection_moves_counts_not_values(spark, tmp_path, monkeypatch):
    """Ten times the rows, all distinct, in as many tasks: what is shuffled is bound by digits, not by rows."""
    monkeypatch.setattr(ranking, "DIGIT", 8)
    moved = []
    for n in (40_000, 400_000):
        path = str(tmp_path / str(n))
        spark.range(n, numPartitions=4).select((F.col("id") * 1.0 / n).alias("v")).write.parquet(path)
        before = shuffled(spark)
        assert quantiles(spark.read.parquet(path), ["v"], {"q50": 0.5}).first().q50 == pytest.approx((n - 1) / n / 2)
        moved.append(shuffled(spark) - before)
    assert moved[1] < 1.5 * moved[0] < 20_000


def shuffled(spark) -> int:
    """Rows written to shuffles by all stages so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, getattr(spark._jvm.scala, "Array").emptyDoubleArray(), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_values_at_all(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "v double, w double")
    assert [(r.column, r.q50) for r in quantiles(df, ["v", "w"], {"q50": 0.5}).collect()] == [("w", 1.0)]
    assert quantiles(df.limit(0), ["v"], {"q50": 0.5}).count() == 0


def test_summary_matches_numpy(spark):
    values = [1.0, 2.0, 2.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = quality.summary(df, ["v"]).first()
    assert (r["count"], r["min"], r["max"], r.q25, r.q50, r.q75) == (4, 1.0, 7.0, 1.75, 2.0, 3.25)
    assert r["mean"] == 3.0 and r["std"] == pytest.approx(np.std(values, ddof=1))


def test_histogram_puts_maximum_in_last_bin(spark):
    df = spark.range(61).select(F.col("id").cast("double").alias("v"), F.lit(3.0).alias("flat"))
    got = quality.histogram(df, ["v", "flat"]).collect()
    v = sorted((r.bin, r.n) for r in got if r.column == "v")
    assert len(v) == 30 and sum(n for _, n in v) == 61 and v[29] == (29, 3)
    assert sum(r.n for r in got if r.column == "flat") == 61


def test_auc_with_ties_matches_mllib(spark):
    rng = random.Random(1)
    data = [(rng.randint(0, 20) / 20, int(rng.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(data, "probability double, label int")
    want = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0).evaluate(
        df.withColumn("label", F.col("label").cast("double")))
    got = metrics.auc(df).first()
    assert got.roc_auc == pytest.approx(want) and got.n_pos + got.n_neg == 400
    assert metrics.auc(df.filter("label = 1")).first().roc_auc is None


def test_auc_by_group(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 3, rng.randint(0, 9) / 10, rng.randint(0, 1)) for i in range(200)],
                               "fold int, probability double, label int")
    got = {r.fold: r.roc_auc for r in metrics.auc(df, by=["fold"]).collect()}
    for fold, area in got.items():
        assert area == pytest.approx(metrics.auc(df.filter(F.col("fold") == fold)).first().roc_auc)
    assert len(got) == 3


def test_best_threshold_reevaluates_inclusively(spark):
    data = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 1), (0.2, 0), (0.1, 0)]
    df = spark.createDataFrame(data, "probability double, label int")
    r = metrics.best_threshold(df).first()
    assert (r.threshold, r.tp, r.fp, r.fn, r.tn) == (0.7, 3, 1, 0, 2)
    assert r.precision == 0.75 and r.recall == 1.0


def test_confusion_adds_up_and_empty_rates_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    r = metrics.confusion(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (0, 0, 0, 2) and (r.precision, r.recall, r.f1_score, r.accuracy) == (0, 0, 0, 1)


def test_sweep_matches_direct_counts(spark):
    rng = random.Random(5)
    data = [(i % 3, rng.randint(0, 100) / 100, int(rng.random() < 0.2), int(rng.random() < 0.5)) for i in range(300)]
    df = spark.createDataFrame(data, "batch int, risk_score double, is_fire_day int, fire_region int")
    got = {(r.scope, r.threshold): r for r in metrics.threshold_sweep(df).collect()}
    assert len(got) == 42
    for (scope, t), r in got.items():
        mask = {"all": lambda y, m: 1, "region": lambda y, m: m, "fire": lambda y, m: y}[scope]
        tp = sum(1 for _, p, y, m in data if y and p * mask(y, m) > t)
        fp = sum(1 for _, p, y, m in data if not y and p * mask(y, m) > t)
        assert (r.tp, r.fp) == (tp, fp) and r.tp + r.fp + r.fn + r.tn == 300
    averaged = {(r.scope, r.threshold): r for r in metrics.threshold_sweep(df, batch="batch").collect()}
    assert averaged["all", 0.5].n_batches == 3


def test_losses_clamp_logs(spark):
    df = spark.createDataFrame([(1.0, 0, 1), (0.0, 1, 1), (0.5, 1, 0)], "risk_score double, is_fire_day int, fire_region int")
    r = metrics.losses(df).first()
    assert r.full_loss == pytest.approx((100 + 100 + np.log(2)) / 3)
    assert r.region_loss == pytest.approx(100.0)
    assert r.scaled_loss == pytest.approx(0.2 * r.full_loss + 0.8 * r.region_loss)


def test_votes(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.4, 0.5)], "a double, b double")
    assert [r.prediction for r in metrics.vote(df, ["a", "b"]).collect()] == [1, 0]
    hard = spark.createDataFrame([(1, 0), (1, 1)], "a int, b int")
    assert [r.prediction for r in metrics.vote(hard, ["a", "b"], "hard").collect()] == [0, 1]
    with pytest.raises(ValueError):
        metrics.vote(df, ["a"], "loud")


def test_look_up_refuses_many_keys(spark):
    small = spark.range(6).withColumn("x", F.col("id") * 2)
    assert [r.x for r in look_up(spark.range(3), small, ["id"], ["x"]).orderBy("id").collect()] == [0, 2, 4]
    with pytest.raises(Exception, match="more than 5 keys"):
        look_up(spark.range(3), small, ["id"], ["x"], limit=5).collect()
