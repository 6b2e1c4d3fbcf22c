import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from cindergrid.operators import scaling, stages
from cindergrid.operators.aggregates import with_class_weight


def frame(spark):
    return spark.range(200).select(
        "id", F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("a"), (F.col("id") % 13).cast("double").alias("b c"), F.lit(4.0).alias("flat"),
        F.element_at(F.array(*map(F.lit, "xyz")), (F.col("id") % 3 + 1).cast("int")).alias("kind"), (F.col("id") > 150).cast("int").alias("label"))


def steps():
    return [stages.MeanImputer(["a"]), stages.StandardScaling(["a", "flat"]), stages.RangeScaling(["b c"]), stages.CategoryEncoder(["kind"]), stages.ClassWeighting(["label"])]


def test_stages_give_what_the_operators_give(spark):
    df = frame(spark)
    want = scaling.impute_mean(with_class_weight(df, "label"), ["a"])
    want = scaling.one_hot(scaling.scale(want, ["a", "flat"], ["b c"]), ["kind"], keep=True)
    got = Pipeline(stages=steps()).fit(df).transform(df).select(*[f"`{c}`" for c in want.columns])
    for x, y in zip(got.orderBy("id").collect(), want.orderBy("id").collect()):
        assert [v if isinstance(v, str) else pytest.approx(v) for v in x] == list(y)


def test_saved_and_applied_to_later_rows(spark, tmp_path):
    df = frame(spark)
    ends = [VectorAssembler(inputCols=["a", "b c", "flat", "kind_y", "kind_z"], outputCol="features"), LogisticRegression(weightCol="weight")]
    fitted = Pipeline(stages=[*steps(), *ends]).fit(df.where("id % 2 = 0"))
    fitted.write().overwrite().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    odd = [(900, None, 3.0, 5.0, "new", 1), (901, float("nan"), None, None, None, None), (902, 1.0, 1.0, 1.0, "z", 7)]
    later = df.where("id % 2 = 1").union(spark.createDataFrame(odd, "id long, a double, `b c` double, flat double, kind string, label int")).cache()
    whole = later.where("id < 900")
    assert loaded.transform(whole).collect() == fitted.transform(whole).collect()
    shown = {r.id: r for r in PipelineModel(loaded.stages[:5]).transform(later).where("id >= 900").collect()}
    mean = df.where("id % 2 = 0").agg(F.avg("a")).first()[0]
    assert shown[900].a == pytest.approx(0, abs=1e-9) and mean > 0 and shown[900].flat == 1.0
    assert (shown[900].kind_y, shown[900].kind_z, shown[901].kind_z, shown[902].kind_z) == (0, 0, 0, 1)
    assert shown[901].weight is None and shown[902].weight is None and shown[901]["b c"] is None


def test_stages_in_cross_validation(spark):
    ends = [VectorAssembler(inputCols=["a", "b c"], outputCol="features"), LogisticRegression(weightCol="weight")]
    grid = ParamGridBuilder().addGrid(ends[1].regParam, [0.0, 10.0]).build()
    cv = CrossValidator(estimator=Pipeline(stages=[*steps(), *ends]), estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=2, seed=3)
    fitted = cv.fit(frame(spark))
    assert len(fitted.avgMetrics) == 2 and max(fitted.avgMetrics) > 0.95
