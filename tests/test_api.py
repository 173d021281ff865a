import warnings

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from trustfold.operators import api, applicability, evaluation, guards, plots, simulate
from trustfold.operators import folds as O


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 15, float(3 * (i % 15) + rng.normal()), float(rng.normal())) for i in range(300)]
    return spark.createDataFrame(rows, "row_id bigint, site int, value double, other double").cache()


def test_roles_and_facade(spark, grouped):
    assert api.detect_roles(grouped) == api.Roles(None, None, "site", "value")
    d, folds = api.assess(grouped)
    assert d.recommended == "group_fold" and folds.groupBy("site").agg(F.count_distinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1
    split = grouped.select("row_id", F.when(F.col("site") < 10, "train").otherwise("test").alias("role"))
    assert isinstance(api.assess(grouped, split), list)
    got = api.workflow(simulate.temporal(spark, 200), "y", ["x1", "x2"])
    assert got.diagnosis.recommended == "temporal_block" and got.performance.count() >= 2


def test_guards(spark, grouped):
    roles = {"group": "site", "target": "value"}
    with pytest.raises(guards.DependenceError):
        guards.random_cv(grouped, **roles)
    with pytest.raises(guards.DependenceError):
        guards.train_control(grouped, "cv", **roles)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert guards.random_cv(grouped, override=True, **roles).count() == 300
    assert said and guards.cache_info()["entries"] >= 1
    assert guards.random_cv(grouped, auto_block=True, **roles).count() == 300
    ready = VectorAssembler(inputCols=["other"], outputCol="features").transform(grouped.withColumnRenamed("value", "label"))
    cv = CrossValidator(estimator=LinearRegression(), estimatorParamMaps=ParamGridBuilder().build(), evaluator=RegressionEvaluator(), numFolds=2)
    with guards.guarded(group="site", target="label"), pytest.raises(guards.DependenceError):
        cv.fit(ready)
    folded = guards.fold_column(ready, O.group_folds(grouped, "site", 2))
    with guards.guarded(group="site", target="label"):
        assert cv.copy({cv.foldCol: "foldCol"}).fit(folded).avgMetrics
    guards.cache_clear()
    assert guards.fold_vector(O.long_form(O.group_folds(grouped, "site")), grouped).count() == 300
    assert guards.named_splits(O.group_folds(grouped, "site")).select("id").distinct().count() == 5


def test_inspection(spark, grouped):
    rows = grouped.withColumn("role", F.when(F.col("row_id") < 200, "train").otherwise("test"))
    steps = Pipeline(stages=[VectorAssembler(inputCols=["other"], outputCol="f"), StandardScaler(inputCol="f", outputCol="g", withMean=True)])
    ready = VectorAssembler(inputCols=["other"], outputCol="f").transform(rows)
    got = api.inspect_pipeline(steps.fit(rows), ready).collect()
    assert [(r.kind, r.leaks) for r in got] == [("VectorAssembler", False), ("StandardScalerModel", True)]
    assert not api.inspect(StandardScaler(inputCol="f", outputCol="g", withMean=True).fit(ready.where("role = 'train'")), ready)
    inner = rows.select("row_id", F.lit(1).alias("fold"), F.lit("train").alias("role"))
    assert api.inspect(inner, rows)[0].type == "cv_leak"
    assert {r.type for r in api.check_nested(inner, rows.select("row_id", "role"), "group_fold")} == {"nested_cv_leak", "nested_cv_strategy_mismatch"}
    assert api.check(grouped, rows.select("row_id", "role"), group="site").where("type = 'group_overlap'").count() == 1


def test_plot_data(spark, grouped):
    split = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train"), (3, "test")], "row_id bigint, role string")
    got = {r.role: r["count"] for r in plots.roles(grouped, split).groupBy("role").count().collect()}
    assert got == {"train": 1, "test": 1, "overlap": 1, "excluded": 297}
    rows = grouped.withColumn("role", F.when(F.col("row_id") % 2 == 0, "train").otherwise("test"))
    assert plots.group_membership(rows, "site").where("membership = 'leak'").count() == 15
    assert plots.split_on_time(rows, "row_id", 10).agg(F.sum("n")).first()[0] == 300
    assert '"Point"' in plots.geojson(grouped, "value", "other", ["site"]).first()[0]


def test_regions_profiles_and_sizes(spark):
    data = simulate.spatial(spark, 250)
    model = evaluation.Linear("response", ["x1", "x2"])
    t = evaluation.transferability(data, model, "x", "y")
    assert t.count() == 16 and t.where("trained = tested").agg(F.max("distance")).first()[0] == 0
    rng = np.random.default_rng(1)
    errors = spark.createDataFrame([(i, float(d), float(d + 0.1 * rng.normal())) for i, d in enumerate(rng.random(300))], "row_id bigint, di double, abs_error double")
    table, predict = evaluation.error_profile(errors)
    low, high = predict(spark.createDataFrame([(0.1,), (0.9,)], "di double")).orderBy("di").collect()
    assert table.count() == 10 and low.expected_error < high.expected_error
    held = model(data)(data)
    assert evaluation.check_residuals(held, "response", "x", "y")["verdict"] in ("mild", "strong")
    assert evaluation.block_sizes(data, "response", "x", "y", v=3, n_sizes=3).count() >= 1
    grid = applicability.clustered_points(spark, 60, (0, 0, 1, 1))
    got = applicability.distance_profiles(data, O.spatial_blocks(data, "x", "y"), grid)
    assert {r.kind for r in got.select("kind").distinct().collect()} == {"cv", "target", "sample"}
