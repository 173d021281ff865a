import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from trustfold.operators import api, guards, leakage, scope
from trustfold.operators.leakage import HARD, SOFT


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"), F.when(F.col("id") < 70, "train").otherwise("test").alias("role")).cache()


def test_sizes_that_were_seen():
    one = lambda *a, **k: [(r.type, r.severity) for r in scope.size_scope(*a, **k)]
    assert one(70, 70, 100) == one(None, 70, 100) == []
    assert one(80, 70, 100) == one(60, 70, 100) == [("model_scope", HARD)]
    assert one(100, 70, 100, "learner") == [("model_trained_on_full_data", HARD)] and one(90, 70, 100, "learner") == [("model_training_size_mismatch", SOFT)] and not one(60, 70, 100, "learner")
    assert one(90, 70, 100, "folds") == [("cv_scope", HARD)] and not one(60, 70, 100, "folds")
    assert one(90, 70, 100, "training_data") == [("data_scope", HARD)] and one(60, 70, 100, "training_data") == [("data_scope", SOFT)]
    assert one(100, 70, 100, "task") == [("task_contains_test_data", SOFT)] and not one(90, 70, 100, "task")
    assert one(100, 70, 100, "tuning") == [("tune_on_full_data", HARD)] and not one(90, 70, 100, "tuning")


def test_rows_that_were_seen(rows):
    split = rows.select("row_id", "role")
    kinds = lambda seen: [r.type for r in scope.fitted_on(seen, split)]
    assert kinds(rows.where("role = 'train'")) == []
    assert kinds(rows) == ["model_scope"]
    assert kinds(rows.where("row_id between 10 and 79")) == ["model_data_leak"]
    assert kinds(rows.limit(0)) == ["model_scope"]


def test_fold_issues(rows, spark):
    split = rows.select("row_id", "role")
    folds = spark.createDataFrame([(1, 1, "train"), (1, 71, "train"), (1, 2, "test"), (1, 1, "test"), (2, 3, "train"), (2, 4, "test"), (3, 900, "train")], "fold int, row_id long, role string")
    got = lambda kind: {(r.fold, r.type): r.n for r in scope.fold_issues(folds, split, kind).collect()}
    assert got("rset") == {(1, "test_in_analysis"): 1, (1, "non_train_in_analysis"): 1, (3, "non_train_in_analysis"): 1}
    assert got("control") == {(1, "test_in_fold"): 1} and got("tuning") == {(1, "tune_test_in_resamples"): 1} and got("vfold") == {(1, "cv_leak"): 1}
    assert got("resampling") == {(1, "cv_fold_overlap"): 1, (1, "test_in_cv_train"): 1}
    assert got("split") == {(1, "cv_leak"): 1, (1, "split_misalignment"): 2, (2, "split_misalignment"): 1}
    whole = scope.with_roles(rows.select("row_id", (F.col("row_id") % 5).cast("int").alias("fold")))
    assert {r.type for r in scope.resampling_risks(whole, split, "tuning")} == {"tune_test_in_resamples", "tune_on_full_data"}
    assert {r.type for r in scope.resampling_risks(whole, split)} == {"cv_leak", "cv_scope"}
    inner = scope.with_roles(rows.where("role = 'train'").select("row_id", (F.col("row_id") % 5).cast("int").alias("fold")))
    assert not scope.resampling_risks(inner, split) and not scope.resampling_risks(inner, split, "tuning")


def test_workflow_checks_every_fold(spark):
    data = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 6).alias("g"), F.col("id").cast("double").alias("t"))
    by_row = data.select("row_id", (F.col("row_id") % 4).cast("int").alias("fold"))
    assert {r.type for r in scope.workflow_risks(data, by_row, "t", "g")} == {"group_overlap", "temporal_leak"}
    by_group = data.select("row_id", F.col("g").cast("int").alias("fold"))
    assert not scope.workflow_risks(data, by_group, group="g")
    blocks = data.select(F.lit(1).alias("fold"), "row_id", F.when(F.col("t") < 30, "train").otherwise("test").alias("role"))
    assert not scope.workflow_risks(data, blocks, "t")
    both = blocks.unionByName(data.where("row_id = 3").select(F.lit(1).alias("fold"), "row_id", F.lit("test").alias("role")))
    assert [r.type for r in scope.workflow_risks(data, both)] == ["index_overlap"]
    done = api.workflow(data.withColumn("y", F.col("g") * 10 + F.col("t") / 100), "y", ["t"], api.Roles(group="g"), v=3)
    assert done.performance.count() == 3 and not [r for r in done.risks if r.type == "group_overlap"]


def test_models_and_pipelines(rows):
    ready = VectorAssembler(inputCols=["a"], outputCol="f").transform(rows)
    lr = LinearRegression(featuresCol="f", labelCol="y")
    assert not api.inspect(lr.fit(ready.where("role = 'train'")), ready)
    assert [r.type for r in api.inspect(lr.fit(ready), ready)] == ["model_scope"]
    late = StandardScaler(inputCol="f", outputCol="g")
    pipe = Pipeline(stages=[lr, late]).fit(ready.where("role = 'train'"))
    assert [r.type for r in api.inspect(pipe, ready)] == ["pipeline_postprocessing"]
    told = {r.stage: (r.leaks, r.risks) for r in api.inspect_pipeline(pipe, ready).collect()}
    assert told == {0: (False, []), 1: (False, ["pipeline_postprocessing"])}


def test_boosting(rows):
    ready = VectorAssembler(inputCols=["a"], outputCol="f").transform(rows).withColumns({"c": (F.col("y") > 3).cast("double"), "v": F.col("row_id") > 60})
    gbt = GBTClassifier(featuresCol="f", labelCol="c", maxIter=3, validationIndicatorCol="v").fit(ready)
    assert {r.type for r in api.inspect(gbt, ready)} >= {"hpo_test_usage", "early_stopping_check"}
    plain = GBTClassifier(featuresCol="f", labelCol="c", maxIter=2).fit(ready)
    assert not scope.inspect_boosting(plain, ready)
    assert [r.type for r in scope.boosting_rules(watched_test=True)] == ["hpo_test_usage"]


def test_predictions_of_a_leaky_model(rows):
    said = rows.where("role = 'test'").select("row_id", F.col("y").alias("actual"), F.col("a").alias("prediction"))
    hard = [leakage.Risk("model_scope", HARD, "")]
    split = rows.select("row_id", "role")
    assert [r.type for r in leakage.audit_predictions(said, split, model_risks=hard)] == ["model_leakage"]
    assert not leakage.audit_predictions(said, split)


def test_fixed_names():
    assert all(leakage.ROLLING_NAMES.search(n) for n in ("ema_5", "sma10", "ewm", "price_cummax", "CumMin_x"))
    assert "LOOCV" in guards.RANDOM_METHODS


def test_partition_checks_equal_those_of_every_fold(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 30)) if i % 9 else None, float(rng.integers(0, 50)) if i % 7 else None) for i in range(120)]
    data = spark.createDataFrame(rows, "row_id bigint, g int, t double")
    once = [(i, int(rng.integers(1, 6))) for i in range(120)]
    for extra in ([], [(3, 1), (3, 2), (4, 5), (4, 5)]):  # rows in several folds, and twice in one
        folds = spark.createDataFrame(sorted(set(once + extra)), "row_id bigint, fold int")
        want = {r.fold: r.asDict() for r in scope.fold_checks(data, scope.with_roles(folds), "t", "g").collect()}
        assert {r.fold: r.asDict() for r in scope.partition_checks(data, folds, "t", "g").collect()} == want
    single = spark.createDataFrame([(i, 1) for i in range(120)], "row_id bigint, fold int")
    (r,) = scope.partition_checks(data, single, "t", "g").collect()
    assert (r.n_train, r.n_test, r.n_overlap, r.n_groups, r.n_early) == (0, 120, 0, 0, 0)
