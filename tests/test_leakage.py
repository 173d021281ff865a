import numpy as np
import pytest
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from trustfold.operators import leakage as L
from trustfold.operators import report, text_rules
from trustfold.operators.integrity import HardViolation


def make(spark, **columns):
    n = len(next(iter(columns.values())))
    names = list(columns)
    rows = [(i + 1, *[columns[c][i] if columns[c][i] is None or isinstance(columns[c][i], str) else float(columns[c][i]) for c in names]) for i in range(n)]
    kinds = ["string" if any(isinstance(v, str) for v in columns[c]) else "double" for c in names]
    data = spark.createDataFrame(rows, "row_id bigint, " + ", ".join(f"{c} {k}" for c, k in zip(names, kinds)))
    split = data.select("row_id", F.when(F.col("row_id") <= 0.7 * n, "train").otherwise("test").alias("role"))
    return data, split


def types(risks):
    return {r.type for r in risks}


def test_leaks_and_clean_twin(spark):
    rng = np.random.default_rng(1)
    y, x = rng.normal(size=100), rng.normal(size=100)
    data, split = make(spark, y=y, x=x, leak=y + 0.001 * rng.normal(size=100), future_y=x * 2)
    got = types(L.validate(L.Workflow(data, split, target="y")))
    assert {"target_leakage_direct", "target_leakage_naming"} <= got
    clean, split = make(spark, y=y, x=x)
    assert types(L.validate(L.Workflow(clean, split, target="y"))) == set()
    with pytest.raises(HardViolation):
        L.validate(L.Workflow(data, split, target="y"), strict=True)


def test_categories_groups_and_standardising(spark):
    rng = np.random.default_rng(2)
    k = rng.permutation(100) % 10
    y = 10.0 * k + 0.001 * rng.normal(size=100)
    data, split = make(spark, y=y, cat=[f"c{i}" for i in k], other=[f"o{i % 3}" for i in range(100)])
    assert [r.source for r in L.validate(L.Workflow(data, split, target="y")) if r.type == "target_leakage_categorical"] == ["cat"]
    g = [f"g{i}" for i in k]
    y2 = 10.0 * k + 0.5 * rng.normal(size=100)
    mean = {i: y2[:70][k[:70] == i].mean() for i in set(k[:70].tolist())}
    data, split = make(spark, y=y2, enc=[mean.get(int(i), 0.0) for i in k], g=g)
    assert "target_leakage_group_mean" in types(L.validate(L.Workflow(data, split, target="y", group="g")))
    v = np.concatenate([rng.normal(50, 10, 70), rng.normal(70, 10, 30)])
    data, split = make(spark, y=rng.normal(size=100), bad=(v - v.mean()) / v.std(ddof=1))
    assert "feature_engineering_leak" in types(L.validate(L.Workflow(data, split, target="y")))


def test_time_rules(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=100).cumsum()
    lagged = [None, None, *y[:-2]]
    roll = [None] * 4 + [float(np.mean(y[i - 4 : i + 1])) for i in range(4, 100)]
    data, split = make(spark, y=y, t=np.arange(100), two_back=lagged, rolling_mean=roll)
    got = L.validate(L.Workflow(data, split, target="y", time="t"))
    assert {"feature_engineering_lag", "rolling_feature_leak"} <= types(got)
    mixed = data.select("row_id", F.when(F.col("row_id") % 2 == 0, "test").otherwise("train").alias("role"))
    assert "temporal_leak" in types(L.validate(L.Workflow(data, mixed, target="y", time="t")))


def test_spatial_rules(spark):
    rng = np.random.default_rng(4)
    x, y = rng.random(100) * 10, rng.random(100) * 10
    x[70:75], y[70:75] = x[:5], y[:5]
    data, split = make(spark, v=rng.normal(size=100), lon=x, lat=y, block=[f"b{i % 9}" for i in range(100)])
    got = types(L.validate(L.Workflow(data, split, coords=("lon", "lat"), block="block", buffer=0.2)))
    assert {"spatial_duplicate", "spatial_block_leak", "spatial_buffer_violation", "spatial_proximity", "spatial_overlap"} <= got


def test_spatial_rules_beyond_one_block_of_training_rows(spark):
    rng = np.random.default_rng(5)
    n = 5400
    x, y = rng.random(n) * 100, rng.random(n) * 100
    x[5100:5104], y[5100:5104] = x[:4], y[:4]
    x[5104:5107], y[5104:5107] = x[5050:5053], y[5050:5053]  # training rows of the second block
    rows = spark.createDataFrame([(i, float(x[i]), float(y[i]), "train" if i < 5100 else "test") for i in range(n)], "row_id long, lon double, lat double, role string")
    got = {r.type: r for r in L.spatial_rules(rows, "lon", "lat")}
    assert got["spatial_duplicate"].n_affected == 7
    moved = rows.withColumn("lon", F.when(F.col("role") == "test", F.col("lon") + 500).otherwise(F.col("lon")))
    assert L.spatial_rules(moved, "lon", "lat") == []
    two = spark.createDataFrame([(0, 0.0, 0.0, "train"), (1, 1.0, 0.0, "train"), (2, 1.0, 0.0, "test")], rows.schema)
    assert "spatial_duplicate" in types(L.spatial_rules(two, "lon", "lat"))


def test_metadata_rules_and_assimilation(spark):
    rng = np.random.default_rng(5)
    data, split = make(spark, y=rng.normal(size=100), a=np.arange(100), b=rng.normal(size=100))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(data)
    leaky = StandardScaler(inputCol="f", outputCol="g", withMean=True).fit(data)
    w = L.Workflow(data, split, target="y", preprocess=[leaky], thresholds={"optimized_on": "test"}, hpo={"cv_type": "simple", "n_configurations": 500, "model_selected_on": "full"})
    got = types(L.validate(w))
    assert {"preprocessing_leak", "threshold_leak", "hpo_cv_bias", "hpo_overfit_risk", "hpo_selection_leak"} <= got
    better, fixed, left = L.assimilate(w)
    assert {r.type for r in fixed} == {"preprocessing_leak", "threshold_leak"}
    assert not {"preprocessing_leak", "threshold_leak"} & types(L.validate(better))
    assert L.risk_rows(spark, left).count() == len(left)


def test_audits(spark):
    _, split = make(spark, y=np.arange(100))
    rows = [(i, float(i), float(i)) for i in range(71, 101)]
    df = spark.createDataFrame(rows, "row_id bigint, actual double, prediction double")
    assert {"perfect_prediction", "exact_predictions"} <= types(L.audit_predictions(df, split))
    wrong = spark.createDataFrame([(i, float(i), float(-i) * (i % 3)) for i in range(1, 101)], "row_id bigint, actual double, prediction double")
    assert {"full_data_prediction", "wrong_prediction_set"} <= types(L.audit_predictions(wrong, split))
    assert {"importance_on_full_data", "negative_importance"} <= types(L.audit_importance({"a": 1.0, "b": -0.1}, 100, 70))


def test_text_rules_and_report(spark):
    texts = [(1, "Random 10-fold cross-validation on spatial data with latitude."), (2, "All data were normalized."), (3, None), (4, "Spatial block CV of raster sites, random k-fold not used.")]
    got = text_rules.check_texts(spark.createDataFrame(texts, "id int, text string"), "id").collect()
    assert {(r.id, r.pattern) for r in got} == {(1, "random_cv_spatial"), (2, "global_preprocessing")}
    from trustfold.operators.diagnosis import Diagnosis

    cert = report.certificate(Diagnosis("none", "none", "random", 10), [L.Risk("index_overlap", L.HARD, "x", 3)])
    assert cert["valid"] is False and "3 rows" in report.explain([L.Risk("index_overlap", L.HARD, "x", 3)])[0]
    assert "dependency: \"none\"" in report.to_yaml(cert) and "<table>" in report.to_html(cert)


def test_export(tmp_path):
    from trustfold.operators.diagnosis import Diagnosis

    cert = report.certificate(Diagnosis("none", "none", "random", 10))
    for end in ("json", "yaml", "html"):
        report.export(cert, str(tmp_path / f"c.{end}"))
        assert (tmp_path / f"c.{end}").stat().st_size > 50
    with pytest.raises(ValueError):
        report.export(cert, str(tmp_path / "c.txt"))


def test_every_fitted_stage_is_compared_with_its_training_fit(spark):
    from pyspark.ml import feature as P

    rows = spark.range(120).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 80, "train").otherwise("test").alias("role"), (F.col("id") % 2).cast("double").alias("y"),
        (F.col("id") * 1.0).alias("a"), (F.col("id") % 7 * 1.0).alias("b"), F.when(F.col("id") >= 100, "late").otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("c"),
        (F.col("id") % 4).cast("double").alias("k"), F.split(F.concat_ws(" ", F.lit("w"), F.when(F.col("id") >= 90, "new")), " ").alias("words"),
    )
    rows = P.VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(rows).withColumn("late_y", F.when(F.col("role") == "test", 5.0).otherwise(F.col("y")))
    train = rows.where("role = 'train'")
    makers = [
        P.StandardScaler(withMean=True, inputCol="v", outputCol="o"), P.MinMaxScaler(inputCol="v", outputCol="o"), P.MaxAbsScaler(inputCol="v", outputCol="o"), P.RobustScaler(inputCol="v", outputCol="o"),
        P.Imputer(inputCols=["a", "b"], outputCols=["a1", "b1"]), P.IDF(inputCol="v", outputCol="o"),
        P.StringIndexer(inputCol="c", outputCol="o"), P.CountVectorizer(inputCol="words", outputCol="o"), P.TargetEncoder(inputCol="k", outputCol="o", labelCol="late_y", targetType="continuous"),
    ]
    for maker in makers:
        name = type(maker).__name__
        kind = "encoding_leak" if name in ("StringIndexer", "CountVectorizer", "TargetEncoder") else "preprocessing_leak"
        assert [(r.type, r.severity, r.n_affected) for r in L.inspect_stage(maker.fit(rows), rows)] == [(kind, L.HARD, 40)], name
        assert L.inspect_stage(maker.fit(train), rows) == [], name
        assert L.inspect_stage(maker.fit(train), rows.select("row_id", "role")) == [], name
    split = rows.select("row_id", "role")
    w = L.Workflow(rows.drop("role"), split, target="y", preprocess=[makers[6].fit(rows), makers[1].fit(rows)])
    better, fixed, _ = L.assimilate(w)
    assert {"encoding_leak", "preprocessing_leak"} == types(fixed) and not {"encoding_leak", "preprocessing_leak"} & types(L.validate(better))
