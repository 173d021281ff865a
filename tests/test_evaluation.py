import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.functions import metrics as M
from trustfold.operators import applicability as A
from trustfold.operators import evaluation as E
from trustfold.operators import simulate
from trustfold.sources import grid as G


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 200))
    rows = [(i, float(rng.random() * 100), float(rng.random() * 100), float(p), float(q), float(2 * p - q + 0.5 * rng.normal())) for i, (p, q) in enumerate(zip(a, b))]
    data = spark.createDataFrame(rows, "row_id bigint, x double, y double, a double, b double, z double").withColumn("noise", F.randn(3)).cache()
    return data, data.select("row_id", (F.col("row_id") % 5 + 1).cast("int").alias("fold"))


def test_held_out_linear_is_least_squares(linear):
    data, folds = linear
    got = {r.row_id: r.prediction for r in E.held_out(data, folds, E.Linear("z", ["a", "b"])).collect()}
    rows = data.collect()
    m = np.array([[1, r.a, r.b] for r in rows])
    z, f = np.array([r.z for r in rows]), np.array([r.row_id % 5 for r in rows])
    for k in range(5):
        beta = np.linalg.lstsq(m[f != k], z[f != k], rcond=None)[0]
        for r, p in zip(np.array([r.row_id for r in rows])[f == k], m[f == k] @ beta):
            assert got[int(r)] == pytest.approx(p, abs=1e-6)


def test_selection_and_comparison(linear):
    data, folds = linear
    path = E.forward_selection(data, folds, "z", ["a", "b", "noise"])
    assert path[0][0] == ["a"] and set(path[1][0]) == {"a", "b"}
    assert set(E.best_subset(data, folds, "z", ["a", "b", "noise"])[0]) >= {"a", "b"}
    ranked = E.compare_models(data, folds, {"good": E.Linear("z", ["a", "b"]), "bad": E.Linear("z", ["noise"])}, "z").orderBy("rank").collect()
    assert [r.model for r in ranked] == ["good", "bad"]
    both = E.compare_cv(data, [folds, folds.withColumn("fold", F.col("fold") % 5 + 1)], [folds, folds], E.Linear("z", ["a", "b"]), "z")
    assert both["inflation"] == pytest.approx(0, abs=1e-9)
    nt = E.null_test(data, folds, "z", ["a", "b"], n_null=9)
    assert nt["p"] == pytest.approx(0.1) and nt["z"] < -2


def test_intervals_maps_and_importance(linear):
    data, folds = linear
    model = E.Linear("z", ["a", "b"])
    held = E.held_out(data, folds, model).withColumn("residual", F.col("z") - F.col("prediction"))
    inside = E.conformal(held, held).agg(F.avg(F.col("z").between(F.col("lower"), F.col("upper")).cast("double"))).first()[0]
    assert 0.88 <= inside <= 0.95
    ci = E.bootstrap(held.withColumn("block", F.col("row_id") % 20), "z", "block")
    assert ci["lower"] < ci["rmse"] < ci["upper"]
    assert E.ensemble(data, folds, model, data).agg(F.max("sd")).first()[0] < 0.5
    assert E.stability_map(data, folds, model, data).agg(F.min("n_models")).first()[0] == 5
    imp = E.importance(data.withColumn("block", F.lit(1)), model(data), "z", ["a", "noise"], "block", n_rep=3).collect()
    assert imp[0].feature == "a" and imp[0].importance > 0.5 and abs(imp[1].importance) < 0.05
    beta = model.solve(model.matrix(model.products(data).first()))
    shap = E.marginal_contributions(model, beta, data.withColumn("block", F.col("row_id") % 4), "block")
    assert shap.count() == 400 and abs(shap.groupBy("feature").agg(F.avg("contribution").alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 0.05
    assert E.stability([1.0, 1.01, 0.99])["verdict"] == "stable"


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.2), (1, 0.9), (0, 0.1), (None, 0.5), (1, None)], "y int, s double")
    assert M.auc(df, "y", "s").first()[0] == pytest.approx(3.5 / 4)
    assert M.auc(df.where("y = 1"), "y", "s").first()[0] == 0.5
    got = df.agg(*[c.alias(n) for n, c in M.classification(F.col("y"), F.col("s")).items()]).first()
    assert (got.accuracy, got.sensitivity, got.specificity, got.kappa) == (0.75, 0.5, 1.0, 0.5)
    flat = spark.createDataFrame([(1.0, 1.5), (1.0, 2.0)], "a double, p double").agg(*[c.alias(n) for n, c in M.regression(F.col("a"), F.col("p")).items()]).first()
    assert flat.rsq is None and flat.mae == 0.75


def test_calibration_recovers_good_and_bad(spark):
    rng = np.random.default_rng(1)
    p = rng.random(4000)
    rows = [(float(a), int(rng.random() < a), int(rng.random() < 0.5)) for a in p]
    df = spark.createDataFrame(rows, "p double, good int, bad int")
    good, bad = E.calibration(df, "good", "p").first(), E.calibration(df, "bad", "p").first()
    assert good.ece < 0.05 and bad.ece > good.ece + 0.1 and 0.7 < good.slope < 1.3
    assert E.calibration_bins(df, "good", "p", quantile=True).count() == 10
    sure = spark.createDataFrame([(float(x), 0.0, 1.0) for x in rng.normal(size=3000)], "y double, m double, s double")
    assert all(abs(r.level - r.coverage) < 0.04 for r in E.regression_calibration(sure, "y", "m", "s").collect())


def test_applicability(spark):
    rng = np.random.default_rng(2)
    make = lambda m, n, o: spark.createDataFrame([(o + i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(m, 1, (n, 2)))], "row_id bigint, a double, b double")
    train, inside, far = make(0, 120, 0), make(0, 80, 1000), make(8, 80, 2000)
    aoa = {r.row_id: r.aoa for r in A.area_of_applicability(train, inside.unionAll(far), ["a", "b"]).collect()}
    assert np.mean([v for k, v in aoa.items() if k < 2000]) > 0.6 and np.mean([v for k, v in aoa.items() if k >= 2000]) < 0.1
    assert A.novelty(train, far, ["a"]).where("mess < 0").count() > 70
    assert {r.feature: r.shifted for r in A.drift(train, inside.withColumn("a", F.col("a") + 2), ["a", "b"]).collect()} == {"a": True, "b": False}
    assert A.adversarial(train, far, ["a", "b"])["verdict"] == "different"
    assert A.sample_design(train, inside.unionAll(far), ["a", "b"], 5).agg(F.min("row_id")).first()[0] >= 2000
    assert A.out_of_range(train, far, ["a", "b"]).where("n_outside = 2").count() > 70
    assert A.mahalanobis(train, far, ["a", "b"]).agg(F.min("mahalanobis")).first()[0] > 20


def test_blocks_of_training_rows_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))], "row_id bigint, a double, b double")
    whole = {r.row_id: r.di for r in A.dissimilarity(df, None, ["a", "b"]).collect()}
    monkeypatch.setattr(A, "BLOCK_ROWS", 16)
    parts = {r.row_id: r.di for r in A.dissimilarity(df, None, ["a", "b"]).collect()}
    assert whole.keys() == parts.keys() and all(whole[k] == pytest.approx(parts[k]) for k in whole)


def test_debias_local_moran_and_grid(spark):
    rng = np.random.default_rng(4)
    xy = rng.random((400, 2)) * 10
    rows = [(i, float(a), float(b), float(np.sin(a / 3) + b / 5 + 0.1 * rng.normal()), float(rng.normal())) for i, (a, b) in enumerate(xy)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, smooth double, rough double")
    share = {r.predictor: r.r2 for r in A.debias(df, "x", "y", ["smooth", "rough"])[1].collect()}
    assert share["smooth"] > 0.6 and share["rough"] < 0.2
    hot = df.limit(150).withColumn("v", F.when((F.col("x") > 7) & (F.col("y") > 7), 5.0).when((F.col("x") < 3) & (F.col("y") < 3), -5.0).otherwise(0.0) + 0.3 * F.randn(1))
    got = E.local_moran(hot.select("row_id", "x", "y", "v")).join(hot, "row_id")
    corner = got.where("x > 7.5 and y > 7.5").agg(F.avg((F.col("label") == "high-high").cast("double"))).first()[0]
    assert corner is None or corner > 0.75
    cells = spark.range(100).select((F.col("id") % 10).alias("col"), F.floor(F.col("id") / 10).alias("row"), F.col("id").cast("double").alias("band"))
    g = G.Grid(cells, 0.0, 0.0, 1.0)
    at = G.extract(g, df)
    assert at.where("band <> floor(x) + 10 * floor(y)").count() == 0 and at.count() == 400


def test_simulations(spark):
    assert simulate.target_leak(spark, 100).stat.corr("leaked_feature", "y") > 0.99
    s = simulate.preprocessing_leak(spark, 120).agg(F.avg("x1"), F.stddev_samp("x1")).first()
    assert abs(s[0]) < 1e-9 and abs(s[1] - 1) < 1e-9
    assert "leaked_feature" in simulate.combined(spark, 50).columns


def test_thin_plate_trend(spark):
    rng = np.random.default_rng(4)
    xy = rng.random((300, 2)) * 10
    rows = [(i, float(a), float(b), float(np.sin(a) + np.cos(b)), float(rng.normal()), None if i % 3 else 1.0) for i, (a, b) in enumerate(xy)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, smooth double, rough double, gaps double")
    s = (xy - xy.mean(0)) / (xy.std(0, ddof=1) + 1e-10)
    knots = [(-1.0, -1.0), (1.0, 1.0), (0.5, -1.0), (-1.0, 1.0), (0.0, 0.0)]
    r2 = np.stack([((s - k) ** 2).sum(1) for k in knots], axis=1)
    basis = np.column_stack([np.ones(300), s, r2 * np.log(r2) / 2])
    out, told = A.debias_thin_plate(df, "x", "y", ["smooth", "rough"], knots=knots)
    got = {r.row_id: r for r in out.collect()}
    for p, values in (("smooth", [r[3] for r in rows]), ("rough", [r[4] for r in rows])):
        v = np.array(values)
        left = v - basis @ np.linalg.lstsq(basis, v, rcond=None)[0]
        assert np.allclose([got[i][p] for i in range(300)], left, atol=1e-6)
        assert abs({r.predictor: r.r2 for r in told.collect()}[p] - (1 - left.var() / v.var())) < 1e-8
    stiff = A.debias_thin_plate(df, "x", "y", ["smooth"], knots=knots, penalty=1e6)[1].first().r2
    plane = basis[:, :3]
    v = np.array([r[3] for r in rows])
    assert abs(stiff - (1 - (v - plane @ np.linalg.lstsq(plane, v, rcond=None)[0]).var() / v.var())) < 1e-3
    share = {r.predictor: r for r in A.debias_thin_plate(df, "x", "y", ["smooth", "gaps"], n_knots=15)[1].collect()}
    assert share["smooth"].r2 > 0.5 and share["gaps"].r2 == 0


def test_coefficients_of_large_features_are_exact():
    from fractions import Fraction

    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(1e3, 5e5, 500), 2)
    t = p / 1e5 + rng.integers(0, 7, 500)
    model = E.Linear("t", ["p"], ridge=0.0)
    m = np.array([[500, p.sum(), t.sum()], [p.sum(), p @ p, p @ t], [t.sum(), p @ t, t @ t]]) * 18000
    n, s, y, ss, sy = (Fraction(float(m[i])) for i in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2)))
    slope = (n * sy - s * y) / (n * ss - s * s)
    a, b = model.solve(m)
    assert abs(a - float((y - slope * s) / n)) < 1e-12 and abs(b - float(slope)) * 1e5 < 1e-12


def test_rows_are_spread_over_more_tasks_as_they_grow(spark):
    from trustfold.functions import common

    one, two = common.spread_rows(40 * common.TASK_ROWS + 1, spark.range(50).withColumnRenamed("id", "row_id"), spark.range(50).selectExpr("id as row_id", "id % 2 as fold"))
    assert one.rdd.getNumPartitions() == two.rdd.getNumPartitions() == 41
    joined = one.join(two.hint("merge"), "row_id").groupBy("row_id").count()
    assert joined.count() == 50 and joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
