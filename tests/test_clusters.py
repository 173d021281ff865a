import numpy as np
import pyspark.ml.clustering as ml
import pytest
from pyspark.sql import functions as F

from trustfold.operators import clusters
from trustfold.operators import folds as O


@pytest.mark.parametrize("d", [1, 2, 3, 5])
def test_nearest_centres_are_those_of_all_pairs(d):
    rng = np.random.default_rng(d)
    for x, c in ((rng.normal(size=(3000, d)), rng.normal(size=(700, d))), (rng.integers(0, 4, (500, d)) * 1.0, rng.integers(0, 4, (300, d)) * 1.0), (np.ones((90, d)), np.ones((40, d))), (rng.normal(size=(5, d)) * 1e9, np.zeros((1, d)))):
        got, taken = clusters.nearest_centres(x, c)
        every = sum((x[:, None, j] - c[None, :, j]) ** 2 for j in range(d))
        assert (got == every.argmin(axis=1)).all()
        assert len(x) != 3000 or d > 3 or taken < every.size / 3
    assert clusters.nearest_centres(np.empty((0, d)), np.ones((2, d)))[0].size == 0


def test_many_clusters_without_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(1200)] + [(2000 + i, 3.0, 3.0) for i in range(200)] + [(3000, None, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double").repartition(3).cache()
    spread = lambda got: got.where("__cluster is not null").groupBy("__cluster").agg((F.var_pop("a") * F.count("*") + F.var_pop("b") * F.count("*")).alias("s")).agg(F.count("*").alias("k"), F.sum("s").alias("s")).first()
    theirs = spread(O._clusters(df, ["a", "b"], 70, 42))
    monkeypatch.setattr(O, "FEW_CLUSTERS", 16)

    def refused(*_):
        raise AssertionError("every row against every centre")

    monkeypatch.setattr(ml.KMeans, "_fit", refused)
    got = O._clusters(df, ["a", "b"], 70, 42).cache()
    ours = spread(got)
    assert ours.k == theirs.k == 70 and ours.s < 1.1 * theirs.s
    assert got.count() == len(rows) and got.where("__cluster is null").count() == 1
    assert got.where("a = 3 and b = 3").select("__cluster").distinct().count() == 1
    folds = O.environmental_blocks(df, ["a", "b"])
    assert {r.fold for r in folds.select("fold").distinct().collect()} == {1, 2, 3, 4, 5} and folds.count() == len(rows)


def test_fewer_places_than_clusters(spark):
    df = spark.createDataFrame([(f"r{i}", float(i % 7), 0.0) for i in range(60)], "row_id string, x double, y double")
    got = clusters.k_means(df, ["x", "y"], 20)
    per = got.join(df, "row_id").groupBy("__cluster").agg(F.count_distinct("x").alias("places"), F.count("*").alias("n")).collect()
    assert len(per) == 7 and all(r.places == 1 for r in per) and sum(r.n for r in per) == 60
    assert clusters.k_means(df.where("x < 0"), ["x", "y"], 3).count() == 0
