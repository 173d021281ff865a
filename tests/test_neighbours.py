import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.operators import evaluation as E
from trustfold.operators import neighbours


def brute(rows, k):
    far = lambda x, y: float(np.sqrt(x * x + y * y))
    return {i: sorted((far(x - a, y - b), j) for j, a, b, _ in rows if j != i)[:k] for i, x, y, _ in rows}


def clouds(kind, n=700, seed=5):
    rng = np.random.default_rng(seed)
    if kind == "uniform":
        xy = rng.random((n, 2)) * 100
    elif kind == "grid":  # many ties
        xy = np.stack(np.divmod(np.arange(n), 27), axis=1).astype(float)
    elif kind == "clusters":  # a tight one far from a wide one, and outliers
        xy = np.concatenate([rng.normal(size=(n // 2, 2)) * 1e-6, 50 + rng.normal(size=(n - n // 2 - 5, 2)), rng.random((5, 2)) * 1e4])
    else:  # a third of all rows at one place
        xy = np.concatenate([np.full((n // 3, 2), 3.0), rng.integers(0, 12, (n - n // 3, 2)).astype(float)])
    return [(int(i), float(a), float(b), float(v)) for i, (a, b), v in zip(rng.permutation(n), xy, rng.normal(size=n))]


@pytest.mark.parametrize("kind", ["uniform", "grid", "clusters", "copies"])
@pytest.mark.parametrize("k", [1, 8])
def test_equals_brute_force(spark, monkeypatch, kind, k):
    monkeypatch.setattr(neighbours, "TILE", 16)
    rows = clouds(kind)
    got = neighbours.k_nearest(spark.createDataFrame(rows, "row_id long, x double, y double, v double").repartition(5), k, value="v").collect()
    want, value = brute(rows, k), {i: v for i, _, _, v in rows}
    assert len(got) == len(rows)
    for r in got:
        assert [(n.d, n.id) for n in r.near] == want[r.row_id]
        assert all(n.v == value[n.id] for n in r.near)


def test_few_rows_null_rows_and_none(spark):
    ddl = "row_id long, x double, y double, v double"
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, None, 0.0, 1.0), (3, float("nan"), 0.0, 1.0)], ddl)
    assert [(r.row_id, r.near) for r in neighbours.k_nearest(one, 3).collect()] == [(1, [])]
    three = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, -0.0, 2.0), (3, 1.0, 0.0, 3.0)], ddl)
    got = {r.row_id: [(n.d, n.id, n.v) for n in r.near] for r in neighbours.k_nearest(three, 5, value="v").collect()}
    assert got == {1: [(0.0, 2, 2.0), (1.0, 3, 3.0)], 2: [(0.0, 1, 1.0), (1.0, 3, 3.0)], 3: [(1.0, 1, 1.0), (1.0, 2, 2.0)]}
    assert neighbours.k_nearest(one.where("false"), 3).count() == 0


def test_local_moran_against_brute_force(spark):
    rows = clouds("uniform", 300)
    df = spark.createDataFrame(rows, "row_id long, x double, y double, v double")
    got = {r.row_id: r for r in E.local_moran(df, k=5, permutations=49).collect()}
    near, value = brute(rows, 5), {i: v for i, _, _, v in rows}
    mean, sd = np.mean(list(value.values())), np.std(list(value.values()))
    z = {i: (v - mean) / sd for i, v in value.items()}
    rng = np.random.default_rng(1)
    for i in value:
        lag = np.mean([z[j] for _, j in near[i]])
        assert abs(got[i].local_i - z[i] * lag) < 1e-9
        others = np.array([v for j, v in z.items() if j != i])
        null = np.abs(z[i] * np.array([rng.choice(others, 5, replace=False).mean() for _ in range(400)]))
        p = (np.sum(null >= abs(z[i] * lag)) + 1) / 401
        assert abs(got[i].p - p) < 0.35  # two independent samples of the same null
        if got[i].p <= 0.05:
            assert got[i].label == ("high-" if z[i] > 0 else "low-") + ("high" if (z[i] > 0) == (got[i].local_i > 0) else "low")
        else:
            assert got[i].label == "none"
    gap = np.mean([got[i].p for i in value]) - 0.5
    assert abs(gap) < 0.1  # values have no pattern


def test_more_rows_than_the_old_limit(spark):
    df = spark.range(30_000).select(F.col("id").alias("row_id"), F.rand(1).alias("x"), F.rand(2).alias("y")).withColumn("v", F.sin(F.col("x") * 6) + F.cos(F.col("y") * 6))
    got = E.local_moran(df)
    assert got.count() == 30_000
    n = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert n["high-high"] > 3000 and n["low-low"] > 3000
