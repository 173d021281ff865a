import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.operators import integrity as I


def split(spark, train, test):
    return spark.createDataFrame([(i, "train") for i in train] + [(i, "test") for i in test], "row_id bigint, role string")


def test_split_rules(spark):
    data = spark.range(1, 101).select(F.col("id").alias("row_id"), (F.col("id") * 1.0).alias("t"), (F.col("id") % 10).alias("g"))
    I.validate_split(data, split(spark, range(1, 71), range(71, 101)), time="t")
    with pytest.raises(I.HardViolation, match="overlap in 11"):
        I.validate_split(data, split(spark, range(1, 61), range(50, 101)))
    with pytest.raises(I.HardViolation, match="groups"):
        I.validate_split(data, split(spark, range(1, 71), range(71, 101)), group="g")
    with pytest.raises(I.HardViolation, match="before"):
        I.validate_split(data, split(spark, range(50, 101), range(1, 50)), time="t")
    with pytest.raises(I.HardViolation, match="lacks"):
        I.validate_split(data, split(spark, [1], [101]))


def test_duplicates_numeric_string_and_null(spark):
    rows = [(i, float(x), 10.0 * x, "train" if i < 6 else "test") for i, x in enumerate([1, 2, 3, 4, 5, 1, 2, 3], 1)]
    data = spark.createDataFrame(rows, "row_id bigint, x double, y double, role string")
    assert sorted(r.row_id for r in I.duplicate_rows(data).collect()) == [6, 7, 8]
    words = spark.createDataFrame([(1, "a", None, "train"), (2, "b", "y", "train"), (3, "a", None, "test"), (4, "b", "z", "test")], "row_id bigint, name string, cat string, role string")
    assert [r.row_id for r in I.duplicate_rows(words).collect()] == [3]


def test_temporal_order_is_strict(spark):
    data = spark.createDataFrame([(i, float(i), "train" if i <= 5 else "test") for i in range(1, 11)], "row_id bigint, t double, role string")
    late, last = I.temporal_order(data, "t")
    assert late.count() == 0 and last == 5


def test_correlation_leaks(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=100)
    rows = [(i, float(a), float(a + 0.001 * b), float(b), None, 1.0, "train") for i, (a, b) in enumerate(zip(y, rng.normal(size=100)))]
    data = spark.createDataFrame(rows, "row_id bigint, y double, leak double, clean double, empty double, flat double, role string")
    got = I.correlation_leaks(data, "y", ["leak", "clean", "empty", "flat"]).collect()
    assert [(r.feature, r.type) for r in got] == [("leak", "target_leakage_direct")]
    assert {r.feature: r.r for r in I.correlations(data, "y", ["empty", "flat"]).collect()} == {"empty": None, "flat": None}


def test_radius_join_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.random((80, 2)) * 4 - 2
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "row_id bigint, x double, y double")
    got = {(r.a, r.b) for r in I.within_radius(df, df, 0.4).collect()}
    want = {(i, j) for i in range(80) for j in range(80) if np.hypot(*(p[i] - p[j])) <= 0.4}
    assert got == want


def test_hull_and_overlap(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0), (2.0, 0.0)]
    rows = [(i, x, y, "train") for i, (x, y) in enumerate(square)] + [(10, 1.0, 1.0, "test"), (11, 5.0, 5.0, "test")]
    data = spark.createDataFrame(rows, "row_id bigint, x double, y double, role string")
    assert sorted(I.convex_hull(data.where("role = 'train'"))) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    assert I.spatial_overlap(data) == 0.5
    assert [r.row_id for r in I.spatial_proximity(data, share=0.01).collect()] == []
