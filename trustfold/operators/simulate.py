"""Data of known structure for tests and teaching. Sizes are small, except for independent rows, which are made on the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def independent(spark: SparkSession, n: int, p: int = 5, noise: float = 1.0, seed: int = 42) -> DataFrame:
    rows = spark.range(n).select((F.col("id") + 1).alias("row_id"), *[F.randn(seed + i).alias(f"x{i + 1}") for i in range(p)])
    return rows.withColumn("y", sum((F.col(f"x{i + 1}") / (i + 1) for i in range(p)), F.lit(0.0)) + noise * F.randn(seed + p))


def _frame(spark: SparkSession, columns: dict) -> DataFrame:
    import pandas as pd

    n = len(next(iter(columns.values())))
    return spark.createDataFrame(pd.DataFrame({"row_id": np.arange(1, n + 1), **columns}))


def spatial(spark: SparkSession, n: int = 300, p: int = 5, reach: float = 0.25, noise: float = 0.3, seed: int = 42) -> DataFrame:
    """A Gaussian field with exponential covariance on the unit square (at most 3000 rows); the target is ``response``."""
    if n > 3000:
        raise ValueError("at most 3000 rows")
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    root = np.linalg.cholesky(np.exp(-d / reach) + 1e-8 * np.eye(n))
    x = root @ rng.normal(size=(n, p))
    field = root @ rng.normal(size=n)
    y = x @ (1 / np.arange(1, p + 1)) + field + noise * rng.normal(size=n)
    return _frame(spark, {"x": xy[:, 0], "y": xy[:, 1], **{f"x{i + 1}": x[:, i] for i in range(p)}, "response": y})


def temporal(spark: SparkSession, n: int = 300, p: int = 5, phi: float = 0.8, noise: float = 0.3, seed: int = 42) -> DataFrame:
    """AR(1) features and errors by day."""
    rng = np.random.default_rng(seed)

    def series() -> np.ndarray:
        e, out = rng.normal(size=n), np.zeros(n)
        for i in range(n):
            out[i] = (phi * out[i - 1] if i else 0.0) + e[i]
        return out

    x = np.stack([series() for _ in range(p)], axis=1)
    y = x @ (1 / np.arange(1, p + 1)) + noise * series()
    got = _frame(spark, {"day": np.arange(n), **{f"x{i + 1}": x[:, i] for i in range(p)}, "y": y})
    return got.withColumn("time", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day").cast("int"))).drop("day")


def target_leak(spark: SparkSession, n: int = 300, p: int = 5, seed: int = 42) -> DataFrame:
    return independent(spark, n, p, seed=seed).withColumn("leaked_feature", F.col("y") + 0.01 * F.randn(seed + 99))


def preprocessing_leak(spark: SparkSession, n: int = 300, p: int = 5, seed: int = 42) -> DataFrame:
    """Features standardised over all rows, with a shift in the last third."""
    rows = independent(spark, n, p, seed=seed)
    rows = rows.withColumns({f"x{i + 1}": F.col(f"x{i + 1}") + F.when(F.col("row_id") > 2 * n / 3, 3.0).otherwise(0.0) for i in range(p)})
    s = rows.agg(*[f(f"x{i + 1}").alias(f"{k}{i}") for i in range(p) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return rows.withColumns({f"x{i + 1}": (F.col(f"x{i + 1}") - s[f"m{i}"]) / s[f"s{i}"] for i in range(p)})


def combined(spark: SparkSession, n: int = 300, p: int = 5, seed: int = 42) -> DataFrame:
    return spatial(spark, n, p, seed=seed).withColumn("leaked_feature", F.col("response") + 0.01 * F.randn(seed + 99))
