"""Data behind plots, as DataFrames: what to draw, not how."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roles(data: DataFrame, split: DataFrame) -> DataFrame:
    """row_id and train, test, overlap or excluded."""
    by = split.groupBy("row_id").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"))
    name = F.when((F.col("a") > 0) & (F.col("b") > 0), "overlap").when(F.col("a") > 0, "train").when(F.col("b") > 0, "test").otherwise("excluded")
    return data.select("row_id").join(by, "row_id", "left").select("row_id", name.alias("role"))


def group_membership(rows: DataFrame, group: str) -> DataFrame:
    """group and train, test or leak."""
    a, b = F.count_if(F.col("role") == "train"), F.count_if(F.col("role") == "test")
    return rows.groupBy(group).agg(F.when((a > 0) & (b > 0), "leak").when(a > 0, "train").otherwise("test").alias("membership"), F.count("*").alias("n"))


def fold_sizes(folds: DataFrame) -> DataFrame:
    keys = ["fold", "role"] if "role" in folds.columns else ["fold"]
    return folds.groupBy(*keys).agg(F.count("*").alias("n"))


def split_on_time(rows: DataFrame, time: str, bins: int = 50) -> DataFrame:
    """bin, role, n over equal widths of time."""
    from ..functions.common import epoch
    from .folds import right_closed_bin

    t = epoch(F.col(time), dict(rows.dtypes)[time])
    low, high = rows.agg(F.min(t), F.max(t)).first()
    return rows.groupBy(right_closed_bin(t, low, high, bins).alias("bin"), "role").agg(F.count("*").alias("n"))


def geojson(rows: DataFrame, x: str, y: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def risk_counts(risks: DataFrame) -> DataFrame:
    return risks.groupBy("severity", "type").agg(F.count("*").alias("n"), F.sum("n_affected").alias("n_affected"))
