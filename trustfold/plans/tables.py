"""The driver's tables in the roles that the queries give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, cust, price, day, structured (price plus a customer effect), role: every fourth order is a test row."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("day"),
        (F.col("o_totalprice") / 1e5 + F.col("o_custkey") % 7).alias("structured"),
        F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("role"),
    )


ORDERS = """orders_r AS (SELECT o_orderkey row_id, o_custkey cust, o_totalprice price, o_orderdate AS day, o_totalprice/1e5 + o_custkey % 7 structured,
  CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS role FROM orders)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, x, y, v (a trend and a third component), w (third component), e4, label of the embeddings, in double precision."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), e(0).alias("x"), e(1).alias("y"), (e(0) + e(1) + 0.5 * e(2)).alias("v"), e(2).alias("w"), e(3).alias("e4"), F.col("label")
    )


POINTS = """points AS (SELECT vec_id row_id, embedding[1]::DOUBLE x, embedding[2]::DOUBLE y,
  embedding[1]::DOUBLE + embedding[2]::DOUBLE + 0.5*embedding[3]::DOUBLE v, embedding[3]::DOUBLE w, embedding[4]::DOUBLE e4, label FROM embeddings)"""

#: The pair sample of the diagnosis: rows with the least MD5 of "42:<row_id>".
SAMPLE = """sampled AS (SELECT row_id, x, y, v FROM points ORDER BY md5('42:'||row_id), row_id LIMIT 2000)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("ts"), F.col("user_id").alias("usr"), F.col("value"))
