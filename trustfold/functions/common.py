"""Durable tables and global positions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine may leave it unset: a temporary folder serves then."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trustfold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_position(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in a total order, without putting all rows in one task.

    Rows are range-partitioned and sorted, and written so that later reads see one partitioning; each
    partition's count then gives the others' offsets (one number a partition on the driver).
    """
    spark = df.sparkSession
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = df.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    # A partition's rows are written in order, so the low bits number them and the high bits name it.
    kept = written(sorted_rows.withColumn("__id", F.monotonically_increasing_id()))
    part, local = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets or [(0, 0)], "__p bigint, __offset bigint")
    return kept.join(F.broadcast(table), part == F.col("__p")).withColumn(name, F.col("__offset") + local + 1).drop("__id", "__p", "__offset")


#: Rows that a task of :func:`spread_rows` gets on average, at most.
TASK_ROWS = 250_000


def spread_rows(rows: int, *tables: DataFrame, key: str = "row_id") -> list[DataFrame]:
    """The tables in hash partitions of ``key``, more of them the more rows there are, so that what a task sorts and groups does not grow with the input.

    Tables that are dealt together are joined on the key, and grouped by it, without another shuffle.
    """
    parts = max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return [t.repartition(parts, key) for t in tables]


def epoch(column: Column, kind: str) -> Column:
    """Time as a number: days of a date, seconds of a timestamp, numbers as they are."""
    if kind == "date":
        return F.unix_date(column).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)
    return column.cast("double")


def hash_order(*columns: str | Column, seed: int = 42) -> Column:
    """A portable pseudo-random order: MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))
