"""Shared pieces: durable materialisation, ASCII lower-casing, byte-level word tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes that separate words: space and tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a session on one machine may leave it unset (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="trustfold-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the checkpoint folder, and read it back.

    Unlike a checkpoint it forgets the plan's size estimate, which loops would square at every step, and
    gives the planner the real size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` once nothing will read them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/table-" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more.

    Else they stay on the executors' disks until the driver happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Arrow batches hold documents, some of them long, and two or three copies of a batch are in memory at once.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_BYTES where they have Spark's own bound of 64 MB; another setting is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, BATCH_BYTES)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def input_tasks(spark: SparkSession) -> int:
    """Shuffle width: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a text column, each of about ``limit`` bytes at most, but one row at least.

    Batches are bounded by rows, not bytes; what is made of a text is several times its size.
    """
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit, side="right")))
        yield at, column.slice(at, end - at)
        pa.default_memory_pool().release_unused()
        at = end


def byte_table(lower: bool = True) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(SPACES)] = True
    return table


def word_bounds(data: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of non-space bytes."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~spaces[data]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
