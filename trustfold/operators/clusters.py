"""k-means with many clusters: Lloyd's rounds at a cost that follows the rows, where every row against every centre is rows times clusters.

Rows lie in Z-order, so a batch of rows is a small part of space. It is halved down to a few rows, and each half keeps those centres alone that may be
nearest to one of its rows: a centre that is farther from the box of the rows than another is at most is none. Centres are sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import TASK_ROWS, global_position, written

#: Rows that are compared with all centres left to them, at most.
LEAF_ROWS = 24
#: One start of so many comes from steps in Z-order.
FIRST_SHARE = 16
_BITS = 16


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest centre of each row, the first of equally near ones, and how many distances were taken. Exact."""
    out, taken = np.zeros(len(x), np.int64), 0
    todo = [(np.arange(len(x)), np.arange(len(centres)))] if len(x) else []
    while todo:
        rows, left = todo.pop()
        here, c = x[rows], centres[left]
        low, high = here.min(axis=0), here.max(axis=0)
        near = np.maximum(np.maximum(low - c, c - high), 0.0)
        far = np.maximum(high - c, c - low)
        # Rounding must not drop a centre that is as near.
        left = left[(near**2).sum(axis=1) <= (far**2).sum(axis=1).min() * (1 + 1e-9)]
        if len(rows) > LEAF_ROWS and len(left) > 1:
            axis, half = int((high - low).argmax()), len(rows) // 2
            order = np.argpartition(here[:, axis], half)
            todo += [(rows[order[:half]], left), (rows[order[half:]], left)]
            taken += len(left)
            continue
        for at in range(0, len(rows), LEAF_ROWS):
            d = sum((here[at : at + LEAF_ROWS, None, j] - centres[None, left, j]) ** 2 for j in range(x.shape[1]))
            out[rows[at : at + LEAF_ROWS]] = left[d.argmin(axis=1)]
            taken += d.size
    return out, taken


def _z_code(names: list[str], ends) -> Column:
    """Bits of the columns between their least and greatest values, one of each in turn."""
    bits, code = min(_BITS, 60 // len(names)), F.lit(0).cast("long")
    for j, name in enumerate(names):
        low, width = ends[f"a{j}"], (ends[f"b{j}"] - ends[f"a{j}"]) or 1.0
        whole = F.floor((F.col(name) - low) / width * F.lit(float((1 << bits) - 1))).cast("long")
        for b in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(whole, b).bitwiseAND(F.lit(1)), b * len(names) + j))
    return code


def _starts(places: DataFrame, names: list[str], k: int) -> np.ndarray:
    """k different places: a few at equal steps in Z-order, then as many again and again, drawn by the square of their distance to those before."""
    spark, u = places.sparkSession, places.count()
    k = min(k, u)
    first = -(-k // FIRST_SHARE)
    step = lambda p: F.expr(f"({p} * {first}L) div {u}L")
    centres = _matrix(places.where(step("pos") > step("(pos - 1)")).orderBy("pos").select(*names).toArrow(), names)
    while len(centres) < k:
        sent = spark.sparkContext.broadcast(centres)

        def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, names)
                yield pa.RecordBatch.from_arrays([pa.array(((x - sent.value[nearest_centres(x, sent.value)[0]]) ** 2).sum(axis=1)), *batch.columns], names=["gap", *batch.schema.names])

        # The least exponential times at rates of the squares are a draw without repeats; the hash of the position and round is its chance.
        chance = (F.pmod(F.xxhash64("pos", F.lit(len(centres))), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        time = F.when(F.col("gap") > 0, -F.log(chance) / F.col("gap")).otherwise(math.inf)
        timed = written(places.mapInArrow(gaps, T.StructType([T.StructField("gap", T.DoubleType()), *places.schema.fields])).select("pos", *names, time.alias("time")))
        many = min(len(centres), k - len(centres))
        # A quantile from above, which errs by 1 in 10,000 rows at most, so that little more than the draw is sorted in one task.
        cut = timed.agg(F.percentile_approx("time", min(1.0, (many + 1) / u + 2e-4), 10_000)).first()[0]
        drawn = timed.where((F.col("time") <= cut) & (F.col("time") < math.inf)).orderBy("time", "pos").limit(many)
        more = _matrix(drawn.select(*names).toArrow(), names)
        sent.unpersist()
        if not len(more):
            break
        centres = np.concatenate([centres, more])
    return centres


def k_means(data: DataFrame, names: list[str], k: int, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(row_id, __cluster) of rows with finite numbers in the columns ``names``.

    Starts are k different places (see _starts), all of them where there are fewer. Rounds end when no centre moves by more than ``tolerance``; a centre that
    loses its rows stays.
    """
    spark = data.sparkSession
    ends = data.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{j}") for j, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max))]).first()
    if not ends.n:
        return data.select("row_id", F.lit(None).cast("int").alias("__cluster"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ends.n // TASK_ROWS))
    coded = data.select("row_id", *names, _z_code(names, ends).alias("z"))
    rows = written(coded.repartitionByRange(parts, "z", *names, "row_id").sortWithinPartitions("z", *names, "row_id").drop("z"))
    places = written(global_position(rows.select(*names).distinct().withColumn("z", _z_code(names, ends)), "z", *names).select("pos", *names))
    centres = _starts(places, names, k)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, names)
            own, index = np.unique(nearest_centres(x, sent.value)[0], return_inverse=True)
            added = [np.bincount(index, x[:, j], len(own)) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(index, minlength=len(own)).astype(np.int64)), *map(pa.array, added)], names=["c", "n", *names])

    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(centres)
        parts_of = rows.select(*names).mapInArrow(sums, "c long, n long, " + ", ".join(f"`{c}` double" for c in names))
        got = parts_of.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
        sent.unpersist()
        moved = centres.copy()
        moved[got["c"].to_numpy()] = _matrix(got, names) / got["n"].to_numpy()[:, None]
        gap = ((moved - centres) ** 2).sum(axis=1).max()
        centres = moved
        if gap <= tolerance**2:
            break
    last = spark.sparkContext.broadcast(centres)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = nearest_centres(_matrix(batch, names), last.value)[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row_id")), pa.array(found)], names=["row_id", "__cluster"])

    return written(rows.mapInArrow(assigned, T.StructType([rows.schema["row_id"], T.StructField("__cluster", T.IntegerType())])))


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(table.schema.get_field_index(c)).to_numpy(**({} if isinstance(table, pa.Table) else {"zero_copy_only": False})) for c in names]).astype(np.float64)
