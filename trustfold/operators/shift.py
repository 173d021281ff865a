"""Classifier two-sample test: can a logistic model tell new rows from training rows, and more so than under permuted labels?

All label permutations are fitted side by side. Rows have a position in a hashed order, which gives the fold and, through a bijection of
the positions, a row's label under every permutation; so a permutation is nothing that is stored or sorted. One Newton step of all
models, permutations times folds, is one scan: each task adds up gradients and second derivatives of its rows by matrix products. The
held-out scores of all permutations are ranked in one range-partitioned pass.

A step sends (permutations + 1) * folds * p^2 / 2 numbers a task, which are added up over SUM_TASKS tasks before they meet on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.common import global_position, hash_order, written
from ..functions.permute import shuffled
from .applicability import drift

SUM_TASKS = 32
#: Numbers in an array of a chunk, rows times label sets times folds: what a task holds depends on neither the rows nor the models.
CHUNK_CELLS = 1 << 18
#: Of the log odds; scores beyond it are 0 or 1 in double precision anyway.
_STEEP = 30.0


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], axis=1)


class _Labels:
    """Labels under the permutations: the rows' own, then 1 where the permuted position is below the number of new rows."""

    def __init__(self, n: int, n_new: int, n_perm: int, seed: int) -> None:
        self.n, self.n_new, self.keys = n, n_new, np.array([(seed + 1 + b) & 0xFFFFFFFFFFFFFFFF for b in range(n_perm)], np.uint64)

    def of(self, own: np.ndarray, pos: np.ndarray) -> np.ndarray:
        moved = shuffled(np.tile(pos - 1, len(self.keys)), self.n, np.repeat(self.keys, len(pos)))
        return np.column_stack([own, (moved < self.n_new).reshape(len(self.keys), len(pos)).T])


def _chunks(batches: Iterator[pa.RecordBatch], p: int, v: int, labels: _Labels):
    """(design matrix, fold, labels) of as many rows as CHUNK_CELLS allows, one at least."""
    names = [f"x{i}" for i in range(p)]
    rows = max(1, CHUNK_CELLS // ((len(labels.keys) + 1) * v))
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            x = np.column_stack([np.ones(batch.num_rows), _columns(batch, names)]) if p else np.ones((batch.num_rows, 1))
            pos = _columns(batch, ["pos"])[:, 0].astype(np.int64)
            yield x, (pos - 1) % v, labels.of(_columns(batch, ["y"])[:, 0], pos)


def added(parts: DataFrame) -> np.ndarray:
    """Element-wise sum of the arrays of all rows, over a few tasks first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column(0):
                got = np.frombuffer(one.as_py(), np.float64)
                total = got.copy() if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return sum(np.frombuffer(r.sums, np.float64) for r in parts.repartition(SUM_TASKS).mapInArrow(add, "sums binary").collect())


def logistic_folds(rows: DataFrame, p: int, v: int, labels: _Labels, most_steps: int = 25, tolerance: float = 1e-8) -> np.ndarray:
    """Coefficients [label set, fold, intercept and features] of the logistic models that leave a fold out: Newton's method, a scan a step."""
    sets, q = len(labels.keys) + 1, p + 1
    pairs = [(i, j) for i in range(q) for j in range(i, q)]
    beta = np.zeros((sets, v, q))
    going = np.ones((sets, v), bool)
    for _ in range(most_steps):
        flat = beta.reshape(sets * v, q)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((q + len(pairs), sets * v))
            for x, fold, y in _chunks(batches, p, v, labels):
                mu = 1 / (1 + np.exp(-np.clip(x @ flat.T, -_STEEP, _STEEP)))
                left_out = np.tile(fold[:, None] == np.arange(v), (1, sets))
                mu_y = np.repeat(y, v, axis=1) - mu
                weight = mu * (1 - mu)
                mu_y[left_out] = weight[left_out] = 0.0
                total[:q] += x.T @ mu_y
                total[q:] += np.stack([x[:, i] * x[:, j] for i, j in pairs]) @ weight
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        got = added(rows.mapInArrow(sums, "sums binary")).reshape(q + len(pairs), sets, v)
        slope, bend = np.moveaxis(got[:q], 0, -1), np.zeros((sets, v, q, q))
        for k, (i, j) in enumerate(pairs):
            bend[..., i, j] = bend[..., j, i] = got[q + k]
        # A hint of a ridge, for separable or collinear data; the optimum moves by less than the tolerance else.
        bend += np.eye(q) * (1e-10 * np.trace(bend, axis1=-2, axis2=-1)[..., None, None] + 1e-12)
        step = np.linalg.solve(bend, slope[..., None])[..., 0]
        step *= np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(axis=-1, keepdims=True), 1e-300))
        beta = np.where(going[..., None], beta + step, beta)
        going &= (np.abs(step).max(axis=-1) > tolerance) & (np.abs(beta).max(axis=-1) < _STEEP)
        if not going.any():
            break
    return beta


def classifier_test(train: DataFrame, new: DataFrame, predictors: list[str], n_perm: int = 100, v: int = 5, seed: int = 42) -> DataFrame:
    """One row: n_train, n_new, classifier_auc (held out over v folds) and classifier_p, (permuted areas as great + 1) / (n_perm + 1).

    Rows with a null predictor are left out. Rows are ordered by the MD5 of seed, side and row_id; position less one, modulo v, is the fold.
    A side without rows gives an area of 0.5. Without permutations p is null.
    """
    spark = train.sparkSession
    side = lambda d, name, y: d.select(F.concat_ws(":", F.lit(name), F.col("row_id").cast("string")).alias("id"), *[F.col(p).cast("double").alias(f"x{i}") for i, p in enumerate(predictors)], F.lit(float(y)).alias("y"))
    both = side(train, "train", 0).unionAll(side(new, "new", 1)).dropna()
    names = [f"x{i}" for i in range(len(predictors))]
    told = both.agg(F.count("*").alias("n"), F.sum("y").alias("n_new"), *[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    n, n_new = told.n, int(told.n_new or 0)
    answer = lambda area, p: spark.createDataFrame([(n - n_new, n_new, area, p)], "n_train long, n_new long, classifier_auc double, classifier_p double")
    if not 0 < n_new < n:
        return answer(0.5, None)
    scaled = [((F.col(c) - told[f"m_{c}"]) / (told[f"s_{c}"] or 1.0)).alias(c) for c in names]
    rows = written(global_position(both.select(hash_order("id", seed=seed).alias("h"), "id", *scaled, "y"), "h", "id").select("pos", *names, "y"))
    labels = _Labels(n, n_new, n_perm, seed)
    p, sets = len(names), n_perm + 1
    beta = logistic_folds(rows, p, v, labels)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, fold, y in _chunks(batches, p, v, labels):
            # Log odds rank as probabilities do.
            eta = np.einsum("nq,nsq->ns", x, beta[:, fold].transpose(1, 0, 2))
            which = np.tile(np.arange(sets, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(eta.ravel()), pa.array(y.ravel().astype(np.int32))], names=["labels", "score", "y"])

    areas = {r.labels: r.auc for r in M.auc(rows.mapInArrow(scores, "labels int, score double, y int"), "y", "score", ["labels"]).collect()}
    permuted = [areas[b] for b in range(1, sets)]
    return answer(areas[0], (sum(a >= areas[0] for a in permuted) + 1) / sets if n_perm else None)


def drift_summary(train: DataFrame, new: DataFrame, predictors: list[str], alpha: float = 0.05, n_perm: int = 100, seed: int = 42) -> DataFrame:
    """One row: n_features, n_shifted, greatest |Cohen's d|, classifier_auc, classifier_p and severity (none, mild, moderate, severe)."""
    share, d = F.avg(F.col("shifted").cast("double")), F.max(F.coalesce(F.abs("cohens_d"), F.lit(0.0)))
    told = drift(train, new, predictors, alpha).agg(F.count("*").alias("n_features"), F.count_if("shifted").alias("n_shifted"), share.alias("share"), d.alias("max_abs_d"))
    both = told.join(F.broadcast(classifier_test(train, new, predictors, n_perm, seed=seed) if n_perm else train.sparkSession.createDataFrame([(None, None)], "classifier_auc double, classifier_p double")))
    level = F.when((F.col("share") == 0) & (F.coalesce("classifier_auc", F.lit(0.0)) < 0.6), "none").when((F.col("share") <= 0.2) & (F.col("max_abs_d") < 0.5), "mild")
    level = level.when((F.col("share") <= 0.5) | (F.col("max_abs_d") < 1.0), "moderate").otherwise("severe")
    return both.select("n_features", "n_shifted", "max_abs_d", "classifier_auc", "classifier_p", level.alias("severity"))
