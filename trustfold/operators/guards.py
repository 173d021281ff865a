"""Splitters that refuse or repair random folds where dependence was found, adapters of fold tables, options and a cache."""

from __future__ import annotations

import functools
import warnings
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diagnosis as D
from . import folds as O


@dataclass
class Options:
    auto_check: bool = True
    strict: bool = False
    verbose: bool = False


options = Options()
_cache: dict[tuple, D.Diagnosis] = {}


class DependenceError(ValueError):
    """Random folds of dependent rows."""


def cached_diagnosis(data: DataFrame, **roles) -> D.Diagnosis:
    """One diagnosis for each plan and set of roles."""
    key = (data.semanticHash(), tuple(sorted((k, str(v)) for k, v in roles.items())))
    if key not in _cache:
        _cache[key] = D.diagnose(data, **roles)
    return _cache[key]


def cache_clear() -> None:
    _cache.clear()


def cache_info() -> dict:
    return {"entries": len(_cache)}


def _recommended(data: DataFrame, d: D.Diagnosis, v: int, coords, time, group) -> DataFrame:
    if d.recommended == "spatial_block":
        return O.spatial_blocks(data, *coords, v, d.spatial.get("range") and 1.5 * d.spatial["range"])
    if d.recommended in ("temporal_block", "spatial_temporal"):
        return O.temporal_blocks(data, time, v, d.temporal.get("embargo"))
    if d.recommended == "temporal_group":
        return O.temporal_groups(data, group, time, v)
    if d.recommended in ("group_fold", "spatial_group"):
        return O.group_folds(data, group, v)
    return O.random_folds(data, v)


def folds_for(data: DataFrame, v: int = 5, coords=None, time=None, group=None, target=None) -> tuple[D.Diagnosis, DataFrame]:
    """Diagnose, and make the recommended folds."""
    if data.limit(2 * v).count() < 2 * v:
        raise ValueError(f"{v} folds need at least {2 * v} rows")
    d = cached_diagnosis(data, coords=coords, time=time, group=group, target=target)
    return d, _recommended(data, d, v, coords, time, group)


def random_cv(data: DataFrame, v: int = 5, strata: str | None = None, coords=None, time=None, group=None, target=None, override: bool = False, auto_block: bool = False) -> DataFrame:
    """Random folds; where roles are given and dependence is found this is an error, unless overridden (with a warning) or blocked instead."""
    if options.auto_check and (coords or time or group):
        d = cached_diagnosis(data, coords=coords, time=time, group=group, target=target)
        if d.dependency != "none":
            if auto_block:
                return _recommended(data, d, v, coords, time, group)
            if not override:
                raise DependenceError(f"{d.dependency} dependence: use {d.recommended} folds")
            warnings.warn(f"random folds in spite of {d.dependency} dependence", stacklevel=2)
    return O.stratified_folds(data, strata, v) if strata else O.random_folds(data, v)


def group_cv(data: DataFrame, group: str, v: int = 5, coords=None, time=None, target=None) -> DataFrame:
    """Group folds; warns of dependence in space or time that is left."""
    if options.auto_check and (coords or time):
        d = cached_diagnosis(data, coords=coords, time=time, target=target)
        if d.dependency != "none":
            warnings.warn(f"{d.dependency} dependence is left between groups", stacklevel=2)
    return O.group_folds(data, group, v)


def initial_split(data: DataFrame, share: float = 0.75, time: str | None = None, coords=None, target=None, seed: int = 42) -> DataFrame:
    """By time if there is one, else random with a warning where rows depend on each other in space."""
    if time:
        return O.chronological_split(data, time, share)
    if options.auto_check and coords and cached_diagnosis(data, coords=coords, target=target).dependency != "none":
        warnings.warn("a random split of spatially dependent rows", stacklevel=2)
    return O.random_split(data, share, seed)


# Resampling methods that deal rows at random.
RANDOM_METHODS = ("cv", "repeatedcv", "boot", "boot632", "optimism_boot", "LOOCV")


def train_control(data: DataFrame, method: str, override: bool = False, **roles) -> dict:
    """Refuses random resampling methods of dependent rows."""
    d = cached_diagnosis(data, **roles)
    if method in RANDOM_METHODS and d.dependency != "none" and not override:
        raise DependenceError(f"{method} resamples at random; use {d.recommended}")
    return {"method": method, "recommended": d.recommended}


@contextmanager
def guarded(**roles):
    """Inside, fitting a Spark CrossValidator without a fold column checks its data first."""
    from pyspark.ml.tuning import CrossValidator

    plain = CrossValidator._fit

    @functools.wraps(plain)
    def fit(self, dataset):
        if not self.getFoldCol():
            d = cached_diagnosis(dataset, **roles)
            if d.dependency != "none":
                raise DependenceError(f"{d.dependency} dependence: set foldCol to {d.recommended} folds")
        return plain(self, dataset)

    CrossValidator._fit = fit
    try:
        yield
    finally:
        CrossValidator._fit = plain


def fold_column(data: DataFrame, folds: DataFrame, name: str = "foldCol") -> DataFrame:
    """``data`` with a zero-based fold column for CrossValidator(foldCol=...)."""
    return data.join(folds.select("row_id", (F.col("fold") - 1).cast("int").alias(name)), "row_id")


def fold_vector(folds: DataFrame, data: DataFrame) -> DataFrame:
    """row_id, fold with the last test fold of each row, 1 where it is never tested."""
    tested = folds.where("role = 'test'") if "role" in folds.columns else folds
    last = tested.groupBy("row_id").agg(F.max("fold").alias("fold"))
    return data.select("row_id").join(last, "row_id", "left").select("row_id", F.coalesce("fold", F.lit(1)).alias("fold"))


def named_splits(folds: DataFrame) -> DataFrame:
    """Folds (of repeats) with padded names."""
    fold = F.concat(F.lit("Fold"), F.lpad(F.col("fold").cast("string"), 2, "0"))
    return folds.withColumn("id", F.concat(F.lit("Repeat"), F.lpad(F.col("repeat").cast("string"), 2, "0"), F.lit("_"), fold) if "repeat" in folds.columns else fold)

