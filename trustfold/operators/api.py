"""The short way in: roles from column names, one call from data to folds, risks or scored folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diagnosis as D
from . import evaluation as E
from . import guards, integrity, leakage, scope

# Column names that say what a column is.
COORDINATES = [("lon", "lat"), ("longitude", "latitude"), ("x", "y"), ("lng", "lat"), ("decimallon", "decimallat"), ("decimallongitude", "decimallatitude")]
TIMES = ["date", "time", "datetime", "timestamp", "year", "day", "t", "date_time"]
GROUPS = ["site", "site_id", "group", "group_id", "patient", "patient_id", "subject", "subject_id", "cluster", "block", "id"]

NUMBERS = ("int", "bigint", "smallint", "tinyint", "float", "double")


@dataclass(frozen=True)
class Roles:
    coords: tuple[str, str] | None = None
    time: str | None = None
    group: str | None = None
    target: str | None = None


def detect_roles(data: DataFrame, target: str | None = None) -> Roles:
    """Roles from lower-cased names and types; a group needs 2 values at least and twice as many rows (one aggregate)."""
    low = {c.lower(): c for c in data.columns if c != target}
    kinds = dict(data.dtypes)
    coords = next(((low[a], low[b]) for a, b in COORDINATES if a in low and b in low and kinds[low[a]] in NUMBERS and kinds[low[b]] in NUMBERS), None)
    time = next((low[c] for c in TIMES if c in low and (kinds[low[c]] in NUMBERS or kinds[low[c]].startswith(("date", "timestamp"))) and low[c] not in (coords or ())), None)
    names = [low[c] for c in GROUPS if c in low and low[c] not in (*(coords or ()), time)]
    group = None
    if names:
        got = data.agg(F.count("*"), *[F.count_distinct(c) for c in names]).first()
        group = next((c for c, k in zip(names, got[1:]) if 2 <= k <= got[0] / 2), None)
    if target is None:
        taken = {*(coords or ()), time, group, "row_id"}
        target = next((c for c in data.columns if c not in taken and kinds[c] in NUMBERS), None)
    return Roles(coords, time, group, target)


def assess(data: DataFrame, split: DataFrame | None = None, roles: Roles | None = None, target: str | None = None, v: int = 5):
    """With a split: raise on unusable ones, else its risks. Without: the diagnosis and the recommended folds."""
    roles = roles or detect_roles(data, target)
    if split is not None:
        integrity.validate_split(data, split, roles.time, roles.group)
        return leakage.validate(leakage.Workflow(data, split, roles.target, roles.time, roles.group, roles.coords))
    return guards.folds_for(data, v, roles.coords, roles.time, roles.group, roles.target)


def check(data: DataFrame, split: DataFrame, **workflow) -> DataFrame:
    """All risks of a split as rows."""
    return leakage.risk_rows(data.sparkSession, leakage.validate(leakage.Workflow(data, split, **workflow)))


def inspect(thing, rows: DataFrame | None = None, kind: str = "vfold", **how) -> list[leakage.Risk]:
    """Risks of a fitted Spark ML stage, model or pipeline (against rows with a role), of a cross-validator, or of fold tables.

    kind: what a fold table is used for, a key of scope.FOLD_RISKS.
    """
    name = type(thing).__name__
    if name == "CrossValidatorModel":
        best = thing.bestModel
        return inspect(best, rows) + leakage.tuning_rules({"cv_type": "simple", "nested": how.get("nested")})
    if isinstance(thing, DataFrame):
        return scope.resampling_risks(thing, rows.select("row_id", "role"), kind)
    if hasattr(thing, "stages"):
        return [r for row in _stages(thing, rows) for r in row[2]]
    out = leakage.inspect_stage(thing, rows) + (scope.inspect_boosting(thing, rows) if name.startswith("GBT") else [])
    size = scope.fitted_size(thing)
    if size is not None:
        n_train, n_all = rows.agg(F.count_if(F.col("role") == "train"), F.count("*")).first()
        out += scope.size_scope(size, n_train, n_all, "model", name)
    return out


def _stages(model, rows: DataFrame) -> list[tuple]:
    """(number, kind, risks) of a pipeline's stages; what follows a predictive model is flagged for review."""
    out, predicts = [], False
    for i, s in enumerate(model.stages):
        risks = inspect(s, rows)
        if predicts:
            risks = [*risks, leakage.Risk("pipeline_postprocessing", leakage.SOFT, f"stage {i} works on the model's results", 0, type(s).__name__)]
        out.append((i, type(s).__name__, risks))
        predicts = predicts or hasattr(s, "getPredictionCol")
    return out


def inspect_pipeline(model, rows: DataFrame) -> DataFrame:
    """(stage number, kind, leaks, risks) of a pipeline; leaks: a hard risk."""
    got = [(i, k, any(r.severity == leakage.HARD for r in risks), [r.type for r in risks]) for i, k, risks in _stages(model, rows)]
    return rows.sparkSession.createDataFrame(got, "stage int, kind string, leaks boolean, risks array<string>")


def check_nested(inner: DataFrame, split: DataFrame, recommended: str | None = None, inner_method: str = "random") -> list[leakage.Risk]:
    """Outer test rows in inner folds, and random inner folds of dependent rows."""
    out = []
    n = integrity.index_overlap(split.where("role = 'test'"), inner).count()
    if n:
        out.append(leakage.Risk("nested_cv_leak", leakage.HARD, f"{n} outer test rows are in inner folds", n, "inner"))
    if inner_method == "random" and recommended not in (None, "random"):
        out.append(leakage.Risk("nested_cv_strategy_mismatch", leakage.SOFT, f"inner folds are random where {recommended} is due", 0, "inner"))
    return out


@dataclass(frozen=True)
class Result:
    diagnosis: D.Diagnosis
    folds: DataFrame
    performance: DataFrame
    risks: list


def workflow(data: DataFrame, target: str, features: list[str], roles: Roles | None = None, v: int = 5, fitter=None) -> Result:
    """Diagnose, fold, fit, score and check every fold's split."""
    roles = roles or detect_roles(data, target)
    d, folds = guards.folds_for(data, v, roles.coords, roles.time, roles.group, target)
    if "role" in folds.columns:  # folds with training sets of their own
        out = None
        model = fitter or E.Linear(target, features)
        for (k,) in sorted(folds.select("fold").distinct().collect()):
            part = data.join(folds.where(F.col("fold") == k).select("row_id", "role"), "row_id")
            got = model(part.where("role = 'train'"))(part.where("role = 'test'")).withColumn("fold", F.lit(k))
            out = got if out is None else out.unionByName(got)
        held = out
    else:
        held = E.held_out(data, folds, fitter or E.Linear(target, features))
    x, y = roles.coords or (None, None)
    risks = leakage.target_names(features, target) + scope.workflow_risks(data, folds, roles.time, roles.group)
    return Result(d, folds, E.fold_performance(held, target, x, y), risks)
