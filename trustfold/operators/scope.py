"""What a model, a resampling or a tuning run has seen, held against the split that it should respect.

Row sets are DataFrames of ``row_id``; a check of any number of folds is one join and one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import epoch, spread_rows
from .leakage import HARD, SOFT, Risk

#: How the size of what was seen is judged, by what it is: (risk if more, its severity, risk if less, its severity).
SIZES = {
    "model": ("model_scope", HARD, "model_scope", HARD),
    "folds": ("cv_scope", HARD, None, None),
    "training_data": ("data_scope", HARD, "data_scope", SOFT),
    "learner": ("model_training_size_mismatch", SOFT, None, None),
}
#: Risks where all rows of the data were seen, test rows included.
WHOLE = {"learner": ("model_trained_on_full_data", HARD), "task": ("task_contains_test_data", SOFT), "tuning": ("tune_on_full_data", HARD)}


def size_scope(n_seen: int | None, n_train: int, n_all: int, kind: str = "model", source: str = "") -> list[Risk]:
    """Risks of a number of rows seen that is not the number of training rows."""
    if n_seen is None or n_seen == n_train:
        return []
    source = source or kind
    if kind in WHOLE and n_seen == n_all and n_all > n_train:
        name, severity = WHOLE[kind]
        return [Risk(name, severity, f"{source} saw all {n_seen} rows, of which {n_train} are training rows", n_seen - n_train, source)]
    more, hard, less, soft = SIZES.get(kind, (None, None, None, None))
    name, severity = (more, hard) if n_seen > n_train else (less, soft)
    return [Risk(name, severity, f"{source} saw {n_seen} rows for {n_train} training rows", abs(n_seen - n_train), source)] if name else []


def seen_rows(seen: DataFrame, split: DataFrame) -> DataFrame:
    """One row: n_seen, n_train, n_test_seen and n_unexpected (seen rows that are no training rows) of seen(row_id)."""
    both = seen.select("row_id", F.lit(1).alias("__s")).join(split.select("row_id", "role"), "row_id", "full_outer")
    s, train = F.col("__s").isNotNull(), F.coalesce(F.col("role") == "train", F.lit(False))
    return both.agg(
        F.count_if(s).alias("n_seen"), F.count_if(train).alias("n_train"), F.count_if(s & (F.col("role") == "test")).alias("n_test_seen"), F.count_if(s & ~train).alias("n_unexpected")
    )


def fitted_on(seen: DataFrame, split: DataFrame, source: str = "model") -> list[Risk]:
    """Risks of a model that was fitted on seen(row_id): a wrong number of rows, or the right number of wrong ones."""
    r = seen_rows(seen, split).first()
    out = size_scope(r.n_seen, r.n_train, -1, "model", source)
    if not out and r.n_unexpected:
        out = [Risk("model_data_leak", HARD, f"{source} was fitted on {r.n_unexpected} rows that are no training rows", r.n_unexpected, source)]
    return out


def fitted_size(model) -> int | None:
    """Rows that a fitted Spark ML model counted in its training summary, if it kept one."""
    if not getattr(model, "hasSummary", False):
        return None
    summary = model.summary
    return summary.numInstances if hasattr(summary, "numInstances") else None


#: Risks by kind of resampling. Each is a count of rows of a fold: (risk, severity, what is counted).
FOLD_RISKS = {
    "vfold": [("cv_leak", HARD, "outer_test")],
    "rset": [("test_in_analysis", HARD, "outer_test"), ("non_train_in_analysis", HARD, "not_train")],
    "control": [("test_in_fold", HARD, "outer_test")],
    "tuning": [("tune_test_in_resamples", HARD, "outer_test")],
    "resampling": [("cv_fold_overlap", HARD, "both"), ("test_in_cv_train", HARD, "outer_test")],
    "split": [("cv_leak", HARD, "outer_test"), ("split_misalignment", SOFT, "assessed_train")],
}


def fold_issues(folds: DataFrame, split: DataFrame, kind: str = "rset") -> DataFrame:
    """(fold, type, severity, n): rows of folds(fold, row_id, role) that the split(row_id, role) keeps out of them, for issues that occur."""
    outer = split.select("row_id", F.col("role").alias("outer"))
    each = folds.groupBy("fold", "row_id").agg(F.bool_or(F.col("role") == "train").alias("fit"), F.bool_or(F.col("role") == "test").alias("assess")).join(outer, "row_id", "left")
    count = {
        "outer_test": F.count_if(F.col("fit") & (F.col("outer") == "test")),
        "not_train": F.count_if(F.col("fit") & ~F.coalesce(F.col("outer") == "train", F.lit(False))),
        "both": F.count_if(F.col("fit") & F.col("assess")),
        "assessed_train": F.count_if(F.col("assess") & (F.col("outer") == "train")),
    }
    rules = FOLD_RISKS[kind]
    got = each.groupBy("fold").agg(*[count[what].alias(f"n{i}") for i, (_, _, what) in enumerate(rules)])
    told = F.explode(F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.col(f"n{i}").alias("n")) for i, (t, s, _) in enumerate(rules)]))
    return got.select("fold", told.alias("i")).select("fold", "i.*").where("n > 0")


def resampling_risks(folds: DataFrame, split: DataFrame, kind: str = "vfold") -> list[Risk]:
    """The issues of a fold table as risks, and whether it was made over more rows than the training rows."""
    out = [Risk(r.type, r.severity, f"fold {r.fold}: {r.n} rows", r.n, f"fold {r.fold}") for r in fold_issues(folds, split, kind).orderBy("fold", "type").collect()]
    seen = folds.select("row_id").distinct().count()
    n_train, n_all = split.agg(F.count_if(F.col("role") == "train"), F.count_distinct("row_id")).first()
    return out + size_scope(seen, n_train, n_all, {"tuning": "tuning", "vfold": "folds", "rset": "folds"}.get(kind, ""), "folds")


def fold_checks(data: DataFrame, folds: DataFrame, time: str | None = None, group: str | None = None) -> DataFrame:
    """One row a fold of folds(fold, row_id, role): n_train, n_test, n_overlap (rows in both), n_groups (in both) and n_early (test rows
    before the last training time). Two aggregates over all folds at once."""
    rows = folds.select("fold", "row_id", "role").join(data, "row_id")
    train, test = F.col("role") == "train", F.col("role") == "test"
    each = rows.groupBy("fold", "row_id").agg(F.bool_or(train).alias("a"), F.bool_or(test).alias("b"))
    out = each.groupBy("fold").agg(F.count_if("a").alias("n_train"), F.count_if("b").alias("n_test"), F.count_if(F.col("a") & F.col("b")).alias("n_overlap"))

    def added(out: DataFrame, got: DataFrame, name: str) -> DataFrame:
        return out.join(got, "fold", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))

    if group:
        by = rows.where(F.col(group).isNotNull()).groupBy("fold", group).agg(F.bool_or(train).alias("a"), F.bool_or(test).alias("b"))
        out = added(out, by.groupBy("fold").agg(F.count_if(F.col("a") & F.col("b")).alias("n_groups")), "n_groups")
    if time:
        timed = rows.withColumn("__t", epoch(F.col(time), dict(data.dtypes)[time]))
        last = timed.where(train).groupBy("fold").agg(F.max("__t").alias("last"))
        out = added(out, timed.where(test).join(last, "fold").where(F.col("__t") < F.col("last")).groupBy("fold").agg(F.count("*").alias("n_early")), "n_early")
    return out


def partition_checks(data: DataFrame, folds: DataFrame, time: str | None = None, group: str | None = None) -> DataFrame:
    """:func:`fold_checks` of a partition folds(row_id, fold), where each fold trains on all others, without a row for every fold and row.

    Training rows are all rows less the fold's own; a row or group is on both sides if another fold has it too; the last training time is
    the greatest of all folds, or for the fold that has it the second.
    """
    n = data.count()
    made, rows = spread_rows(n, folds.select("fold", "row_id"), data.select("row_id", *dict.fromkeys(c for c in (time, group) if c)))
    own = made.join(rows, "row_id")
    ids = own.select("fold", "row_id").distinct()
    total = ids.select("row_id").distinct().count()
    often = ids.groupBy("row_id").agg((F.count("*") > 1).alias("twice"))
    out = ids.join(often, "row_id").groupBy("fold").agg(F.count("*").alias("n_test"), F.count_if("twice").alias("n_overlap"))
    out = out.select("fold", (F.lit(total) - F.col("n_test") + F.col("n_overlap")).alias("n_train"), "n_test", "n_overlap")
    if group:
        (by,) = spread_rows(n, own.where(F.col(group).isNotNull()).select("fold", F.col(group).alias("__g")), key="__g")
        by = by.distinct()
        shared = by.groupBy("__g").agg((F.count("*") > 1).alias("twice"))
        out = out.join(by.join(shared, "__g").groupBy("fold").agg(F.count_if("twice").alias("n_groups")), "fold", "left")
    if time:
        timed = own.select("fold", epoch(F.col(time), dict(data.dtypes)[time]).alias("__t"))
        top = timed.groupBy("fold").agg(F.max("__t").alias("last")).where("last is not null").orderBy(F.desc("last"), "fold").limit(2).collect()
        first, second = (top[0].last if top else None), (top[1].last if len(top) > 1 else None)
        last = F.when(F.col("fold") == F.lit(top[0].fold), F.lit(second)).otherwise(F.lit(first)).cast("double") if top else F.lit(None).cast("double")
        out = out.join(timed.where(F.col("__t") < last).groupBy("fold").agg(F.count("*").alias("n_early")), "fold", "left")
    return out.na.fill(0, [c for c in ("n_groups", "n_early") if c in out.columns])


def with_roles(folds: DataFrame) -> DataFrame:
    """A partition into folds (row_id, fold) as (fold, row_id, role): test rows of their own fold, training rows of the others."""
    if "role" in folds.columns:
        return folds.select("fold", "row_id", "role")
    all_folds = folds.select("fold").distinct().withColumnRenamed("fold", "__k")
    role: Column = F.when(F.col("fold") == F.col("__k"), "test").otherwise("train")
    return folds.select("row_id", "fold").join(F.broadcast(all_folds)).select(F.col("__k").alias("fold"), "row_id", role.alias("role"))


def workflow_risks(data: DataFrame, folds: DataFrame, time: str | None = None, group: str | None = None) -> list[Risk]:
    """Risks of every fold's own split."""
    out = []
    checks = fold_checks if "role" in folds.columns else partition_checks
    for r in checks(data, folds, time, group).orderBy("fold").collect():
        r = r.asDict()
        at = f"fold {r['fold']}"
        if r["n_overlap"]:
            out.append(Risk("index_overlap", HARD, f"{at}: {r['n_overlap']} rows are in train and test", r["n_overlap"], at))
        if r.get("n_groups"):
            out.append(Risk("group_overlap", HARD, f"{at}: {r['n_groups']} groups are in train and test", r["n_groups"], at))
        if r.get("n_early"):
            out.append(Risk("temporal_leak", SOFT, f"{at}: {r['n_early']} test rows lie before the last training time", r["n_early"], at))
    return out


def boosting_rules(watched_test: bool = False, early_stopping: bool = False, best_round: int | None = None, n_test: int = 0) -> list[Risk]:
    """A boosted model whose log has test scores without early stopping, or that stopped early at ``best_round``."""
    out = []
    if watched_test and not early_stopping:
        out.append(Risk("hpo_test_usage", SOFT, "test scores were watched while the model was fitted", n_test, "boosting"))
    if early_stopping and best_round:
        out.append(Risk("early_stopping_check", SOFT, f"stopped early at round {best_round}: see that its validation rows are no test rows", n_test, "boosting"))
    return out


def inspect_boosting(stage, rows: DataFrame) -> list[Risk]:
    """A Spark ML boosted-trees stage whose validation rows (validationIndicatorCol) include test rows, or stopped early on them."""
    column = stage.getOrDefault("validationIndicatorCol") if stage.hasParam("validationIndicatorCol") and stage.isDefined("validationIndicatorCol") else None
    if not column or column not in rows.columns:
        return []
    n = rows.where(F.col(column) & (F.col("role") == "test")).count()
    found = [Risk("hpo_test_usage", SOFT, f"{n} test rows are validation rows of the boosting", n, type(stage).__name__)] if n else []
    return found + boosting_rules(early_stopping=True, best_round=getattr(stage, "getNumTrees", None), n_test=n)
