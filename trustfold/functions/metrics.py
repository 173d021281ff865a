"""Metrics as aggregate expressions over actual and predicted columns. Rows with a null in either are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_position

METRICS = ("rmse", "mae", "rsq", "accuracy", "tss", "kappa", "sensitivity", "specificity", "auc")
SMALLER_IS_BETTER = ("rmse", "mae")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null without variance, where the built-in one divides by zero. Both must be null together."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def regression(actual: Column, predicted: Column) -> dict[str, Column]:
    """rsq is null where the actual values do not vary."""
    ok = actual.isNotNull() & predicted.isNotNull()
    a, e = F.when(ok, actual), F.when(ok, actual - predicted)
    total = F.var_pop(a) * F.count(a)
    return {"rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "rsq": F.when(total > 0, 1 - F.sum(e * e) / total)}


def classification(actual: Column, score: Column, cut: float = 0.5) -> dict[str, Column]:
    """actual is 0 or 1; a score of at least ``cut`` predicts 1."""
    ok = actual.isNotNull() & score.isNotNull()
    yes = score >= cut
    tp, fn = F.count_if(ok & (actual == 1) & yes), F.count_if(ok & (actual == 1) & ~yes)
    tn, fp = F.count_if(ok & (actual == 0) & ~yes), F.count_if(ok & (actual == 0) & yes)
    n = tp + fn + tn + fp
    part = lambda a, b: F.when(a + b > 0, a / (a + b))
    right = F.when(n > 0, (tp + tn) / n)
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return {
        "accuracy": right,
        "sensitivity": part(tp, fn),
        "specificity": part(tn, fp),
        "tss": part(tp, fn) + part(tn, fp) - 1,
        "kappa": F.when((n > 0) & (chance < 1), (right - chance) / (1 - chance)),
    }


def auc(data: DataFrame, actual: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area with half counts for ties, from counts by distinct score. One class only gives 0.5, and other classes than 0 and 1 give null."""
    by = by or []
    ok = data.where(F.col(actual).isNotNull() & F.col(score).isNotNull())
    per = ok.groupBy(*by, score).agg(
        F.count_if(F.col(actual) == 1).alias("p"), F.count_if(F.col(actual) == 0).alias("q"), F.count_if(~F.col(actual).isin(0, 1)).alias("x")
    )
    ranked = global_position(per, *by, score)
    # Negatives below each score: running sums within range partitions, and the partitions before them.
    part = F.floor((F.col("pos") - 1) / 100_000)
    from pyspark.sql.window import Window

    blocks = ranked.withColumn("blk", part)
    sums = blocks.groupBy(*by, "blk").agg(F.sum("q").alias("s"))
    before = sums.withColumn("prior", F.coalesce(F.sum("s").over(Window.partitionBy(*by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inner = Window.partitionBy(*by, "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    below = blocks.withColumn("here", F.coalesce(F.sum("q").over(inner), F.lit(0))).join(F.broadcast(before), [*by, "blk"])
    u = F.sum(F.col("p") * (F.col("prior") + F.col("here") + F.col("q") / 2))
    n1, n0 = F.sum("p"), F.sum("q")
    return below.groupBy(*by).agg(F.when(F.sum("x") == 0, F.when((n1 > 0) & (n0 > 0), u / (n1 * n0)).otherwise(0.5)).alias("auc"))


def willmott(data: DataFrame, actual: str, predicted: str, c: float = 2.0) -> DataFrame:
    """One row: d, d1 and dr."""
    ok = data.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    mean = ok.agg(F.avg(actual)).first()[0]
    o, p = F.col(actual), F.col(predicted)
    spread, error = F.sum(F.abs(o - mean)), F.sum(F.abs(p - o))
    return ok.agg(
        (1 - F.sum(F.pow(p - o, 2)) / F.sum(F.pow(F.abs(p - mean) + F.abs(o - mean), 2))).alias("d"),
        (1 - error / F.sum(F.abs(p - mean) + F.abs(o - mean))).alias("d1"),
        F.when(error <= c * spread, 1 - error / (c * spread)).otherwise(c * spread / error - 1).alias("dr"),
    )


def multiscale(data: DataFrame, x: str, y: str, actual: str, predicted: str, scales: list[float]) -> DataFrame:
    """(scale, n_cells, rmse) of cell means at each scale; scale 0 is pointwise. Scales are a short list of the caller's."""
    out = None
    for s in scales:
        keys = [F.col(x), F.col(y), F.col("row_id")] if s == 0 else [F.floor(F.col(x) / s), F.floor(F.col(y) / s)]
        cells = data.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.avg(actual).alias("a"), F.avg(predicted).alias("p"))
        got = cells.agg(F.count("*").alias("n_cells"), regression(F.col("a"), F.col("p"))["rmse"].alias("rmse")).select(F.lit(float(s)).alias("scale"), "n_cells", "rmse")
        out = got if out is None else out.unionByName(got)
    return out
