"""Scoring models under folds: linear fits from sums of products, and everything that is computed from held-out predictions.

``folds`` is a partition (row_id, fold). Linear models need one pass: the sums of products of all folds are a few numbers, and
a training set's sums are the total less the test fold's. Other models come as a ``Fitter``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.common import hash_order, spread_rows, written
from ..functions.stats import t_two_sided
from .neighbours import k_nearest


class Fitter(Protocol):
    def __call__(self, train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        """A function that adds ``prediction`` to rows."""


class Linear:
    """Least squares of ``target`` on ``features``; coefficients are a literal expression, so scoring stays in the plan."""

    def __init__(self, target: str, features: Sequence[str], ridge: float = 1e-9) -> None:
        self.target, self.features, self.ridge = target, list(features), ridge

    def products(self, data: DataFrame, by: list[str] | None = None) -> DataFrame:
        names = ["1", *self.features, self.target]
        value = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        ok = data.dropna(subset=[*self.features, self.target])
        return ok.groupBy(*(by or [])).agg(*[F.sum(value(a) * value(b)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])

    def matrix(self, row) -> np.ndarray:
        n = len(self.features) + 2
        out, i = np.zeros((n, n)), 0
        for a in range(n):
            for b in range(a, n):
                out[a, b] = out[b, a] = row[f"s{i}"] or 0.0
                i += 1
        return out

    def solve(self, m: np.ndarray, use: Sequence[int] | None = None) -> np.ndarray:
        """Coefficients (intercept first); ``use``: numbers of the features to keep, the others get zero.

        Columns are scaled to unit length first: sums of squares of large features lose half of the digits of the intercept else.
        """
        at = [0, *[1 + i for i in (range(len(self.features)) if use is None else use)]]
        a = m[np.ix_(at, at)]
        scale = 1 / np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        eased = a * scale[:, None] * scale
        out = np.zeros(len(self.features) + 1)
        out[at] = scale * np.linalg.lstsq(eased + self.ridge * np.diag(np.diag(eased)), scale * m[at, -1], rcond=None)[0]
        return out

    def expression(self, beta: np.ndarray) -> Column:
        out = F.lit(float(beta[0]))
        for b, f in zip(beta[1:], self.features):
            if b:
                out = out + F.lit(float(b)) * F.col(f).cast("double")
        return out

    def __call__(self, train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        beta = self.solve(self.matrix(self.products(train).first()))
        return lambda rows: rows.withColumn("prediction", self.expression(beta))

    def by_fold(self, data: DataFrame, folds: DataFrame) -> dict[int, np.ndarray]:
        """Sums of products of each test fold: folds x products numbers."""
        return {r.fold: self.matrix(r) for r in self.products(data.join(folds.select("row_id", "fold"), "row_id"), ["fold"]).collect()}


def held_out(data: DataFrame, folds: DataFrame, fitter) -> DataFrame:
    """``data`` with fold and the prediction of the model that was trained without that fold."""
    rows = data.join(folds.select("row_id", "fold"), "row_id")
    if isinstance(fitter, Linear):
        sums = fitter.by_fold(data, folds)
        total, out = sum(sums.values()), F.lit(None).cast("double")
        for k, m in sums.items():
            out = F.when(F.col("fold") == k, fitter.expression(fitter.solve(total - m))).otherwise(out)
        return rows.withColumn("prediction", out)
    out, rows = None, written(rows)
    for (k,) in sorted(rows.select("fold").distinct().collect()):
        got = fitter(rows.where(F.col("fold") != k))(rows.where(F.col("fold") == k))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


def fold_performance(predictions: DataFrame, target: str, x: str | None = None, y: str | None = None) -> DataFrame:
    """fold, n, rmse, mae, rsq and the fold's centre."""
    got = M.regression(F.col(target).cast("double"), F.col("prediction"))
    centre = [F.avg(c).alias(f"centre_{n}") for n, c in (("x", x), ("y", y)) if c]
    return predictions.groupBy("fold").agg(F.count("*").alias("n"), *[c.alias(n) for n, c in got.items()], *centre)


def pooled_and_mean(predictions: DataFrame, target: str) -> DataFrame:
    """metric, pooled (over all held-out rows), mean_of_folds."""
    got = M.regression(F.col(target).cast("double"), F.col("prediction"))
    whole = predictions.agg(*[c.alias(n) for n, c in got.items()]).first()
    folds = fold_performance(predictions, target).agg(*[F.avg(n).alias(n) for n in got]).first()
    return predictions.sparkSession.createDataFrame([(n, whole[n], folds[n]) for n in got], "metric string, pooled double, mean_of_folds double")


def compare_cv(data: DataFrame, random_folds: Sequence[DataFrame], blocked_folds: Sequence[DataFrame], fitter, target: str, metric: str = "rmse") -> dict:
    """Random against blocked folds, repeat by repeat: means, inflation and a paired t-test."""
    one = lambda f: held_out(data, f, fitter).groupBy("fold").agg(M.regression(F.col(target).cast("double"), F.col("prediction"))[metric].alias("m")).agg(F.avg("m")).first()[0]
    a, b = [one(f) for f in random_folds], [one(f) for f in blocked_folds]
    d = np.array(a) - np.array(b)
    t = float(d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))) if len(d) > 1 and d.std(ddof=1) > 0 else None
    ra, rb = float(np.mean(a)), float(np.mean(b))
    loss = (rb - ra) / rb if metric in M.SMALLER_IS_BETTER else (ra - rb) / rb
    return {"random": ra, "blocked": rb, "inflation": loss, "t": t, "p": t_two_sided(t, len(d) - 1) if t is not None else None}


def compare_models(data: DataFrame, folds: DataFrame, models: dict, target: str, metric: str = "rmse") -> DataFrame:
    """model, mean, sd, min, max over folds and rank."""
    rows = []
    for name, fitter in models.items():
        got = [r[metric] for r in fold_performance(held_out(data, folds, fitter), target).collect()]
        rows.append((name, float(np.mean(got)), float(np.std(got, ddof=1)) if len(got) > 1 else None, float(min(got)), float(max(got))))
    rows.sort(key=lambda r: r[1] if metric in M.SMALLER_IS_BETTER else -r[1])
    return data.sparkSession.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "model string, mean double, sd double, min double, max double, rank int")


def _subset_error(model: Linear, sums: dict[int, np.ndarray], use: Sequence[int]) -> float:
    """Mean RMSE over folds of the subset, from the sums of products alone."""
    total, out = sum(sums.values()), []
    for m in sums.values():
        beta = np.append(model.solve(total - m, use), -1.0)
        out.append(math.sqrt(max(0.0, float(beta @ m @ beta)) / m[0, 0]))
    return float(np.mean(out))


def forward_selection(data: DataFrame, folds: DataFrame, target: str, features: list[str], least: int = 1) -> list[tuple[list[str], float]]:
    """Greedy forward selection by held-out RMSE; one scan of the data, all subsets are solved from its sums."""
    model = Linear(target, features)
    sums, have, path, best = model.by_fold(data, folds), [], [], math.inf
    while len(have) < len(features):
        score, pick = min((_subset_error(model, sums, [*have, i]), i) for i in range(len(features)) if i not in have)
        if score >= best and len(have) >= least:
            break
        have, best = [*have, pick], score
        path.append(([features[i] for i in have], score))
    return path


def best_subset(data: DataFrame, folds: DataFrame, target: str, features: list[str]) -> tuple[list[str], float]:
    """The best of all subsets of at most 15 features."""
    if len(features) > 15:
        raise ValueError("at most 15 predictors")
    model = Linear(target, features)
    sums = model.by_fold(data, folds)
    every = itertools.chain.from_iterable(itertools.combinations(range(len(features)), k) for k in range(1, len(features) + 1))
    score, use = min((_subset_error(model, sums, s), s) for s in every)
    return [features[i] for i in use], score


def conformal(residuals: DataFrame, new: DataFrame, alpha: float = 0.1, residual: str = "residual", prediction: str = "prediction") -> DataFrame:
    """Intervals of ``new`` from held-out residuals: the type-1 quantile of |residual| at min(1, ceil((n+1)(1-alpha))/n)."""
    clean = residuals.where(F.col(residual).isNotNull())
    n = clean.count()
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
    q = clean.selectExpr(f"percentile_disc({level}) within group (order by abs(`{residual}`)) as q").first()[0]
    return new.withColumns({"lower": F.col(prediction) - q, "upper": F.col(prediction) + q})


def calibration_residuals(data: DataFrame, blocks: DataFrame, fitter, target: str, method: str = "block_cv") -> DataFrame:
    """row_id and residual for :func:`conformal`, from blocks(row_id, fold) that are kept whole.

    block_cv, block_jackknife: every row by the model that did not see its block (folds of the user, or one fold a block). split: one
    model of the blocks with odd numbers, rows of the others.
    """
    if method not in ("block_cv", "block_jackknife", "split"):
        raise ValueError(f"unknown method {method!r}")
    if method == "split":
        rows = data.join(blocks.select("row_id", "fold"), "row_id")
        held = fitter(rows.where(F.col("fold") % 2 == 1))(rows.where(F.col("fold") % 2 == 0))
    else:
        held = held_out(data, blocks, fitter)
    return held.select("row_id", (F.col(target) - F.col("prediction")).alias("residual"))


def conformal_width(residuals: DataFrame, alpha: float = 0.1, residual: str = "residual") -> DataFrame:
    """One row: n, level and half width q."""
    n = residuals.where(F.col(residual).isNotNull()).count()
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n) if n else 1.0
    return residuals.selectExpr(f"cast({n} as bigint) as n", f"`{residual}` as r").groupBy("n").agg(F.expr(f"percentile_disc({level}) within group (order by abs(r))").alias("q")).select("n", F.lit(level).alias("level"), "q")


def calibration_bins(data: DataFrame, actual: str, score: str, bins: int = 10, quantile: bool = False) -> DataFrame:
    """bin, n, predicted, observed and its Wilson interval, of bins (left-closed, the last closed) with two rows at least."""
    p = F.col(score)
    ok = data.where(p.isNotNull() & F.col(actual).isNotNull())
    if quantile:
        cuts = sorted(set(ok.agg(F.percentile(score, [k / bins for k in range(1, bins)])).first()[0]))
        place = F.lit(1)
        for c in cuts:
            place = place + (p >= c).cast("int")
    else:
        place = F.greatest(F.lit(1), F.least(F.lit(bins), F.floor(p * bins) + 1))
    z2 = 1.959963984540054**2
    n, o = F.col("n"), F.col("observed")
    half = F.sqrt(o * (1 - o) / n + z2 / (4 * n * n)) * math.sqrt(z2) / (1 + z2 / n)
    mid = (o + z2 / (2 * n)) / (1 + z2 / n)
    got = ok.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(actual).alias("observed")).where("n >= 2")
    return got.withColumns({"lower": mid - half, "upper": mid + half})


def calibration(data: DataFrame, actual: str, score: str, bins: int = 10) -> DataFrame:
    """One row: ece, mce, brier, slope and intercept of the weighted reliability line, and grade (well, moderate, poor)."""
    table = calibration_bins(data, actual, score, bins)
    gap, n = F.abs(F.col("observed") - F.col("predicted")), F.col("n")
    w = {k: F.sum(e) for k, e in {"n": n, "x": n * F.col("predicted"), "y": n * F.col("observed"), "xx": n * F.pow("predicted", 2), "xy": n * F.col("predicted") * F.col("observed")}.items()}
    slope = (w["n"] * w["xy"] - w["x"] * w["y"]) / (w["n"] * w["xx"] - w["x"] * w["x"])
    sums = table.agg((F.sum(n * gap) / F.sum(n)).alias("ece"), F.max(gap).alias("mce"), slope.alias("slope"), ((w["y"] - slope * w["x"]) / w["n"]).alias("intercept"))
    brier = data.agg(F.avg(F.pow(F.col(score) - F.col(actual), 2)).alias("brier"))
    return sums.join(brier).withColumn("grade", F.when(F.col("ece") < 0.02, "well").when(F.col("ece") < 0.08, "moderate").otherwise("poor"))


def regression_calibration(data: DataFrame, actual: str, mean: str, sd: str) -> DataFrame:
    """level, coverage of mean +- z * sd at levels .1 to .9. One scan."""
    from statistics import NormalDist

    levels = [k / 10 for k in range(1, 10)]
    z = [NormalDist().inv_cdf(0.5 + v / 2) for v in levels]
    got = data.agg(*[F.avg((F.abs(F.col(actual) - F.col(mean)) <= q * F.col(sd)).cast("double")).alias(f"c{i}") for i, q in enumerate(z)])
    return got.selectExpr(f"stack(9, {', '.join(f'{v}D, c{i}' for i, v in enumerate(levels))}) as (level, coverage)")


def group_metrics(predictions: DataFrame, target: str, group: str) -> DataFrame:
    """group, n, rmse, mae and the ratio of the worst group's RMSE to the best one's as disparity."""
    got = M.regression(F.col(target).cast("double"), F.col("prediction"))
    by = predictions.groupBy(group).agg(F.count("*").alias("n"), got["rmse"].alias("rmse"), got["mae"].alias("mae"))
    return by.join(F.broadcast(by.agg((F.max("rmse") / F.min("rmse")).alias("disparity"))))


def fairness(data: DataFrame, random_folds: DataFrame, blocked_folds: DataFrame, fitter, target: str, group: str, metric: str = "rmse") -> DataFrame:
    """group, n, metric_random, metric_blocked and their difference as disparity: how much worse a group fares when its neighbours are held out."""

    def scores(folds: DataFrame, name: str) -> DataFrame:
        return held_out(data, folds, fitter).groupBy(group).agg(F.count("*").alias(f"n_{name}"), M.regression(F.col(target).cast("double"), F.col("prediction"))[metric].alias(f"metric_{name}"))

    both = scores(random_folds, "random").join(scores(blocked_folds, "blocked"), group)
    return both.select(group, F.col("n_random").alias("n"), "metric_random", "metric_blocked", (F.col("metric_blocked") - F.col("metric_random")).alias("disparity"))


def prediction_map(data: DataFrame, repeats: DataFrame, fitter, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """row_id, place, mean and spread of a row's held-out predictions over repeats(repeat, row_id, fold), their number, and the mean residual."""
    out, total = None, data.count()
    for (r,) in sorted(repeats.select("repeat").distinct().collect()):
        rows, made = spread_rows(total, data, repeats.where(F.col("repeat") == r))
        got = held_out(rows, made, fitter).select("row_id", x, y, F.col(target).alias("actual"), "prediction")
        out = got if out is None else out.unionByName(got)
    (out,) = spread_rows(2 * total, out)
    by = out.groupBy("row_id").agg(
        F.first(x).alias(x), F.first(y).alias(y), F.avg("prediction").alias("pred_mean"), F.stddev_samp("prediction").alias("pred_sd"),
        F.count("prediction").cast("int").alias("n_tested"), F.first("actual").alias("actual"),
    )
    return by.withColumn("residual_mean", F.col("actual") - F.col("pred_mean"))


def ensemble(data: DataFrame, folds: DataFrame, model: Linear, new: DataFrame, by_error: bool = True) -> DataFrame:
    """Mean and spread over the folds' models of each new row's prediction; weights are inverse held-out errors."""
    sums = model.by_fold(data, folds)
    total, parts = sum(sums.values()), []
    for m in sums.values():
        beta = model.solve(total - m)
        full = np.append(beta, -1.0)
        parts.append((model.expression(beta), 1 / max(1e-12, math.sqrt(max(0.0, float(full @ m @ full)) / m[0, 0])) if by_error else 1.0))
    scale = sum(w for _, w in parts)
    mean = sum((e * (w / scale) for e, w in parts), F.lit(0.0))
    var = sum((F.pow(e - mean, 2) * (w / scale) for e, w in parts), F.lit(0.0))
    return new.withColumns({"prediction": mean, "sd": F.sqrt(var)})


def stability_map(data: DataFrame, folds: DataFrame, model: Linear, new: DataFrame) -> DataFrame:
    """Per new row: mean, sd, cv, range and number of the folds' models' predictions."""
    sums = model.by_fold(data, folds)
    total = sum(sums.values())
    preds = F.array(*[model.expression(model.solve(total - m)) for m in sums.values()])
    n = len(sums)
    mean = F.aggregate(preds, F.lit(0.0), lambda a, p: a + p) / n
    rows = new.withColumn("__p", preds).withColumn("mean", mean)
    sd = F.sqrt(F.aggregate("__p", F.lit(0.0), lambda a, p: a + F.pow(p - F.col("mean"), 2)) / max(n - 1, 1))
    return rows.withColumns({"sd": sd, "range": F.array_max("__p") - F.array_min("__p"), "n_models": F.lit(n)}).withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean"))).drop("__p")


def null_test(data: DataFrame, folds: DataFrame, target: str, features: list[str], n_null: int = 99, seed: int = 42) -> dict:
    """The held-out RMSE against targets permuted in hashed order: z and (number as good + 1) / (n + 1)."""
    from ..functions.common import global_position

    model = Linear(target, features)
    one = lambda d: _subset_error(model, model.by_fold(d, folds), range(len(features)))
    real = one(data)
    base = written(global_position(data, "row_id", name="__a"))
    scores = []
    for r in range(n_null):
        mixed = global_position(base.select(F.col(target).alias("__t"), hash_order("row_id", seed=seed + r + 1).alias("__h")), "__h", name="__a")
        scores.append(one(base.drop(target).join(mixed.select("__a", F.col("__t").alias(target)), "__a")))
    sd = float(np.std(scores, ddof=1)) if n_null > 1 else 0.0
    return {"observed": real, "null_mean": float(np.mean(scores)), "z": (real - float(np.mean(scores))) / sd if sd else None, "p": (sum(s <= real for s in scores) + 1) / (n_null + 1)}


def bootstrap(predictions: DataFrame, target: str, block: str, n_boot: int = 200, alpha: float = 0.05, seed: int = 42) -> dict:
    """Block bootstrap of the held-out RMSE: blocks' squared errors are summed once, and resampled as numbers.

    Blocks are few (a block column of at most 100000 values).
    """
    e2 = F.pow(F.col(target) - F.col("prediction"), 2)
    got = predictions.groupBy(block).agg(F.sum(e2).alias("s"), F.count("*").alias("n")).orderBy(block).limit(100_001).collect()
    if len(got) > 100_000:
        raise ValueError("too many blocks")
    s, n = np.array([r.s for r in got]), np.array([r.n for r in got], float)
    rng = np.random.default_rng(seed)
    draws = [(lambda i: math.sqrt(s[i].sum() / n[i].sum()))(rng.integers(0, len(s), len(s))) for _ in range(n_boot)]
    point = math.sqrt(s.sum() / n.sum())
    low, high = np.quantile(draws, [alpha / 2, 1 - alpha / 2])
    return {"rmse": point, "lower": float(low), "upper": float(high), "se": float(np.std(draws, ddof=1)), "bias": float(np.mean(draws) - point)}


def importance(data: DataFrame, predict: Callable[[DataFrame], DataFrame], target: str, features: list[str], block: str, n_rep: int = 10, seed: int = 42) -> DataFrame:
    """feature, mean and sd of the rise in RMSE when the feature is permuted within blocks by hashed order."""
    from pyspark.sql.window import Window

    rmse = lambda d: predict(d).agg(M.regression(F.col(target).cast("double"), F.col("prediction"))["rmse"]).first()[0]
    base, rows = rmse(data), []
    order = data.withColumn("__i", F.row_number().over(Window.partitionBy(block).orderBy("row_id")))
    for f in features:
        rises = []
        for r in range(n_rep):
            w = Window.partitionBy(block).orderBy(hash_order("row_id", seed=seed + r))
            mixed = data.select(F.col(block).alias("__b"), F.col(f).alias("__v"), F.row_number().over(w).alias("__j"))
            swapped = order.join(mixed, (F.col(block) == F.col("__b")) & (F.col("__i") == F.col("__j"))).withColumn(f, F.col("__v"))
            rises.append(rmse(swapped) - base)
        rows.append((f, float(np.mean(rises)), float(np.std(rises, ddof=1)) if n_rep > 1 else None))
    return data.sparkSession.createDataFrame(sorted(rows, key=lambda r: -r[1]), "feature string, importance double, sd double")


def marginal_contributions(model: Linear, beta: np.ndarray, data: DataFrame, block: str) -> DataFrame:
    """row_id, feature, contribution: prediction less its mean with the feature drawn from the other blocks.

    For a linear model that mean needs only the feature's sums by block.
    """
    sums = data.groupBy(block).agg(F.count("*").alias("__n"), *[F.sum(f).alias(f"__s_{f}") for f in model.features])
    total = sums.agg(F.sum("__n"), *[F.sum(f"__s_{f}") for f in model.features]).first()
    rows = data.join(F.broadcast(sums) if sums.count() <= 100_000 else sums, block)
    parts = [F.struct(F.lit(f).alias("feature"), (F.lit(float(beta[i + 1])) * (F.col(f) - (total[i + 1] - F.col(f"__s_{f}")) / (total[0] - F.col("__n")))).alias("contribution")) for i, f in enumerate(model.features)]
    return rows.select("row_id", F.explode(F.array(*parts)).alias("c")).select("row_id", "c.*")


def stability(repeats: Sequence[float]) -> dict:
    """Coefficient of variation of a metric over repeats: stable below .05, moderate below .15."""
    cv = float(np.std(repeats, ddof=1) / abs(np.mean(repeats)))
    return {"cv": cv, "verdict": "stable" if cv < 0.05 else "moderate" if cv < 0.15 else "unstable"}


def local_moran(points: DataFrame, k: int = 8, permutations: int = 99, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """points(row_id, x, y, v) to row_id, local_i, p and label (high-high, low-low, high-low, low-high, none).

    Weights are the k nearest rows (see neighbours). p is that of conditional permutations: the own value stays, the neighbours' are k values
    of other rows. A row's null statistics are its own z times means of drawn values, so all rows share the draws: each order by the MD5 of
    seed and row_id gives disjoint draws of k and a spare value, which replaces the row's own where it was drawn. The driver holds (k + 1)
    values a permutation.
    """
    clean = points.select("row_id", "x", "y", "v").dropna()
    n, mean, sd = clean.agg(F.count("*"), F.avg("v"), F.stddev_pop("v")).first()
    k = min(k, n - 1)
    if k < 1 or not sd:
        none = [F.lit(None).cast("double").alias("p"), F.lit("none").alias("label")] if permutations else []
        return clean.select("row_id", F.lit(None).cast("double").alias("local_i"), *none)
    z = clean.withColumn("z", (F.col("v") - mean) / sd)
    near = k_nearest(z, k, value="z")
    lag = F.aggregate("near", F.lit(0.0), lambda a, b: a + b["v"]) / F.size("near")
    got = near.select("row_id", lag.alias("lag")).join(z.select(F.col("row_id").cast("long").alias("row_id"), "z"), "row_id").withColumn("local_i", F.col("z") * F.col("lag"))
    if not permutations:
        return got.select("row_id", "local_i")

    drawn, each = [], n // (k + 1)
    for order in range(-(-permutations // each)):
        many = min(each, permutations - order * each) * (k + 1)
        drawn += [(int(r.row_id), r.z) for r in z.select("row_id", "z").orderBy(hash_order("row_id", seed=seed + order), "row_id").limit(many).collect()]
    null, swaps = [], []
    for at in range(0, len(drawn), k + 1):
        own, spare = drawn[at : at + k], drawn[at + k][1]
        total = sum(v for _, v in own)
        null.append(abs(total / k))
        swaps += [(i, abs(total / k), abs((total - v + spare) / k)) for i, v in own]
    # As great but for rounding.
    size = F.abs("lag") - 1e-12
    swapped = points.sparkSession.createDataFrame(swaps, "row_id bigint, was double, now double")
    swapped = swapped.groupBy("row_id").agg(F.collect_list(F.struct("was", "now")).alias("swaps"))
    hits = F.size(F.filter(F.array(*[F.lit(v) for v in null]), lambda v: v >= size))
    more = F.aggregate(F.coalesce("swaps", F.array()), F.lit(0), lambda a, s: a + (s["now"] >= size).cast("int") - (s["was"] >= size).cast("int"))
    p = (hits + more + 1) / (permutations + 1)
    side = lambda test: F.when(test, "high").otherwise("low")
    own = F.col("z") > 0
    label = F.when(F.col("p") <= alpha, F.concat_ws("-", side(own), side(own == (F.col("local_i") > 0)))).otherwise("none")
    return got.join(F.broadcast(swapped), "row_id", "left").withColumn("p", p).select("row_id", "local_i", "p", label.alias("label"))


def transferability(data: DataFrame, model: Linear, x: str, y: str, regions: int = 4, seed: int = 42) -> DataFrame:
    """(trained, tested, rmse, distance of centres) between k-means regions: one scan for all models and all scores."""
    from .folds import _clusters

    clustered = _clusters(data, [x, y], regions, seed).where("__cluster is not null")
    sums = {r["__cluster"]: model.matrix(r) for r in model.products(clustered, ["__cluster"]).collect()}
    centre = {r["__cluster"]: (r.a, r.b) for r in clustered.groupBy("__cluster").agg(F.avg(x).alias("a"), F.avg(y).alias("b")).collect()}
    rows = []
    for i, a in sums.items():
        beta = np.append(model.solve(a), -1.0)
        rows += [(i, j, math.sqrt(max(0.0, float(beta @ b @ beta)) / float(b[0, 0])), math.dist(centre[i], centre[j])) for j, b in sums.items()]
    return data.sparkSession.createDataFrame(rows, "trained int, tested int, rmse double, distance double")


def error_profile(rows: DataFrame, di: str = "di", error: str = "abs_error", bins: int = 10):
    """Mean error by equal-width bins of the dissimilarity, and an isotonic fit that predicts error from it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    from .folds import right_closed_bin

    low, high = rows.agg(F.min(di), F.max(di)).first()
    table = rows.groupBy(right_closed_bin(F.col(di), low, high, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(di).alias("di"), F.avg(error).alias("error"))
    ready = VectorAssembler(inputCols=[di], outputCol="__x").transform(rows.dropna(subset=[di, error]))
    fit = IsotonicRegression(featuresCol="__x", labelCol=error, predictionCol="expected_error").fit(ready)
    return table, lambda new: fit.transform(VectorAssembler(inputCols=[di], outputCol="__x").transform(new)).drop("__x")


def check_residuals(predictions: DataFrame, target: str, x: str, y: str, alpha: float = 0.05) -> dict:
    """Spatial autocorrelation that a model leaves: none, mild below .3, else strong."""
    from ..functions.stats import normal_two_sided
    from .diagnosis import moran

    got = moran(predictions.select("row_id", F.col(x).alias("x"), F.col(y).alias("y"), (F.col(target) - F.col("prediction")).alias("v"))).first()
    p = normal_two_sided(got.z)
    found = got.i > 0.05 and p < alpha
    return {"i": got.i, "p": p, "verdict": "none" if not found else "mild" if got.i < 0.3 else "strong"}


def block_sizes(data: DataFrame, target: str, x: str, y: str, v: int = 5, n_sizes: int = 10, reach: float | None = None) -> DataFrame:
    """(size, score): mean |Moran's I| within the test folds of checkerboards of growing size; the least score is the best size."""
    from .diagnosis import moran
    from .folds import checkerboard

    x0, x1, y0, y1 = data.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    extent = max(x1 - x0, y1 - y0)
    low, high = max(0.5 * (reach or 0), extent / (4 * v)), min(3 * reach, extent / 2) if reach else extent / 2
    rows = []
    for i in range(n_sizes):
        size = low + (high - low) * i / max(n_sizes - 1, 1)
        folded = written(checkerboard(data, x, y, v, size).select("row_id", F.col(x).alias("x"), F.col(y).alias("y"), F.col(target).alias("v"), "fold"))
        n = {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()}
        if len(n) < v:
            continue
        scores = [abs(s.i) for k, c in n.items() if c >= 10 and (s := moran(folded.where(F.col("fold") == k).drop("fold")).first()).i is not None]
        if scores:
            rows.append((float(size), float(np.mean(scores))))
    return data.sparkSession.createDataFrame(rows, "size double, score double")
