"""Diagnosis of spatial, temporal and clustered dependence."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import epoch, global_position, hash_order, written
from ..functions.stats import chi2_survival_even, normal_two_sided

#: Rows in a pair table; more are sampled by hash, as pairs grow with the square.
PAIR_ROWS = 2000
EARTH_M = 6_371_000.0


def planar(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def pair_sample(points: DataFrame, seed: int = 42) -> DataFrame:
    """Complete rows of (row_id, x, y[, v]); at most PAIR_ROWS, those with the least hashes."""
    complete = points.dropna()
    return written(complete.orderBy(hash_order("row_id", seed=seed), "row_id").limit(PAIR_ROWS))


def pairs(sample: DataFrame, geographic: bool = False) -> DataFrame:
    """Ordered pairs (i, j, d[, vi, vj]) of a bounded sample; one side is broadcast, PAIR_ROWS rows at most."""
    side = lambda s: sample.select(*[F.col(c).alias(f"{c}_{s}") for c in sample.columns])
    d = (haversine if geographic else planar)(F.col("x_i"), F.col("y_i"), F.col("x_j"), F.col("y_j"))
    # The sample is one partition; its pairs are made in all tasks.
    tasks = max(1, int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return side("i").repartition(tasks).join(F.broadcast(side("j")), F.col("row_id_i") != F.col("row_id_j")).withColumn("d", d)


def moran(points: DataFrame, geographic: bool = False) -> DataFrame:
    """points(row_id, x, y, v) to one row: n, i, expected, variance, z.

    Row-standardised inverse-distance weights and the variance under randomisation.
    """
    sample = pair_sample(points.select("row_id", "x", "y", "v"))
    stats = sample.agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    centred = sample.join(F.broadcast(stats.select("m"))).withColumn("v", F.col("v") - F.col("m")).drop("m")
    weights = pairs(centred, geographic).withColumn("w", 1 / (F.col("d") + 1e-10))
    rows = weights.groupBy("row_id_i").agg(F.sum("w").alias("s"))
    other = rows.select(F.col("row_id_i").alias("row_id_j"), F.col("s").alias("s_j"))
    standard = weights.join(F.broadcast(rows), "row_id_i").join(F.broadcast(other), "row_id_j")
    standard = standard.withColumns({"wij": F.col("w") / F.col("s"), "wji": F.col("w") / F.col("s_j")})
    sums = standard.agg(F.sum(F.col("wij") * F.col("v_i") * F.col("v_j")).alias("num"), F.sum("wij").alias("s0"), (F.sum(F.pow(F.col("wij") + F.col("wji"), 2)) / 2).alias("s1"))
    s2 = standard.groupBy("row_id_j").agg(F.sum("wij").alias("c")).agg(F.sum(F.pow(1 + F.col("c"), 2)).alias("s2"))
    power = centred.agg(F.sum(F.pow("v", 2)).alias("m2"), F.sum(F.pow("v", 4)).alias("m4"), F.count("*").cast("double").alias("n"))
    n, s0, s1, k = F.col("n"), F.col("s0"), F.col("s1"), F.col("k")
    joined = power.join(sums).join(s2).withColumn("k", F.col("n") * F.col("m4") / F.pow("m2", 2))
    upper = n * ((n * n - 3 * n + 3) * s1 - n * F.col("s2") + 3 * s0 * s0) - k * ((n * n - n) * s1 - 2 * n * F.col("s2") + 6 * s0 * s0)
    lower = (n - 1) * (n - 2) * (n - 3) * s0 * s0
    expected = -1 / (n - 1)
    return (
        joined.withColumn("i", n / s0 * F.col("num") / F.col("m2"))
        .withColumn("expected", expected)
        .withColumn("variance", F.greatest(F.lit(1e-10), upper / lower - expected * expected))
        .withColumn("z", (F.col("i") - F.col("expected")) / F.sqrt("variance"))
        .select(n.cast("long").alias("n"), "i", "expected", "variance", "z")
    )


def variogram(points: DataFrame, bins: int = 15, geographic: bool = False) -> DataFrame:
    """points(row_id, x, y, v) to bin, distance, gamma, n over quantile bins of the pair distances, (a, b] and the first closed."""
    both = written(pairs(pair_sample(points.select("row_id", "x", "y", "v")), geographic).where("row_id_i < row_id_j").select("d", (F.pow(F.col("v_i") - F.col("v_j"), 2) / 2).alias("g")))
    total = both.count()
    bins = min(bins, total // 50)
    if bins < 3:
        return both.sparkSession.createDataFrame([], "bin int, distance double, gamma double, n bigint")
    breaks = sorted(set(both.agg(F.percentile("d", [k / bins for k in range(bins + 1)])).first()[0]))
    place = F.lit(len(breaks) - 1)
    for k in range(len(breaks) - 2, 0, -1):
        place = F.when(F.col("d") <= breaks[k], k).otherwise(place)
    return both.groupBy(place.cast("int").alias("bin")).agg(F.avg("d").alias("distance"), F.avg("g").alias("gamma"), F.count("*").alias("n"))


def spatial_range(bins: DataFrame) -> DataFrame:
    """One row: the distance of the first bin that reaches 95 % of the largest gamma."""
    top = bins.agg(F.max("gamma").alias("top"))
    return bins.join(F.broadcast(top)).where(F.col("gamma") >= 0.95 * F.col("top")).agg(F.min_by("distance", "bin").alias("spatial_range"))


def effective_n(n: int, rho: float | None) -> float:
    rho = min(1.0, max(0.0, rho or 0.0))
    return float(n) if rho < 0.05 else max(10.0, n * (1 - rho**2) / (1 + rho**2))


def lagged(series: DataFrame, lags: int, block: int = 100_000) -> DataFrame:
    """series(pos, v), positions from 1 without gaps, to (pos, v, l_1 ... l_lags).

    Blocks of positions are windowed side by side; each also holds the ``lags`` rows before it.
    """
    home = F.floor((F.col("pos") - 1) / block)
    spill = F.floor((F.col("pos") - 1 + lags) / block)
    rows = series.withColumn("blk", F.explode(F.array_distinct(F.array(home, spill))))
    from pyspark.sql.window import Window

    w = Window.partitionBy("blk").orderBy("pos")
    return rows.select("*", *[F.lag("v", k).over(w).alias(f"l_{k}") for k in range(1, lags + 1)]).where(F.col("blk") == home).drop("blk")


def autocorrelation(series: DataFrame, lags: int = 20) -> DataFrame:
    """series(pos, v) to (lag, acf, n): full-series mean and divisor n."""
    total = series.agg(F.avg("v"), F.sum(F.lit(1)), F.var_pop("v")).first()
    mean, n, var = total[0], total[1] or 0, total[2]
    lags = min(lags, max(n - 1, 1))
    if not n or not var:
        return series.sparkSession.createDataFrame([], "lag int, acf double, n bigint")
    sums = lagged(series.select("pos", "v"), lags).agg(*[F.sum((F.col("v") - mean) * (F.col(f"l_{k}") - mean)).alias(f"s_{k}") for k in range(1, lags + 1)])
    items = ", ".join(f"{k}, s_{k}" for k in range(1, lags + 1))
    return sums.selectExpr(f"stack({lags}, {items}) as (lag, s)").select("lag", (F.col("s") / F.lit(var * n)).alias("acf"), F.lit(n).cast("long").alias("n"))


def ljung_box(acf: DataFrame, lag: int = 10) -> DataFrame:
    """One row: q over the first ``lag`` lags, and n."""
    n = F.col("n")
    return acf.where(F.col("lag") <= lag).agg(F.sum(n * (n + 2) * F.pow("acf", 2) / (n - F.col("lag"))).alias("q"), F.max("n").alias("n"))


def intraclass(data: DataFrame, group: str, value: str) -> DataFrame:
    """One row of the one-way analysis of variance: k, n, m (mean size), msb, msw, icc_raw, icc (within 0 and 1), deff."""
    v = F.col(value).cast("double")
    clean = data.where(F.col(group).isNotNull() & v.isNotNull() & ~F.isnan(v))
    by = clean.groupBy(F.col(group).alias("of_group")).agg(F.count("*").alias("c"), F.avg(v).alias("a"), F.var_pop(v).alias("p"))
    tot = by.agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.try_divide(F.sum(F.col("c") * F.col("a")), F.sum("c")).alias("grand"), F.sum(F.col("c") * F.col("p")).alias("ssw"))
    ssb = by.join(F.broadcast(tot.select("grand"))).agg(F.sum(F.col("c") * F.pow(F.col("a") - F.col("grand"), 2)).alias("ssb"))
    k, n = F.col("k"), F.col("n")
    return (
        tot.join(ssb)
        .withColumns({"m": F.try_divide(n, k), "msb": F.when(k > 1, F.col("ssb") / (k - 1)), "msw": F.when(n > k, F.col("ssw") / (n - k))})
        .withColumn("icc_raw", F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("m") - 1) * F.col("msw")))
        .withColumn("icc", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("icc_raw"))))
        .withColumn("deff", 1 + (F.col("m") - 1) * F.col("icc"))
        .select("k", "n", "m", "msb", "msw", "icc_raw", "icc", "deff")
    )


def severity(moran_i: Column | None = None, acf1: Column | None = None, icc: Column | None = None) -> Column:
    """severe, moderate or none; a null value is an axis where nothing was detected."""
    levels = []
    for value, limit in ((moran_i, 0.5), (acf1, 0.7), (icc, 0.3)):
        if value is not None:
            levels.append(F.when(F.abs(value) > limit, 2).when(value.isNotNull(), 1).otherwise(0))
    top = F.greatest(*levels) if len(levels) > 1 else levels[0] if levels else F.lit(0)
    return F.when(top == 2, "severe").when(top == 1, "moderate").otherwise("none")


def strategy(spatial: bool, temporal: bool, clustered: bool) -> str:
    if spatial and temporal:
        return "spatial_temporal"
    if spatial and clustered:
        return "spatial_group"
    if temporal and clustered:
        return "temporal_group"
    return "spatial_block" if spatial else "temporal_block" if temporal else "group_fold" if clustered else "random"


def inflation(n: int, n_eff: float | None = None, moran_i: float | None = None, acf1: float | None = None, deff: float | None = None, icc: float | None = None) -> dict | None:
    """Expected optimism of a random split: the largest axis and half the others, 0.6 at most."""
    parts = []
    if moran_i is not None:
        parts.append(0.5 * max(0.0, 1 - n_eff / n) if n_eff is not None else 0.4 * moran_i)
    if acf1 is not None:
        parts.append(0.35 * abs(acf1))
    if deff is not None:
        parts.append(0.4 * (deff - 1) / deff)
    elif icc is not None:
        parts.append(0.3 * icc)
    if not parts:
        return None
    total = min(0.6, max(parts) + 0.5 * (sum(parts) - max(parts)))
    return {"auc_inflation": total, "rmse_deflation": 0.8 * total, "confidence": "medium" if moran_i is not None and n_eff is None else "high"}


@dataclass(frozen=True)
class Diagnosis:
    dependency: str
    severity: str
    recommended: str
    n: int
    spatial: dict = field(default_factory=dict)
    temporal: dict = field(default_factory=dict)
    clustered: dict = field(default_factory=dict)
    inflation: dict | None = None

    def rows(self) -> list[tuple]:
        """One row an axis: (axis, detected, statistic, p)."""
        return [(a, bool(d.get("detected")), d.get("statistic"), d.get("p")) for a, d in (("spatial", self.spatial), ("temporal", self.temporal), ("clustered", self.clustered)) if d]


def diagnose_spatial(data: DataFrame, x: str, y: str, target: str | None, alpha: float = 0.05, geographic: bool = False) -> dict:
    points = data.select("row_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(target).cast("double") if target else F.lit(0.0)).alias("v"))
    if points.dropna().limit(10).count() < 10:
        return {"detected": False}
    if target is None:
        both = pairs(pair_sample(points), geographic)
        nearest, most = both.groupBy("row_id_i").agg(F.min("d").alias("d"), F.max("d").alias("m")).agg(F.median("d"), F.max("m")).first()
        return {"detected": bool(most) and nearest / most < 0.05, "statistic": nearest / most if most else None}
    got = moran(points, geographic).first()
    p = normal_two_sided(got.z) if got.i is not None else None
    bins = variogram(points, geographic=geographic)
    reach = spatial_range(bins).first()[0]
    if reach is None:
        reach = pairs(pair_sample(points), geographic).agg(F.max("d") / 3).first()[0]
    found = p is not None and p < alpha and got.i > 0.1
    return {"detected": found, "statistic": got.i, "p": p, "range": reach, "n_eff": effective_n(got.n, got.i) if found else None}


def diagnose_temporal(data: DataFrame, time: str, target: str | None, alpha: float = 0.05) -> dict:
    kind = dict(data.dtypes)[time]
    timed = data.select("row_id", epoch(F.col(time), kind).alias("t"), (F.col(target).cast("double") if target else F.lit(0.0)).alias("v")).dropna()
    series = written(global_position(timed, "t", "row_id"))
    n = series.count()
    if n < 20:
        return {"detected": False}
    gaps = lagged(series.select("pos", F.col("t").alias("v")), 1).select((F.col("v") - F.col("l_1")).alias("gap")).dropna()
    median, mean, sd = gaps.agg(F.median("gap"), F.avg("gap"), F.stddev_samp("gap")).first()
    if target is None:
        return {"detected": bool(mean) and sd / mean > 1, "statistic": sd / mean if mean else None, "embargo": median}
    acf = {r.lag: r.acf for r in autocorrelation(series.select("pos", "v"), 20).collect()}
    if not acf:
        return {"detected": False}
    q = sum(n * (n + 2) * acf[k] ** 2 / (n - k) for k in range(1, 11))
    p = chi2_survival_even(q, 10)
    reach = next((k for k in sorted(acf) if abs(acf[k]) < 2 / math.sqrt(n)), max(acf))
    return {"detected": p < alpha and abs(acf[1]) > 0.2, "statistic": acf[1], "p": p, "lag": reach, "embargo": float(math.ceil(reach * median))}


def diagnose_clustered(data: DataFrame, group: str, target: str | None) -> dict:
    sizes = data.where(F.col(group).isNotNull()).groupBy(group).count().agg(F.count("*"), F.max("count")).first()
    if sizes[0] < 3:
        return {"detected": True, "statistic": None}
    if sizes[1] == 1:
        return {"detected": False}
    numeric = [target] if target else [c for c, t in data.dtypes if t in ("int", "bigint", "float", "double") and c not in ("row_id", group)]
    got = [r for c in numeric if (r := intraclass(data, group, c).first()).icc is not None]
    if not got:
        return {"detected": False}
    icc = sum(r.icc for r in got) / len(got)
    return {"detected": icc > 0.05, "statistic": icc, "deff": 1 + (got[0].m - 1) * icc, "clusters": sizes[0]}


def diagnose(data: DataFrame, coords: tuple[str, str] | None = None, time: str | None = None, group: str | None = None, target: str | None = None, alpha: float = 0.05, geographic: bool = False) -> Diagnosis:
    """Run the detectors for which roles are given; ``data`` has a unique row_id."""
    n = data.count()
    if n < 10:
        raise ValueError("at least 10 rows are needed")
    s = diagnose_spatial(data, *coords, target, alpha, geographic) if coords else {}
    t = diagnose_temporal(data, time, target, alpha) if time else {}
    c = diagnose_clustered(data, group, target) if group else {}
    on = [bool(d.get("detected")) for d in (s, t, c)]
    worst = [2 if abs(d.get("statistic") or 0) > limit else 1 for d, limit, found in ((s, 0.5, on[0]), (t, 0.7, on[1]), (c, 0.3, on[2])) if found]
    level = {0: "none", 1: "moderate", 2: "severe"}[max(worst, default=0)]
    names = [a for a, found in zip(("spatial", "temporal", "clustered"), on) if found]
    lost = inflation(n, s.get("n_eff") if on[0] else None, s.get("statistic") if on[0] else None, t.get("statistic") if on[1] else None, c.get("deff") if on[2] else None, c.get("statistic") if on[2] else None)
    return Diagnosis("mixed" if len(names) > 1 else names[0] if names else "none", level, strategy(*on), n, s, t, c, lost)


def power(d: Diagnosis, effect: float = 0.5, alpha: float = 0.05, wanted: float = 0.8) -> dict:
    """Design effect of the found dependence, effective rows, power of a two-sample comparison and least detectable effect."""
    deff = 1.0
    if d.spatial.get("detected"):
        rho = min(0.99, d.spatial["statistic"] or 0)
        deff *= d.n / d.spatial["n_eff"] if d.spatial.get("n_eff") else (1 + rho) / (1 - rho)
    if d.temporal.get("detected"):
        rho = min(0.99, abs(d.temporal["statistic"] or 0))
        deff *= (1 + rho) / (1 - rho)
    if d.clustered.get("detected"):
        deff *= d.clustered.get("deff") or 1.0
    deff = max(1.0, min(deff, d.n / 10))
    n_eff, normal = d.n / deff, NormalDist()
    z, root = normal.inv_cdf(1 - alpha / 2), math.sqrt(n_eff / 4)
    got = normal.cdf(effect * root - z) + normal.cdf(-effect * root - z)
    return {"n": d.n, "design_effect": deff, "n_effective": n_eff, "power": got, "min_effect": (z + normal.inv_cdf(wanted)) / root, "sufficient": n_eff >= 20}
