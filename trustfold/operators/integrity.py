"""Checks of a split: the rows of ``data`` carry ``row_id`` and ``role`` (train, test or null).

Nulls: a null id, group or time takes no part. Every check is an aggregate or a semi-join over the roles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import correlation

class HardViolation(ValueError):
    """A split that must not be used."""


def index_overlap(train: DataFrame, test: DataFrame, key: str = "row_id") -> DataFrame:
    """Every test row whose id is a training id."""
    return test.join(train.select(key).distinct(), key, "left_semi")


def index_bounds(split: DataFrame, data: DataFrame, key: str = "row_id") -> DataFrame:
    """Split rows without a row in the data."""
    return split.join(data.select(key), key, "left_anti")


def duplicate_rows(data: DataFrame, columns: list[str] | None = None, role: str = "role") -> DataFrame:
    """Test rows equal to some training row in all numeric columns (or in all columns, where none is numeric).

    Null equals null and NaN equals NaN.
    """
    if columns is None:
        numeric = [c for c, t in data.dtypes if t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal")]
        columns = [c for c in numeric if c not in ("row_id", role)] or [c for c in data.columns if c not in ("row_id", role)]
    train = data.where(F.col(role) == "train").select(*[F.col(c).alias(f"t_{c}") for c in columns]).distinct()
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in columns])
    return data.where(F.col(role) == "test").join(train, same, "left_semi")


def temporal_order(data: DataFrame, time: str, role: str = "role") -> tuple[DataFrame, object]:
    """Test rows strictly before the last training time, and that time."""
    last = data.where(F.col(role) == "train").agg(F.max(time)).first()[0]
    return data.where((F.col(role) == "test") & (F.col(time) < F.lit(last))), last


def group_overlap(data: DataFrame, group: str, role: str = "role") -> DataFrame:
    """Groups on both sides, with the number of their test rows."""
    is_test = F.col(role) == "test"
    return (
        data.where(F.col(group).isNotNull() & F.col(role).isin("train", "test"))
        .groupBy(group)
        .agg(F.count_if(is_test).alias("n_test"), F.count_if(~is_test).alias("n_train"))
        .where("n_test > 0 and n_train > 0")
    )


def correlations(data: DataFrame, target: str, features: list[str], role: str | None = "role") -> DataFrame:
    """feature, r, n over complete training pairs; r is null for fewer than two pairs or no variance. One scan."""
    rows = data.where(F.col(role) == "train") if role else data
    y = F.col(target).cast("double")
    out = []
    for f in features:
        x = F.col(f).cast("double")
        both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
        a, b = F.when(both, x), F.when(both, y)
        out += [correlation(a, b).alias(f"r_{f}"), F.count_if(both).alias(f"n_{f}")]
    stats = rows.agg(*out)
    items = ", ".join(f"'{f}', `r_{f}`, `n_{f}`" for f in features)
    return stats.selectExpr(f"stack({len(features)}, {items}) as (feature, r, n)")


def correlation_leaks(data: DataFrame, target: str, features: list[str], role: str | None = "role") -> DataFrame:
    """feature, r, type, severity of features that give the target away."""
    r = F.abs("r")
    return (
        correlations(data, target, features, role)
        .withColumn("type", F.when(r > 0.99, "target_leakage_direct").when(r >= 0.95, "target_leakage_proxy"))
        .withColumn("severity", F.when(r > 0.99, "hard_violation").when(r >= 0.95, "soft_inflation"))
        .where("type is not null")
        .select("feature", "r", "type", "severity")
    )


def cell_neighbours(points: DataFrame, x: str, y: str, radius: float) -> tuple[DataFrame, DataFrame]:
    """Points keyed by their cell of side ``radius``, and keyed by it and the eight cells around it."""
    cx, cy = F.floor(F.col(x) / radius), F.floor(F.col(y) / radius)
    around = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    home = points.withColumns({"cx": cx, "cy": cy})
    near = points.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"cx": cx + F.col("dx"), "cy": cy + F.col("dy")}).drop("dx", "dy")
    return home, near


def within_radius(left: DataFrame, right: DataFrame, radius: float, key: str = "row_id", x: str = "x", y: str = "y") -> DataFrame:
    """(left key, right key, d) of all pairs at a distance of at most ``radius``: an equi-join on grid cells."""
    home, _ = cell_neighbours(left.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay")), "ax", "ay", radius)
    _, near = cell_neighbours(right.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by")), "bx", "by", radius)
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    return home.join(near, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).select("a", "b", "d")


def spatial_proximity(data: DataFrame, x: str = "x", y: str = "y", share: float = 0.01, role: str = "role") -> DataFrame:
    """Test rows nearer to a training row than ``share`` of the training spread, with that distance."""
    train = data.where(F.col(role) == "train")
    spread = train.agg(F.sqrt(F.var_samp(x) + F.var_samp(y))).first()[0]
    if not spread:
        return data.where("false").select("row_id", F.lit(0.0).alias("d"))
    near = within_radius(data.where(F.col(role) == "test"), train, share * spread, x=x, y=y).where(F.col("d") < share * spread)
    return near.groupBy(F.col("a").alias("row_id")).agg(F.min("d").alias("d"))


def convex_hull(points: DataFrame, x: str = "x", y: str = "y") -> list[tuple[float, float]]:
    """Hull of all points: of each partition on the executors, then of those hulls' corners."""

    def corners(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
        pts = sorted(set(pts))
        if len(pts) < 3:
            return pts
        chains = []
        for order in (pts, pts[::-1]):
            chain: list[tuple[float, float]] = []
            for p in order:
                while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                    chain.pop()
                chain.append(p)
            chains += chain[:-1]
        return chains

    def partial(frames):
        import pandas as pd

        held: list[tuple[float, float]] = []
        for f in frames:
            held = corners([*held, *zip(f["x"], f["y"])])
        yield pd.DataFrame(held, columns=["x", "y"])

    clean = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return corners([(r.x, r.y) for r in clean.mapInPandas(partial, "x double, y double").collect()])


def inside_polygon(polygon: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd ray casting as an expression over a literal array of edges."""
    edges = [(a, b) for a, b in zip(polygon, [*polygon[1:], polygon[0]]) if a[1] != b[1]]
    if not edges:
        return F.lit(False)
    items = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*a, *b))]) for a, b in edges])
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter(items, crosses)) % 2 == 1


def spatial_overlap(data: DataFrame, x: str = "x", y: str = "y", role: str = "role") -> float | None:
    """Share of test rows inside the training rows' convex hull; null with fewer than three corners."""
    hull = convex_hull(data.where(F.col(role) == "train"), x, y)
    if len(hull) < 3:
        return None
    inside = inside_polygon(hull, F.col(x), F.col(y)).cast("double")
    return data.where(F.col(role) == "test").agg(F.avg(inside)).first()[0]


def validate_split(data: DataFrame, split: DataFrame, time: str | None = None, group: str | None = None) -> None:
    """Raise HardViolation for an unusable split(row_id, role) of ``data``."""
    if not index_bounds(split, data).isEmpty():
        raise HardViolation("HARD VIOLATION: the split names rows that the data lacks")
    train, test = split.where("role = 'train'"), split.where("role = 'test'")
    n = index_overlap(train, test).count()
    if n:
        raise HardViolation(f"HARD VIOLATION: train and test overlap in {n} rows")
    rows = data.join(split, "row_id")
    if group is not None and (n := group_overlap(rows, group).count()):
        raise HardViolation(f"HARD VIOLATION: {n} groups are in train and test")
    if time is not None and not temporal_order(rows, time)[0].isEmpty():
        raise HardViolation("HARD VIOLATION: test rows lie before the last training time")
