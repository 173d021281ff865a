"""Connected components over link tables, by alternating large-star and small-star steps.

Every step is joins and map-side-combined aggregates over links, so nothing is collected, and the
number of rounds grows with the logarithm of a component's size, not with its diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _relink(pairs: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """pairs(u, v): add ``m``, the least of u and its v. The table that it writes goes to ``spent``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("m"))
    # Written first, so that both sides of the join are dealt out anew and the links of a hub can be split.
    spent.append(written(least))
    return pairs.join(spent[-1], F.col("u") == F.col("w")).drop("w")


def _large_star(links: DataFrame, spent: list[DataFrame]) -> DataFrame:
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _relink(both, spent).where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame, spent: list[DataFrame]) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _relink(down, spent)
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionAll(moved.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(u bigint, v bigint) to (node, component): the least id reachable. Unlinked ids have no row.

    Null ends and loops are ignored, repeats and either direction are fine, no links give no rows.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        spent = [now]
        now = written(_small_star(_large_star(now, spent), spent))
        discard(*spent)
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
