"""Mixing sources to target weights by iterative proportional fitting (native DataFrame code only).

Documents are counted in cells of source x language x topic with their token totals. Raking scales
the cells' token weights in turn to the target marginals of each dimension until they agree. A
document is then kept with a calibrated probability, its cell's weight times a common scale chosen so
that the expected number of kept tokens is the budget and no probability exceeds one.

Target marginals may be given; else they are tempered: the share of a value is proportional to its
token share to the power ``alpha``, as used to lift small sources.

Defined cases: null source, language or topic is a value of its own, a null or empty text has no
tokens and weight zero: it is kept, as it costs nothing. Very long texts are counted whole. Repeated rows count as often as they occur, ties do
not matter as the draw depends only on doc_id; a null doc_id draws as the string "null". Extra
columns pass through. An empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

DIMS = ("mix_source", "mix_lang", "mix_topic")


def token_count(text: Column) -> Column:
    """Words between spaces, tabs and line ends."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A plain stand-in topic from a text's form: table, list or prose by length."""
    n = F.coalesce(F.length(text), F.lit(0))
    return (
        F.when(n == 0, "empty")
        .when(F.instr(text, " | ") > 0, "table")
        .when(F.instr(text, "### ") > 0, "markup")
        .when(n < 1000, "short")
        .when(n < 4000, "medium")
        .otherwise("long")
    )


def unit_draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the id alone: 52 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def tempered(cells: DataFrame, dim: str, alpha: float) -> DataFrame:
    """Target share of each value of ``dim``."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where(F.col("t") > 0)
    total = sums.agg(F.sum(F.pow("t", F.lit(alpha)))).first()[0] or 1.0
    return sums.select(dim, (F.pow("t", F.lit(alpha)) / F.lit(float(total))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 12, tolerance: float = 1e-11) -> DataFrame:
    """Add ``weight`` to cells(dims..., tokens): a share of the mix, with the target marginals.

    Each step scales the cells of a value by its target over the sum of their weights, a window over cells (not documents). A round is
    written out, and its predecessor deleted. It ends when a round changes no weight by more than ``tolerance`` of
    itself, and warns if that is not reached. A value without a target gets none of the mix.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumns({"weight": F.col("tokens") / F.lit(float(total)), "moved": F.lit(0.0)})
    for dim, target in targets.items():
        goal = target.select(F.col(dim).alias("__value"), F.col("target").alias(f"__goal_{dim}"))
        out = out.join(goal, F.col(dim).eqNullSafe(F.col("__value")), "left").drop("__value")
    out = written(out)
    moved = 0.0
    for _ in range(rounds):
        before, out = out, out.withColumn("moved", F.lit(0.0))
        for dim in targets:
            now = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("__factor", F.when(now > 0, F.coalesce(f"__goal_{dim}", F.lit(0.0)) / now).otherwise(0.0))
            change = F.when(F.col("weight") > 0, F.abs(F.col("__factor") - 1)).otherwise(0.0)
            out = out.withColumns({"moved": F.greatest("moved", change), "weight": F.col("weight") * F.col("__factor")})
        out = written(out.drop("__factor"))
        discard(before)
        moved = out.agg(F.max("moved")).first()[0] or 0.0
        if moved <= tolerance:
            break
    else:
        warnings.warn(f"the last of {rounds} rounds still moved a weight by {moved:.2g} of itself", stacklevel=2)
    return out.drop("moved", *[f"__goal_{d}" for d in targets])


def mix(
    docs: DataFrame,
    keep_share: float = 0.5,
    alpha: float = 0.5,
    rounds: int = 12,
    seed: int = 17,
    topic: Column | None = None,
    targets: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Documents with n_tokens, topic, mix_weight (of the cell), mix_prob and mix_keep.

    keep_share: share of all tokens in the expected sample. Probabilities are calibrated: cells
    whose probability would pass one are kept whole and the rest is scaled up, a fixed number of times.
    """
    added = docs.withColumns(
        {
            "n_tokens": token_count(F.col("text")),
            "mix_source": F.col("source"),
            "mix_lang": F.col("lang"),
            "mix_topic": topic_of(F.col("text")) if topic is None else topic,
        }
    )
    cells = written(added.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")))
    goals = {d: (targets or {}).get(d) for d in DIMS}
    goals = {d: written(tempered(cells, d, alpha)) if g is None else g for d, g in goals.items()}
    raked = rake(cells, goals, rounds)
    calibrated = written(calibrate(raked, keep_share))
    hold = [F.col(d).eqNullSafe(F.col(f"c_{d}")) for d in DIMS]
    side = calibrated.select(*[F.col(d).alias(f"c_{d}") for d in DIMS], F.col("weight").alias("mix_weight"), "mix_prob")
    return (
        added.join(side, reduce(Column.__and__, hold), "left")
        .drop(*[f"c_{d}" for d in DIMS])
        .withColumn("mix_prob", F.when(F.col("n_tokens") == 0, 1.0).otherwise(F.col("mix_prob")))
        .withColumn("mix_keep", unit_draw(F.col("doc_id"), seed) < F.round("mix_prob", 9))
    )


def calibrate(cells: DataFrame, keep_share: float, passes: int = 6) -> DataFrame:
    """Add mix_prob = min(1, scale * weight / token share), with the scale that meets the budget.

    Every pass sums the cells to two numbers: the tokens of cells that are kept whole, and the
    expected tokens of the others, which are scaled up to what is still wanted.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / (F.col("tokens") / F.lit(total))).otherwise(0.0)
    out = cells.withColumn("mix_prob", F.least(F.lit(1.0), ratio * F.lit(keep_share)))
    full = F.col("mix_prob") >= 1.0
    for _ in range(passes):
        whole, part = out.agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("mix_prob")))
        ).first()
        if not part:
            break
        up = max(1.0, (keep_share * total - whole) / part)
        out = out.withColumn("mix_prob", F.when(full, 1.0).otherwise(F.least(F.lit(1.0), F.col("mix_prob") * F.lit(up))))
    return out
