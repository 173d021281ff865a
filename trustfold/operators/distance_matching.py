"""Folds whose test-to-train distances are like the distances from prediction places to the data.

``nndm_exclusions`` is nearest-neighbour distance matching: every row is tested alone, and rows around it are excluded until the nearest
training distances have the targets' distribution. The greedy rule lifts the least distance that is over-represented to the row's next
neighbour. Distances only grow and a distance that fits once fits for good, so the rule is one sweep over ascending distances: a row settles
at the first of its neighbours' distances where there is room, floor(n G(t)) rows up to t. G is constant between targets, so a row needs,
for every gap between targets (or between EDGES of their quantiles), its first and last neighbour in the gap and their number. These come from one
pass over pairs of tiles that are within the greatest target distance of each other. The sweep finds for each gap the distance up to which rows
settle, from a hashed sample of SWEPT rows (all rows, if they are fewer); every row then finds its own place, by windows over its gaps.

``knndm`` gives k folds: the best of a series of clusterings (of at most 2048 clusters) and of random folds, then rounds that move some rows at random
to other folds and are kept if distances fit better. Fit is the Kolmogorov-Smirnov statistic over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import global_position, hash_order, written
from .applicability import ks_statistic, nearest
from .neighbours import k_nearest, tile_boxes, z_tiles

EDGES = 128
SWEPT = 8192
TILE = 1024
#: Tiles whose rows meet a tile at once.
_TOGETHER = 64


def target_distances(data: DataFrame, targets: DataFrame, x: str, y: str) -> DataFrame:
    """(d): distance of each target to its nearest row."""
    spots = global_position(targets.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(), "x", "y", name="p")
    rows = data.select(F.struct(F.lit(0).alias("side"), F.col("row_id").cast("long").alias("id")).alias("row_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    new = spots.select(F.struct(F.lit(1).alias("side"), F.col("p").alias("id")).alias("row_id"), "x", "y")
    # Ids as text: a target's is never a row's.
    text = lambda d: d.withColumn("row_id", F.concat_ws(":", "row_id.side", "row_id.id"))
    return nearest(text(new), text(rows), ["x", "y"]).select("d")


def _gaps(goal: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending target distances, all of them or EDGES quantiles, and the share of targets up to each."""
    some = sorted({r.d for r in goal.select("d").distinct().limit(EDGES + 1).collect()})
    if len(some) > EDGES:
        some = sorted(set(goal.agg(F.percentile("d", [(i + 1) / EDGES for i in range(EDGES)])).first()[0]))
        some[-1] = goal.agg(F.max("d")).first()[0]
    share = goal.agg(*[F.avg((F.col("d") <= e).cast("double")).alias(f"e{i}") for i, e in enumerate(some)]).first()
    return np.array(some), np.array(list(share))


def neighbour_gaps(points: DataFrame, edges: np.ndarray) -> DataFrame:
    """points(id, x, y) to (id, gap, first, last, n): of each row's other rows up to the last edge, by the number of edges that are at most the distance."""
    far = float(edges[-1])
    placed, plane = z_tiles(points, TILE)
    if not plane:
        return points.select("id", F.lit(0).alias("gap"), F.lit(0.0).alias("first"), F.lit(0.0).alias("last"), F.lit(0).cast("long").alias("n"))
    sent = points.sparkSession.sparkContext.broadcast(tile_boxes(placed))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                tile, i, px, py = (batch.column(c).to_numpy() for c in range(4))
                dx = np.maximum(np.maximum(box["x_0"] - px[:, None], px[:, None] - box["x_1"]), 0)
                dy = np.maximum(np.maximum(box["y_0"] - py[:, None], py[:, None] - box["y_1"]), 0)
                who, to = np.nonzero(dx * dx + dy * dy <= far * far * (1 + 1e-9))
                part = (tile[who] // _TOGETHER).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (box["tile"][to].astype(np.int32), part, i[who], px[who], py[who])], names=["tile", "part", "id", "x", "y"])

    kinds = "tile int, part int, id bigint, x double, y double"
    near = placed.select("tile", "id", "x", "y").mapInArrow(visits, kinds)
    own = placed.select("tile", F.explode(F.sequence(F.lit(0), F.lit((plane.tiles - 1) // _TOGETHER))).alias("part"), "id", "x", "y")

    def count(key, a: pa.Table, b: pa.Table) -> pa.Table:
        ids, ax, ay = (a.column(c).to_numpy() for c in ("id", "x", "y"))
        others, bx, by = (b.column(c).to_numpy() for c in ("id", "x", "y"))
        out = []
        step = max(1, (1 << 21) // max(1, len(others)))
        for at in range(0, len(ids) if len(others) else 0, step):
            dx, dy = ax[at : at + step, None] - bx, ay[at : at + step, None] - by
            d = np.sqrt(dx * dx + dy * dy)
            d[ids[at : at + step, None] == others] = np.inf
            d.sort(axis=1)
            # By row, how many distances lie below each edge, and how many reach to the last one.
            upto = np.stack([np.searchsorted(row, edges, side="left") for row in d])
            inside = np.array([np.searchsorted(row, far, side="right") for row in d])
            ends = np.column_stack([upto, inside])
            starts = np.column_stack([np.zeros(len(d), np.int64), upto])
            who, gap = np.nonzero(ends > starts)
            out.append((ids[at + who], gap.astype(np.int32), d[who, starts[who, gap]], d[who, ends[who, gap] - 1], (ends - starts)[who, gap]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int32, np.float64, np.float64, np.int64))]
        return pa.table([pa.array(c) for c in columns], names=["id", "gap", "first", "last", "n"])

    parts = own.groupBy("tile", "part").cogroup(near.groupBy("tile", "part")).applyInArrow(count, "id bigint, gap int, first double, last double, n bigint")
    return parts.groupBy("id", "gap").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))


def _sweep(id_: np.ndarray, gap: np.ndarray, first: np.ndarray, final: np.ndarray, share: np.ndarray) -> list[float]:
    """By gap the greatest first distance at which rows settle; ``final`` marks a row's last allowed gap."""
    n, settled, out = len(np.unique(id_)), 0, []
    open_ = np.ones(int(id_.max()) + 1 if len(id_) else 0, bool)
    for g, room in enumerate(np.concatenate([[0.0], share])):
        here = (gap == g) & open_[id_]
        arrive = np.sort(first[here])
        free = min(len(arrive), max(0, math.floor(n * room + 1e-9) - settled))
        limit = math.inf if free == len(arrive) else float(arrive[free - 1]) if free else -math.inf
        done = here & ((first <= limit) | final)
        settled += int(done.sum())
        open_[id_[done]] = False
        out.append(limit)
    return out


def nndm_exclusions(data: DataFrame, targets: DataFrame, x: str = "x", y: str = "y", least: float = 0.5, phi: float | None = None) -> DataFrame:
    """(row_id, distance, n_excluded): training rows of a row's fold are the others at ``distance`` or more; the nearest is that far.

    At least ``least`` of the other rows stay (where several are equally far, n_excluded counts all but one of the last). ``phi`` bounds
    distances; it is the greatest target distance otherwise. Rows without coordinates have no fold; ids are whole numbers.
    """
    points = data.select(F.col("row_id").cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    points = written(points)
    n = points.count()
    if n < 3:
        raise ValueError("at least 3 rows")
    goal = written(target_distances(data, targets, x, y))
    if phi is not None:
        goal = goal.withColumn("d", F.least("d", F.lit(float(phi))))
    edges, share = _gaps(goal)
    most = n - 1 - max(1, math.ceil(least * (n - 1)))
    gaps = written(neighbour_gaps(points, edges))
    by = Window.partitionBy("id").orderBy("gap")
    walk = gaps.withColumn("before", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where((F.col("before") <= most) | (F.col("before") == 0))
    walk = written(walk.withColumn("final", F.lead("gap").over(by).isNull()))
    swept = walk.join(F.broadcast(points.select("id").orderBy(hash_order("id"), "id").limit(SWEPT)), "id", "left_semi").select("id", "gap", "first", "final").toPandas()
    ids = np.unique(swept["id"].to_numpy(), return_inverse=True)[1]
    limits = _sweep(ids, swept["gap"].to_numpy(), swept["first"].to_numpy(), swept["final"].to_numpy(bool), share)
    limit = F.element_at(F.array(*[F.lit(v) for v in limits]), F.col("gap") + 1)
    # A row that finds no room ends at the last neighbour that it may reach: all of its last gap, if the floor allows.
    whole = (F.col("before") + F.col("n") - 1) <= most
    here = F.col("first") <= limit
    place = F.struct(F.when(here | ~whole, F.col("first")).otherwise(F.col("last")).alias("distance"), (F.col("before") + F.when(here | ~whole, 0).otherwise(F.col("n") - 1)).alias("n_excluded"))
    found = walk.where(here | F.col("final")).groupBy("id").agg(F.min_by(place, "gap").alias("at")).select("id", "at.*")
    alone = points.join(found, "id", "left_anti")
    beyond = k_nearest(points.withColumnRenamed("id", "row_id"), 1).join(alone.select(F.col("id").alias("row_id")), "row_id").select(F.col("row_id").alias("id"), F.get("near", F.lit(0))["d"].alias("distance"), F.lit(0).cast("long").alias("n_excluded"))
    return found.unionByName(beyond).select(F.col("id").alias("row_id"), "distance", F.col("n_excluded").cast("long").alias("n_excluded"))


def nndm(data: DataFrame, targets: DataFrame, x: str = "x", y: str = "y", least: float = 0.5, phi: float | None = None) -> DataFrame:
    """The folds in long form: fold (a row's number), row_id, role. By definition that is a row for every pair of rows; see nndm_exclusions for one a row."""
    found = global_position(nndm_exclusions(data, targets, x, y, least, phi), "row_id", name="fold")
    rows = data.select("row_id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    tested = found.join(rows, "row_id").select(F.col("fold").cast("int").alias("fold"), F.col("row_id").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"), "distance")
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    role = F.when(F.col("row_id") == F.col("t"), "test").when(F.sqrt(dx * dx + dy * dy) >= F.col("distance"), "train")
    return rows.join(tested).withColumn("role", role).where("role is not null").select("fold", "row_id", "role")


def fold_distances(folded: DataFrame, x: str, y: str) -> DataFrame:
    """(row_id, d): distance of each row to the nearest row of another fold."""
    rows = folded.select("row_id", "fold", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return nearest(rows, rows, ["x", "y"], folds=True)


def moved(folded: DataFrame, goal: DataFrame, x: str, y: str, rounds: int = 8, seed: int = 42) -> tuple[DataFrame, float]:
    """Folds from ``folded``, and their fit to goal(d): a share of the rows, an eighth at first, goes to another fold at random.

    The round is kept if the distances fit better, else the next one moves a quarter as many, one row in the mean at least.
    """
    fit = lambda df: ks_statistic(fold_distances(df, x, y), goal, "d")
    v, n = folded.agg(F.max("fold"), F.count("*")).first()
    best, least, share = folded, fit(folded), 1 / 8
    for r in range(rounds if v > 1 else 0):
        bits = lambda what: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{r}:{what}"), F.col("row_id").cast("string"))), 1, 8), 16, 10).cast("long")  # noqa: B023, E731
        to = (F.col("fold") + bits("to") % (v - 1)) % v + 1
        got = written(best.withColumn("fold", F.when(bits("who") < math.ceil(max(share, 1 / n) * 2**32), to).otherwise(F.col("fold")).cast("int")))
        if got.select("fold").distinct().count() > 1 and (score := fit(got)) < least:
            best, least = got, score
        else:
            share /= 4
    return best, least


def knndm(data: DataFrame, targets: DataFrame, x: str = "x", y: str = "y", v: int = 5, tries: int = 20, seed: int = 42, moves: int = 8) -> DataFrame:
    """``data`` with fold: k-fold nearest-neighbour distance matching. The best of ``tries`` clusterings from coarse to fine and of random folds is the start of ``moves`` rounds."""
    from .folds import _clusters, _clusters_to_folds, random_folds

    data = written(data)
    n = data.count()
    goal = written(target_distances(data, targets, x, y))
    best, least = written(random_folds(data, v, seed)), math.inf
    for k in sorted({min(2048, max(v, round(v * (n / v) ** (t / max(tries - 1, 1))))) for t in range(tries)} | {n}, reverse=True):
        got = best if k == n else written(random_folds(data, v, seed) if k >= n // 2 else _clusters_to_folds(_clusters(data, [x, y], k, seed), v))
        if got.select("fold").distinct().count() > 1 and (score := ks_statistic(fold_distances(got, x, y), goal, "d")) < least:
            best, least = got, score
    return moved(best, goal, x, y, moves, seed)[0] if least < math.inf else best
