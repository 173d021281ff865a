import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.operators import distance_matching as D
from trustfold.operators import neighbours


def ks(a, b):
    a, b = np.sort(a), np.sort(b)
    v = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, v, side="right") / len(a) - np.searchsorted(b, v, side="right") / len(b)).max()


def clustered(seed, per=10):
    rng = np.random.default_rng(seed)
    xy = np.concatenate([c + rng.normal(size=(per, 2)) * 2 for c in rng.uniform(10, 90, (6, 2))])
    grid = np.stack(np.meshgrid(np.arange(0, 101, 10), np.arange(0, 101, 10)), -1).reshape(-1, 2).astype(float)
    return xy, grid


def frames(spark, xy, grid):
    df = lambda a: spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(a)], "row_id long, x double, y double")
    return df(xy), df(grid)


def greedy(xy, grid, least=0.5):
    """The rule itself: always lift the least over-represented distance to the row's next neighbour."""
    n = len(xy)
    target = np.sort(np.sqrt(((grid[:, None] - xy) ** 2).sum(-1)).min(1))
    far = np.sqrt(((xy[:, None] - xy) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    near, keep = np.sort(far, axis=1), max(1, math.ceil(least * (n - 1)))
    skip, d = np.zeros(n, int), near[:, 0].copy()
    heap = [(v, i) for i, v in enumerate(d)]
    heapq.heapify(heap)
    while heap:
        v, i = heapq.heappop(heap)
        more = skip[i] + 1
        if n - 1 - more >= keep and near[i, more] <= target[-1] and (d <= v).mean() > np.searchsorted(target, v, side="right") / len(target):
            skip[i], d[i] = more, near[i, more]
            heapq.heappush(heap, (d[i], i))
    return d, far, target


@pytest.mark.parametrize("seed", [0, 2])
def test_exclusions_follow_the_greedy_rule(spark, monkeypatch, seed):
    monkeypatch.setattr(D, "TILE", 16)
    monkeypatch.setattr(D, "_TOGETHER", 2)
    xy, grid = clustered(seed)
    want, far, target = greedy(xy, grid)
    got = {r.row_id: r for r in D.nndm_exclusions(*frames(spark, xy, grid)).collect()}
    assert len(got) == len(xy)
    for i, r in got.items():
        inside = int((far[i] < r.distance).sum())
        assert r.n_excluded == inside <= 59 - 30  # the floor of half the other rows
        assert abs(np.where(far[i] >= r.distance, far[i], np.inf).min() - r.distance) < 1e-9  # a neighbour is just that far
    d = np.array([got[i].distance for i in range(len(xy))])
    # Rows that find no room stop at the first, not the last, neighbour of the gap in which they reach the floor.
    assert ks(d, target) <= ks(want, target) + 0.03 < ks(np.min(far, axis=1), target) - 0.3
    settled = np.isclose(d, want)
    assert settled.mean() > 0.6  # rows that find no room may stop elsewhere below the floor


def test_long_form_is_leave_one_out(spark):
    xy, grid = clustered(1)
    data, targets = frames(spark, xy, grid)
    got = D.nndm(data, targets)
    by = {r.fold: r for r in got.groupBy("fold").agg(F.count_if(F.col("role") == "test").alias("t"), F.count_if(F.col("role") == "train").alias("n"), F.countDistinct("row_id").alias("ids")).collect()}
    want = {r.row_id: r.n_excluded for r in D.nndm_exclusions(data, targets).collect()}
    assert len(by) == 60 and all(r.t == 1 and r.ids == r.t + r.n for r in by.values())
    assert sorted(r.n for r in by.values()) == sorted(59 - n for n in want.values())


def test_a_bound_on_distances_few_rows_and_nulls(spark):
    xy, grid = clustered(3)
    data, targets = frames(spark, xy, grid)
    near = D.nndm_exclusions(data, targets, phi=0.001)
    assert near.count() == 60 and near.agg(F.max("n_excluded")).first()[0] == 0
    with_null = data.withColumn("x", F.when(F.col("row_id") != 7, F.col("x")))
    assert sorted(r.row_id for r in D.nndm_exclusions(with_null, targets).collect()) == [i for i in range(60) if i != 7]
    with pytest.raises(ValueError, match="3 rows"):
        D.nndm_exclusions(data.limit(2), targets)


def test_more_rows_than_the_old_limits(spark):
    xy, grid = clustered(5, per=1000)
    data, targets = frames(spark, xy, grid)
    got = D.nndm_exclusions(data, targets)
    goal = np.array([r.d for r in D.target_distances(data, targets, "x", "y").collect()])
    d = np.array([r.distance for r in got.collect()])
    alone = np.array([r.near[0].d for r in neighbours.k_nearest(data, 1).collect()])
    assert len(d) == 6000 and got.agg(F.max("n_excluded")).first()[0] <= 5999 - 3000
    assert ks(d, goal) < ks(alone, goal) - 0.1


def test_moves_only_improve_the_fit(spark):
    xy, grid = clustered(4)
    data, targets = frames(spark, xy, grid)
    goal = D.target_distances(data, targets, "x", "y")
    nearest = np.array([r.d for r in goal.collect()])
    assert np.allclose(np.sort(nearest), np.sort(np.sqrt(((grid[:, None] - xy) ** 2).sum(-1)).min(1)))
    far = np.sqrt(((xy[:, None] - xy) ** 2).sum(-1))

    def fit(folded):
        fold = np.array([r.fold for r in folded.orderBy("row_id").collect()])
        assert len(fold) == len(xy) and 1 < len(set(fold)) <= 5
        return ks(np.where(fold[:, None] != fold, far, np.inf).min(1), nearest)

    start = data.withColumn("fold", (F.col("row_id") % 60 / 12 + 1).cast("int"))
    got, score = D.moved(start, goal, "x", "y", rounds=4)
    assert abs(fit(got) - score) < 1e-12 and score <= fit(start)
    assert fit(D.knndm(data, targets, tries=2, moves=2)) <= fit(data.withColumn("fold", (F.col("row_id") % 5 + 1).cast("int"))) + 0.05
