import hashlib

import numpy as np
import pyarrow as pa
import pytest

from trustfold.functions.permute import shuffled
from trustfold.operators import shift


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000])
def test_shuffles_are_bijections_and_spread(n):
    for key in (0, 1, 12345678901234567890):
        assert sorted(shuffled(np.arange(n), n, key).tolist()) == list(range(n))
    if n == 1000:
        first = np.array([shuffled(np.arange(n), n, k)[0] for k in range(2000)])
        assert abs(first.mean() - 499.5) < 25 and len(set(first.tolist())) > 800
        marks = np.stack([shuffled(np.arange(n), n, k) < 300 for k in range(200)]).astype(float)
        assert np.abs(np.corrcoef(marks) - np.eye(200)).max() < 0.2


def sides(spark, move, n=160, m=90, seed=3):
    rng = np.random.default_rng(seed)
    a = [(i, *map(float, rng.normal(size=3))) for i in range(n)]
    b = [(i, float(rng.normal() + move), float(rng.normal()), float(rng.normal())) for i in range(m)]
    ddl = "row_id long, a double, b double, c double"
    return spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)


def plain(train, new, names, n_perm, v, seed):
    """The same test, one model at a time."""
    rows = [(hashlib.md5(f"{seed}:{side}:{r.row_id}".encode()).hexdigest(), [r[c] for c in names], y) for side, d, y in (("train", train, 0), ("new", new, 1)) for r in d.collect()]
    rows.sort()
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0, ddof=1)])
    fold, n = np.arange(len(x)) % v, len(x)

    def area(lab):
        score = np.zeros(n)
        for f in range(v):
            t, beta = fold != f, np.zeros(x.shape[1])
            for _ in range(30):
                mu = 1 / (1 + np.exp(-x[t] @ beta))
                beta = beta + np.linalg.solve(x[t].T @ (x[t] * (mu * (1 - mu))[:, None]), x[t].T @ (lab[t] - mu))
            score[~t] = x[~t] @ beta
        gap = score[lab == 1][:, None] - score[lab == 0][None]
        return float(((gap > 0) + 0.5 * (gap == 0)).mean())

    own = area(y)
    permuted = [area((shuffled(np.arange(n), n, seed + 1 + b) < y.sum()).astype(float)) for b in range(n_perm)]
    return own, (sum(a >= own for a in permuted) + 1) / (n_perm + 1)


@pytest.mark.parametrize("move", [0.0, 0.3])
def test_area_and_p_match_single_models(spark, move):
    train, new = sides(spark, move)
    r = shift.classifier_test(train, new, ["a", "b", "c"], n_perm=19).first()
    area, p = plain(train, new, ["a", "b", "c"], 19, 5, 42)
    assert (r.n_train, r.n_new) == (160, 90)
    assert abs(r.classifier_auc - area) < 1e-9 and abs(r.classifier_p - p) < 1e-9


def test_shifted_and_unshifted_rows(spark):
    far = shift.drift_summary(*sides(spark, 2.0), ["a", "b", "c"], n_perm=30).first()
    assert far.classifier_auc > 0.85 and far.classifier_p == 1 / 31 and far.n_shifted == 1 and far.max_abs_d > 1.5 and far.severity == "moderate"
    same = shift.drift_summary(*sides(spark, 0.0), ["a", "b", "c"], n_perm=30).first()
    assert same.classifier_p > 0.05 and same.n_shifted == 0
    alone = shift.drift_summary(*sides(spark, 0.0), ["a", "b"], n_perm=0).first()
    assert alone.classifier_auc is None and alone.classifier_p is None and alone.severity == "none"


def test_separable_collinear_null_and_empty(spark):
    train, new = sides(spark, 0.0, 60, 40)
    apart = train.selectExpr("row_id", "-1 - abs(a) as a", "a * 0 as flat"), new.selectExpr("row_id", "1 + abs(a) as a", "a * 0 as flat")
    r = shift.classifier_test(*apart, ["a", "flat"], n_perm=9).first()
    assert r.classifier_auc == 1.0 and r.classifier_p == 0.1
    double = [d.selectExpr("row_id", "a", "2 * a as b") for d in (train, new)]
    assert 0 <= shift.classifier_test(*double, ["a", "b"], n_perm=4).first().classifier_auc <= 1
    gaps = shift.classifier_test(train.selectExpr("row_id", "if(row_id < 10, null, a) a"), new, ["a"], n_perm=0).first()
    assert (gaps.n_train, gaps.n_new, gaps.classifier_p) == (50, 40, None)
    assert shift.classifier_test(train, new.where("false"), ["a"]).first().classifier_auc == 0.5


@pytest.mark.parametrize("n_perm", [0, 30, 100, 3000])
def test_chunks_hold_as_much_however_many_rows_and_models(n_perm):
    rows, v = 9000, 5
    labels = shift._Labels(rows, 4000, n_perm, 42)
    batch = pa.RecordBatch.from_pydict({"x0": np.arange(rows, dtype=float), "pos": np.arange(1, rows + 1), "y": (np.arange(rows) % 2).astype(float)})
    if n_perm == 3000:
        batch = batch.slice(0, 40)
    got = list(shift._chunks(iter([batch]), 1, v, labels))
    assert all(len(x) * y.shape[1] * v <= 300_000 for x, _, y in got)
    x, fold, y = (np.concatenate(part) for part in zip(*got))
    assert x[:, 1].tolist() == batch.column("x0").to_pylist() and fold.tolist() == [i % v for i in range(len(x))]
    assert (y[:, 0] == np.arange(len(x)) % 2).all() and y.shape == (len(x), n_perm + 1)
    for b in {0, n_perm - 1} if n_perm else ():
        assert (y[:, b + 1] == (shuffled(np.arange(len(x)), rows, 43 + b) < 4000)).all()
