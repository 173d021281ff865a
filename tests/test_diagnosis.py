import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustfold.functions import stats
from trustfold.functions.common import global_position
from trustfold.operators import diagnosis as D
from trustfold.operators import simulate


def test_distribution_functions():
    assert stats.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert stats.chi2_survival_even(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_two_sided(2.2621571628, 9) == pytest.approx(0.05, abs=1e-6)
    assert stats.ks_p_value(0.0, 10, 10) == 1.0
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)


def test_global_position_is_a_total_order(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 500).tolist()
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(v)], "row_id bigint, v int").repartition(7)
    got = [r.row_id for r in sorted(global_position(df, "v", "row_id").collect(), key=lambda r: r.pos)]
    assert got == [i for _, i in sorted((x, i) for i, x in enumerate(v))]
    assert global_position(df.where("false"), "v").count() == 0


def test_autocorrelation_over_blocks(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=300).cumsum()
    s = spark.createDataFrame([(i + 1, float(a)) for i, a in enumerate(y)], "pos bigint, v double")
    wide = D.lagged(s, 5, block=37).orderBy("pos").collect()
    assert len(wide) == 300 and all(wide[i].l_3 == (wide[i - 3].v if i >= 3 else None) for i in range(300))
    acf = {r.lag: r.acf for r in D.autocorrelation(s).collect()}
    c = y - y.mean()
    assert acf[4] == pytest.approx((c[4:] * c[:-4]).sum() / (c * c).sum())


def test_moran_matches_matrix_form(spark):
    rng = np.random.default_rng(3)
    xy, v = rng.random((40, 2)), rng.normal(size=40)
    v += xy.sum(1) * 3
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, v))], "row_id bigint, x double, y double, v double")
    got = D.moran(df).first()
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    w = 1 / (d + 1e-10)
    np.fill_diagonal(w, 0)
    w /= w.sum(1, keepdims=True)
    c = v - v.mean()
    n, s0 = 40, w.sum()
    i = n / s0 * (c @ w @ c) / (c @ c)
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    k = n * (c**4).sum() / (c @ c) ** 2
    e = -1 / (n - 1)
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0**2) - k * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0**2)) / ((n - 1) * (n - 2) * (n - 3) * s0**2) - e * e
    assert got.i == pytest.approx(i) and got.variance == pytest.approx(var) and got.z == pytest.approx((i - e) / math.sqrt(var))


def test_detects_each_kind(spark):
    s = D.diagnose(simulate.spatial(spark, 150, noise=0.05), coords=("x", "y"), target="response")
    assert s.dependency == "spatial" and s.recommended == "spatial_block" and s.inflation["auc_inflation"] > 0
    t = D.diagnose(simulate.temporal(spark, 200, phi=0.9), time="time", target="y")
    assert t.dependency == "temporal" and t.recommended == "temporal_block" and t.temporal["embargo"] >= 1
    rng = np.random.default_rng(5)
    rows = [(i, i % 15, float(3 * (i % 15) + rng.normal())) for i in range(300)]
    c = D.diagnose(spark.createDataFrame(rows, "row_id bigint, site int, value double"), group="site", target="value")
    assert c.dependency == "clustered" and c.severity == "severe" and c.recommended == "group_fold"
    assert D.power(c)["design_effect"] > 10
    n = D.diagnose(simulate.independent(spark, 200), target="y")
    assert (n.dependency, n.severity, n.recommended) == ("none", "none", "random")


def test_few_rows(spark):
    rows = [(i, float(i) if i < 5 else None, float(i) if i < 5 else None, 1.0) for i in range(15)]
    d = D.diagnose(spark.createDataFrame(rows, "row_id bigint, x double, y double, v double"), coords=("x", "y"), target="v")
    assert d.dependency == "none"
    with pytest.raises(ValueError):
        D.diagnose(spark.range(5).withColumnRenamed("id", "row_id"))


def test_icc_and_haversine(spark):
    rows = [(1, 1.0), (1, 2.0), (2, 5.0), (2, 7.0), (3, 4.0), (3, None), (None, 9.0)]
    got = D.intraclass(spark.createDataFrame(rows, "g int, v double"), "g", "v").first()
    a = [[1, 2], [5, 7], [4]]
    grand = sum(map(sum, a)) / 5
    msb = sum(len(g) * (sum(g) / len(g) - grand) ** 2 for g in a) / 2
    msw = sum((x - sum(g) / len(g)) ** 2 for g in a for x in g) / 2
    assert got.icc_raw == pytest.approx((msb - msw) / (msb + (5 / 3 - 1) * msw))
    km = spark.range(1).select(D.haversine(F.lit(-0.1278), F.lit(51.5074), F.lit(2.3522), F.lit(48.8566)) / 1000).first()[0]
    assert 340 < km < 347
