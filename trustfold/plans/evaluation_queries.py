"""Metrics, calibration, intervals, applicability and shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import applicability as A
from ..operators import distance_matching as D
from ..operators import evaluation as E
from ..operators import neighbours, resampling, shift
from .tables import ORDERS, POINTS, orders, points, table

QUERIES = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the training mean of their customer's seventh as prediction, scaled."""
    rows = orders(spark, sf_dir)
    means = rows.where("role = 'train'").groupBy((F.col("cust") % 7).alias("k")).agg(F.avg("structured").alias("prediction"))
    return rows.where("role = 'test'").join(F.broadcast(means), F.col("cust") % 7 == F.col("k"))


PREDICTED = f"{ORDERS}, m AS (SELECT cust % 7 k, avg(structured) prediction FROM orders_r WHERE role='train' GROUP BY 1), p AS (SELECT o.*, prediction FROM orders_r o JOIN m ON cust % 7 = k WHERE role='test')"


@query(f"WITH {PREDICTED} SELECT count(*) n, round(sqrt(avg(pow(structured-prediction,2))),6) rmse, round(avg(abs(structured-prediction)),6) mae, round(1-sum(pow(structured-prediction,2))/(var_pop(structured)*count(*)),6) rsq FROM p")
def metrics_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.regression(F.col("structured"), F.col("prediction"))
    return _predicted(spark, sf_dir).agg(F.count("*").alias("n"), *[F.round(c, 6).alias(n) for n, c in got.items()])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a score in [0, 1] from the text's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("row_id"), "quality", "score")


SCORED = "s AS (SELECT doc_id row_id, quality, n_chars/(n_chars+1000.0) score FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE quality=1 AND score>=0.5)::DOUBLE tp, count(*) FILTER (WHERE quality=1 AND score<0.5)::DOUBLE fn, count(*) FILTER (WHERE quality=0 AND score<0.5)::DOUBLE tn, count(*) FILTER (WHERE quality=0 AND score>=0.5)::DOUBLE fp, count(*)::DOUBLE n FROM s)
SELECT round((tp+tn)/n,6) accuracy, round(tp/(tp+fn),6) sensitivity, round(tn/(tn+fp),6) specificity, round(tp/(tp+fn)+tn/(tn+fp)-1,6) tss, round(((tp+tn)/n-((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/(n*n))/(1-((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/(n*n)),6) kappa FROM c""")
def metrics_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = M.classification(F.col("quality"), F.col("score"))
    return _scored(spark, sf_dir).agg(*[F.round(c, 6).alias(n) for n, c in got.items()])


@query(f"""WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score)-1)/2.0 r FROM s)
SELECT round((sum(r) FILTER (WHERE quality=1) - count(*) FILTER (WHERE quality=1)*(count(*) FILTER (WHERE quality=1)+1)/2.0)/(count(*) FILTER (WHERE quality=1)*count(*) FILTER (WHERE quality=0)),6) auc FROM r""")
def metrics_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.auc(_scored(spark, sf_dir), "quality", "score"), "auc")


@query(f"""WITH {PREDICTED}, a AS (SELECT avg(structured) m FROM p), w AS (SELECT sum(pow(prediction-structured,2)) se, sum(pow(abs(prediction-m)+abs(structured-m),2)) sp, sum(abs(prediction-structured)) ae, sum(abs(prediction-m)+abs(structured-m)) ap, sum(abs(structured-m)) sm FROM p, a)
SELECT round(1-se/sp,6) d, round(1-ae/ap,6) d1, round(CASE WHEN ae<=2*sm THEN 1-ae/(2*sm) ELSE 2*sm/ae-1 END,6) dr FROM w""")
def metrics_willmott(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.willmott(_predicted(spark, sf_dir), "structured", "prediction"), "d", "d1", "dr")


@query(f"WITH {PREDICTED} SELECT (row_id % 5)::INT fold, count(*) n, round(sqrt(avg(pow(structured-prediction,2))),6) rmse, round(avg(abs(structured-prediction)),6) mae, round(1-sum(pow(structured-prediction,2))/(var_pop(structured)*count(*)),6) rsq FROM p GROUP BY 1")
def fold_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.fold_performance(_predicted(spark, sf_dir).withColumn("fold", (F.col("row_id") % 5).cast("int")), "structured")
    return _round(got, "rmse", "mae", "rsq")


BINS = f"{SCORED}, b AS (SELECT greatest(1,least(10,floor(score*10)+1))::INT bin, count(*) n, avg(score) predicted, avg(quality) observed FROM s GROUP BY 1 HAVING count(*)>=2)"
Z2 = 1.959963984540054**2


@query(f"""WITH {BINS} SELECT bin, n, round(predicted,6) predicted, round(observed,6) observed,
round((observed+{Z2}/(2*n))/(1+{Z2}/n)-sqrt(observed*(1-observed)/n+{Z2}/(4*n*n))*sqrt({Z2})/(1+{Z2}/n),6) lower, round((observed+{Z2}/(2*n))/(1+{Z2}/n)+sqrt(observed*(1-observed)/n+{Z2}/(4*n*n))*sqrt({Z2})/(1+{Z2}/n),6) upper FROM b""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.calibration_bins(_scored(spark, sf_dir), "quality", "score"), "predicted", "observed", "lower", "upper")


@query(f"""WITH {BINS}, w AS (SELECT sum(n*abs(observed-predicted))/sum(n) ece, max(abs(observed-predicted)) mce, (sum(n)*sum(n*predicted*observed)-sum(n*predicted)*sum(n*observed))/(sum(n)*sum(n*pow(predicted,2))-pow(sum(n*predicted),2)) slope, sum(n*observed) y, sum(n*predicted) x, sum(n) n FROM b)
SELECT round(ece,6) ece, round(mce,6) mce, round(slope,6) slope, round((y-slope*x)/n,6) AS intercept, round((SELECT avg(pow(score-quality,2)) FROM s),6) brier, CASE WHEN ece<0.02 THEN 'well' WHEN ece<0.08 THEN 'moderate' ELSE 'poor' END grade FROM w""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.calibration(_scored(spark, sf_dir), "quality", "score"), "ece", "mce", "slope", "intercept", "brier")


@query(f"""WITH {PREDICTED}, r AS (SELECT abs(structured-prediction) r FROM p), n AS (SELECT count(*) n, least(1.0, ceil((count(*)+1)*0.9)/count(*)) lv FROM r), o AS (SELECT r, row_number() OVER (ORDER BY r) k FROM r)
SELECT n, round(lv::DOUBLE,6) AS level, round(r,6) q FROM n JOIN o ON k = ceil(lv*n)""")
def conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predicted(spark, sf_dir).select((F.col("structured") - F.col("prediction")).alias("residual"))
    return _round(E.conformal_width(rows), "level", "q")


@query(f"""WITH {POINTS} SELECT 0.0::DOUBLE scale, count(*) n_cells, round(sqrt(avg(pow(v-(x+y),2))),6) rmse FROM points """ + "".join(f"UNION ALL SELECT {s}::DOUBLE, count(*), round(sqrt(avg(pow(a-p,2))),6) FROM (SELECT avg(v) a, avg(x+y) p FROM points GROUP BY floor(x/{s}), floor(y/{s})) " for s in (0.1, 0.25, 0.5)))
def multiscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(M.multiscale(points(spark, sf_dir).withColumn("p", F.col("x") + F.col("y")), "x", "y", "v", "p", [0, 0.1, 0.25, 0.5]), "rmse")


@query(f"WITH {PREDICTED}, g AS (SELECT cust % 3 grp, count(*) n, sqrt(avg(pow(structured-prediction,2))) rmse, avg(abs(structured-prediction)) mae FROM p GROUP BY 1) SELECT grp, n, round(rmse,6) rmse, round(mae,6) mae, round((SELECT max(rmse)/min(rmse) FROM g),6) disparity FROM g")
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.group_metrics(_predicted(spark, sf_dir).withColumn("grp", F.col("cust") % 3), "structured", "grp"), "rmse", "mae", "disparity")


SPLIT = f"{POINTS}, tr AS (SELECT * FROM points WHERE label < 5), nw AS (SELECT * FROM points WHERE label >= 5)"
SCALED = f"{SPLIT}, st AS (SELECT avg(w) mw, stddev_samp(w) sw, avg(e4) me, stddev_samp(e4) se FROM tr), a AS (SELECT row_id, (w-mw)/sw p, (e4-me)/se q FROM tr, st), b AS (SELECT row_id, (w-mw)/sw p, (e4-me)/se q FROM nw, st), nm AS (SELECT avg(sqrt(pow(a.p-c.p,2)+pow(a.q-c.q,2))) m FROM a JOIN a c ON a.row_id<>c.row_id)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = points(spark, sf_dir)
    return rows.where("label < 5"), rows.where("label >= 5")


@query(f"WITH {SCALED}, d AS (SELECT b.row_id, min(sqrt(pow(a.p-b.p,2)+pow(a.q-b.q,2))) d FROM b, a GROUP BY 1) SELECT row_id, round(d/m,6) di FROM d, nm")
def di_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(A.dissimilarity(train, new, ["w", "e4"]), "di")


@query(f"""WITH {SCALED}, o AS (SELECT a.row_id, min(sqrt(pow(a.p-c.p,2)+pow(a.q-c.q,2)))/any_value(m) di FROM a JOIN a c ON a.row_id<>c.row_id, nm GROUP BY 1), q AS (SELECT quantile_cont(di,0.25) x, quantile_cont(di,0.75) y FROM o), h AS (SELECT max(di) t FROM o, q WHERE di<=y+1.5*(y-x)),
d AS (SELECT b.row_id, min(sqrt(pow(a.p-b.p,2)+pow(a.q-b.q,2)))/any_value(m) di, count(*) FILTER (WHERE sqrt(pow(a.p-b.p,2)+pow(a.q-b.q,2))/m <= t) lpd, any_value(t) t FROM b, a, nm, h GROUP BY 1) SELECT row_id, round(di,6) di, lpd, di<=t AS aoa FROM d""")
def area_of_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(A.area_of_applicability(train, new, ["w", "e4"]), "di")


@query(f"""WITH {SPLIT}, r AS (SELECT min(w) a, max(w) b, min(e4) c, max(e4) d, count(*) n FROM tr), f AS (SELECT row_id, w, e4, a, b, c, d, (SELECT count(*) FROM tr WHERE tr.w<=nw.w)*100.0/n fw, (SELECT count(*) FROM tr WHERE tr.e4<=nw.e4)*100.0/n fe FROM nw, r)
SELECT row_id, round(least(CASE WHEN fw=0 THEN 100*(w-a)/(b-a) WHEN fw<=50 THEN 2*fw WHEN fw<100 THEN 2*(100-fw) ELSE 100*(b-w)/(b-a) END, CASE WHEN fe=0 THEN 100*(e4-c)/(d-c) WHEN fe<=50 THEN 2*fe WHEN fe<100 THEN 2*(100-fe) ELSE 100*(d-e4)/(d-c) END),6) mess FROM f""")
def mess(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(A.novelty(train, new, ["w", "e4"]), "mess")


@query(f"""WITH {SPLIT}, r AS (SELECT min(w) a, max(w) b, min(e4) c, max(e4) d FROM tr) SELECT row_id, ((w<a OR w>b)::INT + (e4<c OR e4>d)::INT)::INT n_outside, concat_ws(',', CASE WHEN w<a OR w>b THEN 'w' END, CASE WHEN e4<c OR e4>d THEN 'e4' END) outside FROM nw, r""")
def extrapolation_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return A.out_of_range(train, new, ["w", "e4"])


@query(f"""WITH {SPLIT}, s AS (SELECT avg(w) m, avg(e4) k, var_samp(w) a, var_samp(e4) b, covar_samp(w,e4) c FROM tr) SELECT row_id, round((b*pow(w-m,2)-2*c*(w-m)*(e4-k)+a*pow(e4-k,2))/(a*b-c*c),6) mahalanobis FROM nw, s""")
def mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(A.mahalanobis(train, new, ["w", "e4"]), "mahalanobis")


@query(f"""WITH {SPLIT}, u AS (SELECT 'w' feature, w v, 1 a, 0 b FROM tr UNION ALL SELECT 'w', w, 0, 1 FROM nw UNION ALL SELECT 'e4', e4, 1, 0 FROM tr UNION ALL SELECT 'e4', e4, 0, 1 FROM nw),
c AS (SELECT feature, v, sum(a) OVER (PARTITION BY feature ORDER BY v)/sum(a) OVER (PARTITION BY feature) fa, sum(b) OVER (PARTITION BY feature ORDER BY v)/sum(b) OVER (PARTITION BY feature) fb FROM u), k AS (SELECT feature, max(abs(fa-fb)) ks FROM c GROUP BY 1),
d AS (SELECT 'w' feature, (n.m-t.m)/sqrt(((t.n-1)*t.s+(n.n-1)*n.s)/(t.n+n.n-2)) d FROM (SELECT avg(w) m, var_samp(w) s, count(*) n FROM tr) t, (SELECT avg(w) m, var_samp(w) s, count(*) n FROM nw) n
 UNION ALL SELECT 'e4', (n.m-t.m)/sqrt(((t.n-1)*t.s+(n.n-1)*n.s)/(t.n+n.n-2)) FROM (SELECT avg(e4) m, var_samp(e4) s, count(*) n FROM tr) t, (SELECT avg(e4) m, var_samp(e4) s, count(*) n FROM nw) n)
SELECT feature, round(ks,6) ks, round(d,6) cohens_d FROM k JOIN d USING (feature)""")
def ks_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(A.drift(train, new, ["w", "e4"]).select("feature", "ks", "cohens_d"), "ks", "cohens_d")


@query(f"WITH {SCALED}, d AS (SELECT b.row_id, min(sqrt(pow(a.p-b.p,2)+pow(a.q-b.q,2)))/any_value(m) di FROM b, a, nm GROUP BY 1) SELECT row_id, round(di,6) di, row_number() OVER (ORDER BY di DESC, row_id)::INT rank FROM d ORDER BY d.di DESC, row_id LIMIT 10")
def sample_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(A.sample_design(train, new, ["w", "e4"]), "di")


@query(f"""WITH {POINTS}, z AS (SELECT row_id, x, y, (v-avg(v) OVER ())/stddev_pop(v) OVER () z FROM points), p AS (SELECT a.row_id, a.z, b.z zj, row_number() OVER (PARTITION BY a.row_id ORDER BY sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), b.row_id) r FROM z a JOIN z b ON a.row_id<>b.row_id)
SELECT row_id, round(any_value(z)*avg(zj),6) local_i FROM p WHERE r<=8 GROUP BY row_id""")
def local_moran_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.local_moran(points(spark, sf_dir).select("row_id", "x", "y", "v"), permutations=0), "local_i")


#: Local statistics by all pairs; draws of neighbours from the hashed order, with the spare value in the place of the row's own.
LOCAL_MORAN = f"""WITH {POINTS}, z AS (SELECT row_id, x, y, (v-avg(v) OVER ())/stddev_pop(v) OVER () z FROM points), c AS (SELECT count(*) // 9 AS per FROM z),
near AS (SELECT a.row_id, a.z, b.z zj, row_number() OVER (PARTITION BY a.row_id ORDER BY sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), b.row_id) r FROM z a JOIN z b ON a.row_id<>b.row_id),
i AS (SELECT row_id, any_value(z) z, avg(zj) lag FROM near WHERE r<=8 GROUP BY 1),
o AS (SELECT row_id, z, g.round, row_number() OVER (PARTITION BY g.round ORDER BY md5((42+g.round)||':'||row_id), row_id)-1 pos FROM z, (SELECT unnest(range(99 // per + 1)) round FROM c) g),
d AS (SELECT round*per + pos//9 perm, pos % 9 j, row_id, z FROM o, c WHERE pos < per*9 AND round*per + pos//9 < 99),
l AS (SELECT perm, sum(z) FILTER (WHERE j<8) total, sum(z) FILTER (WHERE j=8) spare FROM d GROUP BY 1),
p AS (SELECT i.row_id, any_value(i.z) z, any_value(i.lag) lag, (count(*) FILTER (WHERE abs((total - coalesce(d.z - spare, 0))/8) >= abs(lag) - 1e-12) + 1)/100.0 p
  FROM i CROSS JOIN l LEFT JOIN d ON d.perm = l.perm AND d.j < 8 AND d.row_id = i.row_id GROUP BY 1)
SELECT row_id, round(z*lag,6) local_i, round(p::DOUBLE,6) p, CASE WHEN p > 0.05 THEN 'none' ELSE CASE WHEN z>0 THEN 'high-' ELSE 'low-' END || CASE WHEN (z>0) = (z*lag>0) THEN 'high' ELSE 'low' END END AS label FROM p"""


@query(LOCAL_MORAN)
def local_moran(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(E.local_moran(points(spark, sf_dir).select("row_id", "x", "y", "v")), "local_i", "p")


@query(f"""WITH {POINTS}, p AS (SELECT a.row_id, b.row_id other, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) d FROM points a JOIN points b ON a.row_id<>b.row_id), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, other) nth FROM p)
SELECT row_id, nth::INT nth, other, round(d,6) d FROM r WHERE nth<=5""")
def nearest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours.k_nearest(points(spark, sf_dir), 5).select("row_id", F.posexplode("near").alias("nth", "b"))
    return _round(near.select("row_id", (F.col("nth") + 1).alias("nth"), F.col("b.id").alias("other"), F.col("b.d").alias("d")), "d")


@query(f"""WITH {POINTS}, p AS (SELECT a.row_id id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) d FROM points a JOIN points b ON a.row_id<>b.row_id)
SELECT id, ((d>=0.05)::INT+(d>=0.1)::INT+(d>=0.2)::INT+(d>=0.4)::INT)::INT gap, round(min(d),6) AS first, round(max(d),6) AS last, count(*) n FROM p WHERE d<=0.4 GROUP BY 1,2""")
def neighbour_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    rows = points(spark, sf_dir).select(F.col("row_id").alias("id"), "x", "y")
    return _round(D.neighbour_gaps(rows, np.array([0.05, 0.1, 0.2, 0.4])), "first", "last")


@query(f"""WITH {POINTS} SELECT a.row_id, round(min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))),6) d FROM points a JOIN points b ON a.row_id % 5 <> b.row_id % 5 GROUP BY 1""")
def fold_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.fold_distances(points(spark, sf_dir).withColumn("fold", F.col("row_id") % 5), "x", "y"), "d")


#: Held-out errors of v on x, block by block, from slopes of the other blocks.
BLOCK_ERRORS = """k AS (SELECT DISTINCT {0} b FROM points), m AS (SELECT b, regr_slope(v,x) s, regr_intercept(v,x) i FROM k JOIN points ON {0}<>b GROUP BY b),
e AS (SELECT b, sqrt(avg(pow(v-i-s*x,2))) rmse, 1-sum(pow(v-i-s*x,2))/(var_pop(v)*count(*)) rsq FROM m JOIN points ON {0}=b GROUP BY b)"""


@query(f"WITH {POINTS}, {BLOCK_ERRORS.format('label')} SELECT 'rmse' metric, round(avg(rmse),6) estimate, count(*) n_blocks FROM e UNION ALL SELECT 'rsq', round(avg(rsq),6), count(*) FROM e")
def bootstrap_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = points(spark, sf_dir), E.Linear("v", ["x"], ridge=0.0)
    both = [resampling.refit_bootstrap(rows, model, "label", n_boot=50, metric=m).select("metric", "estimate", "n_blocks") for m in ("rmse", "rsq")]
    return _round(both[0].unionAll(both[1]), "estimate")


@query(None)
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampling.refit_bootstrap(points(spark, sf_dir), E.Linear("v", ["x", "e4"]), "label")
    return _round(got, "estimate", "lower", "upper", "se", "bias")


@query(f"WITH {POINTS}, {BLOCK_ERRORS.format('row_id % 5')} SELECT 'rmse' metric, round(avg(rmse),6) observed, 0.01::DOUBLE p FROM e")
def null_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v depends on x, so that no permutation comes near and p is the least possible."""
    rows, folds = _linear_folds(spark, sf_dir)
    got = resampling.permuted_targets_test(rows, folds, E.Linear("v", ["x"], ridge=0.0))
    return _round(got.select("metric", "observed", "p"), "observed", "p")


@query(f"""WITH {POINTS}, s AS (SELECT label, count(*) n, sum(x) x, sum(e4) e4 FROM points GROUP BY 1), t AS (SELECT sum(n) n, sum(x) x, sum(e4) e4 FROM s)
SELECT row_id, 'x' feature, round(2*(p.x-(t.x-s.x)/(t.n-s.n)),6) contribution FROM points p JOIN s USING (label), t UNION ALL SELECT row_id, 'e4', round(-3*(p.e4-(t.e4-s.e4)/(t.n-s.n)),6) FROM points p JOIN s USING (label), t""")
def contributions_of_a_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of other blocks count. The model is linear, so its values are predicted once and added up by block."""
    rows = points(spark, sf_dir)
    got = resampling.block_contributions(rows, lambda d: d.withColumn("prediction", 2 * F.col("x") - 3 * F.col("e4") + 1), ["x", "e4"], "label", samples=rows.count(), additive=True)
    return _round(got, "contribution")


def _classifier_sql(steps: int = 9, v: int = 5) -> str:
    """Newton's method of the folds' logistic models, a common table a step, and the area under the curve of the held-out scores."""
    sql = f"""WITH {SPLIT}, u AS (SELECT 'train:'||row_id id, w, e4, 0 y FROM tr UNION ALL SELECT 'new:'||row_id, w, e4, 1 FROM nw),
r AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY md5('42:'||id), id)-1) % {v} fold, (w-avg(w) OVER ())/stddev_samp(w) OVER () p, (e4-avg(e4) OVER ())/stddev_samp(e4) OVER () q, y FROM u),
b0 AS (SELECT unnest(range({v})) f, 0.0::DOUBLE a, 0.0::DOUBLE b, 0.0::DOUBLE c)"""
    for t in range(steps):
        sql += f""",
s{t} AS MATERIALIZED (SELECT f, any_value(a) a, any_value(b) b, any_value(c) c, sum(m) h00, sum(m*p) h01, sum(m*q) h02, sum(m*p*p) h11, sum(m*p*q) h12, sum(m*q*q) h22, sum(e) g0, sum(e*p) g1, sum(e*q) g2
 FROM (SELECT *, u*(1-u) m, y-u e FROM (SELECT *, 1/(1+exp(-(a+b*p+c*q))) u FROM r JOIN b{t} ON fold<>f)) GROUP BY f),
b{t + 1} AS MATERIALIZED (SELECT f, a+((h11*h22-h12*h12)*g0+(h02*h12-h01*h22)*g1+(h01*h12-h02*h11)*g2)/det a, b+((h02*h12-h01*h22)*g0+(h00*h22-h02*h02)*g1+(h01*h02-h00*h12)*g2)/det b, c+((h01*h12-h02*h11)*g0+(h01*h02-h00*h12)*g1+(h00*h11-h01*h01)*g2)/det c
 FROM (SELECT *, h00*(h11*h22-h12*h12)-h01*(h01*h22-h12*h02)+h02*(h01*h12-h11*h02) det FROM s{t}))"""
    return sql + f""",
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s)-1)/2.0 r FROM (SELECT y, a+b*p+c*q s FROM r JOIN b{steps} ON fold=f)),
n AS (SELECT count(*) FILTER (WHERE y=0) n_train, count(*) FILTER (WHERE y=1) n_new FROM k)
SELECT n_train, n_new, round(((SELECT sum(r) FROM k WHERE y=1)-n_new*(n_new+1)/2.0)/(n_train*n_new),6) classifier_auc FROM n"""


@query(_classifier_sql())
def drift_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(shift.classifier_test(train, new, ["w", "e4"], n_perm=0).drop("classifier_p"), "classifier_auc")


@query(None)
def drift_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    return _round(shift.drift_summary(train, new, ["w", "e4"]), "max_abs_d", "classifier_auc", "classifier_p")


@query(f"""WITH {POINTS}, r AS (SELECT row_id % 4 fold, regr_slope(v,x) s FROM points GROUP BY 1), f AS (SELECT k.fold, regr_slope(v,x) b, regr_intercept(v,x) a FROM points, (SELECT DISTINCT fold FROM r) k WHERE row_id % 4 <> k.fold GROUP BY k.fold)
SELECT row_id, fold::INT fold, round(a+b*x,6) prediction FROM points JOIN f ON row_id % 4 = fold""")
def held_out_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    got = E.held_out(rows, rows.select("row_id", (F.col("row_id") % 4).cast("int").alias("fold")), E.Linear("v", ["x"], ridge=0.0))
    return _round(got.select("row_id", "fold", "prediction"), "prediction")


def _linear_folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = points(spark, sf_dir)
    return rows, rows.select("row_id", (F.col("row_id") % 5).cast("int").alias("fold"))


@query(None)
def forward_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folds = _linear_folds(spark, sf_dir)
    return spark.createDataFrame([(",".join(f), round(s, 6)) for f, s in E.forward_selection(rows, folds, "v", ["x", "y", "w", "e4"])], "features string, rmse double")


#: Two-feature least squares of the rows outside each fold, the fold's own error, and all models' predictions.
ENSEMBLE = f"""WITH {POINTS}, k AS (SELECT unnest(range(5)) f), s AS (SELECT f, avg(v) mv, avg(x) mx, avg(e4) me, var_pop(x) xx, var_pop(e4) ee, covar_pop(x,e4) xe, covar_pop(x,v) xv, covar_pop(e4,v) ev FROM k JOIN points ON row_id % 5 <> f GROUP BY f),
b AS (SELECT f, (xv*ee-ev*xe)/(xx*ee-xe*xe) b, (ev*xx-xv*xe)/(xx*ee-xe*xe) c, mv, mx, me FROM s), m AS (SELECT f, b, c, mv-b*mx-c*me a FROM b),
h AS (SELECT f, any_value(a) a, any_value(b) b, any_value(c) c, 1/greatest(1e-12, sqrt(avg(pow(v-a-b*x-c*e4,2)))) wt FROM m JOIN points ON row_id % 5 = f GROUP BY f),
p AS (SELECT row_id, wt, a+b*x+c*e4 p FROM points, h), q AS (SELECT row_id, sum(wt*p)/sum(wt) m FROM p GROUP BY 1)
SELECT row_id, round(any_value(m),6) prediction, round(sqrt(sum(wt*pow(p-m,2))/sum(wt)),6) sd FROM p JOIN q USING (row_id) GROUP BY 1"""


@query(ENSEMBLE)
def ensemble_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folds = _linear_folds(spark, sf_dir)
    return _round(E.ensemble(rows, folds, E.Linear("v", ["x", "e4"]), rows).select("row_id", "prediction", "sd"), "prediction", "sd")


@query(None)
def adversarial_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, new = _sides(spark, sf_dir)
    got = A.adversarial(train, new, ["w", "e4"])
    return spark.createDataFrame([(got["auc"], got["dissimilarity"], got["verdict"])], "auc double, dissimilarity double, verdict string")


def _schemes_sql(schemes: dict[str, str]) -> str:
    """Common tables: a mean held-out RMSE of v on x for each scheme of folds."""
    return ", ".join(
        f"""k{n} AS (SELECT DISTINCT {f} b FROM points), m{n} AS (SELECT b, regr_slope(v,x) s, regr_intercept(v,x) i FROM k{n} JOIN points ON {f}<>b GROUP BY b),
{n} AS (SELECT avg(e) e FROM (SELECT sqrt(avg(pow(v-i-s*x,2))) e FROM m{n} JOIN points ON {f}=b GROUP BY b))"""
        for n, f in schemes.items()
    )


@query(f"""WITH {POINTS}, {_schemes_sql({"r1": "row_id % 5", "r2": "row_id % 4", "b1": "label % 5", "b2": "label % 4"})}
SELECT round((r1.e+r2.e)/2,6) random, round((b1.e+b2.e)/2,6) blocked, round(1-(r1.e+r2.e)/(b1.e+b2.e),6) inflation, round(((r1.e-b1.e)+(r2.e-b2.e))/2/(abs((r1.e-b1.e)-(r2.e-b2.e))/sqrt(2)/sqrt(2)),4) t FROM r1, r2, b1, b2""")
def cv_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    dealt = lambda c, k: rows.select("row_id", (F.col(c) % k).cast("int").alias("fold"))
    got = E.compare_cv(rows, [dealt("row_id", 5), dealt("row_id", 4)], [dealt("label", 5), dealt("label", 4)], E.Linear("v", ["x"], ridge=0.0), "v")
    one = spark.createDataFrame([(got["random"], got["blocked"], got["inflation"], got["t"])], "random double, blocked double, inflation double, t double")
    return _round(one, "random", "blocked", "inflation").withColumn("t", F.round("t", 4))


@query(f"""WITH {POINTS}, a AS (SELECT abs(x) di, abs(v) e FROM points), r AS (SELECT min(di) lo, max(di) hi FROM a)
SELECT greatest(1, least(10, ceil((di-lo)/((hi-lo)/10))))::INT bin, count(*) n, round(avg(di),6) di, round(avg(e),6) error FROM a, r GROUP BY 1""")
def error_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("row_id", F.abs("x").alias("di"), F.abs("v").alias("abs_error"))
    return _round(E.error_profile(rows)[0], "di", "error")


def _importance_sql(repeats: int = 3) -> str:
    parts = []
    for f in ("x", "y"):
        for r in range(repeats):
            parts.append(f"""SELECT '{f}' feature, sqrt(avg(pow(o.v-(0.9*{"m.x" if f == "x" else "o.x"}+1.1*{"m.y" if f == "y" else "o.y"}),2))) e
 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_id) i FROM points) o JOIN (SELECT label, x, y, row_number() OVER (PARTITION BY label ORDER BY md5('{42 + r}:'||row_id)) i FROM points) m ON o.label=m.label AND o.i=m.i""")
    return f"WITH {POINTS}, b AS (SELECT sqrt(avg(pow(v-(0.9*x+1.1*y),2))) e FROM points), p AS ({' UNION ALL '.join(parts)}) SELECT feature, round(avg(p.e-b.e),6) importance, round(stddev_samp(p.e-b.e),6) sd FROM p, b GROUP BY 1"


@query(_importance_sql())
def block_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.importance(points(spark, sf_dir), lambda d: d.withColumn("prediction", 0.9 * F.col("x") + 1.1 * F.col("y")), "v", ["x", "y"], "label", n_rep=3)
    return _round(got, "importance", "sd")


KNOTS = [(-1.0, -1.0), (1.0, 1.0), (0.5, -1.0)]


def _thin_plate_sql() -> str:
    """The trend's share by making the basis orthogonal, a column at a time."""
    near = [f"greatest(pow(u-({a}),2)+pow(w2-({b}),2),1e-10)" for a, b in KNOTS]
    names = ["u", "w2", *(f"k{i}" for i in range(len(KNOTS)))]
    sql = f"""WITH {POINTS}, a AS (SELECT w, e4, (x-avg(x) OVER ())/(stddev_samp(x) OVER ()+1e-10) u, (y-avg(y) OVER ())/(stddev_samp(y) OVER ()+1e-10) w2 FROM points),
c AS (SELECT *, {", ".join(f"{r}*ln({r})/2 k{i}" for i, r in enumerate(near))} FROM a), o0 AS (SELECT {", ".join(f"{n}-avg({n}) OVER () {n}" for n in ["w", "e4", *names])} FROM c)"""
    for i, n in enumerate(names):
        rest = ["w", "e4", *names[i + 1 :]]
        sql += f",\no{i + 1} AS MATERIALIZED (SELECT {', '.join(f'{c}-{n}*(sum({c}*{n}) OVER ())/(sum({n}*{n}) OVER ()) {c}' for c in rest)} FROM o{i})"
    last = f"o{len(names)}"
    return sql + "\n" + " UNION ALL ".join(f"SELECT '{p}' predictor, round(1-(SELECT sum({p}*{p}) FROM {last})/(SELECT sum({p}*{p}) FROM o0),6) r2" for p in ("w", "e4"))


@query(_thin_plate_sql())
def thin_plate_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.debias_thin_plate(points(spark, sf_dir), "x", "y", ["w", "e4"], knots=KNOTS)[1].select("predictor", "r2"), "r2")
