"""Scope of models and resamplings, audits, whole checks, and the data behind plots."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import api, evaluation, folds, guards, integrity, leakage, plots, scope
from ..operators import diagnosis as D
from ..sources import grid
from .tables import ORDERS, POINTS, orders, points

QUERIES = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


def _inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner folds over all orders, with mistakes: every seventh row is assessed in fold 1 as well."""
    rows = orders(spark, sf_dir)
    base = rows.select((F.col("row_id") % 5 + 1).cast("int").alias("fold"), "row_id", F.when(F.col("row_id") % 3 == 0, "test").otherwise("train").alias("role"))
    return base.unionByName(rows.where("row_id % 7 = 0").select(F.lit(1).alias("fold"), "row_id", F.lit("test").alias("role")))


INNER = f"""{ORDERS}, i AS (SELECT (row_id % 5 + 1)::INT fold, row_id, CASE WHEN row_id % 3 = 0 THEN 'test' ELSE 'train' END AS r FROM orders_r UNION ALL SELECT 1, row_id, 'test' FROM orders_r WHERE row_id % 7 = 0),
e AS (SELECT fold, i.row_id, bool_or(r='train') fit, bool_or(r='test') assess, any_value(o.role) outer_role FROM i JOIN orders_r o USING (row_id) GROUP BY 1, 2),
k AS (SELECT fold, count(*) FILTER (WHERE fit AND outer_role='test') outer_test, count(*) FILTER (WHERE fit AND outer_role<>'train') not_train, count(*) FILTER (WHERE fit AND assess) both_roles, count(*) FILTER (WHERE assess AND outer_role='train') assessed FROM e GROUP BY 1)"""


@query(
    f"WITH {INNER} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{kind}' kind, fold, '{name}' AS type, '{severity}' severity, {({'outer_test': 'outer_test', 'not_train': 'not_train', 'both': 'both_roles', 'assessed_train': 'assessed'})[what]} n FROM k"
        for kind, rules in scope.FOLD_RISKS.items()
        for name, severity, what in rules
    )
    + ") WHERE n > 0"
)
def fold_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner, split, out = _inner(spark, sf_dir), orders(spark, sf_dir).select("row_id", "role"), None
    for kind in scope.FOLD_RISKS:
        got = scope.fold_issues(inner, split, kind).select(F.lit(kind).alias("kind"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query(f"WITH {ORDERS} SELECT count(*) FILTER (WHERE row_id % 5 <> 0) n_seen, count(*) FILTER (WHERE role='train') n_train, count(*) FILTER (WHERE row_id % 5 <> 0 AND role='test') n_test_seen, count(*) FILTER (WHERE row_id % 5 <> 0 AND role<>'train') n_unexpected FROM orders_r")
def model_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return scope.seen_rows(rows.where("row_id % 5 <> 0"), rows.select("row_id", "role"))


@query(f"""WITH {ORDERS}, k AS (SELECT DISTINCT (row_id % 5)::INT fold FROM orders_r), e AS (SELECT k.fold, o.row_id, o.cust, o.day, row_id % 5 = k.fold tested FROM orders_r o, k),
l AS (SELECT fold, max(day) last FROM e WHERE NOT tested GROUP BY 1), g AS (SELECT fold, count(*) n_groups FROM (SELECT fold, cust FROM e GROUP BY 1, 2 HAVING bool_or(tested) AND bool_or(NOT tested)) GROUP BY 1)
SELECT e.fold, count(*) FILTER (WHERE NOT tested) n_train, count(*) FILTER (WHERE tested) n_test, 0::BIGINT n_overlap, any_value(n_groups) n_groups, count(*) FILTER (WHERE tested AND day < last) n_early FROM e JOIN l USING (fold) JOIN g USING (fold) GROUP BY 1""")
def fold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    made = scope.with_roles(rows.select("row_id", (F.col("row_id") % 5).cast("int").alias("fold")))
    return scope.fold_checks(rows.drop("role"), made, "day", "cust")


@query("SELECT o_orderkey + 1 row_id FROM orders WHERE o_orderkey + 1 NOT IN (SELECT o_orderkey FROM orders)")
def index_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return integrity.index_bounds(rows.select((F.col("row_id") + 1).alias("row_id"), "role"), rows).select("row_id")


@query(f"WITH {ORDERS} SELECT 'group_overlap' AS type, 'hard_violation' severity, count(*) n_affected FROM (SELECT cust FROM orders_r GROUP BY 1 HAVING count(DISTINCT role)=2) UNION ALL SELECT 'temporal_leak', 'soft_inflation', count(*) FROM orders_r WHERE role='test' AND day < (SELECT max(day) FROM orders_r WHERE role='train')")
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector over orders; two find something."""
    rows = orders(spark, sf_dir)
    got = api.check(rows.drop("role"), rows.select("row_id", "role"), target="structured", time="day", group="cust")
    return got.select("type", "severity", "n_affected")


@query(f"WITH {ORDERS} SELECT 'full_data_prediction' AS type, 'hard_violation' severity, count(*) n_affected FROM orders_r UNION ALL SELECT 'wrong_prediction_set', 'hard_violation', count(*) FROM orders_r WHERE role='train' UNION ALL SELECT 'model_leakage', 'hard_violation', 0")
def audit_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all rows by a model that was fitted on rows of its own."""
    rows = orders(spark, sf_dir)
    model = scope.fitted_on(rows.where("row_id % 5 <> 0"), rows.select("row_id", "role"))
    said = rows.select("row_id", F.col("structured").alias("actual"), (F.col("row_id") % 11).cast("double").alias("prediction"))
    return leakage.risk_rows(spark, leakage.audit_predictions(said, rows.select("row_id", "role"), model_risks=model)).select("type", "severity", "n_affected")


@query(f"""WITH {POINTS}, p AS (SELECT *, row_id % 4 = 0 tested FROM points UNION ALL SELECT row_id + 1000000, x, y, v, w, e4, label, true FROM points WHERE row_id % 12 = 1),
near AS (SELECT a.row_id, a.tested, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) d FROM p a JOIN p b ON a.row_id <> b.row_id AND NOT b.tested GROUP BY 1, 2), m AS (SELECT median(d) m FROM near WHERE NOT tested),
c AS (SELECT count(*) n, count(*) FILTER (WHERE d < 0.5*m) close, count(*) FILTER (WHERE d < 0.01*m) same FROM near, m WHERE tested)
SELECT 'spatial_autocorrelation' AS type, close n_affected FROM c WHERE close > 0.3*n UNION ALL SELECT 'spatial_duplicate', same FROM c WHERE same > 0""")
def spatial_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows near to training rows or on them, over all rows."""
    rows = points(spark, sf_dir).withColumn("role", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    copies = rows.where("row_id % 12 = 1").withColumns({"row_id": F.col("row_id") + 1_000_000, "role": F.lit("test")})
    return leakage.risk_rows(spark, leakage.spatial_rules(rows.unionByName(copies), "x", "y")).select("type", "n_affected")


Z_SUM = NormalDist().inv_cdf(0.975) + NormalDist().inv_cdf(0.8)


@query(f"""WITH {ORDERS}, g AS (SELECT cust, count(*) c, avg(structured) a, var_pop(structured) p FROM orders_r GROUP BY 1),
t AS (SELECT count(*)::DOUBLE k, sum(c)::DOUBLE n, sum(c*a)/sum(c) grand, sum(c*p) ssw FROM g), b AS (SELECT sum(c*pow(a-grand,2)) ssb FROM g, t),
i AS (SELECT k, n, n/k m, ssb/(k-1) msb, ssw/(n-k) msw FROM t, b), c AS (SELECT *, least(1.0, greatest(0.0, (msb-msw)/(msb+(m-1)*msw))) icc FROM i),
d AS (SELECT *, CASE WHEN icc > 0.05 THEN greatest(1.0, least(1+(m-1)*icc, n/10)) ELSE 1.0 END deff FROM c)
SELECT n::BIGINT n, round(icc,6) icc, round(deff,6) design_effect, round(n/deff,4) n_effective, round({Z_SUM}/sqrt(n/deff/4),6) min_effect, n/deff >= 20 sufficient FROM d""")
def power_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective rows and least detectable effect of orders that are grouped by customer."""
    d = D.diagnose(orders(spark, sf_dir), group="cust", target="structured")
    got = D.power(d)
    row = (got["n"], round(d.clustered["statistic"], 6), round(got["design_effect"], 6), round(got["n_effective"], 4), round(got["min_effect"], 6), got["sufficient"])
    return spark.createDataFrame([row], "n bigint, icc double, design_effect double, n_effective double, min_effect double, sufficient boolean")


@query(f"WITH {ORDERS} SELECT row_id, ((row_number() OVER (ORDER BY cust % 7, md5('42:'||row_id), row_id) - 1) % 5 + 1)::INT fold FROM orders_r")
def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumn("seventh", F.col("cust") % 7)
    return folds.stratified_folds(rows, "seventh").select("row_id", "fold")


@query("SELECT o_orderkey row_id, CASE WHEN row_number() OVER (ORDER BY md5('42:'||o_orderkey), o_orderkey) <= floor((SELECT count(*) FROM orders)*0.75) THEN 'train' ELSE 'test' END AS role FROM orders")
def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.initial_split(orders(spark, sf_dir))


@query(f"WITH {ORDERS}, k AS (SELECT DISTINCT (row_id % 5 + 1)::INT fold FROM orders_r) SELECT k.fold, CASE WHEN row_id % 5 + 1 = k.fold THEN 'test' ELSE 'train' END AS role, count(*) n FROM orders_r, k GROUP BY 1, 2")
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = orders(spark, sf_dir).select("row_id", (F.col("row_id") % 5 + 1).cast("int").alias("fold"))
    return plots.fold_sizes(folds.long_form(made))


@query(f"WITH {INNER}, t AS (SELECT row_id, max(fold) f FROM i WHERE r='test' GROUP BY 1) SELECT row_id, coalesce(f, 1)::INT fold FROM orders_r LEFT JOIN t USING (row_id)")
def fold_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.fold_vector(_inner(spark, sf_dir), orders(spark, sf_dir))


@query(f"WITH {ORDERS} SELECT 'Repeat0'||(row_id % 3 + 1)||'_Fold0'||(row_id % 5 + 1) id, count(*) n FROM orders_r GROUP BY 1")
def named_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = orders(spark, sf_dir).select("row_id", (F.col("row_id") % 5 + 1).cast("int").alias("fold"), (F.col("row_id") % 3 + 1).cast("int").alias("repeat"))
    return guards.named_splits(made).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {INNER} SELECT o.row_id, CASE WHEN bool_or(i.r='train') AND bool_or(i.r='test') THEN 'overlap' WHEN bool_or(i.r='train') THEN 'train' WHEN bool_or(i.r='test') THEN 'test' ELSE 'excluded' END AS role FROM orders_r o LEFT JOIN (SELECT * FROM i WHERE row_id % 2 = 0) i USING (row_id) GROUP BY 1")
def row_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.roles(orders(spark, sf_dir), _inner(spark, sf_dir).where("row_id % 2 = 0"))


@query(f"WITH {ORDERS} SELECT cust, CASE WHEN count(DISTINCT role)=2 THEN 'leak' ELSE any_value(role) END AS membership, count(*) n FROM orders_r GROUP BY 1")
def group_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.group_membership(orders(spark, sf_dir), "cust")


@query(f"""WITH {ORDERS}, r AS (SELECT role, (day::DATE - DATE '1970-01-01')::DOUBLE t FROM orders_r), e AS (SELECT min(t) a, max(t) b FROM r)
SELECT greatest(1, least(50, ceil((t-a)/((b-a)/50))))::INT bin, role, count(*) n FROM r, e GROUP BY 1, 2""")
def split_on_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.split_on_time(orders(spark, sf_dir).withColumn("day", F.to_date("day")), "day")


@query(f"WITH {POINTS}, c AS (SELECT *, floor((x+1)/0.05)::BIGINT c, floor((y+1)/0.05)::BIGINT r FROM points) SELECT row_id, (c*100+r)::DOUBLE band FROM c WHERE c BETWEEN 0 AND 39 AND r BETWEEN 0 AND 39 AND (c+r) % 7 <> 0")
def grid_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a 40 x 40 grid at points; points off the grid or on a cell without a value are dropped."""
    cells = spark.range(1600).select(F.floor(F.col("id") / 40).alias("col"), (F.col("id") % 40).alias("row"))
    cells = cells.withColumn("band", F.when((F.col("col") + F.col("row")) % 7 != 0, (F.col("col") * 100 + F.col("row")).cast("double")))
    return grid.extract(grid.Grid(cells, -1.0, -1.0, 0.05), points(spark, sf_dir).select("row_id", "x", "y")).select("row_id", "band")


def _folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = orders(spark, sf_dir).withColumn("custd", (F.col("cust") % 7).cast("double"))
    return rows, rows.select("row_id", (F.col("row_id") % 4 + 1).cast("int").alias("fold"))


FOLDED = f"""{ORDERS}, f AS (SELECT *, (cust % 7)::DOUBLE custd, (row_id % 4 + 1)::INT fold FROM orders_r), k AS (SELECT DISTINCT fold k FROM f),
co AS (SELECT k, regr_slope(structured, price) pb, regr_intercept(structured, price) pa, regr_slope(structured, custd) cb, regr_intercept(structured, custd) ca FROM f, k WHERE fold <> k GROUP BY k)"""


@query(f"""WITH {FOLDED}, s AS (SELECT fold, sqrt(avg(pow(structured-pa-pb*price,2))) p, sqrt(avg(pow(structured-ca-cb*custd,2))) c FROM f JOIN co ON k = fold GROUP BY 1),
m AS (SELECT 'price' model, avg(p) mean, stddev_samp(p) sd, min(p) lo, max(p) hi FROM s UNION ALL SELECT 'custd', avg(c), stddev_samp(c), min(c), max(c) FROM s)
SELECT model, round(mean,6) mean, round(sd,6) sd, round(lo,6) "min", round(hi,6) "max", row_number() OVER (ORDER BY mean)::INT "rank" FROM m""")
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _folded(spark, sf_dir)
    models = {f: evaluation.Linear("structured", [f]) for f in ("price", "custd")}
    got = evaluation.compare_models(rows, made, models, "structured")
    return got.select("model", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "max")], "rank")


@query(f"""WITH {FOLDED}, h AS (SELECT fold, structured, pa+pb*price p FROM f JOIN co ON k = fold), q AS (SELECT fold, sqrt(avg(pow(structured-p,2))) rmse, avg(abs(structured-p)) mae, 1-sum(pow(structured-p,2))/(var_pop(structured)*count(*)) rsq FROM h GROUP BY ROLLUP (fold))
SELECT unnest(['rmse','mae','rsq']) metric, unnest([round(max(rmse) FILTER (WHERE fold IS NULL),6), round(max(mae) FILTER (WHERE fold IS NULL),6), round(max(rsq) FILTER (WHERE fold IS NULL),6)]) pooled,
unnest([round(avg(rmse) FILTER (WHERE fold IS NOT NULL),6), round(avg(mae) FILTER (WHERE fold IS NOT NULL),6), round(avg(rsq) FILTER (WHERE fold IS NOT NULL),6)]) mean_of_folds FROM q""")
def global_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _folded(spark, sf_dir)
    held = evaluation.held_out(rows, made, evaluation.Linear("structured", ["price"]))
    return evaluation.pooled_and_mean(held, "structured").select("metric", F.round("pooled", 6).alias("pooled"), F.round("mean_of_folds", 6).alias("mean_of_folds"))


@query(f"""WITH {FOLDED}, g AS (SELECT row_id, avg(pa+pb*price) m, stddev_samp(pa+pb*price) sd, max(pa+pb*price)-min(pa+pb*price) r, count(*) n FROM f, co GROUP BY 1)
SELECT row_id, round(m,3) mean, round(sd,3) sd, round(r,3) "range", n::INT n_models FROM g""")
def stability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _folded(spark, sf_dir)
    got = evaluation.stability_map(rows, made, evaluation.Linear("structured", ["price"], ridge=0.0), rows.select("row_id", "price"))
    return got.select("row_id", *[F.round(c, 3).alias(c) for c in ("mean", "sd", "range")], "n_models")


@query(f"""WITH {FOLDED}, e AS (SELECT k, 1/sqrt(avg(pow(structured-pa-pb*price,2))) w FROM f JOIN co ON k = fold GROUP BY 1), t AS (SELECT sum(w) tw FROM e),
g AS (SELECT row_id, sum(w/tw*(pa+pb*price)) m FROM f, co JOIN e USING (k), t GROUP BY 1) SELECT row_id, round(m,3) prediction FROM g""")
def ensemble_by_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _folded(spark, sf_dir)
    got = evaluation.ensemble(rows, made, evaluation.Linear("structured", ["price"], ridge=0.0), rows.select("row_id", "price"))
    return got.select("row_id", F.round("prediction", 3).alias("prediction"))


LEVELS = [(k / 10, NormalDist().inv_cdf(0.5 + k / 20)) for k in range(1, 10)]


@query(f"WITH {FOLDED}, h AS (SELECT abs(structured-pa-pb*price) e FROM f JOIN co ON k = fold), l AS (SELECT * FROM (VALUES {', '.join(f'({v}::DOUBLE, {z!r}::DOUBLE)' for v, z in LEVELS)}) t(level, z)) SELECT level, round(avg((e <= z*2.0)::INT),6) coverage FROM h, l GROUP BY 1")
def interval_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _folded(spark, sf_dir)
    held = evaluation.held_out(rows, made, evaluation.Linear("structured", ["price"])).withColumn("sd", F.lit(2.0))
    return evaluation.regression_calibration(held, "structured", "prediction", "sd").select("level", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {FOLDED}, b AS (SELECT fold, count(*) n, sum(price) p, sum(custd) c FROM f GROUP BY 1), t AS (SELECT sum(n) n, sum(p) p, sum(c) c FROM b)
SELECT row_id, 'price' feature, round(0.5*(price-(t.p-b.p)/(t.n-b.n)),4) contribution FROM f JOIN b USING (fold), t UNION ALL SELECT row_id, 'custd', round(2.0*(custd-(t.c-b.c)/(t.n-b.n)),4) FROM f JOIN b USING (fold), t""")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _folded(spark, sf_dir)
    model = evaluation.Linear("structured", ["price", "custd"])
    got = evaluation.marginal_contributions(model, [1.0, 0.5, 2.0], rows.join(made, "row_id"), "fold")
    return got.select("row_id", "feature", F.round("contribution", 4).alias("contribution"))


def _linear() -> evaluation.Linear:
    return evaluation.Linear("structured", ["price"], ridge=0.0)


@query(f"""WITH {FOLDED}, h AS (SELECT abs(structured-pa-pb*price) e FROM f JOIN co ON k = fold), o AS (SELECT regr_slope(structured, price) b, regr_intercept(structured, price) a FROM f WHERE fold % 2 = 1),
s AS (SELECT abs(structured-a-b*price) e FROM f, o WHERE fold % 2 = 0)
SELECT 'block_cv' AS method, count(*) n, round(list_sort(list(e))[ceil((count(*)+1)*0.9)::BIGINT],4) q FROM h UNION ALL SELECT 'split', count(*), round(list_sort(list(e))[ceil((count(*)+1)*0.9)::BIGINT],4) FROM s""")
def conformal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half widths of intervals from residuals of blocks that were held out whole, and of half of the blocks."""
    rows, made = _folded(spark, sf_dir)
    out = None
    for method in ("block_cv", "split"):
        fitter = _linear() if method == "block_cv" else (lambda train: _linear()(train))
        got = evaluation.conformal_width(evaluation.calibration_residuals(rows, made, fitter, "structured", method)).select(F.lit(method).alias("method"), "n", F.round("q", 4).alias("q"))
        out = got if out is None else out.unionByName(got)
    return out


@query(f"""WITH {FOLDED}, kb AS (SELECT DISTINCT (cust % 3)::INT k FROM orders_r), cb AS (SELECT k, regr_slope(structured, price) b, regr_intercept(structured, price) a FROM f, kb WHERE cust % 3 <> k GROUP BY k),
r AS (SELECT cust % 5 g, count(*) n, sqrt(avg(pow(structured-pa-pb*price,2))) m FROM f JOIN co ON k = fold GROUP BY 1), b AS (SELECT cust % 5 g, sqrt(avg(pow(structured-a-b*price,2))) m FROM f JOIN cb ON k = cust % 3 GROUP BY 1)
SELECT g "group", n, round(r.m,6) metric_random, round(b.m,6) metric_blocked, round(b.m-r.m,6) disparity FROM r JOIN b USING (g)""")
def fairness_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, made = _folded(spark, sf_dir)
    rows = rows.withColumn("group", F.col("cust") % 5)
    blocked = rows.select("row_id", (F.col("cust") % 3).cast("int").alias("fold"))
    got = evaluation.fairness(rows, made, blocked, _linear(), "structured", "group")
    return got.select("group", "n", *[F.round(c, 6).alias(c) for c in ("metric_random", "metric_blocked", "disparity")])


@query(f"""WITH {ORDERS}, f AS (SELECT *, 1 rep, (row_id % 4)::INT fold FROM orders_r UNION ALL SELECT *, 2, (row_id % 3)::INT FROM orders_r), k AS (SELECT DISTINCT rep, fold k FROM f),
co AS (SELECT f.rep, k, regr_slope(structured, price) b, regr_intercept(structured, price) a FROM f JOIN k ON f.rep = k.rep WHERE fold <> k GROUP BY 1, 2),
h AS (SELECT row_id, structured, a+b*price p FROM f JOIN co ON f.rep = co.rep AND k = fold)
SELECT row_id, round(avg(p),3) pred_mean, round(stddev_samp(p),3) pred_sd, count(*)::INT n_tested, round(any_value(structured)-avg(p),3) residual_mean FROM h GROUP BY 1""")
def prediction_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    repeats = rows.select(F.lit(1).alias("repeat"), "row_id", (F.col("row_id") % 4).cast("int").alias("fold")).unionByName(rows.select(F.lit(2).alias("repeat"), "row_id", (F.col("row_id") % 3).cast("int").alias("fold")))
    got = evaluation.prediction_map(rows, repeats, _linear(), "structured", "price", "cust")
    return got.select("row_id", *[F.round(c, 3).alias(c) for c in ("pred_mean", "pred_sd")], "n_tested", F.round("residual_mean", 3).alias("residual_mean"))


@query(f"""WITH {POINTS}, t AS (SELECT row_id % 4 + 1 fold, * FROM points), c AS (SELECT a.row_id, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) d FROM t a JOIN t b ON a.fold <> b.fold GROUP BY 1),
g AS (SELECT a.row_id, min(sqrt(pow(a.x+0.1-b.x,2)+pow(a.y-b.y,2))) d FROM t a, t b WHERE a.row_id % 5 = 0 GROUP BY 1), s AS (SELECT a.row_id, min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))) d FROM t a JOIN t b ON a.row_id <> b.row_id GROUP BY 1)
SELECT 'cv' kind, count(*) n, round(avg(d),6) mean, round(max(d),6) "max" FROM c UNION ALL SELECT 'target', count(*), round(avg(d),6), round(max(d),6) FROM g UNION ALL SELECT 'sample', count(*), round(avg(d),6), round(max(d),6) FROM s""")
def distance_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest distances of held-out rows, of places to predict at, and of all rows."""
    from ..operators.applicability import distance_profiles as profiles

    rows = points(spark, sf_dir).select("row_id", "x", "y")
    made = rows.select("row_id", (F.col("row_id") % 4 + 1).cast("int").alias("fold"))
    away = rows.where("row_id % 5 = 0").withColumn("x", F.col("x") + 0.1)
    got = profiles(rows, made, away, sample=1 << 30)
    return got.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.max("d"), 6).alias("max"))


@query(f"""WITH {POINTS}, r AS (SELECT corr(w,x) a, corr(w,y) b, corr(x,y) c, corr(e4,x) d, corr(e4,y) e FROM points)
SELECT 'w' predictor, round((a*a+b*b-2*a*b*c)/(1-c*c),6) r2, CASE WHEN (a*a+b*b-2*a*b*c)/(1-c*c) < 0.1 THEN 'low' WHEN (a*a+b*b-2*a*b*c)/(1-c*c) < 0.4 THEN 'moderate' ELSE 'high' END AS grade FROM r
UNION ALL SELECT 'e4', round((d*d+e*e-2*d*e*c)/(1-c*c),6), CASE WHEN (d*d+e*e-2*d*e*c)/(1-c*c) < 0.1 THEN 'low' WHEN (d*d+e*e-2*d*e*c)/(1-c*c) < 0.4 THEN 'moderate' ELSE 'high' END FROM r""")
def debias_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of predictors that a linear trend in the coordinates explains."""
    from ..operators.applicability import debias

    _, told = debias(points(spark, sf_dir), "x", "y", ["w", "e4"], degree=1)
    return told.select("predictor", F.round("r2", 6).alias("r2"), "grade")


@query(f"""WITH {ORDERS}, f AS (SELECT row_id, cust, day, (row_id % 5)::INT fold FROM orders_r), k AS (SELECT fold, count(*) n FROM f GROUP BY 1), g AS (SELECT cust, count(DISTINCT fold) folds FROM f GROUP BY 1)
SELECT fold, (SELECT count(*) FROM f)-n n_train, n n_test, 0::BIGINT n_overlap, (SELECT count(DISTINCT f.cust) FROM f JOIN g USING (cust) WHERE f.fold=k.fold AND folds>1) n_groups,
 (SELECT count(*) FROM f WHERE f.fold=k.fold AND f.day < (SELECT max(o.day) FROM f o WHERE o.fold<>k.fold)) n_early FROM k""")
def partition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return scope.partition_checks(rows, rows.select("row_id", (F.col("row_id") % 5).cast("int").alias("fold")), "day", "cust")


STAR = [(-0.1, -0.1), (0.1, -0.05), (0.2, 0.1), (0.05, 0.05), (-0.05, 0.2), (-0.2, 0.1)]
EDGES = ", ".join(f"({a[0]}::DOUBLE,{a[1]}::DOUBLE,{b[0]}::DOUBLE,{b[1]}::DOUBLE)" for a, b in zip(STAR, [*STAR[1:], STAR[0]]))


@query(f"WITH {POINTS}, e(x1,y1,x2,y2) AS (VALUES {EDGES}) SELECT row_id, count(*) FILTER (WHERE (y1>y)<>(y2>y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1) % 2 = 1 AS inside FROM points, e GROUP BY row_id")
def inside_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("row_id", integrity.inside_polygon(STAR, F.col("x"), F.col("y")).alias("inside"))


@query(f"""WITH {ORDERS} SELECT sum((role='train')::INT)::BIGINT n_train, sum((role='test')::INT)::BIGINT n_test, count(DISTINCT cust) FILTER (WHERE cust IN (SELECT cust FROM orders_r WHERE role='train') AND cust IN (SELECT cust FROM orders_r WHERE role='test')) n_groups,
'a split of its own groups: unusable' verdict FROM orders_r""")
def split_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validate_split says of a split that shares customers: it raises, and names as many as the join finds."""
    rows = orders(spark, sf_dir)
    split = rows.select("row_id", "role")
    try:
        integrity.validate_split(rows.drop("role"), split, group="cust")
        said, n = "usable", 0
    except integrity.HardViolation as e:
        said, n = "a split of its own groups: unusable", int(next(w for w in str(e).split() if w.isdigit()))
    return split.agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")).select("n_train", "n_test", F.lit(n).cast("long").alias("n_groups"), F.lit(said).alias("verdict"))
