"""Dependence diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import global_position
from ..operators import diagnosis as D
from .tables import ORDERS, POINTS, SAMPLE, events, orders, points, table


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _icc(df: DataFrame, group: str, value: str) -> DataFrame:
    return _round(D.intraclass(df, group, value), "m", "msb", "msw", "icc_raw", "icc", "deff")


def icc_orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _icc(orders(spark, sf_dir).withColumn("scaled", F.col("price") / 1e5), "cust", "scaled")


def icc_orders_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _icc(orders(spark, sf_dir), "cust", "structured")


def icc_customer_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_acctbal") / 1e3 + F.col("c_nationkey") % 5).alias("v"))
    return _icc(rows, "c_nationkey", "v")


def _icc_sql(ctes: str, source: str, group: str, value: str) -> str:
    return f"""WITH {ctes}{', ' if ctes else ''}r AS (SELECT {group} g, {value} v FROM {source}),
b AS (SELECT g, count(*) c, avg(v) a, var_pop(v) p FROM r GROUP BY g),
t AS (SELECT count(*) k, sum(c)::BIGINT n, sum(c*a)/sum(c) gm, sum(c*p) ssw FROM b),
s AS (SELECT sum(c*pow(a-gm,2)) ssb FROM b, t),
m AS (SELECT k, n, n/k m, ssb/(k-1) msb, ssw/(n-k) msw FROM t, s),
i AS (SELECT *, (msb-msw)/(msb+(m-1)*msw) icc_raw FROM m), j AS (SELECT *, least(1.0,greatest(0.0,icc_raw)) icc FROM i)
SELECT k, n, round(m,6) m, round(msb,6) msb, round(msw,6) msw, round(icc_raw,6) icc_raw, round(icc,6) icc, round(1+(m-1)*icc,6) deff FROM j"""


def _series(spark: SparkSession, sf_dir: str, running: bool) -> DataFrame:
    rows = events(spark, sf_dir)
    placed = global_position(rows, "ts", "row_id")
    if not running:
        return placed.select("pos", F.col("value").alias("v"))
    mean = rows.agg(F.avg("value")).first()[0]
    from pyspark.sql.window import Window

    blocks = placed.select("pos", (F.col("value") - mean).alias("d"), F.floor((F.col("pos") - 1) / 100_000).alias("blk"))
    prior = blocks.groupBy("blk").agg(F.sum("d").alias("s")).withColumn("prior", F.coalesce(F.sum("s").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("s")
    inner = F.sum("d").over(Window.partitionBy("blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("here", inner).join(F.broadcast(prior), "blk").select("pos", (F.col("here") + F.col("prior")).alias("v"))


def acf_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.autocorrelation(_series(spark, sf_dir, False)), "acf")


def acf_events_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.autocorrelation(_series(spark, sf_dir, True)), "acf")


def ljung_box_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.ljung_box(D.autocorrelation(_series(spark, sf_dir, False))), "q")


def _acf_sql(running: bool) -> str:
    source = (
        "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) pos, value v FROM events)"
        if not running
        else "s AS (SELECT row_number() OVER (ORDER BY ts, event_id) pos, sum(value-(SELECT avg(value) FROM events)) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) v FROM events)"
    )
    return f"""WITH {source}, m AS (SELECT avg(v) m, var_pop(v)*count(*) ss, count(*) n FROM s), k AS (SELECT unnest(range(1,21))::INT lag)
SELECT lag, round(sum((a.v-m)*(b.v-m))/any_value(ss),6) acf, any_value(n) n FROM k, m, s a JOIN s b ON b.pos = a.pos - lag GROUP BY lag"""


LJUNG_SQL = f"""WITH a AS ({_acf_sql(False).replace('round(sum((a.v-m)*(b.v-m))/any_value(ss),6)', 'sum((a.v-m)*(b.v-m))/any_value(ss)')})
SELECT round(sum(n*(n+2)*pow(acf,2)/(n-lag)),6) q, max(n) n FROM a WHERE lag <= 10"""


def moran_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.moran(points(spark, sf_dir)), "i", "expected", "variance", "z")


def moran_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.moran(points(spark, sf_dir).withColumn("v", F.col("w"))), "i", "expected", "variance", "z")


def _moran_sql(value: str) -> str:
    return f"""WITH {POINTS}, {SAMPLE.replace('x, y, v', f'x, y, {value} v')}, c AS (SELECT row_id, x, y, v-(SELECT avg(v) FROM sampled) v FROM sampled),
p AS (SELECT a.row_id i, b.row_id j, a.v vi, b.v vj, 1/(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))+1e-10) w FROM c a JOIN c b ON a.row_id<>b.row_id),
r AS (SELECT i, sum(w) s FROM p GROUP BY i), q AS (SELECT p.i, p.j, vi, vj, w/a.s wij, w/b.s wji FROM p JOIN r a ON p.i=a.i JOIN r b ON p.j=b.i),
t AS (SELECT sum(wij*vi*vj) num, sum(wij) s0, sum(pow(wij+wji,2))/2 s1 FROM q), u AS (SELECT sum(pow(1+c,2)) s2 FROM (SELECT j, sum(wij) c FROM q GROUP BY j)),
m AS (SELECT sum(pow(v,2)) m2, sum(pow(v,4)) m4, count(*)::DOUBLE n FROM c), k AS (SELECT *, n*m4/pow(m2,2) k, -1/(n-1) e FROM m, t, u),
z AS (SELECT n::BIGINT n, n/s0*num/m2 i, e, greatest(1e-10, (n*((n*n-3*n+3)*s1-n*s2+3*s0*s0)-k*((n*n-n)*s1-2*n*s2+6*s0*s0))/((n-1)*(n-2)*(n-3)*s0*s0)-e*e) var FROM k)
SELECT n, round(i,6) i, round(e,6) expected, round(var,6) variance, round((i-e)/sqrt(var),6) z FROM z"""


def variogram_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.variogram(points(spark, sf_dir)), "distance", "gamma")


def spatial_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(D.spatial_range(D.variogram(points(spark, sf_dir))), "spatial_range")


VARIOGRAM = f"""WITH {POINTS}, {SAMPLE}, p AS MATERIALIZED (SELECT sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) d, pow(a.v-b.v,2)/2 g FROM sampled a JOIN sampled b ON a.row_id<b.row_id),
q AS MATERIALIZED (SELECT quantile_cont(d, [{', '.join(f'{k}/15.0' for k in range(1, 15))}]) b FROM p), f AS (SELECT (1 + {' + '.join(f'(d > b[{k}])::INT' for k in range(1, 15))})::INT bin, d, g FROM p, q),
v AS (SELECT bin, avg(d) distance, avg(g) gamma, count(*) n FROM f GROUP BY bin) """


def diagnosis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole diagnosis of orders (time, customer, structured target) as rows an axis, with power and inflation."""
    d = D.diagnose(orders(spark, sf_dir), None, "day", "cust", "structured")
    p = D.power(d)
    rows = [(a, f, float(s) if s is not None else None) for a, f, s, _ in d.rows()]
    rows += [("design_effect", None, p["design_effect"]), ("n_effective", None, p["n_effective"]), ("power", None, p["power"]), ("inflation", None, d.inflation["auc_inflation"] if d.inflation else None)]
    return spark.createDataFrame([(*r, d.recommended, d.severity) for r in rows], "item string, detected boolean, value double, recommended string, severity string")


def inflation_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected optimism from the intraclass correlation of the structured orders."""
    got = D.intraclass(orders(spark, sf_dir), "cust", "structured")
    lost = 0.4 * (F.col("deff") - 1) / F.col("deff")
    return got.select(D.severity(icc=F.when(F.col("icc") > 0.05, F.col("icc"))).alias("severity"), F.round(F.least(F.lit(0.6), lost), 6).alias("auc_inflation"), F.round(0.8 * F.least(F.lit(0.6), lost), 6).alias("rmse_deflation"))


INFLATION_SQL = _icc_sql(ORDERS, "orders_r", "cust", "structured").split("\nSELECT k, n,")[0] + """
SELECT CASE WHEN icc > 0.3 THEN 'severe' WHEN icc > 0.05 THEN 'moderate' ELSE 'none' END severity, round(least(0.6, 0.4*((m-1)*icc)/(1+(m-1)*icc)),6) auc_inflation, round(0.8*least(0.6, 0.4*((m-1)*icc)/(1+(m-1)*icc)),6) rmse_deflation FROM j"""


def haversine_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distances in km of points read as longitude and latitude from a fixed city."""
    rows = points(spark, sf_dir).select("row_id", (F.col("x") * 60).alias("lon"), (F.col("y") * 30).alias("lat"))
    d = D.haversine(F.lit(-0.1278), F.lit(51.5074), F.col("lon"), F.col("lat"))
    return rows.select("row_id", F.round(d / 1000, 6).alias("km"))


QUERIES = {
    "icc_orders_customer": (icc_orders_customer, _icc_sql(ORDERS, "orders_r", "cust", "price/1e5")),
    "icc_orders_structured": (icc_orders_structured, _icc_sql(ORDERS, "orders_r", "cust", "structured")),
    "icc_customer_nation": (icc_customer_nation, _icc_sql("", "customer", "c_nationkey", "c_acctbal/1e3 + c_nationkey % 5")),
    "acf_events": (acf_events, _acf_sql(False)),
    "acf_events_running": (acf_events_running, _acf_sql(True)),
    "ljung_box_events": (ljung_box_events, LJUNG_SQL),
    "moran_embeddings": (moran_embeddings, _moran_sql("v")),
    "moran_raw": (moran_raw, _moran_sql("w")),
    "variogram_embeddings": (variogram_embeddings, VARIOGRAM + "SELECT bin, round(distance,6) distance, round(gamma,6) gamma, n FROM v"),
    "spatial_range": (spatial_range, VARIOGRAM + "SELECT round(min_by(distance, bin),6) spatial_range FROM v WHERE gamma >= 0.95*(SELECT max(gamma) FROM v)"),
    "inflation_clustered": (inflation_clustered, INFLATION_SQL),
    "haversine_points": (haversine_nations, f"WITH {POINTS} SELECT row_id, round(2*6371*asin(least(1.0, sqrt(pow(sin(radians(y*30-51.5074)/2),2)+cos(radians(51.5074))*cos(radians(y*30))*pow(sin(radians(x*60+0.1278)/2),2)))),6) km FROM points"),
    "diagnosis_summary": (diagnosis_summary, None),
}
