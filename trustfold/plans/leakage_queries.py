"""Split checks, leakage detectors and text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds, integrity, leakage, text_rules
from .tables import ORDERS, POINTS, orders, points, table


def split_chrono_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.chronological_split(orders(spark, sf_dir), "day")


def check_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return integrity.index_overlap(rows.where("row_id % 3 <> 0"), rows.where("row_id % 4 = 0")).select("row_id")


def check_group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.group_overlap(orders(spark, sf_dir), "cust")


def check_temporal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.temporal_order(orders(spark, sf_dir), "day")[0].select("row_id", "day")


def check_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), "p_size", F.floor(F.col("p_retailprice") / 10).alias("tens"), F.when(F.col("p_partkey") % 4 == 0, "test").otherwise("train").alias("role"))
    return integrity.duplicate_rows(part, ["p_size", "tens"]).select("row_id")


def _leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with a direct leak, a proxy and clean features; train rows have odd order keys."""
    return table(spark, sf_dir, "lineitem").select(
        "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        (F.col("l_extendedprice") * 1.01 + F.col("l_quantity")).alias("direct"),
        (F.col("l_extendedprice") + 7000 * (F.col("l_discount") * 100 % 10)).alias("proxy"),
        F.when(F.col("l_orderkey") % 2 == 1, "train").otherwise("test").alias("role"),
    )


def corr_leakage_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leaky(spark, sf_dir)
    got = integrity.correlations(rows, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "direct", "proxy"])
    r = F.abs("r")
    return got.select("feature", F.round("r", 6).alias("r"), "n", F.when(r > 0.99, "target_leakage_direct").when(r >= 0.95, "target_leakage_proxy").otherwise("none").alias("type"))


CORR_SQL = """WITH l AS (SELECT l_extendedprice, l_quantity, l_discount, l_tax, l_extendedprice*1.01+l_quantity direct, l_extendedprice+7000*(l_discount*100 % 10) proxy FROM lineitem WHERE l_orderkey % 2 = 1),
c AS (SELECT 'l_quantity' feature, corr(l_quantity, l_extendedprice) r, count(*) n FROM l UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice), count(*) FROM l
 UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice), count(*) FROM l UNION ALL SELECT 'direct', corr(direct, l_extendedprice), count(*) FROM l UNION ALL SELECT 'proxy', corr(proxy, l_extendedprice), count(*) FROM l)
SELECT feature, round(r,6) r, n, CASE WHEN abs(r)>0.99 THEN 'target_leakage_direct' WHEN abs(r)>=0.95 THEN 'target_leakage_proxy' ELSE 'none' END AS type FROM c"""


def spatial_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).withColumn("role", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    return integrity.spatial_proximity(rows, share=0.05).select("row_id", F.round("d", 6).alias("d"))


def target_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumns({"customer": F.col("cust").cast("string"), "effect": F.col("cust") % 7 * 100 + F.col("price") / 1e6, "seventh": (F.col("cust") % 7).cast("string")})
    return leakage.categorical_target(rows, "effect", ["seventh", "customer"]).select("feature", F.round("explained", 6).alias("explained"), "leak")


def target_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    means = rows.where("role = 'train'").groupBy("cust").agg((F.avg("structured") * 2 + 1).alias("encoded"))
    got = leakage.group_mean_target(rows.join(means, "cust"), "structured", "cust", ["encoded", "price"])
    return got.select("feature", F.round("r", 6).alias("r"), "leak")


def fe_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumn("role", F.when(F.col("price") < 200_000, "train").otherwise("test"))
    m, s = rows.agg(F.avg("price"), F.stddev_samp("price")).first()
    got = leakage.standardised_on_all(rows.withColumn("scaled", (F.col("price") - m) / s), ["scaled", "structured"])
    return got.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "train_mean", "train_sd")], "leak")


def fe_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumn("role", F.when(F.col("price") < 200_000, "train").otherwise("test"))
    m = rows.agg(F.max("price")).first()[0]
    return leakage.ranks_on_all(rows.withColumns({"price_pct": F.col("price") / m, "key_pct": F.lit(0.5) + F.col("row_id") % 2 / 10}), ["price_pct", "key_pct"])


def fe_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).withColumn("role", F.when(F.col("price") < 200_000, "train").otherwise("test"))
    return leakage.bins_only_in_test(rows.withColumns({"price_bin": F.floor(F.col("price") / 50_000), "cust_bin": F.col("cust") % 5}), ["price_bin", "cust_bin"])


def fe_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.common import global_position

    rows = global_position(orders(spark, sf_dir), "day", "row_id")
    before = rows.select((F.col("pos") + 2).alias("pos"), (F.col("structured") * 3).alias("lagged"))
    got = leakage.lagged_targets(rows.join(before, "pos", "left").drop("pos"), "structured", ["lagged", "price"], "day")
    return got.select("feature", "lag", F.round("r", 6).alias("r"), "leak")


SENTENCES = [
    (-1, "We used random 10-fold cross-validation on species distribution data with latitude and longitude."),
    (-2, "The entire dataset was normalized and a random k-fold was run on a monthly time series."),
    (-3, "Variable selection was performed before spatial block cross-validation at each site location."),
    (-4, "Feature selection was conducted separately; 5-fold cross-validation followed at geographic coordinates."),
    (-5, "A temporal split of daily values; PCA before splitting."),
    (-6, "A single train-test split; the model was fitted on all data."),
]


def literature_check_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    said = spark.createDataFrame(SENTENCES, "doc_id bigint, text string")
    got = text_rules.check_texts(docs.unionByName(said), "doc_id", strict=True)
    return got.select("doc_id", "context", "pattern", "severity", "matched_text")


def _literature_sql() -> str:
    count = lambda words: " + ".join(f"contains(low, '{w}')::INT" for w in words)
    values = ", ".join(f"({i}, '{t}')" for i, t in SENTENCES)
    parts = []
    for name, where, _, pattern, exception, level in text_rules.RULES:
        cond = f"regexp_matches(low, '{pattern}')" + (f" AND context = '{where}'" if where else "") + (f" AND NOT regexp_matches(low, '{exception}')" if exception else "")
        parts.append(f"SELECT doc_id, context, '{name}' pattern, '{level}' severity, substr(regexp_extract(low, '({pattern})', 1), 1, 80) matched_text FROM c WHERE {cond}")
    return f"""WITH d AS (SELECT doc_id, lower(text) low FROM documents UNION ALL SELECT i, lower(t) FROM (VALUES {values}) v(i, t)),
k AS (SELECT doc_id, low, {count(text_rules.SPATIAL_WORDS)} s, {count(text_rules.TEMPORAL_WORDS)} t FROM d WHERE low IS NOT NULL),
c AS (SELECT *, CASE WHEN s>=2 AND s>t THEN 'spatial' WHEN t>=2 AND t>s THEN 'temporal' WHEN s>=1 AND t>=1 THEN 'spatial' ELSE 'general' END context FROM k)
""" + " UNION ALL ".join(parts)


def threshold_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    got = leakage.youden_threshold(rows, "quality", "n_chars", 11)
    return got.select(F.round("threshold", 6).alias("threshold"), F.round("j", 6).alias("j"))


YOUDEN_SQL = """WITH r AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)),
q AS (SELECT DISTINCT unnest(quantile_cont(n_chars, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0])) c FROM r),
j AS (SELECT c, count(*) FILTER (WHERE quality=1 AND n_chars>=c)/(count(*) FILTER (WHERE quality=1))::DOUBLE + count(*) FILTER (WHERE quality=0 AND n_chars<c)/(count(*) FILTER (WHERE quality=0))::DOUBLE - 1 AS j FROM r, q GROUP BY c)
SELECT round(c::DOUBLE,6) threshold, round(j,6) j FROM j ORDER BY j.j DESC, c LIMIT 1"""


def fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    inner = rows.select((F.col("row_id") % 5 + 1).cast("int").alias("fold"), "row_id", F.when(F.col("row_id") % 3 == 0, "test").otherwise("train").alias("role"))
    return leakage.fold_leaks(inner, rows.select("row_id", "role"))


QUERIES = {
    "split_chrono_orders": (split_chrono_orders, "SELECT o_orderkey row_id, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor((SELECT count(*) FROM orders)*0.75) THEN 'train' ELSE 'test' END AS role FROM orders"),
    "check_overlap": (check_overlap, "SELECT o_orderkey row_id FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0"),
    "check_group_overlap": (check_group_overlap, f"WITH {ORDERS} SELECT cust, count(*) FILTER (WHERE role='test') n_test, count(*) FILTER (WHERE role='train') n_train FROM orders_r GROUP BY cust HAVING count(DISTINCT role) = 2"),
    "check_temporal_order": (check_temporal_order, f"WITH {ORDERS} SELECT row_id, day FROM orders_r WHERE role='test' AND day < (SELECT max(day) FROM orders_r WHERE role='train')"),
    "check_duplicates": (check_duplicates, "SELECT p_partkey row_id FROM part p WHERE p_partkey % 4 = 0 AND EXISTS (SELECT 1 FROM part t WHERE t.p_partkey % 4 <> 0 AND t.p_size IS NOT DISTINCT FROM p.p_size AND floor(t.p_retailprice/10) IS NOT DISTINCT FROM floor(p.p_retailprice/10))"),
    "corr_leakage_lineitem": (corr_leakage_lineitem, CORR_SQL),
    "spatial_proximity": (spatial_proximity, f"""WITH {POINTS}, s AS (SELECT 0.05*sqrt(var_samp(x)+var_samp(y)) r FROM points WHERE row_id % 4 <> 0)
SELECT a.row_id, round(min(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))),6) d FROM points a, points b, s WHERE a.row_id % 4 = 0 AND b.row_id % 4 <> 0 AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) < r GROUP BY a.row_id"""),
    "target_categorical": (target_categorical, f"""WITH {ORDERS}, t AS (SELECT cust, cust % 7 * 100 + price/1e6 e FROM orders_r WHERE role='train'),
c AS (SELECT 'seventh' feature, avg(v) w FROM (SELECT var_samp(e) v FROM t GROUP BY cust % 7) UNION ALL SELECT 'customer', avg(v) FROM (SELECT var_samp(e) v FROM t GROUP BY cust))
SELECT feature, round(1 - w/(SELECT var_samp(e) FROM t), 6) explained, 1 - w/(SELECT var_samp(e) FROM t) > 0.99 AS leak FROM c"""),
    "target_group_mean": (target_group_mean, f"""WITH {ORDERS}, m AS (SELECT cust, avg(structured) m FROM orders_r WHERE role='train' GROUP BY cust), j AS (SELECT price, m, m*2+1 e FROM orders_r JOIN m USING (cust) WHERE role='train')
SELECT 'encoded' feature, round(corr(e,m),6) r, abs(corr(e,m))>0.99 AS leak FROM j UNION ALL SELECT 'price', round(corr(price,m),6), abs(corr(price,m))>0.99 FROM j"""),
    "fe_standardised": (fe_standardised, f"""WITH {ORDERS}, s AS (SELECT price, structured, (price-(SELECT avg(price) FROM orders_r))/(SELECT stddev_samp(price) FROM orders_r) scaled FROM orders_r),
u AS (SELECT 'scaled' feature, avg(scaled) m, stddev_samp(scaled) s, avg(scaled) FILTER (WHERE price<200000) tm, stddev_samp(scaled) FILTER (WHERE price<200000) ts FROM s
 UNION ALL SELECT 'structured', avg(structured), stddev_samp(structured), avg(structured) FILTER (WHERE price<200000), stddev_samp(structured) FILTER (WHERE price<200000) FROM s)
SELECT feature, round(m,6)+0.0 mean, round(s,6) sd, round(tm,6) train_mean, round(ts,6) train_sd, abs(m)<0.01 AND abs(s-1)<0.01 AND (abs(tm)>0.05 OR abs(ts-1)>0.05) AS leak FROM u"""),
    "fe_rank": (fe_rank, f"""WITH {ORDERS}, s AS (SELECT price, price/(SELECT max(price) FROM orders_r) p FROM orders_r)
SELECT 'price_pct' feature, min(p)>=0 AND max(p)<=1 AND max(p) FILTER (WHERE price>=200000) > 1.1*max(p) FILTER (WHERE price<200000) AS leak FROM s UNION ALL SELECT 'key_pct', false"""),
    "fe_binning": (fe_binning, f"""WITH {ORDERS}, s AS (SELECT price, floor(price/50000)::BIGINT a, cust % 5 b FROM orders_r),
u AS (SELECT 'price_bin' feature, count(*) k, count(*) FILTER (WHERE t=0) n FROM (SELECT a, count(*) FILTER (WHERE price<200000) t FROM s GROUP BY a) UNION ALL SELECT 'cust_bin', count(*), count(*) FILTER (WHERE t=0) FROM (SELECT b, count(*) FILTER (WHERE price<200000) t FROM s GROUP BY b))
SELECT feature, k, n n_only_test, k BETWEEN 2 AND 20 AND k < 0.1*(SELECT count(*) FROM s) AND n>0 AS leak FROM u"""),
    "fe_lag": (fe_lag, f"""WITH {ORDERS}, p AS (SELECT *, lag(structured,2) OVER (ORDER BY day,row_id)*3 lagged, {', '.join(f'lag(structured,{k}) OVER (ORDER BY day,row_id) l{k}' for k in range(1, 6))} FROM orders_r),
u AS ({' UNION ALL '.join(f"SELECT '{f}' feature, {k} lag, corr({f}, l{k}) r FROM p" for f in ('lagged', 'price') for k in range(1, 6))})
SELECT feature, lag::INT lag, round(r,6) r, abs(r)>0.99 AS leak FROM u"""),
    "literature_check_docs": (literature_check_docs, _literature_sql()),
    "threshold_youden": (threshold_youden, YOUDEN_SQL),
    "fold_leakage": (fold_leakage, f"""WITH {ORDERS} SELECT (row_id % 5 + 1)::INT fold, count(*) FILTER (WHERE role='test') n_test_leaked, count(*) FILTER (WHERE role<>'train') n_not_train FROM orders_r WHERE row_id % 3 <> 0 GROUP BY 1"""),
}
