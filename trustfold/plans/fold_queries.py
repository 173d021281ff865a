"""Fold strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds as O
from .tables import ORDERS, POINTS, orders, points, table

DAY = 86400.0


def _few(df: DataFrame) -> DataFrame:
    return df.select("row_id", "fold")


QUERIES = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


@query("SELECT o_orderkey row_id, ((row_number() OVER (ORDER BY md5('42:'||o_orderkey), o_orderkey)-1) % 5 + 1)::INT fold FROM orders")
def folds_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.random_folds(orders(spark, sf_dir)))


EXTENT = "e AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM points), s AS (SELECT *, greatest(x1-x0,y1-y0)/sqrt(10) b FROM e)"


@query(f"WITH {POINTS}, {EXTENT} SELECT row_id, ((floor((x-x0)/b)+floor((y-y0)/b))::BIGINT % 5 + 1)::INT fold FROM points, s")
def folds_checkerboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.checkerboard(points(spark, sf_dir), "x", "y"))


@query(f"""WITH {POINTS}, {EXTENT}, r AS (SELECT row_id, x, x0, b, 2*b/sqrt(3) w, floor((y-y0)/(0.75*b)) rw FROM points, s), c AS (SELECT row_id, rw, floor((x-x0-CASE WHEN rw % 2 = 1 THEN w/2 ELSE 0 END)/w) cl FROM r)
SELECT row_id, ((dense_rank() OVER (ORDER BY rw, cl)-1) % 5 + 1)::INT fold FROM c""")
def folds_hexagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.hexagonal(points(spark, sf_dir), "x", "y"))


@query("""WITH RECURSIVE g AS (SELECT c_nationkey, row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)) p, count(*) n FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1),
r AS (SELECT 0::BIGINT p, [0,0,0,0,0]::BIGINT[] l, 0::BIGINT f UNION ALL
 SELECT r.p+1, list_transform(l, lambda x, i: x + CASE WHEN i = list_position(l, list_min(l)) THEN g.n ELSE 0 END), list_position(l, list_min(l))::BIGINT FROM r JOIN g ON g.p = r.p+1)
SELECT c_custkey row_id, r.f::INT fold FROM customer JOIN g USING (c_nationkey) JOIN r ON r.p = g.p""")
def folds_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.group_folds(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_nationkey"), "c_nationkey"))


@query(f"""WITH {POINTS}, l AS (SELECT DISTINCT round(x,2) lx, round(y,2) ly FROM points), h AS (SELECT *, row_number() OVER (ORDER BY md5('42:'||printf('%.2f',lx)||':'||printf('%.2f',ly))) p FROM l)
SELECT count(*) n_locations, count(DISTINCT (p-1) % 5) n_folds FROM h""")
def folds_location_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = O.leave_location_out(points(spark, sf_dir), "x", "y", digits=2)
    spots = got.groupBy(F.round("x", 2).alias("a"), F.round("y", 2).alias("b")).agg(F.count_distinct("fold").alias("k"), F.min("fold").alias("f"))
    return spots.agg(F.count("*").alias("n_locations"), F.count_distinct(F.when(F.col("k") == 1, F.col("f"))).alias("n_folds"))


TIMED = f"{ORDERS}, t AS (SELECT row_id, epoch_us(day)/1e6 t, row_number() OVER (ORDER BY day, row_id) pos, count(*) OVER () n FROM orders_r)"


@query(f"""WITH {TIMED}, k AS (SELECT unnest(range(1,6)) k), b AS (SELECT k, round_even((k-1)*n/5.0,0)+1 c, round_even(k*n/5.0,0) d FROM k, (SELECT any_value(n) n FROM t)),
f AS (SELECT k, c, d, min(t) t0 FROM b JOIN t ON pos BETWEEN c AND d GROUP BY k, c, d), g AS (SELECT 0.05*(max(t)-min(t)) e FROM t),
r AS (SELECT k fold, row_id, CASE WHEN pos BETWEEN c AND d THEN 'test' ELSE 'train' END AS role FROM f JOIN t ON pos BETWEEN c AND d OR pos < c JOIN g ON pos BETWEEN c AND d OR t < t0 - e)
SELECT fold::INT fold, row_id, role FROM r WHERE fold IN (SELECT fold FROM r GROUP BY fold HAVING count(*) FILTER (WHERE role='train') >= 10)""")
def folds_temporal_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.temporal_blocks(orders(spark, sf_dir), "day")


@query(f"""WITH {TIMED}, z AS (SELECT any_value(n) n, any_value(n)//6 s FROM t), k AS (SELECT unnest(range(0,5)) k), b AS (SELECT k+1 fold, greatest(2*s, n-5*s)+k*s b, least(n, greatest(2*s, n-5*s)+(k+1)*s) d FROM k, z WHERE greatest(2*s, n-5*s)+k*s < n),
f AS (SELECT fold, b, d, min(t) t0 FROM b JOIN t ON pos > b AND pos <= d GROUP BY fold, b, d)
SELECT fold::INT fold, row_id, CASE WHEN pos > b THEN 'test' ELSE 'train' END AS role FROM f JOIN t ON (pos > b AND pos <= d) OR (pos <= b AND t < t0 - {30 * DAY})""")
def folds_temporal_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.temporal_expanding(orders(spark, sf_dir), "day", embargo=30 * DAY)


@query(f"""WITH {TIMED}, z AS (SELECT any_value(n) n, any_value(n)//6 s FROM t), k AS (SELECT unnest(range(0,5)) k), b AS (SELECT k+1 fold, k*greatest(1,(n-4*s)//4) a, s FROM k, z),
f AS (SELECT fold, a, s, min(t) t0 FROM b JOIN t ON pos > a+3*s AND pos <= a+4*s GROUP BY fold, a, s)
SELECT fold::INT fold, row_id, CASE WHEN pos > a+3*s THEN 'test' ELSE 'train' END AS role FROM f JOIN t ON (pos > a+3*s AND pos <= a+4*s) OR (pos > a AND pos <= a+3*s AND t < t0)""")
def folds_temporal_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.temporal_sliding(orders(spark, sf_dir), "day")


@query(f"""WITH {TIMED}, z AS (SELECT min(t) a, max(t) b FROM t), g AS (SELECT row_id, t, greatest(1, least(6, ceil((t-a)/((b-a)/6))))::INT g FROM t, z), e AS (SELECT g fold, min(t) t0, max(t) t1 FROM g WHERE g <= 5 GROUP BY g)
SELECT fold, row_id, CASE WHEN g = fold THEN 'test' ELSE 'train' END AS role FROM g, e WHERE g = fold OR t < t0 - {30 * DAY} OR t > t1 + {30 * DAY}""")
def folds_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.purged(orders(spark, sf_dir), "day", embargo=30 * DAY)


@query(f"""WITH {ORDERS}, m AS (SELECT cust, avg(epoch_us(day)/1e6) t FROM orders_r GROUP BY cust), r AS (SELECT cust, ((row_number() OVER (ORDER BY t, cust)-1) % 5 + 1)::INT fold FROM m)
SELECT row_id, fold FROM orders_r JOIN r USING (cust)""")
def folds_temporal_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.temporal_groups(orders(spark, sf_dir), "cust", "day"))


@query(f"""WITH {ORDERS}, z AS (SELECT min(epoch_us(day)/1e6) a, max(epoch_us(day)/1e6) b FROM orders_r), g AS (SELECT row_id, cust, greatest(1, least(5, ceil((epoch_us(day)/1e6-a)/((b-a)/5))))::INT bin FROM orders_r, z),
c AS (SELECT cust, bin, ((row_number() OVER (ORDER BY md5('42:'||cust||':'||bin), cust, bin)-1) % 5 + 1)::INT fold FROM (SELECT DISTINCT cust, bin FROM g))
SELECT row_id, fold FROM g JOIN c USING (cust, bin)""")
def folds_llto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.leave_location_and_time_out(orders(spark, sf_dir), "cust", "day"))


PAIRS = "d AS (SELECT a.row_id a, b.row_id b, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) d FROM points a JOIN points b ON a.row_id<>b.row_id)"


@query(f"""WITH {POINTS}, {EXTENT}, {PAIRS}, n AS (SELECT a, count(*) n FROM d, s WHERE d.d <= 0.1*greatest(x1-x0,y1-y0) GROUP BY a)
SELECT row_id, coalesce(n,0) n_excluded, (SELECT count(*) FROM points)-1-coalesce(n,0) n_train FROM points LEFT JOIN n ON row_id=a""")
def spatial_loo_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.spatial_loo(points(spark, sf_dir))


@query(f"""WITH {POINTS}, f AS (SELECT row_id, (row_id % 5 + 1)::INT fold FROM points), {PAIRS}, x AS (SELECT DISTINCT g.fold, d.a FROM d JOIN f h ON d.a=h.row_id JOIN f g ON d.b=g.row_id WHERE d.d<=0.05 AND g.fold<>h.fold)
SELECT k.fold, f.row_id, CASE WHEN f.fold=k.fold THEN 'test' ELSE 'train' END AS role FROM f, (SELECT DISTINCT fold FROM f) k WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.fold=k.fold AND x.a=f.row_id)""")
def buffer_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    return O.buffered(rows.select("row_id", (F.col("row_id") % 5 + 1).cast("int").alias("fold")), rows, 0.05)


@query(f"""WITH {POINTS}, e AS (SELECT max(x)-min(x) ex, max(y)-min(y) ey FROM points)
SELECT (row_id % 5 + 1)::INT fold, count(*) n, round((max(x)-min(x))/any_value(ex),6) x_share, round((max(y)-min(y))/any_value(ey),6) y_share, round(avg(x),6) x_mean, round(avg(y),6) y_mean, (max(x)-min(x))/any_value(ex)>=0.2 AND (max(y)-min(y))/any_value(ey)>=0.2 AS balanced FROM points, e GROUP BY 1""")
def coverage_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    got = O.coverage(rows.select("row_id", (F.col("row_id") % 5 + 1).cast("int").alias("fold")), rows)
    return got.withColumns({c: F.round(c, 6) for c in ("x_share", "y_share", "x_mean", "y_mean")})


@query("""WITH r AS (SELECT r+1 repeat, o_orderkey row_id, ((row_number() OVER (PARTITION BY r ORDER BY md5((42+1000*r)||':'||o_orderkey), o_orderkey)-1) % 5 + 1)::INT fold FROM orders, (SELECT unnest(range(0,3)) r)),
c AS (SELECT repeat, fold, count(*) n FROM r GROUP BY 1,2), b AS (SELECT a.fold, a.repeat r1, b.repeat r2, count(*) m FROM r a JOIN r b ON a.fold=b.fold AND a.row_id=b.row_id AND a.repeat<b.repeat GROUP BY 1,2,3)
SELECT fold, r1::INT r1, r2::INT r2, round(m/(x.n+y.n-m)::DOUBLE,6) jaccard FROM b JOIN c x USING (fold) JOIN c y USING (fold) WHERE x.repeat=r1 AND y.repeat=r2""")
def jaccard_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = O.overlap_of_repeats(O.repeated(orders(spark, sf_dir).select("row_id"), lambda d, s: O.random_folds(d, seed=s), 3))
    return got.withColumn("jaccard", F.round("jaccard", 6))


@query("SELECT o_orderkey row_id, " + ", ".join(f"o_orderkey % 5 + 1 <> {k} AS run_{k}" for k in range(1, 6)) + " FROM orders")
def logical_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.logical_columns(orders(spark, sf_dir).select("row_id", (F.col("row_id") % 5 + 1).cast("int").alias("fold")), 5)


@query(None)
def folds_spatial_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.spatial_blocks(points(spark, sf_dir), "x", "y"))


@query(None)
def folds_environmental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.environmental_blocks(points(spark, sf_dir), ["w", "e4", "v"]))


@query(None)
def folds_spatial_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few(O.spatial_plus(points(spark, sf_dir), "x", "y", ["w", "e4"]))


@query(f"""WITH RECURSIVE {POINTS}, p AS (SELECT row_id, x, y, row_number() OVER (ORDER BY row_id) i FROM points WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT 0::BIGINT i, []::STRUCT(x DOUBLE, y DOUBLE)[] kept, false stays UNION ALL
 SELECT p.i, CASE WHEN ok THEN list_append(kept, {{'x': p.x, 'y': p.y}}) ELSE kept END, ok
 FROM (SELECT r.kept, p.*, len(list_filter(r.kept, lambda k: sqrt(pow(k.x-p.x,2)+pow(k.y-p.y,2)) < 0.05)) = 0 ok FROM r JOIN p ON p.i = r.i+1) p)
SELECT row_id, x, y FROM p JOIN r USING (i) WHERE stays""")
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.thinned(points(spark, sf_dir).select("row_id", "x", "y"), 0.05)


@query(f"""WITH RECURSIVE {POINTS}, near AS (SELECT a.row_id a, b.row_id b, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) d FROM points a JOIN points b ON a.row_id<>b.row_id), least AS (SELECT a, min(d) d FROM near GROUP BY a),
cut AS (SELECT 2*quantile_cont(d,0.25) AS limit_d FROM least), links AS (SELECT a, b, d FROM near, cut WHERE d < limit_d),
r AS (SELECT []::BIGINT[] gone, 1::BIGINT more UNION ALL SELECT CASE WHEN step IS NULL THEN gone ELSE list_append(gone, step) END, step FROM
 (SELECT gone, (SELECT arg_min(a, {{'d': d, 'a': a}}) FROM links WHERE NOT list_contains(gone, a) AND NOT list_contains(gone, b)) step FROM r WHERE more IS NOT NULL)),
g AS (SELECT gone FROM r WHERE more IS NULL)
SELECT row_id, x, y FROM points, g WHERE NOT list_contains(gone, row_id)""")
def thinned_by_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.thinned_by_closest(points(spark, sf_dir).select("row_id", "x", "y"))


@query(f"""WITH RECURSIVE {POINTS}, g AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) p, count(*) n FROM points WHERE label IS NOT NULL GROUP BY 1),
r AS (SELECT 0::BIGINT p, [0,0,0,0,0]::BIGINT[] l, 0::BIGINT f UNION ALL
 SELECT r.p+1, list_transform(l, lambda x, i: x + CASE WHEN i = list_position(l, list_min(l)) THEN g.n ELSE 0 END), list_position(l, list_min(l))::BIGINT FROM r JOIN g ON g.p = r.p+1),
f AS (SELECT row_id, x, y, r.f::INT fold FROM points JOIN g USING (label) JOIN r ON r.p = g.p),
gone AS (SELECT DISTINCT b.fold, a.row_id FROM f a JOIN f b ON a.fold <> b.fold AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) <= 0.02)
SELECT k.fold, f.row_id, CASE WHEN f.fold = k.fold THEN 'test' ELSE 'train' END AS role FROM f, (SELECT DISTINCT fold FROM f) k WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.fold = k.fold AND gone.row_id = f.row_id)""")
def folds_spatial_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.make_folds(points(spark, sf_dir), "spatial_group", x="x", y="y", group="label", range=0.02).select("fold", "row_id", "role")
