"""Queries of statistics, windows, scalar functions, matrices and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import matrix, stats
from ..streaming.windows import cell_counts, windowed
from . import tables as t
from .registry import query, r


@query("SELECT c_mktsegment segment, round(avg(c_acctbal), 4) m1, round(avg(power(c_acctbal, 2)), 1) m2, round(stddev_pop(c_acctbal), 4) std FROM customer GROUP BY 1")
def moments_acctbal(spark: SparkSession, d: str) -> DataFrame:
    return stats.moments(t.table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]).select(F.col("c_mktsegment").alias("segment"), r("m1", "m1", 4), r("m2", "m2", 1), r("std", "std", 4))


@query("SELECT round(sum(l_quantity * l_discount) / sum(l_quantity), 6) m1, round(sum(l_quantity * l_discount * l_discount) / sum(l_quantity), 6) m2 FROM lineitem")
def moments_weighted(spark: SparkSession, d: str) -> DataFrame:
    return stats.moments(t.table(spark, d, "lineitem"), "l_discount", weight="l_quantity").select(r("m1", "m1"), r("m2", "m2"))


@query("""WITH p AS (SELECT c_nationkey nation, greatest(c_acctbal, 0) v FROM customer),
s AS (SELECT nation, sum(v) total, count(*) n FROM p GROUP BY 1)
SELECT p.nation, round(-sum(CASE WHEN v > 0 THEN v / total * ln(v / total) ELSE 0 END) / ln(max(n)), 6) entropy FROM p JOIN s ON p.nation = s.nation GROUP BY 1""")
def entropy_nation(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.greatest("c_acctbal", F.lit(0.0)).alias("v"))
    return stats.entropy(rows, "v", ["nation"]).select("nation", r("entropy", "entropy"))


@query("""WITH s AS (SELECT c_nationkey nation, o_custkey, sum(o_totalprice) v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
k AS (SELECT nation, ln(v) y, ln(row_number() OVER (PARTITION BY nation ORDER BY v DESC)) x FROM s WHERE v > 0)
SELECT nation, round(regr_slope(y, x), 5) slope, round(regr_r2(y, x), 5) r2 FROM k GROUP BY 1""")
def rank_size_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "orders").join(t.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return stats.rank_size(rows, "v", ["nation"]).select("nation", r("slope", "slope", 5), r("r2", "r2", 5))


@query("""WITH e AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
c AS (SELECT CAST(floor((o_totalprice - lo) * 19 / (hi - lo)) AS INT) bin, count(*) n FROM orders, e GROUP BY 1),
b AS (SELECT CAST(unnest(generate_series(0, 19)) AS INT) bin)
SELECT b.bin, round(lo + (b.bin + 0.5) * (hi - lo) / 20, 3) centre, coalesce(n, 0) n FROM b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""")
def histogram_price(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(t.table(spark, d, "orders"), "o_totalprice", 20).select("bin", r("centre", "centre", 3), "n")


@query("""WITH k AS (SELECT c_nationkey nation, c_acctbal v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) rn, count(*) OVER (PARTITION BY c_nationkey) n FROM customer),
a AS (SELECT *, least(greatest(0.9 * (n + 1), 1), n) pos FROM k)
SELECT nation, round(max(CASE WHEN rn = floor(pos) THEN v END) + max(pos - floor(pos)) * (max(CASE WHEN rn = ceil(pos) THEN v END) - max(CASE WHEN rn = floor(pos) THEN v END)), 4) q90 FROM a GROUP BY 1""")
def quantile_balance(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile(t.table(spark, d, "customer"), "c_acctbal", 0.9, ["c_nationkey"]).select(F.col("c_nationkey").alias("nation"), r("quantile", "q90", 4))


@query("""WITH k AS (SELECT c_nationkey nation, c_acctbal v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) i, count(*) OVER (PARTITION BY c_nationkey) n FROM customer WHERE c_acctbal > 0)
SELECT nation, round(2 * sum(i * v) / (max(n) * sum(v)) - (max(n) + 1.0) / max(n), 6) gini FROM k GROUP BY 1""")
def gini_balance(spark: SparkSession, d: str) -> DataFrame:
    return stats.gini(t.table(spark, d, "customer").where("c_acctbal > 0"), "c_acctbal", ["c_nationkey"]).select(F.col("c_nationkey").alias("nation"), r("gini", "gini"))


@query("""WITH a AS (SELECT c_acctbal v, 1 x, 0 y FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_acctbal, 0, 1 FROM customer WHERE c_mktsegment = 'MACHINERY'),
c AS (SELECT v, sum(x) x, sum(y) y FROM a GROUP BY 1),
f AS (SELECT abs(sum(x) OVER (ORDER BY v) / sum(x) OVER () - sum(y) OVER (ORDER BY v) / sum(y) OVER ()) d FROM c)
SELECT round(max(d), 6) ks FROM f""")
def ks_segments(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "customer")
    return stats.ks_distance(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"), "c_acctbal").select(r("ks", "ks"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) cumsum FROM events")
def cumsum_events(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return stats.cumulative(rows, "value", ["user_id"], ["ts", "event_id"]).select("event_id", r("cumsum", "cumsum", 4))


@query("""SELECT c_mktsegment segment, count(*) n, round(avg(c_acctbal), 4) mean, round(stddev_samp(c_acctbal), 4) sd, round(abs(avg(c_acctbal) / stddev_samp(c_acctbal)), 6) ratio FROM customer GROUP BY 1 HAVING count(*) >= 10""")
def grouped_summary(spark: SparkSession, d: str) -> DataFrame:
    out = stats.grouped_summary(t.table(spark, d, "customer"), ["c_mktsegment"], ["c_acctbal"], least=10)
    return out.select(F.col("c_mktsegment").alias("segment"), "n", r("c_acctbal_mean", "mean", 4), r("c_acctbal_sd", "sd", 4), r("c_acctbal_ratio", "ratio"))


@query("SELECT p_brand brand, min(p_retailprice) cost, arg_min(p_partkey, (p_retailprice, p_partkey)) best FROM part GROUP BY 1")
def best_part(spark: SparkSession, d: str) -> DataFrame:
    return stats.best_rows(t.table(spark, d, "part"), ["p_brand"], "p_retailprice", ["p_partkey"]).select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("cost"), F.col("p_partkey").alias("best"))


@query(f"""WITH {t.POP}, a AS (SELECT city, t, pop v FROM pop), b AS (SELECT city, t - 1 t, pop v FROM pop)
SELECT round(ln(sum(power(a.v - b.v, 2))), 5) logmse, round(avg(power(ln(a.v) - ln(b.v), 2)), 6) mselog FROM a JOIN b ON a.city = b.city AND a.t = b.t""")
def log_mse_years(spark: SparkSession, d: str) -> DataFrame:
    """Every year against the one after it."""
    rows = t.pop(spark, d)
    return stats.log_mse(rows, rows.withColumn("t", F.col("t") - 1), ["city", "t"], "pop").select(r("logmse", "logmse", 5), r("mselog", "mselog"))


@query("""SELECT l_orderkey, l_linenumber, round(floor(l_extendedprice * 10) / 10, 1) cut, round(power(2 * (l_quantity - l_tax) / (l_quantity + l_tax), 2), 6) rel,
CAST(CAST(floor(l_quantity / 3) AS INT) AS VARCHAR) || ':' || CAST(CAST(floor((l_quantity / 3 - floor(l_quantity / 3)) * 60) AS INT) AS VARCHAR) || ':' ||
CAST(CAST(floor(((l_quantity / 3 - floor(l_quantity / 3)) * 60 - floor((l_quantity / 3 - floor(l_quantity / 3)) * 60)) * 60) AS INT) AS VARCHAR) clock,
round(exp(-l_quantity / 20), 6) cost, round(-20 * ln(exp(-l_quantity / 20)), 6) back FROM lineitem""")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = t.table(spark, d, "lineitem")
    cost = fn.exp_cost(q, 20)
    return rows.select("l_orderkey", "l_linenumber", F.round(fn.digits(F.col("l_extendedprice"), 1), 1).alias("cut"), r(fn.rel_square(q, F.col("l_tax")), "rel"), fn.clock(q / 3).alias("clock"), r(cost, "cost"), r(fn.exp_cost_inverse(cost, 20), "back"))


@query(f"""WITH {t.POINTS} SELECT id, round(radians(x * 10) * 6378137, 3) mx, round(ln(tan(pi() / 4 + radians(40 + y) / 2)) * 6378137, 3) my,
round(degrees((radians(x * 10) * 6378137 - 500) / 6378137), 6) west, round(degrees((radians(x * 10) * 6378137 + 500) / 6378137), 6) east FROM points""")
def projections(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("x") * 10, 40 + F.col("y")
    mx, my = fn.to_mercator(lon, lat)
    west, _, east, _ = fn.window_around(lon, lat, 1000)
    return t.points(spark, d).select("id", r(mx, "mx", 3), r(my, "my", 3), r(west, "west"), r(east, "east"))


_M = "m AS (SELECT o i, d j, mass v FROM od), od2 AS (SELECT o i, d j, mass / 1000 v FROM od WHERE o < d)"


def _matrices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = t.od(spark, d).select(F.col("o").alias("i"), F.col("d").alias("j"), F.col("mass").alias("v"))
    return m, m.where("i < j").withColumn("v", F.col("v") / 1000)


@query(f"WITH {t.OD}, {_M} SELECT a.i, b.j, round(sum(a.v * b.v), 2) v FROM m a JOIN od2 b ON a.j = b.i GROUP BY 1, 2")
def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    return matrix.multiply(*_matrices(spark, d)).select("i", "j", r("v", "v", 2))


@query(f"WITH {t.OD}, {_M} SELECT m.i, m.j, round(m.v * od2.v, 2) v FROM m JOIN od2 ON m.i = od2.i AND m.j = od2.j")
def matrix_hadamard(spark: SparkSession, d: str) -> DataFrame:
    return matrix.hadamard(*_matrices(spark, d)).select("i", "j", r("v", "v", 2))


@query(f"WITH {t.OD}, {_M} SELECT coalesce(m.i, od2.i) i, coalesce(m.j, od2.j) j, round(coalesce(m.v, 0) - coalesce(od2.v, 0), 3) v FROM m FULL JOIN od2 ON m.i = od2.i AND m.j = od2.j")
def matrix_difference(spark: SparkSession, d: str) -> DataFrame:
    return matrix.subtracted(*_matrices(spark, d)).select("i", "j", r("v", "v", 3))


@query(f"WITH {t.OD}, {_M}, x AS (SELECT i, j, v FROM m UNION ALL SELECT j, i, v FROM m) SELECT i, j, round(sum(v), 3) v FROM x GROUP BY 1, 2")
def matrix_symmetric_sum(spark: SparkSession, d: str) -> DataFrame:
    m, _ = _matrices(spark, d)
    return matrix.added(m, matrix.transposed(m)).select("i", "j", r("v", "v", 3))


@query(f"WITH {t.OD}, {_M} SELECT round(sum(v), 2) total, round(min(v), 3) least, round(max(v), 3) most, count(*) entries, round(sum(v) / 625, 4) mean FROM m")
def matrix_totals(spark: SparkSession, d: str) -> DataFrame:
    return matrix.totals(_matrices(spark, d)[0], 25, 25).select(r("total", "total", 2), r("least", "least", 3), r("most", "most", 3), "entries", r("mean", "mean", 4))


@query(f"WITH {t.OD}, {_M} SELECT 'row' side, i k, round(sum(v), 2) v FROM m GROUP BY 1, 2 UNION ALL SELECT 'column', j, round(sum(v), 2) FROM m GROUP BY 1, 2")
def matrix_margins(spark: SparkSession, d: str) -> DataFrame:
    m, _ = _matrices(spark, d)
    return matrix.row_sums(m).select(F.lit("row").alias("side"), F.col("i").alias("k"), r("v", "v", 2)).unionAll(matrix.column_sums(m).select(F.lit("column"), "j", r("v", "v", 2)))


@query(f"WITH {t.OD}, {_M} SELECT i - 5 i, j - 10 j, round(sqrt(v), 5) v FROM m WHERE i BETWEEN 5 AND 12 AND j BETWEEN 10 AND 14")
def matrix_block_power(spark: SparkSession, d: str) -> DataFrame:
    return matrix.power(matrix.block(_matrices(spark, d)[0], 5, 10, 8, 5), 0.5).select("i", "j", r("v", "v", 5))


@query(f"WITH {t.OD}, {_M}, n AS (SELECT n_nationkey k, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) p FROM nation WHERE n_regionkey = 1) SELECT a.p i, b.p j, round(m.v, 3) v FROM m JOIN n a ON m.i = a.k JOIN n b ON m.j = b.k")
def matrix_picked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    keys = t.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("old"), (F.row_number().over(Window.orderBy("n_nationkey")) - 1).alias("new"))
    return matrix.picked(_matrices(spark, d)[0], keys, keys).select("i", "j", r("v", "v", 3))


@query(f"WITH {t.OD}, {_M} SELECT i, j, round(CASE WHEN i = j THEN 0 ELSE v END, 3) v FROM m UNION ALL SELECT i, j + 25, round(v, 3) FROM od2")
def matrix_replaced_bound(spark: SparkSession, d: str) -> DataFrame:
    m, half = _matrices(spark, d)
    diagonal = matrix.mapped(m.where("i = j"), lambda v: v * 0.0)
    return matrix.bound(matrix.replaced(m, diagonal), half, 25).select("i", "j", r("v", "v", 3))


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) n, round(sum(value), 3) total, round(avg(value), 5) m1, round(stddev_pop(value), 5) std FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    out = windowed(t.table(spark, d, "events"), "ts", "value", "1 day", by=("event_type",))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r("total", "total", 3), r("m1", "m1", 5), r("std", "std", 5))


@query("SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(floor(user_id / 100.0) AS INT) i, CAST(floor(value / 50.0) AS INT) j, count(*) v FROM events GROUP BY 1, 2, 3")
def windowed_raster(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select("ts", F.col("user_id") / 100.0, F.col("value") / 50.0).toDF("ts", "x", "y")
    return cell_counts(rows, "ts", "x", "y", "1 day", 1.0).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "i", "j", "v")
