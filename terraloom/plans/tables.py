"""Spatial tables derived from the driver's business tables; the SQL of each is beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.network import Network


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RASTER = """
idx AS (SELECT a.i, b.j FROM (SELECT CAST(unnest(generate_series(1, 50)) AS INT) i) a CROSS JOIN (SELECT CAST(unnest(generate_series(0, 10)) AS INT) j) b),
cnt AS (SELECT CAST(l_quantity AS INT) i, CAST(round(l_discount * 100) AS INT) j, CAST(count(*) AS DOUBLE) v FROM lineitem GROUP BY 1, 2),
raster AS (SELECT idx.i, idx.j, coalesce(cnt.v, CAST(0 AS DOUBLE)) v FROM idx LEFT JOIN cnt ON idx.i = cnt.i AND idx.j = cnt.j)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand by quantity and discount, all 50 x 11 cells."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j")).agg(F.count("*").cast("double").alias("v"))
    cells = spark.range(550).select((F.floor(F.col("id") / 11) + 1).cast("int").alias("i"), (F.col("id") % 11).cast("int").alias("j"))
    return cells.join(counts, ["i", "j"], "left").select(F.lit(0).alias("grid_id"), "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


BINARY = RASTER + """,
lim AS (SELECT avg(v) m FROM raster),
bin AS (SELECT i, j, CASE WHEN v > m THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END v FROM raster, lim)"""


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's cells above its mean."""
    cells = raster(spark, sf_dir)
    mean = cells.agg(F.avg("v").alias("m"))
    return cells.crossJoin(F.broadcast(mean)).select("grid_id", "i", "j", F.when(F.col("v") > F.col("m"), 1.0).otherwise(0.0).alias("v"))


def _hashed(key: str, factor: int) -> Column:
    return (F.col(key).cast("long") * factor % 1000).cast("double") / 1000.0


POINTS = "points AS (SELECT CAST(s_suppkey AS BIGINT) id, CAST(s_suppkey * 7919 % 1000 AS DOUBLE) / 1000 x, CAST(s_suppkey * 104729 % 1000 AS DOUBLE) / 1000 y, s_acctbal v FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points of the unit square."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), _hashed("s_suppkey", 7919).alias("x"), _hashed("s_suppkey", 104729).alias("y"), F.col("s_acctbal").alias("v"))


ZONES = "zones AS (SELECT n_nationkey city, CAST(n_nationkey * 7919 % 1000 AS DOUBLE) / 1000 x, CAST(n_nationkey * 104729 % 1000 AS DOUBLE) / 1000 y FROM nation)"


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city"), _hashed("n_nationkey", 7919).alias("x"), _hashed("n_nationkey", 104729).alias("y"))


OD = """od AS (SELECT c_nationkey o, s_nationkey d, sum(l_extendedprice * (1 - l_discount)) / 1000 mass
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows from customers' nations to suppliers' nations, in thousands."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("o"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("d"))
    return line.join(orders, "l_orderkey").join(customer, "c_custkey").join(supplier, "l_suppkey").groupBy("o", "d").agg((F.sum("value") / 1000).alias("mass"))


PAIRS = ZONES + ", pairs AS (SELECT a.city i, b.city j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d FROM zones a CROSS JOIN zones b)"

EDGES = PAIRS + ", " + OD + """,
und AS (SELECT least(o, d) src, greatest(o, d) dst, sum(mass) mass FROM od WHERE o <> d GROUP BY 1, 2),
edges AS (SELECT src, dst, CAST(1 AS DOUBLE) weight, pairs.d length, mass FROM und JOIN pairs ON src = i AND dst = j WHERE mass > 1.25 * (SELECT avg(mass) FROM und))"""


def network(spark: SparkSession, sf_dir: str) -> Network:
    """Nations linked where trade both ways is a quarter above the mean of the linked pairs."""
    from ..operators.urban import distance_table

    flows = od(spark, sf_dir).where("o <> d").groupBy(F.least("o", "d").alias("src"), F.greatest("o", "d").alias("dst")).agg(F.sum("mass").alias("mass"))
    mean = flows.agg(F.avg("mass").alias("m"))
    far = distance_table(zones(spark, sf_dir)).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("d").alias("length"))
    links = flows.crossJoin(F.broadcast(mean)).where("mass > 1.25 * m").join(far, ["src", "dst"]).select("src", "dst", F.lit(1.0).alias("weight"), "length", "mass")
    from ..operators.runtime import cut

    return Network(zones(spark, sf_dir).withColumnRenamed("city", "id"), cut(links))


POP = "pop AS (SELECT c_nationkey city, CAST(extract(year FROM o_orderdate) AS INT) t, sum(o_totalprice) / 1000 pop FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of nations by year, as populations of cities."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("t"), "o_totalprice")
    return orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("city")), "c_custkey").groupBy("city", "t").agg((F.sum("o_totalprice") / 1000).alias("pop"))
