"""Queries of simulations, analysis and further network operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform_sql as u
from ..operators import analysis, generators, network, simulation, urban
from . import tables as t
from .queries_space import _boxes

from .registry import query, r


@query(f"""WITH RECURSIVE {t.EDGES}, {t.POINTS}, n AS (SELECT city id, x, y FROM zones), s AS (SELECT src, dst, a.x x1, a.y y1, b.x x2, b.y y2 FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id),
q AS (SELECT id, x, y, s.*, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) f FROM points, s),
d AS (SELECT id, sqrt((x - x1 - f * (x2 - x1)) * (x - x1 - f * (x2 - x1)) + (y - y1 - f * (y2 - y1)) * (y - y1 - f * (y2 - y1))) d FROM q)
SELECT id, round(min(d), 6) distance FROM d GROUP BY 1 HAVING min(d) <= 0.3""")
def net_nearest_links(spark: SparkSession, d: str) -> DataFrame:
    return network.nearest_links(t.points(spark, d), t.network(spark, d), 0.3).select("id", r("distance", "distance"))


@query()
def net_coarse_grained(spark: SparkSession, d: str) -> DataFrame:
    return network.coarse_grained(t.network(spark, d), generators.grid_polygons(spark, 0, 1, 0, 1, 2, 2), 0.25).links


@query(f"""WITH RECURSIVE {t.EDGES}, {t.POINTS}, n AS (SELECT city id, x, y FROM zones), lonely AS (SELECT id + 1000 id, x, y FROM points UNION ALL SELECT id, x, y FROM n WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)),
s AS (SELECT src, dst, a.x x1, a.y y1, b.x x2, b.y y2 FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id),
q AS (SELECT id, x, y, s.*, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) f FROM lonely, s),
d AS (SELECT id, min(sqrt((x - x1 - f * (x2 - x1)) * (x - x1 - f * (x2 - x1)) + (y - y1 - f * (y2 - y1)) * (y - y1 - f * (y2 - y1)))) d FROM q GROUP BY 1)
SELECT round((SELECT sum(length) FROM edges) + sum(d), 4) length FROM d WHERE d <= 0.5""")
def net_connected_isolated(spark: SparkSession, d: str) -> DataFrame:
    """The length of all links grows by the distances of the isolated nodes, for links that are split keep theirs."""
    net = t.network(spark, d)
    more = t.points(spark, d).select((F.col("id") + 1000).alias("id"), "x", "y")
    return network.connect_isolated(net.with_(nodes=net.nodes.unionByName(more)), 0.5).links.agg(r(F.sum("length"), "length", 4))


@query()
def net_slime_mould(spark: SparkSession, d: str) -> DataFrame:
    return simulation.slime_mould(network.largest_component(t.network(spark, d)), 0, 2, rounds=3)


@query("""SELECT CAST(floor(p_size / 10.0) AS INT) i, CAST(floor(p_retailprice / 500) AS INT) j, round(coalesce(sum(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 END), 0), 2) home,
round(coalesce(sum(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice * 2 END), 0), 2) work FROM part GROUP BY 1, 2""")
def building_space(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.when(F.col("p_partkey") % 2 == 0, "home").otherwise("work").alias("kind"), F.col("p_retailprice").alias("surface"), F.lit(2).alias("storeys"))
    rows = rows.withColumns({"x": F.col("x") / 10.0, "y": F.col("y") / 500})
    return simulation.building_grid(rows, 0.0, 0.0, 1.0).select("i", "j", r("home", "home", 2), r("work", "work", 2))


@query("""WITH e AS (SELECT min(p_size) a0, max(p_size) a1, min(p_retailprice) b0, max(p_retailprice) b1 FROM part)
SELECT p_partkey, round((p_size - a0) / CAST(a1 - a0 AS DOUBLE), 6) size, round((p_retailprice - b0) / (b1 - b0), 6) price FROM part, e""")
def scaled_parts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.scaled(t.table(spark, d, "part"), ["p_size", "p_retailprice"]).select("p_partkey", r("p_size", "size"), r("p_retailprice", "price"))


@query()
def part_components(spark: SparkSession, d: str) -> DataFrame:
    rows = analysis.scaled(t.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return analysis.clusters(analysis.principal_components(rows, ["p_size", "p_retailprice"], 2), ["pc1", "pc2"], 3, seed=1)


@query(f"""WITH {t.POINTS}, {t.ZONES}, j AS (SELECT city area, v FROM points JOIN zones ON points.x > zones.x + 0.0003 AND points.x < zones.x + 0.3003 AND points.y > zones.y + 0.0003 AND points.y < zones.y + 0.3003)
SELECT area, count(*) n, round(stddev_samp(v), 4) sd FROM j GROUP BY 1 HAVING count(*) > 2""")
def area_profiles(spark: SparkSession, d: str) -> DataFrame:
    moved = _boxes(spark, d, 0.3).select("id", F.transform("ring", lambda p: F.struct((p["x"] + 0.0003).alias("x"), (p["y"] + 0.0003).alias("y"))).alias("ring"))
    return analysis.area_profiles(t.points(spark, d), moved, "v", 0.1).select("area", "n", r("sd", "sd", 4))


@query()
def explored_mixtures(spark: SparkSession, d: str) -> DataFrame:
    def model(p: dict, rng: np.random.Generator) -> np.ndarray:
        i, j = np.indices((30, 30))
        centres = rng.random((int(p["centers"]), 2)) * 30
        return sum(np.exp(-np.hypot(i - a, j - b) / p["radius"]) for a, b in centres)

    runs = simulation.parameter_grid(spark, {"centers": [1, 3, 5], "radius": [2.0, 4.0]}, replications=3)
    return simulation.explored(runs, model, seed=1)


@query(f"""WITH {t.POINTS}, a AS (SELECT id, x * 100 x, y * 100 y FROM points), g AS (SELECT a.id, b.x - a.x - 100 * round((b.x - a.x) / 100) gx, b.y - a.y - 100 * round((b.y - a.y) / 100) gy FROM a JOIN a b ON a.id <> b.id),
m AS (SELECT id, avg(gx) mx, avg(gy) my, sum(-gx / greatest(gx * gx + gy * gy, 1e-6)) rx, sum(-gy / greatest(gx * gx + gy * gy, 1e-6)) ry FROM g WHERE gx * gx + gy * gy <= 400 GROUP BY 1),
z AS (SELECT id, CASE WHEN {u(1, "0", "id", "'n'")} < 0.1 THEN 10 * ({u(1, "0", "id", "'x'")} - 0.5) ELSE 0 END zx, CASE WHEN {u(1, "0", "id", "'n'")} < 0.1 THEN 10 * ({u(1, "0", "id", "'y'")} - 0.5) ELSE 0 END zy, {u(1, "0", "id", "'xa'")} - 0.5 ax, {u(1, "0", "id", "'ya'")} - 0.5 ay FROM a),
p AS (SELECT a.id, x, y, coalesce(0.05 * mx + 5 * rx, ax) + zx nx, coalesce(0.05 * my + 5 * ry, ay) + zy ny FROM a JOIN z ON a.id = z.id LEFT JOIN m ON a.id = m.id),
s AS (SELECT *, greatest(sqrt(nx * nx + ny * ny), 1e-9) speed FROM p), c AS (SELECT *, least(1.0, 10 / speed) capped FROM s), k AS (SELECT *, capped * (0.2 * 5 / (speed * capped) + 0.8) pace FROM c)
SELECT id agent, round(x + nx * pace - 100 * floor((x + nx * pace) / 100), 4) x, round(y + ny * pace - 100 * floor((y + ny * pace) / 100), 4) y FROM k""")
def swarm(spark: SparkSession, d: str) -> DataFrame:
    start = t.points(spark, d).selectExpr("id agent", "x * 100 x", "y * 100 y", "0D dx", "0D dy", "20D radius", "5D normal", "10D most", "0.05D c1", "0.1D c2", "5D c3", "0.1D c4", "0.2D c5")
    return simulation.swarm_step(start, 100.0, seed=1, t=0).select("agent", r("x", "x", 4), r("y", "y", 4))


@query()
def multiscale(spark: SparkSession, d: str) -> DataFrame:
    pops = t.pop(spark, d).groupBy("city").agg((F.sum("pop") / 100).alias("pop"))
    growth = urban.gravity(0.05, 0.8, 0.5)(pops, urban.distance_table(t.zones(spark, d)))
    grids = generators.mixture_grid(spark, 10, 10, [(5, 5)], 3.0, samples=25)
    return simulation.multiscale_step(pops, grids, growth, alpha=1.1, beta=0.05, seed=1)[1]
