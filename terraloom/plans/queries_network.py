"""Queries of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.columns import uniform_sql as u
from ..operators import generators, network
from . import tables as t
from .registry import query, r

_NODES = "n AS (SELECT city id, x, y FROM zones)"
_COMP = """und2 AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
walk(id, root) AS (SELECT id, id FROM n UNION SELECT u.dst, w.root FROM walk w JOIN und2 u ON w.id = u.src),
comp AS (SELECT id, min(root) component FROM walk GROUP BY 1)"""
#: Distances by five min-plus squarings: paths of up to 32 links, over the 25 nations.
_DIST = """d0 AS (SELECT src i, dst j, length d FROM edges UNION ALL SELECT dst, src, length FROM edges UNION ALL SELECT id, id, CAST(0 AS DOUBLE) FROM n),
""" + ",\n".join(f"d{k} AS (SELECT a.i, b.j, min(a.d + b.d) d FROM d{k - 1} a JOIN d{k - 1} b ON a.j = b.i GROUP BY 1, 2)" for k in range(1, 6))
_ALL = f"WITH RECURSIVE {t.EDGES}, {_NODES}"
#: The minimum spanning tree: a pair is in it if no way around has only shorter pairs (five min-max squarings).
_TREE = "m0 AS (SELECT i, j, d FROM far),\n" + ",\n".join(f"m{k} AS MATERIALIZED (SELECT a.i, b.j, min(greatest(a.d, b.d)) d FROM m{k - 1} a JOIN m{k - 1} b ON a.j = b.i GROUP BY 1, 2)" for k in range(1, 6)) + """,
tree AS (SELECT far.i src, far.j dst, far.d length FROM far JOIN m5 ON far.i = m5.i AND far.j = m5.j WHERE far.i < far.j AND far.d <= m5.d + 1e-12)"""
#: Nations a little off their places, so that no two distances are equal.
_MOVED = f"moved AS (SELECT city, x + {u(21, 'city')} / 20 x, y + {u(22, 'city')} / 20 y FROM zones), far AS (SELECT a.city i, b.city j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d FROM moved a CROSS JOIN moved b)"
_JOLTED = f"jolted AS (SELECT src, dst, length * (1 + {u(23, 'src', 'dst')} / 10) length FROM edges)"


def _moved(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c, seed: (F.col(c) + uniform(seed, "city") / 20).alias(c)
    return t.zones(spark, d).select(F.col("city").alias("id"), at("x", 21), at("y", 22))


@query(f"{_ALL} SELECT src, dst, round(length, 6) length FROM edges")
def net_edges(spark: SparkSession, d: str) -> DataFrame:
    return t.network(spark, d).links.select("src", "dst", r("length", "length"))


@query(f"{_ALL}, e AS (SELECT src id FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT id, count(*) degree FROM e GROUP BY 1) SELECT degree, count(*) n FROM g GROUP BY 1")
def net_degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return network.degree_distribution(t.network(spark, d))


@query(f"{_ALL}, {_COMP} SELECT id, component FROM comp")
def net_components(spark: SparkSession, d: str) -> DataFrame:
    return network.components(t.network(spark, d))


@query(f"{_ALL}, {_COMP}, b AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT id FROM comp WHERE component IN (SELECT component FROM b)")
def net_largest_component(spark: SparkSession, d: str) -> DataFrame:
    return network.largest_component(t.network(spark, d)).nodes.select("id")


@query(f"{_ALL}, {_COMP} SELECT (SELECT count(*) FROM n) nodes, (SELECT count(*) FROM edges) links, round((SELECT count(*) FROM edges) / (25.0 * 24), 6) gamma, round((SELECT sum(length) FROM edges), 5) total_length, (SELECT count(DISTINCT component) FROM comp) components")
def net_summary(spark: SparkSession, d: str) -> DataFrame:
    return network.summary(t.network(spark, d)).select("nodes", "links", r("gamma", "gamma"), r("total_length", "total_length", 5), "components")


@query(f"{_ALL}, {_COMP} SELECT (SELECT count(*) FROM edges) - 25 + count(DISTINCT component) cycles FROM comp")
def net_cycles(spark: SparkSession, d: str) -> DataFrame:
    return network.cycle_count(t.network(spark, d))


@query(f"{_ALL}, {_DIST} SELECT i src, j dst, round(d, 6) dist FROM d5")
def net_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    return network.shortest_paths(t.network(spark, d), cost="length").select("src", "dst", r("dist", "dist"))


@query(f"{_ALL}, {_DIST} SELECT i src, j dst, round(d, 6) dist FROM d5")
def net_min_plus(spark: SparkSession, d: str) -> DataFrame:
    return network.min_plus(t.network(spark, d), cost="length").select("src", "dst", r("dist", "dist"))


@query(f"""{_ALL}, {_DIST}, m AS (SELECT d5.d, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) s FROM d5 JOIN n a ON i = a.id JOIN n b ON j = b.id)
SELECT round(avg(CASE WHEN d > 0 THEN 1 / d END), 6) closeness, round(max(d), 6) diameter, round(avg(d), 6) path_length, round(avg(CASE WHEN d > 0 THEN s / d END), 6) efficiency FROM m""")
def net_path_measures(spark: SparkSession, d: str) -> DataFrame:
    net = t.network(spark, d)
    return network.path_measures(net, network.shortest_paths(net, cost="length"), finite_only=True).select(*[r(c, c) for c in ("closeness", "diameter", "path_length", "efficiency")])


@query(f"{_ALL}, {_DIST} SELECT round(sum(abs(d5.d - pairs.d)), 4) difference FROM d5 JOIN pairs ON d5.i = pairs.i AND d5.j = pairs.j")
def net_path_difference(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.urban import distance_table

    straight = distance_table(t.zones(spark, d)).toDF("src", "dst", "dist")
    return network.path_difference(network.shortest_paths(t.network(spark, d), cost="length"), straight).select(r("difference", "difference", 4))


@query(f"{_ALL}, k AS (SELECT n_nationkey id FROM nation WHERE n_regionkey IN (0, 2)) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def net_subgraph(spark: SparkSession, d: str) -> DataFrame:
    keys = t.table(spark, d, "nation").where("n_regionkey IN (0, 2)").select(F.col("n_nationkey").alias("id"))
    return network.subgraph(t.network(spark, d), keys).links.select("src", "dst")


@query(f"{_ALL}, k AS (SELECT n_nationkey id FROM nation WHERE n_regionkey = 0) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM k) OR dst IN (SELECT id FROM k)")
def net_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    keys = t.table(spark, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("id"))
    return network.subgraph(t.network(spark, d), keys, neighbours=True).links.select("src", "dst")


@query(f"{_ALL}, k AS (SELECT n_nationkey id FROM nation WHERE n_regionkey = 1) SELECT src, dst FROM edges WHERE src NOT IN (SELECT id FROM k) AND dst NOT IN (SELECT id FROM k)")
def net_without_nodes(spark: SparkSession, d: str) -> DataFrame:
    keys = t.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"))
    return network.remove_nodes(t.network(spark, d), keys).links.select("src", "dst")


@query(f"{_ALL}, k AS (SELECT src, dst FROM edges WHERE length <= 0.3) SELECT DISTINCT id FROM (SELECT src id FROM k UNION ALL SELECT dst FROM k)")
def net_without_long_links(spark: SparkSession, d: str) -> DataFrame:
    net = t.network(spark, d)
    return network.remove_links(net, net.links.where("length > 0.3"), keep_nodes=False).nodes.select("id")


@query(f"{_ALL} SELECT src, dst FROM edges UNION SELECT src, dst FROM und WHERE mass < 0.5 * (SELECT avg(mass) FROM und)")
def net_union(spark: SparkSession, d: str) -> DataFrame:
    net = t.network(spark, d)
    flows = t.od(spark, d).where("o <> d").groupBy(F.least("o", "d").alias("src"), F.greatest("o", "d").alias("dst")).agg(F.sum("mass").alias("mass"))
    weak = flows.crossJoin(F.broadcast(flows.agg(F.avg("mass").alias("m")))).where("mass < 0.5 * m").select("src", "dst")
    return network.union(net.with_(links=net.links.select("src", "dst")), network.Network(net.nodes, weak)).links


_CROSSED = f"""{_ALL}, s AS (SELECT src, dst, a.x ax, a.y ay, b.x bx, b.y by_ FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id),
p AS (SELECT p.src src1, p.dst dst1, q.src src2, q.dst dst2, p.ax, p.ay, p.bx, p.by_, (p.bx - p.ax) * (q.by_ - q.ay) - (p.by_ - p.ay) * (q.bx - q.ax) den,
 (q.ax - p.ax) * (q.by_ - q.ay) - (q.ay - p.ay) * (q.bx - q.ax) tn, (q.ax - p.ax) * (p.by_ - p.ay) - (q.ay - p.ay) * (p.bx - p.ax) un
 FROM s p JOIN s q ON p.src < q.src OR (p.src = q.src AND p.dst < q.dst)
 WHERE p.src <> q.src AND p.src <> q.dst AND p.dst <> q.src AND p.dst <> q.dst)"""


@query(f"""{_CROSSED}
SELECT src1, dst1, src2, dst2, round(ax + tn / den * (bx - ax), 6) x, round(ay + tn / den * (by_ - ay), 6) y FROM p WHERE abs(den) > 1e-12 AND tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1""")
def net_crossings(spark: SparkSession, d: str) -> DataFrame:
    return network.crossings(t.network(spark, d), 0.2).select("src1", "dst1", "src2", "dst2", r("x", "x"), r("y", "y"))


@query(f"{_CROSSED.replace(_NODES, _MOVED + ', n AS (SELECT city id, x, y FROM moved)')}, x AS (SELECT count(*) n FROM p WHERE abs(den) > 1e-12 AND tn / den BETWEEN 0 AND 1 AND un / den BETWEEN 0 AND 1) SELECT count(*) + 2 * (SELECT n FROM x) links, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 4) length FROM s")
def net_planarised(spark: SparkSession, d: str) -> DataFrame:
    """Links after splitting: one more for each link of each crossing, and the same length in all."""
    moved = _moved(spark, d)
    links = t.network(spark, d).links.select("src", "dst")
    return network.planarised(network.Network(moved, generators.measured(moved, links)), 0.2).links.agg(F.count("*").alias("links"), r(F.sum("length"), "length", 4))


@query(f"""{_ALL}, {_JOLTED}, {_DIST.replace('edges', 'jolted')}, e AS (SELECT src, dst, src a, dst b, length FROM jolted UNION ALL SELECT src, dst, dst, src, length FROM jolted),
used AS (SELECT src, dst, count(*) n FROM e JOIN d5 x ON x.j = a JOIN d5 y ON y.i = b JOIN d5 z ON z.i = x.i AND z.j = y.j WHERE z.i <> z.j AND x.d + length + y.d <= z.d + 1e-9 GROUP BY 1, 2)
SELECT edges.src, edges.dst, round(coalesce(n, 0) / (SELECT count(*) FROM d5 WHERE i <> j), 6) betweenness FROM edges LEFT JOIN used ON edges.src = used.src AND edges.dst = used.dst""")
def net_betweenness(spark: SparkSession, d: str) -> DataFrame:
    net = t.network(spark, d)
    jolted = net.with_(links=net.links.withColumn("length", F.col("length") * (1 + uniform(23, "src", "dst") / 10)))
    return network.betweenness(jolted, cost="length").select("src", "dst", r("betweenness", "betweenness"))


@query()
def net_equilibrium(spark: SparkSession, d: str) -> DataFrame:
    return network.equilibrium(t.network(spark, d), cost="length", congested=lambda free, flow: free * (1 + flow / 100))


@query(f"{_ALL}, e AS (SELECT src id FROM edges UNION ALL SELECT dst FROM edges), g AS (SELECT id, count(*) degree FROM e GROUP BY 1) SELECT count(*) - (SELECT count(*) FROM g WHERE degree = 2) links, round(sum(length), 4) length FROM edges")
def net_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Contracting a node of degree 2 takes one link away and no length."""
    net = t.network(spark, d)
    return network.simplified(net.with_(links=net.links.drop("mass"))).links.agg(F.count("*").alias("links"), r(F.sum("length"), "length", 4))


@query(f"WITH {t.ZONES}, {_MOVED}, {_TREE} SELECT src, dst, round(length, 6) length FROM tree")
def net_tree(spark: SparkSession, d: str) -> DataFrame:
    return generators.tree_network(_moved(spark, d)).links.select("src", "dst", r("length", "length"))


@query(f"""WITH {t.ZONES}, {_MOVED}, {_TREE}, more AS (SELECT i src, j dst, d length FROM far ANTI JOIN tree ON i = src AND j = dst WHERE i < j AND d <= 0.3),
top AS (SELECT * FROM more ORDER BY -ln(1 - {u(3, "src", "dst")}), src, dst LIMIT 10) SELECT src, dst, round(length, 6) length FROM tree UNION ALL SELECT src, dst, round(length, 6) FROM top""")
def net_local_links(spark: SparkSession, d: str) -> DataFrame:
    return generators.local_links(generators.tree_network(_moved(spark, d)), 10, 0.3, seed=3).links.select("src", "dst", r("length", "length"))


@query("""WITH c AS (SELECT k, k // 5 x, k % 5 y FROM (SELECT unnest(generate_series(0, 24)) k))
SELECT least(a.k, b.k) src, greatest(a.k, b.k) dst, round(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) * 2, 6) length FROM c a JOIN c b ON a.k < b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1""")
def net_lattice(spark: SparkSession, d: str) -> DataFrame:
    return generators.grid_network(spark, 4, 2.0, diagonals=True).links.select("src", "dst", r("length", "length"))


@query(f"""{_ALL}, s AS (SELECT greatest(1, CAST(ceil(length / 0.05) AS INT)) m, a.x ax, a.y ay, b.x bx, b.y by_ FROM edges JOIN n a ON src = a.id JOIN n b ON dst = b.id),
w AS (SELECT *, unnest(generate_series(0, m)) k FROM s)
SELECT DISTINCT CAST(floor((ax + (bx - ax) * k / m) / 0.05) AS INT) i, CAST(floor((ay + (by_ - ay) * k / m) / 0.05) AS INT) j FROM w""")
def net_rasterised(spark: SparkSession, d: str) -> DataFrame:
    return network.rasterised(t.network(spark, d), 0.05, 0.05).select("i", "j")


@query(f"""WITH {t.ZONES}, l AS (SELECT round(x / 0.25) * 0.25 x, round(y / 0.25) * 0.25 y, n_regionkey g, city FROM zones JOIN nation ON city = n_nationkey),
s AS (SELECT x, y, lead(x) OVER (PARTITION BY g ORDER BY city) x2, lead(y) OVER (PARTITION BY g ORDER BY city) y2 FROM l),
o AS (SELECT CASE WHEN x < x2 OR (x = x2 AND y < y2) THEN [x, y, x2, y2] ELSE [x2, y2, x, y] END e FROM s WHERE x2 IS NOT NULL AND NOT (x = x2 AND y = y2))
SELECT DISTINCT round(e[1], 2) ax, round(e[2], 2) ay, round(e[3], 2) bx, round(e[4], 2) by_, round(sqrt((e[1] - e[3]) * (e[1] - e[3]) + (e[2] - e[4]) * (e[2] - e[4])), 6) length FROM o""")
def net_from_lines(spark: SparkSession, d: str) -> DataFrame:
    zones = t.zones(spark, d).join(t.table(spark, d, "nation").select(F.col("n_nationkey").alias("city"), "n_regionkey"), "city")
    lines = zones.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("city", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("coords")).withColumn("weight", F.lit(1.0))
    net = network.from_lines(lines, 0.25)
    at = lambda c, a, b: net.nodes.select(F.col("id").alias(c), F.round("x", 2).alias(a), F.round("y", 2).alias(b))
    return net.links.join(at("src", "ax", "ay"), "src").join(at("dst", "bx", "by_"), "dst").select("ax", "ay", "bx", "by_", r("length", "length"))


_TRADE = "l AS (SELECT DISTINCT o_custkey a, 1000000000000 + o_orderkey b FROM orders)"


@query(f"""WITH RECURSIVE {_TRADE}, ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), walk(id, root) AS (SELECT a, a FROM ways UNION SELECT b, root FROM walk JOIN ways ON id = a),
c AS (SELECT id, min(root) c FROM walk GROUP BY 1) SELECT n size, count(*) components FROM (SELECT c, count(*) n FROM c GROUP BY 1) GROUP BY 1""")
def trade_components(spark: SparkSession, d: str) -> DataFrame:
    """Customers linked to their orders: a network that grows with the tables; components by size."""
    links = t.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000000000).alias("dst"))
    sizes = network.components(network.from_links(links)).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))
