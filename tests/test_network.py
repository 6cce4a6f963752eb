import pytest
from pyspark.sql import functions as F

from terraloom.operators import generators, network


def links(spark, rows):
    return spark.createDataFrame([(a, b, w, w) for a, b, w in rows], "src long, dst long, weight double, length double")


def test_cross(spark):
    net = generators.cross_network(spark)
    paths = network.shortest_paths(net)
    assert {r.dist for r in paths.collect()} == {0, 1, 2}
    assert network.path_measures(net, paths).first().diameter == 2
    assert {r.id: r.degree for r in network.degrees(net).collect()}[0] == 4
    assert network.summary(net).first().components == 1
    assert network.cycle_count(net).first().cycles == 0
    assert [r.betweenness for r in network.betweenness(net).collect()] == pytest.approx([8 / 20] * 4)


def test_unreachable_counts_as_infinite(spark):
    net = network.from_links(links(spark, [(1, 2, 1.0)]))
    net = net.with_(nodes=spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 5.0, 5.0)], "id long, x double, y double"))
    row = network.path_measures(net, network.shortest_paths(net)).first()
    assert row.diameter == float("inf")
    assert network.components(net).select("component").distinct().count() == 2


def test_chain_is_contracted(spark):
    net = network.from_links(links(spark, [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (4, 5, 1.0), (4, 6, 1.0)]))
    out = {(r.src, r.dst): (r.length, r.weight) for r in network.simplified(net).links.collect()}
    assert out[1, 4] == (6.0, pytest.approx(14 / 6))
    assert len(out) == 3


def test_both_path_methods_agree(spark):
    net = generators.random_network(spark, 12, 30, seed=5)
    a = {(r.src, r.dst): round(r.dist, 9) for r in network.shortest_paths(net, cost="length").collect()}
    b = {(r.src, r.dst): round(r.dist, 9) for r in network.min_plus(net, cost="length").collect()}
    assert a == b


def test_tree_is_planar_and_connected(spark):
    net = generators.tree_network(generators.random_points(spark, 30, seed=2))
    assert net.links.count() == 29
    assert network.components(net).select("component").distinct().count() == 1
    assert network.is_planar(net, 0.2)


def test_planarised_has_no_crossings(spark):
    net = network.planarised(generators.random_network(spark, 10, 15, seed=1), 0.2)
    assert network.crossings(net, 0.2).where("abs(x - round(x, 6)) >= 0").join(net.nodes.select(F.round("x", 6).alias("x6"), F.round("y", 6).alias("y6")), (F.round("x", 6) == F.col("x6")) & (F.round("y", 6) == F.col("y6")), "left_anti").count() == 0


def test_empty_network(spark):
    net = network.empty(spark)
    assert network.components(net).count() == 0
    assert generators.random_network(spark, 0, 0).links.count() == 0


def test_removal_and_percolation(spark):
    net = generators.grid_network(spark, 3, 1.0)
    assert network.remove_random(net, 1.0, 1).links.count() == 0
    closed = net.with_(links=net.links.withColumn("weight", F.lit(0.0)))
    assert network.percolate(closed, 1.0, 1).links.where("weight = 1").count() == net.links.count()
    assert network.reindexed(net, 10).nodes.agg({"id": "min"}).first()[0] == 10
