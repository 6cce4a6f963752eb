"""Pipelines, spread grids, and what operators refuse."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import applications, generators, grid, interaction, network, runtime, simulation, spatial, urban


def test_spread_measures_equal_the_dense_ones(spark):
    made = generators.random_grid(spark, 7, 150, samples=2, seed=3).withColumn("v", F.when(F.col("v") > 0.4, F.col("v")).otherwise(0.0))
    for spread, dense, name in ((grid.moran_of_large, grid.moran, "moran"), (grid.mean_distance_of_large, grid.mean_distance, "distance")):
        want = {r.grid_id: r[name] for r in dense(made).collect()}
        got = {r.grid_id: r[name] for r in spread(made).collect()}
        assert set(got) == {0, 1} and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)
    want = {r.grid_id: (r.components, r.block_area) for r in grid.components(made).collect()}
    assert {r.grid_id: (r.components, pytest.approx(r.block_area)) for r in grid.components_of_large(made).collect()} == want


def test_samples_follow_their_weights(spark):
    df = spark.createDataFrame([(k, float(w)) for k, w in enumerate([0, 1, 0, 7, 2])], "k long, w double")
    drawn = {r.key: r.n for r in generators.sample_with_replacement(df, 5000, "k", "w", seed=1).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert set(drawn) == {1, 3, 4} and sum(drawn.values()) == 5000
    assert [round(drawn[k] / 5000, 1) for k in (1, 3, 4)] == [0.1, 0.7, 0.2]


def test_refusals(spark):
    cities = spark.range(30).select(F.col("id").alias("city"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    with pytest.raises(ValueError):
        urban.distance_table(cities, limit=20)
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0)], "id long, x double, y double")
    bad = network.Network(nodes, spark.createDataFrame([(0, 1, -1.0, 1.0)], "src long, dst long, weight double, length double"))
    with pytest.raises(Exception, match="at least 0"):
        network.shortest_paths(bad).collect()
    with pytest.raises(ValueError):
        simulation.read_recipe("3 * (1, 2)")
    pairs = spark.createDataFrame([(0, 0, 0.1), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.2)], "o long, d long, w double")
    mass = lambda c, a: spark.createDataFrame([(0, a), (1, 2.0)], f"{c} long, mass double")
    with pytest.warns(UserWarning, match="margins"):
        interaction.doubly_constrained(pairs, mass("o", 3.0), mass("d", 3.0), rounds=1, tolerance=1e-12)


def test_a_zone_without_reach_gets_nothing(spark):
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 0.0)], "o long, d long, w double")
    mass = lambda c: spark.createDataFrame([(0, 1.0), (1, 1.0)], f"{c} long, mass double")
    with pytest.warns(UserWarning):
        flows = {(r.o, r.d): r.flow for r in interaction.doubly_constrained(pairs, mass("o"), mass("d"), rounds=3).collect()}
    assert flows[1, 0] == flows[1, 1] == 0 and np.isfinite(list(flows.values())).all()


def test_windows_and_their_morphology(spark):
    square = lambda x, y, s: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))])
    layer = spark.range(1).select("id", square(0, 0, 10).alias("ring"))
    houses = spark.range(1).select("id", square(-100, -100, 300).alias("ring"))
    rows = applications.sampled_morphology(layer, houses, 3, 4.0, 5, seed=2).collect()
    assert len(rows) == 3 and all(r.density == 1 and r.components == 1 for r in rows)
    centres = spatial.sampled_windows(layer, 50, 4.0, seed=2)
    assert centres.where("x < 0 OR x > 10 OR y < 0 OR y > 10").count() == 0


def test_classes_are_calibrated_apart(spark):
    zones = spark.createDataFrame([(k, float(k), 0.0) for k in range(5)], "city long, x double, y double")
    far = urban.distance_table(zones).toDF("o", "d", "dist")
    kinds = spark.createDataFrame([("a", 0.8), ("b", 2.0)], "kind string, decay double")
    pairs = far.crossJoin(kinds).withColumn("observed", F.exp(-F.col("dist") / F.col("decay"))).drop("decay")
    mass = lambda c: pairs.groupBy("kind", c).agg(F.sum("observed").alias("mass"))
    got = {r.kind: r.decay for r in applications.calibrated_classes(pairs, mass("o"), mass("d"), "kind", start=1.0, rounds=30).collect()}
    assert got["a"] < got["b"]


def test_generator_errors(spark):
    runs = simulation.parameter_grid(spark, {"share": [0.2, 0.8]}, replications=2)
    model = lambda p, r: (r.random((12, 12)) < p["share"]).astype(float)
    errors = {r.share: r.error for r in applications.generator_errors(runs, model, {"density": 0.8}, ["share"]).collect()}
    assert errors[0.8] < errors[0.2]


def test_timed_and_put(spark, caplog):
    with caplog.at_level(logging.INFO, "terraloom"), runtime.timed("a step"):
        path = f"{runtime.fresh_path(spark, 'put')}/x.txt"
        runtime.put(spark, path, b"one\ntwo\n")
    assert "a step took" in caplog.text and spark.read.text(path).count() == 2
    runtime.remove(spark, path)
