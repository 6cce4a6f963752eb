import pytest
from pyspark.sql import functions as F

from terraloom.operators import generators, interaction, matrix, points, spatial, urban


def test_doubly_constrained_margins(spark):
    o = spark.createDataFrame([(0, 10.0), (1, 30.0)], "o int, mass double")
    d = spark.createDataFrame([(0, 25.0), (1, 15.0)], "d int, mass double")
    pairs = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.2), (1, 1, 1.0)], "o int, d int, w double")
    flows = interaction.doubly_constrained(pairs, o, d, tolerance=1e-10)
    assert {r.o: round(r.s, 6) for r in flows.groupBy("o").agg(F.sum("flow").alias("s")).collect()} == {0: 10, 1: 30}
    assert {r.d: round(r.s, 6) for r in flows.groupBy("d").agg(F.sum("flow").alias("s")).collect()} == {0: 25, 1: 15}


def test_decay_is_recovered(spark):
    zones = generators.random_points(spark, 8, seed=1).select(F.col("id").alias("city"), "x", "y")
    pairs = urban.distance_table(zones).toDF("o", "d", "dist")
    o = zones.select(F.col("city").alias("o"), F.lit(5.0).alias("mass"))
    d = zones.select(F.col("city").alias("d"), F.lit(5.0).alias("mass"))
    seen = interaction.singly_constrained(pairs.withColumn("w", F.exp(-F.col("dist") / 0.3)), o, d).withColumnRenamed("flow", "observed").drop("w")
    assert interaction.fit_decay(seen, o, d, start=1.0, threshold=1e-4)["all"] == pytest.approx(0.3, rel=0.05)


def test_matrices(spark):
    m = matrix.constant(spark, 2, 2, 0.0).withColumn("v", F.expr("CAST(i * 2 + j + 1 AS DOUBLE)"))
    assert matrix.determinant(m, 2) == pytest.approx(-2)
    assert matrix.solve(m, [5, 11]) == pytest.approx([1, 2])
    assert matrix.solve(matrix.constant(spark, 2, 2), [1, 2]) is None
    one = {(r.i, r.j): round(r.v, 9) for r in matrix.multiply(m, matrix.inverse(m, 2)).collect()}
    assert one == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): 1}
    assert matrix.random(spark, 30, 30, 0.5, 1).count() == pytest.approx(450, abs=80)
    with pytest.raises(ValueError):
        matrix.to_array(m, 5000, 2)


def test_samples(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(10)], "k long, w double")
    drawn = generators.sample_with_replacement(df, 3000, "k", "w", seed=1)
    assert drawn.count() == 3000
    counts = {r.key: r["count"] for r in drawn.groupBy("key").count().collect()}
    assert 0 not in counts and counts[9] == pytest.approx(600, abs=90)
    assert generators.sample_without_replacement(df, 4, ["k"], seed=1).distinct().count() == 4


def test_moments_of_draws(spark):
    mu, sigma = generators.log_normal_parameters(2.0, 0.5)
    row = spark.range(20000).select(generators.log_normal(mu, sigma, 3, "id").alias("v"), generators.poisson_count(F.lit(1.5), F.rand(1)).alias("n")).agg(F.avg("v"), F.stddev_pop("v"), F.avg("n")).first()
    assert row[0] == pytest.approx(2, abs=0.02) and row[1] == pytest.approx(0.5, abs=0.02) and row[2] == pytest.approx(1.5, abs=0.05)


def test_hull(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (1.0, 0.5)], "x double, y double")
    row = points.hull(df).first()
    assert (row.area, row.cx, row.cy, len(row.ring)) == (2.0, 1.0, 0.5, 4)
    collinear = points.hull(df.where("y = 0")).first()
    assert collinear.area == 0


def test_points_in_triangle(spark):
    polygon = spark.sql("SELECT 1L id, array(struct(0D x, 0D y), struct(1D x, 0D y), struct(0D x, 1D y), struct(0D x, 0D y)) ring")
    inside = generators.triangle_points(polygon, 200, seed=3)
    assert inside.where("x + y > 1.0000001").count() == 0 and inside.count() == 200
    assert spatial.points_in_polygons(inside.select("id", "x", "y"), polygon, 0.3).count() == 200


def test_clip_by_hand():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert sorted(spatial._clipped(square, (1.0, 1.0, 3.0, 3.0))) == [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    assert spatial._clipped(square, (3.0, 3.0, 4.0, 4.0)) == []


def test_jobs_and_plans(spark):
    people = spark.createDataFrame([(k, 0, 0.0, 0.0) for k in range(500)], "individual_id long, o int, x double, y double")
    flows = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0)], "o int, d int, flow double")
    got = {r.d: r["count"] for r in spatial.assigned_jobs(people, flows, seed=1).groupBy("d").count().collect()}
    assert sum(got.values()) == 500 and got[1] == pytest.approx(375, abs=50)
    assert spatial.commute_plans(people).select("plan.actions").first()[0][1].type == "work"


def test_osm_changes(spark):
    base = spark.createDataFrame([(1, 1, 0.0), (2, 1, 0.0)], "id long, version int, lat double")
    changes = spark.createDataFrame([(1, 2, 5.0, "modify"), (2, 2, 0.0, "delete"), (3, 1, 1.0, "create")], "id long, version int, lat double, change string")
    assert {r.id: r.lat for r in spatial.changed(base, changes).collect()} == {1: 5.0, 3: 1.0}
