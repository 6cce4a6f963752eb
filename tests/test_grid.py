import numpy as np
import pytest

from terraloom.operators import generators, grid


def frame(spark, a, grid_id=0):
    a = np.asarray(a, float)
    return spark.createDataFrame([(grid_id, i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "grid_id int, i int, j int, v double")


def morphology(spark, a):
    return grid.morphology(frame(spark, a)).first().asDict()


def test_full_grid(spark):
    m = morphology(spark, np.ones((3, 3)))
    assert (m["density"], m["components"], m["dilation_steps"], m["erosion_steps"]) == (1, 1, 1, 0)


def test_single_cell(spark):
    a = np.zeros((3, 3))
    a[1, 1] = 1
    m = morphology(spark, a)
    assert (m["dilation_steps"], m["erosion_steps"], m["components"]) == (2, 1, 1)
    assert m["density"] == pytest.approx(1 / 9)


def test_two_far_cells(spark):
    a = np.zeros((3, 3))
    a[0, 0] = a[2, 2] = 1
    assert morphology(spark, a)["components"] == 2


def test_empty_grid(spark):
    m = morphology(spark, np.zeros((4, 5)))
    assert (m["components"], m["dilation_steps"], m["distance"], m["component_area"]) == (0, 0, 0, 20)


def test_fft_equals_pairs():
    a = np.random.default_rng(1).random((10, 10))
    i, j = np.indices(a.shape)
    d = np.hypot(i.ravel()[:, None] - i.ravel(), j.ravel()[:, None] - j.ravel())
    w = np.where(d == 0, 0, 1 / np.where(d == 0, 1, d))
    z = (a - a.mean()).ravel()
    assert grid._moran(a) == pytest.approx(a.size * (z @ w @ z) / (w.sum() * (z @ z)), abs=1e-10)
    v = a.ravel()
    assert grid._distance(a) == pytest.approx((v @ d @ v) / v.sum() ** 2 * np.sqrt(np.pi / a.size), abs=1e-10)


def test_step_counts_against_loops():
    r = np.random.default_rng(2)
    dilate = lambda x: grid._shift_all(x, np.logical_or.reduce)
    erode = lambda x: grid._shift_all(x, np.logical_and.reduce)
    for _ in range(50):
        on = r.random((r.integers(3, 9), r.integers(3, 9))) < r.random()
        got = grid.steps(on)
        for name, step, done in (("dilation_steps", dilate, np.all), ("erosion_steps", erode, lambda x: not x.any())):
            if not on.any() or on.all():
                continue
            x, n = on, 0
            while not done(x):
                x, n = step(x), n + 1
            assert got[name] == max(1, n)


def test_uniform_values(spark):
    from terraloom.operators import stats

    same = spark.createDataFrame([(2.0,)] * 8, "v double")
    assert stats.entropy(same, "v").first()[0] == pytest.approx(1)
    assert stats.gini(same, "v").first()[0] == pytest.approx(0)


def test_rank_size_is_exact(spark):
    from terraloom.operators import stats

    row = stats.rank_size(generators.rank_size_values(spark, 50, 1.0, 10.0), "v").first()
    assert row.slope == pytest.approx(-1) and row.r2 == pytest.approx(1)


def test_generators(spark):
    with pytest.raises(ValueError):
        generators.random_grid(spark, 0, 5)
    total = generators.random_grid(spark, 8, 8, total=1.0, seed=4).agg({"v": "sum"}).first()[0]
    assert total == pytest.approx(1, abs=1e-10)
    blocks = generators.blocks_grid(spark, 50, 50, 5, 5, 10, seed=1)
    assert grid.components(blocks).first().components <= 5
    once = generators.random_grid(spark, 10, 10, seed=3).orderBy("i", "j").collect()
    assert once == generators.random_grid(spark, 10, 10, seed=3).repartition(7).orderBy("i", "j").collect()
    assert grid.components(generators.launched(spark, "mixture", 20, seed=1)).count() == 1


def test_mass_is_kept_inside(spark):
    a = np.zeros((9, 9))
    a[4, 4] = 8
    out = grid.diffuse(frame(spark, a), 0.5)
    assert out.agg({"v": "sum"}).first()[0] == pytest.approx(8)


def test_rotation_and_distance(spark):
    df = spark.createDataFrame([(1, 2.0, 10.0)], "grid_id int, a double, b double")
    out = grid.rotated(df, ["a", "b"], [0, 0], [4, 20], [[1, 0], [1, 1]]).first()
    assert (out.pc1, out.pc2) == (1.0, 0.5)
    other = spark.createDataFrame([(1, 1.0, 12.0)], "grid_id int, a double, b double")
    assert grid.morphology_distance(df, other, ["a", "b"]).first().distance == 3
