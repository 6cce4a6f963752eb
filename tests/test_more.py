"""Simulations, analysis, rasters, PBF, multipolygons, and further network operators."""

import json
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.operators import analysis, generators, network, simulation
from terraloom.plans import queries_more  # noqa: F401
from terraloom.plans.registry import QUERIES
from terraloom.sources import osm, pbf, rasters, vector


def test_slime_mould_prefers_the_short_way(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.5, 2.0)], "id long, x double, y double")
    links = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 1.0, 3.0), (1, 2, 1.0, 3.0)], "src long, dst long, weight double, length double")
    got = {(r.src, r.dst): r for r in simulation.slime_mould(network.Network(nodes, links), 0, 1, rounds=25).collect()}
    assert got[0, 1].diameter > 2 * got[0, 2].diameter
    assert got[0, 1].flow + got[0, 2].flow == pytest.approx(1)


def test_slime_mould_of_separate_components(spark):
    nodes = spark.createDataFrame([(k, float(k), 0.0) for k in (0, 1, 2, 3, 4, 5, 9)], "id long, x double, y double")
    links = spark.createDataFrame([(0, 1, 1.0, 1.0), (0, 2, 1.0, 3.0), (1, 2, 1.0, 3.0), (3, 4, 1.0, 0.3), (4, 5, 1.0, 0.7), (3, 5, 1.0, 0.9)], "src long, dst long, weight double, length double")
    run = lambda source, sink, net=network.Network(nodes, links): {(r.src, r.dst): (r.diameter, r.flow) for r in simulation.slime_mould(net, source, sink, rounds=2).collect()}
    still = {(r.src, r.dst): (1.0, 0.0) for r in links.collect()}
    assert run(0, 4) == run(9, 0) == run(0, 7) == still  # no path; a lone node; not in the network
    got = run(0, 1)
    assert got[0, 1][1] + got[0, 2][1] == pytest.approx(1) and got[0, 2][1] == pytest.approx(got[1, 2][1] * -1)
    assert all(got[k] == (pytest.approx(0.81), 0.0) for k in ((3, 4), (4, 5), (3, 5)))


def test_slime_mould_query_where_no_trade_stands_out(spark):
    """On sf0.1 no pair of nations trades a quarter above the mean, so the network has no links; on sf0.001 nation 0 has none."""
    assert QUERIES["net_slime_mould"](spark, "/root/testdata/sf0.1").collect() == []
    assert {(r.diameter, r.flow) for r in QUERIES["net_slime_mould"](spark, "/root/testdata/sf0.001").collect()} == {(1.0, 0.0)}


def test_multiscale_keeps_people(spark):
    pops = spark.createDataFrame([(1, 100.0), (2, 50.0)], "city int, pop double")
    growth = spark.createDataFrame([(1, 0.5)], "city int, growth double")
    grids = generators.random_grid(spark, 9, 9, samples=3, seed=1).where("grid_id > 0").withColumn("v", F.when((F.col("i") == 4) & (F.col("j") == 4), 10.0).otherwise(0.0))
    new, after = simulation.multiscale_step(pops, grids, growth, alpha=1.0, beta=0.1)
    assert {r.city: r["pop"] for r in new.collect()} == {1: 150.0, 2: 50.0}
    assert {r.grid_id: round(r.s, 6) for r in after.groupBy("grid_id").agg(F.sum("v").alias("s")).collect()} == {1: 60.0, 2: 10.0}


def test_buildings_and_slots(spark):
    b = spark.createDataFrame([(0.5, 0.5, "home", 10.0, 2), (0.6, 0.1, "home", 5.0, 1), (1.5, 0.5, "work", 4.0, 1)], "x double, y double, kind string, surface double, storeys int")
    assert {(r.i, r.j): (r.home, r.work) for r in simulation.building_grid(b, 0, 0, 1).collect()} == {(0, 0): (25, 0), (1, 0): (0, 4)}
    grid = generators.blank(spark, 5, 5).withColumn("v", F.lit(0.0))
    assert [(r.i, r.j) for r in simulation.free_slots(grid, 0, 0, 3).collect()] == [(0, 0), (0, 1), (1, 0)]


def test_swarm_stays_on_the_torus(spark):
    rows = generators.random_points(spark, 60, 0, 100, 0, 100, seed=1).selectExpr("id agent", "x", "y", "0D dx", "0D dy", "20D radius", "5D normal", "10D most", "0.05D c1", "0.1D c2", "5D c3", "0.1D c4", "0.2D c5")
    state = rows
    for t in range(2):
        state = simulation.swarm_step(state, 100.0, seed=1, t=t)
    got = state.collect()
    assert len(got) == 60 and all(0 <= r.x < 100 and 0 <= r.y < 100 and np.hypot(r.dx, r.dy) <= 12 for r in got)


def test_swarm_of_crowded_places(spark):
    """60,000 agents at 40 places: joined one by one, they make hundreds of millions of rows."""
    genes = "20D radius, 5D normal, 1e9 most, 0.05D c1, 0.1D c2, 5D c3, 0D c4, 0D c5"
    place = [((p * 37 % 40) * 2.5, (p * 11 % 40) * 2.5) for p in range(40)]
    where = "id agent, cast(id % 40 * 37 % 40 * 2.5 as double) x, cast(id % 40 * 11 % 40 * 2.5 as double) y, cast(id % 40 as double) dx, cast(id div 40 % 3 as double) dy"
    began = time.monotonic()
    got = {r.agent: r for r in simulation.swarm_step(spark.range(60_000).selectExpr(*where.split(", "), *genes.split(", ")), 100.0, seed=1, t=0).collect()}
    assert time.monotonic() - began < 60
    for agent in range(120):
        (x, y), vx, vy = place[agent % 40], agent % 40, agent // 40 % 3
        # a place's agents: 1,500 with dx = p; dy is 0, 1, 2 in turn
        near = [(p, (a - x) - 100 * np.round((a - x) / 100), (b - y) - 100 * np.round((b - y) / 100)) for p, (a, b) in enumerate(place)]
        near = [(p, gx, gy) for p, gx, gy in near if gx * gx + gy * gy <= 400]
        n = 1500 * len(near) - 1
        mean = [1500 * sum(c) / n for c in zip(*[(gx, gy) for _, gx, gy in near])]
        flow = [(1500 * sum(p for p, _, _ in near) - vx) / n, (1500 * len(near) - vy) / n]
        push = [-1500 * sum(c) for c in zip(*[(gx / max(gx * gx + gy * gy, 1e-6), gy / max(gx * gx + gy * gy, 1e-6)) for _, gx, gy in near])]
        want = [own + 0.05 * m + 0.1 * (v - own) + 5 * r for own, m, v, r in zip((vx, vy), mean, flow, push)]
        assert [got[agent].dx, got[agent].dy] == pytest.approx(want, abs=1e-6)


def test_swarm_lone_and_unknown(spark):
    """A lone agent and twins at one place; a neighbour without a speed counts for the place only; agents may start off the torus."""
    rows = [(1, 10.0, 10.0, 1.0), (2, 50.0, 50.0, 2.0), (3, 50.0, 50.0, 4.0), (4, 90.0, 10.0, 3.0), (5, -9.0, 10.0, None)]
    genes = "0D dy, 5D radius, 5D normal, 1e9 most, 0D c1, 1D c2, 0D c3, 0D c4, 0D c5"
    swarm = spark.createDataFrame(rows, "agent long, x double, y double, dx double").selectExpr("*", *genes.split(", "))
    got = {r.agent: r.dx for r in simulation.swarm_step(swarm, 100.0, seed=1, t=0).collect()}
    assert (got[2], got[3]) == (4.0, 2.0)
    assert abs(got[1] - 1.0) <= 0.5 and got[4] is None and got[5] is None


def test_exploration(spark):
    runs = simulation.latin_hypercube(spark, 8, {"density": (0.1, 0.9)}, seed=2)
    assert sorted(int(r.density * 10 - 1) for r in runs.collect()) == list(range(8))
    found = simulation.explored(runs, lambda p, r: (r.random((12, 12)) < p["density"]).astype(float), seed=1)
    again = simulation.explored(runs.repartition(3), lambda p, r: (r.random((12, 12)) < p["density"]).astype(float), seed=1)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(found) == key(again)
    errors = simulation.calibration_error(found, {"density": 0.5}).orderBy("error").collect()
    assert errors[0].error < 0.2
    assert simulation.parameter_grid(spark, {"a": [1, 2], "b": [3, 4, 5]}, replications=2).count() == 12


def test_analysis(spark):
    rows = [(k, 0.1 * (k % 7) + 0.1, float(k), 2.0 * k + 1, float(k // 10 * 100)) for k in range(20)]
    df = spark.createDataFrame(rows, "run long, density double, a double, b double, c double")
    assert analysis.filtered(df, ["a"]).where("density <= 0.05 OR density >= 0.8").isEmpty()
    s = analysis.scaled(df, ["a", "b"])
    assert s.agg(F.min("a"), F.max("b")).first()[:] == (0.0, 1.0)
    pcs = analysis.principal_components(s, ["a", "b"], 2)
    assert pcs.agg(F.stddev("pc2")).first()[0] == pytest.approx(0, abs=1e-9)
    assert analysis.clusters(df, ["c"], 2, seed=1).groupBy("c").agg(F.countDistinct("cluster").alias("k")).where("k > 1").isEmpty()
    target = spark.createDataFrame([(1, 3.2)], "id long, a double")
    assert analysis.nearest_run(df, target, ["a"]).first().run == 3


def test_areas(spark):
    area = spark.sql("SELECT 1L id, array(struct(0D x, 0D y), struct(1D x, 0D y), struct(1D x, 1D y), struct(0D x, 1D y)) ring")
    points = spark.createDataFrame([(k, 0.1 * k + 0.05, 0.5, float(k), k % 2) for k in range(12)], "id long, x double, y double, v double, cluster int")
    row = analysis.area_profiles(points, area, "v", 0.5).first()
    assert row.n == 10 and row.sd == pytest.approx(np.std(range(10), ddof=1))
    assert {r.cluster: r.share for r in analysis.cluster_shares(points, area, 0.5).collect()} == {0: 0.5, 1: 0.5}


def test_isolated_nodes_are_tied(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 1.0, 0.5)], "id long, x double, y double")
    net = network.Network(nodes, spark.createDataFrame([(0, 1, 1.0, 2.0)], "src long, dst long, weight double, length double"))
    out = network.connect_isolated(net, 1.0)
    assert sorted((r.src, r.dst, r.length) for r in out.links.collect()) == [(0, 3, 1.0), (1, 3, 1.0), (2, 3, 0.5)]
    assert network.components(out).select("component").distinct().count() == 1
    assert network.with_stations(net, spark.createDataFrame([(9, 1.9, 0.0)], "id long, x double, y double")).first().node == 1


def test_coarse_graining(spark):
    net = generators.grid_network(spark, 3, 1.0)
    square = lambda k, x: f"SELECT {k}L id, array(struct({x}D x, -0.5D y), struct({x + 2}D x, -0.5D y), struct({x + 2}D x, 3.5D y), struct({x}D x, 3.5D y)) ring"
    polygons = spark.sql(f"{square(1, -0.5)} UNION ALL {square(2, 1.5)}")
    out = network.coarse_grained(net, polygons, 2.0)
    assert out.nodes.count() == 2 and [(r.src, r.dst) for r in out.links.collect()] == [(1, 2)]


def test_geotiff(spark, tmp_path):
    a = np.arange(12, dtype="<f4").reshape(3, 4)
    strips = [zlib.compress(a[k : k + 1].tobytes()) for k in range(3)]
    data, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(data))
        data += s
    entries, extra, base = [], b"", 8 + len(data)

    def add(tag, kind, fmt, values):
        nonlocal extra
        raw = struct.pack(f"<{len(values)}{fmt}", *values)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, kind, len(values), base + len(extra)))
            extra += raw
        else:
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))

    for tag, kind, fmt, values in ((256, 3, "H", [4]), (257, 3, "H", [3]), (258, 3, "H", [32]), (259, 3, "H", [8]), (273, 4, "I", offsets), (277, 3, "H", [1]), (278, 3, "H", [1]), (279, 4, "I", [len(s) for s in strips]), (339, 3, "H", [3]), (33550, 12, "d", [2.0, 2.0, 0.0]), (33922, 12, "d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0])):
        add(tag, kind, fmt, values)
    at = base + len(extra)
    (tmp_path / "r.tif").write_bytes(b"II*\0" + struct.pack("<I", at) + data + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4)
    got = {(r.i, r.j): (r.v, r.x, r.y) for r in rasters.read_geotiff(spark, str(tmp_path / "r.tif")).collect()}
    assert got[2, 3] == (11.0, 17.0, 45.0) and len(got) == 12


def test_geojson(spark, tmp_path):
    lines = [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {"highway": "primary"}}, {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[9, 9], [8, 8]]}, "properties": {}}]
    (tmp_path / "g.json").write_text("\n".join(map(json.dumps, lines)))
    rows = rasters.read_geojson(spark, str(tmp_path / "g.json"), box=(-1, -1, 2, 2)).collect()
    assert len(rows) == 1 and rows[0].attrs["highway"] == "primary" and rows[0].coords[1].x == 1
    with pytest.raises(ValueError):
        vector.read_layer(spark, "x.txt")


def _varint(v):
    out = b""
    while v > 0x7F:
        out, v = out + bytes([v & 0x7F | 0x80]), v >> 7
    return out + bytes([v])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _zig(values):
    out, last = b"", 0
    for v in values:
        d, last = v - last, v
        out += _varint((d << 1) ^ (d >> 63))
    return out


def test_pbf(spark, tmp_path):
    strings = b"".join(_field(1, s) for s in (b"", b"building", b"yes", b"name", b"x"))
    dense = _field(1, _zig([7, 9, 8])) + _field(8, _zig([10_000_000, 20_000_000, -5_000_000])) + _field(9, _zig([0, 1, 2])) + _field(10, bytes([3, 4, 0, 0, 0]))
    way = _field(1, 5) + _field(2, bytes([1])) + _field(3, bytes([2])) + _field(8, _zig([7, 9, 8, 7]))
    block = _field(1, strings) + _field(2, _field(2, dense)) + _field(2, _field(3, way))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    head = _field(1, b"OSMData") + _field(3, len(blob))
    (tmp_path / "m.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    nodes = {r.id: r for r in pbf.read_nodes(spark, str(tmp_path / "m.pbf")).collect()}
    assert nodes[9].lat == pytest.approx(2.0) and nodes[8].lat == pytest.approx(-0.5) and nodes[7].tags == {"name": "x"} and nodes[8].tags == {}
    w = pbf.read_ways(spark, str(tmp_path / "m.pbf")).first()
    assert (w.id, w.tags, w.node_refs) == (5, {"building": "yes"}, [7, 9, 8, 7])


def test_multipolygons_and_removal(spark):
    ways = spark.sql("SELECT * FROM VALUES (1L, map('a', 'b'), array(1L, 2L, 3L)), (2L, map(), array(1L, 4L, 3L)), (3L, map(), array(7L, 8L, 9L, 7L)) AS t(id, tags, node_refs)")
    relation = spark.sql("SELECT 5L id, map('type', 'multipolygon') tags, array(struct('way' type, 1L ref, 'outer' role), struct('way' type, 2L ref, 'outer' role), struct('way' type, 3L ref, 'inner' role)) members")
    got = {r.role: r.refs for r in osm.multipolygons(relation, ways).collect()}
    assert got == {"outer": [1, 2, 3, 4, 1], "inner": [7, 8, 9, 7]}
    nodes = spark.createDataFrame([(k, 0.0, float(k)) for k in range(1, 10)], "id long, lat double, lon double")
    left, kept = osm.without(nodes, ways, spark.createDataFrame([(1,), (2,)], "id long"))
    assert left.count() == 7 and {r.id for r in kept.collect()} == {2, 3}
    assert osm.in_box(nodes, 2, -1, 4, 1).count() == 3
    assert osm.tag_matches(ways, "a", "b|c").count() == 1
