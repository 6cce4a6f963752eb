"""Queries of the pipelines and of further model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform_sql as u
from ..operators import applications, generators, grid, interaction, network, simulation, spatial, stats, urban
from ..operators.runtime import fresh_path, put
from ..sources.tables import write_binary
from . import tables as t
from .queries_models import _FIRST, _POT, _first, _shares
from .queries_space import _boxes
from .registry import query, r

_X = "chr(120)"  # the letter x, without quotes


def _file(spark: SparkSession, lines: list[str], name: str) -> str:
    path = f"{fresh_path(spark, name)}/{name}"
    put(spark, path, "".join(f"{x}\n" for x in lines).encode())
    return path


# -- rasters of polygons -------------------------------------------------------------------------------------------

_CELLS = "c AS (SELECT i, j, i * 0.1 x0, j * 0.1 y0 FROM (SELECT CAST(unnest(generate_series(0, 9)) AS INT) i), (SELECT CAST(unnest(generate_series(0, 9)) AS INT) j))"
_COVER = "greatest(0, least(x + 0.0703, x0 + 0.1) - greatest(x, x0)) * greatest(0, least(y + 0.0703, y0 + 0.1) - greatest(y, y0))"


@query(f"WITH {t.ZONES}, {_CELLS}, s AS (SELECT i, j, sum({_COVER}) / 0.01 s FROM c, zones GROUP BY 1, 2) SELECT i, j, CASE WHEN s > 0.25 THEN 1.0 ELSE 0.0 END v, round(s, 6) share FROM s")
def buildings_raster(spark: SparkSession, d: str) -> DataFrame:
    made = spatial.covered_cells(_boxes(spark, d, 0.0703), 0.0, 0.0, 0.1, 10, 10, least=0.25)
    return made.select("i", "j", "v", r("share", "share"))


@query(f"WITH {t.ZONES} SELECT city id FROM zones WHERE x > 0.1003 AND y > 0.1003 AND x + 0.1 < 0.8003 AND y + 0.1 < 0.8003")
def boxes_inside_mask(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside_mask(_boxes(spark, d, 0.1), 0.1003, 0.1003, 0.8003, 0.8003).select("id")


@query("SELECT 6 * 64 AS \"cells\", 6 grids, 6 * 64 inside")
def sampled_grids(spark: SparkSession, d: str) -> DataFrame:
    """Grids in windows of a layer: how many cells, and how many agree with a raster made window by window."""
    layer, houses = _boxes(spark, d, 0.2), _boxes(spark, d, 0.0703)
    made = spatial.sampled_grids(layer, houses, 6, 0.3, 8, seed=4)
    alone = None
    for w in spatial.sampled_windows(layer, 6, 0.3, seed=4).collect():  # six windows
        own = spatial.covered_cells(houses, w.x - 0.15, w.y - 0.15, 0.3 / 8, 8, 8).select(F.lit(w.id).alias("grid_id"), "i", "j", F.col("v").alias("own"))
        alone = own if alone is None else alone.unionByName(own)
    both = made.join(alone, ["grid_id", "i", "j"])
    return both.agg(F.count("*").alias("cells"), F.countDistinct("grid_id").alias("grids"), F.sum((F.col("v") == F.col("own")).cast("int")).alias("inside"))


@query(f"""WITH {t.RASTER}, a(area, i0, i1, j0, j1) AS (VALUES (1, 1, 21, 0, 6), (2, 10, 40, 3, 11)), c AS (SELECT area, i, j, v FROM raster JOIN a ON i >= i0 AND i < i1 AND j >= j0 AND j < j1),
s AS (SELECT area, sum(v) total, count(*) n FROM c GROUP BY 1), e AS (SELECT c.area, round(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 6) density, round(-sum(CASE WHEN v > 0 THEN v / total * ln(v / total) ELSE 0 END) / ln(max(n)), 6) entropy FROM c JOIN s ON c.area = s.area GROUP BY 1),
d AS (SELECT p.area, round(sqrt(pi() / max(n)) * sum(sqrt(CAST((p.i - q.i) * (p.i - q.i) + (p.j - q.j) * (p.j - q.j) AS DOUBLE)) * p.v * q.v) / (max(total) * max(total)), 6) distance FROM c p JOIN c q ON p.area = q.area JOIN s ON s.area = p.area GROUP BY 1)
SELECT e.area, density, entropy, distance FROM e JOIN d ON e.area = d.area""")
def area_indicators(spark: SparkSession, d: str) -> DataFrame:
    areas = spark.createDataFrame([(1, 1, 21, 0, 6), (2, 10, 40, 3, 11)], "area int, i0 int, i1 int, j0 int, j1 int")
    return applications.area_indicators(t.raster(spark, d), areas).select("area", *[r(c, c) for c in ("density", "entropy", "distance")])


@query(f"WITH {t.RASTER} SELECT i, j, v + CASE WHEN {u(12, 'i', 'j')} < 0.1 THEN 1 ELSE 0 END v FROM raster")
def grid_perturbed(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.columns import uniform

    return applications.perturbed(t.raster(spark, d), F.col("v") + F.when(uniform(12, "i", "j") < 0.1, 1.0).otherwise(0.0)).select("i", "j", "v")


@query(f"WITH {t.RASTER}, m AS (SELECT j id, sum(v) a, max(v) b FROM raster GROUP BY 1) SELECT id, round(0.6 * (a - 10) / 90 + 0.8 * (b - 1) / 9, 6) pc1, round(0.8 * (a - 10) / 90 - 0.6 * (b - 1) / 9, 6) pc2 FROM m")
def indicators_rotated(spark: SparkSession, d: str) -> DataFrame:
    rows = t.raster(spark, d).groupBy(F.col("j").alias("id")).agg(F.sum("v").alias("a"), F.max("v").alias("b"))
    return grid.rotated(rows, ["a", "b"], [10.0, 1.0], [100.0, 10.0], [[0.6, 0.8], [0.8, -0.6]]).select("id", r("pc1", "pc1"), r("pc2", "pc2"))


@query(f"WITH {t.RASTER}, m AS (SELECT j grid_id, sum(v) a, max(v) b FROM raster GROUP BY 1) SELECT grid_id, abs(a - 2 * a) + abs(b - 2 * b) distance FROM m")
def indicators_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = t.raster(spark, d).groupBy(F.col("j").alias("grid_id")).agg(F.sum("v").alias("a"), F.max("v").alias("b"))
    return grid.morphology_distance(rows, rows.select("grid_id", (2 * F.col("a")).alias("a"), (2 * F.col("b")).alias("b")), ["a", "b"])


@query(f"WITH {t.RASTER}, m AS (SELECT j run, sum(v) a, max(v) b FROM raster GROUP BY 1) SELECT run, round(power(2 * (a - 50) / (a + 50), 2) + power(2 * (b - 5) / (b + 5), 2), 6) error FROM m")
def calibration_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = t.raster(spark, d).groupBy(F.col("j").alias("run")).agg(F.sum("v").alias("a"), F.max("v").alias("b"))
    return simulation.calibration_error(rows, {"a": 50.0, "b": 5.0}).select("run", r("error", "error"))


# -- systems of cities ---------------------------------------------------------------------------------------------


@query(f"WITH {t.PAIRS}, {t.POP}, p AS (SELECT CAST(t AS DOUBLE) t, city, pop, 0 k FROM pop) SELECT 'pop' kind, city i, 0 j, round(sum(pop), 3) v FROM p GROUP BY city UNION ALL SELECT 'distance', i, j, round(d, 6) FROM pairs")
def macro_from_files(spark: SparkSession, d: str) -> DataFrame:
    """A system of cities written as matrix files and set up from them."""
    pops = {(x.city, x.t): x.pop for x in t.pop(spark, d).collect()}  # 25 cities, a few years
    years, pairs = sorted({k for _, k in pops}), {(x.i, x.j): x.d for x in urban.distance_table(t.zones(spark, d)).collect()}
    populations = _file(spark, [",".join(repr(pops.get((c, y), 0.0)) for y in years) for c in range(25)], "populations")
    distances = _file(spark, [",".join(repr(pairs[i, j]) for j in range(25)) for i in range(25)], "distances")
    read, far, _ = urban.from_files(spark, populations, distances, _file(spark, [str(y) for y in years], "dates"))
    sums = read.groupBy("city").agg(F.sum("pop").alias("v")).where("v > 0").select(F.lit("pop").alias("kind"), F.col("city").alias("i"), F.lit(0).alias("j"), r("v", "v", 3))
    return sums.unionByName(far.select(F.lit("distance").alias("kind"), "i", "j", r("d", "v")))


@query(f"{_FIRST}, k AS (SELECT unnest(generate_series(0, 2)) k) SELECT CAST(k AS DOUBLE) t, -1 + CASE WHEN k = 0 THEN 0 ELSE m END model, city, round(pop * CASE WHEN k = 0 THEN 1 ELSE power(1.02 * 1.05, k - 1) * CASE WHEN m = 1 THEN 1.02 ELSE 1.02 * 1.05 END END, 3) pop FROM p, k, (SELECT unnest([1, 2]) m) WHERE k > 0 OR m = 1")
def macro_coupled(spark: SparkSession, d: str) -> DataFrame:
    """Two models in turn, each growing the populations that the one before left."""
    pops, distances = _first(spark, d)
    grow = lambda rate: lambda p, x, dt: (urban.macro_step(p, x, [urban.gibrat(rate)], dt), x)
    models: list[applications.MacroModel] = [grow(0.02), grow(0.05)]
    return urban.run_multi(pops, distances, [0.0, 1.0, 2.0], models).select("t", "model", "city", r("pop", "pop", 3))


@query(f"{_FIRST} SELECT p.city, round(pop, 3) pop, round(power(pop, 1.2) * total / (SELECT sum(power(pop, 1.2)) FROM p), 3) wealth FROM p, tot")
def wealth_rescaled(spark: SparkSession, d: str) -> DataFrame:
    pops, _ = _first(spark, d)
    return urban.rescaled_wealth(pops.withColumn("wealth", F.pow("pop", F.lit(1.2)))).select("city", r("pop", "pop", 3), r("wealth", "wealth", 3))


@query(f"""{_FIRST}, s AS (SELECT k innovation, city, CASE WHEN k = 0 THEN 1 - (0.1 + city / 50.0) ELSE 0.1 + city / 50.0 END share FROM (SELECT CAST(unnest(generate_series(0, 1)) AS INT) k), p)
SELECT innovation, city, round(share * CASE WHEN city % 5 = 0 THEN 0.8 ELSE 1 END, 6) share FROM s UNION ALL SELECT 2, city, CASE WHEN city % 5 = 0 THEN 0.2 ELSE 0 END FROM p""")
def innovation_adopters(spark: SparkSession, d: str) -> DataFrame:
    pops, _ = _first(spark, d)
    return urban.early_adopters(_shares(pops), pops.where("city % 5 = 0"), 2, 3.0, 0.2).select("innovation", "city", r("share", "share"))


@query(f"WITH {t.POP} SELECT round(count(DISTINCT t % 3) / CAST(count(DISTINCT city) * count(DISTINCT t) AS DOUBLE), 6) rate FROM pop")
def innovation_rate(spark: SparkSession, d: str) -> DataFrame:
    states = t.pop(spark, d).withColumn("innovation", F.col("t") % 3)
    return urban.innovation_rate(states).select(r("rate", "rate"))


@query(f"{_FIRST}, {_POT} SELECT round(1.5 * avg(u), 9) flow FROM pot")
def gravity_mean_flow(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    flows = urban.potentials(pops, urban.decayed(distances, 0.5), 0.8)
    steps = flows.withColumn("t", F.lit(0)).unionByName(flows.select("i", "j", (2 * F.col("potential")).alias("potential"), F.lit(1).alias("t")))
    return urban.mean_flow(steps).select(r("flow", "flow", 9))


# -- flow models ---------------------------------------------------------------------------------------------------


@query(f"WITH {t.PAIRS} SELECT i, j, round(200 * d, 6) v FROM pairs WHERE exp(-200 * d / 60) > 0.3")
def distances_thresholded(spark: SparkSession, d: str) -> DataFrame:
    pairs = {(x.i, x.j): 200 * x.d for x in urban.distance_table(t.zones(spark, d)).collect()}  # 625 pairs
    path, to = _file(spark, [",".join(repr(pairs[i, j]) for j in range(25)) for i in range(25)], "distances"), fresh_path(spark, "sparse")
    applications.thresholded(spark, path, to)
    return spark.read.parquet(to).select("i", "j", r("v", "v"))


@query(f"WITH {t.PAIRS}, k AS (SELECT n_nationkey id, row_number() OVER (ORDER BY n_nationkey) - 1 k FROM nation WHERE n_regionkey = 2) SELECT a.k i, b.k j, round(d, 6) v FROM pairs JOIN k a ON i = a.id JOIN k b ON j = b.id")
def matrix_selected(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "matrix")
    write_binary(urban.distance_table(t.zones(spark, d)).withColumnRenamed("d", "v"), path)
    keep = t.table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return applications.selected(spark, path, keep).select("i", "j", r("v", "v"))


@query(f"""WITH {t.PAIRS}, m(mode, scale) AS (VALUES ('road', CAST(0.2 AS DOUBLE)), ('rail', CAST(0.5 AS DOUBLE))), x AS (SELECT mode, i o, j d, d dist, exp(-d / scale) observed FROM pairs, m),
om AS (SELECT o, sum(observed) mass FROM x GROUP BY 1), dm AS (SELECT d, sum(observed) mass FROM x GROUP BY 1) SELECT 'o' side, o k, round(mass, 6) mass FROM om UNION ALL SELECT 'd', d, round(mass, 6) FROM dm""")
def multimode_masses(spark: SparkSession, d: str) -> DataFrame:
    _, o, dd = _multimode(spark, d)
    return o.select(F.lit("o").alias("side"), F.col("o").alias("k"), r("mass", "mass")).unionAll(dd.select(F.lit("d"), "d", r("mass", "mass")))


def _multimode(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = urban.distance_table(t.zones(spark, d)).collect()  # 625 pairs
    import math

    flows = {m: _file(spark, ["25,25", *(f"{x.i},{x.j},{math.exp(-x.d / s)!r}" for x in pairs)], m) for m, s in (("road", 0.2), ("rail", 0.5))}
    far = {m: _file(spark, ["25,25", *(f"{x.i},{x.j},{x.d!r}" for x in pairs)], f"{m}-distance") for m in flows}
    return applications.multimode(spark, flows, far)


_CALIBRATED = """x AS (SELECT mode, i o, j d, d dist, exp(-d / scale) observed FROM pairs, m), om AS (SELECT o, sum(observed) mass FROM x GROUP BY 1), dm AS (SELECT d, sum(observed) mass FROM x GROUP BY 1),
want AS (SELECT mode, sum(observed * dist) / sum(observed) want FROM x GROUP BY 1), f0 AS (SELECT mode, CAST(0.4 AS DOUBLE) decay FROM want), """ + ", ".join(
    f"g{k} AS MATERIALIZED (SELECT mode, max(decay) decay, sum(flow * dist) / sum(flow) got FROM (SELECT x.mode, decay, dist, om.mass * exp(-dist / decay) * dm.mass / sum(exp(-dist / decay) * dm.mass) OVER (PARTITION BY x.o) flow "
    f"FROM x JOIN om ON x.o = om.o JOIN dm ON x.d = dm.d JOIN f{k} f ON x.mode = f.mode) GROUP BY 1), "
    f"f{k + 1} AS MATERIALIZED (SELECT g.mode, CASE WHEN (SELECT max(abs(got / want - 1)) FROM g{k} JOIN want USING (mode)) <= 0.02 THEN decay ELSE decay * want / got END decay FROM g{k} g JOIN want ON g.mode = want.mode)"
    for k in range(20)
)


@query(f"WITH {t.PAIRS}, m(mode, scale) AS (VALUES ('road', CAST(0.2 AS DOUBLE)), ('rail', CAST(0.5 AS DOUBLE))), {_CALIBRATED} SELECT mode \"mode\", round(decay, 6) decay FROM f20")
def multimode_calibrated(spark: SparkSession, d: str) -> DataFrame:
    return applications.calibrated(*_multimode(spark, d), start=0.4, threshold=0.02, rounds=20).select("mode", r("decay", "decay"))


@query(f"""WITH {t.PAIRS}, {t.OD}, om AS (SELECT o, sum(mass) mass FROM od GROUP BY 1), dm AS (SELECT d, sum(mass) mass FROM od GROUP BY 1), f AS (SELECT i o, j d, exp(-pairs.d / 0.3) * dm.mass w FROM pairs JOIN om ON i = o JOIN dm ON j = dm.d),
h AS (SELECT o, d, sum(w) OVER (PARTITION BY o ORDER BY d) / sum(w) OVER (PARTITION BY o) high FROM f), c AS (SELECT c_custkey k, c_nationkey o, {u(6, 'c_custkey')} u FROM customer)
SELECT k individual_id, min(d) d FROM c JOIN h ON c.o = h.o WHERE high > u GROUP BY 1""")
def people_gravity_jobs(spark: SparkSession, d: str) -> DataFrame:
    flows = t.od(spark, d)
    pairs = urban.distance_table(t.zones(spark, d)).select(F.col("i").alias("o"), F.col("j").alias("d"), F.col("d").alias("dist"))
    people = t.table(spark, d, "customer").select(F.col("c_custkey").alias("individual_id"), F.col("c_nationkey").alias("o"))
    masses = flows.groupBy("o").agg(F.sum("mass").alias("mass")), flows.groupBy("d").agg(F.sum("mass").alias("mass"))
    return applications.gravity_jobs(people, pairs, *masses, 0.3, seed=6).select("individual_id", "d")


@query(f"""WITH {t.OD}, f AS (SELECT o, d, sum(mass) OVER (PARTITION BY o ORDER BY d) / sum(mass) OVER (PARTITION BY o) high FROM od),
c AS (SELECT c_custkey k, c_nationkey o, {u(5, 'c_custkey')} u FROM customer WHERE {u(5, 'c_custkey')} < 0.2 AND c_nationkey + 5 < 25)
SELECT k individual_id, min(d) d, round(min(7 + 2 * {u(5, 'k', 'chr(97)')}), 6) away FROM c JOIN f ON c.o = f.o WHERE high > u GROUP BY 1""")
def people_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Households and individuals sampled, placed, given workplaces and plans."""
    households = t.zones(spark, d).withColumnRenamed("city", "household_id")
    home = F.col("c_nationkey")
    people = t.table(spark, d, "customer").select(F.col("c_custkey").alias("individual_id"), (home + 5).alias("household_id"), home.alias("o"))
    made = applications.population(households, people, t.od(spark, d).withColumnRenamed("mass", "flow"), share=0.2, seed=5)
    return made.select("individual_id", "d", r(F.get("plan.actions", F.lit(0))["end"], "away"))


# -- networks of areas, rail, micro models -------------------------------------------------------------------------

_LATTICE = "l AS (SELECT k, (k // 6) * 1.0 x, (k % 6) * 1.0 y FROM (SELECT unnest(generate_series(0, 35)) k)), s AS (SELECT a.k a, b.k b, 1.0 length FROM l a JOIN l b ON (a.x = b.x AND b.y = a.y + 1) OR (a.y = b.y AND b.x = a.x + 1))"


def _streets(spark: SparkSession, d: str) -> DataFrame:
    """The links of a lattice as lines."""
    net = generators.grid_network(spark, 5, 1.0)
    at = lambda c: net.nodes.select(F.col("id").alias(c), F.struct("x", "y").alias(f"p_{c}"))
    return net.links.join(at("src"), "src").join(at("dst"), "dst").select(F.array("p_src", "p_dst").alias("coords"), F.lit(1.0).alias("weight"))


@query(f"WITH {_LATTICE}, i AS (SELECT k FROM l WHERE x BETWEEN 0 AND 2 AND y BETWEEN 0 AND 3) SELECT count(*) links, CAST(sum(length) AS DOUBLE) length FROM s WHERE a IN (FROM i) OR b IN (FROM i)")
def area_network(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    area = spark.range(1).select("id", F.array(corner(-0.5, -0.5), corner(2.5, -0.5), corner(2.5, 3.5), corner(-0.5, 3.5)).alias("ring"))
    return applications.area_network(_streets(spark, d), area, 0.01).links.agg(F.count("*").alias("links"), F.sum("length").alias("length"))


@query("SELECT a, b, CAST(least(abs(a - b), abs(a - 0) + 1 + abs(b - 5), abs(a - 5) + 1 + abs(b - 0)) AS DOUBLE) dist FROM (SELECT unnest(generate_series(0, 5)) a), (SELECT unnest(generate_series(0, 5)) b)")
def rail_scenario(spark: SparkSession, d: str) -> DataFrame:
    """Six stations along a line, with a new link between its ends."""
    k = F.col("id").cast("double")
    point = lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y"))
    lines = spark.range(5).select(F.array(point(k), point(k + 1)).alias("coords"), F.lit(1.0).alias("weight"))
    net, at = applications.rail_network(lines, spark.range(6).select("id", (k + 0.1).alias("x"), F.lit(0.1).alias("y")), 0.01, 0.5)
    ends = at.where("station IN (0, 5)").agg(F.min("node").alias("src"), F.max("node").alias("dst"))
    extra = ends.select(*[F.col(c).cast(net.links.schema[c].dataType) for c in ("src", "dst")], F.lit(1.0).alias("weight"), F.lit(1.0).alias("length"))
    return applications.station_distances(net.with_(links=net.links.select("src", "dst", "weight", "length")), at, extra).select("a", "b", "dist")


@query("SELECT 36 nodes, 1 components, true transit_faster")
def micro_network(spark: SparkSession, d: str) -> DataFrame:
    net, _ = applications.micro_network(spark, 5.0, 1.0, 4, 4.0, seed=2)
    fast = net.links.where("weight < length").agg((F.count("*") > 0).alias("transit_faster"))
    return network.summary(net).select("nodes", "components").crossJoin(fast)


@query(f"SELECT 'patch' kind, k id, 4.0 area FROM (SELECT unnest(generate_series(0, 24)) k) UNION ALL SELECT 'building', s_suppkey, 0.25 FROM supplier UNION ALL SELECT 'developer', k, round(10 * {u(3, 'k', _X)}, 6) FROM (SELECT unnest(generate_series(0, 9)) k)")
def micro_patches(spark: SparkSession, d: str) -> DataFrame:
    area = lambda df, kind: spatial.with_bounds(df).select(F.lit(kind).alias("kind"), "id", r("area", "area"))
    agents = applications.developers(spark, 10, 10.0, 5.0, seed=3).select(F.lit("developer").alias("kind"), "id", r("x", "area"))
    return area(applications.patches(spark, 10.0, 2.0), "patch").unionByName(area(applications.footprints(t.points(spark, d), 0.5), "building")).unionByName(agents)


# -- swarms --------------------------------------------------------------------------------------------------------

_RECIPE = "30 * (150.5, 5.0, 10.0, 0.25, 0.5, 20.0, 0.1, 0.5)\na line of remarks\n10 * (80.0, 30.0, 25.0, 0.75, 2.0, 40.0, 0.2, 0.25)\n"


@query("SELECT 40 n, round((30 * 0.25 + 10 * 0.75) / 40, 6) c1_mean, round((30 * 0.5 + 10 * 1.0) / 40, 6) c2_mean, round((30 * 20.0 + 10 * 40.0) / 40, 6) c3_mean, round(20 * sqrt(0.75 * 0.25), 6) c3_sd")
def swarm_recipe(spark: SparkSession, d: str) -> DataFrame:
    """Agents of a recipe, with genes beyond their bounds cut."""
    agents = simulation.recipe_agents(spark, _RECIPE, 100.0, seed=1)
    found = simulation.swarm_indicators(agents).crossJoin(agents.agg(F.count("*").alias("n")))
    return found.select("n", *[r(c, c) for c in ("c1_mean", "c2_mean", "c3_mean", "c3_sd")])


@query("SELECT n, line FROM (VALUES (30, '30 * (150.50, 5.00, 10.00, 0.25, 0.50, 20.00, 0.10, 0.50)'), (10, '10 * (80.00, 20.00, 25.00, 0.75, 1.00, 40.00, 0.20, 0.25)')) x(n, line)")
def swarm_recipe_text(spark: SparkSession, d: str) -> DataFrame:
    return simulation.recipe_text(simulation.recipe_agents(spark, _RECIPE, 100.0, seed=1))


@query(f"SELECT s_suppkey agent, row_number() OVER (ORDER BY s_suppkey * 7919 % 1000, s_suppkey) - 1 rank_x, row_number() OVER (ORDER BY s_suppkey * 104729 % 1000, s_suppkey) - 1 rank_y FROM supplier")
def swarm_ranks(spark: SparkSession, d: str) -> DataFrame:
    return simulation.ranked_agents(t.points(spark, d).withColumnRenamed("id", "agent"))


@query(f"SELECT k agent, round(least(1.0, 0.5 * CASE WHEN {u(4, 'k', 'chr(99) || chr(49)')} < 0.3 THEN 0.8 + 0.4 * {u(5, 'k', 'chr(99) || chr(49)')} ELSE 1 END), 6) c1 FROM (SELECT unnest(generate_series(0, 39)) k)")
def swarm_mutated(spark: SparkSession, d: str) -> DataFrame:
    agents = simulation.recipe_agents(spark, _RECIPE, 100.0, seed=1).withColumn("c1", F.lit(0.5))
    return simulation.mutated(agents, 0.3, seed=4).select("agent", r("c1", "c1"))


# -- filters -------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 > 0")
def values_real(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose value is neither null nor NaN."""
    v = F.when(F.col("c_custkey") % 3 == 0, F.lit(float("nan"))).when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return stats.real(t.table(spark, d, "customer").withColumn("v", v), "v").select("c_custkey")


@query("SELECT p_partkey run FROM part WHERE p_size / 50.0 > 0.05 AND p_size / 50.0 < 0.8 AND p_partkey % 4 > 0")
def runs_filtered(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import analysis

    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("run"), (F.col("p_size") / 50.0).alias("density"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).alias("moran"))
    return analysis.filtered(rows, ["moran"]).select("run")


@query("WITH g AS (SELECT p_partkey run, p_size * 1.0 a, p_retailprice / 100 b FROM part), k AS (SELECT t, a0, b0, run, (a - a0) * (a - a0) + (b - b0) * (b - b0) gap FROM g, (VALUES (1, 10.0, 12.0), (2, 40.0, 15.0)) c(t, a0, b0)) SELECT t AS \"target\", arg_min(run, (gap, run)) run FROM k GROUP BY 1")
def runs_nearest(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import analysis

    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("run"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))
    return analysis.nearest_run(rows, spark.createDataFrame([(1, 10.0, 12.0), (2, 40.0, 15.0)], "id int, a double, b double"), ["a", "b"]).select("target", "run")


@query(f"SELECT c_custkey, round(exp(1 + 0.5 * sqrt(-2 * ln(1 - {u(3, 'c_custkey')})) * cos(2 * pi() * {u(4, 'c_custkey')})), 6) v FROM customer")
def log_normal_draws(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "customer").select("c_custkey", r(generators.log_normal(1.0, 0.5, 3, "c_custkey"), "v"))


@query(f"WITH {t.OD}, {t.ZONES} SELECT od.o, od.d, round(a.x, 6) x1, round(b.y, 6) y2 FROM od JOIN zones a ON o = a.city JOIN zones b ON d = b.city")
def flows_as_links(spark: SparkSession, d: str) -> DataFrame:
    zones = t.zones(spark, d)
    made = interaction.as_links(t.od(spark, d), zones.withColumnRenamed("city", "o"), zones.withColumnRenamed("city", "d"))
    return made.select("o", "d", r("x1", "x1"), r("y2", "y2"))
