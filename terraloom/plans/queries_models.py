"""Queries of spatial interaction and urban dynamics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform_sql as u
from ..operators import interaction, urban
from . import tables as t
from .registry import query, r

_MASSES = "om AS (SELECT o, sum(mass) mass FROM od GROUP BY 1), dm AS (SELECT d, sum(mass) mass FROM od GROUP BY 1), w AS (SELECT i o, j d, exp(-d / 0.4) w, d dist FROM pairs)"
_OD = f"WITH {t.PAIRS}, {t.OD}, {_MASSES}"


def _masses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    flows = t.od(spark, d)
    pairs = urban.distance_table(t.zones(spark, d)).select(F.col("i").alias("o"), F.col("j").alias("d"), F.exp(-F.col("d") / 0.4).alias("w"), F.col("d").alias("dist"))
    return flows, pairs, flows.groupBy("o").agg(F.sum("mass").alias("mass")), flows.groupBy("d").agg(F.sum("mass").alias("mass"))


@query(f"WITH {t.OD} SELECT o, d, round(mass, 3) mass FROM od")
def od_flows(spark: SparkSession, d: str) -> DataFrame:
    return t.od(spark, d).select("o", "d", r("mass", "mass", 3))


@query(f"{_OD} SELECT w.o, w.d, round(om.mass * w * dm.mass / sum(w * dm.mass) OVER (PARTITION BY w.o), 3) flow FROM w JOIN om ON w.o = om.o JOIN dm ON w.d = dm.d")
def gravity_singly(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, o, dd = _masses(spark, d)
    return interaction.singly_constrained(pairs, o, dd).select("o", "d", r("flow", "flow", 3))


@query(f"{_OD} SELECT w.o, w.d, round(dm.mass * w * om.mass / sum(w * om.mass) OVER (PARTITION BY w.d), 3) flow FROM w JOIN om ON w.o = om.o JOIN dm ON w.d = dm.d")
def gravity_destination(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, o, dd = _masses(spark, d)
    return interaction.singly_constrained(pairs, o, dd, origin_constraint=False).select("o", "d", r("flow", "flow", 3))


@query(f"""{_OD}, m(mode, decay) AS (VALUES ('road', CAST(0.2 AS DOUBLE)), ('rail', CAST(0.5 AS DOUBLE))), x AS (SELECT mode, o, d, dist, exp(-dist / decay) w FROM w, m),
f AS (SELECT mode, x.o, x.d, dist, om.mass * w * dm.mass / sum(w * dm.mass) OVER (PARTITION BY x.o) flow FROM x JOIN om ON x.o = om.o JOIN dm ON x.d = dm.d)
SELECT mode, round(sum(flow * dist) / sum(flow), 6) length, round(sum(flow), 2) flow FROM f GROUP BY 1""")
def gravity_multimode(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, o, dd = _masses(spark, d)
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(v).alias("decay")) for m, v in (("road", 0.2), ("rail", 0.5))])).alias("m")
    long = pairs.select("o", "d", "dist", modes).select("m.mode", "o", "d", "dist", F.exp(-F.col("dist") / F.col("m.decay")).alias("w"))
    flows = interaction.singly_constrained(long, o, dd)
    return interaction.trip_length(flows, ("mode",)).join(flows.groupBy("mode").agg(F.sum("flow").alias("flow")), "mode").select("mode", r("length", "length"), r("flow", "flow", 2))


@query(f"{_OD} SELECT w.o, w.d, round(w * om.mass * dm.mass, 0) flow FROM w JOIN om ON w.o = om.o JOIN dm ON w.d = dm.d")
def gravity_unconstrained(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, o, dd = _masses(spark, d)
    return interaction.unconstrained(pairs, o, dd).select("o", "d", r("flow", "flow", 0))


@query(f"{_OD} SELECT round(sum(mass * dist) / sum(mass), 6) length FROM od JOIN w ON od.o = w.o AND od.d = w.d")
def trip_length(spark: SparkSession, d: str) -> DataFrame:
    flows, pairs, _, _ = _masses(spark, d)
    return interaction.trip_length(flows.join(pairs, ["o", "d"]), value="mass").select(r("length", "length"))


@query(f"{_OD} SELECT 'o' side, o k, round(mass, 1) total FROM om UNION ALL SELECT 'd', d, round(mass, 1) FROM dm")
def gravity_doubly_margins(spark: SparkSession, d: str) -> DataFrame:
    """The margins of doubly constrained flows are the given masses."""
    _, pairs, o, dd = _masses(spark, d)
    flows = interaction.doubly_constrained(pairs, o, dd, tolerance=1e-10)
    return flows.groupBy(F.lit("o").alias("side"), F.col("o").alias("k")).agg(r(F.sum("flow"), "total", 1)).unionAll(flows.groupBy(F.lit("d"), "d").agg(r(F.sum("flow"), "total", 1)))


#: Balancing factors by 60 rounds of proportional fitting.
_BALANCED = "b0 AS (SELECT d, CAST(1 AS DOUBLE) b FROM dm),\n" + ",\n".join(
    f"a{k} AS MATERIALIZED (SELECT w.o, 1 / sum(w * b * dm.mass) a FROM w JOIN b{k - 1} b ON w.d = b.d JOIN dm ON w.d = dm.d GROUP BY 1), "
    f"b{k} AS MATERIALIZED (SELECT w.d, 1 / sum(w * a * om.mass) b FROM w JOIN a{k} a ON w.o = a.o JOIN om ON w.o = om.o GROUP BY 1)"
    for k in range(1, 61)
)


@query(f"{_OD}, {_BALANCED} SELECT w.o, w.d, round(w * a * om.mass * b * dm.mass, 2) flow FROM w JOIN a60 a ON w.o = a.o JOIN b60 b ON w.d = b.d JOIN om ON w.o = om.o JOIN dm ON w.d = dm.d")
def gravity_doubly(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, o, dd = _masses(spark, d)
    return interaction.doubly_constrained(pairs, o, dd, tolerance=1e-12, rounds=60).select("o", "d", r("flow", "flow", 2))


#: The decay that fits observed trip lengths: up to 20 corrections, none once within a hundredth.
_FITTED = "f0 AS (SELECT CAST(0.5 AS DOUBLE) decay), want AS (SELECT sum(od.mass * exp(-dist / 0.3) * dist) / sum(od.mass * exp(-dist / 0.3)) want FROM od JOIN w ON od.o = w.o AND od.d = w.d),\n" + ",\n".join(
    f"f{k} AS MATERIALIZED (SELECT CASE WHEN abs(got / want - 1) <= 0.01 THEN decay ELSE decay * want / got END decay FROM (SELECT max(decay) decay, sum(flow * dist) / sum(flow) got FROM "
    f"(SELECT decay, dist, om.mass * exp(-dist / decay) * dm.mass / sum(exp(-dist / decay) * dm.mass) OVER (PARTITION BY w.o) flow FROM w JOIN od ON w.o = od.o AND w.d = od.d JOIN om ON w.o = om.o JOIN dm ON w.d = dm.d, f{k - 1})), want)"
    for k in range(1, 21)
)


@query(f"{_OD}, {_FITTED} SELECT 'all' \"mode\", round(decay, 6) decay FROM f20")
def gravity_fitted(spark: SparkSession, d: str) -> DataFrame:
    flows, pairs, o, dd = _masses(spark, d)
    fitted = interaction.fit_decay(pairs.join(flows, ["o", "d"]).withColumn("observed", F.col("mass") * F.exp(-F.col("dist") / 0.3)).drop("w", "mass"), o, dd, start=0.5)
    return spark.createDataFrame(list(fitted.items()), "mode string, decay double").select("mode", r("decay", "decay"))


_FIRST = f"WITH {t.PAIRS}, {t.POP}, p AS (SELECT city, sum(pop) pop FROM pop GROUP BY 1), tot AS (SELECT sum(pop) total FROM p)"
_POT = "pot AS (SELECT i, j, CASE WHEN i <> j THEN power(a.pop / total, 0.8) * exp(-pairs.d / 0.5) * power(b.pop / total, 0.8) ELSE 0 END u FROM pairs JOIN p a ON i = a.city JOIN p b ON j = b.city CROSS JOIN tot)"


def _first(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The cities that models start from, by their revenue of all years, and their distances."""
    return t.pop(spark, d).groupBy("city").agg(F.sum("pop").alias("pop")), urban.distance_table(t.zones(spark, d))


@query(f"{_FIRST}, {_POT} SELECT i, j, round(u, 8) potential FROM pot")
def gravity_potentials(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    return urban.potentials(pops, urban.decayed(distances, 0.5), 0.8).select("i", "j", r("potential", "potential", 8))


@query(f"""{_FIRST}, {_POT}, g AS (SELECT i, sum(u) s FROM pot GROUP BY 1), m AS (SELECT sum(u) / count(*) m, count(DISTINCT i) n FROM pot)
SELECT city, round(pop * (1 + 1.0 * (0.01 + 0.02 * s / (n * m))), 3) pop FROM p JOIN g ON city = i CROSS JOIN m""")
def macro_step(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    return urban.macro_step(pops, distances, [urban.gibrat(0.01), urban.gravity(0.02, 0.8, 0.5)], 1.0).select("city", r("pop", "pop", 3))


@query(f"{_FIRST}, k AS (SELECT unnest(generate_series(0, 3)) t) SELECT CAST(t AS DOUBLE) t, city, round(pop * power(1.02, t), 3) pop FROM p, k")
def macro_run(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    return urban.run_macro(pops, distances, [0.0, 1.0, 2.0, 3.0], [urban.gibrat(0.02)]).select("t", "city", r("pop", "pop", 3))


def _coevolved(k: int) -> str:
    """Step k: growth by the distances before it, then distances by the flows after it."""
    pot = f"power(a.pop / total, 0.8) * power(b.pop / total, 0.8)"
    return f"""
t{k} AS (SELECT sum(pop) total FROM s{k}),
u{k} AS (SELECT i, j, CASE WHEN i <> j THEN {pot} * exp(-x.d / 0.5) ELSE 0 END u FROM x{k} x JOIN s{k} a ON i = a.city JOIN s{k} b ON j = b.city CROSS JOIN t{k}),
s{k + 1} AS MATERIALIZED (SELECT city, pop * (1 + 0.01 + 0.02 * g / (n * m)) pop FROM s{k} JOIN (SELECT i, sum(u) g FROM u{k} GROUP BY 1) ON city = i CROSS JOIN (SELECT sum(u) / count(*) m, count(DISTINCT i) n FROM u{k})),
v{k} AS (SELECT i, j, x.d, CASE WHEN i <> j THEN {pot} ELSE 0 END u FROM x{k} x JOIN s{k + 1} a ON i = a.city JOIN s{k + 1} b ON j = b.city CROSS JOIN (SELECT sum(pop) total FROM s{k + 1})),
x{k + 1} AS MATERIALIZED (SELECT i, j, CASE WHEN i = j THEN 0 ELSE d / (1 + 0.1 * (1 - l / u) / (1 + l / u)) END d FROM v{k} CROSS JOIN (SELECT median(u) l FROM v{k} WHERE i <> j))"""


@query(f"{_FIRST}, s0 AS (SELECT city, pop FROM p), x0 AS (SELECT i, j, d FROM pairs), {_coevolved(0)}, {_coevolved(1)} " + " UNION ALL ".join(f"SELECT CAST({k} AS DOUBLE) t, city, round(pop, 3) pop FROM s{k}" for k in range(3)))
def macro_coevolution(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    rules = [urban.gibrat(0.01), urban.gravity(0.02, 0.8, 0.5)]
    return urban.run_macro(pops, distances, [0.0, 1.0, 2.0], rules, lambda p, x: urban.updated_network(p, x, gamma=0.8, top=0.1, exponent=1.0, q=0.5)).select("t", "city", r("pop", "pop", 3))


@query(f"{_FIRST} SELECT i city, round(max(a.pop), 3) population, round(avg(exp(-d / 0.5)), 6) closeness, round(sum(exp(-d / 0.5) * b.pop) / max(total), 6) accessibility FROM pairs JOIN p a ON i = a.city JOIN p b ON j = b.city CROSS JOIN tot GROUP BY 1")
def macro_accessibility(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    return urban.accessibility(pops, urban.decayed(distances, 0.5)).select("city", r("population", "population", 3), r("closeness", "closeness"), r("accessibility", "accessibility"))


@query(f"{_FIRST} SELECT round(sum(a.pop * b.pop * d) / max(total * total), 6) average_distance FROM pairs JOIN p a ON i = a.city JOIN p b ON j = b.city CROSS JOIN tot")
def macro_average_distance(spark: SparkSession, d: str) -> DataFrame:
    return urban.average_distance(*_first(spark, d)).select(r("average_distance", "average_distance"))


@query(f"""WITH {t.POP}, l AS (SELECT t, city, pop - lag(pop) OVER (PARTITION BY city ORDER BY t) g FROM pop), m AS (SELECT t, max(abs(g)) top FROM l WHERE g IS NOT NULL GROUP BY 1)
SELECT l.t, city, round(g / top, 6) delta FROM l JOIN m ON l.t = m.t WHERE g IS NOT NULL""")
def macro_deltas(spark: SparkSession, d: str) -> DataFrame:
    return urban.deltas(t.pop(spark, d)).select("t", "city", r("delta", "delta"))


_TRADE = """u AS (SELECT i, j, a.pop si, b.pop dj, a.pop * b.pop * exp(-d / 0.5) u FROM pairs JOIN p a ON i = a.city JOIN p b ON j = b.city WHERE i <> j),
x AS (SELECT i, j, least(si * u / sum(u) OVER (PARTITION BY i), dj * u / sum(u) OVER (PARTITION BY j)) amount FROM u)"""


@query(f"{_FIRST}, {_TRADE} SELECT i, j, round(amount, 4) amount FROM x")
def exchange_transactions(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    return urban.transactions(pops.select("city", F.col("pop").alias("supply"), F.col("pop").alias("demand")), distances, 0.5).select("i", "j", r("amount", "amount", 4))


@query(f"""{_FIRST}, {_TRADE}, s AS (SELECT i city, sum(amount) a FROM x GROUP BY 1), b AS (SELECT j city, sum(amount) a FROM x GROUP BY 1)
SELECT p.city, round(greatest(0, pop + 0.5 * (s.a - b.a)), 3) wealth, round(pop * power(greatest(0, pop + 0.5 * (s.a - b.a)) / pop, 0.8), 3) pop FROM p JOIN s ON p.city = s.city JOIN b ON p.city = b.city""")
def exchange_step(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    out = urban.exchange_step(pops.withColumn("wealth", F.col("pop")), distances, decay=0.5, multiplier=0.5, supply_exponent=1.0, demand_exponent=1.0, wealth_exponent=1.25)
    return out.select("city", r("wealth", "wealth", 3), r("pop", "pop", 3))


_SHARES = "sh AS (SELECT k innovation, city, CAST(1 + k AS DOUBLE) utility, CASE WHEN k = 0 THEN 1 - (0.1 + city / 50.0) ELSE 0.1 + city / 50.0 END share FROM (SELECT CAST(unnest(generate_series(0, 1)) AS INT) k), p)"


def _shares(pops: DataFrame) -> DataFrame:
    second = 0.1 + F.col("city") / 50.0
    return pops.select("city", F.explode(F.array(F.lit(0), F.lit(1))).alias("innovation")).select("innovation", "city", (1.0 + F.col("innovation")).alias("utility"), F.when(F.col("innovation") == 0, 1 - second).otherwise(second).alias("share"))


@query(f"""{_FIRST}, {_SHARES}, m AS (SELECT innovation, utility, sh.city j, pop / total * power(share, 1 / utility) m FROM sh JOIN p ON sh.city = p.city CROSS JOIN tot),
q AS (SELECT innovation, i city, sum(exp(-d / 0.5) * m) p FROM pairs JOIN m ON pairs.j = m.j GROUP BY 1, 2)
SELECT innovation, city, round(p / sum(p) OVER (PARTITION BY city), 6) share FROM q""")
def innovation_diffusion(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    return urban.diffuse_innovations(_shares(pops), pops, distances, 0.5).select("innovation", "city", r("share", "share"))


@query(f"""{_FIRST}, {_SHARES}, a AS (SELECT innovation, utility, share * pop x, pop FROM sh JOIN p ON sh.city = p.city), k AS (SELECT innovation, sum(x) x FROM a GROUP BY 1)
SELECT round((SELECT sum(x * utility) / sum(x) FROM a), 6) utility, round(1 - sum(x * x) / (sum(x) * sum(x)), 6) diversity FROM k""")
def innovation_utility(spark: SparkSession, d: str) -> DataFrame:
    pops, _ = _first(spark, d)
    at = lambda x: x.withColumn("t", F.lit(0))
    return urban.utility(at(_shares(pops)), at(pops)).select(r("utility", "utility"), r("diversity", "diversity"))


_INVENTED = f"""hit AS (SELECT city, 2 * (1 + {u(4, "1", "city")}) utility FROM p WHERE {u(3, "1", "city")} < 0.5 * pop / (SELECT max(pop) FROM p)),
shares AS (SELECT innovation, sh.city, sh.utility, CASE WHEN hit.city IS NULL THEN share ELSE share * 0.9 END share FROM sh LEFT JOIN hit ON sh.city = hit.city UNION ALL SELECT 1000 + city, city, utility, 0.1 FROM hit)"""


@query(f"""{_FIRST}, {_POT}, {_SHARES}, {_INVENTED}, m AS (SELECT innovation, utility, shares.city j, pop / total * power(share, 1 / utility) m FROM shares JOIN p ON shares.city = p.city CROSS JOIN tot),
q AS (SELECT innovation, i city, sum(exp(-d / 0.5) * m) q FROM pairs JOIN m ON pairs.j = m.j GROUP BY 1, 2), s AS (SELECT innovation, city, q / sum(q) OVER (PARTITION BY city) share FROM q),
l AS (SELECT innovation, sum(share * pop) / sum(pop) level FROM s JOIN p ON s.city = p.city GROUP BY 1), f AS (SELECT city, exp(sum(CASE WHEN share > 0 THEN level * ln(share) ELSE 0 END)) f FROM s JOIN l ON s.innovation = l.innovation GROUP BY 1),
g AS (SELECT i city, sum(u * f) g FROM pot JOIN f ON i = city GROUP BY 1) SELECT p.city, round(pop * (1 + 0.01 + 0.02 * g / (SELECT max(g) FROM g)), 3) pop FROM p JOIN g ON p.city = g.city""")
def innovation_step(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    shares = urban.new_innovations(_shares(pops), pops, rate=0.5, hierarchy=1.0, early=0.1, utility=2.0, t=1, seed=3)
    return urban.innovation_step(shares, pops, distances, innovation_decay=0.5, gravity_decay=0.5, growth=0.01, weight=0.02, gamma=0.8)[1].select("city", r("pop", "pop", 3))


def _exchanged(k: int) -> str:
    return f"""
y{k} AS (SELECT i, j, a.wealth si, b.wealth dj, a.wealth * b.wealth * exp(-d / 0.5) u FROM pairs JOIN s{k} a ON i = a.city JOIN s{k} b ON j = b.city WHERE i <> j),
z{k} AS (SELECT i, j, least(si * u / sum(u) OVER (PARTITION BY i), dj * u / sum(u) OVER (PARTITION BY j)) amount FROM y{k}),
w{k} AS (SELECT city, pop, wealth, greatest(0, wealth + 0.5 * (a - b)) new FROM s{k} JOIN (SELECT i, sum(amount) a FROM z{k} GROUP BY 1) ON city = i JOIN (SELECT j, sum(amount) b FROM z{k} GROUP BY 1) ON city = j),
s{k + 1} AS MATERIALIZED (SELECT city, pop * power(new / wealth, 0.8) pop, new wealth FROM w{k})"""


@query(f"{_FIRST}, s0 AS (SELECT city, pop, pop wealth FROM p), {_exchanged(0)}, {_exchanged(1)}, {_exchanged(2)} " + " UNION ALL ".join(f"SELECT {k} t, city, round(pop, 3) pop, round(wealth, 3) wealth FROM s{k}" for k in range(4)))
def exchange_run(spark: SparkSession, d: str) -> DataFrame:
    pops, distances = _first(spark, d)
    out = urban.run_exchanges(pops.withColumn("wealth", F.col("pop")), distances, 3, decay=0.5, multiplier=0.5, supply_exponent=1.0, demand_exponent=1.0, wealth_exponent=1.25)
    return out.select("t", "city", r("pop", "pop", 3), r("wealth", "wealth", 3))
