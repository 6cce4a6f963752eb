"""Stepwise models of systems of cities, on tables keyed (t, city). City systems are a few thousand rows; pair tables (i, j, d) are theirs.

Every step is a join and an aggregation over the pair table; loops run on the driver and cut lineage each step.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import interaction_potential, uniform, wealth
from .runtime import cut

Growth = Callable[[DataFrame, DataFrame], DataFrame]  # (city, pop), (i, j, d) -> (city, growth)


def distance_table(cities: DataFrame, limit: int = 20_000) -> DataFrame:
    """(i, j, d) of all ordered pairs of cities (city, x, y): the model's matrix, the square of a city system of at most ``limit`` cities, which is checked."""
    if cities.limit(limit + 1).count() > limit:
        raise ValueError(f"a table of all pairs is for at most {limit} cities")
    a, b = cities.select(F.col("city").alias("i"), "x", "y"), cities.select(F.col("city").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.crossJoin(b).select("i", "j", F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0))).alias("d"))


def synthetic_cities(spark: SparkSession, n: int, alpha: float, top: float, world: float, *, seed: int = 0) -> DataFrame:
    """city, x, y, pop: rank-size populations at random places."""
    k = F.col("id")
    return spark.range(n).select(k.alias("city"), (uniform(seed, k, F.lit("x")) * world).alias("x"), (uniform(seed, k, F.lit("y")) * world).alias("y"), (top * F.pow((k + 1).cast("double"), F.lit(-alpha))).alias("pop"))


def decayed(distances: DataFrame, decay: float) -> DataFrame:
    """(i, j, w) with w = exp(-d / decay)."""
    return distances.select("i", "j", F.exp(-F.col("d") / decay).alias("w"))


def lower_index(i: Column, j: Column) -> Column:
    """Place of the pair i > j (from 0) in the flattened lower triangle."""
    return i * (i - 1) / 2 + j


def potentials(pops: DataFrame, weights: DataFrame, gamma: float) -> DataFrame:
    """(i, j, potential): (p_i / P)^gamma w (p_j / P)^gamma, 0 on the diagonal."""
    total = pops.agg(F.sum("pop").alias("P"))
    share = pops.crossJoin(F.broadcast(total)).select("city", F.pow(F.col("pop") / F.col("P"), F.lit(gamma)).alias("s"))
    rows = weights.join(share.select(F.col("city").alias("i"), F.col("s").alias("si")), "i").join(share.select(F.col("city").alias("j"), F.col("s").alias("sj")), "j")
    return rows.select("i", "j", F.when(F.col("i") != F.col("j"), F.col("si") * F.col("w") * F.col("sj")).otherwise(0.0).alias("potential"))


def gibrat(rate: float) -> Growth:
    return lambda pops, distances: pops.select("city", F.lit(rate).alias("growth"))


def gravity(weight: float, gamma: float, decay: float) -> Growth:
    """weight / (n * mean potential) times a city's summed potential."""

    def growth(pops: DataFrame, distances: DataFrame) -> DataFrame:
        found = potentials(pops, decayed(distances, decay), gamma)
        per = found.groupBy("i").agg(F.sum("potential").alias("s"))
        mean = found.agg((F.sum("potential") / F.count("*")).alias("m"), F.countDistinct("i").alias("n"))
        return per.crossJoin(F.broadcast(mean)).select(F.col("i").alias("city"), F.when(F.col("m") > 0, weight * F.col("s") / (F.col("n") * F.col("m"))).otherwise(0.0).alias("growth"))

    return growth


def feedback(weight: float, gamma: float, city_pairs: DataFrame) -> Growth:
    """Network feedback: pair flows (p_i p_j / P^2)^gamma against a table (city, i, j, w) of each city's exposure to pairs."""

    def growth(pops: DataFrame, distances: DataFrame) -> DataFrame:
        total = pops.agg(F.sum("pop").alias("P"))
        at = lambda c: pops.select(F.col("city").alias(c), F.col("pop").alias(f"p{c}"))
        flows = distances.where("i < j").join(at("i"), "i").join(at("j"), "j").crossJoin(F.broadcast(total)).select("i", "j", F.pow(F.col("pi") * F.col("pj") / (F.col("P") * F.col("P")), F.lit(gamma)).alias("flow"))
        seen = city_pairs.join(flows, ["i", "j"]).groupBy("city").agg(F.sum(F.col("w") * F.col("flow")).alias("s"))
        mean = seen.agg(F.sum("s").alias("t"))
        return seen.crossJoin(F.broadcast(mean)).select("city", F.when(F.col("t") > 0, weight * F.col("s") / F.col("t")).otherwise(0.0).alias("growth"))

    return growth


def macro_step(pops: DataFrame, distances: DataFrame, rules: Sequence[Growth], dt: float) -> DataFrame:
    """p + p * dt * (sum of the growth rates)."""
    rates = None
    for rule in rules:
        own = rule(pops, distances).select("city", "growth")
        rates = own if rates is None else rates.unionByName(own)
    total = rates.groupBy("city").agg(F.sum("growth").alias("g"))
    return pops.join(total, "city", "left").select("city", (F.col("pop") * (1 + dt * F.coalesce("g", F.lit(0.0)))).alias("pop"))


def run_macro(initial: DataFrame, distances: DataFrame, dates: Sequence[float], rules: Sequence[Growth], update: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(t, city, pop) over the dates; ``update`` may change distances after each step (co-evolution)."""
    pops, d = cut(initial.select("city", F.col("pop").cast("double").alias("pop"))), cut(distances)
    out = pops.withColumn("t", F.lit(dates[0]))
    for before, now in zip(dates, dates[1:]):
        pops = cut(macro_step(pops, d, rules, now - before))
        out = out.unionByName(pops.withColumn("t", F.lit(now)))
        if update is not None:
            d = cut(update(pops, d))
    return out.select("t", "city", "pop")


def updated_network(pops: DataFrame, distances: DataFrame, *, gamma: float, top: float, exponent: float, q: float) -> DataFrame:
    """Distances shortened where flows pass their q-quantile, lengthened elsewhere: d / (1 + g) with g = top (1 - r) / (1 + r), r = (threshold / flow)^exponent."""
    from .stats import quantile

    flows = potentials(pops, distances.select("i", "j", F.lit(1.0).alias("w")), gamma)
    limit = quantile(flows.where("i <> j"), "potential", q).withColumnRenamed("quantile", "limit")
    r = F.pow(F.col("limit") / F.col("potential"), F.lit(exponent))
    g = F.when(F.col("potential") > 0, top * (1 - r) / (1 + r)).otherwise(F.lit(-top))
    return distances.join(flows, ["i", "j"]).crossJoin(F.broadcast(limit)).select("i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("d") / (1 + g)).alias("d"))


def fit(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    from .stats import log_mse

    return log_mse(simulated, observed, ("t", "city"), "pop")


def deltas(states: DataFrame) -> DataFrame:
    """Change of each city from the step before, over the largest change of the step."""
    gap = F.col("pop") - F.lag("pop").over(Window.partitionBy("city").orderBy("t"))
    rows = states.withColumn("delta", gap).where("delta IS NOT NULL")
    top = rows.groupBy("t").agg(F.max(F.abs("delta")).alias("top"))
    return rows.join(top, "t").select("t", "city", F.when(F.col("top") > 0, F.col("delta") / F.col("top")).otherwise(0.0).alias("delta"))


def accessibility(pops: DataFrame, weights: DataFrame) -> DataFrame:
    """city, population, closeness (mean weight), accessibility (population-weighted mean weight)."""
    total = pops.agg(F.sum("pop").alias("P"))
    rows = weights.join(pops.select(F.col("city").alias("j"), F.col("pop").alias("pj")), "j").groupBy("i").agg(F.avg("w").alias("closeness"), F.sum(F.col("w") * F.col("pj")).alias("s"))
    return rows.join(pops.select(F.col("city").alias("i"), "pop"), "i").crossJoin(F.broadcast(total)).select(F.col("i").alias("city"), F.col("pop").alias("population"), "closeness", (F.col("s") / F.col("P")).alias("accessibility"))


def average_distance(pops: DataFrame, distances: DataFrame) -> DataFrame:
    """Population-weighted mean distance."""
    at = lambda c: pops.select(F.col("city").alias(c), F.col("pop").alias(f"p{c}"))
    pairs = distances.join(at("i"), "i").join(at("j"), "j").agg(F.sum(F.col("pi") * F.col("pj") * F.col("d")).alias("s"))
    return pairs.crossJoin(pops.agg(F.sum("pop").alias("P"))).select((F.col("s") / (F.col("P") * F.col("P"))).alias("average_distance"))


def from_files(spark: SparkSession, populations: str, distances: str, dates: str, *, sep: str = ",") -> tuple[DataFrame, DataFrame, list[float]]:
    """(t, city, pop), (i, j, d) and the dates of a system of cities from matrix files: a row a city and a column a date; a square of distances; one date a line."""
    from ..sources.tables import read_matrix

    days = [r.v for r in read_matrix(spark, dates, sep=sep).orderBy("i").collect()]  # a few dates
    days_at = F.array(*[F.lit(float(x)) for x in days])
    pops = read_matrix(spark, populations, sep=sep).select(F.get(days_at, F.col("j")).alias("t"), F.col("i").alias("city"), F.col("v").alias("pop"))
    return pops, read_matrix(spark, distances, sep=sep).withColumnRenamed("v", "d"), days


# -- economic exchanges --------------------------------------------------------------------------------------------


def transactions(cities: DataFrame, distances: DataFrame, decay: float) -> DataFrame:
    """(i, j, amount): the lesser of i's supply share to j and j's demand share from i, by interaction potentials. Cities have (city, supply, demand)."""
    at = lambda c, v: cities.select(F.col("city").alias(c), F.col(v).alias(f"{v}_{c}"))
    rows = decayed(distances, decay).where("i <> j").join(at("i", "supply"), "i").join(at("j", "demand"), "j")
    rows = rows.withColumn("u", interaction_potential(F.col("supply_i"), F.col("demand_j"), F.col("w")))
    out, into = rows.groupBy("i").agg(F.sum("u").alias("ui")), rows.groupBy("j").agg(F.sum("u").alias("uj"))
    rows = rows.join(out, "i").join(into, "j")
    offered = F.when(F.col("ui") > 0, F.col("supply_i") * F.col("u") / F.col("ui")).otherwise(0.0)
    wanted = F.when(F.col("uj") > 0, F.col("demand_j") * F.col("u") / F.col("uj")).otherwise(0.0)
    return rows.select("i", "j", F.least(offered, wanted).alias("amount"))


def exchange_step(cities: DataFrame, distances: DataFrame, *, decay: float, multiplier: float, supply_exponent: float, demand_exponent: float, wealth_exponent: float) -> DataFrame:
    """(city, pop, wealth) after one round of exchanges: wealth gains multiplier * (sold - bought), population follows wealth."""
    traded = transactions(cities.select("city", wealth(F.col("wealth"), supply_exponent).alias("supply"), wealth(F.col("wealth"), demand_exponent).alias("demand")), distances, decay)
    sold, bought = traded.groupBy("i").agg(F.sum("amount").alias("sold")), traded.groupBy("j").agg(F.sum("amount").alias("bought"))
    rows = cities.join(sold, cities["city"] == sold["i"], "left").join(bought, cities["city"] == bought["j"], "left")
    new = F.greatest(F.lit(0.0), F.col("wealth") + multiplier * (F.coalesce("sold", F.lit(0.0)) - F.coalesce("bought", F.lit(0.0))))
    return rows.select("city", F.when(F.col("wealth") > 0, F.col("pop") * F.pow(new / F.col("wealth"), F.lit(1 / wealth_exponent))).otherwise(F.col("pop")).alias("pop"), new.alias("wealth"))


def run_exchanges(initial: DataFrame, distances: DataFrame, steps: int, **parameters: float) -> DataFrame:
    state, d = cut(initial.select("city", "pop", "wealth")), cut(distances)
    out = state.withColumn("t", F.lit(0))
    for t in range(1, steps + 1):
        state = cut(exchange_step(state, d, **parameters))
        out = out.unionByName(state.withColumn("t", F.lit(t)))
    return out.select("t", "city", "pop", "wealth")


def rescaled_wealth(cities: DataFrame) -> DataFrame:
    """(city, pop, wealth) with wealth rescaled to the total population."""
    totals = cities.agg(F.sum("pop").alias("_p"), F.sum("wealth").alias("_w"))
    return cities.crossJoin(F.broadcast(totals)).select("city", "pop", F.when(F.col("_w") > 0, F.col("wealth") * F.col("_p") / F.col("_w")).otherwise(0.0).alias("wealth"))


# -- innovation ----------------------------------------------------------------------------------------------------


def diffuse_innovations(shares: DataFrame, pops: DataFrame, distances: DataFrame, decay: float) -> DataFrame:
    """(innovation, city, utility, share) after diffusion: adoption spreads by share^(1/utility) over all cities with weights exp(-d / decay), then shares are normalised a city."""
    total = pops.agg(F.sum("pop").alias("P"))
    source = shares.join(pops, "city").crossJoin(F.broadcast(total)).select("innovation", "utility", F.col("city").alias("j"), (F.col("pop") / F.col("P") * F.pow("share", 1 / F.col("utility"))).alias("m"))
    reach = decayed(distances, decay).join(source, "j").groupBy("innovation", "utility", F.col("i").alias("city")).agg(F.sum(F.col("w") * F.col("m")).alias("p"))
    sums = reach.groupBy("city").agg(F.sum("p").alias("s"))
    return reach.join(sums, "city").select("innovation", "city", "utility", (F.col("p") / F.col("s")).alias("share"))


def new_innovations(shares: DataFrame, pops: DataFrame, *, rate: float, hierarchy: float, early: float, utility: float, t: int, seed: int = 0) -> DataFrame:
    """Mutation rule: each city invents with probability rate * (p / pmax)^hierarchy; adopters there start at the share ``early``."""
    top = pops.agg(F.max("pop").alias("top"))
    made = pops.crossJoin(F.broadcast(top)).where(uniform(seed, F.lit(t), "city") < rate * F.pow(F.col("pop") / F.col("top"), F.lit(hierarchy)))
    new = made.select(F.xxhash64(F.lit(t), "city").alias("innovation"), "city", (utility * (1 + uniform(seed + 1, F.lit(t), "city"))).alias("utility"))
    hit = new.groupBy("city").agg(F.count("*").alias("k"))
    kept = shares.join(hit, "city", "left").withColumn("share", F.when(F.col("k").isNotNull(), F.col("share") * (1 - early)).otherwise(F.col("share"))).drop("k")
    return kept.unionByName(new.withColumn("share", F.lit(early)))


def early_adopters(shares: DataFrame, cities: DataFrame, innovation: int, utility: float, early: float) -> DataFrame:
    """The shares after a new innovation, which the cities (city) adopt with the share ``early`` and the others not at all; other shares there shrink to make room."""
    chosen = cities.select("city", F.lit(True).alias("_new")).distinct()
    old = shares.join(chosen, "city", "left").withColumn("share", F.when(F.col("_new"), F.col("share") * (1 - early)).otherwise(F.col("share"))).select(*shares.columns)
    every = shares.select("city").distinct().join(chosen, "city", "left")
    new = every.select(F.lit(innovation).cast(shares.schema["innovation"].dataType).alias("innovation"), "city", F.lit(float(utility)).alias("utility"), F.when(F.col("_new"), early).otherwise(0.0).alias("share"))
    return old.unionByName(new)


def innovation_rate(states: DataFrame) -> DataFrame:
    """Innovations made a city and step, of (t, innovation, city, ...): distinct innovations over cities times steps."""
    return states.agg((F.countDistinct("innovation") / (F.countDistinct("city") * F.countDistinct("t"))).alias("rate"))


def mean_flow(flows: DataFrame) -> DataFrame:
    """Mean over steps of the mean potential of (t, i, j, potential)."""
    return flows.groupBy("t").agg(F.avg("potential").alias("m")).agg(F.avg("m").alias("flow"))


def innovation_step(shares: DataFrame, pops: DataFrame, distances: DataFrame, *, innovation_decay: float, gravity_decay: float, growth: float, weight: float, gamma: float, dt: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """New shares and populations: diffusion, then gravity growth scaled by a technology factor exp(sum of share * ln(share) * adoption)."""
    spread = cut(diffuse_innovations(shares, pops, distances, innovation_decay))
    level = spread.join(pops, "city").groupBy("innovation").agg((F.sum(F.col("share") * F.col("pop")) / F.sum("pop")).alias("level"))
    factor = spread.join(level, "innovation").groupBy("city").agg(F.exp(F.sum(F.when(F.col("share") > 0, F.col("level") * F.ln("share")).otherwise(0.0))).alias("f"))
    pulled = potentials(pops, decayed(distances, gravity_decay), gamma).join(factor, F.col("i") == F.col("city")).groupBy("i").agg(F.sum(F.col("potential") * F.col("f")).alias("s"))
    mean = pulled.agg(F.max("s").alias("m"))
    g = pulled.crossJoin(F.broadcast(mean)).select(F.col("i").alias("city"), F.when(F.col("m") > 0, growth + weight * F.col("s") / F.col("m")).otherwise(F.lit(growth)).alias("g"))
    return spread, cut(pops.join(g, "city").select("city", (F.col("pop") * (1 + dt * F.col("g"))).alias("pop")))


def utility(shares: DataFrame, pops: DataFrame) -> DataFrame:
    """Population-weighted mean utility, and diversity 1 - sum of squared macro shares, a time step (t, innovation, city, utility, share), (t, city, pop)."""
    rows = shares.join(pops, ["t", "city"])
    mean = rows.groupBy("t").agg((F.sum(F.col("share") * F.col("utility") * F.col("pop")) / F.sum(F.col("share") * F.col("pop"))).alias("utility"))
    macro = rows.groupBy("t", "innovation").agg(F.sum(F.col("share") * F.col("pop")).alias("a"))
    sums = macro.groupBy("t").agg((1 - F.sum(F.col("a") * F.col("a")) / (F.sum("a") * F.sum("a"))).alias("diversity"))
    return mean.join(sums, "t")


def run_multi(initial: DataFrame, distances: DataFrame, dates: Sequence[float], models: Sequence[Callable[[DataFrame, DataFrame, float], tuple[DataFrame, DataFrame]]]) -> DataFrame:
    """Sequentially coupled models: each takes (pops, distances, dt), returns new ones; (t, model, city, pop)."""
    pops, d = cut(initial.select("city", F.col("pop").cast("double").alias("pop"))), cut(distances)
    out = pops.withColumns({"t": F.lit(dates[0]), "model": F.lit(-1)})
    for before, now in zip(dates, dates[1:]):
        for k, model in enumerate(models):
            pops, d = (cut(x) for x in model(pops, d, now - before))
            out = out.unionByName(pops.withColumns({"t": F.lit(now), "model": F.lit(k)}))
    return out.select("t", "model", "city", "pop")
