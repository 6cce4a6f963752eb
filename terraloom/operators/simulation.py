"""Simulation models: slime-mould networks, multiscale cities, buildings on grids, swarms, and experiment plans."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.columns import uniform
from . import generators, grid
from .matrix import solve
from .network import Network, components
from .ranks import numbered
from .runtime import cut


def slime_mould(net: Network, source: int, sink: int, *, flow: float = 1.0, gamma: float = 1.8, decay: float = 1.0, dt: float = 0.1, rounds: int = 20) -> DataFrame:
    """src, dst, diameter, flow after rounds of pressure flow and tube adaptation between two nodes.

    The pressures of a round solve a linear system on the driver (bounded by the dense limit); flows and diameters are columns.
    Links of other components carry nothing. Where no path joins the two nodes, or one is not in the network, the system has
    no solution: there is no flow and diameters stay as they are.
    """
    comp = cut(components(net))
    ends = {r.id: r.component for r in comp.where(F.col("id").isin(source, sink)).toLocalIterator()}
    joined = source in ends and ends[source] == ends.get(sink)
    ids = sorted(r.id for r in comp.where(F.col("component") == ends[sink]).select("id").toLocalIterator()) if joined else []
    place = {v: k for k, v in enumerate(ids)}
    state = cut(net.links.select("src", "dst", F.greatest("length", F.lit(1e-9)).alias("length"), F.lit(1.0).alias("diameter"), F.lit(0.0).alias("flow")))
    if not joined:
        return state.select("src", "dst", "diameter", "flow")
    index = net.nodes.sparkSession.createDataFrame(list(place.items()), "id long, k int")
    at = lambda c: index.select(F.col("id").alias(c), F.col("k").alias(f"{c}_k"))
    for _ in range(rounds):
        pace = state.join(at("src"), "src").join(at("dst"), "dst").withColumn("c", F.col("diameter") / F.col("length"))
        cells = F.explode(F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("v")) for i, j, v in (("src_k", "src_k", F.col("c")), ("dst_k", "dst_k", F.col("c")), ("src_k", "dst_k", -F.col("c")), ("dst_k", "src_k", -F.col("c")))])).alias("m")
        laplace = pace.select(cells).select("m.*").groupBy("i", "j").agg(F.sum("v").alias("v"))
        ground = place[sink]
        fixed = laplace.where((F.col("i") != ground)).unionByName(net.nodes.sparkSession.createDataFrame([(ground, ground, 1.0)], "i int, j int, v double"))
        b = [0.0] * len(ids)
        b[place[source]] = flow
        pressure = solve(fixed, b)
        if pressure is None:
            break
        p = net.nodes.sparkSession.createDataFrame([(v, float(pressure[k])) for v, k in place.items()], "id long, p double")
        on = lambda c: p.select(F.col("id").alias(c), F.col("p").alias(f"{c}_p"))
        drop = F.coalesce(F.col("src_p") - F.col("dst_p"), F.lit(0.0))
        moved = state.join(on("src"), "src", "left").join(on("dst"), "dst", "left").withColumn("q", F.col("diameter") / F.col("length") * drop)
        power = F.pow(F.abs("q"), F.lit(gamma))
        state = cut(moved.select("src", "dst", "length", (F.col("diameter") + dt * (power / (1 + power) - decay * F.col("diameter"))).alias("diameter"), F.col("q").alias("flow")))
    return state.select("src", "dst", "diameter", "flow")


def grown_network(initial: Network, add_nodes: Callable[[Network, int], Network], add_links: Callable[[Network, int], Network], *, nodes: int, rounds: int = 100) -> Network:
    """Heuristics for nodes and links, by turns, until there are ``nodes`` nodes."""
    net = initial
    for k in range(rounds):
        if net.nodes.count() >= nodes:
            break
        net = add_links(add_nodes(net, k), k)
        net = net.with_(nodes=cut(net.nodes), links=cut(net.links))
    return net


def multiscale_step(pops: DataFrame, grids: DataFrame, growth: DataFrame, *, alpha: float, beta: float, rounds: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cities (city, pop) grow by (city, growth); each city's grid (grid_id = city) takes its new people by share^alpha and diffuses: one task a city."""
    new = cut(pops.join(growth, "city", "left").select("city", (F.col("pop") * (1 + F.coalesce("growth", F.lit(0.0)))).alias("pop"), F.greatest(F.lit(0.0), F.col("pop") * F.coalesce("growth", F.lit(0.0))).alias("more")))
    rows = grids.join(new.select(F.col("city").alias("grid_id"), "more"), "grid_id")
    kind = grids.schema["grid_id"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a = grid.dense(table)
        r = np.random.default_rng([seed, abs(int(key[0].as_py()))])
        w = (a / a.sum()) ** alpha if a.sum() > 0 else np.ones_like(a)
        more = table["more"][0].as_py()
        a = a + r.multinomial(int(more), (w / w.sum()).ravel()).reshape(a.shape) + (more - int(more)) * w / w.sum()  # whole people by lot, the rest by share
        for _ in range(rounds):
            a = generators._diffused(a, beta)
        i, j = np.indices(a.shape)
        return pa.table({"grid_id": pa.array([key[0].as_py()] * a.size, table["grid_id"].type), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": a.ravel()})

    return new.drop("more"), rows.groupBy("grid_id").applyInArrow(run, f"grid_id {kind}, i int, j int, v double")


def building_grid(buildings: DataFrame, x0: float, y0: float, side: float) -> DataFrame:
    """i, j and a column of floor space a building kind, from (x, y, kind, surface, storeys)."""
    cells = buildings.select(F.floor((F.col("x") - x0) / side).cast("int").alias("i"), F.floor((F.col("y") - y0) / side).cast("int").alias("j"), "kind", (F.col("surface") * F.col("storeys")).alias("space"))
    return cells.groupBy("i", "j").pivot("kind", ["home", "work"]).sum("space").na.fill(0.0)


def free_slots(grid_: DataFrame, x: float, y: float, n: int) -> DataFrame:
    """The n empty cells nearest to a place: a top-n, ties by cell."""
    d = F.pow(F.col("i") - x, F.lit(2.0)) + F.pow(F.col("j") - y, F.lit(2.0))
    return grid_.where("v = 0").withColumn("d", d).orderBy("d", "i", "j").limit(n).select("i", "j")


def swarm_step(agents: DataFrame, world: float, *, seed: int, t: int) -> DataFrame:
    """One step of swarm chemistry on a torus: agents (agent, x, y, dx, dy, radius, normal, most, c1, c2, c3, c4, c5) see others within their radius.

    Neighbours are found in cells of the largest radius, sums are aggregated first, so no agent gathers its neighbours. Where agents
    share places, places are joined, not agents: those at one place count together, and each agent takes itself off the sums of its place.
    """
    size = agents.agg(F.max("radius").alias("radius"), F.count("*").alias("agents"), F.count_distinct(F.struct("x", "y")).alias("places")).first()
    shared = size.places < size.agents
    cell = size.radius or 1.0
    n = max(1, math.floor(world / cell))
    cell = world / n
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted({(a % n, b % n) for a in (-1, 0, 1) for b in (-1, 0, 1)})]))
    tile = lambda c: F.pmod(F.floor(F.col(c) / cell), F.lit(n))
    seek = agents.select("x", "y", "radius")
    seek = (seek.distinct() if shared else seek).withColumn("o", around).select("x", "y", "radius", ((tile("x") + F.col("o.a")) % n).alias("tx"), ((tile("y") + F.col("o.b")) % n).alias("ty"))
    others = agents.withColumnsRenamed({"x": "ox", "y": "oy"})
    if shared:
        others = others.groupBy("ox", "oy").agg(F.count("*").alias("k"), *[f(v).alias(f"{v}_{name}") for v in ("dx", "dy") for name, f in (("sum", F.sum), ("k", F.count))])
    else:
        others = others.select("ox", "oy", F.lit(1).alias("k"), *[c for v in ("dx", "dy") for c in (F.col(v).alias(f"{v}_sum"), F.col(v).isNotNull().cast("int").alias(f"{v}_k"))])
    others = others.withColumns({"tx": tile("ox"), "ty": tile("oy")})
    half_up = lambda q: F.signum(q) * (F.floor(F.abs(q)) + F.when(F.abs(q) - F.floor(F.abs(q)) >= 0.5, 1).otherwise(0))  # noqa: E731  # as F.round, which goes through decimals
    wrap = lambda a, b: (F.col(a) - F.col(b)) - world * half_up((F.col(a) - F.col(b)) / world)
    near = seek.join(others, ["tx", "ty"]).withColumns({"gx": wrap("ox", "x"), "gy": wrap("oy", "y")})
    d2 = F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")
    near = near.where(d2 <= F.col("radius") * F.col("radius"))
    near = near.withColumns({"rx": -F.col("gx") / F.greatest(d2, F.lit(1e-6)), "ry": -F.col("gy") / F.greatest(d2, F.lit(1e-6))})
    parts = ("gx", "gy", "rx", "ry")
    near = near.withColumns({f"{c}_high": F.rint(F.col(c) * 2.0**32) / 2.0**32 if shared else F.col(c) for c in parts})  # high parts add up exactly: opposite terms of many agents cancel in any order
    sums = {"k": F.col("k")} | {f"{c}_high": F.col("k") * F.col(f"{c}_high") for c in parts} | {f"{c}_low": F.col("k") * (F.col(c) - F.col(f"{c}_high")) for c in parts}
    sums |= {c: F.col(c) for c in ("dx_sum", "dx_k", "dy_sum", "dy_k")}
    seen = near.groupBy("x", "y", "radius").agg(*[F.sum(v).alias(c) for c, v in sums.items()])
    mean = lambda total, count: F.when(count > 0, total / count)
    velocity = lambda v: mean(F.col(f"{v}_sum") - F.coalesce(v, F.lit(0.0)), F.col(f"{v}_k") - F.col(v).isNotNull().cast("int"))
    total = lambda c: F.col(f"{c}_high") + F.col(f"{c}_low")
    centre = {f"m{c}": mean(total(f"g{c}"), F.col("k") - 1) for c in ("x", "y")}
    rows = agents.join(seen, ["x", "y", "radius"], "left").withColumns(centre | {"vx": velocity("dx"), "vy": velocity("dy"), "rx": total("rx"), "ry": total("ry")})
    noise = lambda axis: F.when(uniform(seed, F.lit(t), "agent", F.lit("n")) < F.col("c4"), 10 * (uniform(seed, F.lit(t), "agent", F.lit(axis)) - 0.5)).otherwise(0.0)
    alone = lambda axis: uniform(seed, F.lit(t), "agent", F.lit(f"{axis}a")) - 0.5
    push = lambda m, v, r, own, axis: F.when(F.col("mx").isNotNull(), F.col("c1") * F.col(m) + F.col("c2") * (F.col(v) - F.col(own)) + F.col("c3") * F.col(r)).otherwise(alone(axis)) + noise(axis)
    rows = rows.withColumns({"nx": F.col("dx") + push("mx", "vx", "rx", "dx", "x"), "ny": F.col("dy") + push("my", "vy", "ry", "dy", "y")})
    speed = F.greatest(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny")), F.lit(1e-9))
    capped = F.least(F.lit(1.0), F.col("most") / speed)
    pace = F.col("c5") * F.col("normal") / (speed * capped) + (1 - F.col("c5"))
    rows = rows.withColumns({"dx": F.col("nx") * capped * pace, "dy": F.col("ny") * capped * pace})
    inside = lambda p, v: F.pmod(F.col(p) + F.col(v), F.lit(world))
    return rows.withColumns({"x": inside("x", "dx"), "y": inside("y", "dy")}).select(*agents.columns)


def swarm_indicators(agents: DataFrame) -> DataFrame:
    """Mean and standard deviation of the genes c1, c2 and c3."""
    return agents.agg(*[f(c).alias(f"{c}_{n}") for c in ("c1", "c2", "c3") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def ranked_agents(agents: DataFrame) -> DataFrame:
    """agent, rank_x, rank_y: places in the order of x and of y, from 0, ties by agent; by ranges, not in one task."""
    by = lambda axis: numbered(agents.select("agent", axis), F.struct(axis, "agent").asc(), f"rank_{axis}").select("agent", f"rank_{axis}")
    return by("x").join(by("y"), "agent")


#: The genes of swarm agents and their upper bounds, in order.
GENES = (("radius", 300.0), ("normal", 20.0), ("most", 40.0), ("c1", 1.0), ("c2", 1.0), ("c3", 100.0), ("c4", 0.5), ("c5", 1.0))


def bounded_genes(agents: DataFrame) -> DataFrame:
    """Genes cut to their bounds; the normal speed is at most the greatest."""
    held = agents.withColumns({name: F.least(F.greatest(F.col(name).cast("double"), F.lit(0.0)), F.lit(top)) for name, top in GENES})
    return held.withColumn("normal", F.least("normal", "most"))


def read_recipe(text: str) -> list[tuple[int, tuple[float, ...]]]:
    """A recipe's lines ``count * (gene, gene, ...)`` as counts and genes; other lines are passed over."""
    found = re.findall(r"^\s*(\d+)\s*\*\s*\(([^)]*)\)", text, re.M)
    rows = [(int(n), tuple(float(x) for x in genes.split(","))) for n, genes in found]
    if any(len(genes) != len(GENES) for _, genes in rows):
        raise ValueError(f"a recipe's lines have {len(GENES)} genes")
    return rows


def recipe_text(agents: DataFrame) -> DataFrame:
    """n, line: a recipe line for each distinct set of genes, counted."""
    names = [name for name, _ in GENES]
    genes = F.concat_ws(", ", *[F.format_string("%.2f", F.col(c)) for c in names])
    return agents.groupBy(*names).agg(F.count("*").alias("n")).select("n", F.concat(F.col("n").cast("string"), F.lit(" * ("), genes, F.lit(")")).alias("line"))


def recipe_agents(spark: SparkSession, text: str, world: float, *, seed: int = 0) -> DataFrame:
    """The agents of a recipe, at random places on the torus and at rest."""
    names = [name for name, _ in GENES]
    kinds = spark.createDataFrame([(k, n, *genes) for k, (n, genes) in enumerate(read_recipe(text))], "kind int, n int, " + ", ".join(f"{c} double" for c in names))
    each = kinds.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    numbered_ = numbered(each, F.struct("kind", "k").asc(), "agent")
    place = lambda axis: (uniform(seed, "agent", F.lit(axis)) * world).alias(axis)
    return bounded_genes(numbered_.select("agent", place("x"), place("y"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), *names))


def mutated(agents: DataFrame, rate: float, *, seed: int = 0) -> DataFrame:
    """Each gene multiplied by a uniform factor in [0.8, 1.2) with probability ``rate``, then bounded."""
    change = lambda c: F.when(uniform(seed, "agent", F.lit(c)) < rate, F.col(c) * (0.8 + 0.4 * uniform(seed + 1, "agent", F.lit(c)))).otherwise(F.col(c))
    return bounded_genes(agents.withColumns({name: change(name) for name, _ in GENES}))


def parameter_grid(spark: SparkSession, values: Mapping[str, Sequence[float]], replications: int = 1) -> DataFrame:
    """run and a column a parameter: the full factorial design."""
    rows = [(k, *map(float, v)) for k, v in enumerate(x for x in itertools.product(*values.values()) for _ in range(replications))]
    return spark.createDataFrame(rows, "run long, " + ", ".join(f"{n} double" for n in values))


def latin_hypercube(spark: SparkSession, n: int, bounds: Mapping[str, tuple[float, float]], *, seed: int = 0) -> DataFrame:
    """n rows whose every parameter has one value in each of n equal slices."""
    r = np.random.default_rng(seed)
    columns = [low + (r.permutation(n) + r.random(n)) / n * (high - low) for low, high in bounds.values()]
    return spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(zip(*columns))], "run long, " + ", ".join(f"{name} double" for name in bounds))


def explored(runs: DataFrame, model: Callable[[dict, np.random.Generator], np.ndarray], *, seed: int = 0) -> DataFrame:
    """Grid indicators of a NumPy model for every row of parameters: one task slice of runs, nothing shuffled. The outcome depends on the run alone."""
    schema = f"run long, {grid.MORPHOLOGY}, entropy double, slope double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                a = model(row, np.random.default_rng([seed, row["run"]]))
                on = a > 0
                built, free = grid.labels(on), grid.labels(~on)
                sizes = [np.unique(x[x >= 0], return_counts=True)[1] for x in (built, free)]
                p = a[a > 0] / a.sum() if a.sum() > 0 else np.array([1.0])
                v = np.sort(a[a > 0])[::-1]
                slope = float(np.polyfit(np.log(np.arange(1, len(v) + 1)), np.log(v), 1)[0]) if len(v) > 1 else 0.0
                out.append({
                    "run": row["run"], "height": a.shape[0], "width": a.shape[1], "area": float(a.sum()), "moran": grid._moran(a), "distance": grid._distance(a), "density": float(on.mean()), "components": len(sizes[0]),
                    "block_area": float(sizes[0].mean()) if len(sizes[0]) else 0.0, "component_area": float(sizes[1].mean()) if len(sizes[1]) else 0.0, "detour": grid._detour(on, 50), **grid.steps(on),
                    "entropy": float(-(p * np.log(p)).sum() / np.log(a.size)), "slope": slope,
                })
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return runs.mapInArrow(run, schema)


def calibration_error(measured: DataFrame, goals: Mapping[str, float]) -> DataFrame:
    """run, error: the summed squared relative differences from goals."""
    from ..functions.columns import rel_square

    terms = [rel_square(F.col(c), F.lit(float(v))) for c, v in goals.items()]
    return measured.select("run", sum(terms[1:], terms[0]).alias("error"))
