"""Seeded generators of grids, points, networks and samples. Draws are hashes of seed and key: no result depends on partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from . import grid as grids
from .network import Network, components, connected, percolate, rasterised, subgraph
from .ranks import running
from .runtime import cut


def blank(spark: SparkSession, height: int, width: int, samples: int = 1) -> DataFrame:
    """grid_id, i, j of full grids."""
    if height <= 0 or width <= 0:
        raise ValueError("a grid needs a positive size")
    k = F.col("id")
    return spark.range(samples * height * width).select(F.floor(k / (height * width)).cast("int").alias("grid_id"), (F.floor(k / width) % height).cast("int").alias("i"), (k % width).cast("int").alias("j"))


def scaled(df: DataFrame, total: float) -> DataFrame:
    """Values rescaled to a total a grid."""
    sums = df.groupBy("grid_id").agg(F.sum("v").alias("s"))
    return df.join(sums, "grid_id").withColumn("v", F.when(F.col("s") > 0, F.col("v") / F.col("s") * total).otherwise(F.col("v"))).drop("s")


def random_grid(spark: SparkSession, height: int, width: int, *, occupied: float | None = None, total: float | None = None, samples: int = 1, seed: int = 0) -> DataFrame:
    """Uniform values, or 0/1 with the share ``occupied``."""
    v = uniform(seed, "grid_id", "i", "j")
    out = blank(spark, height, width, samples).withColumn("v", v if occupied is None else F.when(v < occupied, 1.0).otherwise(0.0))
    return out if total is None else scaled(out, total)


def mixture_grid(spark: SparkSession, height: int, width: int, centers: int | Sequence[tuple[float, float]], radius: float, top: float = 1.0, *, samples: int = 1, seed: int = 0) -> DataFrame:
    """Sum of exponential kernels around centres: the centres are an array, so each cell is one row and nothing is joined."""
    cells = blank(spark, height, width, samples)
    if isinstance(centers, int):
        at = F.transform(F.sequence(F.lit(1), F.lit(centers)), lambda k: F.struct((uniform(seed, F.col("grid_id"), k, F.lit("i")) * height).alias("a"), (uniform(seed, F.col("grid_id"), k, F.lit("j")) * width).alias("b")))
    else:
        at = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in centers])
    kernel = lambda s, c: s + top * F.exp(-F.sqrt(F.pow(F.col("i") - c["a"], F.lit(2.0)) + F.pow(F.col("j") - c["b"], F.lit(2.0))) / radius)
    return cells.withColumn("v", F.aggregate(at, F.lit(0.0), kernel))


def blocks_grid(spark: SparkSession, height: int, width: int, blocks: int, least: int, most: int, *, samples: int = 1, seed: int = 0) -> DataFrame:
    """Random rectangles, clipped to the grid; values count the blocks on a cell."""
    draw = lambda name, n: F.floor(uniform(seed, "grid_id", "block", F.lit(name)) * n).cast("int")
    made = spark.range(samples * blocks).select(F.floor(F.col("id") / blocks).cast("int").alias("grid_id"), (F.col("id") % blocks).cast("int").alias("block"))
    made = made.select("grid_id", draw("i", height).alias("i0"), draw("j", width).alias("j0"), (draw("h", most - least + 1) + least).alias("h"), (draw("w", most - least + 1) + least).alias("w"))
    on = made.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), F.col("i0") - F.floor(F.col("h") / 2).cast("int")), F.least(F.lit(height - 1), F.col("i0") - F.floor(F.col("h") / 2).cast("int") + F.col("h") - 1))))
    on = on.withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), F.col("j0") - F.floor(F.col("w") / 2).cast("int")), F.least(F.lit(width - 1), F.col("j0") - F.floor(F.col("w") / 2).cast("int") + F.col("w") - 1))))
    counts = on.groupBy("grid_id", "i", "j").agg(F.count("*").cast("double").alias("v"))
    return blank(spark, height, width, samples).join(counts, ["grid_id", "i", "j"], "left").select("grid_id", "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def _per_sample(spark: SparkSession, samples: int, make: object) -> DataFrame:
    """Grids that grow step by step: one task a sample, NumPy inside."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        a = make(g)
        i, j = np.indices(a.shape)
        return pa.table({"grid_id": np.full(a.size, g, np.int32), "i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": a.ravel().astype(float)})

    return spark.range(samples).select(F.col("id").cast("int").alias("grid_id")).groupBy("grid_id").applyInArrow(run, "grid_id int, i int, j int, v double")


def _diffused(a: np.ndarray, share: float) -> np.ndarray:
    p = np.pad(a, 1)
    around = sum(p[1 + x : p.shape[0] - 1 + x, 1 + y : p.shape[1] - 1 + y] for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0))
    return a * (1 - share) + around * share / 8


def reaction_diffusion_grid(spark: SparkSession, size: int, growth: float, total: float, alpha: float, beta: float, rounds: int = 1, *, samples: int = 1, seed: int = 0) -> DataFrame:
    """Preferential attachment (share^alpha) of ``growth`` people a step, then ``rounds`` diffusions of share ``beta``, until ``total``."""

    def make(g: int) -> np.ndarray:
        r = np.random.default_rng([seed, g])
        a = np.zeros(size * size)
        while a.sum() < total:
            weight = (a / a.sum()) ** alpha if a.sum() > 0 else np.ones_like(a)
            a += r.multinomial(int(growth), weight / weight.sum())
            b = a.reshape(size, size)
            for _ in range(rounds):
                b = _diffused(b, beta)
            a = b.ravel()
        return a.reshape(size, size)

    return _per_sample(spark, samples, make)


def gravity_grid(spark: SparkSession, size: int, growth: float, gravity: float, hierarchy: float, centers: int, total: int, *, samples: int = 1, seed: int = 0) -> DataFrame:
    """Cells fill with probability by the gravity field of the people present, until ``total`` cells are set."""

    def make(g: int) -> np.ndarray:
        r = np.random.default_rng([seed, g])
        a = np.zeros((size, size))
        a.flat[r.choice(size * size, centers, replace=False)] = 1
        di = np.minimum(np.arange(2 * size), 2 * size - np.arange(2 * size))
        d = np.hypot(di[:, None], di[None, :])
        kernel = np.where(d == 0, 0.0, np.maximum(d, 1.0) ** -gravity)
        while a.sum() < min(total, size * size):
            field = np.fft.irfft2(np.fft.rfft2(a**hierarchy, (2 * size, 2 * size)) * np.fft.rfft2(kernel), (2 * size, 2 * size))[:size, :size]
            p = np.maximum(field, 0) * (a == 0)
            n = int(min(max(1, growth * a.sum()), min(total, size * size) - a.sum(), (p > 0).sum()))
            a.flat[r.choice(size * size, n, replace=False, p=p.ravel() / p.sum())] = 1
        return a

    return _per_sample(spark, samples, make)


def correlated_grid(spark: SparkSession, size: int, correlation: float, occupied: float, gradient: float = 0.0, *, samples: int = 1, seed: int = 0) -> DataFrame:
    """Correlated percolation: a Gaussian field with exponential spectrum, cut at each cell's quantile of the density mask."""

    def make(g: int) -> np.ndarray:
        r = np.random.default_rng([seed, g])
        k = np.hypot(np.fft.fftfreq(size)[:, None], np.fft.fftfreq(size)[None, :]) * 2 * np.pi
        spectrum = (1 + (k * correlation) ** 2) ** -1.5
        field = np.real(np.fft.ifft2(np.fft.fft2(r.standard_normal((size, size))) * np.sqrt(spectrum)))
        rank = field.ravel().argsort().argsort().reshape(size, size) / field.size  # the field's distribution function
        c = np.hypot(*(np.indices((size, size)) - (size - 1) / 2))
        mask = np.minimum(1.0, occupied * np.exp(-gradient * c / size) / np.exp(-gradient * c / size).mean())
        return (rank < mask).astype(float)

    return _per_sample(spark, samples, make)


def percolation_grid(spark: SparkSession, size: int, probability: float, step: int = 5, *, border: int = 5, seed: int = 0) -> DataFrame:
    net = percolated(grid_network(spark, size // step, step), probability, border=border, size=size, seed=seed)
    on = rasterised(net, 1.0)
    return blank(spark, size + 1, size + 1).join(on, ["grid_id", "i", "j"], "left").select("grid_id", "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def launched(spark: SparkSession, name: str, size: int, *, threshold: float = 0.5, limit: float = 0.8, seed: int = 0, **options: object) -> DataFrame:
    """A binary grid by generator name (random, mixture, blocks, percolation); empty if its density passes ``limit``."""
    made = {
        "random": lambda: random_grid(spark, size, size, occupied=options.get("occupied", 0.3), seed=seed),
        "mixture": lambda: mixture_grid(spark, size, size, options.get("centers", 5), options.get("radius", 3.0), seed=seed),
        "blocks": lambda: blocks_grid(spark, size, size, options.get("blocks", 5), options.get("least", 5), options.get("most", 10), seed=seed),
        "percolation": lambda: percolation_grid(spark, size, options.get("probability", 0.3), seed=seed),
    }[name]()
    top = made.groupBy("grid_id").agg(F.max("v").alias("top"))
    binary = made.join(top, "grid_id").withColumn("v", F.when((F.col("top") > 0) & (F.col("v") / F.col("top") > (threshold if name == "mixture" else 0.0)), 1.0).otherwise(0.0)).drop("top")
    dense = grids.density(binary)
    return binary.join(dense, "grid_id").withColumn("v", F.when(F.col("density") > limit, 0.0).otherwise(F.col("v"))).drop("density")


# -- points --------------------------------------------------------------------------------------------------------


def random_points(spark: SparkSession, n: int, xmin: float = 0.0, xmax: float = 1.0, ymin: float = 0.0, ymax: float = 1.0, *, seed: int = 0) -> DataFrame:
    k = F.col("id")
    return spark.range(n).select("id", (xmin + uniform(seed, k, F.lit("x")) * (xmax - xmin)).alias("x"), (ymin + uniform(seed, k, F.lit("y")) * (ymax - ymin)).alias("y"))


def poisson_points(spark: SparkSession, intensity: float, xmin: float = 0.0, xmax: float = 1.0, ymin: float = 0.0, ymax: float = 1.0, *, seed: int = 0) -> DataFrame:
    """Homogeneous Poisson process."""
    n = int(np.random.default_rng(seed).poisson(intensity * (xmax - xmin) * (ymax - ymin)))
    return random_points(spark, n, xmin, xmax, ymin, ymax, seed=seed)


def poisson_count(mean: Column, u: Column, most: int = 200) -> Column:
    """A Poisson draw from one uniform number, by inversion; means are small (a cell's)."""
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), (s["n"] + (u >= s["c"]).cast("int")).alias("n"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda s: s["n"])


def field_points(grid: DataFrame, *, side: float = 1.0, seed: int = 0) -> DataFrame:
    """Heterogeneous Poisson process: each cell (i, j, v) holds a Poisson number of points with mean v * area, uniform in the cell."""
    counted = grid.select("i", "j", poisson_count(F.col("v") * side * side, uniform(seed, "i", "j")).alias("n")).where("n > 0")
    rows = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select(F.xxhash64("i", "j", "k").alias("id"), ((F.col("i") + uniform(seed, "i", "j", "k", F.lit("x"))) * side).alias("x"), ((F.col("j") + uniform(seed, "i", "j", "k", F.lit("y"))) * side).alias("y"))


def density_points(grid: DataFrame, n: int, xmin: float, xmax: float, ymin: float, ymax: float, *, seed: int = 0) -> DataFrame:
    """n points with cell probabilities v, jittered inside their cells, in the given box."""
    shape = grid.agg(F.max("i") + 1, F.max("j") + 1).first()
    drawn = sample_with_replacement(grid.withColumn("key", F.struct("i", "j")), n, "key", "v", seed=seed)
    x = xmin + (F.col("key.i") + uniform(seed, "draw", F.lit("x"))) * (xmax - xmin) / shape[0]
    y = ymin + (F.col("key.j") + uniform(seed, "draw", F.lit("y"))) * (ymax - ymin) / shape[1]
    return drawn.select(F.col("draw").alias("id"), x.alias("x"), y.alias("y"))


def grid_polygons(spark: SparkSession, xmin: float, xmax: float, ymin: float, ymax: float, xres: int, yres: int) -> DataFrame:
    """id, ring of a regular grid of polygons."""
    dx, dy, k = (xmax - xmin) / xres, (ymax - ymin) / yres, F.col("id")
    x0, y0 = xmin + F.floor(k / yres) * dx, ymin + (k % yres) * dy
    corner = lambda a, b: F.struct((x0 + a).alias("x"), (y0 + b).alias("y"))
    return spark.range(xres * yres).select("id", F.array(corner(0, 0), corner(dx, 0), corner(dx, dy), corner(0, dy), corner(0, 0)).alias("ring"))


def triangle_points(polygons: DataFrame, n: int, *, seed: int = 0) -> DataFrame:
    """n uniform points in convex polygons (id, ring), chosen by area: fan triangles, cumulated areas, barycentric draws."""
    fan = polygons.select("id", F.explode(F.sequence(F.lit(2), F.size("ring") - 1)).alias("k"), "ring")
    p = lambda e: F.get("ring", e)
    tri = fan.select("id", "k", p(F.lit(0)).alias("a"), p(F.col("k") - 1).alias("b"), p(F.col("k")).alias("c"))
    area = F.abs((F.col("b.x") - F.col("a.x")) * (F.col("c.y") - F.col("a.y")) - (F.col("c.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))) / 2
    drawn = sample_with_replacement(tri.withColumns({"w": area, "key": F.struct("id", "k", "a", "b", "c")}), n, "key", "w", seed=seed)
    r, s = F.sqrt(uniform(seed, "draw", F.lit("r"))), uniform(seed, "draw", F.lit("s"))
    put = lambda v: (1 - r) * F.col(f"key.a.{v}") + r * (1 - s) * F.col(f"key.b.{v}") + r * s * F.col(f"key.c.{v}")
    return drawn.select(F.col("draw").alias("id"), F.col("key.id").alias("polygon"), put("x").alias("x"), put("y").alias("y"))


# -- samples -------------------------------------------------------------------------------------------------------


def sample_with_replacement(df: DataFrame, n: int, key: str, weight: str | None = None, *, seed: int = 0) -> DataFrame:
    """draw, key: n draws with probabilities by weight. Keys are unique.

    Running sums by ranges make the distribution function; it is cut into n slots of equal weight, a key stands in the slots that its
    span touches (n + keys rows in all), and each draw meets only the keys of its slot.
    """
    rows = df.select(F.col(key).alias("key"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("w > 0")
    spans = running(rows, (), F.asc("key"), ["w"]).select("key", (F.col("w_upto") - F.col("w")).alias("low"), F.col("w_upto").alias("high"), F.col("w_total").alias("total"))
    slot = lambda c: F.least(F.floor(F.col(c) / F.col("total") * n), F.lit(n - 1))
    spans = cut(spans)
    total = spans.agg(F.max("total").alias("total"))
    cells = spans.withColumn("slot", F.explode(F.sequence(slot("low"), slot("high"))))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(seed, "id").alias("u")).crossJoin(F.broadcast(total))  # one row
    draws = draws.select("draw", (F.col("u") * F.col("total")).alias("u"), F.least(F.floor(F.col("u") * n), F.lit(n - 1)).alias("slot"))
    near = draws.withColumn("slot", F.explode(F.array("slot", F.col("slot") - 1, F.col("slot") + 1)))  # rounding may move an edge by one slot
    hit = near.join(cells.select("slot", "key", "low", "high"), "slot").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return hit.groupBy("draw").agg(F.min("key").alias("key"))


def sample_without_replacement(df: DataFrame, n: int, keys: Sequence[str], weight: str | None = None, *, seed: int = 0) -> DataFrame:
    """n rows, by weight if given (exponential races), else uniform: a top-n, no full sort."""
    u = -F.ln(1 - uniform(seed, *keys))
    return df.orderBy(u / F.col(weight) if weight else u, *keys).limit(n) if weight is None else df.where(F.col(weight) > 0).orderBy(u / F.col(weight), *keys).limit(n)


def shuffled(df: DataFrame, keys: Sequence[str], *, seed: int = 0) -> DataFrame:
    return df.orderBy(uniform(seed, *keys), *keys)


def normal(mu: float, sigma: float, seed: int, *keys: Column | str) -> Column:
    """A normal draw from two hashes (Box-Muller)."""
    a, b = uniform(seed, *keys), uniform(seed + 1, *keys)
    return mu + sigma * F.sqrt(-2 * F.ln(1 - a)) * F.cos(2 * math.pi * b)


def log_normal(mu: float, sigma: float, seed: int, *keys: Column | str) -> Column:
    return F.exp(normal(mu, sigma, seed, *keys))


def log_normal_parameters(mean: float, std: float) -> tuple[float, float]:
    """mu and sigma of a log-normal with a mean and a standard deviation."""
    s2 = math.log(1 + (std / mean) ** 2)
    return math.log(mean) - s2 / 2, math.sqrt(s2)


def rank_size_values(spark: SparkSession, n: int, alpha: float, top: float) -> DataFrame:
    k = F.col("id") + 1
    return spark.range(n).select(k.alias("rank"), (top * F.pow(k.cast("double"), F.lit(-alpha))).alias("v"))


# -- networks ------------------------------------------------------------------------------------------------------


def grid_network(spark: SparkSession, cells: int, step: float, *, diagonals: bool = False) -> Network:
    """A square lattice of (cells + 1)^2 nodes."""
    side, k = cells + 1, F.col("id")
    nodes = spark.range(side * side).select("id", (F.floor(k / side) * step).alias("x"), ((k % side) * step).alias("y"))
    ways = [(1, 0), (0, 1)] + [(1, 1), (1, -1)] * diagonals
    to = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ways]))
    links = nodes.select("id", F.floor(k / side).alias("r"), (k % side).alias("c"), to.alias("o"))
    links = links.where((F.col("r") + F.col("o.a")).between(0, cells) & (F.col("c") + F.col("o.b")).between(0, cells))
    far = (F.col("r") + F.col("o.a")) * side + F.col("c") + F.col("o.b")
    length = F.sqrt((F.col("o.a") * F.col("o.a") + F.col("o.b") * F.col("o.b")).cast("double")) * step
    return Network(nodes, links.select(F.least("id", far).alias("src"), F.greatest("id", far).alias("dst"), F.lit(1.0).alias("weight"), length.alias("length")))


def percolated(net: Network, probability: float, *, border: int, size: float, rounds: int = 100, seed: int = 0) -> Network:
    """Bond percolation: links open with the probability, round by round, until the largest open component touches the border ``border`` times."""
    top = net.nodes.agg(F.max("x"), F.max("y")).first()
    edge = net.nodes.where((F.col("x") <= 0) | (F.col("y") <= 0) | (F.col("x") >= top[0]) | (F.col("y") >= top[1])).select("id")
    both = net.links.join(edge.withColumnRenamed("id", "src"), "src", "left_semi").join(edge.withColumnRenamed("id", "dst"), "dst", "left_semi")
    current = net.with_(links=cut(net.links.join(both.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("weight", F.lit(0.0))))
    for k in range(rounds):
        current = current.with_(links=cut(percolate(current, probability, seed + k).links))
        opened = current.with_(links=current.links.where("weight > 0"))
        comp = cut(components(opened))
        best = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
        giant = cut(comp.join(best, "component", "left_semi").select("id"))
        if giant.join(edge, "id").count() >= border:
            return subgraph(opened, giant)
    return opened


def random_network(spark: SparkSession, n: int, links: int, *, seed: int = 0) -> Network:
    """n random points and about ``links`` random links, without self-loops and repeats."""
    nodes = random_points(spark, n, seed=seed)
    if n < 2 or links < 1:
        return Network(nodes, spark.createDataFrame([], "src long, dst long, weight double, length double"))
    drawn = spark.range(links).select(F.floor(uniform(seed, "id", F.lit("a")) * n).alias("a"), F.floor(uniform(seed, "id", F.lit("b")) * n).alias("b")).where("a <> b")
    ends = drawn.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return Network(nodes, measured(nodes, ends))


def measured(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    length = F.sqrt(F.pow(F.col("srcx") - F.col("dstx"), F.lit(2.0)) + F.pow(F.col("srcy") - F.col("dsty"), F.lit(2.0)))
    return ends.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", F.lit(1.0).alias("weight"), length.alias("length"))


def tree_network(nodes: DataFrame) -> Network:
    """The Euclidean minimum spanning tree of points."""
    none = nodes.sparkSession.createDataFrame([], "src long, dst long, weight double, length double")
    return connected(Network(nodes.select("id", "x", "y"), none))


def local_links(net: Network, links: int, radius: float, *, seed: int = 0) -> Network:
    """Up to ``links`` further links between nodes within ``radius``, found in cells of that side."""
    tiled = net.nodes.select("id", "x", "y", F.floor(F.col("x") / radius).alias("tx"), F.floor(F.col("y") / radius).alias("ty"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    seek = tiled.withColumn("o", around).select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("tx") + F.col("o.a")).alias("tx"), (F.col("ty") + F.col("o.b")).alias("ty"))
    near = seek.join(tiled.withColumnRenamed("id", "dst"), ["tx", "ty"]).where("src < dst")
    d = F.sqrt(F.pow(F.col("ax") - F.col("x"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("y"), F.lit(2.0)))
    ends = near.where(d <= radius).join(net.links.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst")
    more = measured(net.nodes, sample_without_replacement(ends, links, ["src", "dst"], seed=seed))
    return net.with_(links=net.links.select("src", "dst", "weight", "length").unionByName(more))


def cross_network(spark: SparkSession) -> Network:
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 0.0), (3, 0.0, -1.0), (4, -1.0, 0.0)], "id long, x double, y double")
    return Network(nodes, spark.createDataFrame([(0, k, 1.0, 1.0) for k in range(1, 5)], "src long, dst long, weight double, length double"))
