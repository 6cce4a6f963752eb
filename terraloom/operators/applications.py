"""Pipelines put together from the operators: flow models from files, areas' networks and populations, rail scenarios, micro models, calibration."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import exp_cost, uniform
from ..sources.tables import read_binary, read_coordinates, read_matrix, write_binary
from . import generators, interaction, network, simulation, spatial
from . import grid as grids
from .network import Network
from .ranks import numbered


#: So many boxes of areas are broadcast; more are joined.
_AREAS = 10_000


class MacroModel(Protocol):
    """A model of a system of cities: new populations (city, pop) and distances (i, j, d) after a step; ``urban.run_multi`` couples several."""

    def __call__(self, pops: DataFrame, distances: DataFrame, dt: float) -> tuple[DataFrame, DataFrame]: ...


# -- flow models ---------------------------------------------------------------------------------------------------


def thresholded(spark: SparkSession, path: str, to: str, *, decay: float = 60.0, least: float = 0.3, sep: str = ",") -> None:
    """A matrix file of distances as a binary table (i, j, v) of the cells where exp(-v / decay) is above ``least``."""
    rows = read_matrix(spark, path, sep=sep).where(~F.isnan("v"))
    write_binary(rows.where(exp_cost(F.col("v"), decay) > least), to)


def selected(spark: SparkSession, path: str, keep: DataFrame) -> DataFrame:
    """i, j, v of a binary matrix with the kept rows and columns (id) only, numbered anew in the order of ids."""
    names = numbered(keep.select("id").distinct(), F.asc("id"), "new")
    rows = read_binary(spark, path)
    ends = lambda c: names.select(F.col("id").alias(c), F.col("new").alias(f"new_{c}"))
    return rows.join(ends("i"), "i").join(ends("j"), "j").select(F.col("new_i").alias("i"), F.col("new_j").alias("j"), "v")


def multimode(spark: SparkSession, flows: Mapping[str, str], distances: Mapping[str, str], *, sep: str = ",") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (mode, o, d, dist, observed) from sparse files of each mode, and the masses (o, mass), (d, mass): sums of the flows over modes."""

    def stacked(files: Mapping[str, str], value: str) -> DataFrame:
        out = None
        for mode, path in files.items():
            own = read_coordinates(spark, path, sep=sep).select(F.lit(mode).alias("mode"), F.col("i").alias("o"), F.col("j").alias("d"), F.col("v").alias(value))
            out = own if out is None else out.unionByName(own)
        return out

    seen = stacked(flows, "observed")
    pairs = stacked(distances, "dist").join(seen, ["mode", "o", "d"], "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return pairs, seen.groupBy("o").agg(F.sum("observed").alias("mass")), seen.groupBy("d").agg(F.sum("observed").alias("mass"))


def calibrated(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, *, start: float = 1.0, threshold: float = 0.01, rounds: int = 50) -> DataFrame:
    """mode, decay: the decay of each mode at which modelled and observed mean trip lengths agree."""
    fitted = interaction.fit_decay(pairs, origins, destinations, start=start, threshold=threshold, rounds=rounds, by_mode="mode" in pairs.columns)
    return pairs.sparkSession.createDataFrame([(str(m), float(v)) for m, v in fitted.items()], "mode string, decay double")


def calibrated_classes(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, by: str, **options: float) -> DataFrame:
    """``by``, mode, decay: a calibration for each class of travellers; classes are a few names."""
    out = None
    for name in [r[0] for r in origins.select(by).distinct().orderBy(by).collect()]:
        own = calibrated(*(x.where(F.col(by) == name).drop(by) for x in (pairs, origins, destinations)), **options).select(F.lit(name).alias(by), "mode", "decay")
        out = own if out is None else out.unionByName(own)
    return out


def gravity_jobs(individuals: DataFrame, pairs: DataFrame, origins: DataFrame, destinations: DataFrame, decay: float, *, seed: int = 0) -> DataFrame:
    """individual_id, o, d: workplaces drawn by the flows of a gravity model with a fitted decay, from (o, d, dist) and masses."""
    flows = interaction.singly_constrained(pairs.withColumn("w", exp_cost(F.col("dist"), decay)), origins, destinations)
    return spatial.assigned_jobs(individuals, flows, seed=seed)


# -- areas ---------------------------------------------------------------------------------------------------------


def area_network(lines: DataFrame, area: DataFrame, snap: float) -> Network:
    """The largest component of the network of the lines (coords) that have a point in the area (id, ring)."""
    rows = lines.withColumn("_line", F.monotonically_increasing_id())
    points = rows.select(F.posexplode("coords").alias("k", "p"), "_line").select(F.struct("_line", "k").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    inside = spatial.points_in_polygons(points, area, max(snap, 1e-9) * 1000).select(F.col("point._line").alias("_line")).distinct()
    return network.largest_component(network.from_lines(rows.join(inside, "_line", "left_semi").drop("_line"), snap))


def jittered(points: DataFrame, radius: float, *, seed: int = 0) -> DataFrame:
    """Points moved by up to ``radius`` along each axis, by their ids."""
    move = lambda c: (F.col(c) + (2 * uniform(seed, "id", F.lit(c)) - 1) * radius).alias(c)
    return points.select(*[move(c) if c in ("x", "y") else F.col(c) for c in points.columns])


def population(households: DataFrame, individuals: DataFrame, flows: DataFrame, *, share: float = 1.0, seed: int = 0) -> DataFrame:
    """Sampled individuals at home, with a workplace by flows from their zone ``o`` and a commuting plan."""
    _, kept = spatial.sampled_households(households, individuals, share, seed=seed)
    placed = spatial.located(kept, households)
    jobs = spatial.assigned_jobs(placed.select("individual_id", "o"), flows, seed=seed).select("individual_id", "d")
    return spatial.commute_plans(placed.join(jobs, "individual_id"), seed=seed)


def sampled_morphology(layer: DataFrame, buildings: DataFrame, n: int, side: float, cells: int, *, seed: int = 0) -> DataFrame:
    """The indicators of the buildings' rasters in n windows of a layer, one row a window."""
    return grids.morphology(spatial.sampled_grids(layer, buildings, n, side, cells, seed=seed))


def area_indicators(raster: DataFrame, areas: DataFrame) -> DataFrame:
    """The indicators of a raster (i, j, v) cropped to each area (area, i0, i1, j0, j1), one row an area; the ends are left out."""
    inside = (F.col("i") >= F.col("i0")) & (F.col("i") < F.col("i1")) & (F.col("j") >= F.col("j0")) & (F.col("j") < F.col("j1"))
    few = areas.limit(_AREAS + 1).count() <= _AREAS
    rows = raster.select("i", "j", "v").join(F.broadcast(areas) if few else areas, inside)
    cropped = rows.select(F.col("area").alias("grid_id"), "i", "j", "v")
    return grids.density(cropped).join(grids.entropy(cropped), "grid_id").join(grids.mean_distance(cropped), "grid_id").withColumnRenamed("grid_id", "area")


# -- rail and micro models -----------------------------------------------------------------------------------------


def rail_network(lines: DataFrame, stations: DataFrame, snap: float, reach: float) -> tuple[Network, DataFrame]:
    """A rail network and (station, node): each station (id, x, y) at its nearest node within ``reach``."""
    net = network.from_lines(lines, snap)
    return net, network.with_stations(net, stations).where(F.col("distance") <= reach).select("station", "node")


def station_distances(net: Network, at: DataFrame, extra: DataFrame | None = None, *, cost: str = "length") -> DataFrame:
    """a, b, dist between stations (station, node) along a network; ``extra`` links are a scenario."""
    net = net if extra is None else network.add_links(net, extra)
    paths = network.shortest_paths(net, at.select(F.col("node").alias("id")).distinct(), cost=cost)
    ends = lambda c, name: at.select(F.col("node").alias(c), F.col("station").alias(name))
    return paths.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").select("a", "b", "dist")


def micro_network(spark: SparkSession, world: float, patch: float, centers: int, speed: float, *, seed: int = 0) -> tuple[Network, DataFrame]:
    """Streets on a square lattice, with a transit tree between random centres tied to their nearest crossings; links' weight is travel time. And the centres."""
    streets = generators.grid_network(spark, int(world // patch), patch)
    places = generators.random_points(spark, centers, 0.0, world, 0.0, world, seed=seed)
    tied = network.with_stations(streets, places).select("station", "node")
    ends = lambda c, name: tied.select(F.col("station").alias(c), F.col("node").alias(name))
    tree = generators.tree_network(places).links.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").where("a <> b")
    transit = network.canonical(tree.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("length") / speed).alias("weight"), "length"))
    links = streets.links.withColumn("weight", F.col("length")).join(transit.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(transit)
    return streets.with_(links=links), tied


def patches(spark: SparkSession, world: float, patch: float) -> DataFrame:
    """id, ring of a square world's patches."""
    n = int(world // patch)
    return generators.grid_polygons(spark, 0.0, n * patch, 0.0, n * patch, n, n)


def footprints(centroids: DataFrame, side: float) -> DataFrame:
    """id, ring of square buildings around centroids (id, x, y)."""
    corner = lambda a, b: F.struct((F.col("x") + a * side / 2).alias("x"), (F.col("y") + b * side / 2).alias("y"))
    return centroids.select("id", F.array(*[corner(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]).alias("ring"))


def developers(spark: SparkSession, n: int, world: float, capital: float, *, seed: int = 0) -> DataFrame:
    """id, x, y, capital of developer agents at random places."""
    return generators.random_points(spark, n, 0.0, world, 0.0, world, seed=seed).withColumn("capital", F.lit(float(capital)))


# -- calibration ---------------------------------------------------------------------------------------------------


def generator_errors(runs: DataFrame, model: Callable[[dict, np.random.Generator], np.ndarray], goals: Mapping[str, float], by: Sequence[str], *, seed: int = 0) -> DataFrame:
    """The parameters ``by`` and the mean error of their replications against goals."""
    errors = simulation.calibration_error(simulation.explored(runs, model, seed=seed), goals)
    return errors.join(runs, "run").groupBy(*by).agg(F.avg("error").alias("error"))


def perturbed(grid: DataFrame, change: Column) -> DataFrame:
    """A grid with its values replaced by an expression of its columns."""
    return grid.withColumn("v", change)
