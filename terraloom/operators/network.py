"""Networks as two DataFrames: nodes (id, x, y) and links (src, dst, weight, length). Undirected unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import link_id, segments_cross, uniform
from .ranks import numbered
from .runtime import cut


@dataclass(frozen=True)
class Network:
    nodes: DataFrame
    links: DataFrame
    directed: bool = False

    def with_(self, **parts: object) -> Network:
        return replace(self, **parts)


def from_links(links: DataFrame, directed: bool = False) -> Network:
    """Nodes are the distinct ends; links (src, dst, weight, length) get canonical ends and lose repeats."""
    clean = canonical(links, directed)
    nodes = clean.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return Network(nodes, clean, directed)


def canonical(links: DataFrame, directed: bool = False) -> DataFrame:
    """No self-loops, no parallel links (the least weight stays), undirected ends in order."""
    rows = links.where("src <> dst")
    rows = rows if directed else rows.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    extra = [c for c in rows.columns if c not in ("src", "dst")]
    return rows.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in extra]) if extra else rows.distinct()


def empty(spark: SparkSession) -> Network:
    return Network(spark.createDataFrame([], "id long, x double, y double"), spark.createDataFrame([], "src long, dst long, weight double, length double"))


def arcs(net: Network, cost: str = "weight") -> DataFrame:
    """src, dst, cost in both directions for undirected networks."""
    own = net.links.select("src", "dst", F.col(cost).cast("double").alias("cost"))
    return own if net.directed else own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))


def union(a: Network, b: Network) -> Network:
    return Network(a.nodes.unionByName(b.nodes).distinct(), a.links.unionByName(b.links).distinct(), a.directed)


def consistent(net: Network) -> DataFrame:
    """Are node ids unique? One row."""
    return net.nodes.agg((F.count("*") == F.countDistinct("id")).alias("consistent"))


def reindexed(net: Network, start: int = 0) -> Network:
    """Ids start, start + 1, ... in the order of old ids."""
    names = numbered(net.nodes.select("id").distinct(), F.asc("id"), "new", start)
    nodes = net.nodes.join(names, "id").drop("id").withColumnRenamed("new", "id")
    ends = lambda c: names.select(F.col("id").alias(c), F.col("new").alias(f"n{c}"))
    links = net.links.join(ends("src"), "src").join(ends("dst"), "dst").drop("src", "dst").withColumnsRenamed({"nsrc": "src", "ndst": "dst"})
    return net.with_(nodes=nodes, links=links)


def subgraph(net: Network, ids: DataFrame, *, neighbours: bool = False) -> Network:
    """Links with both ends among the ids (or with any end, and the neighbours)."""
    own = ids.select("id").distinct()
    at = lambda c: own.withColumnRenamed("id", c)
    if neighbours:
        marked = net.links.join(at("src").withColumn("s", F.lit(1)), "src", "left").join(at("dst").withColumn("d", F.lit(1)), "dst", "left")
        links = marked.where("s = 1 OR d = 1").select(*net.links.columns)
        own = own.unionByName(links.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    else:
        links = net.links.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")
    return net.with_(nodes=net.nodes.join(own, "id", "left_semi"), links=links)


def remove_nodes(net: Network, ids: DataFrame) -> Network:
    gone = ids.select("id").distinct()
    links = net.links.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return net.with_(nodes=net.nodes.join(gone, "id", "left_anti"), links=links)


def remove_links(net: Network, gone: DataFrame, *, keep_nodes: bool = True) -> Network:
    links = net.links.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")
    nodes = net.nodes if keep_nodes else net.nodes.join(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    return net.with_(nodes=nodes, links=links)


def subgraph_links(net: Network, kept: DataFrame) -> Network:
    links = net.links.join(kept.select("src", "dst"), ["src", "dst"], "left_semi")
    return net.with_(nodes=net.nodes.join(links.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi"), links=links)


def add_links(net: Network, more: DataFrame, nodes: DataFrame | None = None) -> Network:
    out = net.with_(links=net.links.unionByName(more).distinct())
    return out if nodes is None else out.with_(nodes=net.nodes.unionByName(nodes).distinct())


def remove_random(net: Network, share: float, seed: int, *, what: str = "links") -> Network:
    """Remove each link (or node, with its links) with probability ``share``, by hash."""
    if what == "links":
        return remove_links(net, net.links.where(uniform(seed, "src", "dst") < share))
    return remove_nodes(net, net.nodes.where(uniform(seed, "id") < share))


def percolate(net: Network, probability: float, seed: int, where: Column | None = None) -> Network:
    """Links of weight 0 (that pass ``where``) get weight 1 with the probability."""
    opened = (F.col("weight") == 0) & (uniform(seed, "src", "dst") < probability)
    opened = opened if where is None else opened & where
    return net.with_(links=net.links.withColumn("weight", F.when(opened, 1.0).otherwise(F.col("weight"))))


# -- components and paths -------------------------------------------------------------------------------------------


def components(net: Network) -> DataFrame:
    """id, component (its smallest id) of every node, by alternating large-star and small-star until a round's checksum of the links stays the same."""
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = cut(net.links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = cut(joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return net.nodes.select("id").distinct().join(edges, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))


def largest_component(net: Network) -> Network:
    """Ties go to the smaller component id."""
    comp = cut(components(net))
    best = comp.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return subgraph(net, comp.join(best, "component", "left_semi"))


def cycle_count(net: Network) -> DataFrame:
    """Independent cycles: links - nodes + components."""
    comp = components(net).agg(F.countDistinct("component").alias("c"))
    return comp.crossJoin(net.nodes.agg(F.count("*").alias("n"))).crossJoin(net.links.agg(F.count("*").alias("m"))).select((F.col("m") - F.col("n") + F.col("c")).alias("cycles"))


def shortest_paths(net: Network, sources: DataFrame | None = None, *, cost: str = "weight", rounds: int = 10_000, paths: bool = False) -> DataFrame:
    """src, dst, dist (and path) from every source (all nodes if none are given) to every node it reaches, itself included (0).

    Only improved labels are sent on (a frontier), one aggregation a round, until none improves. Ties between paths go to the smaller path.
    """
    checked = F.when(F.col("cost") >= 0, F.col("cost")).otherwise(F.raise_error(F.lit("a link's cost must be a number of at least 0")).cast("double"))
    own = cut(arcs(net, cost).groupBy("src", "dst").agg(F.min("cost").alias("cost")).withColumn("cost", checked))
    start = (sources if sources is not None else net.nodes).select(F.col("id").alias("src")).distinct()
    best = cut(start.select("src", F.col("src").alias("dst"), F.struct(F.lit(0.0).alias("dist"), F.array("src").alias("path")).alias("label")))
    front = best
    for _ in range(rounds):
        step = front.select("src", F.col("dst").alias("at"), "label").join(own.select(F.col("src").alias("at"), F.col("dst").alias("to"), "cost"), "at")
        path = F.concat("label.path", F.array("to")) if paths else F.col("label.path")
        offered = step.groupBy("src", F.col("to").alias("dst")).agg(F.min(F.struct((F.col("label.dist") + F.col("cost")).alias("dist"), path.alias("path"))).alias("offer"))
        front = cut(offered.join(best, ["src", "dst"], "left").where(F.col("label").isNull() | (F.col("offer.dist") < F.col("label.dist"))).select("src", "dst", F.col("offer").alias("label")))
        if front.isEmpty():
            break
        best = cut(best.join(front.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(front))
    return best.select("src", "dst", F.col("label.dist").alias("dist"), *([F.col("label.path").alias("path")] if paths else []))


def min_plus(net: Network, *, cost: str = "weight") -> DataFrame:
    """All-pairs distances by min-plus squaring of the distance table: log2(n) rounds of one join. For small, dense networks."""
    nodes = net.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    d = cut(arcs(net, cost).withColumnRenamed("cost", "dist").unionByName(nodes).groupBy("src", "dst").agg(F.min("dist").alias("dist")))
    while True:
        two = d.alias("a").join(d.alias("b"), F.col("a.dst") == F.col("b.src")).groupBy("a.src", "b.dst").agg(F.min(F.col("a.dist") + F.col("b.dist")).alias("dist"))
        new = cut(two)
        changed = new.join(d.withColumnRenamed("dist", "old"), ["src", "dst"], "left").where("old IS NULL OR dist < old")
        if changed.isEmpty():
            return d
        d = new


def distances(net: Network, *, method: str = "frontier", cost: str = "weight") -> DataFrame:
    """All-pairs distances by a named method: ``frontier`` (labels sent on while they improve) or ``min_plus`` (squarings of the table)."""
    return {"frontier": shortest_paths, "min_plus": min_plus}[method](net, cost=cost).select("src", "dst", "dist")


def path_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Summed absolute difference of distances over common, reachable pairs."""
    x, y = a.select("src", "dst", F.col("dist").alias("da")), b.select("src", "dst", F.col("dist").alias("db"))
    return x.join(y, ["src", "dst"]).agg(F.sum(F.abs(F.col("da") - F.col("db"))).alias("difference"))


# -- measures -------------------------------------------------------------------------------------------------------


def degrees(net: Network) -> DataFrame:
    """id, degree; a self-loop counts twice."""
    return net.links.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def degree_distribution(net: Network) -> DataFrame:
    return degrees(net).groupBy("degree").agg(F.count("*").alias("n"))


def summary(net: Network) -> DataFrame:
    """nodes, links, gamma, total_length, components."""
    n, m = net.nodes.agg(F.count("*").alias("nodes")), net.links.agg(F.count("*").alias("links"), F.sum("length").alias("total_length"))
    comp = components(net).agg(F.countDistinct("component").alias("components"))
    return n.crossJoin(m).crossJoin(comp).select("nodes", "links", (F.col("links") / (F.col("nodes") * (F.col("nodes") - 1))).alias("gamma"), "total_length", "components")


def path_measures(net: Network, paths: DataFrame, *, finite_only: bool = False) -> DataFrame:
    """closeness, diameter, path_length, efficiency over pairs; unreachable pairs count as infinite unless ``finite_only``."""
    at = lambda c: net.nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    rows = paths.join(at("src"), "src").join(at("dst"), "dst")
    straight = F.sqrt(F.pow(F.col("srcx") - F.col("dstx"), F.lit(2.0)) + F.pow(F.col("srcy") - F.col("dsty"), F.lit(2.0)))
    parts = rows.agg(F.avg(F.when(F.col("dist") > 0, 1 / F.col("dist"))).alias("closeness"), F.max("dist").alias("diameter"), F.avg("dist").alias("path_length"), F.avg(F.when(F.col("dist") > 0, straight / F.col("dist"))).alias("efficiency"), F.count("*").alias("reached"))
    if finite_only:
        return parts.drop("reached")
    pairs = paths.agg(F.countDistinct("src").alias("s")).crossJoin(net.nodes.agg(F.countDistinct("id").alias("n")))
    cut_off = F.col("reached") < F.col("s") * F.col("n")
    far = lambda c: F.when(cut_off, F.lit(float("inf"))).otherwise(F.col(c)).alias(c)
    return parts.crossJoin(pairs).select("closeness", far("diameter"), far("path_length"), "efficiency")


def load_paths(net: Network, *, cost: str = "weight", demand: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """All-or-nothing assignment: src, dst, flow of every link. ``demand`` has (src, dst, flow); pairs without count 1."""
    found = shortest_paths(net, sources, cost=cost, paths=True).where("src <> dst")
    found = found.withColumn("flow", F.lit(1.0)) if demand is None else found.join(demand.select("src", "dst", F.col("flow").alias("f")), ["src", "dst"], "left").withColumn("flow", F.coalesce("f", F.lit(1.0)))
    hops = found.select(F.explode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("a"), F.expr("slice(path, 2, size(path) - 1)").alias("b"))).alias("h"), "flow")
    ends = hops.select(F.col("h.a").alias("a"), F.col("h.b").alias("b"), "flow")
    ends = ends if net.directed else ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "flow")
    flows = ends.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("flow").alias("flow"))
    return net.links.select("src", "dst").distinct().join(flows, ["src", "dst"], "left").select("src", "dst", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def betweenness(net: Network, *, cost: str = "weight") -> DataFrame:
    """Share of the shortest paths between distinct nodes that use each link."""
    flows = cut(load_paths(net, cost=cost))
    pairs = shortest_paths(net, cost=cost).where("src <> dst").agg(F.count("*").alias("pairs"))
    return flows.crossJoin(F.broadcast(pairs)).select("src", "dst", (F.col("flow") / F.col("pairs")).alias("betweenness"))


def equilibrium(net: Network, demand: DataFrame | None = None, *, cost: str = "weight", congested: Callable[[Column, Column], Column] | None = None, step: float = 0.5, epsilon: float = 0.05, rounds: int = 30) -> DataFrame:
    """Static user equilibrium by relaxation: src, dst, flow, cost once flows change by at most ``epsilon`` on average."""
    congested = congested or (lambda free, flow: free * (1 + flow))
    free = cut(net.links.select("src", "dst", F.col(cost).cast("double").alias("free")))
    state = cut(free.withColumns({"flow": F.lit(0.0), "cost": F.col("free")}))
    for _ in range(rounds):
        loaded = load_paths(net.with_(links=state.select("src", "dst", "cost")), cost="cost", demand=demand).withColumnRenamed("flow", "target")
        moved = state.join(loaded, ["src", "dst"]).withColumn("next", F.col("flow") + step * (F.col("target") - F.col("flow")))
        new = cut(moved.select("src", "dst", "free", F.col("next").alias("flow"), congested(F.col("free"), F.col("next")).alias("cost"), (F.abs(F.col("next") - F.col("flow")) / F.greatest(F.col("next"), F.lit(1e-9))).alias("change")))
        gap = new.where("flow > 0").agg(F.avg("change")).first()[0]
        state = new.drop("change")
        if gap is None or gap <= epsilon:
            break
    return state.select("src", "dst", "flow", "cost")


def crossings(net: Network, cell: float) -> DataFrame:
    """Pairs of links that cross, with the point; links meet in square cells of side ``cell`` that both touch, so no all-pairs join."""
    at = lambda c: net.nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    rows = net.links.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    tiles = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    rows = rows.withColumn("tx", F.explode(tiles("src_x", "dst_x"))).withColumn("ty", F.explode(tiles("src_y", "dst_y")))
    a, b = rows.alias("a"), rows.alias("b")
    ordered = link_id(F.col("a.src"), F.col("a.dst")) < link_id(F.col("b.src"), F.col("b.dst"))
    ends = lambda s: tuple(F.col(f"{s}.{c}") for c in ("src_x", "src_y", "dst_x", "dst_y"))
    meets, x, y = segments_cross(ends("a"), ends("b"))
    joined = a.join(b, (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty")) & ordered)
    return joined.where(meets).select(F.col("a.src").alias("src1"), F.col("a.dst").alias("dst1"), F.col("b.src").alias("src2"), F.col("b.dst").alias("dst2"), x.alias("x"), y.alias("y")).distinct()


def is_planar(net: Network, cell: float) -> bool:
    return crossings(net, cell).isEmpty()


def planarised(net: Network, cell: float) -> Network:
    """Every link split at its crossings; other links stay. New nodes get ids above the old."""
    found = cut(crossings(net, cell))
    top = net.nodes.agg(F.max("id")).first()[0] or 0
    points = cut(numbered(found.select("x", "y").distinct(), F.struct("x", "y").asc(), "id", top + 1).select(F.col("id").cast("long").alias("id"), "x", "y"))
    hits = found.select(F.explode(F.array(F.struct(F.col("src1").alias("src"), F.col("dst1").alias("dst")), F.struct(F.col("src2").alias("src"), F.col("dst2").alias("dst")))).alias("l"), "x", "y").select("l.*", "x", "y").join(points, ["x", "y"])
    nodes = net.nodes.select("id", "x", "y").unionByName(points)
    ends = net.links.select("src", "dst", F.explode(F.array("src", "dst")).alias("id")).join(nodes, "id")
    on = ends.select("src", "dst", "id", "x", "y").unionByName(hits.select("src", "dst", "id", "x", "y"))
    start = nodes.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    along = Window.partitionBy("src", "dst").orderBy(F.pow(F.col("x") - F.col("sx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("sy"), F.lit(2.0)), "id")
    parts = on.join(start, "src").withColumns({"to": F.lead("id").over(along), "tx": F.lead("x").over(along), "ty": F.lead("y").over(along)}).where("to IS NOT NULL")
    length = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ty"), F.lit(2.0)))
    weights = net.links.select("src", "dst", "weight")
    links = parts.withColumn("length", length).join(weights, ["src", "dst"]).select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"), "weight", "length")
    return net.with_(nodes=nodes, links=links)


def connected(net: Network, rounds: int = 64) -> Network:
    """Components joined until one is left: in each round every component links to its nearest node outside (Boruvka), distance as weight."""
    from .pairs import distances, pair_rows

    import numpy as np

    for _ in range(rounds):
        comp = cut(net.nodes.join(components(net), "id").select("id", "x", "y", F.col("component").alias("c")))
        if comp.select("c").distinct().count() <= 1:
            break

        def kernel(a: dict, b: dict) -> dict:
            d = np.where(a["c"][:, None] == b["c"][None, :], np.inf, distances(a, b))
            k = d.argmin(axis=1) if len(b["id"]) else np.zeros(0, int)
            best = d[np.arange(len(k)), k] if len(k) else np.zeros(0)
            good = np.isfinite(best)
            return {"id": a["id"][: len(k)][good], "c": a["c"][: len(k)][good], "dist": best[good], "other": b["id"][k][good] if len(k) else b["id"][:0]}

        offers = pair_rows(comp, ["id", "x", "y", "c"], kernel, "id long, c long, dist double, other long")
        best = offers.groupBy("c").agg(F.min(F.struct("dist", F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"))).alias("m")).select("m.*").distinct()
        new = best.select("src", "dst", F.col("dist").alias("weight"), F.col("dist").alias("length"))
        net = net.with_(links=cut(net.links.select("src", "dst", "weight", "length").unionByName(new).distinct()))
    return net


def simplified(net: Network) -> Network:
    """Chains of degree-2 nodes contracted: length summed, weight the length-weighted mean. Rings without a junction keep their smallest node."""
    degree = cut(degrees(net))
    two = degree.where("degree = 2").select("id")
    links = cut(net.links.select("src", "dst", "weight", "length").withColumn("k", F.monotonically_increasing_id()))
    ends = links.select("k", F.explode(F.array("src", "dst")).alias("id"))
    inner = ends.join(two, "id")
    shared = inner.groupBy("id").agg(F.min("k").alias("src"), F.max("k").alias("dst")).where("src <> dst").withColumn("weight", F.lit(1.0)).select("src", "dst", "weight")
    chains = cut(components(Network(links.select(F.col("k").alias("id")), shared)).withColumnsRenamed({"id": "k", "component": "chain"}))
    outer = ends.join(two, "id", "left_anti").join(chains, "k").groupBy("chain").agg(F.min("id").alias("src"), F.max("id").alias("dst"))
    rings = ends.join(chains, "k").groupBy("chain").agg(F.min("id").alias("ring"))
    sums = links.join(chains, "k").groupBy("chain").agg(F.sum("length").alias("length"), (F.sum(F.col("weight") * F.col("length")) / F.sum("length")).alias("weight"))
    made = sums.join(outer, "chain", "left").join(rings, "chain").select(F.coalesce("src", "ring").alias("src"), F.coalesce("dst", "ring").alias("dst"), "weight", "length")
    made = cut(made)
    nodes = net.nodes.join(made.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
    return net.with_(nodes=nodes, links=made)


def from_lines(lines: DataFrame, snap: float) -> Network:
    """Network of polylines (coords, weight) whose points are snapped to a grid of side ``snap``."""
    at = lambda p: F.struct((F.round(p["x"] / snap) * snap).alias("x"), (F.round(p["y"] / snap) * snap).alias("y"))
    parts = lines.select(F.transform("coords", at).alias("c"), "weight").select(F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("s"), "weight")
    parts = cut(parts.where("s.a <> s.b").select(F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b"), "weight").groupBy("a", "b").agg(F.min("weight").alias("weight")))
    nodes = cut(parts.select(F.explode(F.array("a", "b")).alias("p")).distinct().select(F.xxhash64("p.x", "p.y").alias("id"), "p.x", "p.y"))
    key = lambda c: F.xxhash64(f"{c}.x", f"{c}.y")
    length = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), F.lit(2.0)) + F.pow(F.col("a.y") - F.col("b.y"), F.lit(2.0)))
    return Network(nodes, parts.select(key("a").alias("src"), key("b").alias("dst"), "weight", length.alias("length")))


def rasterised(net: Network, resolution: float, width: float = 1.0) -> DataFrame:
    """grid_id, i, j, v: cells that links of a width cover, walking each link in steps of a cell."""
    at = lambda c: net.nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    rows = net.links.where("weight > 0").join(at("src"), "src").join(at("dst"), "dst")
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("dstx") - F.col("srcx"), F.lit(2.0)) + F.pow(F.col("dsty") - F.col("srcy"), F.lit(2.0))) / resolution)).cast("int")
    walked = rows.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    half = int(max(0, round((width / resolution - 1) / 2)))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-half, half + 1) for b in range(-half, half + 1)]))
    x, y = F.col("srcx") + (F.col("dstx") - F.col("srcx")) * F.col("k") / F.col("n"), F.col("srcy") + (F.col("dsty") - F.col("srcy")) * F.col("k") / F.col("n")
    on = walked.select(F.floor(x / resolution).cast("int").alias("i"), F.floor(y / resolution).cast("int").alias("j"), around.alias("o"))
    return on.select(F.lit(0).alias("grid_id"), (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), F.lit(1.0).alias("v")).distinct()


# -- stations, isolated nodes, coarse graining ---------------------------------------------------------------------


def nearest_links(points: DataFrame, net: Network, cell: float) -> DataFrame:
    """For each point (id, x, y) the nearest link within ``cell``: id, src, dst, px, py, distance; points without one are left out.

    Links are dealt to all cells that their bounds touch, points to the nine cells around them.
    """
    from ..functions.columns import project_on_segment

    at = lambda c: net.nodes.select(F.col("id").alias(c), F.col("x").alias(f"{c}_x"), F.col("y").alias(f"{c}_y"))
    tiles = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell))
    rows = net.links.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst").withColumn("tx", F.explode(tiles("src_x", "dst_x"))).withColumn("ty", F.explode(tiles("src_y", "dst_y")))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    seek = points.select("id", "x", "y", F.floor(F.col("x") / cell).alias("u"), F.floor(F.col("y") / cell).alias("w")).withColumn("o", around)
    seek = seek.select("id", "x", "y", (F.col("u") + F.col("o.a")).alias("tx"), (F.col("w") + F.col("o.b")).alias("ty"))
    px, py = project_on_segment(F.col("x"), F.col("y"), *[F.col(c) for c in ("src_x", "src_y", "dst_x", "dst_y")])
    near = seek.join(rows, ["tx", "ty"]).withColumns({"px": px, "py": py})
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2.0)) + F.pow(F.col("y") - F.col("py"), F.lit(2.0)))
    best = near.where(d <= cell).groupBy("id").agg(F.min(F.struct(d.alias("distance"), "src", "dst", "px", "py")).alias("m"))
    return best.select("id", "m.src", "m.dst", "m.px", "m.py", "m.distance")


def with_stations(net: Network, stations: DataFrame) -> DataFrame:
    """station, node, distance: the nearest node of every station (id, x, y)."""
    from .points import nearest

    return nearest(stations, net.nodes).withColumnsRenamed({"id": "station", "nearest": "node"})


def connect_isolated(net: Network, cell: float) -> Network:
    """Nodes without links are tied to their nearest link within ``cell``, which is split at their projections."""
    lonely = net.nodes.join(net.links.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")
    found = cut(nearest_links(lonely, net, cell))
    top = net.nodes.agg(F.max("id")).first()[0] or 0
    feet = cut(numbered(found.select("src", "dst", "px", "py").distinct(), F.struct("src", "dst", "px", "py").asc(), "foot", top + 1).select(F.col("foot").cast("long").alias("foot"), "src", "dst", "px", "py"))
    nodes = net.nodes.select("id", "x", "y").unionByName(feet.select(F.col("foot").alias("id"), F.col("px").alias("x"), F.col("py").alias("y")))
    ties = found.join(feet, ["src", "dst", "px", "py"]).select(F.col("id").alias("src"), F.col("foot").alias("dst"), F.lit(1.0).alias("weight"), F.col("distance").alias("length"))
    hit = feet.select("src", "dst").distinct()
    whole = net.links.join(hit, ["src", "dst"], "left_anti").select("src", "dst", "weight", "length")
    at = nodes.select("id", "x", "y")
    on = net.links.join(hit, ["src", "dst"], "left_semi").select("src", "dst", "weight", F.explode(F.array("src", "dst")).alias("id")).unionByName(feet.join(net.links.select("src", "dst", "weight"), ["src", "dst"]).select("src", "dst", "weight", F.col("foot").alias("id"))).join(at, "id")
    start = at.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    along = Window.partitionBy("src", "dst").orderBy(F.pow(F.col("x") - F.col("sx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("sy"), F.lit(2.0)), "id")
    parts = on.join(start, "src").withColumns({"to": F.lead("id").over(along), "tx": F.lead("x").over(along), "ty": F.lead("y").over(along)}).where("to IS NOT NULL")
    length = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ty"), F.lit(2.0)))
    pieces = parts.select(F.least("id", "to").alias("src"), F.greatest("id", "to").alias("dst"), "weight", length.alias("length"))
    return net.with_(nodes=nodes, links=whole.unionByName(pieces).unionByName(ties))


def coarse_grained(net: Network, polygons: DataFrame, cell: float, *, cost: str = "length") -> Network:
    """One node a polygon (its mean node), links between polygons that a link joins; the cost is the least path between their nearest nodes to the mean."""
    from .spatial import points_in_polygons

    inside = cut(points_in_polygons(net.nodes, polygons, cell).withColumnsRenamed({"point": "id", "polygon": "p"}))
    mean = inside.join(net.nodes, "id").groupBy("p").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    gap = F.pow(F.col("nx") - F.col("x"), F.lit(2.0)) + F.pow(F.col("ny") - F.col("y"), F.lit(2.0))
    own = net.nodes.select("id", F.col("x").alias("nx"), F.col("y").alias("ny")).join(inside, "id").join(mean, "p")
    centre = cut(own.groupBy("p").agg(F.min(F.struct(gap.alias("g"), "id")).alias("m")).select("p", F.col("m.id").alias("id")))
    side = lambda c: inside.select(F.col("id").alias(c), F.col("p").alias(f"{c}_p"))
    joined = net.links.join(side("src"), "src").join(side("dst"), "dst").where("src_p <> dst_p").select(F.least("src_p", "dst_p").alias("a"), F.greatest("src_p", "dst_p").alias("b")).distinct()
    paths = shortest_paths(net, centre.select("id"), cost=cost)
    ends = lambda p, c: centre.select(F.col("p").alias(p), F.col("id").alias(c))
    links = joined.join(ends("a", "src"), "a").join(ends("b", "dst"), "b").join(paths, ["src", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight"), F.col("dist").alias("length"))
    return Network(mean.withColumnRenamed("p", "id"), links)
