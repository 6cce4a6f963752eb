"""Spatial joins by tiles, polygon operations, and OSM objects as tables. Points (id, x, y); polygons (id, ring, bounds)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_ring, ring_area


def with_bounds(polygons: DataFrame) -> DataFrame:
    """Adds xmin, ymin, xmax, ymax, area of a ring column."""
    side = lambda v: F.transform("ring", lambda p: p[v])
    return polygons.withColumns({"xmin": F.array_min(side("x")), "ymin": F.array_min(side("y")), "xmax": F.array_max(side("x")), "ymax": F.array_max(side("y")), "area": ring_area(F.col("ring"))})


def envelope(polygons: DataFrame) -> DataFrame:
    return with_bounds(polygons).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def _tiled(polygons: DataFrame, cell: float) -> DataFrame:
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    return polygons.withColumn("tx", F.explode(span("xmin", "xmax"))).withColumn("ty", F.explode(span("ymin", "ymax")))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """point, polygon of every point inside a polygon: an equi-join on tiles, then ray casting. A point inside several gives several rows."""
    p = points.select(F.col("id").alias("point"), "x", "y", F.floor(F.col("x") / cell).alias("tx"), F.floor(F.col("y") / cell).alias("ty"))
    q = _tiled(with_bounds(polygons.select(F.col("id").alias("polygon"), "ring")), cell)
    near = (F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax"))
    return p.join(q, ["tx", "ty"]).where(near).where(in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("point", "polygon")


def boxes_overlapping(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """a, b of polygons whose bounds overlap; each pair is found once, in the tile of its overlap's corner."""
    a, b = _tiled(with_bounds(left.select("id", "ring")), cell).alias("a"), _tiled(with_bounds(right.select("id", "ring")), cell).alias("b")
    overlap = (F.col("a.xmin") <= F.col("b.xmax")) & (F.col("b.xmin") <= F.col("a.xmax")) & (F.col("a.ymin") <= F.col("b.ymax")) & (F.col("b.ymin") <= F.col("a.ymax"))
    corner = (F.col("a.tx") == F.floor(F.greatest("a.xmin", "b.xmin") / cell)) & (F.col("a.ty") == F.floor(F.greatest("a.ymin", "b.ymin") / cell))
    return a.join(b, (F.col("a.tx") == F.col("b.tx")) & (F.col("a.ty") == F.col("b.ty")) & overlap & corner).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def within_radius(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """a, b, distance of points within ``radius``: cells of that side, the nine around each left point."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    p = left.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.floor(F.col("x") / radius).alias("u"), F.floor(F.col("y") / radius).alias("w")).withColumn("o", around)
    p = p.select("a", "ax", "ay", (F.col("u") + F.col("o.a")).alias("tx"), (F.col("w") + F.col("o.b")).alias("ty"))
    q = right.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / radius).alias("tx"), F.floor(F.col("y") / radius).alias("ty"))
    d = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0)))
    return p.join(q, ["tx", "ty"]).select("a", "b", d.alias("distance")).where(F.col("distance") <= radius)


def _clipped(ring: list[tuple[float, float]], bounds: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """Sutherland-Hodgman: the ring cut by each side of the box in turn."""
    xmin, ymin, xmax, ymax = bounds
    for axis, bound, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        kept = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                kept.append(p)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = kept
    return ring


def clipped(polygons: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """id, ring of rings cut to a box, in Arrow batches; empty outside."""
    kind = polygons.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = []
            for ring in batch.column(1).to_pylist():
                points = [(p["x"], p["y"]) for p in ring]
                points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
                rings.append([{"x": x, "y": y} for x, y in _clipped(points, (xmin, ymin, xmax, ymax))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], names=["id", "ring"])

    return polygons.select("id", "ring").mapInArrow(run, f"id {kind}, ring array<struct<x:double,y:double>>")


def polygons_in_box(polygons: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """id, ring, area of the parts of polygons inside a box; bounds prune first."""
    near = with_bounds(polygons).where((F.col("xmax") > xmin) & (F.col("xmin") < xmax) & (F.col("ymax") > ymin) & (F.col("ymin") < ymax))
    return clipped(near.select("id", "ring"), xmin, ymin, xmax, ymax).where(F.size("ring") > 2).withColumn("area", ring_area(F.col("ring")))


def _areas(batches: Iterator[pa.RecordBatch], side: float, x0: float, y0: float) -> Iterator[pa.RecordBatch]:
    """Key columns ending in i and j, and ``area``: each ring (the last column) cut to its cell."""
    for batch in batches:
        i, j, rings = (c.to_pylist() for c in batch.columns[-3:])
        areas = []
        for a, b, ring in zip(i, j, rings):
            points = [(p["x"], p["y"]) for p in ring]
            points = points[:-1] if len(points) > 1 and points[0] == points[-1] else points
            part = _clipped(points, (x0 + a * side, y0 + b * side, x0 + (a + 1) * side, y0 + (b + 1) * side))
            areas.append(abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(part, part[1:] + part[:1]))) / 2)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(areas, pa.float64())], names=[*batch.schema.names[:-1], "area"])


def covered_cells(polygons: DataFrame, x0: float, y0: float, side: float, height: int, width: int, *, least: float = 0.0) -> DataFrame:
    """grid_id, i, j, v, share of a raster of polygons: v is 1 where they cover more than ``least`` of a cell, i along x.

    Each polygon meets only the cells that its bounds touch, and is cut to each. Shares of polygons that overlap add up.
    """
    at = lambda c, low, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - low) / side).cast("int")))
    near = with_bounds(polygons.select("ring")).where((F.col("xmax") > x0) & (F.col("ymax") > y0) & (F.col("xmin") < x0 + height * side) & (F.col("ymin") < y0 + width * side))
    cells = near.withColumn("i", F.explode(F.sequence(at("xmin", x0, height), at("xmax", x0, height)))).withColumn("j", F.explode(F.sequence(at("ymin", y0, width), at("ymax", y0, width))))

    shares = cells.select("i", "j", "ring").mapInArrow(lambda b: _areas(b, side, x0, y0), "i int, j int, area double").groupBy("i", "j").agg((F.sum("area") / (side * side)).alias("share"))
    k = F.col("id")
    blank = polygons.sparkSession.range(height * width).select(F.lit(0).alias("grid_id"), F.floor(k / width).cast("int").alias("i"), (k % width).cast("int").alias("j"))
    share = F.coalesce("share", F.lit(0.0))
    return blank.join(shares, ["i", "j"], "left").select("grid_id", "i", "j", F.when(share > least, 1.0).otherwise(0.0).alias("v"), share.alias("share"))


def inside_mask(polygons: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The polygons whose bounds lie strictly inside a box."""
    inside = (F.col("xmin") > xmin) & (F.col("ymin") > ymin) & (F.col("xmax") < xmax) & (F.col("ymax") < ymax)
    return with_bounds(polygons).where(inside).select(*polygons.columns)


def sampled_windows(layer: DataFrame, n: int, side: float, *, seed: int = 0) -> DataFrame:
    """id, x, y, ring of n square windows whose centres lie in the layer's convex polygons (id, ring), uniform by area."""
    from .generators import triangle_points

    corner = lambda a, b: F.struct((F.col("x") + a * side / 2).alias("x"), (F.col("y") + b * side / 2).alias("y"))
    return triangle_points(layer, n, seed=seed).select("id", "x", "y", F.array(*[corner(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]).alias("ring"))


def sampled_grids(layer: DataFrame, polygons: DataFrame, n: int, side: float, cells: int, *, least: float = 0.0, seed: int = 0) -> DataFrame:
    """grid_id, i, j, v: rasters of the polygons in n windows of the layer, ``cells`` cells a side.

    All windows are one set of boxes: each polygon meets the windows that its bounds overlap, then their cells.
    """
    windows = sampled_windows(layer, n, side, seed=seed)
    met = boxes_overlapping(windows.select("id", "ring"), polygons.select("id", "ring"), side)
    step = side / cells
    low = windows.select(F.col("id").alias("a"), (F.col("x") - side / 2).alias("wx"), (F.col("y") - side / 2).alias("wy"))
    moved = met.join(low, "a").join(polygons.select(F.col("id").alias("b"), "ring"), "b")
    moved = moved.select("a", F.transform("ring", lambda p: F.struct(((p["x"] - F.col("wx")) / step).alias("x"), ((p["y"] - F.col("wy")) / step).alias("y"))).alias("ring"))
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(F.col(c)).cast("int")))
    rows = with_bounds(moved).withColumn("i", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("j", F.explode(F.sequence(at("ymin"), at("ymax"))))

    shares = rows.select(F.col("a").alias("grid_id"), "i", "j", "ring").mapInArrow(lambda b: _areas(b, 1.0, 0.0, 0.0), "grid_id long, i int, j int, area double").groupBy("grid_id", "i", "j").agg(F.sum("area").alias("share"))
    k = F.col("id")
    blank = layer.sparkSession.range(n * cells * cells).select(F.floor(k / (cells * cells)).alias("grid_id"), (F.floor(k / cells) % cells).cast("int").alias("i"), (k % cells).cast("int").alias("j"))
    return blank.join(shares, ["grid_id", "i", "j"], "left").select("grid_id", "i", "j", F.when(F.coalesce("share", F.lit(0.0)) > least, 1.0).otherwise(0.0).alias("v"))


# -- OSM tables ----------------------------------------------------------------------------------------------------


def tagged(df: DataFrame, wanted: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Rows whose tags have all keys, with one of the values where values are given."""
    for key, values in wanted.items():
        value = F.element_at("tags", key)
        df = df.where(value.isNotNull() if values is None else value.isin(*values))
    return df


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, tags, coords of ways with their node references resolved in order; missing nodes are left out."""
    parts = ways.select("id", F.posexplode("node_refs").alias("k", "ref"))
    found = parts.join(nodes.select(F.col("id").alias("ref"), F.col("lon").alias("x"), F.col("lat").alias("y")), "ref").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("coords"))
    return ways.join(found, "id").select("id", "tags", "coords")


def is_polygon(ways: DataFrame) -> Column:
    return (F.size("node_refs") > 3) & (F.element_at("node_refs", 1) == F.element_at("node_refs", -1))


def way_polygons(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    return way_lines(ways.where(is_polygon(ways)), nodes).withColumnRenamed("coords", "ring")


def buildings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    return way_polygons(tagged(ways, {"building": None}), nodes)


def changed(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Objects after a change file (id, version, change, ...): the newest version of each id wins, deletions go."""
    rows = base.withColumn("change", F.lit("base")).unionByName(changes, allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "id"]
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("o"))
    return newest.select("id", "o.*").where("change <> 'delete'").drop("change")


# -- synthetic population ------------------------------------------------------------------------------------------


def located(individuals: DataFrame, households: DataFrame) -> DataFrame:
    """Individuals with their household's place; those without a household go."""
    return individuals.join(households.select("household_id", "x", "y"), "household_id")


def sampled_households(households: DataFrame, individuals: DataFrame, share: float, *, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    from ..functions.columns import uniform

    kept = individuals.where(uniform(seed, "individual_id") < share)
    return households.join(kept, "household_id", "left_semi"), kept


def commute_plans(individuals: DataFrame, *, seed: int = 0) -> DataFrame:
    """Home, work, home with uniform departure times, as nested plans."""
    from ..functions.columns import uniform

    act = lambda kind, end: F.struct(F.lit(kind).alias("type"), F.col("x").alias("x"), F.col("y").alias("y"), end.alias("end"))
    away, back = 7 + 2 * uniform(seed, "individual_id", F.lit("a")), 16 + 2 * uniform(seed, "individual_id", F.lit("b"))
    actions = F.array(act("home", away), act("work", back), act("home", F.lit(24.0)))
    return individuals.withColumn("plan", F.struct(actions.alias("actions"), F.array(F.lit("car"), F.lit("car")).alias("legs")))


def assigned_jobs(individuals: DataFrame, flows: DataFrame, *, seed: int = 0) -> DataFrame:
    """individual_id, o, d: a workplace by the empirical flow shares of the home zone (o, d, flow), by cumulative shares."""
    from pyspark.sql import Window

    from ..functions.columns import uniform

    upto = Window.partitionBy("o").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cdf = flows.groupBy("o", "d").agg(F.sum("flow").alias("f")).withColumns({"high": F.sum("f").over(upto), "total": F.sum("f").over(Window.partitionBy("o"))})
    arrays = cdf.groupBy("o").agg(F.sort_array(F.collect_list(F.struct((F.col("high") / F.col("total")).alias("p"), "d"))).alias("cdf"))
    u = uniform(seed, "individual_id")
    return individuals.join(arrays, "o").select("individual_id", "o", F.get(F.filter("cdf", lambda s: s["p"] > u), F.lit(0))["d"].alias("d"))
