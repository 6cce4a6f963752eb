"""Point patterns and spatial fields: columns x, y and a value. Pair measures run in blocks (see pairs)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import distances, pair_rows


def _inverse(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(d == 0, 0.0, 1 / d)


def moran(points: DataFrame, value: str = "v") -> DataFrame:
    """Moran's I with weights 1/d, 0 at distance 0."""
    rows = points.where(~F.isnan(value)).select("x", "y", F.col(value).cast("double").alias("v"))
    n, mean = rows.agg(F.count("*"), F.avg("v")).first()

    def kernel(a: dict, b: dict) -> dict:
        w = _inverse(distances(a, b))
        za, zb = a["v"] - mean, b["v"] - mean
        return {"num": za @ w @ zb, "w": w.sum()}

    sums = pair_rows(rows, ["x", "y", "v"], kernel, "num double, w double").agg(F.sum("num").alias("num"), F.sum("w").alias("w"))
    variance = rows.agg(F.sum(F.pow(F.col("v") - F.lit(mean), F.lit(2.0))).alias("z2"))
    return sums.crossJoin(variance).select((n * F.col("num") / (F.col("w") * F.col("z2"))).alias("moran"))


def average_distance(points: DataFrame, value: str = "v") -> DataFrame:
    """Value-weighted mean distance over the largest distance."""

    def kernel(a: dict, b: dict) -> dict:
        d = distances(a, b)
        return {"s": a["v"] @ d @ b["v"], "far": d.max(initial=0.0)}

    rows = points.where(~F.isnan(value)).select("x", "y", F.col(value).cast("double").alias("v"))
    sums = pair_rows(rows, ["x", "y", "v"], kernel, "s double, far double").agg(F.sum("s").alias("s"), F.max("far").alias("far"))
    return sums.crossJoin(rows.agg(F.sum("v").alias("t"))).select((F.col("s") / (F.col("t") * F.col("t") * F.col("far"))).alias("average_distance"))


def ripley(points: DataFrame, radii: int = 50, area: float | None = None) -> DataFrame:
    """r, share, k, g: for radii r in units of the largest distance, the share of pairs within r (self pairs count), Ripley's K, and its increments."""
    rows = points.select("x", "y")
    n = rows.count()
    far = pair_rows(rows, ["x", "y"], lambda a, b: {"far": distances(a, b).max(initial=0.0)}, "far double").agg(F.max("far")).first()[0]
    size = area if area is not None else hull(points).select("area").first()[0]

    def kernel(a: dict, b: dict) -> dict:
        bins = np.clip(np.ceil(distances(a, b) / far * radii - 1e-12), 0, radii).astype(np.int64) if far else np.zeros((len(a["x"]), len(b["x"])), np.int64)
        return {"bin": np.arange(radii + 1), "n": np.bincount(bins.ravel(), minlength=radii + 1)}

    counts = pair_rows(rows, ["x", "y"], kernel, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.orderBy("bin")).cast("double")  # a row a radius
    k = counts.select((F.col("bin") / radii).alias("r"), (upto / (n * (n - 1))).alias("share")).withColumn("k", F.col("share") * size)
    return k.withColumn("g", F.col("k") - F.lag("k", 1, 0.0).over(Window.orderBy("r")))


def discrepancy(points: DataFrame) -> DataFrame:
    """Warnock's L2 star discrepancy of points in the unit square."""

    def kernel(a: dict, b: dict) -> dict:
        return {"s": ((1 - np.maximum(a["x"][:, None], b["x"])) * (1 - np.maximum(a["y"][:, None], b["y"]))).sum()}

    pairs = pair_rows(points, ["x", "y"], kernel, "s double").agg(F.sum("s").alias("s"))
    single = points.agg(F.count("*").alias("n"), F.sum((1 - F.pow("x", F.lit(2.0))) * (1 - F.pow("y", F.lit(2.0)))).alias("p"))
    value = F.lit(1 / 9) - F.col("p") / (2 * F.col("n")) + F.col("s") / (F.col("n") * F.col("n"))
    return pairs.crossJoin(single).select(F.sqrt(value).alias("discrepancy"))


def spatial_moment(points: DataFrame, p: int, q: int, value: str = "v") -> DataFrame:
    """Moment of order (p, q) about the mean point, coordinates over their ranges, values as weights."""
    box = points.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.max("x") - F.min("x")).alias("rx"), (F.max("y") - F.min("y")).alias("ry"), F.sum(value).alias("t"))
    term = F.pow((F.col("x") - F.col("cx")) / F.col("rx"), F.lit(float(p))) * F.pow((F.col("y") - F.col("cy")) / F.col("ry"), F.lit(float(q))) * F.col(value) / F.col("t")
    return points.crossJoin(F.broadcast(box)).agg(F.sum(term).alias("moment"))


def nearest(left: DataFrame, right: DataFrame, *, key: str = "id", cell: float | None = None) -> DataFrame:
    """For each left point (key, x, y) its nearest right point: key, nearest, distance; ties go to the smaller id.

    Right points are dealt to square cells of side ``cell`` (by default about one point a cell). Each left point searches rings of cells, doubling,
    until the best distance is inside the ring searched: a few equi-joins, no cross join.
    """
    box = right.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    wide = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not box[4] or wide[0] is None:
        return left.select(key, F.lit(None).cast(right.schema[key].dataType).alias("nearest"), F.lit(None).cast("double").alias("distance")).limit(0)
    cell = cell or max(np.sqrt(max((box[1] - box[0]) * (box[3] - box[2]), 1e-18) / box[4]), 1e-9)
    extent = max(max(box[1], wide[1]) - min(box[0], wide[0]), max(box[3], wide[3]) - min(box[2], wide[2]))
    tile = lambda d, side: d.withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)})
    todo, done, side = left.select(key, "x", "y"), None, cell
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:
        last = side >= extent
        seek = tile(todo, side).withColumn("o", F.explode(offsets)).select(key, "x", "y", (F.col("tx") + F.col("o.a")).alias("tx"), (F.col("ty") + F.col("o.b")).alias("ty"))
        found = seek.join(tile(right.select(F.col(key).alias("rid"), F.col("x").alias("x"), F.col("y").alias("y")), side).select("rid", F.col("x").alias("rx"), F.col("y").alias("ry"), "tx", "ty"), ["tx", "ty"])
        d = F.sqrt(F.pow(F.col("x") - F.col("rx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ry"), F.lit(2.0)))
        best = found.groupBy(key).agg(F.min(F.struct(d.alias("distance"), F.col("rid").alias("nearest"))).alias("m")).select(key, "m.nearest", "m.distance")
        sure = best if last else best.where(F.col("distance") <= side)
        done = sure if done is None else done.unionByName(sure)
        if last:
            return done
        from .runtime import cut

        sure_keys = cut(sure)
        done = sure_keys if done is sure else done
        todo = cut(todo.join(sure_keys.select(key), key, "left_anti"))
        if todo.isEmpty():
            return done
        side *= 4


def hull(points: DataFrame, by: str | None = None) -> DataFrame:
    """Convex hull of each group: ring (array of x, y), area, cx, cy. Every partition sends only its own hull."""
    schema = "g string, x double, y double"

    def local(batches):
        for batch in batches:
            g = np.array(batch.column(0).to_pylist(), dtype=object)
            xy = np.column_stack([batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)])
            for k in dict.fromkeys(g.tolist()):
                ring = _hull(xy[g == k])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(ring), pa.string()), pa.array(ring[:, 0]), pa.array(ring[:, 1])], names=["g", "x", "y"])

    def final(table: pa.Table) -> pa.Table:
        ring = _hull(np.column_stack([table["x"].to_numpy(), table["y"].to_numpy()]))
        a, cx, cy = _area_centroid(ring)
        return pa.table({"g": table["g"][:1], "ring": pa.array([[{"x": float(x), "y": float(y)} for x, y in ring]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), "area": [a], "cx": [cx], "cy": [cy]})

    rows = points.where("x IS NOT NULL AND y IS NOT NULL").select((F.col(by).cast("string") if by else F.lit("")).alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = rows.mapInArrow(local, schema).groupBy("g").applyInArrow(final, "g string, ring array<struct<x:double,y:double>>, area double, cx double, cy double")
    return found.withColumnRenamed("g", by) if by else found.drop("g")


def _hull(xy: np.ndarray) -> np.ndarray:
    points = sorted(map(tuple, np.unique(xy, axis=0)))
    if len(points) < 3:
        return np.array(points, float).reshape(-1, 2)

    def half(order: list) -> list:
        chain: list = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]), float)


def _area_centroid(ring: np.ndarray) -> tuple[float, float, float]:
    if len(ring) < 3:
        c = ring.mean(axis=0) if len(ring) else np.full(2, np.nan)
        return 0.0, float(c[0]), float(c[1])
    x, y = ring.T
    xn, yn = np.roll(x, -1), np.roll(y, -1)
    cross = x * yn - xn * y
    area = cross.sum() / 2
    return float(abs(area)), float(((x + xn) * cross).sum() / (6 * area)), float(((y + yn) * cross).sum() / (6 * area))


def summary(points: DataFrame, value: str = "v") -> DataFrame:
    """One row of a field's statistics: moments, entropy, Moran, average distance, hierarchy, spatial moments."""
    from . import stats

    parts = [stats.moments(points, value, orders=(1, 2, 3, 4)), stats.entropy(points, value), stats.rank_size(points, value), moran(points, value), average_distance(points, value)]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    for p, q in ((0, 1), (1, 0), (1, 1), (2, 0), (0, 2)):
        out = out.crossJoin(spatial_moment(points, p, q, value).withColumnRenamed("moment", f"moment_{p}{q}"))
    return out


def weighted_regression(points: DataFrame, x: str, y: str, bandwidth: float) -> DataFrame:
    """Geographically weighted regression of ``y`` on ``x``: slope and intercept at every point, Gaussian weights."""

    def kernel(a: dict, b: dict) -> dict:
        w = np.exp(-0.5 * (distances(a, b) / bandwidth) ** 2)
        xs, ys = b["vx"], b["vy"]
        return {"id": a["id"], "sw": w.sum(axis=1), "sx": w @ xs, "sy": w @ ys, "sxx": w @ (xs * xs), "sxy": w @ (xs * ys)}

    rows = points.select("id", "x", "y", F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy"))
    sums = pair_rows(rows, ["id", "x", "y", "vx", "vy"], kernel, "id long, sw double, sx double, sy double, sxx double, sxy double")
    sums = sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("sw", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return sums.select("id", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"))
