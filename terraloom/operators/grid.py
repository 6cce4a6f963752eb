"""Grids in long form: grid_id, i, j, v. Measures, neighbourhood operators and convolutions, for many grids in one job.

Cell-wise and neighbourhood operators are relational and split a single large grid over all tasks. Measures that need all pairs of cells
(Moran, mean distance, flows) are convolutions: a grid is one group of ``applyInArrow`` and costs n log n by FFT, so there a grid must fit
a task's memory (about 100 bytes a cell). The ``..._of_large`` forms spread one grid over many tasks.
NaN counts as 0 in the convolutions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats

CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def cells(df: DataFrame) -> DataFrame:
    """The grid with a grid_id (0 if it has none)."""
    out = df if "grid_id" in df.columns else df.withColumn("grid_id", F.lit(0))
    return out.select("grid_id", "i", "j", F.col("v").cast("double").alias("v"))


def as_points(df: DataFrame) -> DataFrame:
    """Cells as a field at cell centres."""
    return cells(df).select("grid_id", (F.col("i") + 0.5).alias("x"), (F.col("j") + 0.5).alias("y"), "v")


def to_text(df: DataFrame) -> DataFrame:
    """grid_id, text: a line a row, ``+`` for positive cells and ``0`` for others."""
    lines = cells(df).groupBy("grid_id", "i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", F.when(F.col("v") > 0, "+").otherwise("0").alias("c")))), lambda s: s["c"]), "").alias("line"))
    return lines.groupBy("grid_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n").alias("text"))


def crop(df: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """Cells of rows i0 to i1 and columns j0 to j1, inclusive."""
    return df.where(F.col("i").between(i0, i1) & F.col("j").between(j0, j1))


def density(df: DataFrame) -> DataFrame:
    return cells(df).groupBy("grid_id").agg(F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("density"))


def entropy(df: DataFrame) -> DataFrame:
    return stats.entropy(cells(df), "v", ["grid_id"])


def slope(df: DataFrame) -> DataFrame:
    return stats.rank_size(cells(df), "v", ["grid_id"])


def fractal_dimension(df: DataFrame, sides: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """Box-counting dimension: slope of ln(occupied boxes) on ln(1 / side)."""
    boxes = cells(df).where("v > 0").withColumn("k", F.explode(F.array(*map(F.lit, sides))))
    counts = boxes.select("grid_id", "k", F.floor(F.col("i") / F.col("k")).alias("a"), F.floor(F.col("j") / F.col("k")).alias("b")).distinct().groupBy("grid_id", "k").agg(F.count("*").alias("n"))
    return counts.groupBy("grid_id").agg(F.regr_slope(F.ln("n"), F.ln(1.0 / F.col("k"))).alias("dimension"), F.regr_r2(F.ln("n"), F.ln(1.0 / F.col("k"))).alias("r2"))


def acentrism(df: DataFrame, quantiles: int = 20) -> DataFrame:
    """Area between the diagonal and the curve of relative mean distance by share of cells kept, from the largest values down.

    For each k the cells holding the k/quantiles largest values give a mean distance; its ratio to that of all cells, against k/quantiles.
    """

    def curve(a: np.ndarray) -> dict[str, float]:
        order = np.sort(a.ravel())[::-1]
        whole, area, before = _distance(a, False), 0.0, 0.0
        for k in range(1, quantiles + 1):
            cut = order[max(0, int(np.ceil(len(order) * k / quantiles)) - 1)]
            ratio = _distance(np.where(a >= cut, a, 0.0), False) / whole if whole else 0.0
            area += (before + ratio) / 2 / quantiles
            before = ratio
        return {"acentrism": area}

    return per_grid(df, curve, "acentrism double")


# -- neighbourhoods ------------------------------------------------------------------------------------------------


def convolve(df: DataFrame, kernel: Sequence[tuple[int, int, float]]) -> DataFrame:
    """Zero-padded convolution of the same size with a small kernel of (di, dj, weight): each cell sends its share to its neighbours, partial sums first."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(w)).alias("w")) for a, b, w in kernel])
    sent = cells(df).withColumn("o", F.explode(offsets)).select("grid_id", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("v") * F.col("o.w")).alias("s"), ((F.col("o.a") == 0) & (F.col("o.b") == 0)).cast("int").alias("own"))
    if not any(a == b == 0 for a, b, _ in kernel):
        sent = sent.unionByName(cells(df).select("grid_id", "i", "j", F.lit(0.0).alias("s"), F.lit(1).alias("own")))
    return sent.groupBy("grid_id", "i", "j").agg(F.sum("s").alias("v"), F.max("own").alias("own")).where("own = 1").drop("own")


def convolve_1d(df: DataFrame, kernel: Sequence[tuple[int, float]]) -> DataFrame:
    """The same along i, for one-column grids (i, v)."""
    flat = df.withColumn("j", F.lit(0))
    return convolve(flat, [(k, 0, w) for k, w in kernel]).drop("j")


def dilation(df: DataFrame) -> DataFrame:
    """1 where a cell of the cross-shaped neighbourhood is positive."""
    out = convolve(cells(df).withColumn("v", F.when(F.col("v") > 0, 1.0).otherwise(0.0)), [(a, b, 1.0) for a, b in CROSS])
    return out.withColumn("v", F.when(F.col("v") > 0, 1.0).otherwise(0.0))


def erosion(df: DataFrame) -> DataFrame:
    """1 where all five cells of the cross are positive; cells outside the grid count as 0."""
    out = convolve(cells(df).withColumn("v", F.when(F.col("v") > 0, 1.0).otherwise(0.0)), [(a, b, 1.0) for a, b in CROSS])
    return out.withColumn("v", F.when(F.col("v") == 5, 1.0).otherwise(0.0))


def diffuse(df: DataFrame, share: float) -> DataFrame:
    """Every cell gives ``share`` of its value to its eight neighbours, all at once; what leaves the grid is lost."""
    ring = [(a, b, share / 8) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    return convolve(df, [(0, 0, 1 - share), *ring])


def to_links(df: DataFrame) -> DataFrame:
    """Links between positive cells that touch up, down, left or right: grid_id, src and dst as (i, j)."""
    on = cells(df).where("v > 0").select("grid_id", "i", "j")
    further = on.withColumn("o", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))))
    ends = further.select("grid_id", F.struct("i", "j").alias("src"), (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"))
    return ends.join(on, ["grid_id", "i", "j"]).select("grid_id", "src", F.struct("i", "j").alias("dst"))


# -- kernels of a whole grid ---------------------------------------------------------------------------------------


def per_grid(df: DataFrame, fn: Callable[[np.ndarray], dict[str, float]], schema: str) -> DataFrame:
    """``fn`` of every grid as a dense array (missing cells 0, NaN 0): one row a grid."""
    rows = cells(df)
    kind = rows.schema["grid_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"grid_id": table["grid_id"][:1]} | {k: [x] for k, x in fn(dense(table)).items()})

    return rows.groupBy("grid_id").applyInArrow(run, f"grid_id {kind}, {schema}")


def dense(table: pa.Table) -> np.ndarray:
    i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
    i, j = i - i.min(), j - j.min()
    out = np.zeros((int(i.max()) + 1, int(j.max()) + 1))
    out[i, j] = np.nan_to_num(v.astype(float))
    return out


def _fft_sum(a: np.ndarray, b: np.ndarray, weight: Callable[[np.ndarray], np.ndarray]) -> float:
    """Sum over ordered pairs of cells of a_p * b_q * weight(distance): one circular convolution of the padded grid."""
    n, m = a.shape
    shape = (2 * n, 2 * m)
    di, dj = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)), np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m))
    w = weight(np.hypot(di[:, None], dj[None, :]))
    spread = np.fft.irfft2(np.fft.rfft2(b, shape) * np.fft.rfft2(w, shape), shape)[:n, :m]
    return float((a * spread).sum())


def _inverse(d: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(d == 0, 0.0, 1 / d)


def _moran(a: np.ndarray) -> float:
    z = a - a.mean()
    one = np.ones_like(a)
    total = (z * z).sum()
    return float(a.size * _fft_sum(z, z, _inverse) / (_fft_sum(one, one, _inverse) * total)) if total > 0 and a.size > 1 else float("nan")


def _distance(a: np.ndarray, normalise: bool = True) -> float:
    total = a.sum()
    if total == 0:
        return 0.0
    mean = _fft_sum(a, a, lambda d: d) / total**2
    return mean * np.sqrt(np.pi / a.size) if normalise else mean


#: Columns of a grid's transform that one task takes together.
_COLUMNS = 64
_SPECTRUM = "grid_id long, part int, i int, re binary, im binary"


def _spectrum(rows: DataFrame, width: int, value: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """grid_id, part, i, re, im: each row (grid_id, i, ...) transformed to length ``width``, in parts of columns."""

    def run(table: pa.Table) -> pa.Table:
        f = np.fft.rfft(value(table), width)
        cuts = [f[k : k + _COLUMNS] for k in range(0, len(f), _COLUMNS)]
        n = len(cuts)
        return pa.table({
            "grid_id": [table["grid_id"][0].as_py()] * n, "part": pa.array(range(n), pa.int32()), "i": pa.array([table["i"][0].as_py()] * n, pa.int32()),
            "re": pa.array([c.real.tobytes() for c in cuts], pa.binary()), "im": pa.array([c.imag.tobytes() for c in cuts], pa.binary()),
        })

    return rows.groupBy("grid_id", "i").applyInArrow(run, _SPECTRUM)


def pair_sums(df: DataFrame, sums: Mapping[str, tuple[str, str, Callable[[np.ndarray], np.ndarray]]]) -> DataFrame:
    """grid_id and, for each name, the sum over ordered pairs of cells of a_p b_q weight(distance), for (a, b, weight) with columns a and b.

    One grid is spread over many tasks: a Fourier transform of its rows, a shuffle, one of its columns; products of the transforms add up to the sums (Parseval), and
    the weights' transform is made in the same two steps. No task holds more than a row or ``_COLUMNS`` columns of a grid. All grids here have one shape.
    """
    names = sorted({c for a, b, _ in sums.values() for c in (a, b)})
    rows = df.select(F.col("grid_id").cast("long").alias("grid_id"), "i", "j", *[F.col(c).cast("double").alias(c) for c in names])
    low = rows.agg(F.min("i").alias("i"), F.max("i").alias("n"), F.min("j").alias("j"), F.max("j").alias("m")).first()
    n, m = low.n - low.i + 1, low.m - low.j + 1

    def line(c: str) -> Callable[[pa.Table], np.ndarray]:
        def value(table: pa.Table) -> np.ndarray:
            out = np.zeros(m)
            out[table["j"].to_numpy() - low.j] = np.nan_to_num(table[c].to_numpy())
            return out

        return value

    def weights(weight: Callable[[np.ndarray], np.ndarray]) -> Callable[[pa.Table], np.ndarray]:
        def value(table: pa.Table) -> np.ndarray:
            i = table["i"][0].as_py()
            j = np.minimum(np.arange(2 * m), 2 * m - np.arange(2 * m))
            return weight(np.hypot(min(i, 2 * n - i), j))

        return value

    shifted = rows.withColumn("i", F.col("i") - low.i)
    parts = None
    for c in names:
        own = _spectrum(shifted.select("grid_id", "i", "j", c), 2 * m, line(c)).withColumn("what", F.lit(c))
        parts = own if parts is None else parts.unionByName(own)
    lattice = df.sparkSession.range(2 * n).select(F.lit(0).cast("long").alias("grid_id"), F.col("id").cast("int").alias("i"))
    kernels = None
    for name, (_, _, weight) in sums.items():
        own = _spectrum(lattice, 2 * m, weights(weight)).withColumn("what", F.lit(name))
        kernels = own if kernels is None else kernels.unionByName(own)

    def columns(table: pa.Table, what: str) -> np.ndarray:
        own = table.filter(pc.equal(table["what"], what))
        read = lambda c: np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in own[c]])
        full = np.zeros((2 * n, len(own["re"][0].as_py()) // 8), complex)
        full[own["i"].to_numpy()] = read("re") + 1j * read("im")
        return np.fft.fft(full, axis=0)

    def add(cells_: pa.Table, kernel: pa.Table) -> pa.Table:
        if not cells_.num_rows:
            return pa.table({"grid_id": pa.array([], pa.int64()), **{name: pa.array([], pa.float64()) for name in sums}})
        spectra, part = {c: columns(cells_, c) for c in names}, cells_["part"][0].as_py()
        at = part * _COLUMNS + np.arange(len(next(iter(spectra.values()))[0]))
        twice = np.where((at == 0) | (at == m), 1.0, 2.0)  # the half of the spectrum that is left out mirrors the other
        found = {name: [float(((np.conj(spectra[a]) * spectra[b] * columns(kernel, name)).real * twice).sum() / (4 * n * m))] for name, (a, b, _) in sums.items()}
        return pa.table({"grid_id": cells_["grid_id"][:1], **found})

    ids = shifted.select("grid_id").distinct()
    every = kernels.drop("grid_id").crossJoin(ids)  # a copy of the weights' transform for each grid
    schema = "grid_id long, " + ", ".join(f"{name} double" for name in sums)
    found = parts.groupBy("grid_id", "part").cogroup(every.groupBy("grid_id", "part")).applyInArrow(add, schema)
    return found.groupBy("grid_id").agg(*[F.sum(name).alias(name) for name in sums])


def moran(df: DataFrame) -> DataFrame:
    """Moran's I with weights 1/d, of grids that fit a task each; :func:`moran_of_large` is for larger ones."""
    return per_grid(df, lambda a: {"moran": _moran(a)}, "moran double")


def moran_of_large(df: DataFrame) -> DataFrame:
    """Moran's I with weights 1/d of full grids of any size, each spread over many tasks."""
    rows = cells(df)
    mean = rows.groupBy("grid_id").agg(F.avg("v").alias("m"), F.count("*").alias("cells"), F.var_pop("v").alias("var"))
    centred = rows.join(mean.select("grid_id", "m"), "grid_id").select("grid_id", "i", "j", (F.col("v") - F.col("m")).alias("z"), F.lit(1.0).alias("one"))
    found = pair_sums(centred, {"near": ("z", "z", _inverse), "all": ("one", "one", _inverse)})
    return found.join(mean, "grid_id").select("grid_id", F.when(F.col("var") > 0, F.col("near") / (F.col("all") * F.col("var"))).otherwise(float("nan")).alias("moran"))


def mean_distance(df: DataFrame) -> DataFrame:
    """Mean distance between individuals, over the radius of a disc of the grid's area; 0 for an empty grid. Grids fit a task each."""
    return per_grid(df, lambda a: {"distance": _distance(a)}, "distance double")


def mean_distance_of_large(df: DataFrame) -> DataFrame:
    """:func:`mean_distance` of full grids of any size, each spread over many tasks."""
    rows = cells(df).select("grid_id", "i", "j", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).alias("v"))
    total = rows.groupBy("grid_id").agg(F.sum("v").alias("total"), F.count("*").alias("cells"))
    found = pair_sums(rows, {"far": ("v", "v", lambda d: d)}).join(total, "grid_id")
    mean = F.col("far") / (F.col("total") * F.col("total")) * F.sqrt(math.pi / F.col("cells"))
    return found.select("grid_id", F.when(F.col("total") > 0, mean).otherwise(0.0).alias("distance"))


def components_of_large(df: DataFrame) -> DataFrame:
    """grid_id, components, block_area of the positive cells of grids of any size, as a graph of cells that touch."""
    from .network import Network
    from .network import components as of_graph

    on = cells(df).where("v > 0").select(F.struct("grid_id", "i", "j").alias("id"))
    ends = to_links(df).select(F.struct("grid_id", "src.i", "src.j").alias("src"), F.struct("grid_id", "dst.i", "dst.j").alias("dst"))
    sizes = of_graph(Network(on, ends)).groupBy(F.col("id.grid_id").alias("grid_id"), "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("grid_id").agg(F.count("*").cast("double").alias("components"), F.avg("n").alias("block_area"))


def congested_flows(df: DataFrame, cost: float) -> DataFrame:
    """Gravity flows with weights 1/d of population shares, less their congestion: sum w p q - cost * sum w^2 p^2 q^2."""

    def flows(a: np.ndarray) -> dict[str, float]:
        p = a / a.sum() if a.sum() else a
        return {"flows": _fft_sum(p, p, _inverse) - cost * _fft_sum(p * p, p * p, lambda d: _inverse(d) ** 2)}

    return per_grid(df, flows, "flows double")


def labels(on: np.ndarray) -> np.ndarray:
    """Component numbers of set cells (4 neighbours), -1 elsewhere: minimum labels spread with pointer jumping."""
    n, m = on.shape
    label = np.where(on.ravel(), np.arange(n * m), -1)
    at = np.arange(n * m).reshape(n, m)
    pairs = np.concatenate([np.stack([at[1:][on[1:] & on[:-1]], at[:-1][on[1:] & on[:-1]]], 1), np.stack([at[:, 1:][on[:, 1:] & on[:, :-1]], at[:, :-1][on[:, 1:] & on[:, :-1]]], 1)])
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        differ = a != b
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        np.minimum.at(label, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(label, pairs[:, 1], label[pairs[:, 0]])
        set_ = label >= 0
        while True:
            up = label[label[set_]]
            if (up == label[set_]).all():
                break
            label[set_] = up
    return label.reshape(n, m)


def _taxi(seed: np.ndarray) -> np.ndarray:
    """Taxicab distance of every cell to the nearest set cell."""
    far = float(sum(seed.shape))
    d = np.where(seed, 0.0, far)
    for axis in (0, 1):
        k = np.arange(d.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
        up = np.minimum.accumulate(d - k, axis=axis) + k
        down = np.flip(np.minimum.accumulate(np.flip(d + k, axis), axis=axis), axis) - k
        d = np.minimum(up, down)
    return d


def _shift_all(on: np.ndarray, keep: Callable[[Sequence[np.ndarray]], np.ndarray]) -> np.ndarray:
    p = np.pad(on, 1)
    return keep([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] for a, b in CROSS])


def steps(on: np.ndarray) -> dict[str, float]:
    """Steps to full dilation and erosion, and until closing and opening are stable, in closed form."""
    dilate = lambda x: _shift_all(x, np.logical_or.reduce)
    erode = lambda x: _shift_all(x, np.logical_and.reduce)
    empty, full = not on.any(), bool(on.all())
    inside = _taxi(~np.pad(on, 1))[1:-1, 1:-1]
    return {
        "dilation_steps": 0.0 if empty else max(1.0, float(_taxi(on).max())),
        "erosion_steps": 0.0 if full else max(1.0, float(inside[on].max(initial=0.0))),
        "closing_steps": 0.0 if empty else 1.0 if (erode(dilate(on)) == on).all() else 2.0,
        "opening_steps": 0.0 if full else 1.0 if (dilate(erode(on)) == on).all() else 2.0,
    }


def _detour(on: np.ndarray, sampled: int) -> float:
    """Mean ratio of path to straight distance between up to ``sampled`` set cells, reachable pairs over all pairs."""
    at = np.argwhere(on)
    if len(at) < 2:
        return 0.0
    key = (at[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[:, 1].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    chosen = at[np.argsort(key, kind="stable")[:sampled]]
    total, pairs = 0.0, 0
    for i, j in chosen:
        reach, d, step = np.zeros_like(on), np.full(on.shape, np.inf), 0
        front = np.zeros_like(on)
        front[i, j] = True
        while front.any():
            d[front] = step
            reach |= front
            front = _shift_all(front, np.logical_or.reduce) & on & ~reach
            step += 1
        straight = np.hypot(chosen[:, 0] - i, chosen[:, 1] - j)
        path = d[chosen[:, 0], chosen[:, 1]]
        good = (straight > 0) & np.isfinite(path)
        total += float((path[good] / straight[good]).sum())
        pairs += int((straight > 0).sum())
    return total / pairs if pairs else 0.0


MORPHOLOGY = "height double, width double, area double, moran double, distance double, density double, components double, block_area double, component_area double, detour double, dilation_steps double, erosion_steps double, closing_steps double, opening_steps double"


def morphology(df: DataFrame, sampled: int = 50) -> DataFrame:
    """All indicators of building grids (0/1), one row a grid."""

    def measure(a: np.ndarray) -> dict[str, float]:
        on = a > 0
        built, free = labels(on), labels(~on)
        sizes = lambda x: np.unique(x[x >= 0], return_counts=True)[1]
        mean = lambda x: float(x.mean()) if len(x) else 0.0
        own = sizes(built)
        return {
            "height": float(a.shape[0]), "width": float(a.shape[1]), "area": float(a.sum()), "moran": _moran(a), "distance": _distance(a), "density": float(on.mean()),
            "components": float(len(own)), "block_area": mean(own), "component_area": mean(sizes(free)), "detour": _detour(on, sampled), **steps(on),
        }

    return per_grid(df, measure, MORPHOLOGY)


def components(df: DataFrame) -> DataFrame:
    """grid_id, components, block_area (mean size) of positive cells, and component_area of the others."""

    def measure(a: np.ndarray) -> dict[str, float]:
        out = {}
        for name, on in (("block_area", a > 0), ("component_area", ~(a > 0))):
            x = labels(on)
            sizes = np.unique(x[x >= 0], return_counts=True)[1]
            out[name] = float(sizes.mean()) if len(sizes) else 0.0
            if name == "block_area":
                out["components"] = float(len(sizes))
        return out

    return per_grid(df, measure, "block_area double, components double, component_area double")


def morphology_distance(a: DataFrame, b: DataFrame, columns: Sequence[str], key: str = "grid_id") -> DataFrame:
    """Summed absolute difference of two tables of indicators."""
    gap = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns]
    return a.alias("a").join(b.alias("b"), key).select(key, sum(gap[1:], gap[0]).alias("distance"))


def rotated(df: DataFrame, columns: Sequence[str], low: Sequence[float], high: Sequence[float], rotation: Sequence[Sequence[float]]) -> DataFrame:
    """Principal components pc1, pc2, ... of min-max normalised indicators, chosen by name."""
    scaled = [(F.col(c) - a) / (b - a) for c, a, b in zip(columns, low, high)]
    parts = [[s * w for s, w in zip(scaled, column)] for column in zip(*rotation)]
    return df.withColumns({f"pc{k + 1}": sum(p[1:], p[0]) for k, p in enumerate(parts)})
