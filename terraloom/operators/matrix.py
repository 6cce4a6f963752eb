"""Sparse matrices in coordinate form: i, j, v. Absent cells are 0; element-wise maps touch stored cells only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DENSE_LIMIT = 2000


def mapped(m: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return m.withColumn("v", fn(F.col("v")))


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product: an equi-join on the inner index, products summed map-side first."""
    joined = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return joined.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), ["i", "j"]).select("i", "j", (F.col("a.v") * F.col("b.v")).alias("v"))


def added(*ms: DataFrame) -> DataFrame:
    """Sum of matrices, by union and aggregation: one shuffle whatever their number."""
    return reduce(lambda a, b: a.unionByName(b), [m.select("i", "j", "v") for m in ms]).groupBy("i", "j").agg(F.sum("v").alias("v"))


def subtracted(a: DataFrame, b: DataFrame) -> DataFrame:
    return added(a, mapped(b, lambda v: -v))


def power(m: DataFrame, p: float) -> DataFrame:
    return mapped(m, lambda v: F.pow(v, F.lit(float(p))))


def totals(m: DataFrame, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """total, least, most, entries, mean (over all cells if the shape is given)."""
    mean = F.sum("v") / (rows * columns) if rows and columns else F.avg("v")
    return m.agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("entries"), mean.alias("mean"))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("v"))


def block(m: DataFrame, i: int, j: int, rows: int, columns: int) -> DataFrame:
    """A submatrix, indices from 0."""
    inside = F.col("i").between(i, i + rows - 1) & F.col("j").between(j, j + columns - 1)
    return m.where(inside).select((F.col("i") - i).alias("i"), (F.col("j") - j).alias("j"), "v")


def picked(m: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """A submatrix of chosen indices: tables (old, new) for rows and columns."""
    r, c = rows.select(F.col("old").alias("i"), F.col("new").alias("ni")), columns.select(F.col("old").alias("j"), F.col("new").alias("nj"))
    return m.join(r, "i").join(c, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def replaced(m: DataFrame, cells: DataFrame) -> DataFrame:
    """The matrix with some cells set to new values."""
    return m.join(cells, ["i", "j"], "left_anti").select("i", "j", "v").unionByName(cells.select("i", "j", "v"))


def bound(a: DataFrame, b: DataFrame, offset: int, by_columns: bool = True) -> DataFrame:
    """b put beside (or under) a, whose size along that axis is ``offset``."""
    axis = "j" if by_columns else "i"
    return a.select("i", "j", "v").unionByName(b.select("i", "j", "v").withColumn(axis, F.col(axis) + offset))


def diagonal(values: DataFrame) -> DataFrame:
    """(i, v) on the diagonal."""
    return values.select("i", F.col("i").alias("j"), "v")


def constant(spark: SparkSession, rows: int, columns: int, value: float = 1.0) -> DataFrame:
    """A full matrix, made cell by cell from one range."""
    k = F.col("id")
    return spark.range(rows * columns).select(F.floor(k / columns).cast("int").alias("i"), (k % columns).cast("int").alias("j"), F.lit(float(value)).alias("v"))


def random(spark: SparkSession, rows: int, columns: int, density: float, seed: int) -> DataFrame:
    """Cells kept with probability ``density``; values uniform; both by hash of the cell."""
    from ..functions.columns import uniform

    return constant(spark, rows, columns).select("i", "j", uniform(seed, "i", "j").alias("v")).where(uniform(seed + 1, "i", "j") < density)


def to_array(m: DataFrame, rows: int, columns: int) -> np.ndarray:
    """A small matrix on the driver; refused above DENSE_LIMIT rows or columns."""
    if max(rows, columns) > DENSE_LIMIT:
        raise ValueError(f"dense work on the driver is bounded to {DENSE_LIMIT} rows and columns")
    out = np.zeros((rows, columns))
    for r in m.select("i", "j", "v").toLocalIterator():
        out[r.i, r.j] = r.v
    return out


def inverse(m: DataFrame, n: int) -> DataFrame:
    a = np.linalg.inv(to_array(m, n, n))
    return m.sparkSession.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n)], "i int, j int, v double")


def determinant(m: DataFrame, n: int) -> float:
    return float(np.linalg.det(to_array(m, n, n)))


def solve(m: DataFrame, b: Sequence[float]) -> list[float] | None:
    """x of m x = b, None if m is singular."""
    try:
        return np.linalg.solve(to_array(m, len(b), len(b)), np.array(b, float)).tolist()
    except np.linalg.LinAlgError:
        return None
