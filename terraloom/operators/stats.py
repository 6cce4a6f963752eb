"""Statistics of columns, for each group of ``by`` or over all rows. NaN and null values are left out of every statistic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def real(df: DataFrame, *values: str) -> DataFrame:
    """The rows whose values are neither null nor NaN."""
    for v in values:
        df = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    return df


def moments(df: DataFrame, value: str, by: Sequence[str] = (), orders: Sequence[int] = (1, 2), weight: str | None = None) -> DataFrame:
    """Raw moments m1, m2, ... (weighted if asked) and the biased standard deviation ``std``."""
    rows, v = real(df, value), F.col(value).cast("double")
    mean = (lambda x: F.sum(x * F.col(weight)) / F.sum(weight)) if weight else F.avg
    return rows.groupBy(*by).agg(*[mean(F.pow(v, F.lit(float(k)))).alias(f"m{k}") for k in orders], F.stddev_pop(v).alias("std"))


def entropy(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Normalised entropy of the values' shares; n counts zeros, a zero total gives 0."""
    rows = df.select(*by, F.when(F.isnan(F.col(value).cast("double")), 0.0).otherwise(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).alias("v"))
    # sum p ln p = (sum v ln v) / total - ln total: one pass, partial sums
    parts = rows.groupBy(*by).agg(F.sum("v").alias("total"), F.sum(F.when(F.col("v") > 0, F.col("v") * F.ln("v")).otherwise(0.0)).alias("vlnv"), F.count("*").alias("n"))
    h = F.when((F.col("total") <= 0) | (F.col("n") < 2), 0.0).otherwise((F.ln("total") - F.col("vlnv") / F.col("total")) / F.ln("n"))
    return parts.select(*by, h.alias("entropy"))


def rank_size(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and R2 of ln(value) on ln(rank), positive values in descending order.

    Equal values have equal ranks only as a group, so ranks are dealt to distinct values with their counts; for one hot group the ranks
    come from counts of values, not from one sorted task of rows.
    """
    counted = real(df, value).where(F.col(value) > 0).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranked = running(counted, by, F.desc("v"), ["n"]).withColumn("before", F.col("n_upto") - F.col("n"))
    rows = ranked.select(*by, F.ln("v").alias("y"), F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("rank"))
    return rows.groupBy(*by).agg(F.regr_slope("y", F.ln("rank")).alias("slope"), F.regr_r2("y", F.ln("rank")).alias("r2"))


def histogram(df: DataFrame, value: str, breaks: int) -> DataFrame:
    """bin, centre, n for ``breaks`` bins: bin floor((v - min)(breaks - 1) / range), empty bins included."""
    rows = real(df, value).select(F.col(value).cast("double").alias("v"))
    edge = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    binned = rows.crossJoin(F.broadcast(edge)).withColumn("bin", F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) * (breaks - 1) / (F.col("high") - F.col("low")))).otherwise(0).cast("int"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(breaks).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(edge))
    centre = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / breaks
    return bins.join(counts, "bin", "left").select("bin", centre.alias("centre"), F.coalesce("n", F.lit(0)).alias("n"))


def quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile at position q (n + 1), interpolated; clipped to the extremes."""
    counted = real(df, value).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    rows = running(counted, by, F.asc("v"), ["n"]).withColumnsRenamed({"n_upto": "upto", "n_total": "total"})
    at = F.least(F.greatest(F.lit(q) * (F.col("total") + 1), F.lit(1.0)), F.col("total").cast("double"))
    rows = rows.withColumns({"lo": F.floor(at), "hi": F.ceil(at), "part": at - F.floor(at)})
    pick = lambda k: F.min(F.when(F.col("upto") >= F.col(k), F.col("v")))
    return rows.groupBy(*by).agg((pick("lo") + F.max("part") * (pick("hi") - pick("lo"))).alias("quantile"))


def gini(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient by ranks: n log n, no pairs."""
    counted = real(df, value).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    rows = running(counted, by, F.asc("v"), ["n"]).withColumn("before", F.col("n_upto") - F.col("n"))
    ranks = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2  # sum of the ranks of equal values
    parts = rows.groupBy(*by).agg(F.sum(ranks * F.col("v")).alias("s"), F.sum(F.col("n") * F.col("v")).alias("t"), F.sum("n").alias("k"))
    return parts.select(*by, (2 * F.col("s") / (F.col("k") * F.col("t")) - (F.col("k") + 1) / F.col("k")).alias("gini"))


def ks_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of two samples, from counts of distinct values."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select(F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    counts = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    rows = running(counts, (), F.asc("v"), ["x", "y"])
    return rows.select(F.abs(F.col("x_upto") / F.col("x_total") - F.col("y_upto") / F.col("y_total")).alias("d")).agg(F.max("d").alias("ks"))


def cumulative(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All columns and ``cumsum``, the running sum in order."""
    return df.withColumn("cumsum", F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def log_mse(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """ln of the summed squared difference, and the mean squared difference of logs, over common keys."""
    x, y = F.col("a.v"), F.col("b.v")
    left, right = (d.select(*keys, F.col(value).alias("v")) for d in (a, b))
    joined = left.alias("a").join(right.alias("b"), list(keys))
    return joined.agg(F.ln(F.sum(F.pow(x - y, F.lit(2.0)))).alias("logmse"), F.avg(F.pow(F.ln(x) - F.ln(y), F.lit(2.0))).alias("mselog"))


def grouped_summary(df: DataFrame, by: Sequence[str], values: Sequence[str], least: int = 0) -> DataFrame:
    """count, and for each value its mean, sample deviation and |mean / deviation|; groups of at least ``least`` rows."""
    columns: list[Column] = []
    for v in values:
        columns += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_sd"), F.abs(F.avg(v) / F.stddev_samp(v)).alias(f"{v}_ratio")]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *columns).where(F.col("n") >= least)


def best_rows(df: DataFrame, by: Sequence[str], cost: str, keep: Sequence[str]) -> DataFrame:
    """The row of least cost in each group; ties go to the smallest kept columns."""
    return df.groupBy(*by).agg(F.min(F.struct(cost, *keep)).alias("best")).select(*by, "best.*")
