"""Measures of points and cells by event-time window, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, value: str, width: str, *, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """start, keys, n, total, m1, std of each window; on a stream, rows later than ``late`` are dropped and windows close behind the watermark."""
    rows = df.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if df.isStreaming else rows
    out = rows.groupBy(F.window("_t", width, slide or width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("m1"), F.stddev_pop(value).alias("std"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total", "m1", "std")


def cell_counts(df: DataFrame, time: str, x: str, y: str, width: str, cell: float, *, late: str = "10 minutes") -> DataFrame:
    """start, i, j, v: a raster of event counts a window, ready for the grid measures."""
    rows = df.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if df.isStreaming else rows
    out = rows.groupBy(F.window("_t", width).alias("w"), F.floor(F.col(x) / cell).cast("int").alias("i"), F.floor(F.col(y) / cell).cast("int").alias("j")).agg(F.count("*").alias("v"))
    return out.select(F.col("w.start").alias("start"), "i", "j", "v")
