"""Running sums over a whole table, without gathering it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut


def running(df: DataFrame, by: Sequence[str], order: Column, sums: Sequence[str]) -> DataFrame:
    """Adds ``<name>_upto`` (the running sum in order, this row included) and ``<name>_total`` for each of ``sums``.

    With ``by``, a window a group. Without, rows are dealt to ranges of the order; the totals of the ranges, a row each, give every range its offset.
    """
    if by:
        over = Window.partitionBy(*by)
        upto = over.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({f"{s}_upto": F.sum(s).over(upto) for s in sums} | {f"{s}_total": F.sum(s).over(over) for s in sums})
    rows = cut(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    ranges = rows.groupBy("_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums], *[F.sum(f"_{s}").over(Window.partitionBy()).alias(f"{s}_total") for s in sums])
    local = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(ranges), "_range").withColumns({f"{s}_upto": F.sum(s).over(local) + F.col(f"_{s}_before") for s in sums})
    return out.drop("_range", *[f"_{s}_before" for s in sums])


def numbered(df: DataFrame, order: Column, name: str, start: int = 0) -> DataFrame:
    """Rows numbered from ``start`` in the order of a unique key."""
    return running(df.withColumn("_one", F.lit(1)), (), order, ["_one"]).withColumn(name, F.col("_one_upto") - 1 + start).drop("_one", "_one_upto", "_one_total")
