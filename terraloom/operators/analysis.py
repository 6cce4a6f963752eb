"""Analysis of measured indicators: scaling, principal components, clusters, and their place in areas. Columns in, columns out, with Spark's own estimators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.8) -> DataFrame:
    """Rows with a density strictly inside the bounds and no missing indicator."""
    rows = df.where((F.col("density") > low) & (F.col("density") < high))
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return rows


def scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns mapped to [0, 1] by their extremes; a constant column becomes 0."""
    edges = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    rows = df.crossJoin(F.broadcast(edges))
    part = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0)
    return rows.withColumns({c: part(c) for c in columns}).drop(*edges.columns)


def principal_components(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """All columns and pc1, ..., pck."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df)
    out = PCA(k=k, inputCol="_features", outputCol="_pc").fit(rows).transform(rows).withColumn("_pc", vector_to_array("_pc"))
    return out.withColumns({f"pc{i + 1}": F.get("_pc", F.lit(i)) for i in range(k)}).drop("_features", "_pc")


def clusters(df: DataFrame, columns: Sequence[str], k: int, *, seed: int = 0) -> DataFrame:
    """All columns and ``cluster``."""
    rows = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(rows).transform(rows).drop("_features")


def area_profiles(points: DataFrame, areas: DataFrame, value: str, cell: float, least: int = 2) -> DataFrame:
    """area, n, sd of a value over the points (id, x, y, ...) in each area (id, ring), for areas of more than ``least`` points."""
    from .spatial import points_in_polygons

    inside = points_in_polygons(points, areas, cell).withColumnsRenamed({"point": "id", "polygon": "area"})
    return inside.join(points.select("id", value), "id").groupBy("area").agg(F.count("*").alias("n"), F.stddev_samp(value).alias("sd")).where(F.col("n") > least)


def cluster_shares(points: DataFrame, areas: DataFrame, cell: float) -> DataFrame:
    """area, cluster, share of the area's points."""
    from .spatial import points_in_polygons

    inside = points_in_polygons(points, areas, cell).withColumnsRenamed({"point": "id", "polygon": "area"}).join(points.select("id", "cluster"), "id")
    total = inside.groupBy("area").agg(F.count("*").alias("n"))
    return inside.groupBy("area", "cluster").agg(F.count("*").alias("k")).join(total, "area").select("area", "cluster", (F.col("k") / F.col("n")).alias("share"))


def nearest_run(runs: DataFrame, targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each target row (id, columns) the closest run by squared distance; targets are a few rows (cluster centres, objectives)."""
    named = targets.select(F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in columns])
    gap = sum((F.pow(F.col(c) - F.col(f"t_{c}"), F.lit(2.0)) for c in columns[1:]), F.pow(F.col(columns[0]) - F.col(f"t_{columns[0]}"), F.lit(2.0)))
    return runs.crossJoin(F.broadcast(named)).groupBy("target").agg(F.min(F.struct(gap.alias("gap"), "run")).alias("m")).select("target", "m.run", "m.gap")
