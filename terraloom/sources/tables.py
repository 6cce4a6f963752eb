"""Delimited text: tables, raw lines, numeric matrices and coordinate matrices; binary tables as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", header: bool = True, schema: StructType | str | None = None) -> DataFrame:
    """A table; without a schema all columns are strings, named c0, c1, ... where there is no header."""
    reader = spark.read.option("sep", sep).option("header", header).option("quote", '"')
    out = (reader.schema(schema) if schema else reader).csv(path)
    return out if header or schema else out.toDF(*[f"c{k}" for k in range(len(out.columns))])


def write_csv(df: DataFrame, path: str, *, sep: str = ",", header: bool = True) -> None:
    df.write.option("sep", sep).option("header", header).csv(path)


def write_binary(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def numbered(df: DataFrame, name: str = "line") -> DataFrame:
    """Rows numbered from 0 in file order: counts of the partitions give each its offset; the rows aren't moved."""
    from pyspark.sql import Window

    rows = df.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return rows.join(F.broadcast(counts.select("_p", "_first", offset.alias("_o"))), "_p").withColumn(name, F.col("_m") - F.col("_first") + F.col("_o")).drop("_p", "_m", "_first", "_o")


def read_lines(spark: SparkSession, path: str, *, sep: str = ",", skip: int = 0) -> DataFrame:
    """line, parts: the split lines of a file, without its first ``skip`` lines."""
    rows = numbered(spark.read.text(path)).where(F.col("line") >= skip)
    return rows.select((F.col("line") - skip).alias("line"), F.split("value", f"\\Q{sep}\\E").alias("parts"))


def _number(text: Column, missing: str) -> Column:
    return F.when(F.trim(text) == missing, F.lit(float("nan"))).otherwise(F.trim(text).cast("double"))


def read_matrix(spark: SparkSession, path: str, *, sep: str = ",", missing: str = "NA", skip: int = 0) -> DataFrame:
    """i, j, v of a numeric matrix file; missing cells are NaN."""
    parts = read_lines(spark, path, sep=sep, skip=skip).select(F.col("line").cast("int").alias("i"), F.posexplode("parts").alias("j", "text"))
    return parts.select("i", "j", _number(F.col("text"), missing).alias("v"))


def read_sparse_from_dense(spark: SparkSession, path: str, *, keep: Callable[[Column], Column], convert: Callable[[Column], Column] = lambda v: v, sep: str = ",", missing: str = "NA") -> DataFrame:
    """The cells of a matrix file (first line: its shape) that pass ``keep``, converted."""
    return read_matrix(spark, path, sep=sep, missing=missing, skip=1).where(keep(F.col("v"))).select("i", "j", convert(F.col("v")).alias("v"))


def read_coordinates(spark: SparkSession, path: str, *, sep: str = ",", missing: str = "NA") -> DataFrame:
    """i, j, v of a coordinate file (first line: its shape)."""
    parts = read_lines(spark, path, sep=sep, skip=1)
    return parts.select(F.get("parts", F.lit(0)).cast("int").alias("i"), F.get("parts", F.lit(1)).cast("int").alias("j"), _number(F.get("parts", F.lit(2)), missing).alias("v"))


def read_grid(spark: SparkSession, path: str, *, sep: str = ";", missing: str = "NA", grid_id: object = 0) -> DataFrame:
    """A raster file as grid_id, i, j, v."""
    return read_matrix(spark, path, sep=sep, missing=missing).select(F.lit(grid_id).alias("grid_id"), "i", "j", "v")


def big_endian_float(data: Column) -> Column:
    """Four bytes as a big-endian float, from the bits."""
    bits = F.conv(F.hex(data), 16, 10).cast("long")
    sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(255), bits.bitwiseAND(0x7FFFFF)
    normal = sign * (1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
    special = F.when(fraction == 0, sign * float("inf")).otherwise(float("nan"))
    return F.when(exponent == 0, sign * fraction / float(1 << 23) * 2.0**-126).when(exponent == 255, special).otherwise(normal).cast("float")


def read_database(spark: SparkSession, url: str, table: str, xmin: float, ymin: float, xmax: float, ymax: float, *, geometry: str = "geom", key: str | None = None, parts: int = 1, driver: str = "org.postgresql.Driver") -> DataFrame:
    """Geometries of a PostGIS table that meet a box; the box travels in the query. Needs the driver's jar.

    With a numeric ``key`` the table is read in ``parts`` ranges of it, side by side; the edges come from the table's own extremes.
    """
    quoted = lambda name: ".".join('"' + part.replace('"', '""') + '"' for part in name.split("."))
    box = ", ".join(repr(float(v)) for v in (xmin, ymin, xmax, ymax))
    inside = f"FROM {quoted(table)} WHERE ST_Intersects({quoted(geometry)}, ST_MakeEnvelope({box}, 4326))"
    reader = spark.read.format("jdbc").options(url=url, driver=driver)
    if key is None:
        return reader.option("query", f"SELECT ST_AsText({quoted(geometry)}) AS wkt {inside}").load()
    low, high = reader.option("query", f"SELECT min({quoted(key)}) AS low, max({quoted(key)}) AS high {inside}").load().first()
    rows = f"(SELECT {quoted(key)} AS k, ST_AsText({quoted(geometry)}) AS wkt {inside}) AS g"
    ranged = spark.read.format("jdbc").options(url=url, driver=driver, dbtable=rows, partitionColumn="k", lowerBound=str(low or 0), upperBound=str((high or 0) + 1), numPartitions=str(parts))
    return ranged.load().select("wkt")
