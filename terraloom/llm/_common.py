"""Helpers shared by the training-data operators: shared folders, written tables, words, sizes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runtime import cut, fresh_path

__all__ = ["WORD_GAP", "WordHashes", "bucketed", "crc_mod", "fresh_path", "map_batches", "settle", "small_batches", "table", "unit_hash", "written"]

#: ASCII white space as the contracts define it; ``bytes.split()`` splits at the same six characters.
WORD_GAP = r"[\x20\x09-\x0D]+"

_tables: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    for spark, name in _tables:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    return cut(df, name)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by a column: grouping and joining by it later moves nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    called = f"terraloom_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(called)
    if not _tables:
        atexit.register(_clean)
    _tables.append((spark, called))
    return spark.table(called)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(*tables: dict) -> None:
    """At a task's end: empty the worker's tables and give freed memory back, for workers live on and serve other stages."""
    for t in tables:
        t.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | object, last: Callable[[], None] = settle) -> DataFrame:
    """``mapInArrow`` with a function from one batch to dicts of columns; keeps no state between batches but the function's own. ``last`` is called at a task's end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    struct = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in (c for batch in batches for c in fn(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in arrow], schema=arrow)
        last()

    return df.mapInArrow(run, struct)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows, for rows are whole texts; a session that sets another size keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


class WordHashes(dict):
    """Words (bytes) to 64-bit hashes; bounded by :meth:`trim`, called between documents."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")) if isinstance(key, str) else F.crc32(key.cast("string").cast("binary")), F.lit(n))


def unit_hash(key: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")
