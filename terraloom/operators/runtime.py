"""What operators share on a cluster: the folder that driver and executors see, files put there, lineage cut through written tables."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary one for a local master; a cluster needs a shared folder, so there that raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            root = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = f"file://{tempfile.mkdtemp(prefix='terraloom-')}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/terraloom-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Hadoop's file system API, so that any store works."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file from the driver to any store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: plans stay small, and jobs survive lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def timed(name: str) -> Iterator[None]:
    """Logs the seconds that a block takes."""
    began = time.monotonic()
    try:
        yield
    finally:
        logging.getLogger("terraloom").info("%s took %.3f s", name, time.monotonic() - began)


def _clean() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
