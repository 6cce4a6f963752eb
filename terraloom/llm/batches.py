"""Documents in batches that stay where they are: packed once by the tasks that read them, bucketed by batch.

An operator that must look something up for many words of a text sends what it asks for, once a batch, to the blocks that
own the answers, and joins the answers with the batch; the bucketed table makes that join move the answers only.
Batches follow the order of reading and are cut by size, so no key gathers in one. What is written is fixed, whatever
happens to an executor later, though another run of the same tasks might pack other batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucketed, settle

ROW_BYTES = 16 << 20


def squeezed(data: bytes, level: int = 6) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def unsqueezed(data: pa.Scalar) -> bytes:
    view = memoryview(data.as_buffer())
    size = int.from_bytes(view[:8], "little")
    return pa.decompress(view[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def planes(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_batches(docs: DataFrame, batch_bytes: int, text: str = "text") -> tuple[DataFrame, int, int]:
    """batch, data: the rows in batches of about ``batch_bytes`` of text; how many batches there are about; the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batch_bytes = min(batch_bytes, max(1 << 20, total // 12))  # small inputs are dealt out too
    tasks = max(12, -(-total // batch_bytes))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size, here, number = TaskContext.get().partitionId() << 24, [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for b in held:
                    writer.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([base + number], pa.int64()), pa.array([squeezed(sink.getvalue().to_pybytes())], pa.binary())], names=["batch", "data"])

        for batch in rows:
            for at in range(0, batch.num_rows, 100):
                held.append(batch.slice(at, 100))
                size += held[-1].nbytes
                if size >= min(ROW_BYTES, batch_bytes):  # a large batch is several rows
                    yield flush()
                    held, here, size = [], here + size, 0
                    number, here = (number + 1, 0) if here >= batch_bytes else (number, here)
        if held:
            yield flush()
        settle()

    boxes = docs.coalesce(tasks).mapInArrow(run, "batch long, data binary")
    return bucketed(boxes, "batches", "batch", min(4 * tasks, 20_000)), tasks, total


def opened(own: pa.Table) -> Iterator[pa.Table]:
    """The rows of a batch, in portions."""
    for data in own["data"]:
        yield pa.ipc.open_stream(unsqueezed(data)).read_all()
