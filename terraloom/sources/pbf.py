"""OSM PBF extracts as the node and way tables of the XML reader. A file's blocks are independent, so a task holds one block's objects at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_NODES = pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string()))])
_WAYS = pa.schema([("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("node_refs", pa.list_(pa.int64()))])


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Number and value of each field of a message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _packed(data: memoryview) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def _signed(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += _signed(v)
        out.append(total)
    return out


def blocks(content: bytes) -> Iterator[memoryview]:
    """The primitive blocks of a file, inflated."""
    data, at = memoryview(content), 0
    while at < len(data):
        n = struct.unpack_from(">I", data, at)[0]
        head = dict(_fields(data[at + 4 : at + 4 + n]))
        blob = dict(_fields(data[at + 4 + n : at + 4 + n + head[3]]))
        at += 4 + n + head[3]
        if bytes(head[1]) == b"OSMData":
            yield memoryview(zlib.decompress(blob[3])) if 3 in blob else blob[1]


def objects(block: memoryview) -> tuple[list[dict], list[dict]]:
    """Nodes and ways of a block."""
    groups, strings, granularity, lat0, lon0 = [], [], 100, 0, 0
    for number, value in _fields(block):
        if number == 1:
            strings = [bytes(s).decode() for _, s in _fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat0 = value - (1 << 64 if value >> 63 else 0)
        elif number == 20:
            lon0 = value - (1 << 64 if value >> 63 else 0)
    degrees = lambda v, base: (base + granularity * v) / 1e9
    named = lambda f: [(strings[k], strings[v]) for k, v in zip(_packed(f.get(2, memoryview(b""))), _packed(f.get(3, memoryview(b""))))]
    nodes, ways = [], []
    for group in groups:
        for number, value in _fields(group):
            f = dict(_fields(value))
            if number == 1:
                nodes.append({"id": _signed(f[1]), "lat": degrees(_signed(f[8]), lat0), "lon": degrees(_signed(f[9]), lon0), "tags": named(f)})
            elif number == 2:
                tags, at, texts = [], 0, _packed(f.get(10, memoryview(b"")))
                ids = _running(_packed(f[1]))
                for _ in ids:
                    own = []
                    while at < len(texts) and texts[at]:
                        own.append((strings[texts[at]], strings[texts[at + 1]]))
                        at += 2
                    at += 1
                    tags.append(own)
                nodes += [{"id": i, "lat": degrees(a, lat0), "lon": degrees(o, lon0), "tags": t} for i, a, o, t in zip(ids, _running(_packed(f[8])), _running(_packed(f[9])), tags)]
            elif number == 3:
                ways.append({"id": f[1], "tags": named(f), "node_refs": _running(_packed(f[8]))})
    return nodes, ways


def _read(spark: SparkSession, path: str, which: int, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for block in blocks(content.as_py()):
                    yield pa.RecordBatch.from_pylist(objects(block)[which], schema=(_NODES, _WAYS)[which])

    return files.mapInArrow(run, schema)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, 0, "id long, lat double, lon double, tags map<string,string>")


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, 1, "id long, tags map<string,string>, node_refs array<long>")
