"""GeoTIFF bands as grids, and GeoJSON features; files are read through Spark, so any store will do."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_tiff(data: bytes, band: int = 0) -> tuple[np.ndarray, float, float, float, float]:
    """A band's values, and x0, y0, dx, dy of its upper left corner: strips or tiles, plain or deflated, without predictor."""
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    sizes = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 6: "b", 8: "h", 9: "i", 16: "Q"}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in sizes:
            continue
        code = f"{n}{sizes[kind]}"
        place = at + 10 + 12 * k
        if struct.calcsize(code) > 4:
            place = struct.unpack_from(order + "I", data, place)[0]
        tags[tag] = struct.unpack_from(order + code, data, place)
    width, height, compression, bands = tags[256][0], tags[257][0], tags.get(259, (1,))[0], tags.get(277, (1,))[0]
    if compression not in (1, 8, 32946) or tags.get(317, (1,))[0] != 1:
        raise ValueError(f"TIFF compression {compression} with predictor {tags.get(317, (1,))[0]} is not supported")
    bits, sample = tags.get(258, (8,))[0], tags.get(339, (1,))[0]
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[sample] + str(bits // 8)).newbyteorder(order)
    tiled = 322 in tags
    tw, th = (tags[322][0], tags[323][0]) if tiled else (width, tags.get(278, (height,))[0])
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across = -(-width // tw)
    separate = tags.get(284, (1,))[0] == 2
    per = len(offsets) // bands if separate else len(offsets)
    out = np.zeros((height, width))
    for k in range(per):
        src = k + band * per if separate else k
        raw = data[offsets[src] : offsets[src] + counts[src]]
        raw = zlib.decompress(raw) if compression != 1 else raw
        i, j = k // across * th, k % across * tw
        rows = th if tiled else min(th, height - i)
        block = np.frombuffer(raw, kind)[: rows * tw * (1 if separate else bands)].reshape(rows, tw, -1)[:, :, 0 if separate else band]
        part = block[: height - i, : width - j]
        out[i : i + part.shape[0], j : j + part.shape[1]] = part
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    return out, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], scale[0], -scale[1]


def read_geotiff(spark: SparkSession, path: str, band: int = 0) -> DataFrame:
    """grid_id (the file), i, j, v and the cell centres x, y of a band; one task a file, rows in slices."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, x0, y0, dx, dy = decode_tiff(content.as_py(), band)
                step = max(1, 200_000 // a.shape[1])
                for top in range(0, a.shape[0], step):
                    part = a[top : top + step]
                    i, j = np.indices(part.shape)
                    i = i + top
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(part.ravel()), pa.array((x0 + (j + 0.5) * dx).ravel()), pa.array((y0 + (i + 0.5) * dy).ravel())], names=["grid_id", "i", "j", "v", "x", "y"])

    return files.mapInArrow(run, "grid_id string, i int, j int, v double, x double, y double")


def as_points(raster: DataFrame, band: int = 0) -> DataFrame:
    """Cells as points with an attribute named by the band."""
    return raster.select("x", "y", F.create_map(F.lit(f"v{band}"), F.col("v").cast("string")).alias("attrs"))


def read_geojson(spark: SparkSession, path: str, kind: str = "LineString", box: tuple[float, float, float, float] | None = None, limit: int | None = None) -> DataFrame:
    """coords, attrs of the features of a kind (one feature a line), whose first point lies in a box; ``limit`` is the caller's choice."""
    rows = spark.read.schema("type string, geometry struct<type:string,coordinates:string>, properties map<string,string>").json(path)
    nested = {"Point": "array<double>", "LineString": "array<array<double>>", "Polygon": "array<array<array<double>>>"}[kind]
    found = rows.where(F.col("geometry.type") == kind).select(F.from_json("geometry.coordinates", nested).alias("c"), F.col("properties").alias("attrs"))
    line = {"Point": F.array("c"), "LineString": F.col("c"), "Polygon": F.element_at("c", 1)}[kind]
    out = found.select(F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("coords"), "attrs")
    if box:
        first = F.element_at("coords", 1)
        out = out.where(first["x"].between(box[0], box[2]) & first["y"].between(box[1], box[3]))
    return out.limit(limit) if limit else out
