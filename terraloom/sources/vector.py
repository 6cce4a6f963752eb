"""Vector files: shapefiles, GeoPackages, WKB and WKT. Files are read through Spark's binary source, so any store will do."""

from __future__ import annotations

import re
import sqlite3
import struct
import tempfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COORDS = "array<struct<x:double,y:double>>"
GEOMETRY = f"kind string, parts array<{COORDS}>, attrs map<string,string>"


def wkt_points(text: Column) -> Column:
    """The coordinates of a WKT geometry's first part."""
    first = F.regexp_extract(text, r"\(+([^()]*)\)", 1)
    return F.transform(F.split(first, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))


def to_wkt(kind: str, coords: Column) -> Column:
    body = F.array_join(F.transform(coords, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    start, end = ("((", "))") if kind.upper() == "POLYGON" else ("(", ")")
    return F.concat(F.lit(f"{kind.upper()} {start}"), body, F.lit(end))


def wkb(data: bytes, at: int = 0) -> tuple[str, list[list[tuple[float, float]]], int]:
    """Kind, parts (rings or lines) and end of a WKB geometry."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    kind, dims = code % 1000, 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3)
    at += 5

    def points(n: int, at: int) -> tuple[list[tuple[float, float]], int]:
        flat = struct.unpack_from(f"{order}{n * dims}d", data, at)
        return list(zip(flat[::dims], flat[1::dims])), at + 8 * n * dims

    def count(at: int) -> tuple[int, int]:
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == 1:
        part, at = points(1, at)
        return "Point", [part], at
    if kind == 2:
        n, at = count(at)
        part, at = points(n, at)
        return "LineString", [part], at
    n, at = count(at)
    parts = []
    if kind == 3:
        for _ in range(n):
            size, at = count(at)
            ring, at = points(size, at)
            parts.append(ring)
        return "Polygon", parts, at
    for _ in range(n):
        name, inner, at = wkb(data, at)
        parts += inner
    return f"Multi{name}" if n else "Empty", parts, at


def _row(kind: str, parts: Sequence[Sequence[tuple[float, float]]], attrs: dict[str, str]) -> dict:
    return {"kind": kind, "parts": [[{"x": x, "y": y} for x, y in p] for p in parts], "attrs": list(attrs.items())}


_ARROW = pa.schema([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))), ("attrs", pa.map_(pa.string(), pa.string()))])


def shapes(shp: bytes, dbf: bytes | None, wanted: Sequence[str] | None) -> Iterator[dict]:
    """The records of a shapefile: points, lines, polygons."""
    fields, records = [], []
    if dbf:
        n, head, size = struct.unpack_from("<IHH", dbf, 4)
        at = 32
        while dbf[at] != 0x0D:
            fields.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
            at += 32
        for k in range(n):
            row, at = {}, head + k * size + 1
            for name, width in fields:
                row[name] = dbf[at : at + width].decode("latin-1").strip()
                at += width
            records.append(row)
    at, k = 100, 0
    while at + 8 <= len(shp):
        size = struct.unpack_from(">I", shp, at + 4)[0] * 2
        body = shp[at + 8 : at + 8 + size]
        kind = struct.unpack_from("<I", body)[0] % 10
        attrs = {n: v for n, v in (records[k] if k < len(records) else {}).items() if wanted is None or n in wanted}
        if kind == 1:
            yield _row("Point", [[struct.unpack_from("<dd", body, 4)]], attrs)
        elif kind in (3, 5):
            parts, n = struct.unpack_from("<II", body, 36)
            starts = [*struct.unpack_from(f"<{parts}I", body, 44), n]
            flat = struct.unpack_from(f"<{2 * n}d", body, 44 + 4 * parts)
            xy = list(zip(flat[::2], flat[1::2]))
            yield _row("Polygon" if kind == 5 else "LineString" if parts == 1 else "MultiLineString", [xy[a:b] for a, b in zip(starts, starts[1:])], attrs)
        at, k = at + 8 + size, k + 1


def read_shapefile(spark: SparkSession, path: str, attributes: Sequence[str] | None = None) -> DataFrame:
    """kind, parts, attrs of every shape under ``path`` (x.shp with x.dbf): one task a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path).select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.substring_index("path", ".", -1).alias("ext"), "content")
    pairs = files.groupBy("stem").agg(F.max(F.when(F.col("ext") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("ext") == "dbf", F.col("content"))).alias("dbf")).where("shp IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(shapes(row["shp"], row["dbf"], attributes))
                yield pa.RecordBatch.from_pylist(found, schema=_ARROW)

    return pairs.mapInArrow(run, GEOMETRY)


def read_geopackage(spark: SparkSession, path: str, table: str, attributes: Sequence[str] = (), geometry: str = "geom") -> DataFrame:
    """kind, parts, attrs of a feature table; null and empty geometries are skipped."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                with tempfile.NamedTemporaryFile(suffix=".gpkg") as local:  # SQLite needs a file; it lives as long as this task's read
                    Path(local.name).write_bytes(value.as_py())
                    rows, quoted = [], ", ".join(f'"{a}"' for a in (geometry, *attributes))
                    for blob, *values in sqlite3.connect(local.name).execute(f'SELECT {quoted} FROM "{table}"'):
                        if blob is None or blob[3] >> 4 & 1:
                            continue
                        kind, parts, _ = wkb(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])
                        rows.append(_row(kind, parts, {a: str(v) for a, v in zip(attributes, values) if v is not None}))
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.mapInArrow(run, GEOMETRY)


def write_geopackage(points: DataFrame, path: str, table: str, attributes: Sequence[str] = (), *, limit: int = 10_000_000) -> None:
    """Points (x, y, attributes) to a GeoPackage in EPSG:4326. One file has one writer: it streams from the executors to a file of the driver, which is then
    copied to ``path`` in any store; at most ``limit`` rows."""
    spark = points.sparkSession
    local = Path(tempfile.mkdtemp(prefix="terraloom-")) / "layer.gpkg"
    db = sqlite3.connect(local)
    db.executescript(
        "PRAGMA application_id = 1196444487;"
        "CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT, description TEXT);"
        "INSERT INTO gpkg_spatial_ref_sys VALUES ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS[\"WGS 84\"]', NULL);"
        "CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, description TEXT, last_change TEXT, min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);"
        "CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);"
    )
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, srs_id) VALUES (?, 'features', 4326)", (table,))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POINT', 4326, 0, 0)", (table,))
    db.execute(f'CREATE TABLE "{table}" (fid INTEGER PRIMARY KEY, geom BLOB{"".join(f", \"{a}\" TEXT" for a in attributes)})')
    for n, row in enumerate(points.select("x", "y", *attributes).toLocalIterator()):
        if n >= limit:
            raise ValueError(f"a GeoPackage here has at most {limit} rows")
        blob = b"GP\x00\x01" + struct.pack("<i", 4326) + b"\x01" + struct.pack("<Idd", 1, row[0], row[1])
        db.execute(f'INSERT INTO "{table}" VALUES (NULL, ?{", ?" * len(attributes)})', (blob, *[None if v is None else str(v) for v in row[2:]]))
    db.commit()
    db.close()
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    named(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, named(f"file://{local}"), named(path))
    local.parent.rmdir()


def epsg_of(prj: str) -> str | None:
    """The EPSG code that a .prj text names, if any; the two systems with closed forms are recognised by name."""
    found = re.findall(r'AUTHORITY\["EPSG","(\d+)"\]', prj)
    if found:
        return f"EPSG:{found[-1]}"
    return "EPSG:3857" if re.search("Pseudo.?Mercator|Web_Mercator", prj) else "EPSG:4326" if re.search("WGS.?(19)?84", prj) else None


def lines_of(geometries: DataFrame) -> DataFrame:
    """Line parts as (coords, attrs); other geometries give none."""
    return geometries.where(F.col("kind").isin("LineString", "MultiLineString")).select(F.explode("parts").alias("coords"), "attrs")


def polygons_of(geometries: DataFrame) -> DataFrame:
    """Outer rings as (ring, attrs): the first part of a multi-polygon; other kinds raise."""
    bad = F.raise_error(F.concat(F.lit("not a polygon: "), F.col("kind"))).cast(COORDS)
    return geometries.select(F.when(F.col("kind").isin("Polygon", "MultiPolygon"), F.element_at("parts", 1)).otherwise(bad).alias("ring"), "attrs")


def read_layer(spark: SparkSession, path: str, attributes: Sequence[str] | None = None, table: str | None = None) -> DataFrame:
    """A vector layer by its file's ending: shapefile or GeoPackage."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "gpkg":
        return read_geopackage(spark, path, table or Path(path).stem, attributes or ())
    if ending == "shp":
        folder, _, name = path.rpartition("/")
        return read_shapefile(spark, f"{folder}/{name[:-4]}.*", attributes)
    raise ValueError(f"no reader for .{ending} layers")
