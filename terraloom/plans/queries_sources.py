"""Queries of sources and sinks: tables and networks written, read back and held against the tables they came from."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..functions.columns import uniform_sql as u
from ..operators import network, spatial
from ..operators.runtime import fresh_path, put
from ..sources import graphs, osm, pbf, rasters, tables, vector
from . import tables as t
from .registry import query, r

_EDGES = f"WITH RECURSIVE {t.EDGES}"


def _text(spark: SparkSession, lines: list[str], name: str) -> str:
    path = f"{fresh_path(spark, name)}/{name}"
    put(spark, path, "".join(f"{x}\n" for x in lines).encode())
    return path


# -- tables --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    tables.write_csv(t.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path, sep=";")
    return tables.read_csv(spark, path, sep=";", schema="c_custkey long, c_name string, c_mktsegment string, c_acctbal double").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT n_nationkey line, n_name part FROM nation WHERE n_nationkey > 0")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = [f"{x.n_nationkey}|{x.n_name}" for x in t.table(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    return tables.read_lines(spark, _text(spark, rows, "lines"), sep="|", skip=1).select((F.col("line") + 1).alias("line"), F.get("parts", F.lit(1)).alias("part"))


@query("SELECT c_nationkey, c_mktsegment, count(*) n, round(sum(c_acctbal), 2) total FROM customer GROUP BY 1, 2")
def binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "binary")
    tables.write_binary(t.table(spark, d, "customer"), path)
    return tables.read_binary(spark, path).groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), r(F.sum("c_acctbal"), "total", 2))


def _raster_file(spark: SparkSession, d: str, sep: str, head: bool) -> str:
    cells = {(x.i, x.j): x.v for x in t.raster(spark, d).collect()}  # 550 cells
    rows = [sep.join("NA" if cells[i, j] == 0 else str(cells[i, j]) for j in range(11)) for i in range(1, 51)]
    return _text(spark, ["50,11"] * head + rows, "matrix")


@query(f"WITH {t.RASTER} SELECT 7 grid_id, i - 1 i, j, v FROM raster WHERE v > 0")
def grid_file(spark: SparkSession, d: str) -> DataFrame:
    return tables.read_grid(spark, _raster_file(spark, d, ";", False), grid_id=7).where(~F.isnan("v"))


@query(f"WITH {t.RASTER} SELECT i - 1 i, j, 2 * v v FROM raster WHERE v > (SELECT avg(v) FROM raster WHERE v > 0)")
def sparse_from_dense(spark: SparkSession, d: str) -> DataFrame:
    mean = t.raster(spark, d).where("v > 0").agg(F.avg("v")).first()[0]
    return tables.read_sparse_from_dense(spark, _raster_file(spark, d, ",", True), keep=lambda v: ~F.isnan(v) & (v > mean), convert=lambda v: 2 * v)


@query(f"WITH {t.OD} SELECT o i, d j, round(mass, 3) v FROM od")
def coordinate_file(spark: SparkSession, d: str) -> DataFrame:
    flows = t.od(spark, d).collect()  # pairs of nations
    path = _text(spark, ["25,25", *(f"{x.o},{x.d},{x.mass!r}" for x in flows)], "coordinates")
    return tables.read_coordinates(spark, path).select("i", "j", r("v", "v", 3))


@query("SELECT k, (k - 50) * CAST(0.25 AS DOUBLE) v FROM (SELECT unnest(generate_series(0, 199)) k)")
def floats(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, bytearray(struct.pack(">f", (k - 50) * 0.25))) for k in range(200)]
    return spark.createDataFrame(rows, "k long, b binary").select("k", tables.big_endian_float(F.col("b")).cast("double").alias("v"))


# -- layers --------------------------------------------------------------------------------------------------------


def _shapefile(spark: SparkSession, d: str, side: float) -> str:
    """Squares at the nations, named by them, as x.shp, x.dbf and x.prj."""
    zones = t.zones(spark, d).join(t.table(spark, d, "nation").select(F.col("n_nationkey").alias("city"), "n_name"), "city").orderBy("city").collect()  # 25 rows
    shp, dbf = b"\0" * 100, b""
    for k, z in enumerate(zones):
        ring = [(z.x, z.y), (z.x, z.y + side), (z.x + side, z.y + side), (z.x + side, z.y), (z.x, z.y)]
        body = struct.pack("<I4dIII", 5, z.x, z.y, z.x + side, z.y + side, 1, 5, 0) + b"".join(struct.pack("<dd", *p) for p in ring)
        shp += struct.pack(">II", k + 1, len(body) // 2) + body
        dbf += b" " + z.n_name.encode().ljust(20)
    head = struct.pack("<BBBBIHH", 3, 26, 1, 1, len(zones), 65, 21) + b"\0" * 20 + b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([20, 0]) + b"\0" * 14 + b"\r"
    folder = fresh_path(spark, "shape")
    for ending, data in (("shp", shp), ("dbf", head + dbf), ("prj", b'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]')):
        put(spark, f"{folder}/x.{ending}", data)
    return f"{folder}/x.shp"


@query(f"WITH {t.ZONES} SELECT n_name, round(x, 6) x, round(y, 6) y, 0.01 area FROM zones JOIN nation ON city = n_nationkey")
def shapefile_layer(spark: SparkSession, d: str) -> DataFrame:
    rings = vector.polygons_of(vector.read_layer(spark, _shapefile(spark, d, 0.1), ["NAME"]))
    rows = spatial.with_bounds(rings)
    return rows.select(F.trim(F.element_at("attrs", "NAME")).alias("n_name"), r("xmin", "x"), r("ymin", "y"), r("area", "area"))


@query("SELECT 'EPSG:4326' epsg, 25 n")
def shapefile_projection(spark: SparkSession, d: str) -> DataFrame:
    path = _shapefile(spark, d, 0.1)
    prj = "\n".join(x.value for x in spark.read.text(path.replace(".shp", ".prj")).collect())
    return vector.read_layer(spark, path, ["NAME"]).agg(F.count("*").alias("n")).select(F.lit(vector.epsg_of(prj)).alias("epsg"), "n")


@query(f"WITH {t.POINTS} SELECT CAST(id AS VARCHAR) id, round(x, 6) x, round(y, 6) y FROM points")
def geopackage_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{fresh_path(spark, 'layer')}/p.gpkg"
    vector.write_geopackage(t.points(spark, d).select("x", "y", "id"), path, "places", ["id"])
    at = lambda c: F.get(F.get("parts", F.lit(0)), F.lit(0))[c]
    return vector.read_layer(spark, path, ["id"], "places").select(F.element_at("attrs", "id").alias("id"), r(at("x"), "x"), r(at("y"), "y"))


def _tiff(spark: SparkSession, d: str) -> str:
    """The demand raster as a GeoTIFF of deflated strips, two units a cell, its corner at (10, 50)."""
    a = np.zeros((50, 11), "<f4")
    for x in t.raster(spark, d).collect():  # 550 cells
        a[x.i - 1, x.j] = x.v
    strips = [zlib.compress(row.tobytes()) for row in a]
    ends = np.cumsum([8, *map(len, strips)])
    entries, extra = [], b""
    for tag, kind, code, values in (
        (256, 3, "H", [11]), (257, 3, "H", [50]), (258, 3, "H", [32]), (259, 3, "H", [8]), (273, 4, "I", ends[:-1].tolist()), (277, 3, "H", [1]), (278, 3, "H", [1]),
        (279, 4, "I", [*map(len, strips)]), (339, 3, "H", [3]), (33550, 12, "d", [2.0, 2.0, 0.0]), (33922, 12, "d", [0.0, 0.0, 0.0, 10.0, 50.0, 0.0]),
    ):
        raw = struct.pack(f"<{len(values)}{code}", *values)
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", int(ends[-1]) + len(extra))))
        extra += raw if len(raw) > 4 else b""
    path = f"{fresh_path(spark, 'raster')}/r.tif"
    put(spark, path, b"II*\0" + struct.pack("<I", int(ends[-1]) + len(extra)) + b"".join(strips) + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0" * 4)
    return path


@query(f"WITH {t.RASTER} SELECT i - 1 i, j, v, CAST(10 + 2 * j + 1 AS DOUBLE) x, CAST(50 - 2 * (i - 1) - 1 AS DOUBLE) y FROM raster")
def geotiff_cells(spark: SparkSession, d: str) -> DataFrame:
    return rasters.read_geotiff(spark, _tiff(spark, d)).select("i", "j", F.col("v").cast("double").alias("v"), "x", "y")


@query(f"WITH {t.BINARY} SELECT 11 width, 51 height, count(*) FILTER (v = 1) black FROM bin")
def png_image(spark: SparkSession, d: str) -> DataFrame:
    data = graphs.png(t.binary(spark, d))
    width, height = struct.unpack(">II", data[16:24])
    pixels = zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]])
    lines = [pixels[k + 1 : k + 1 + width] for k in range(0, len(pixels), width + 1)]
    return spark.createDataFrame([(width, height, sum(line.count(b"\x00") for line in lines))], "width int, height int, black long")


@query(f"WITH {t.ZONES} SELECT n_name, round(x, 4) x, round(y + 0.1, 4) y FROM zones JOIN nation ON city = n_nationkey WHERE x BETWEEN 0 AND 0.6 AND y BETWEEN 0.2 AND 1")
def geojson_lines(spark: SparkSession, d: str) -> DataFrame:
    zones = t.zones(spark, d).join(t.table(spark, d, "nation").select(F.col("n_nationkey").alias("city"), "n_name"), "city")
    place = F.array(F.array("x", "y"), F.array("x", F.col("y") + 0.1))
    features = zones.select(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), place.alias("coordinates")).alias("geometry"), F.struct("n_name").alias("properties"))
    path = fresh_path(spark, "geojson")
    features.write.json(path)
    end = F.element_at("coords", -1)
    return rasters.read_geojson(spark, path, "LineString", (0.0, 0.2, 0.6, 1.0)).select(F.element_at("attrs", "n_name").alias("n_name"), r(end["x"], "x", 4), r(end["y"], "y", 4))


# -- networks ------------------------------------------------------------------------------------------------------


@query(f"{_EDGES} SELECT src, dst, weight, round(length, 6) length FROM edges")
def gml_round_trip(spark: SparkSession, d: str) -> DataFrame:
    net, path = t.network(spark, d), fresh_path(spark, "gml")
    graphs.write_lines(graphs.gml_lines(net.with_(links=net.links.drop("mass"))), path)
    return graphs.read_gml(spark, path).links.select("src", "dst", "weight", r("length", "length"))


@query(f"{_EDGES} SELECT src, dst FROM edges")
def gexf_edges(spark: SparkSession, d: str) -> DataFrame:
    net, path = t.network(spark, d), fresh_path(spark, "gexf")
    graphs.write_lines(graphs.gexf_lines(net.with_(links=net.links.drop("mass"))), path)
    end = lambda name: F.regexp_extract("value", f'{name}="([^"]*)"', 1).cast("int")
    return spark.read.text(path).where("value LIKE '%<edge %'").select(end("source").alias("src"), end("target").alias("dst"))


@query(f"{_EDGES}, b AS (SELECT src a, dst b, length FROM edges UNION ALL SELECT dst, src, length FROM edges), z AS (SELECT city, round(x, 6) x, round(y, 6) y FROM zones) SELECT p.x ax, p.y ay, q.x bx, q.y by_, round(length, 6) length FROM b JOIN z p ON a = p.city JOIN z q ON b = q.city")
def matsim_network_round_trip(spark: SparkSession, d: str) -> DataFrame:
    net, path = t.network(spark, d), fresh_path(spark, "matsim")
    graphs.write_lines(graphs.matsim_network_lines(net.with_(links=net.links.drop("mass")), 13.9), path)
    back = graphs.read_matsim_network(spark, path)
    at = lambda c, a, b: back.nodes.select(F.col("id").alias(c), r("x", a), r("y", b))
    return back.links.join(at("src", "ax", "ay"), "src").join(at("dst", "bx", "by_"), "dst").select("ax", "ay", "bx", "by_", r("length", "length"))


@query("SELECT count(*) people, 3 * count(*) acts, 2 * count(*) legs FROM customer")
def matsim_population(spark: SparkSession, d: str) -> DataFrame:
    people = t.table(spark, d, "customer").select(F.col("c_custkey").alias("individual_id"), F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    lines, path = graphs.matsim_population_lines(spatial.commute_plans(people)), fresh_path(spark, "people")
    graphs.write_lines(lines, path)
    found = lambda tag: F.sum(F.size(F.split("value", f"<{tag} ")) - 1)
    return spark.read.text(path).agg(found("person").alias("people"), found("act(?:ivity)?").alias("acts"), found("leg").alias("legs"))


# -- OSM -----------------------------------------------------------------------------------------------------------

_CORNERS = ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1))


def _osm(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Four nodes and a closed way a nation; ways of even nations are buildings, of others roads."""
    zones, kind = t.zones(spark, d), F.when(F.col("city") % 2 == 0, F.create_map(F.lit("building"), F.lit("yes"))).otherwise(F.create_map(F.lit("highway"), F.when(F.col("city") % 3 == 0, "primary").otherwise("path")))
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(_CORNERS)])).alias("c")
    nodes = zones.select("city", "x", "y", corners).select((F.col("city") * 4 + F.col("c.k") + 1).cast("long").alias("id"), F.lit(1).alias("version"), F.create_map(F.lit("k"), F.col("c.k").cast("string")).alias("tags"), (F.col("y") + F.col("c.b")).alias("lat"), (F.col("x") + F.col("c.a")).alias("lon"))
    first = F.col("city").cast("long") * 4 + 1
    ways = zones.select((F.col("city") + 1000).cast("long").alias("id"), F.lit(1).alias("version"), kind.alias("tags"), F.array(first, first + 1, first + 2, first + 3, first).alias("node_refs"))
    return nodes, ways


def _read_osm(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = fresh_path(spark, "osm")
    graphs.write_lines(osm.xml_lines(*_osm(spark, d)), path)
    return osm.read_nodes(spark, path), osm.read_ways(spark, path)


@query(f"WITH {t.ZONES} SELECT city + 1000 id, round(x, 6) x, round(y, 6) y, 0.01 area FROM zones WHERE city % 2 = 0")
def osm_buildings(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways = _read_osm(spark, d)
    rings = spatial.with_bounds(spatial.buildings(ways, nodes))
    return rings.select("id", r("xmin", "x"), r("ymin", "y"), r("area", "area"))


@query(f"WITH {t.ZONES} SELECT city + 1000 id FROM zones WHERE city % 2 = 1 AND city % 3 = 0")
def osm_highways(spark: SparkSession, d: str) -> DataFrame:
    return spatial.tagged(_read_osm(spark, d)[1], {"highway": ["primary", "secondary"]}).select("id")


@query(f"WITH {t.ZONES}, k(k, a, b) AS (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(_CORNERS))}) SELECT city * 4 + k + 1 id FROM zones, k WHERE k IN (1, 3) AND x + a BETWEEN 0.2003 AND 0.8003 AND y + b BETWEEN 0.1003 AND 0.7003")
def osm_nodes_in_box(spark: SparkSession, d: str) -> DataFrame:
    return osm.tag_matches(osm.in_box(_read_osm(spark, d)[0], 0.2003, 0.1003, 0.8003, 0.7003), "k", "1|3").select("id")


@query(f"WITH {t.ZONES} SELECT city + 1000 id, CASE WHEN city = 3 THEN 2 WHEN city = 99 THEN 1 ELSE 1 END \"version\" FROM zones WHERE city <> 4 UNION ALL SELECT 1099, 1")
def osm_changed(spark: SparkSession, d: str) -> DataFrame:
    _, ways = _read_osm(spark, d)
    change = lambda key, version, what: ways.limit(0).unionByName(ways.where(f"id = {min(key, 1003)}").withColumns({"id": F.lit(key).cast("long"), "version": F.lit(version)})).withColumn("change", F.lit(what))
    changes = change(1003, 2, "modify").unionByName(change(1004, 2, "delete")).unionByName(change(1099, 1, "create"))
    return spatial.changed(ways, changes).select("id", "version")


@query(f"WITH {t.ZONES} SELECT city + 1000 id, CASE WHEN city < 5 THEN 2 ELSE 5 END refs FROM zones")
def osm_without_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways = _read_osm(spark, d)
    gone = nodes.where("id <= 20 AND element_at(tags, 'k') IN ('0', '1')").select("id")
    return osm.without(nodes, ways, gone)[1].select("id", F.size("node_refs").alias("refs"))


@query(f"WITH {t.ZONES} SELECT city + 1000 relation, 4 links FROM zones")
def osm_multipolygons(spark: SparkSession, d: str) -> DataFrame:
    """Each ring in two halves, put together again."""
    _, ways = _read_osm(spark, d)
    half = lambda k: ways.select((F.col("id") * 10 + k).alias("id"), "tags", F.slice("node_refs", *((1, 3) if k == 0 else (3, 3))).alias("node_refs"))
    member = lambda k: F.struct(F.lit("way").alias("type"), (F.col("id") * 10 + k).alias("ref"), F.lit("outer").alias("role"))
    relations = ways.select("id", F.create_map(F.lit("type"), F.lit("multipolygon")).alias("tags"), F.array(member(0), member(1)).alias("members"))
    return osm.multipolygons(relations, half(0).unionByName(half(1))).select("relation", (F.size("refs") - 1).alias("links"))


def _varint(v: int) -> bytes:
    out = b""
    while v > 0x7F:
        out, v = out + bytes([v & 0x7F | 0x80]), v >> 7
    return out + bytes([v])


def _field(number: int, value: int | bytes) -> bytes:
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _steps(values: list[int]) -> bytes:
    return b"".join(_varint((b - a) << 1 ^ (b - a) >> 63) for a, b in zip([0, *values], values))


@query(f"WITH {t.ZONES} SELECT city + 1000 id, 5 points, round(x, 6) x, round(y, 6) y FROM zones WHERE city % 2 = 0")
def pbf_buildings(spark: SparkSession, d: str) -> DataFrame:
    nodes, ways = (x.orderBy("id").collect() for x in _osm(spark, d))  # 100 nodes, 25 ways
    names = sorted({s for w in ways for pair in w.tags.items() for s in pair})
    place = {s: k + 1 for k, s in enumerate(names)}
    coordinate = lambda v: round(v * 1e7)
    dense = _field(1, _steps([n.id for n in nodes])) + _field(8, _steps([coordinate(n.lat) for n in nodes])) + _field(9, _steps([coordinate(n.lon) for n in nodes])) + _field(10, b"\0" * len(nodes))
    block = _field(1, b"".join(_field(1, s) for s in (b"", *(x.encode() for x in names)))) + _field(2, _field(2, dense))
    for w in ways:
        way = _field(1, w.id) + _field(2, b"".join(_varint(place[k]) for k in w.tags)) + _field(3, b"".join(_varint(place[v]) for v in w.tags.values())) + _field(8, _steps(w.node_refs))
        block += _field(2, _field(3, way))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    head, path = _field(1, b"OSMData") + _field(3, len(blob)), f"{fresh_path(spark, 'pbf')}/m.pbf"
    put(spark, path, struct.pack(">I", len(head)) + head + blob)
    lines = spatial.way_lines(spatial.tagged(pbf.read_ways(spark, path), {"building": None}), pbf.read_nodes(spark, path))
    first = F.element_at("coords", 1)
    return lines.select("id", F.size("coords").alias("points"), r(first["x"], "x"), r(first["y"], "y"))


# -- people --------------------------------------------------------------------------------------------------------


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations as households' places, customers as individuals, whose household is the fifth nation on: some have none."""
    households = t.zones(spark, d).withColumnRenamed("city", "household_id")
    individuals = t.table(spark, d, "customer").select(F.col("c_custkey").alias("individual_id"), (F.col("c_nationkey") + 5).alias("household_id"))
    return households, individuals


@query(f"WITH {t.ZONES} SELECT c_custkey individual_id, round(x, 6) x, round(y, 6) y FROM customer JOIN zones ON c_nationkey + 5 = city")
def people_located(spark: SparkSession, d: str) -> DataFrame:
    households, individuals = _people(spark, d)
    return spatial.located(individuals, households).select("individual_id", r("x", "x"), r("y", "y"))


@query(f"WITH k AS (SELECT c_nationkey + 5 h, count(*) n FROM customer WHERE {u(5, 'c_custkey')} < 0.05 GROUP BY 1) SELECT h household_id, n FROM k JOIN nation ON h = n_nationkey")
def people_sampled(spark: SparkSession, d: str) -> DataFrame:
    households, kept = spatial.sampled_households(*_people(spark, d), 0.05, seed=5)
    return households.join(kept.groupBy("household_id").agg(F.count("*").alias("n")), "household_id").select("household_id", "n")


@query(f"""WITH {t.OD}, f AS (SELECT o, d, sum(mass) OVER (PARTITION BY o ORDER BY d) / sum(mass) OVER (PARTITION BY o) high FROM od), c AS (SELECT c_custkey k, c_nationkey o, {u(6, 'c_custkey')} u FROM customer)
SELECT k individual_id, min(d) d FROM c JOIN f ON c.o = f.o WHERE high > u GROUP BY 1""")
def people_at_work(spark: SparkSession, d: str) -> DataFrame:
    people = t.table(spark, d, "customer").select(F.col("c_custkey").alias("individual_id"), F.col("c_nationkey").alias("o"))
    return spatial.assigned_jobs(people, t.od(spark, d).withColumnRenamed("mass", "flow"), seed=6).select("individual_id", "d")


@query(f"SELECT c_custkey individual_id, round(7 + 2 * {u(7, 'c_custkey', chr(39) + 'a' + chr(39))}, 6) away, round(16 + 2 * {u(7, 'c_custkey', chr(39) + 'b' + chr(39))}, 6) back FROM customer WHERE c_nationkey + 5 IN (SELECT n_nationkey FROM nation)")
def people_plans(spark: SparkSession, d: str) -> DataFrame:
    households, individuals = _people(spark, d)
    plans = spatial.commute_plans(spatial.located(individuals, households), seed=7)
    end = lambda k: F.get("plan.actions", F.lit(k))["end"]
    return plans.select("individual_id", r(end(0), "away"), r(end(1), "back"))


# -- networks by rule ----------------------------------------------------------------------------------------------


@query(f"{_EDGES} SELECT src + 100 src, dst + 100 dst, round(length, 6) length FROM edges")
def net_reindexed(spark: SparkSession, d: str) -> DataFrame:
    net = t.network(spark, d)
    return network.reindexed(net.with_(links=net.links.drop("mass")), 100).links.select("src", "dst", r("length", "length"))


@query("SELECT true consistent")
def net_consistent(spark: SparkSession, d: str) -> DataFrame:
    return network.consistent(t.network(spark, d))


@query(f"{_EDGES} SELECT src, dst FROM edges WHERE NOT {u(8, 'src', 'dst')} < 0.4")
def net_thinned(spark: SparkSession, d: str) -> DataFrame:
    return network.remove_random(t.network(spark, d), 0.4, 8).links.select("src", "dst")


@query(f"{_EDGES}, k AS (SELECT city FROM zones WHERE {u(8, 'city')} < 0.3) SELECT src, dst FROM edges WHERE src NOT IN (FROM k) AND dst NOT IN (FROM k)")
def net_without_random_nodes(spark: SparkSession, d: str) -> DataFrame:
    return network.remove_random(t.network(spark, d), 0.3, 8, what="nodes").links.select("src", "dst")


@query(f"{_EDGES} SELECT src, dst, CASE WHEN length > 0.4 AND {u(9, 'src', 'dst')} < 0.5 THEN 1.0 ELSE 0.0 END weight FROM edges")
def net_percolated(spark: SparkSession, d: str) -> DataFrame:
    net = t.network(spark, d)
    return network.percolate(net.with_(links=net.links.withColumn("weight", F.lit(0.0))), 0.5, 9, F.col("length") > 0.4).links.select("src", "dst", "weight")


@query(f"{_EDGES}, b AS (SELECT src a, dst b FROM edges UNION ALL SELECT dst, src FROM edges UNION ALL SELECT src, src FROM edges) SELECT least(a, b) src, greatest(a, b) dst FROM b WHERE a <> b GROUP BY 1, 2")
def net_canonical(spark: SparkSession, d: str) -> DataFrame:
    links = t.network(spark, d).links.select("src", "dst")
    back, loops = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), links.select("src", F.col("src").alias("dst"))
    return network.from_links(links.unionByName(back).unionByName(loops)).links.select("src", "dst")


@query(f"{_EDGES} SELECT DISTINCT unnest([src, dst]) id FROM edges")
def net_nodes_of_links(spark: SparkSession, d: str) -> DataFrame:
    return network.from_links(t.network(spark, d).links.select("src", "dst")).nodes.select("id")


@query("SELECT 0 nodes, 0 links")
def net_empty(spark: SparkSession, d: str) -> DataFrame:
    net = network.empty(spark)
    return net.nodes.agg(F.count("*").alias("nodes")).crossJoin(net.links.agg(F.count("*").alias("links")))


_FEW = """d0 AS (SELECT src i, dst j, length d FROM edges UNION ALL SELECT dst, src, length FROM edges UNION ALL SELECT city, city, CAST(0 AS DOUBLE) FROM zones),
""" + ",\n".join(f"d{k} AS (SELECT a.i, b.j, min(a.d + b.d) d FROM d{k - 1} a JOIN d{k - 1} b ON a.j = b.i GROUP BY 1, 2)" for k in range(1, 6))


@query(f"{_EDGES}, {_FEW} SELECT i src, j dst, round(d, 6) dist FROM d5 WHERE i IN (1, 5, 9)")
def net_paths_from_some(spark: SparkSession, d: str) -> DataFrame:
    net, some = t.network(spark, d), spark.createDataFrame([(1,), (5,), (9,)], "id int")
    return network.shortest_paths(net, some, cost="length").select("src", "dst", r("dist", "dist"))


@query(f"WITH {t.ZONES}, k AS (SELECT city, uniform_x x FROM (SELECT city, x + 0.05 * (2 * {u(3, 'city', chr(39) + 'x' + chr(39))} - 1) uniform_x FROM zones)) SELECT city id, round(x, 6) x FROM k")
def points_jittered(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.applications import jittered

    return jittered(t.zones(spark, d).withColumnRenamed("city", "id"), 0.05, seed=3).select("id", r("x", "x"))


@query(f"SELECT c_custkey, round({u(11, 'c_custkey')}, 9) v FROM customer")
def hashed_draws(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "customer").select("c_custkey", r(uniform(11, "c_custkey"), "v", 9))
