import math
import struct

from pyspark.sql import functions as F

from terraloom.operators import generators, spatial
from terraloom.sources import graphs, osm, tables, vector
from terraloom.streaming.windows import windowed


def test_matrix_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1;NA;3\n4;5;6\n")
    got = {(r.i, r.j): r.v for r in tables.read_matrix(spark, str(tmp_path / "m.csv"), sep=";").collect()}
    assert got[1, 2] == 6 and math.isnan(got[0, 1]) and len(got) == 6
    (tmp_path / "c.csv").write_text("2,2\n0,1,2.5\n1,0,NA\n")
    rows = {(r.i, r.j): r.v for r in tables.read_coordinates(spark, str(tmp_path / "c.csv")).collect()}
    assert rows[0, 1] == 2.5 and math.isnan(rows[1, 0])
    (tmp_path / "d.csv").write_text("2,2\n0,1\n7,0\n")
    assert tables.read_sparse_from_dense(spark, str(tmp_path / "d.csv"), keep=lambda v: v > 0).count() == 2
    assert tables.read_csv(spark, str(tmp_path / "m.csv"), sep=";", header=False).columns == ["c0", "c1", "c2"]


def test_line_numbers_hold_over_partitions(spark, tmp_path):
    (tmp_path / "n.txt").write_text("".join(f"{k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = tables.numbered(spark.read.text(str(tmp_path / "n.txt")))
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where(F.col("line") != F.col("value").cast("long")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_floats(spark):
    values = [1.5, -0.1, 0.0, 3e38, 1e-40]
    df = spark.createDataFrame([(bytearray(struct.pack(">f", v)), v) for v in values], "b binary, v double")
    assert all(r.x == struct.unpack("f", struct.pack("f", r.v))[0] for r in df.select(tables.big_endian_float(F.col("b")).alias("x"), "v").collect())


def test_gml_round_trip(spark, tmp_path):
    net = generators.cross_network(spark)
    graphs.write_lines(graphs.gml_lines(net), str(tmp_path / "g"))
    back = graphs.read_gml(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, back.nodes.select("id", "x", "y").collect())) == sorted(map(tuple, net.nodes.collect()))
    assert sorted(map(tuple, back.links.collect())) == sorted(map(tuple, net.links.collect()))
    assert graphs.gexf_lines(net).count() == 3 + 5 + 4


def test_matsim_network(spark, tmp_path):
    graphs.write_lines(graphs.matsim_network_lines(generators.cross_network(spark), 13.9), str(tmp_path / "n"))
    back = graphs.read_matsim_network(spark, str(tmp_path / "n"))
    assert back.nodes.count() == 5 and back.links.count() == 8
    people = spatial.commute_plans(spark.createDataFrame([(1, 0.0, 0.0)], "individual_id long, x double, y double"))
    assert '<leg mode="car"/>' in graphs.matsim_population_lines(people).where("part = 1").first().value


def test_osm_round_trip(spark, tmp_path):
    nodes = spark.sql("SELECT explode(array(named_struct('id', 1L, 'lat', 0D, 'lon', 0D), named_struct('id', 2L, 'lat', 0D, 'lon', 1D), named_struct('id', 3L, 'lat', 1D, 'lon', 1D))) n").select("n.*").withColumns({"version": F.lit(1), "tags": F.expr("map('a', 'x<y')")})
    ways = spark.sql("SELECT 9L id, 1 version, map('building', 'yes') tags, array(1L, 2L, 3L, 1L) node_refs")
    graphs.write_lines(osm.xml_lines(nodes, ways), str(tmp_path / "o"))
    n, w = osm.read_nodes(spark, str(tmp_path / "o")), osm.read_ways(spark, str(tmp_path / "o"))
    assert n.count() == 3 and n.first().tags == {"a": "x<y"}
    found = spatial.buildings(w, n).collect()
    assert len(found) == 1 and [(p.x, p.y) for p in found[0].ring] == [(0, 0), (1, 0), (1, 1), (0, 0)]


def test_geopackage_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (3.0, 4.0, None)], "x double, y double, name string")
    vector.write_geopackage(df, str(tmp_path / "p.gpkg"), "places", ["name"])
    back = vector.read_geopackage(spark, str(tmp_path / "p.gpkg"), "places", ["name"]).collect()
    assert sorted((r.kind, r.parts[0][0].x, r.attrs.get("name")) for r in back) == [("Point", 1.0, "a"), ("Point", 3.0, None)]


def test_shapes():
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<I4dII", 5, 0, 0, 1, 1, 1, 4) + struct.pack("<I", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    shp = b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body
    found = list(vector.shapes(shp, None, None))
    assert found[0]["kind"] == "Polygon" and len(found[0]["parts"][0]) == 4
    assert vector.epsg_of('GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]') == "EPSG:4326"


def test_wkt(spark):
    row = spark.sql("SELECT 'POLYGON ((0 0, 1 0, 1 1, 0 0))' w").select(vector.wkt_points(F.col("w")).alias("p")).select("p", vector.to_wkt("polygon", F.col("p")).alias("w")).first()
    assert [(p.x, p.y) for p in row.p] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert row.w == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 0.0))"


def test_png(spark):
    image = graphs.png(generators.random_grid(spark, 5, 4, occupied=0.5, seed=1))
    assert image[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image[16:24]) == (4, 5)


def test_stream_equals_table(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    events.write.parquet(str(tmp_path / "in" / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
    query = windowed(stream, "ts", "value", "1 day", late="400 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want = {(r.start, r.n, round(r.total, 6)) for r in windowed(events, "ts", "value", "1 day").collect()}
    assert {(r.start, r.n, round(r.total, 6)) for r in spark.table("w").collect()} == want
