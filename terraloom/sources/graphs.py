"""Network files: GML, GEXF, MATSim network and population XML, and PNG images of grids."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.network import Network
from .tables import numbered


def read_gml(spark: SparkSession, path: str) -> Network:
    """Nodes (id, x, y, attrs) and links (src, dst, weight, length) of a GML file.

    Lines open and close node and edge blocks; a running count of openings names each block, which is then one group of key-value lines.
    """
    from pyspark.sql import Window

    lines = numbered(spark.read.text(path)).select("line", F.trim("value").alias("t"))
    opens = F.when(F.rlike("t", F.lit(r"^(node|edge)\b")), 1).otherwise(0)
    order = Window.partitionBy().orderBy("line")  # one file, in its order: a GML file is read whole
    rows = lines.withColumn("block", F.sum(opens).over(order)).where("block > 0")
    kind = F.max(F.regexp_extract("t", r"^(node|edge)\b", 1)).alias("kind")
    pair = F.rlike("t", F.lit(r"^\w+\s+\S"))
    entries = F.map_from_entries(F.collect_list(F.when(pair & ~F.rlike("t", F.lit(r"^(node|edge|graph)\b")), F.struct(F.regexp_extract("t", r"^(\w+)", 1), F.trim(F.regexp_replace(F.regexp_extract("t", r"^\w+\s+(.*)$", 1), '^"|"$', ""))))))
    blocks = rows.groupBy("block").agg(kind, entries.alias("m"))
    get = lambda k: F.element_at("m", k)
    nodes = blocks.where("kind = 'node'").select(get("id").cast("long").alias("id"), get("x").cast("double").alias("x"), get("y").cast("double").alias("y"), F.map_filter("m", lambda k, v: ~k.isin("id", "x", "y")).alias("attrs"))
    links = blocks.where("kind = 'edge'").select(get("source").cast("long").alias("src"), get("target").cast("long").alias("dst"), F.coalesce(get("weight").cast("double"), F.lit(1.0)).alias("weight"), F.coalesce(get("length").cast("double"), F.lit(1.0)).alias("length"))
    return Network(nodes, links)


def gml_lines(net: Network) -> DataFrame:
    """The text of a GML file, in order: part, value."""
    node = F.format_string('  node [\n    id %d\n    x %s\n    y %s\n  ]', F.col("id"), F.col("x").cast("string"), F.col("y").cast("string"))
    edge = F.format_string('  edge [\n    source %d\n    target %d\n    weight %s\n    length %s\n  ]', F.col("src"), F.col("dst"), F.col("weight").cast("string"), F.col("length").cast("string"))
    spark = net.nodes.sparkSession
    ends = spark.createDataFrame([(0, f"graph [\n  directed {int(net.directed)}"), (3, "]")], "part int, value string")
    return ends.unionByName(net.nodes.select(F.lit(1).alias("part"), node.alias("value"))).unionByName(net.links.select(F.lit(2).alias("part"), edge.alias("value")))


def gexf_lines(net: Network) -> DataFrame:
    node = F.format_string('<node id="%d"/>', F.col("id"))
    edge = F.format_string('<edge source="%d" target="%d" weight="%s"/>', F.col("src"), F.col("dst"), F.col("weight").cast("string"))
    spark, kind = net.nodes.sparkSession, "directed" if net.directed else "undirected"
    ends = spark.createDataFrame([(0, f'<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="{kind}"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")], "part int, value string")
    return ends.unionByName(net.nodes.select(F.lit(1).alias("part"), node.alias("value"))).unionByName(net.links.select(F.lit(3).alias("part"), edge.alias("value")))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def matsim_network_lines(net: Network, speed: float) -> DataFrame:
    """MATSim network XML; undirected links are written both ways."""
    both = net.links if net.directed else net.links.unionByName(net.links.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    node = F.format_string('<node id="%d" x="%s" y="%s"/>', F.col("id"), F.col("x").cast("string"), F.col("y").cast("string"))
    link = F.format_string('<link id="%d_%d" from="%d" to="%d" length="%s" freespeed="%s" capacity="1000.0" permlanes="1.0" modes="car"/>', F.col("src"), F.col("dst"), F.col("src"), F.col("dst"), F.col("length").cast("string"), F.lit(str(speed)))
    ends = net.nodes.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="utf-8"?>\n<network>\n<nodes>'), (2, "</nodes>\n<links>"), (4, "</links>\n</network>")], "part int, value string")
    return ends.unionByName(net.nodes.select(F.lit(1).alias("part"), node.alias("value"))).unionByName(both.select(F.lit(3).alias("part"), link.alias("value")))


def matsim_population_lines(individuals: DataFrame) -> DataFrame:
    """MATSim population XML of (individual_id, plan), plans as commute_plans makes them."""
    act = lambda a: F.concat(F.lit('<activity type="'), _escaped(a["type"]), F.lit('" x="'), a["x"].cast("string"), F.lit('" y="'), a["y"].cast("string"), F.lit('" end_time="'), a["end"].cast("string"), F.lit('"/>'))
    steps = F.transform("plan.actions", lambda a, k: F.concat(act(a), F.coalesce(F.concat(F.lit('<leg mode="'), F.get("plan.legs", k), F.lit('"/>')), F.lit(""))))
    person = F.concat(F.lit('<person id="'), F.col("individual_id").cast("string"), F.lit('"><plan selected="yes">'), F.array_join(steps, ""), F.lit("</plan></person>"))
    ends = individuals.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="utf-8"?>\n<population>'), (2, "</population>")], "part int, value string")
    return ends.unionByName(individuals.select(F.lit(1).alias("part"), person.alias("value")))


def read_matsim_network(spark: SparkSession, path: str) -> Network:
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", "_id string, _x double, _y double").select(F.xxhash64("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    links = read("link", "_from string, _to string, _length double").select(F.xxhash64("_from").alias("src"), F.xxhash64("_to").alias("dst"), F.lit(1.0).alias("weight"), F.col("_length").alias("length"))
    return Network(nodes, links, directed=True)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (part, value) as one text file: XML and GML have one root, so the file has one writer, which streams."""
    lines.repartition(1).sortWithinPartitions("part", "value").select("value").write.text(path)


def png(grid: DataFrame, *, limit: int = 4_000_000) -> bytes:
    """A grid as a grey PNG, value 1 black and others white; made on the driver, for at most ``limit`` cells."""
    rows = grid.select("i", "j", (F.col("v") == 1).alias("on")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"an image has at most {limit} cells")
    height, width = 1 + max(r.i for r in rows), 1 + max(r.j for r in rows)
    lines = [bytearray(b"\x00" + b"\xff" * width) for _ in range(height)]
    for r in rows:
        if r.on:
            lines[r.i][r.j + 1] = 0
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(map(bytes, lines)))) + chunk(b"IEND", b"")
