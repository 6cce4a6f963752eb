"""OSM XML as tables: nodes (id, version, lat, lon, tags), ways (id, version, tags, node_refs), relations (id, version, tags, members)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import _escaped

_TAGS = "tag array<struct<_k:string,_v:string>>"


def _tags() -> Column:
    return F.map_from_entries(F.transform(F.coalesce("tag", F.array()), lambda t: F.struct(t["_k"], t["_v"]))).alias("tags")


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, "node", f"_id long, _version int, _lat double, _lon double, {_TAGS}").select(F.col("_id").alias("id"), F.col("_version").alias("version"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), _tags())


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path, "way", f"_id long, _version int, nd array<struct<_ref:long>>, {_TAGS}")
    return rows.select(F.col("_id").alias("id"), F.col("_version").alias("version"), _tags(), F.transform(F.coalesce("nd", F.array()), lambda n: n["_ref"]).alias("node_refs"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path, "relation", f"_id long, _version int, member array<struct<_type:string,_ref:long,_role:string>>, {_TAGS}")
    members = F.transform(F.coalesce("member", F.array()), lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), m["_role"].alias("role")))
    return rows.select(F.col("_id").alias("id"), F.col("_version").alias("version"), _tags(), members.alias("members"))


def xml_lines(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """OSM XML of nodes and ways: part, value."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit('<tag k="'), _escaped(e["key"]), F.lit('" v="'), _escaped(e["value"]), F.lit('"/>'))), "")
    node = F.concat(F.format_string('<node id="%d" version="%d" lat="%s" lon="%s">', "id", "version", F.col("lat").cast("string"), F.col("lon").cast("string")), tags, F.lit("</node>"))
    refs = F.array_join(F.transform("node_refs", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    way = F.concat(F.format_string('<way id="%d" version="%d">', "id", "version"), refs, tags, F.lit("</way>"))
    ends = nodes.sparkSession.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">'), (3, "</osm>")], "part int, value string")
    return ends.unionByName(nodes.select(F.lit(1).alias("part"), node.alias("value"))).unionByName(ways.select(F.lit(2).alias("part"), way.alias("value")))


def in_box(nodes: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return nodes.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def tag_matches(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Objects whose tag matches a regular expression of alternatives."""
    return df.where(F.rlike(F.element_at("tags", key), F.lit(f"^(?:{pattern})$")))


def without(nodes: DataFrame, ways: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes removed by id, and with them from the ways' references; ways left with under two nodes go."""
    ids = gone.select(F.col("id").alias("ref")).distinct()
    parts = ways.select("id", F.posexplode("node_refs").alias("k", "ref")).join(ids, "ref", "left_anti")
    left = parts.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ref"))), lambda s: s["ref"]).alias("node_refs"))
    return nodes.join(ids.withColumnRenamed("ref", "id"), "id", "left_anti"), ways.drop("node_refs").join(left, "id").where(F.size("node_refs") > 1)


def multipolygons(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """relation, role, refs: closed rings assembled from the way members of multipolygon relations; pieces are joined end to end, one task a relation's members."""
    import pyarrow as pa

    members = relations.where(F.element_at("tags", "type") == "multipolygon").select(F.col("id").alias("relation"), F.explode("members").alias("m")).where("m.type = 'way'").select("relation", F.col("m.ref").alias("id"), F.when(F.col("m.role") == "inner", "inner").otherwise("outer").alias("role"))
    parts = members.join(ways.select("id", "node_refs"), "id")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pieces = [list(p) for p in table.sort_by("id")["node_refs"].to_pylist() if len(p) > 1]
        rings = [p for p in pieces if p[0] == p[-1]]
        open_ = [p for p in pieces if p[0] != p[-1]]
        while open_:
            ring = open_.pop(0)
            while ring[0] != ring[-1]:
                hit = next((k for k, p in enumerate(open_) if ring[-1] in (p[0], p[-1])), None)
                if hit is None:
                    break
                p = open_.pop(hit)
                ring += p[1:] if p[0] == ring[-1] else p[-2::-1]
            if ring[0] == ring[-1]:
                rings.append(ring)
        return pa.table({"relation": pa.array([key[0].as_py()] * len(rings), pa.int64()), "role": pa.array([key[1].as_py()] * len(rings), pa.string()), "refs": pa.array(rings, pa.list_(pa.int64()))})

    return parts.groupBy("relation", "role").applyInArrow(run, "relation long, role string, refs array<long>")
