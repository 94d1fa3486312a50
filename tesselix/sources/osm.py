"""Nodes of OpenStreetMap XML as points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesselix.operators.points import points_from

SCHEMA = "_id long, _lat double, _lon double, tag array<struct<_k: string, _v: string>>"


def generated_name(id: Column, letters: int = 6) -> Column:
    """Small letters made from the id, so that a retried task makes the same."""
    return F.concat(*(F.chr(F.lit(97) + F.pmod(F.xxhash64(id, F.lit(i)), F.lit(26)).cast("int")) for i in range(letters)))


def _nodes(raw: DataFrame) -> DataFrame:
    name = F.expr("try_element_at(filter(tag, t -> t._k = 'name'), -1)._v")
    named = raw.withColumn("_name", F.when(F.length(name) > 0, name).otherwise(generated_name(F.col("_id"))))
    return points_from(named, {"x": "_lat", "y": "_lon"}, "_id", "_name")


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """id, name, x (latitude), y (longitude) of each node; ways and relations are left out. The last name tag counts; a
    missing or empty name is made from the id. A malformed document or number fails the read. Folders under path are read too."""
    return _nodes(spark.read.format("xml").option("rowTag", "node").option("mode", "FAILFAST").option("recursiveFileLookup", True).schema(SCHEMA).load(path))


def stream_osm(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """The same of documents that arrive in a folder or in folders under it, as a stream."""
    raw = spark.readStream.format("xml").option("rowTag", "node").option("mode", "FAILFAST").option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).schema(SCHEMA).load(path)
    return _nodes(raw)


def write_osm(points: DataFrame, path: str, nodes_a_document: int = 5000) -> None:
    """Points (id, name, x, y) as documents of about so many nodes, a file each."""
    text = F.col("name")
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    tag = F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit('<tag k="name" v="'), text, F.lit('"/>')))
    node = F.concat(F.lit('<node id="'), "id", F.lit('" lat="'), F.col("x").cast("string"), F.lit('" lon="'), F.col("y").cast("string"), F.lit('">'), tag, F.lit("</node>"))
    documents = 1 + points.count() // nodes_a_document
    grouped = points.groupBy(F.pmod(F.xxhash64("id"), F.lit(documents)).alias("document")).agg(F.array_join(F.collect_list(node), "\n").alias("nodes"))
    grouped.select(F.concat(F.lit("<osm>\n"), "nodes", F.lit("\n</osm>")), "document").write.partitionBy("document").text(path)
