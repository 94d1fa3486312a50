"""Connected components as DataFrames: alternating large and small stars, nothing on the driver but counts
and the few nodes that many links share, whose rows are dealt out by a salt."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import hot_keys, materialise, salted_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node of its component (also for the root itself).
    Links of a node to itself, with nulls, and repeated ones count for nothing."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges, before = materialise(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both, least, "u", "v", hot_keys(both, "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted_join(large, least, "u", "v", hot_keys(large, "u"))
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
