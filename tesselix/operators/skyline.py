"""Skylines: the rows that no row dominates, all dimensions to be small."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tesselix.functions import geometry as g
from tesselix.operators.counting import box_counts
from tesselix.operators.index import leaf_of
from tesselix.operators.joins import dealt_join, hot_keys
from tesselix.operators.points import DIMS, blocks, columns, live, placed
from tesselix.plans.ordering import running_min_before
from tesselix.sources.storage import materialise

#: Points of least sum that a first pass filters by.
STRONG = 64
#: Points, or leaves, that are broadcast together.
BLOCK = 100_000
#: Points of a leaf in the last step, and points that go without leaves.
CELL = 256
FEW = 2_000


def skyline(points: DataFrame, dims: tuple[str, ...] = DIMS, key: tuple[str, ...] = ("id",), duplicates: str = "all", rule: str = "all") -> DataFrame:
    """duplicates='first': one row, that of the smallest key, for each coordinate of the skyline; 'all': each of them.
    rule: which ids are live. Rows with null or NaN coordinates are left out."""
    rows = placed(live(points, rule), dims)
    coords = sweep(rows, dims) if len(dims) == 2 else undominated(rows, dims)
    if duplicates == "all":
        return rows.join(coords, list(dims), "left_semi").select(*points.columns)
    kept = rows.join(coords, list(dims), "left_semi").groupBy(*dims).agg(F.min(F.struct(*key, *(c for c in points.columns if c not in (*key, *dims)))).alias("_r"))
    return kept.select(*dims, "_r.*").select(*points.columns)


def strong_filter(coords: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Without most of the dominated: those that one of the STRONG points of least sum dominates."""
    total = sum(columns(dims)[1:], F.col(dims[0]))
    strong = coords.orderBy(total, *dims).limit(STRONG).select(*(F.col(d).alias(f"_s_{d}") for d in dims))
    return coords.join(F.broadcast(strong), g.dominates(columns(dims, "_s_"), columns(dims)), "left_anti")  # STRONG rows


def sweep(rows: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Skyline coordinates in two dimensions: by x, then y, those with y below every y before."""
    x, y = dims
    lowest = strong_filter(rows.groupBy(x).agg(F.min(y).alias(y)), dims)
    before = running_min_before(lowest, [x, y], y, "_before")
    return before.filter(F.col("_before").isNull() | (F.col(y) < F.col("_before"))).select(*dims)


def undominated(rows: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Skyline coordinates in any number of dimensions: distinct ones, without what a few strong points dominate,
    without what is dominated in its own partition, and then leaf against leaf of those left: only leaves whose boxes can reach
    one another are compared."""
    coords = strong_filter(rows.select(*dims).distinct(), dims)

    # by direction from the least corner, so that a partition's points are alike and few of them are left
    low = coords.agg(*(F.min(d).alias(d) for d in dims)).first()
    angles = [F.atan2(F.col(d) - F.lit(float(low[d] or 0.0)), sum((F.col(e) - F.lit(float(low[e] or 0.0)) for e in dims[i + 2 :]), F.col(dims[i + 1]) - F.lit(float(low[dims[i + 1]] or 0.0)))) for i, d in enumerate(dims[:-1])]
    coords = coords.repartitionByRange(*angles)

    def local(batches):
        best = np.empty((0, len(dims)))
        for b in batches:
            p = np.concatenate([best, b.to_numpy(float)])
            p = p[np.lexsort([*p.T[::-1], p.sum(1)])]
            kept: list[np.ndarray] = []
            while len(p):  # the row of least sum is not dominated; it takes out what it dominates
                kept.append(p[0])
                p = p[1:][(p[1:] < p[0]).any(1)]
            best = np.array(kept).reshape(-1, len(dims))
        yield pd.DataFrame(best, columns=list(dims))

    left = materialise(coords.mapInPandas(local, coords.schema), "local-skylines")
    if left.count() <= FEW:
        other = F.broadcast(left.select(*(F.col(d).alias(f"_o_{d}") for d in dims)))
        return left.join(other, g.dominates(columns(dims, "_o_"), columns(dims)), "left_anti")
    packed = materialise(leaf_of(left.withColumn("_h", F.xxhash64(*dims)), dims, "_h", CELL, "str").select(*dims, "node"), "packed")
    pairs = materialise(meeting(packed, dims), "meeting")
    return left.join(beaten(packed, pairs, dims), list(dims), "left_anti")


def meeting(packed: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """a, b, n_a, n_b: leaves a that may hold a point dominating one of leaf b. Leaves of which another dominates every point are
    left out on both sides: what dominates there is dominated itself, by a point that stays."""
    box = [e for d in dims for e in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"))]
    leaves = materialise(packed.groupBy("node").agg(F.count("*").alias("n"), *box), "leaves")

    def named(side):
        return [F.col("node").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(f"{d}_{s}").alias(f"{side}_{d}_{s}") for d in dims for s in ("min", "max"))]

    def against(left, right, reaches):  # one row a CELL points on either side; one goes out in blocks of bounded size
        parts = [right.join(F.broadcast(x), reaches) for x in blocks(left, "a", BLOCK)]
        return reduce(DataFrame.unionByName, parts)

    below = g.dominates([F.col(f"a_{d}_max") for d in dims], [F.col(f"b_{d}_min") for d in dims])
    dead = materialise(against(leaves.select(*named("a")), leaves.select(*named("b")), below).select(F.col("b").alias("node")).distinct(), "dead")
    alive = materialise(leaves.join(dead, "node", "left_anti"), "alive")
    reaches = reduce(lambda p, q: p & q, (F.col(f"a_{d}_min") <= F.col(f"b_{d}_max") for d in dims))
    return against(alive.select(*named("a")), alive.select(*named("b")), reaches).select("a", "b", "n_a", "n_b")


def beaten(packed: DataFrame, pairs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Coordinates that are in no skyline: those of leaves that are in no pair, and those that a point of a leaf they meet dominates. A pair
    is CELL by CELL comparisons at most; the points of leaves that many meet are dealt out by a salt."""
    alive = pairs.select(F.col("b").alias("node")).distinct()  # a leaf that is not dominated meets itself
    asked = materialise(packed.select(*(F.col(d).alias(f"_b_{d}") for d in dims), F.col("node").alias("b")).join(pairs.select("a", "b"), "b").withColumnRenamed("a", "node").drop("b"), "asked")
    met = dealt_join(asked, packed, "node", f"_b_{dims[0]}", hot_keys(asked, "node"))
    lost = met.filter(g.dominates(columns(dims), columns(dims, "_b_"))).select(*(F.col(f"_b_{d}").alias(d) for d in dims))
    return packed.join(alive, "node", "left_anti").select(*dims).unionByName(lost).distinct()


def dominance_counts(points: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id") -> DataFrame:
    """How many rows each row dominates; rows that dominate none are absent."""
    if len(dims) == 2:
        return _counted(points, dims, id)
    a = points.select(F.col(id).alias("id"), *(F.col(d).alias(f"_a_{d}") for d in dims))
    counts = None
    for part in blocks(points, id, BLOCK):
        b = part.select(*(F.col(d).alias(f"_b_{d}") for d in dims))
        own = a.join(F.broadcast(b), g.dominates(columns(dims, "_a_"), columns(dims, "_b_"))).groupBy("id").agg(F.count("*").alias("dominated"))
        counts = own if counts is None else counts.unionByName(own)
    return counts.groupBy("id").agg(F.sum("dominated").alias("dominated"))


def _counted(points: DataFrame, dims: tuple[str, str], id: str) -> DataFrame:
    """The same in two dimensions, without the pairs: the rows above and to the right of a place, less those at it."""
    points = materialise(placed(points.select(F.col(id).alias("id"), *dims), dims), "counted")
    places = materialise(points.groupBy(*dims).agg(F.count("*").alias("_w")), "places")
    beyond = [e for d in dims for e in (F.col(d).alias(f"q_{d}_min"), F.lit(float("inf")).alias(f"q_{d}_max"))]
    hits = box_counts(points, places.select(*dims, *beyond), dims, dims)
    over = hits.join(places, list(dims)).select(*dims, (F.col("hits") - F.col("_w")).alias("dominated")).filter("dominated > 0")
    return points.join(over, list(dims)).groupBy("id").agg(F.sum("dominated").alias("dominated"))
