"""How many points lie in each of many boxes of two dimensions, without the pairs.

Distinct places, in order of x, are cut into slabs of equal size; what is in each slab, in order of y, into strips. Of a box, the
slabs and strips that lie in it whole are looked up in a table of sums; the two slabs and the two strips at most that its sides cut are
counted in, each with the parts of all boxes that cut it. So the work grows with points and boxes, not with the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tesselix.operators.points import DIMS
from tesselix.plans.ordering import numbered
from tesselix.sources.storage import materialise

#: Places of a slab; slabs (and strips) at most, whose table of sums the driver holds; parts of boxes that are counted together.
SLAB = 200_000
MOST_SLABS = 500
PARTS = 500_000
SIDES = ("u_lo", "u_hi", "v_lo", "v_hi")


def weight_below(ranks: np.ndarray, weights: np.ndarray, first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each pair of first and rank: the weights of those of the first so many rows whose rank is lower. Bit by bit of the ranks (a
    permutation), from the highest: rows with bit 0 go before those with 1, and each pair's stretch of rows goes with them."""
    low, high, out = np.zeros(len(first), np.int64), first.astype(np.int64), np.zeros(len(first), np.int64)
    for b in reversed(range(len(ranks).bit_length())):
        ones = (ranks >> b & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~ones)])
        order = np.concatenate([np.flatnonzero(~ones), np.flatnonzero(ones)])
        ranks, weights = ranks[order], weights[order]
        sums = np.concatenate([[0], np.cumsum(weights)])
        l0, h0, one = zeros[low], zeros[high], (rank >> b & 1).astype(bool)
        out += np.where(one, sums[h0] - sums[l0], 0)
        low, high = np.where(one, zeros[-1] + low - l0, l0), np.where(one, zeros[-1] + high - h0, h0)
    return out


def weight_inside(u, v, w, u_lo, u_hi, v_lo, v_hi) -> np.ndarray:
    """The weights of the points (u, v) in each closed box."""
    order = np.argsort(u, kind="stable")
    u, v, w = u[order], v[order], w[order].astype(np.int64)
    by_v = np.argsort(v, kind="stable")
    ranks = np.empty(len(v), np.int64)
    ranks[by_v] = np.arange(len(v))
    v = v[by_v]
    i, j = (np.searchsorted(u, u_lo, "left"), np.searchsorted(u, u_hi, "right")), (np.searchsorted(v, v_lo, "left"), np.searchsorted(v, v_hi, "right"))
    at = lambda a, b: weight_below(ranks, w, i[a], j[b])
    return at(1, 1) - at(0, 1) - at(1, 0) + at(0, 0)


def whole(low, high, lo, hi):
    """Of slabs in order with their least and largest value: the first and the last that lie between lo and hi whole, and the
    one or two others that may be cut (-1: none)."""
    a, b = np.searchsorted(low, lo, "left"), np.searchsorted(high, hi, "right") - 1
    left = np.where((a > 0) & (high[np.maximum(a - 1, 0)] >= lo), a - 1, -1)
    right = np.where((b + 1 < len(low)) & (low[np.minimum(b + 1, len(low) - 1)] <= hi), b + 1, -1)
    return a, b, left, np.where(right == left, -1, right)


def box_counts(points: DataFrame, boxes: DataFrame, key: tuple[str, ...], dims: tuple[str, str] = DIMS, prefix: str = "q_", slab: int = SLAB) -> DataFrame:
    """key and hits of each box (columns key, {prefix}{dim}_min and _max) that holds a point. key must tell boxes apart."""
    x, y = dims
    places = materialise(points.groupBy(F.col(x).alias("u"), F.col(y).alias("v")).agg(F.count("*").alias("w")), "places")
    slab = max(slab, -(-places.count() // MOST_SLABS))
    slabs = materialise(numbered(places, ["u", "v"], "_rn").select(F.expr(f"(_rn - 1) div {slab}").alias("part"), "u", "v", "w"), "slabs")
    rows = materialise(slabs.groupBy("part", "v").agg(F.sum("w").alias("w")), "slab-rows")
    strips = materialise(numbered(rows, ["v", "part"], "_rn").select(F.expr(f"(_rn - 1) div {slab}").alias("strip"), F.col("part").cast("double").alias("u"), "v", "w"), "strips")
    ends = lambda df, part, c: [np.array(e) for e in zip(*df.groupBy(part).agg(F.min(c), F.max(c)).orderBy(part).select(f"min({c})", f"max({c})").collect(), strict=True)] or [np.empty(0)] * 2
    across, along = ends(slabs, "part", "u"), ends(strips, "strip", "v")  # MOST_SLABS at most
    sums = np.zeros((len(across[0]) + 1, len(along[0]) + 1), np.int64)
    for s, t, w in strips.groupBy("u", "strip").agg(F.sum("w")).collect():  # MOST_SLABS squared at most
        sums[int(s) + 1, t + 1] = w
    sums = sums.cumsum(0).cumsum(1)
    sides = dict(zip(SIDES, (f"{prefix}{d}_{s}" for d in dims for s in ("min", "max")), strict=True))
    # bucket: slabs are even, strips odd, -1: looked up
    schema = StructType([*boxes.select(*key).schema.fields, StructField("bucket", LongType()), *(StructField(s, DoubleType()) for s in SIDES), StructField("hits", LongType())])

    def parts(batches):
        for b in batches:
            u_lo, u_hi, v_lo, v_hi = (b[s].to_numpy(float) for s in SIDES)
            a, z, *cut = whole(*across, u_lo, u_hi)
            c, e, *cut_y = whole(*along, v_lo, v_hi)
            inner, full = z >= a, (z >= a) & (e >= c)
            found = sums[np.where(full, z + 1, 0), np.where(full, e + 1, 0)] - sums[np.where(full, a, 0), np.where(full, e + 1, 0)] - sums[np.where(full, z + 1, 0), np.where(full, c, 0)] + sums[np.where(full, a, 0), np.where(full, c, 0)]
            own = b.assign(bucket=-1, hits=found)
            yield own[found > 0]
            for at in cut:
                yield own.assign(bucket=2 * at, hits=0)[at >= 0]
            for at in cut_y:
                yield own.assign(bucket=2 * at + 1, hits=0, u_lo=a.astype(float), u_hi=z.astype(float))[(at >= 0) & inner]

    asked = boxes.select(*key, *(F.col(c).cast("double").alias(s) for s, c in sides.items())).filter("u_lo <= u_hi AND v_lo <= v_hi")
    if not len(across[0]):
        return asked.limit(0).select(*key, F.lit(0).cast("bigint").alias("hits"))
    made = materialise(asked.mapInPandas(lambda batches: (p[schema.names] for p in parts(batches)), schema), "box-parts")
    salts = materialise(made.filter("bucket >= 0").groupBy("bucket").agg(F.expr(f"1 + count(*) div {PARTS}").alias("_salts")), "salts")  # 2 * MOST_SLABS at most
    groups = int(salts.agg(F.sum("_salts")).first()[0] or 1)
    held = slabs.select((F.col("part") * 2).alias("bucket"), "u", "v", "w").unionByName(strips.select((F.col("strip") * 2 + 1).alias("bucket"), "u", "v", "w"))
    held = held.join(F.broadcast(salts), "bucket").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))).drop("_salts")
    asking = made.join(F.broadcast(salts), "bucket").withColumn("_salt", F.pmod(F.xxhash64(*key), "_salts")).drop("_salts")

    def count(there: pd.DataFrame, parts_: pd.DataFrame) -> pd.DataFrame:
        hits = weight_inside(*(there[c].to_numpy() for c in ("u", "v", "w")), *(parts_[s].to_numpy() for s in SIDES))
        return parts_[list(key)].assign(hits=hits)

    by = ("bucket", "_salt")
    spread = lambda df: df.repartition(groups, *by).groupBy(*by)
    counted = spread(held).cogroup(spread(asking)).applyInPandas(count, StructType([*boxes.select(*key).schema.fields, StructField("hits", LongType())]))
    return counted.unionByName(made.filter("bucket < 0").select(*key, "hits")).groupBy(*key).agg(F.sum("hits").alias("hits")).filter("hits > 0")
