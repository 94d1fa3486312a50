"""Clustered layout on disk and the plans that profit from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from tesselix.functions import geometry as g
from tesselix.operators.index import FANOUT, leaf_of
from tesselix.operators.knn import knn
from tesselix.operators.points import DIMS, columns
from tesselix.plans.ordering import numbered

#: Leaves whose boxes the driver holds.
MOST_HELD = 100_000


def write_clustered(points: DataFrame, path: str, dims: tuple[str, ...] = DIMS, id: str = "id", rows_per_file: int = 1_000_000, row_group_bytes: int = 1 << 18) -> None:
    """Rows near each other in files and row groups near each other, so that min/max statistics prune range queries. There are as many
    files as the number of rows asks for; equal coordinates are told apart by the id, so none is hot."""
    n = points.count()
    files = max(1, -(-n // rows_per_file))
    slabs, order = max(1, round(files**0.5)), [*dims, *([id] if id in points.columns else [])]
    cut = numbered(points, order, "_rn").withColumn("_slab", F.expr(f"((_rn - 1) * {slabs}) div {max(n, 1)}")).drop("_rn")
    cut = cut.repartitionByRange(files, "_slab", dims[1], *order[len(dims) :]).sortWithinPartitions("_slab", *reversed(dims))
    cut.drop("_slab").write.option("parquet.block.size", row_group_bytes).mode("overwrite").parquet(path)


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def leaf_table(points: DataFrame, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(points with their leaf, the leaves' boxes), packed so that leaves are about square."""
    placed = leaf_of(points, dims, id, fanout, "str")
    boxes = placed.groupBy("node").agg(F.count("*").alias("entries"), *(e for d in dims for e in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"))))
    return placed, boxes


def write_index(points: DataFrame, path: str, dims: tuple[str, ...] = DIMS, id: str = "id", fanout: int = FANOUT, rows_per_file: int = 1_000_000) -> None:
    """The points, ordered by leaf, and the leaves' boxes, once for all queries: `points` and `leaves` under path."""
    placed = leaf_of(points, dims, id, fanout, "str")
    files = max(1, -(-points.count() // rows_per_file))
    placed.repartitionByRange(files, "node").sortWithinPartitions("node").write.option("parquet.block.size", 1 << 18).mode("overwrite").parquet(f"{path}/points")
    stored = points.sparkSession.read.parquet(f"{path}/points")
    boxes = stored.groupBy("node").agg(F.count("*").alias("entries"), *(e for d in dims for e in (F.min(d).alias(f"{d}_min"), F.max(d).alias(f"{d}_max"))))
    boxes.write.mode("overwrite").parquet(f"{path}/leaves")


class Index:
    """A stored index. Up to MOST_HELD leaves' boxes are held on the driver, so a query prunes without a job of its own and
    reads the leaves it needs by their numbers, which reach the scan."""

    def __init__(self, spark: SparkSession, path: str, dims: tuple[str, ...] = DIMS, id: str = "id"):
        self.dims, self.id = dims, id
        self.points, self.leaves = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/leaves")
        # one limited query: MOST_HELD rows of a few numbers at most
        held = self.leaves.select("node", "entries", *(f"{d}_{s}" for s in ("min", "max") for d in dims)).limit(MOST_HELD + 1).collect()
        self.held = np.array([tuple(r) for r in held], float).reshape(len(held), 2 + 2 * len(dims)) if len(held) <= MOST_HELD else None

    def near(self, at, k: int) -> list[int] | None:
        """The leaves that can hold one of the k nearest, by the same rule as pruned_leaves(); None if too many to hold."""
        if self.held is None:
            return None
        node, entries, low, high = self.held[:, 0], self.held[:, 1], self.held[:, 2 : 2 + len(self.dims)], self.held[:, 2 + len(self.dims) :]
        q = np.array(at, float)
        far = (np.maximum(abs(low - q), abs(high - q)) ** 2).sum(1)
        close = (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1)
        order = np.argsort(far)
        enough = np.flatnonzero(np.cumsum(entries[order]) >= k)
        reach = far[order[enough[0]]] if len(enough) else np.inf
        return sorted(int(x) for x in node[close <= reach * (1 + 1e-12)])

    def knn(self, at, k: int) -> DataFrame:
        """The k nearest, from the leaves that can hold them."""
        leaves = self.near(at, k) if k > 0 else []
        if leaves is None:
            return knn_two_phase(self.points, self.leaves, at, k, self.dims, self.id)
        some = self.points.filter(F.col("node").between(min(leaves, default=0), max(leaves, default=-1)) & F.col("node").isin(leaves))
        return knn(some.drop("node"), at, k, self.dims, self.id)


def pruned_leaves(boxes: DataFrame, at, k: int, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """The leaves that can hold one of the k nearest: `reach` is the least farthest-corner distance within which leaves
    hold k points; a leaf stays if it is no farther (so ties stay). Squared distances."""
    q = [F.lit(float(v)) for v in at]
    own = boxes.select("node", "entries", g.max_dist2(g.box("", dims), q).alias("far"), g.min_dist2(g.box("", dims), q).alias("near"))
    # k leaves by distance hold k points at least, so the window sees k rows
    some = own.orderBy("far", "node").limit(k)
    upto = some.withColumn("held", F.sum("entries").over(Window.orderBy("far", "node").rowsBetween(Window.unboundedPreceding, 0)))
    reach = upto.agg(F.min(F.when(F.col("held") >= k, F.col("far"))).alias("reach"))
    # a last bit of rounding must not drop a leaf
    return own.crossJoin(F.broadcast(reach)).filter(F.col("reach").isNull() | (F.col("near") <= F.col("reach") * F.lit(1 + 1e-12))).select("node")


def knn_two_phase(placed: DataFrame, boxes: DataFrame, at, k: int, dims: tuple[str, ...] = DIMS, id: str = "id") -> DataFrame:
    """The k nearest, looked for in the leaves that can hold them only."""
    if k <= 0:
        return knn(placed.drop("node"), at, 0, dims, id)
    return knn(placed.join(pruned_leaves(boxes, at, k, dims), "node", "left_semi").drop("node"), at, k, dims, id)


def skyline_prefix(points: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """Points not dominated by the least of a partition: a cheap first pass for wide inputs. A point may meet the least of a
    partition that is not its own, or none: what any point dominates is in no skyline, and what meets none stays."""
    best = points.groupBy(F.spark_partition_id().alias("_p")).agg(F.min_by(F.struct(*dims), sum(columns(dims)[1:], F.col(dims[0]))).alias("_b"))
    met = points.withColumn("_p", F.spark_partition_id()).join(F.broadcast(best), "_p", "left")  # a row a partition
    return met.filter(~F.coalesce(g.dominates([F.col(f"_b.{d}") for d in dims], columns(dims)), F.lit(False))).select(*points.columns)
