"""Range queries: closed boxes, one at a time or many as a join."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window
from pyspark.sql.types import LongType, StructField, StructType

from tesselix.operators.joins import tasks_for
from tesselix.operators.points import DIMS
from tesselix.sources.storage import materialise

#: Query boxes that may be broadcast, each of which all points are compared with; more of them go through the grid.
BROADCAST_QUERIES = 2_000
#: Pairs of a point and a box of its cell that a task compares.
COMPARED = 10_000_000
#: In so many deals that fall to tasks by a hash, so that tasks are about even.
DEALS = 8
#: The widest grid's cells are 2 ** this times the narrowest's.
MOST_GRIDS = 60


def range_query(points: DataFrame, low, high, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """The points in a closed box. Plain comparisons with literals, which reach the scan and prune row groups; an
    inverted box gives no rows."""
    return points.filter(reduce(lambda a, b: a & b, (F.col(d).between(F.lit(float(lo)), F.lit(float(h))) for d, lo, h in zip(dims, low, high, strict=True))))


def square(centre, r: float) -> tuple[list[float], list[float]]:
    """The window of half-side r around a centre."""
    return [c - r for c in centre], [c + r for c in centre]


def preview(hits: DataFrame, n: int, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The first n rows and, on each, the number of all, in one pass: a task gives its first n rows, the first of them with the
    task's number of rows, and these few are put in order together. order must tell rows apart."""

    def first(batches):
        best, total = None, 0
        for b in batches:
            total += b.num_rows
            both = pa.Table.from_batches([b]) if best is None else pa.concat_tables([best, pa.Table.from_batches([b])])
            best = both.sort_by([(c, "ascending") for c in order]).slice(0, n).combine_chunks()
        if best is not None:
            counts = pa.array([total] + [0] * (best.num_rows - 1), pa.int64())
            yield from best.append_column("hits", counts).to_batches()

    some = hits.mapInArrow(first, StructType([*hits.schema.fields, StructField("hits", LongType())]))
    all_ = Window.partitionBy(F.lit(0))  # n rows a task
    ranked = some.withColumns({"_rank": F.row_number().over(all_.orderBy(*order)), "hits": F.sum("hits").over(all_)})
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def range_join(points: DataFrame, queries: DataFrame, dims: tuple[str, ...] = DIMS, prefix: str = "q_", method: str = "auto", cell: tuple[float, ...] | None = None) -> DataFrame:
    """points x queries (columns {prefix}{dim}_min and _max) where the point lies in the box. Few queries are broadcast;
    many (or method='grid') are spread over grid cells, joined by cell and refined. Boxes wider than the cell go to a grid
    whose cells are twice, four times, ... as wide, so none takes more than three cells a dimension; a point has one cell in
    each grid that is in use, and a box is in one grid, so no pair comes twice."""
    inside = reduce(lambda a, b: a & b, (F.col(d).between(F.col(f"{prefix}{d}_min"), F.col(f"{prefix}{d}_max")) for d in dims))
    if method == "broadcast" or (method == "auto" and len(queries.limit(BROADCAST_QUERIES + 1).select(F.lit(1)).collect()) <= BROADCAST_QUERIES):
        return points.join(F.broadcast(queries), inside)
    if cell is None:
        sides = queries.agg(*(F.avg(F.col(f"{prefix}{d}_max") - F.col(f"{prefix}{d}_min")).alias(d) for d in dims)).first()
        cell = tuple(float(sides[d] or 1.0) or 1.0 for d in dims)
    queries = queries.filter(reduce(lambda a, b: a & b, (F.col(f"{prefix}{d}_min") <= F.col(f"{prefix}{d}_max") for d in dims)))
    wide = F.greatest(F.lit(1.0), *((F.col(f"{prefix}{d}_max") - F.col(f"{prefix}{d}_min")) / F.lit(w) for d, w in zip(dims, cell, strict=True)))
    # a box that rounding has made a little wider than the cell stays in its grid: it takes three cells at most there too
    queries = materialise(queries.withColumn("_grid", F.least(F.ceil(F.log2(wide) - F.lit(1e-9)), F.lit(MOST_GRIDS)).cast("int")), "boxes")
    grids = sorted(r["_grid"] for r in queries.select("_grid").distinct().collect())  # at most MOST_GRIDS + 1
    at = lambda c, w: F.floor(c / (F.lit(float(w)) * F.pow(F.lit(2.0), F.col("_grid"))))
    spread, own = queries, points.withColumn("_grid", F.explode(F.array(*(F.lit(i) for i in grids)).cast("array<int>")))
    for d, w in zip(dims, cell, strict=True):
        spread = spread.withColumn(f"_c_{d}", F.explode(F.sequence(at(F.col(f"{prefix}{d}_min"), w), at(F.col(f"{prefix}{d}_max"), w))))
        own = own.withColumn(f"_c_{d}", at(F.col(d), w))
    cells = ["_grid", *(f"_c_{d}" for d in dims)]
    named = lambda df: df.withColumn("_cell", F.concat_ws(":", *cells)).drop(*cells)
    own, spread = named(own), named(spread)
    counted = lambda df, n: df.groupBy("_cell").agg(F.count("*").cast("double").alias(n))
    pairs = counted(own, "_n").join(counted(spread, "_m"), "_cell").select("_cell", (F.col("_n") * F.col("_m")).alias("_pairs"))
    pairs = materialise(pairs, "cell-pairs")
    tasks = tasks_for(own, pairs.agg(F.sum("_pairs")).first()[0] or 0, COMPARED)
    # a cell's points are dealt out by as many salts as its pairs ask for, and its boxes go to each. Not broadcast, which Spark would
    # choose by the boxes' bytes before they are copied
    each = COMPARED / DEALS
    hot = F.broadcast(pairs.filter(F.col("_pairs") > each).select("_cell", F.ceil(F.col("_pairs") / F.lit(each)).cast("int").alias("_salts")))  # DEALS a task at most
    dealt = own.withColumn("_spread", F.xxhash64(*points.columns)).join(hot, "_cell", "left")
    dealt = dealt.withColumn("_salt", F.pmod("_spread", F.coalesce("_salts", F.lit(1))).cast("int")).drop("_spread", "_salts").repartition(tasks, "_cell", "_salt")
    copies = spread.join(hot, "_cell", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies.hint("merge"), ["_cell", "_salt"]).filter(inside).drop("_cell", "_salt")
