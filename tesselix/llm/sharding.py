"""Sharding: longest-processing-time scheduling of groups that must stay together.

Groups (equal texts) are ordered by size, largest first, and each goes to the least-loaded shard. LPT looks at sizes
only, so it runs over the histogram of sizes instead of over groups, and gives the heap's loads exactly. The heap's
decisions for a size come out as rank intervals, one per shard, and the groups of that size take them by their rank.

k different sizes take k * k / 2 bytes at least, so the histogram has at most the root of twice the input's bytes rows. The
driver takes it partition by partition, in order, and writes the plan in parts of PLAN_ROWS rows: it never holds all of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import fresh_path, gapless, materialise, text_or_empty

#: Beside a text's bytes, what a row takes in a shard.
ROW_BYTES = 16
#: Sizes whose plan is written together.
PLAN_ROWS = 50_000
PLAN = "_size long, _to array<int>, _upto array<long>"


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard gets when each goes to the least-loaded one (lowest number on
    ties); loads are updated. The items take the `count` smallest of the loads' arithmetic progressions, so all but the
    last few are dealt by a search for the level they fill up to; the heap deals those."""
    step = max(size, 1)
    given = [0] * len(loads)
    if count == 1:
        i = loads.index(min(loads))
        given[i], loads[i] = 1, loads[i] + size
        return given
    low, high = min(loads), max(loads) + step * (count // len(loads) + 2)

    def below(level: int) -> int:
        return sum(-(-(level - x) // step) for x in loads if x < level)

    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if below(mid) <= count else (low, mid - 1)
    for i, x in enumerate(loads):
        if x < low:
            given[i] = -(-(low - x) // step)
    heap = [(x + given[i] * step, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count - sum(given)):
        x, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (x + step, i))
    for i, n in enumerate(given):
        loads[i] += n * size
    return given


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(size, groups of it), largest first -> (size, shards, ranks below which they take groups)."""
    loads = [0] * shards
    for size, count in sizes:
        to, upto, at = [], [], 0
        for i, n in enumerate(deal(loads, size, count)):
            if n:
                at += n
                to.append(i)
                upto.append(at)
        yield size, to, upto


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 250_000) -> DataFrame:
    """Puts every row into one of `shards`: doc_id, size, text_crc32, group_sha256, shard, slot.

    Rows of equal text are one group and share a shard. A null text counts as empty (size 16, crc32 0) and is in the
    group of the empty texts. Repeated rows each get a slot; a null id sorts first in its bucket. An empty table gives
    no rows. Other columns of docs are not looked at. One group larger than a fair share makes its shard that much
    larger: groups stay together. Slots run from 0 without gaps, in no particular order.
    """
    spark, text = docs.sparkSession, text_or_empty(text_col)
    data = text.cast("binary")
    rows = materialise(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("group_sha256")),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("group_sha256").agg(F.sum("size").alias("_size")), "shard-groups")
    histogram = materialise(groups.groupBy("_size").agg(F.count("*").alias("n")), "shard-sizes")
    path, part = fresh_path(spark, "shard-plan"), []

    def flush() -> None:
        spark.createDataFrame(part, PLAN).coalesce(1).write.mode("append").parquet(path)
        part.clear()

    for row in schedule(((r["_size"], r["n"]) for r in histogram.orderBy(F.desc("_size")).toLocalIterator()), shards):
        part.append(row)
        if len(part) >= PLAN_ROWS:
            flush()
    flush()
    plan = spark.read.schema(PLAN).parquet(path)
    buckets = 1 + rows.count() // rows_per_task
    ranked = gapless(groups, ["_size"], ["group_sha256"], "_rank", buckets)
    placed = ranked.join(plan, "_size").select("group_sha256", F.expr("element_at(_to, 1 + size(filter(_upto, x -> x <= _rank)))").alias("shard"))
    # A group with a third of all rows is one hot key here; the join splits it (AQE's skew join), the groups' side has a row a key.
    placed_rows = materialise(rows.join(placed, "group_sha256"), "shard-placed")
    return gapless(placed_rows, ["shard"], ["doc_id", "group_sha256"], "slot", buckets)
