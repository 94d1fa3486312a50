"""Packing: minimum bin slack over a histogram of remaining lengths.

A text longer than the window is cut into whole windows and a remainder; everything else stays whole. What is left to
pack is a multiset of lengths from 1 to the window, which is at most `window` counts whatever the input. A window is
filled by the longest length left and the multiset of further lengths that comes closest to the room beside it: a
subset-sum dynamic programme over bitsets (one bit a reachable sum), lengths in binary portions of their counts,
backtracked to counts. The filling is repeated as long as its counts last, so a plan has at most a few thousand
fillings, each of which uses up a length. Pieces take the places of the plan by their rank among pieces of their length.
Where pieces carry their ids they are not moved for it: they lie in files, a file's pieces have the ranks from its
offset on, in the order they lie in, and a task reads its files and gives out the places.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F, Window

from tesselix.llm.common import gapless, materialise, text_or_empty, unused
from tesselix.llm.files import store
from tesselix.llm.tokens import TOGETHER, encoded
from tesselix.sources.shipping import ship

PIECE = "doc_id {id}, start bigint, length bigint, ids binary, doc_tokens bigint"


#: Bytes of text encoded together where rows carry their ids: more time, less memory.
HEAVY_BYTES = 1 << 21


def pieces(docs: DataFrame, path: str, window: int = 4096, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", together: int = TOGETHER) -> DataFrame:
    """The ids of each text (a null one is empty), then `end`, cut into pieces of at most `window`: doc_id, start (its
    text's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens. Lazy, one pass, nothing shuffled.
    A text without ids (empty, and end is None) has no piece. Repeated rows and null ids are rows like others."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))

    def run(batches):
        for rows, ids, at in encoded(batches, "_text", path, end, together):
            n = np.diff(at)
            count = -(-n // window)
            of = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(n[of] - start, window)
            cut = np.concatenate([[0], np.cumsum(length)]) * 4
            data = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(of)), pa.array(start), pa.array(length), data.cast(pa.binary()), pa.array(n[of])], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return picked.mapInArrow(run, PIECE.format(id=dict(picked.dtypes)["doc_id"]))


def fill(room: int, left: dict[int, int]) -> dict[int, int]:
    """The counts of lengths (at most those left) whose sum is at most `room` and closest to it; of several, one of
    few, long pieces."""
    reach, steps, all_bits = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        count, portion = min(left[length], room // length), 1
        while count and not reach >> room & 1:
            portion = min(portion, count)
            steps.append((length, portion, reach))
            reach |= reach << (length * portion) & all_bits
            count -= portion
            portion *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, portion, before in reversed(steps):
        if not before >> at & 1:
            at -= length * portion
            used[length] += portion
    return dict(used)


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, pieces a sequence, first sequence, first offset): pieces of `length` whose rank is in
    the interval go, so many in each, to the sequences from the first one on, side by side from the offset."""
    left, taken, out, sequence = {k: n for k, n in counts.items() if n}, Counter(), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        beside = fill(window - longest, {k: n for k, n in left.items() if n})
        left[longest] += 1
        used = Counter(beside)
        used[longest] += 1
        times = min(left[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            out.append((length, taken[length], times * n, n, sequence, offset))
            taken[length] += times * n
            offset += n * length
            left[length] -= times * n
            if not left[length]:
                del left[length]
        sequence += times
    return out


def _places(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank below which this place takes pieces, first rank, pieces a sequence, first sequence, first offset),
    ascending. At most 90 different lengths fit a window together and each filling uses one up: 90 * window rows, 15 MB."""
    return sorted((length, first + n, first, each, sequence, offset) for length, first, n, each, sequence, offset in plan(counts, window))


def _counts(rows: DataFrame) -> dict[int, int]:
    return {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows


def place(rows: DataFrame, window: int = 4096, order: tuple[str, ...] = ("doc_id", "start"), rows_per_task: int = 250_000) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length from 1 to `window`; other columns stay, whatever their names. Pieces of one
    sequence lie side by side from offset 0. An empty table gives no rows. rows must be cheap to read twice."""
    spark, counts = rows.sparkSession, _counts(rows)
    by_length: dict[int, list] = {}
    for length, *rest in _places(counts, window):
        by_length.setdefault(length, []).append(tuple(rest))
    rank, found, p = unused(rows, "_rank", "_places", "_p")
    places = spark.createDataFrame([(k, v) for k, v in by_length.items()], f"length bigint, {found} array<struct<upto: bigint, first: bigint, each: bigint, sequence: bigint, at: bigint>>")
    ranked = gapless(rows, ["length"], list(order), rank, 1 + sum(counts.values()) // rows_per_task)
    joined = ranked.join(F.broadcast(places), "length")  # bounded by _places()
    joined = joined.withColumn(p, F.expr(f"element_at(filter({found}, x -> x.upto > {rank}), 1)"))
    own = F.col(rank) - F.col(f"{p}.first")
    return joined.select(*rows.columns, F.expr(f"{p}.sequence + ({rank} - {p}.first) div {p}.each").alias("sequence_id"), (F.col(f"{p}.at") + own % F.col(f"{p}.each") * F.col("length")).alias("offset"))


def place_files(rows: DataFrame, window: int = 4096, batch_rows: int = 2_000) -> DataFrame:
    """place() for pieces in Parquet files that stay as they are (a table just written): only their lengths are
    counted and summed up; the files are read in place, `batch_rows` rows at a time."""
    spark = rows.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(np.array(_places(_counts(rows), window), np.int64).reshape(-1, 6))
    lengths = rows.select("length", F.col("_metadata.file_path").alias("file")).groupBy("file", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    starts = lengths.select("file", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    files = starts.groupBy("file").agg(F.collect_list("length").alias("lengths"), F.collect_list("start").alias("starts"))  # at most `window` lengths
    files = materialise(files, "piece-files")
    names = rows.columns
    schema = rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        # length and rank in one number, ascending
        places = held.value
        upto = (places[:, 0] << 48) + places[:, 1]
        for b in batches:
            for file, own, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                next_rank = np.zeros(window + 1, np.int64)
                next_rank[own] = start
                fs, path = store(file)
                with fs.open_input_file(path) as f:
                    for got in pq.ParquetFile(f).iter_batches(batch_rows, columns=names):
                        length = got.column("length").to_numpy().astype(np.int64)
                        order = np.argsort(length, kind="stable")
                        n = np.bincount(length, minlength=window + 1)
                        rank = np.empty(len(length), np.int64)
                        rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(next_rank, n)
                        next_rank += n
                        _, _, first, each, sequence, at = places[np.searchsorted(upto, (length << 48) + rank, "right")].T
                        yield pa.RecordBatch.from_arrays([*(got.column(c) for c in names), pa.array(sequence + (rank - first) // each), pa.array(at + (rank - first) % each * length)], [*names, "sequence_id", "offset"])

    # by number: the rows are small, the files are not
    tasks = max(files.count(), 1)
    return files.repartition(tasks, "file").select("file", "lengths", "starts").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = 4096, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all texts: one row a piece with its ids, sequence_id and offset. The pieces are written once."""
    return place_files(materialise(pieces(docs, path, window, end, id_col, text_col, HEAVY_BYTES), "pieces"), window)
