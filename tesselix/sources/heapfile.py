"""Block files of fixed slots as a Spark data source: spark.read.format("tesselix_heap").

A file holds consecutive blocks of 32,768 bytes: the number of its records (4 bytes), then records of an id (8), a name (256,
filled up with NUL) and the coordinates (8 each), little-endian. Its name says its first block and how many there are, so an
address is a file and an offset: a filter on block_id becomes seeks, and only the blocks asked for are read.

Writing: rows with block_id and slot_id (heap.addressed), blocks whole within a task. A task's files have names of their own until the
job is committed, so a task that is run again leaves nothing that is read. Appends go after the last block. A null name is an
empty one; names are cut as heap.stored_name does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tesselix.operators import heap
from tesselix.operators.points import DIMS
from tesselix.sources.shipping import ship

FORMAT = "tesselix_heap"
BLOCKS_PER_FILE = 4096
#: Blocks that a task reads.
BLOCKS_PER_TASK = 1024


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def record(dims: list[str]) -> np.dtype:
    return np.dtype([("id", "<i8"), ("name", f"S{heap.NAME_BYTES}"), *((d, "<f8") for d in dims)])


def _dims(options) -> list[str]:
    return options.get("dims", ",".join(DIMS)).split(",")


class HeapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "block_id bigint, slot_id bigint, id bigint, name string, " + ", ".join(f"{d} double" for d in _dims(self.options))

    def reader(self, schema) -> HeapReader:
        return HeapReader(self.options["path"], _dims(self.options))

    def writer(self, schema, overwrite: bool) -> HeapWriter:
        return HeapWriter(self.options["path"], _dims(self.options))


@dataclass
class Blocks(InputPartition):
    """Runs of blocks of a file: (first, how many)."""

    file: str
    first: int
    runs: list[tuple[int, int]]


def files_of(path: str) -> list[tuple[int, int, str]]:
    """First block, number of blocks and name of each file."""
    fs, folder = _store(path)
    found = []
    for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        parts = f.base_name.removesuffix(".bin").split("-")
        if f.base_name.startswith("heap-") and f.base_name.endswith(".bin"):
            found.append((int(parts[1]), int(parts[2]), f.base_name))
    return sorted(found)


class HeapReader(DataSourceReader):
    def __init__(self, path: str, dims: list[str]):
        self.path, self.dims = path, dims
        self.low, self.high, self.wanted = -(2**62), 2**62, None

    def pushFilters(self, filters) -> Iterator:  # noqa: N802
        """Bounds and lists of block_id; Spark applies all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("block_id",):
                if isinstance(f, (EqualTo, In)):
                    some = {v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                    self.wanted = some if self.wanted is None else self.wanted & some
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[Blocks]:
        out = []
        wanted = None if self.wanted is None else np.array(sorted(b for b in self.wanted if self.low <= b <= self.high), np.int64)
        for first, n, name in files_of(self.path):
            if wanted is None:
                low, high = max(first, self.low), min(first + n - 1, self.high)
                runs = [(b, min(BLOCKS_PER_TASK, high + 1 - b)) for b in range(low, high + 1, BLOCKS_PER_TASK)]
                out += [Blocks(name, first, [r]) for r in runs]
            else:
                own = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + n)]
                edges = np.flatnonzero(np.diff(own, prepend=-9, append=2**62) != 1)
                runs = [(int(own[i]), int(j - i)) for i, j in zip(edges[:-1], edges[1:], strict=True)] if len(own) else []
                out += [Blocks(name, first, runs[k : k + BLOCKS_PER_TASK]) for k in range(0, len(runs), BLOCKS_PER_TASK)]
        return out or [Blocks("", 0, [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if not partition.runs:
            return
        fs, folder = _store(self.path)
        kind, slots = record(self.dims), heap.slots_per_block(len(self.dims))
        with fs.open_input_file(f"{folder}/{partition.file}") as f:
            for first, n in partition.runs:
                for block in range(first, first + n, 64):
                    some = min(64, first + n - block)
                    f.seek((block - partition.first) * heap.BLOCK_BYTES)
                    yield self._decode(f.read(some * heap.BLOCK_BYTES), block, kind, slots)

    def _decode(self, data: bytes, first: int, kind: np.dtype, slots: int) -> pa.RecordBatch:
        n = len(data) // heap.BLOCK_BYTES
        raw = np.frombuffer(data, np.uint8).reshape(n, heap.BLOCK_BYTES)
        counts = np.ascontiguousarray(raw[:, : heap.HEADER_BYTES]).view("<i4").ravel()
        rows = np.ascontiguousarray(raw[:, heap.HEADER_BYTES : heap.HEADER_BYTES + slots * kind.itemsize]).view(kind)
        block, slot = np.nonzero(np.arange(slots) < counts[:, None])
        rows = rows[block, slot]
        names = [x.split(b"\0")[0].decode("utf-8", "replace") for x in rows["name"].tolist()]
        columns = [pa.array(block + first), pa.array(slot), pa.array(np.ascontiguousarray(rows["id"])), pa.array(names, pa.string()), *(pa.array(np.ascontiguousarray(rows[d])) for d in self.dims)]
        return pa.RecordBatch.from_arrays(columns, ["block_id", "slot_id", "id", "name", *self.dims])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class HeapWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dims: list[str]):
        self.path, self.dims = path, dims

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = _store(self.path)
        fs.create_dir(folder, recursive=True)
        kind, files, attempt = record(self.dims), [], uuid.uuid4().hex
        out, first, block, held = None, 0, None, []

        def put():
            """The block held, at the end of its file."""
            nonlocal out, first
            if out is None or block - first >= BLOCKS_PER_FILE or block != first + files[-1][2]:
                if out is not None:
                    out.close()
                name = f"_{attempt}-{len(files)}"
                out, first = fs.open_output_stream(f"{folder}/{name}"), block
                files.append([name, first, 0])
            rows = np.concatenate(held)
            out.write(np.int32(len(rows)).astype("<i4").tobytes() + rows.tobytes() + bytes(heap.BLOCK_BYTES - heap.HEADER_BYTES - rows.nbytes))
            files[-1][2] += 1

        for b in iterator:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            ids = column["block_id"].to_numpy(zero_copy_only=False)
            rows = np.zeros(len(ids), kind)
            rows["id"] = column["id"].to_numpy(zero_copy_only=False)
            rows["name"] = [(x or "").encode()[: heap.NAME_BYTES] for x in column["name"].to_pylist()]
            for d in self.dims:
                rows[d] = column[d].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for own, number in zip(np.split(rows, cuts), ids[np.concatenate([[0], cuts])].tolist() if len(ids) else [], strict=False):
                if block is not None and number != block:
                    put()
                    held = []
                block = number
                held.append(own)
        if held:
            put()
        if out is not None:
            out.close()
        return Written([(name, f"heap-{first:012d}-{n:06d}.bin") for name, first, n in files])

    def commit(self, messages) -> None:
        fs, folder = _store(self.path)
        for m in messages:
            for made, name in m.files if m else []:
                fs.move(f"{folder}/{made}", f"{folder}/{name}")

    def abort(self, messages) -> None:
        fs, folder = _store(self.path)
        for m in messages:
            for made, _ in m.files if m else []:
                fs.delete_file(f"{folder}/{made}")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeapSource)


def write_heap(records: DataFrame, path: str, order: tuple[str, ...] = ("id",), dims: tuple[str, ...] = DIMS) -> None:
    """Puts records (id, name, dims) into slots in the given order, in blocks after those that are there."""
    register(records.sparkSession)
    last = max((first + n - 1 for first, n, _ in files_of(path)), default=0)
    placed = heap.addressed(records.select("id", "name", *dims), order, len(dims)).withColumn("block_id", F.col("block_id") + F.lit(last))
    files = 1 + placed.count() // (heap.slots_per_block(len(dims)) * BLOCKS_PER_FILE)
    # by file, so that blocks are whole within a task
    dealt = placed.repartition(int(files), F.expr(f"(block_id - {last + 1}) div {BLOCKS_PER_FILE}")).sortWithinPartitions("block_id", "slot_id")
    dealt.select("block_id", "slot_id", "id", "name", *dims).write.format(FORMAT).option("dims", ",".join(dims)).mode("append").save(path)


def read_heap(spark: SparkSession, path: str, dims: tuple[str, ...] = DIMS) -> DataFrame:
    """block_id, slot_id, id, name, dims of all records, in as many partitions as there are runs of blocks."""
    register(spark)
    return spark.read.format(FORMAT).option("dims", ",".join(dims)).load(path)
