"""Block files as a data source."""

import os

import pytest
from pyspark.sql import functions as F

from tesselix.operators import heap
from tesselix.sources import heapfile
from tesselix.sources.storage import fresh_path

POINT = "id bigint, name string, x double, y double"


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(heapfile, "BLOCKS_PER_FILE", 3)


def test_what_is_written_is_read_by_address(spark, small_files):
    rows = [(i, f"näme {i}" if i % 5 else None, float(i) / 3, -float(i)) for i in range(1000)]
    path = fresh_path(spark, "blocks")
    df = spark.createDataFrame(rows, POINT).repartition(4)
    heapfile.write_heap(df, path)
    got = {(r["block_id"], r["slot_id"]): (r["id"], r["name"], r["x"], r["y"]) for r in heapfile.read_heap(spark, path).collect()}
    assert got == {(1 + i // 117, i % 117): (i, n or "", x, y) for i, n, x, y in rows}
    want = {(r["block_id"], r["slot_id"]): r["id"] for r in heap.addressed(df).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(os.path.getsize(f"{path.removeprefix('file:')}/{name}") == n * 32768 for _, n, name in heapfile.files_of(path))
    more = spark.createDataFrame([(5000 + i, "x" * 300 + "é", 0.0, 0.0) for i in range(200)], POINT)
    heapfile.write_heap(more, path)
    all_ = heapfile.read_heap(spark, path)
    assert all_.count() == 1200 and all_.filter("id >= 5000").select("block_id").distinct().count() == 2
    assert {r["name"] for r in all_.filter("id >= 5000").collect()} == {r["n"] for r in more.select(heap.stored_name(F.col("name")).alias("n")).collect()}


def test_only_the_blocks_asked_for_are_read():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

    def runs(*filters):
        reader = heapfile.HeapReader("x", ["x", "y"])
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return [(p.file, r) for p in reader.partitions() for r in p.runs]

    files, heapfile.files_of = heapfile.files_of, lambda path: [(1, 4, "a"), (5, 4, "b"), (9, 2, "c")]
    try:
        assert runs() == [("a", (1, 4)), ("b", (5, 4)), ("c", (9, 2))]
        assert runs(EqualTo(("block_id",), 6)) == [("b", (6, 1))]
        assert runs(In(("block_id",), (2, 3, 6, 10, 77))) == [("a", (2, 2)), ("b", (6, 1)), ("c", (10, 1))]
        assert runs(GreaterThanOrEqual(("block_id",), 4), LessThan(("block_id",), 7)) == [("a", (4, 1)), ("b", (5, 2))]
        assert runs(EqualTo(("id",), 6))[0] == ("a", (1, 4)) and runs(EqualTo(("block_id",), 99)) == []
    finally:
        heapfile.files_of = files


def test_filters_reach_the_seeks(spark, small_files):
    """A partition a run of blocks: of 100 addresses in two blocks no other block is read."""
    path = fresh_path(spark, "blocks")
    heapfile.write_heap(spark.createDataFrame([(i, "n", 0.0, 0.0) for i in range(3000)], POINT), path)
    some = heapfile.read_heap(spark, path).filter(F.col("block_id").isin(2, 11))
    assert some.rdd.getNumPartitions() == 2
    assert sorted(r["id"] for r in some.collect()) == [*range(117, 234), *range(1170, 1287)]
    assert heapfile.read_heap(spark, path).filter("block_id > 1000").count() == 0


def test_an_empty_heap(spark):
    path = fresh_path(spark, "blocks")
    heapfile.write_heap(spark.createDataFrame([], POINT), path)
    assert heapfile.read_heap(spark, path).count() == 0
