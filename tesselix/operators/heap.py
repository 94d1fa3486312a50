"""Addresses of records in fixed-size blocks, and what fits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tesselix.plans.ordering import numbered

# Fixed values of the block format: bytes of a block, of its header, of an id, of a name and of a coordinate.
BLOCK_BYTES = 32_768
HEADER_BYTES = 4
ID_BYTES = 8
NAME_BYTES = 256
COORD_BYTES = 8


def record_bytes(dims: int) -> int:
    return ID_BYTES + NAME_BYTES + COORD_BYTES * dims


def slots_per_block(dims: int) -> int:
    return (BLOCK_BYTES - HEADER_BYTES) // record_bytes(dims)


def layout(dims: int) -> dict[str, int]:
    return {"dims": dims, "record_bytes": record_bytes(dims), "slots_per_block": slots_per_block(dims), "block_bytes": BLOCK_BYTES}


def addressed(records: DataFrame, order: tuple[str, ...] = ("id",), dims: int = 2) -> DataFrame:
    """Adds block_id (from 1) and slot_id (from 0) in the given order; every record has its own."""
    slots = slots_per_block(dims)
    return numbered(records, list(order), "_rn").withColumns({"block_id": F.expr(f"1 + (_rn - 1) div {slots}"), "slot_id": F.expr(f"(_rn - 1) % {slots}")}).drop("_rn")


def fetch(records: DataFrame, pointers: DataFrame) -> DataFrame:
    """The records at (block_id, slot_id); the optimiser broadcasts the pointers if they are small."""
    return records.join(pointers.select("block_id", "slot_id"), ["block_id", "slot_id"])


def stored_name(name: Column, limit: int = NAME_BYTES) -> Column:
    """A name as the block format keeps it: its first bytes, a character cut in two as U+FFFD, up to the first NUL."""
    cut = F.make_valid_utf8(F.substring(name.cast("binary"), 1, limit).cast("string"))
    return F.split_part(cut, F.char(F.lit(0)), F.lit(1))


def write(records: DataFrame, path: str, append: bool = False) -> None:
    records.write.mode("append" if append else "errorifexists").parquet(path)
