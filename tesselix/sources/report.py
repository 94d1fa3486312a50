"""Result rows as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tesselix.operators.points import DIMS


def lines(rows: DataFrame, n: int | None = None, dims: tuple[str, ...] = DIMS, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """id and line: id, name and coordinates to six places, of the first n rows."""
    rows = rows.orderBy(*order).limit(n) if n is not None else rows
    return rows.select("id", F.format_string("%d, %s, (" + ", ".join(["%.6f"] * len(dims)) + ")", "id", "name", *dims).alias("line"))


def write_lines(rows: DataFrame, path: str, **how) -> None:
    lines(rows, **how).select("line").write.text(path)
