"""Points: rows with an id and DOUBLE coordinate columns (x, y, ... so that filters reach the Parquet scan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tesselix.sources.storage import materialise

DIMS = ("x", "y")


def points_from(df: DataFrame, coords: dict[str, str | Column], id: str | None = None, name: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as points. Rows with a null or NaN coordinate are left out, as no query can place them. Coordinates stay
    bare columns (a stored -0.0 too, which equals 0.0 everywhere): filters on them reach the scan."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    columns = [F.col(id).cast("bigint").alias("id")] if id else []
    columns += [F.col(name).alias("name")] if name else []
    columns += [F.col(k) for k in keep] + [as_col(c).cast("double").alias(d) for d, c in coords.items()]
    return placed(df.select(*columns), tuple(coords))


def placed(df: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(d).isNotNull() & ~F.isnan(d) for d in dims)))


def live(df: DataFrame, rule: str = "all") -> DataFrame:
    """all; not_tombstone: id <> -1; positive: id > 0."""
    return {"all": lambda: df, "not_tombstone": lambda: df.filter("id <> -1"), "positive": lambda: df.filter("id > 0")}[rule]()


def coords_array(df: DataFrame, dims: tuple[str, ...] = DIMS) -> DataFrame:
    return df.withColumn("coords", F.array(*dims))


def columns(dims: tuple[str, ...], prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{d}") for d in dims]


def blocks(df: DataFrame, key: str, most: int, rows: int | None = None) -> list[DataFrame]:
    """df (of so many rows, if that is known) in parts of about `most` rows at most, by a hash of the key; small ones are one part. More
    parts are cut from a table that is written once."""
    n = -(-(df.count() if rows is None else rows) // most)
    if n <= 1:
        return [df]
    df = materialise(df, "blocks")
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(2 * n)) == i) for i in range(2 * n)]


def sampled(df: DataFrame, n: int, seed: int = 0, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """n rows drawn evenly, with replacement, and the draw's number; the same seed draws the same rows."""
    from tesselix.plans.ordering import numbered

    total = df.count()
    draws = df.sparkSession.range(n if total else 0).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))) + 1).alias("_rn"))
    return numbered(df, list(order), "_rn").join(draws, "_rn").drop("_rn")
