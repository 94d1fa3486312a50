"""Shared pieces: gapless positions and byte-level words.

Texts reach Python as Arrow batches and are worked on as one byte buffer per slice of bounded size, so
that word splitting, hashing and counting are numpy passes instead of loops over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from tesselix.sources.storage import fresh_path, materialise

__all__ = ["ALNUM", "LOWER", "NOT_WHITE", "distinct_spans", "fresh_path", "gapless", "hot_keys", "materialise", "mix", "powers", "ragged", "release", "salted_join", "shingle_hashes", "slices", "span_hashes", "text_or_empty", "unused", "words"]

#: Bytes of text worked on at once; a single longer text is worked on alone.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 16
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Words between ASCII white space, unchanged.
NOT_WHITE = ~WHITE
#: Words of ASCII letters, digits and any non-ASCII character.
ALNUM = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores after them as it takes for df to have no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def gapless(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int) -> DataFrame:
    """Adds out: 0, 1, 2, ... within each key. A key's rows are spread over `buckets` by a hash of `order`, counted
    there and numbered from the bucket's offset, so a hot key is never sorted by one task. Keys must not be null. Other
    columns stay, whatever their names."""
    b, n, o = unused(df, "_b", "_n", "_o")
    salted = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by_key = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy(*keys, b).agg(F.count("*").alias(n)).select(*keys, b, F.coalesce(F.sum(n).over(by_key), F.lit(0)).alias(o))
    within = Window.partitionBy(*keys, b).orderBy(*order)
    return salted.join(offsets, [*keys, b]).withColumn(out, (F.col(o) + F.row_number().over(within) - 1).cast("long")).drop(b, o)


#: A key is hot if it holds more than one in HOT of all rows, so there are fewer than HOT of them; a hot key's rows are
#: dealt to SALTS tasks.
HOT = 200
SALTS = 64


def hot_keys(df: DataFrame, key: str) -> list:
    """The hot keys of df, fewer than HOT; null is none. Keys are counted before they are shuffled."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("of"))  # one row
    return [r[0] for r in counts.crossJoin(F.broadcast(total)).filter(F.col("n") * HOT > F.col("of")).select(key).collect()]


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, hot: list) -> DataFrame:
    """many joined with the row of `one` that its key has (rows without one go). Rows of hot keys are dealt to SALTS tasks by a
    hash of the column `spread` of many, and a hot key's row of `one` to each of them."""
    (salt,) = unused(many.select("*", *(F.lit(None).alias(c) for c in one.columns if c not in many.columns)), "_salt")
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    dealt = many.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = one.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, salt]).drop(salt)


# --- texts as bytes -------------------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows with at most `most` bytes of text: (rows, bytes, offsets of the texts in them). At
    a task's end the worker, which Spark keeps, gives back the memory it has freed."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            continue
        _, offs, data = texts.buffers()
        offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(texts):
            to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1), at + SLICE_ROWS)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def words(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes of `kind`) and, per text, the number of words before it."""
    w = kind[buf]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    full = offs[:-1][offs[1:] > offs[:-1]]
    first[full] = w[full]
    ends = offs[1:][offs[1:] > offs[:-1]] - 1
    last[ends] = w[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64; kept, and grown by doubling."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once.
CHUNK = 1 << 18


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (starts ascend, and ends), from one running sum over the buffer. The sum is taken
    chunk by chunk, so that a very long text takes a few numbers a span, not several a byte."""
    at_start, at_end, scale = (np.zeros(len(starts), np.uint64) for _ in range(3))
    local = np.zeros(min(CHUNK, len(buf)) + 1, np.uint64)
    up, down = powers(_BASE, len(local)), powers(_INVERSE, len(local))
    before = np.uint64(0)
    for low in range(0, len(buf) if len(starts) else 0, CHUNK):
        n = min(CHUNK, len(buf) - low)
        np.cumsum((buf[low : low + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=local[1 : n + 1])
        local[1 : n + 1] *= np.uint64(pow(_BASE, low, 1 << 64))
        local[: n + 1] += before
        i, j = np.searchsorted(starts, (low, low + n))
        at_start[i:j] = local[starts[i:j] - low]
        scale[i:j] = down[starts[i:j] - low] * np.uint64(pow(_INVERSE, low, 1 << 64))
        i, j = np.searchsorted(ends, (low, low + n), "right")
        at_end[i:j] = local[ends[i:j] - low]
        before, local[0] = local[n], 0
    return mix((at_end - at_start) * scale)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values; shingles that cross texts are the caller's to drop."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out, n)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """Exact codes of the spans and the distinct spans. Spans must be ascending and apart."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    both = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = both.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + length - 1 for each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)
