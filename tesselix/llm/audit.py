"""Filter interaction audit: what each of five filters removes, in every order they could be applied in.

A document fails a set of filters, one of 32. A table of 32 by 120, made once, holds the step at which an order (one of the
120 permutations) removes a document with that set. Each task looks its documents up in the table and counts, by
np.bincount, what goes at each step of each order in each part, split by label; the counts of all tasks are added.

Filters A to D need the text alone; E needs the smallest id among equal texts, found by 128-bit hashes of whole texts.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import hot_keys, materialise, salted_join, slices, unused
from tesselix.sources.shipping import ship

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
# Fixed values of the filters.
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
UPPER = bytes(range(0x41, 0x5B))
CONTINUATION = bytes(range(0x80, 0xC0))
WHITE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text split into words at once; rows looked up at once; parts counted in a task before their counts are given out.
PIECE_BYTES = 1 << 20
LOOKUP_ROWS = 4096
MOST_PARTS = 256


def first_failures() -> np.ndarray:
    """For each set of failed filters (bit i is filter i) and order, the step (from 0) that removes; 5 if none does."""
    steps = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(len(FILTERS))):
            fails = np.arange(len(steps)) >> FILTERS.index(order[step]) & 1 == 1
            steps[fails, o] = step
    return steps


def count_words(data: bytes) -> tuple[int, int]:
    """Words and distinct words (runs without ASCII white space). Of a long text a piece is split at a time, and distinct words
    are told apart by 64-bit hashes."""
    if len(data) <= PIECE_BYTES:
        found = data.split()
        return len(found), len(set(found))
    n, at, seen = 0, 0, np.zeros(0, np.int64)
    while at < len(data):
        cut = WHITE.search(data, at + PIECE_BYTES)
        to = cut.start() if cut else len(data)
        found = data[at:to].split()
        n, at = n + len(found), to
        seen = np.union1d(seen, np.fromiter(map(hash, set(found)), np.int64))
    return n, len(seen)


def text_failures(data: bytes) -> int:
    """Bits of A to D: too few words, too few distinct words, too many capitals, a mark."""
    n, distinct = count_words(data)
    without = lambda some: len(data) - len(data.translate(None, some))
    points = len(data) - without(CONTINUATION)
    tests = (n < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * without(UPPER) > UPPER_PERCENT * points, without(MARKS) > 0)
    return sum(bit << i for i, bit in enumerate(tests))


def failures(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part (null: empty), fails (bits of A to E) of each row of docs. A null text is empty. A row fails E if its text stands
    in a row of a smaller id; rows of one id don't make each other fail, rows of a null id neither fail E nor make others."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for rows, buf, offs in slices(batches, "_text"):
            data, fails, digests = buf.tobytes(), [], []
            for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                text = data[i:j]
                fails.append(text_failures(text))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])

    kind = dict(picked.dtypes)["doc_id"]
    rows = materialise(picked.mapInArrow(run, f"doc_id {kind}, part string, fails int, digest binary"), "failures")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = salted_join(rows, firsts, "digest", "doc_id", hot_keys(rows, "digest"))
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    return marked.select("doc_id", "part", (F.col("fails") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether any label of the document's says quality = 1, toxic = 1. Rows of a null id have no
    label; they are dealt out by a salt, for all nulls are one key to a join."""
    said = labels.groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))))
    (salt,) = unused(rows, "_salt")
    dealt = rows.withColumn(salt, F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(64))).otherwise(F.lit(0)))
    joined = dealt.join(said.withColumn(salt, F.lit(0).cast("bigint")), ["doc_id", salt], "left").drop(salt)
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _tallies(part: str, cells: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
    """The rows of a part. cells: documents by order, step (the last: kept by all) and labels; sets: by set of failed filters."""
    gone = cells[:, : len(FILTERS)]
    removed = gone.sum(2)
    at = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    failing = np.array([sets[np.arange(len(sets)) >> f & 1 == 1].sum() for f in range(len(FILTERS))])
    unique = sets[1 << np.arange(len(FILTERS))]
    columns = {
        "kept": sets.sum() - removed.cumsum(1),
        "removed": removed,
        "redundant": failing[at] - removed,
        "unique_fails": unique[at],
        "good_lost": gone[:, :, [1, 3]].sum(2),
        "toxic_lost": gone[:, :, [2, 3]].sum(2),
        "shapley": np.bincount(at.ravel(), removed.ravel(), len(FILTERS)).astype(np.int64)[at],
    }
    n = removed.size
    head = [pa.array([part] * n), pa.array(np.repeat(ORDERS, len(FILTERS))), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)))]
    return pa.RecordBatch.from_arrays([*head, *(pa.array(columns[c].ravel().astype(np.int64)) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step (1 to 5) and, of the part's documents, kept (after the step), removed (by it), redundant (they fail its
    filter and went earlier), unique_fails (they fail that filter only), good_lost and toxic_lost (removed, of that label),
    shapley (removed by that filter, over all orders): 600 rows a part, zeros included.

    Null texts are empty and null parts the empty string; an empty table gives no rows. Repeated rows count each; a document
    with several labels has all of them, one with none or nulls has none. Other columns don't matter."""
    rows = with_labels(failures(docs, part_col, id_col, text_col), labels).select("part", "fails", (F.col("good").cast("int") + 2 * F.col("toxic").cast("int")).alias("labels"))
    shape = (len(ORDERS), len(FILTERS) + 1, 4)

    def run(batches):
        table = first_failures()
        orders = np.arange(len(ORDERS)) * (shape[1] * 4)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, LOOKUP_ROWS):
                b = whole.slice(at, LOOKUP_ROWS)
                coded = b.column(0).dictionary_encode()
                code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
                fails, said = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
                cell = (code * (len(ORDERS) * shape[1] * 4) + said)[:, None] + orders + table[fails] * 4
                cells = np.bincount(cell.ravel(), minlength=len(names) * int(np.prod(shape))).reshape(-1, *shape)
                sets = np.bincount(code * len(table) + fails, minlength=len(names) * len(table)).reshape(-1, len(table))
                for name, c, s in zip(names, cells, sets, strict=True):
                    old = held.get(name)
                    held[name] = (c, s) if old is None else (old[0] + c, old[1] + s)
                if len(held) > MOST_PARTS:
                    yield from (_tallies(p, *x) for p, x in held.items())
                    held = {}
        yield from (_tallies(p, *x) for p, x in held.items())

    partial = rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))
