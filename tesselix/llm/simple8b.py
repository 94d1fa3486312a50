"""Token ids in binary files: Simple-8b, a word-aligned code.

A 64-bit word holds a selector (its 4 high bits) and as many ids as fit the selector's width. Ids are coded in blocks
of BLOCK; the file has the word at which each block starts, so readers find, read and decode runs of blocks on their
own, all blocks of a run at once in array operations. An id too large for any width is an escape: the word holds its index in a list of
64-bit values at the end of the file.

File, all little-endian: MAGIC; seven unsigned 64-bit numbers (ids, ids a block, blocks, words, escapes, texts, bytes
of a text's id); per block and once more the word it starts at; per text its ids (64-bit each); per text its id
(signed 64-bit, with a byte before all of them per text that is 1 if the id is null); words; escapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from tesselix.llm.common import fresh_path, materialise, text_or_empty
from tesselix.llm.files import store, write_file
from tesselix.llm.tokens import encoded
from tesselix.sources.shipping import ship

MAGIC = b"TSLX8B01"
BLOCK = 512
#: Blocks that are coded together.
AT_ONCE = 1024
# Fixed values of the code: ids in a word and bits of each, by selector. Selector 0 is the escape.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
#: Ids in a file, about.
FILE_IDS = 1 << 22
#: Ids that a reader decodes together, about, and texts at most.
RUN_IDS = 1 << 20
RUN_TEXTS = 5_000


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, the word at which each block starts and the number of words, escapes)."""
    words, offsets, escapes, at, n = [], [np.zeros(1, np.uint64)], [], 0, 0
    for i in range(0, len(ids), AT_ONCE * BLOCK):
        own, places, rare = _encode(ids[i : i + AT_ONCE * BLOCK], n)
        words.append(own)
        offsets.append(places[1:] + np.uint64(at))
        escapes.append(rare)
        at, n = at + len(own), n + len(rare)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(words or none), np.concatenate(offsets), np.concatenate(escapes or none)


def _encode(ids: np.ndarray, escaped_before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """encode() of some blocks, ids in all but the last of them full."""
    n_blocks = -(-len(ids) // BLOCK)
    wide = BLOCK + int(COUNTS.max())
    values = np.zeros((n_blocks, wide), np.uint64)
    full = np.zeros(n_blocks * BLOCK, np.uint64)
    full[: len(ids)] = ids
    values[:, :BLOCK] = full.reshape(n_blocks, BLOCK)
    size = np.full(n_blocks, BLOCK)
    size[-1] = len(ids) - (n_blocks - 1) * BLOCK
    # need: the first selector from 1 on, by width, that holds the value; 16: none does
    need = (np.searchsorted(np.array([1 << int(b) for b in BITS[1:]], np.uint64), values.ravel(), "right") + 1).astype(np.uint8).reshape(values.shape)
    choice = np.where(need == 16, 0, 15).astype(np.uint8)
    most, span = need, 1
    for selector in range(14, 0, -1):
        while span < COUNTS[selector]:  # the largest need of the next `span` values; beyond the block there are zeros
            step = min(span, int(COUNTS[selector]) - span)
            nxt = most.copy()
            nxt[:, :-step] = np.maximum(most[:, :-step], most[:, step:])
            most, span = nxt, span + step
        choice[most <= selector] = selector
    at, block, words_of = np.zeros(n_blocks, np.int64), np.arange(n_blocks), np.zeros(n_blocks, np.int64)
    found = []
    while len(block):  # a word of every unfinished block at each step
        s = choice[block, at[block]]
        found.append((block, words_of[block], at[block], s))
        at[block] += COUNTS[s]
        words_of[block] += 1
        block = block[at[block] < size[block]]
    block, nth, at, s = (np.concatenate(x) for x in zip(*found, strict=True))
    offsets = np.concatenate([[0], np.cumsum(words_of)])
    place, first = offsets[block] + nth, block * wide + at
    words, flat = np.zeros(int(offsets[-1]), np.uint64), values.ravel()
    for selector in np.unique(s):
        own = s == selector
        if selector == 0:
            continue
        word = np.full(int(own.sum()), int(selector) << 60, np.uint64)
        for k in range(COUNTS[selector] if BITS[selector] else 0):
            word |= flat[first[own] + k] << np.uint64(k * BITS[selector])
        words[place[own]] = word
    escaped = np.flatnonzero(s == 0)
    escaped = escaped[np.argsort(place[escaped])]
    words[place[escaped]] = np.arange(escaped_before, escaped_before + len(escaped), dtype=np.uint64)
    return words, offsets.astype(np.uint64), flat[first[escaped]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encode()."""
    out = np.zeros(n, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    before = np.cumsum(count) - count
    offsets = offsets.astype(np.int64)
    per_block = np.diff(offsets)
    block = np.repeat(np.arange(len(per_block)), per_block)
    at = block * BLOCK + before - np.repeat(before[offsets[:-1]], per_block) if len(words) else before
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector):
        own = selector == s
        place, end, word = at[own], stop[own], words[own]
        if s == 0:
            out[place] = escapes[(word & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s] if BITS[s] else 0):
            inside = place + k < end
            out[place[inside] + k] = (word[inside] >> np.uint64(k * BITS[s])) & mask
    return out


def file_bytes(ids: np.ndarray, lengths: np.ndarray, keys: list) -> bytes:
    words, offsets, escapes = encode(ids)
    head = np.array([len(ids), BLOCK, len(offsets) - 1, len(words), len(escapes), len(lengths), 8], "<u8")
    nulls = np.array([k is None for k in keys], np.uint8)
    key = np.array([k or 0 for k in keys], "<i8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, offsets.astype("<u8"), lengths.astype("<u8"), nulls, key, words.astype("<u8"), escapes.astype("<u8")))])


class IdFile:
    """A file of ids, open: its head and index are read, words only by ranges of blocks."""

    def __init__(self, f):
        self.f = f
        if f.read(8) != MAGIC:
            raise ValueError("not a file of token ids")
        self.n, block, blocks, self.n_words, self.n_escapes, texts, _ = (int(x) for x in self._take("<u8", 7))
        if block != BLOCK:
            raise ValueError(f"blocks of {block} ids")
        self.offsets, lengths, nulls, keys = self._take("<u8", blocks + 1), self._take("<u8", texts), self._take("u1", texts), self._take("<i8", texts)
        self.at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
        self.nulls, self.keys = nulls.astype(bool), keys.astype(np.int64)
        self.words_at = 64 + self.offsets.nbytes + lengths.nbytes + nulls.nbytes + keys.nbytes
        self._escapes = None

    def _take(self, kind: str, count: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * count
        data = self.f.read(size)
        if len(data) != size:
            raise ValueError("a file of token ids that is cut off")
        return np.frombuffer(data, kind)

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids from low to high (exclusive); only the blocks that hold them are read."""
        if low >= high:
            return np.zeros(0, np.uint64)
        if self._escapes is None:
            self.f.seek(self.words_at + 8 * self.n_words)
            self._escapes = self._take("<u8", self.n_escapes).astype(np.uint64)
        first, last = low // BLOCK, -(-high // BLOCK)
        start, stop = int(self.offsets[first]), int(self.offsets[last])
        self.f.seek(self.words_at + 8 * start)
        words = self._take("<u8", stop - start).astype(np.uint64)
        got = decode(words, self.offsets[first : last + 1] - np.uint64(start), self._escapes, min(last * BLOCK, self.n) - first * BLOCK)
        return got[low - first * BLOCK : high - first * BLOCK]

    def texts(self, numbers: np.ndarray, most: int = RUN_IDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The texts of these ascending numbers, in runs of texts next to each other with about `most` ids, one text at
        least: (numbers, ids, the place in the run at which each text starts and the run's ids)."""
        i = 0
        while i < len(numbers):
            end = int(np.searchsorted(self.at, self.at[numbers[i]] + most, "right")) - 1
            j = i + 1
            while j < len(numbers) and j - i < RUN_TEXTS and numbers[j] == numbers[j - 1] + 1 and numbers[j] < end:
                j += 1
            cut = self.at[numbers[i] : numbers[j - 1] + 2]
            yield numbers[i:j], self.ids(int(cut[0]), int(cut[-1])), cut - cut[0]
            i = j


def write_ids(docs: DataFrame, path: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts, each followed by `end`, in ascending order of id_col (an integer) to files in the
    shared folder, and returns the files: part, nth, file, texts, n_ids, low and high (the smallest and largest id_col in
    it; null if all are), first_id (ids in the files before it).

    Null ids come first, equal ones in the order of their texts' hashes; a null text is empty; each repeated row is
    written. An empty table gives no files. A file that a lost attempt has left is in no row of the result.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "ids")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_h"))
    rows = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_text").select("_id", "_text")

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        ids, lengths, keys, waiting = [], [], [], 0

        def flush():
            nonlocal nth, ids, lengths, keys, waiting
            n = np.concatenate(lengths)
            file = write_file(folder, f"part-{part:06d}-{nth:04d}", file_bytes(np.concatenate(ids), n, keys))
            some = [k for k in keys if k is not None]
            row = [[part], [nth], [file], [len(n)], [waiting], [min(some, default=None)], [max(some, default=None)]]
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            nth, ids, lengths, keys, waiting = nth + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["part", "nth", "file", "texts", "n_ids", "low", "high"])

        for got, own, at in encoded(batches, "_text", path, end):
            ids.append(own)
            lengths.append(np.diff(at))
            keys += got.column(0).to_pylist()
            waiting += len(own)
            if waiting >= FILE_IDS:
                yield flush()
        if keys:
            yield flush()

    files = materialise(rows.mapInArrow(run, "part bigint, nth bigint, file string, texts bigint, n_ids bigint, low bigint, high bigint"), "id-files")
    # one task, a row for each file of FILE_IDS ids or more: 100 TB of text are some 8 million rows of a few numbers
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


TEXT = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _read(files: DataFrame, wanted: list[int] | None) -> DataFrame:
    def run(batches):
        some = None if wanted is None else np.array(wanted, np.int64)
        for b in batches:
            for file, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, path = store(file)
                with fs.open_input_file(path) as f:
                    own = IdFile(f)
                    numbers = np.arange(len(own.keys)) if some is None else np.flatnonzero(np.isin(own.keys, some) & ~own.nulls)
                    for which, ids, cut in own.texts(numbers):
                        data = pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(cut * 4), pa.py_buffer(ids.astype("<u4").tobytes())])
                        keys = pa.array(own.keys[which], pa.int64(), mask=own.nulls[which])
                        yield pa.RecordBatch.from_arrays([keys, pa.array(first + own.at[which]), pa.array(np.diff(cut)), data.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    ship(files.sparkSession)
    # a few files a task: the window that numbers them has left them in one partition
    spread = files.select("file", "first_id").repartition(max(files.sparkSession.sparkContext.defaultParallelism * 2, 8), "file")
    return spread.mapInArrow(run, TEXT)


def read_ids(files: DataFrame) -> DataFrame:
    """The texts of write_ids(): doc_id, start (ids of all texts before it), n_tokens, ids (little-endian unsigned 32-bit).
    Files are read and decoded by runs of blocks, so a task holds about RUN_IDS ids, or one text's."""
    return _read(files, None)


def read_texts(files: DataFrame, wanted: list[int]) -> DataFrame:
    """read_ids() of the documents of a stated list: files that can't hold one are left alone, of the others the index is
    read, and the blocks that hold those texts. Ids that aren't there have no row, repeated ones all theirs."""
    wanted = sorted(set(wanted))
    # ranges of the list that reach the small table of files
    holds = F.exists(F.lit(wanted).cast("array<bigint>"), lambda i: i.between(F.col("low"), F.col("high")))
    return _read(files.filter(holds), wanted)
