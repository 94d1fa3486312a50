"""Substring dedup by repeated-phrase automata.

A word goes if it stands in a window of WINDOW words that also starts in a document of a smaller id. Every window has
an anchor, the phrase of GRAM words in it whose hash is smallest (the first on ties): equal windows have equal anchors
at equal places, and about one phrase in twenty is the anchor of any window.

1. Texts, words joined by one space, are put into bucket files of bounded size in the shared folder.
2. Anchors that by their hashes recur in more than one document are taken from the texts, and confirmed as recurring
   phrases by the phrases themselves.
3. Confirmed phrases are dealt to the buckets whose documents they are an anchor in, so each bucket's phrases are a shard of
   bounded size whatever the corpus. Each shard is compiled to an Aho-Corasick automaton, and all texts are streamed
   through their bucket's: a window counts if and only if the automaton has found a phrase at its anchor. (Shards that are dealt without
   regard to documents would need every document streamed through every shard, which grows with the square of the corpus.)
4. Consecutive windows around one located anchor are a segment. Equal segments of several documents collapse to the
   first document's, so copies never meet one another; only where an anchor has unequal segments are their windows
   compared, by the hashes of whole windows.
5. Each bucket removes what its documents don't own.

Phrases are compared as texts or by 128-bit hashes, windows by 64-bit hashes among those around one phrase. A text is
worked on whole: beside it a task holds a dozen numbers for each of its words, and its bucket's automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import NOT_WHITE, fresh_path, hot_keys, materialise, mix, powers, ragged, salted_join, slices, span_hashes, words
from tesselix.llm.files import store, write_file
from tesselix.sources.shipping import ship

WINDOW = 50
GRAM = 10
#: Bytes of text in a bucket; a longer text is a bucket by itself.
BUCKET_BYTES = 4 << 20
MOST_TASKS = 100_000
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


def write_buckets(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Bucket files and their rows: bucket, file, texts."""
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        part, nth, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal nth, ids, texts, size
            out = pa.BufferOutputStream()
            pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_binary())}), out, compression="zstd", use_dictionary=False)
            file = write_file(folder, f"bucket-{part:06d}-{nth:05d}", out.getvalue().to_pybytes())
            row = [[part << 20 | nth], [file], [len(ids)]]
            nth, ids, texts, size = nth + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["bucket", "file", "texts"])

        for rows, buf, offs in slices(batches, "_text"):
            data = buf.tobytes()
            for key, i, j in zip(rows.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                if ids and size + j - i > BUCKET_BYTES:
                    yield flush()
                ids.append(key)
                texts.append(b" ".join(data[i:j].split()))
                size += j - i
        if ids:
            yield flush()

    return materialise(picked.mapInArrow(run, "bucket bigint, file string, texts bigint"), "buckets")


class Bucket:
    """The texts of a bucket as one run of bytes, a line each, with their words and windows."""

    def __init__(self, file: str):
        fs, path = store(file)
        with fs.open_input_file(path) as f:
            table = pq.read_table(f)
        self.ids = table.column("doc_id").to_pylist()
        lines = [b" " + t + b" \n" for t in table.column("text").to_pylist()]
        self.data = b"".join(lines)
        self.offs = np.concatenate([[0], np.cumsum([len(x) for x in lines], dtype=np.int64)])

    def split(self) -> Bucket:
        self.buf = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends, self.at = words(self.buf, self.offs, NOT_WHITE)
        self.n_words = np.diff(self.at)
        return self

    def hash_words(self) -> None:
        hashes = span_hashes(self.buf, self.starts, self.ends)
        self.run = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_BASE, len(hashes)), out=self.run[1:])

    def hashes(self, first: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Of the n words from each first one on."""
        return mix((self.run[first + n] - self.run[first]) * powers(_INVERSE, len(self.run))[first], 5)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each window, and of its anchor. Texts without an id have none."""
        n = np.where([k is not None for k in self.ids], np.maximum(self.n_words - WINDOW + 1, 0), 0)
        first = ragged(self.at[:-1], n)
        if not len(first):
            return first, first
        self.hash_words()
        grams = self.hashes(np.arange(len(self.starts) - GRAM + 1), GRAM)
        return first, sliding_argmin(grams, WINDOW - GRAM + 1)[first]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the first place of the least of values[i : i + width] (cut off at the end)."""
    best, at, span = values.copy(), np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        if step >= len(values):
            break
        later = best[step:] < best[:-step]
        best[:-step] = np.where(later, best[step:], best[:-step])
        at[:-step] = np.where(later, at[step:], at[:-step])
        span += step
    return at


CELL = "bucket bigint, gram bigint, low bigint, high bigint, at bigint, n bigint"


def anchors(buckets: DataFrame) -> DataFrame:
    """bucket, gram (hash of an anchor), low and high: the smallest and largest id of its documents in the bucket; at and n:
    where the anchor first stands in the bucket's bytes."""

    def run(batches):
        for b in batches:
            for bucket, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = Bucket(file).split()
                _, anchor = own.windows()
                anchor = np.unique(anchor)
                ids = np.array([k or 0 for k in own.ids], np.int64)[np.searchsorted(own.at, anchor, "right") - 1]
                grams = own.hashes(anchor, GRAM).view(np.int64) if len(anchor) else anchor
                order = np.lexsort((ids, grams))
                grams, ids, anchor = grams[order], ids[order], anchor[order]
                first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else grams
                last = np.append(first[1:], len(grams)) - 1 if len(grams) else grams
                at = own.starts[anchor[first]] if len(grams) else grams
                n = own.ends[anchor[first] + GRAM - 1] - at if len(grams) else grams
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), bucket)), *(pa.array(x) for x in (grams[first], ids[first], ids[last], at, n))], ["bucket", "gram", "low", "high", "at", "n"])

    return buckets.mapInArrow(run, CELL)


def confirmed(buckets: DataFrame, cells: DataFrame, tasks: int) -> DataFrame:
    """bucket, at, n of the phrases that stand in more than one document: each bucket's shard."""
    likely = cells.groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("gram")
    wanted = cells.join(likely, "gram").repartition(tasks, "bucket")

    def run(own: pa.Table, wanted: pa.Table) -> pa.Table:
        # a group is one bucket; one without likely phrases is not read
        files = own.column("file").to_pylist() if wanted.num_rows else []
        data = Bucket(files[0]).data if files else b""
        spans = zip(wanted.column("at").to_pylist(), wanted.column("n").to_pylist(), strict=True) if files else ()
        phrases = pa.array([data[i : i + n] for i, n in spans], pa.binary())
        return pa.table([*(wanted.column(c).slice(0, len(phrases)) for c in ("bucket", "at", "n", "low", "high")), phrases], ["bucket", "at", "n", "low", "high", "phrase"])

    texts = materialise(buckets.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(run, "bucket bigint, at bigint, n bigint, low bigint, high bigint, phrase binary"), "phrases")
    recurring = texts.groupBy("phrase").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("phrase")
    # a phrase that is everywhere is one row of `recurring` and one a bucket here
    return salted_join(texts, recurring, "phrase", "bucket", hot_keys(texts, "phrase")).select("bucket", "at", "n")


def occurrences(own: Bucket, phrases: list[bytes]) -> np.ndarray:
    """The words at which one of the phrases begins: an automaton of them, over all texts of the bucket."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in phrases:
        automaton.add_word(f" {p.decode('latin-1')} ", len(p))  # bytes as characters: offsets are bytes
    automaton.make_automaton()
    # a match ends at the space after the phrase
    begins = np.fromiter((end - n for end, n in automaton.iter(own.data.decode("latin-1"))), np.int64)
    return np.searchsorted(own.starts, begins)


def locate(own: Bucket, phrases: list[bytes]) -> Iterator[tuple]:
    """The segments around the anchors at which the automaton of the phrases finds one, once
    a text: (text's number, doc_id, first words in the text, windows, hash of the anchor, of the segment, of each window)."""
    if not phrases:
        return
    first, anchor = own.split().windows()
    located = np.zeros(len(own.starts) + 1, bool)
    located[occurrences(own, phrases)] = True
    kept = located[anchor]
    first, anchor = first[kept], anchor[kept]
    if not len(first):
        return
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(first)))
    text = np.searchsorted(own.at, first[begin], "right") - 1
    spans = own.hashes(first[begin], n + WINDOW - 1).view(np.int64)
    each = own.hashes(first, WINDOW).view(np.int64)
    keys, same = {}, {}
    for k, (b, a) in enumerate(zip(begin.tolist(), anchor[begin].tolist(), strict=True)):
        phrase = own.data[own.starts[a] : own.ends[a + GRAM - 1]]
        key = keys.get(phrase)
        if key is None:
            key = keys[phrase] = hashlib.blake2b(phrase, digest_size=16).digest()
        t = int(text[k])
        # the segment's hash holds where the anchor is in it: equal phrases at unequal places are unequal segments
        key = key + int(a - first[b]).to_bytes(4, "little")
        starts, _, _ = same.setdefault((t, key, int(spans[k])), ([], int(n[k]), each[b : b + n[k]]))
        starts.append(int(first[b] - own.at[t]))
    for (t, key, span), (starts, count, hashes) in same.items():
        yield t, own.ids[t], starts, count, key, span, hashes


SEGMENT = "bucket bigint, nth int, doc_id bigint, starts array<int>, n int, anchor binary, segment bigint, windows array<bigint>"


def segments(buckets: DataFrame, shards: DataFrame) -> DataFrame:
    """The segments of all buckets, each by its shard of phrases."""

    def run(own: pa.Table, shard: pa.Table) -> pa.Table:
        rows = []
        for bucket, file in zip(own.column("bucket").to_pylist(), own.column("file").to_pylist() if shard.num_rows else [], strict=False):
            texts = Bucket(file)
            phrases = [texts.data[i : i + n] for i, n in zip(shard.column("at").to_pylist(), shard.column("n").to_pylist(), strict=True)]
            rows += [(bucket, *x) for x in locate(texts, phrases)]
        cut = np.concatenate([[0], np.cumsum([r[4] for r in rows], dtype=np.int64)]).astype(np.int32)
        windows = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([r[7] for r in rows]) if rows else np.zeros(0, np.int64)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int64()]
        return pa.table([*(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)), windows], ["bucket", "nth", "doc_id", "starts", "n", "anchor", "segment", "windows"])

    return buckets.groupBy("bucket").cogroup(shards.groupBy("bucket")).applyInArrow(run, SEGMENT)


def covered(found: DataFrame) -> DataFrame:
    """Per segment of a text that has windows to remove: bucket, nth, starts, n, mask (a bit a window)."""
    owners = found.groupBy("anchor", "segment").agg(F.min("doc_id").alias("owner"), F.first("n").alias("n"))
    owners = materialise(owners, "owners")
    contested = owners.groupBy(F.substring("anchor", 1, 16).alias("phrase")).agg(F.count("*").alias("segments")).filter("segments > 1").select("phrase")
    contested = materialise(contested, "phrases")  # so that a phrase which is everywhere is a split join's key below
    shared = found.select(F.substring("anchor", 1, 16).alias("phrase"), "anchor", "segment", "doc_id", "windows").join(contested, "phrase", "left_semi")
    shared = materialise(shared.groupBy("anchor", "segment").agg(F.min(F.struct("doc_id", "windows")).alias("o")).select("anchor", "segment", "o.*"), "contested")
    single = shared.select("anchor", "segment", "doc_id", F.posexplode("windows").alias("i", "window")).withColumn("phrase", F.substring("anchor", 1, 16))
    firsts = single.groupBy("phrase", "window").agg(F.min("doc_id").alias("first"))
    theirs = single.join(firsts, ["phrase", "window"]).filter("first < doc_id").groupBy("anchor", "segment").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))
    everything = F.expr("shiftleft(1L, n) - 1")
    known = owners.join(theirs, ["anchor", "segment"], "left").select("anchor", "segment", "owner", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))
    # a hot segment (a passage in a third of all documents) is one row here and many there
    key = F.concat("anchor", F.unhex(F.lpad(F.hex("segment"), 16, "0"))).alias("key")
    many = found.select("bucket", "nth", "doc_id", "starts", "n", key)
    hit = salted_join(many, known.select("owner", "mask", key), "key", "bucket", hot_keys(many, "key"))
    return hit.select("bucket", "nth", "starts", "n", F.when(F.col("doc_id") > F.col("owner"), everything).otherwise(F.col("mask")).alias("mask")).filter("mask <> 0")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are runs without ASCII white space. A null or empty text has no words. Rows of one id don't remove each
    other's words; rows of a null id keep all and remove nothing elsewhere. An empty table gives no rows; other columns
    are dropped. Ids must be integers."""
    spark = docs.sparkSession
    ship(spark)
    buckets = write_buckets(docs, fresh_path(spark, "texts"), id_col, text_col)
    # By number, so that buckets stay spread out: their rows here are small, their files are not.
    tasks = min(buckets.count() + 1, MOST_TASKS)
    buckets = buckets.select("bucket", "file").repartition(tasks, "bucket")
    cells = materialise(anchors(buckets), "anchors")
    shards = confirmed(buckets, cells, tasks)
    found = materialise(segments(buckets, shards.repartition(tasks, "bucket")), "segments")
    gone = covered(found)

    def run(own: pa.Table, gone: pa.Table) -> pa.Table:
        out = []
        for file in own.column("file").to_pylist():
            b = Bucket(file).split()
            edges = np.zeros(len(b.starts) + 1, np.int64)
            if gone.num_rows:
                nth, n, mask = (gone.column(c).to_numpy().astype(np.int64) for c in ("nth", "n", "mask"))
                starts = gone.column("starts").combine_chunks()
                times = starts.value_lengths().to_numpy().astype(np.int64)
                nth, n, mask, start = np.repeat(nth, times), np.repeat(n, times), np.repeat(mask, times), starts.flatten().to_numpy().astype(np.int64)
                i = ragged(np.zeros(len(n), np.int64), n)
                of = np.repeat(np.arange(len(n)), n)
                hit = (mask[of] >> i & 1).astype(bool)
                first = (b.at[nth] + start)[of][hit] + i[hit]
                edges += np.bincount(first, minlength=len(edges)) - np.bincount(first + WINDOW, minlength=len(edges))
            keep = np.cumsum(edges)[:-1] == 0
            kept = np.concatenate([[0], np.cumsum(keep)])
            for t, key in enumerate(b.ids):
                i, j = b.at[t], b.at[t + 1]
                removed = int(j - i - (kept[j] - kept[i]))
                text = b.data[b.starts[i] : b.ends[j - 1]] if j > i else b""
                if removed:
                    text = b" ".join(w for w, k in zip(text.split(b" "), keep[i:j].tolist(), strict=True) if k)
                out.append((key, int(j - i), removed, text))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
        return pa.table([*cols[:3], cols[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return buckets.groupBy("bucket").cogroup(gone.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
