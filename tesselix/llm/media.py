"""Media columns: content-addressed payloads in tar shards.

A payload is 8-bit grey samples, WIDTH to a row, stored as a PNG file (lossless) under the SHA-256 of that file. Tasks
write their payloads into tar shards of about SHARD_BYTES, each content once a task; of the places of a content in
several shards, the smallest is the one that rows carry. So a row is (digest, shard, offset, length), and metadata
columns are filled by reading ranges: the PNG header (33 bytes at the offset) for width, height and depth, and the
payload itself only where it is asked for.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import fresh_path, hot_keys, materialise, salted_join, slices, text_or_empty
from tesselix.llm.files import Writer, store
from tesselix.sources.shipping import ship

WIDTH = 64
SHARD_BYTES = 64 << 20
HEADER = 33
#: Stored bytes and samples that are given out together, about.
BATCH_BYTES = 4 << 20
#: Stored bytes that a task reads.
TASK_BYTES = 16 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples: bytes, level: int = 6) -> bytes:
    """A grey PNG of WIDTH samples a row, 8 bits each."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row after its filter, 0: none
    lines[:, 1:] = rows
    return b"".join([_MAGIC, _part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), _part(b"IDAT", zlib.compress(lines.tobytes(), level)), _part(b"IEND", b"")])


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour kind) from the first HEADER bytes."""
    if data[:8] != _MAGIC or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", data[16:26])


def png_samples(data: bytes) -> bytes:
    """The samples of png()'s files; its checksums are checked."""
    width, height, bits, kind = png_header(data)
    at, packed = 8, []
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(name + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if name == b"IDAT":
            packed.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if (bits, kind) != (8, 0) or lines[:, 0].any():
        raise ValueError("not one of our PNGs")
    return lines[:, 1:].tobytes()


class Shard(Writer):
    """A tar file being written."""

    def __init__(self, folder: str, name: str):
        super().__init__(folder, name, ".tar")
        self.size = 0

    def add(self, name: str, data: bytes) -> int:
        """The offset of the data."""
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.write(head + data + bytes(-len(data) % 512))
        offset = self.size + len(head)
        self.size = offset + len(data) + -len(data) % 512
        return offset

    def close(self) -> str:
        self.write(bytes(1024))
        return super().close()


ROW = "n_bytes bigint, digest string, shard string, offset bigint, length bigint"


def store_texts(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Stores the UTF-8 bytes of every text (null: empty) as media: doc_id, n_bytes (of the text), digest, shard,
    offset, length. Equal texts have equal values but for doc_id. Repeated rows and null ids stay; an empty table gives
    no rows and no shards; other columns are dropped. Shards that a lost attempt has left are in no row."""
    ship(docs.sparkSession)
    folder = folder or fresh_path(docs.sparkSession, "media")
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))

    def run(batches):
        part, nth, shard, known = TaskContext.get().partitionId(), 0, None, {}
        for rows, buf, offs in slices(batches, "_text"):
            data, found = buf.tobytes(), []
            for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                text = data[i:j]
                key = hashlib.sha256(text).digest()
                if key not in known:
                    shard = shard or Shard(folder, f"shard-{part:06d}-{nth:04d}")
                    stored = png(padded(text))
                    digest = hashlib.sha256(stored).hexdigest()
                    known[key] = (len(text), digest, shard.uri, shard.add(f"{digest}.png", stored), len(stored))
                found.append(known[key])
                if shard and shard.size >= shard_bytes:  # whole shards are done with; a content may be in the next one again
                    shard.close()
                    shard, nth, known = None, nth + 1, {}
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(list(x)) for x in zip(*found, strict=True))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard:
            shard.close()

    rows = materialise(picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, {ROW}"), "media-rows")
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset")).alias("_p"))
    return salted_join(rows.drop("shard", "offset"), places, "digest", "doc_id", hot_keys(rows, "digest")).select("doc_id", "n_bytes", "digest", "_p.shard", "_p.offset", "length")


HEAD = "digest string, shard string, offset bigint, length bigint, width bigint, height bigint, bits bigint"


class _Opened:
    """The shard read last, kept open: places come in the order they lie in."""

    def __init__(self):
        self.uri = self.file = None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            fs, path = store(uri)
            self.file, self.uri = fs.open_input_file(path), uri
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file:
            self.file.close()


def read_headers(rows: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """One row a content of store_texts()'s rows: digest, shard, offset, length, and width, height, bits from HEADER bytes at
    the offset; nothing else is read. Contents come in the order they lie in; no rows give none. task_bytes: stored bytes
    that a task's contents have, about, for what reads them afterwards."""
    ship(rows.sparkSession)
    wanted = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    # by number: the rows are small, what is read for them is not
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        tasks += int((rows.agg(F.sum("length")).first()[0] or 0) // task_bytes)
    wanted = wanted.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")

    def run(batches):
        opened = _Opened()
        for b in batches:
            places = zip(*(b.column(i).to_pylist() for i in (1, 2)), strict=True)
            heads = [png_header(opened.read(shard, offset, HEADER))[:3] for shard, offset in places]
            if heads:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in zip(*heads, strict=True))], [*b.schema.names, "width", "height", "bits"])
        opened.close()

    return wanted.mapInArrow(run, HEAD)


def read_payloads(heads: DataFrame) -> DataFrame:
    """read_headers()'s rows with the stored file (media) and its samples (payload), read back whole; a file whose samples
    aren't as many as its header row says is refused."""

    def run(batches):
        opened, found, held = _Opened(), [], 0

        def flush():
            nonlocal found, held
            own, media, payload = zip(*found, strict=True)
            kept = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_arrays([*kept.columns, pa.array(media, pa.binary()), pa.array(payload, pa.binary())], [*kept.schema.names, "media", "payload"])
            found, held = [], 0
            return out

        for b in batches:
            places = zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "width", "height")), strict=True)
            for i, (shard, offset, length, width, height) in enumerate(places):
                media = opened.read(shard, offset, length)
                payload = png_samples(media)
                if len(payload) != width * height:
                    raise ValueError("a payload that is not its header's")
                found.append((b.slice(i, 1), media, payload))
                held += length + len(payload)
                if held >= BATCH_BYTES or len(found) >= 5_000:
                    yield flush()
        opened.close()
        if found:
            yield flush()

    return heads.mapInArrow(run, f"{HEAD}, media binary, payload binary")


def read_media(rows: DataFrame, payload: bool = True) -> DataFrame:
    """What is stored, one row a content: digest, media_bytes, width, height, bits from header ranges and, if asked for,
    the stored file (media) and its samples (payload); else both are null and no payload is read."""
    if payload:
        read = read_payloads(read_headers(rows, TASK_BYTES))
    else:
        none = F.lit(None).cast("binary")
        read = read_headers(rows).withColumns({"media": none, "payload": none})
    return read.select("digest", F.col("length").alias("media_bytes"), "width", "height", "bits", "media", "payload")
