"""Benchmark decontamination by spaced seeds.

Words are lower-case runs of letters and digits; in scripts that are written without spaces (U+3000 to U+9FFF) each
character is one. A document is contaminated by an item if a window of the document equals a window of the item but for
some substituted words, place by place: SUBSTITUTED words of WINDOW, and in a shorter item, whose window is the whole
item, as many in proportion (none below 5 words, 1 below 10, 2 below WINDOW). Fixed masks of the places that count are
laid over each position of both sides; equal hashes of the words that a mask lets through are hits. The masks are
lossless for their length of item: however the words to substitute are chosen, one mask fits between them (a test tries
all choices). Each hit's alignment is then verified word by word around it, so hits alone decide nothing.

The test side goes to the tasks in blocks of bounded size, each of which all documents pass, so nothing is shuffled, and
the passes over the documents grow with the test items: one for every BLOCK_CHARS characters of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tesselix.llm.common import ALNUM, LOWER, mix, powers, ragged, slices, span_hashes, text_or_empty, words
from tesselix.sources.shipping import ship

WINDOW = 15
SUBSTITUTED = 3
#: By the least number of an item's words: the masks. Items of fewer than 5 words have one that is the whole item.
MASKS = {15: ("1101111", "11100010011", "10001101011"), 10: ("111011", "11010011", "11111"), 5: ("1111", "11101", "11011", "10111"), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
EXACT = 4
#: Characters of test items in a block, so some 20 MB of hashes.
BLOCK_CHARS = 4_000_000
#: Hits of seeds that are listed at once.
HITS = 1 << 18
_PRIMES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_BITS = 20


def allowed(n):
    """The words of an item of n words that may be substituted in a window."""
    return np.minimum(n, WINDOW) * SUBSTITUTED // WINDOW


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words and, per text, the number of words before it."""
    alone = np.flatnonzero((buf >= 0xE3) & (buf <= 0xE9))  # the first of the three bytes of U+3000 to U+9FFF
    alone = alone[alone + 2 < len(buf)]
    if not len(alone):
        return words(buf, offs, ALNUM)
    other = buf.copy()
    for k in range(3):
        other[alone + k] = 0
    starts, ends, _ = words(other, offs, ALNUM)
    starts, ends = np.concatenate([starts, alone]), np.concatenate([ends, alone + 3])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], np.searchsorted(starts[order], offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = word_spans(buf, offs)
    return span_hashes(LOWER[buf], starts, ends), at


def seed_hashes(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of what the mask lets through at each position where it fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    weights = powers(_PRIMES[number % 4], len(mask) + 1)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + n] * weights[k + 1]
    return mix(out, number)


class Items:
    """A block of test items: word hashes one after another, and their seeds in order."""

    def __init__(self, ids: list, texts: list[str]):
        data = [t.encode() for t in texts]
        offs = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        self.ids, (self.words, self.at) = ids, word_hashes(np.frombuffer(b"".join(data), np.uint8), offs)
        lengths = np.diff(self.at)
        item = np.repeat(np.arange(len(ids)), lengths)
        self.seeds, number = [], 0
        least = np.array(sorted(MASKS))
        kind = least[np.maximum(np.searchsorted(least, lengths, "right") - 1, 0)]
        for shortest, masks in MASKS.items():
            for mask in masks:
                seeds = seed_hashes(self.words, mask, number)
                place = np.arange(len(seeds))
                own = (item[: len(seeds)] == item[len(mask) - 1 :]) & (kind[item[: len(seeds)]] == shortest)
                seeds, place = seeds[own], place[own]
                order = np.argsort(seeds, kind="stable")
                seeds, place = seeds[order], place[order]
                marked = np.zeros(1 << _BITS, bool)
                marked[(seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                if len(seeds):
                    self.seeds.append((mask, number, shortest <= EXACT, seeds, place, item[place], np.packbits(marked)))
                number += 1

    def met(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By mask: positions among all words whose seed an item has, and from where to where it stands among the mask's seeds."""
        for k, (mask, number, exact, seeds, _, _, marked) in enumerate(self.seeds):
            got = seed_hashes(hashes, mask, number)
            top = (got >> np.uint64(64 - _BITS)).astype(np.int64)
            at = np.flatnonzero(np.unpackbits(marked).view(bool)[top] & (doc[: len(got)] == doc[len(mask) - 1 :]))
            low, high = np.searchsorted(seeds, got[at], "left"), np.searchsorted(seeds, got[at], "right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if exact and len(at):  # such an item's first place in a document is its best
                _, first = np.unique(doc[at].astype(np.int64) * len(seeds) + low, return_index=True)
                at, low, high = at[first], low[first], high[first]
            yield k, at, low, high

    def window(self, i: int) -> tuple[int, int]:
        """Words of an item's window, and how many of them must be equal."""
        whole = int(self.at[i + 1] - self.at[i])
        return min(whole, WINDOW), min(whole, WINDOW) - int(allowed(whole))

    def best_of(self, hashes: np.ndarray, begin: int, end: int, i: int, shift: int) -> tuple[int, int] | None:
        """(less equal words, first word) of the best window of an alignment: the document's words from begin to end, `shift` words after the item's."""
        low, high = max(self.at[i], begin - shift), min(self.at[i + 1], end - shift)
        window, least = self.window(i)
        if high - low < window:
            return None
        run = np.concatenate([[0], np.cumsum(hashes[low + shift : high + shift] == self.words[low:high])])
        equal = run[window:] - run[:-window]
        k = int(equal.argmax())
        return (-int(equal[k]), int(low + shift + k - begin)) if equal[k] >= least else None

    def repetitive(self, hashes: np.ndarray, begin: int, end: int, met: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> dict[int, tuple[int, int]]:
        """The best window of each item in a document that repeats what the items repeat: its hits are not listed. For each item the
        document is gone through from its start; alignments are verified once, as many together as HITS words allow, and once a window is
        equal in all words none that starts later counts."""
        shares: dict[int, list[tuple[np.ndarray, int, int, int]]] = {}
        for k, at, low, high in met:
            item = self.seeds[k][5]
            order = np.argsort(low, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(low[order])) + 1) if len(order) else ():
                lo, hi = int(low[own[0]]), int(high[own[0]])
                ids, first = np.unique(item[lo:hi], return_index=True)  # places ascend within a seed, and so do items
                for i, a, b in zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), hi - lo], strict=True):
                    shares.setdefault(i, []).append((at[own], k, lo + a, lo + b))
        best = {}
        for i, own in shares.items():
            window, least = self.window(i)
            place = np.concatenate([p for p, *_ in own])
            which = np.repeat(np.arange(len(own)), [len(p) for p, *_ in own])
            order = np.argsort(place, kind="stable")
            place, which = place[order], which[order]
            size = np.array([b - a for _, _, a, b in own])[which].cumsum()
            seen = np.zeros(end - begin + int(self.at[i + 1] - self.at[i]), bool)  # alignments
            got, at = None, 0
            while at < len(place):
                if got and got[0] == -window and place[at] - begin >= got[1] + window:
                    break
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HITS // 16, "right")))
                shifts = [np.subtract.outer(place[at:to][which[at:to] == w], self.seeds[own[w][1]][4][own[w][2] : own[w][3]]).ravel() for w in np.unique(which[at:to]).tolist()]
                shifts = np.unique(np.concatenate(shifts))
                number = shifts + int(self.at[i + 1]) - begin
                shifts = shifts[~seen[number]]
                seen[number] = True
                got, at = self._best(hashes, begin, end, i, shifts, got), to
            if got:
                best[i] = got
        return best

    def _best(self, hashes: np.ndarray, begin: int, end: int, i: int, shifts: np.ndarray, got: tuple[int, int] | None) -> tuple[int, int] | None:
        """The best window of the item over these alignments and what was got before."""
        window, least = self.window(i)
        first, last = int(self.at[i]), int(self.at[i + 1])
        block = max(1, HITS // (last - first))
        for k in range(0, len(shifts), block):
            some = shifts[k : k + block]
            place = some[:, None] + np.arange(first, last)  # of each of the item's words in the document
            inside = (place >= begin) & (place < end)
            equal = np.zeros((len(some), last - first + 1), np.int32)
            np.cumsum(inside & (hashes[np.clip(place, begin, end - 1)] == self.words[first:last]), axis=1, out=equal[:, 1:])
            equal = equal[:, window:] - equal[:, :-window]
            equal[~(inside[:, : last - first - window + 1] & inside[:, window - 1 :])] = -1
            most = equal.max(1)
            top = int(most.max())
            if top >= least:
                start = int((some[most == top] + first + equal[most == top].argmax(1)).min()) - begin
                got = min(got, (-top, start)) if got else (-top, start)
        return got

    def matches(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first word of the best window in the document, equal words in it) for each pair that holds. Hits (a seed's
        places in a document by those in the items) are listed for HITS of them at a time; a document of more is worked on alone."""
        n = len(at) - 1
        doc = np.repeat(np.arange(n), np.diff(at))
        met = [m for m in self.met(hashes, doc) if len(m[1])]
        if not met:
            return []
        hits = sum(np.bincount(doc[p], high - low, n) for _, p, low, high in met)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        upto, d = np.concatenate([[0], hits.cumsum()]), 0
        while d < n:
            to = max(d + 1, int(np.searchsorted(upto, upto[d] + HITS, "right")) - 1)
            some = [(k, p[own], low[own], high[own]) for k, p, low, high in met if (own := (p >= at[d]) & (p < at[to])).any()]
            if hits[d] > HITS:
                best |= {(d, i): got for i, got in self.repetitive(hashes, int(at[d]), int(at[d + 1]), some).items()}
            elif some:
                place = np.concatenate([np.repeat(p, high - low) for _, p, low, high in some])
                which = [(k, ragged(low, high - low)) for k, _, low, high in some]
                own, item = (np.concatenate([self.seeds[k][c][w] for k, w in which]) for c in (4, 5))
                for e, i, shift in np.unique(np.stack([doc[place], item, place - own], 1), axis=0).tolist():  # alignments
                    got = self.best_of(hashes, at[e], at[e + 1], i, shift)
                    if got:
                        best[e, i] = min(best.get((e, i), got), got)
            d = to
        return [(d, i, start, -equal) for (d, i), (equal, start) in sorted(best.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    """The test items (null texts left out) in blocks; the driver holds one at a time."""
    ids, texts, n = [], [], 0
    for r in items.select(F.col(id_col), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        n += len(r[1])
        if n >= block_chars:
            yield Items(ids, texts)
            ids, texts, n = [], [], 0
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs and item that contaminates it: doc_id, item_id, start_word, equal_words. Of several
    windows the row has the one of most equal words, then the first. Null texts and those without words match nothing on either side;
    repeated rows on either side give repeated rows; null ids are kept; an empty table on either side gives no rows."""
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    schema = f"doc_id {dict(picked.dtypes)['doc_id']}, item_id {dict(items.dtypes)[item_id]}, start_word int, equal_words int"
    out = spark.createDataFrame([], schema)
    kinds = to_arrow_type(items.schema[item_id].dataType)
    for block in item_blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            block = held.value
            for rows, buf, offs in slices(batches, "_text"):
                hashes, at = word_hashes(buf, offs)
                found = block.matches(hashes, at)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array([d for d, *_ in found], pa.int64())), pa.array([block.ids[i] for _, i, *_ in found], kinds), pa.array([s for *_, s, _ in found], pa.int32()), pa.array([e for *_, e in found], pa.int32())],
                    ["doc_id", "item_id", "start_word", "equal_words"],
                )

        out = out.unionByName(picked.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, columns unchanged; rows with a null or empty text stay."""
    spark, schema = docs.sparkSession, docs.schema
    ship(spark)
    for block in item_blocks(items, item_id, item_text):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for rows, buf, offs in slices(batches, text_col):
                hashes, at = word_hashes(buf, offs)
                clean = np.ones(rows.num_rows, bool)
                clean[[d for d, *_ in held.value.matches(hashes, at)]] = False
                yield rows.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
