"""Periodic runs of words, by block matching.

A run is a stretch of words whose smallest period is q, at least max(12, 2 q) words long, that no neighbouring word extends
with period q. Where words q apart are equal over a stretch of m places, m >= max(12 - q, q), the stretch holds an
aligned block of a power of two B with 2 B - 1 <= m, and the block stands again q words on. So for each B:

1. Blocks at multiples of B whose words all recur near enough are keys of a pyahocorasick automaton over word numbers (those of more than
   KEY_WORDS words by their first ones); the whole document is searched for them.
2. Occurrences at the distances of that B (2 B - 1 to 4 B - 2; for the least runs see SCALES) are seeds.
3. A seed is extended to both sides word by word while words q apart are equal. What is long enough is a run, unless the same
   stretch has a smaller period.

Blocks and seeds in which a found run shows that only multiples of its period can follow are passed over, so text of one
repeated line takes about n log n steps, not n squared. A document is worked on whole, in the task that holds it; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import NOT_WHITE, distinct_spans, ragged, slices, words
from tesselix.sources.shipping import ship

LEAST = 12
#: Words of a key: a longer block is looked for by its first ones, and the extension of the seed looks at the others. (The automaton's
#: own code goes down a key by recursion.)
KEY_WORDS = 64


def scales(n: int) -> Iterator[tuple[int, list[tuple[int, int]], int]]:
    """Block length, ranges of distances, and how many places in a row must have equal words at one of these distances, for
    documents of n words. A run of period q < 12 has at least 12 words, so 12 - q such places: blocks of 4 do for all but 6."""
    yield 4, [(1, 5), (7, 14)], 7
    yield 2, [(6, 6)], 6
    size = 8
    while 2 * (2 * size - 1) <= n:
        yield size, [(2 * size - 1, 4 * size - 2)], 2 * size - 1
        size *= 2


def next_same(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How many places on the same word (codes from 0) stands again in the same text; beyond all distances if nowhere."""
    out = np.full(len(codes), np.iinfo(np.int64).max)
    if len(codes):
        key = text * (int(codes.max()) + 1) + codes
        order = np.argsort(key, kind="stable")  # places ascend within a word
        again = key[order[1:]] == key[order[:-1]]
        out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def long_stretches(good: np.ndarray, least: int) -> np.ndarray:
    """good, without its stretches of fewer than `least` places."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    kept = ends - starts >= least
    change = np.zeros(len(good) + 1, np.int64)
    change[starts[kept]] += 1
    change[ends[kept]] -= 1
    return np.cumsum(change)[:-1] > 0


def repeats_from(w: np.ndarray, at: int, q: int) -> int:
    """The first place from `at` on whose word isn't the one q places on."""
    last, step = len(w) - q, 64
    while at < last:
        to = min(at + step, last)
        unequal = w[at:to] != w[at + q : to + q]
        if unequal.any():
            return at + int(unequal.argmax())
        at, step = to, step * 2
    return last


def repeats_to(w: np.ndarray, at: int, q: int) -> int:
    """The first place before `at` from which on all words up to there are the ones q places on."""
    step = 64
    while at > 0:
        low = max(at - step, 0)
        unequal = w[low:at] != w[low + q : at + q]
        if unequal.any():
            return at - int(unequal[::-1].argmax())
        at, step = low, step * 2
    return 0


class Found:
    """Runs found so far, by period, in ascending order of their starts (and so of their ends: runs of one period overlap by
    less than it)."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, q: int, start: int, end: int) -> None:
        starts, ends = self.of.setdefault(q, ([], []))
        at = bisect_right(starts, start)
        if not at or starts[at - 1] != start:
            starts.insert(at, start)
            ends.insert(at, end)

    def multiples_of_found(self, q: int, at: np.ndarray) -> np.ndarray:
        """Seeds at these places whose first q words lie in a run whose period divides q: their stretch has that period."""
        known = np.zeros(len(at), bool)
        for p, (starts, ends) in self.of.items():
            if p < q and not q % p:
                i = np.searchsorted(starts, at, "right") - 1
                known |= (i >= 0) & (np.asarray(ends)[i] >= at + q)
        return known

    def reach(self, most: int, n: int) -> np.ndarray:
        """For each place the farthest end of a run, of period `most` or less, that starts there or before."""
        out = np.zeros(n, np.int64)
        for p, (starts, ends) in self.of.items():
            if p <= most:
                np.maximum.at(out, starts, ends)
        return np.maximum.accumulate(out)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period), by start, then period; of equal stretches the smallest period."""
        least: dict[tuple[int, int], int] = {}
        for p in sorted(self.of):
            for start, end in zip(*self.of[p], strict=True):
                least.setdefault((start, end), p)
        return sorted((start, end - start, p) for (start, end), p in least.items())


def seeds(w: np.ndarray, key: tuple[int, ...], starts: np.ndarray, size: int, distances: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of blocks and distances at which the same block stands again: an automaton of the blocks, over the document."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number: dict[tuple[int, ...], int] = {}
    size = min(size, KEY_WORDS)
    of = np.empty(len(starts), np.int64)
    for i, s in enumerate(starts.tolist()):
        block = key[s : s + size]
        of[i] = number.setdefault(block, len(number))
    for block, k in number.items():
        automaton.add_word(block, k)
    automaton.make_automaton()
    n = len(w) + 1
    hits = np.fromiter((k * n + end - size + 1 for end, k in automaton.iter(key)), np.int64)
    hits.sort()
    place, distance = [], []
    for low, high in distances:
        first = np.searchsorted(hits, of * n + np.minimum(starts + low, len(w)))
        last = np.searchsorted(hits, of * n + np.minimum(starts + high, len(w)), "right")
        count = last - first
        at = np.repeat(starts, count)
        place.append(at)
        distance.append(hits[ragged(first, count)] % n - at)
    return np.concatenate(place), np.concatenate(distance)


def runs(w: np.ndarray, again: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers w; again: how far on each word stands again."""
    n, found, key = len(w), Found(), None
    for size, distances, least in scales(n):
        blocks = n // size
        near = long_stretches(again <= distances[-1][1], least)
        # the last word of a run's last period needs no later one: blocks lie before it
        starts = np.flatnonzero(near[: blocks * size].reshape(blocks, size).all(1)) * size
        if len(starts) and found.of:
            # a run of period size or less that holds the block and all its distances: only multiples of that period follow
            starts = starts[found.reach(size, n)[starts] < np.minimum(starts + size + distances[-1][1], n)]
        if not len(starts):
            continue
        key = key or tuple(w.tolist())
        place, distance = seeds(w, key, starts, size, distances)
        order = np.lexsort((place, distance))
        place, distance = place[order], distance[order]
        edges = np.flatnonzero(np.diff(distance, prepend=-1, append=-1))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            q, at = int(distance[i]), place[i:j]
            at, k = at[~found.multiples_of_found(q, at)], 0
            while k < len(at):
                low, high = repeats_to(w, int(at[k]), q), repeats_from(w, int(at[k]), q)
                if high + q - low >= max(LEAST, 2 * q):
                    found.add(q, low, high + q)
                k = int(np.searchsorted(at, high))
    return found.runs()


def planted(h: int, n: int) -> tuple[int, int] | None:
    """Of a document with this checksum and n words: the word from which on it is made periodic, and the period."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def dropped(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether a word stands after the first period of a run."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:-1] > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period in words, by start, then period), collapsed: the words
    that aren't after the first period of a run, joined by one space.

    plant: of one document in ten (by the checksum of its decimal id) the words from some word on are first replaced by a
    repetition of the words there. A null or empty text has no words and no runs; a null id is never planted. Repeated rows give
    repeated rows, an empty table none; other columns are dropped."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        for rows, buf, offs in slices(batches, "_text"):
            data, ids = buf.tobytes(), rows.column(0).to_pylist()
            starts, ends, at = words(buf, offs, NOT_WHITE)
            codes = distinct_spans(buf, starts, ends)[0]
            n_words, remade = np.diff(at), set()
            for t, n in enumerate(n_words.tolist()):
                made = planted(zlib.crc32(str(ids[t]).encode()), n) if plant and ids[t] is not None else None
                if made:
                    remade.add(t)
                    a, p = made
                    codes[at[t] + a : at[t + 1]] = codes[at[t] + a + np.arange(n - a) % p]
            again = next_same(codes, np.repeat(np.arange(len(n_words)), n_words))
            found, texts = [], []
            for t, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                here = runs(codes[i:j], again[i:j]) if j - i >= LEAST else []
                kept = data[offs[t] : offs[t + 1]].split()
                if t in remade:
                    a, p = planted(zlib.crc32(str(ids[t]).encode()), j - i)
                    kept = kept[:a] + [kept[a + k % p] for k in range(j - i - a)]
                if here:
                    kept = [w for w, gone in zip(kept, dropped(here, j - i).tolist(), strict=True) if not gone]
                found.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                texts.append(b" ".join(kept))
            collapsed = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words), pa.array(found, pa.list_(RUN)), collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(picked.dtypes)["doc_id"]
    return picked.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
