"""Token counts by a linear longest-match automaton.

Greedy word-piece splitting takes, again and again, the longest vocabulary piece that begins what is left of a word.
The automaton reads each byte once: its states are the trie of the pieces; where a state has no edge for the next
byte, it pops the pieces that greedy splitting settles on by then (only their number is kept, computed beforehand) and
goes on from the state its failure link names. So a word's length in pieces is a sum of popped counts and no piece is
ever built. All distinct words of a slice move through the automaton together, a byte a step.

Greedy counts are those of a word-piece tokenizer. Over the pieces of a byte-pair vocabulary, as in the registered query, they are
the lengths of the longest-match splits; that vocabulary's own tokenizer merges by rank and may give other counts.

A vocabulary is a list of pieces as bytes: those that begin a word start with a space, the others continue one.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import NOT_WHITE, distinct_spans, slices, text_or_empty, words
from tesselix.sources.shipping import ship

NONE = -1
#: Longer words are walked one by one.
TOGETHER = 256


def ranked_pieces(path: str) -> list[bytes]:
    """The pieces of a file of base64 pieces and ranks; pieces with white space after their first byte are never used."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if not any(c in b"\t\n\x0b\x0c\r " for c in p[1:]) and not (len(p) > 0 and p[0] in b"\t\n\x0b\x0c\r")]


def marked_pieces(vocabulary: list[str], mark: str = "##") -> list[bytes]:
    """Pieces of a vocabulary that marks those that continue a word."""
    return [p[len(mark) :].encode() if p.startswith(mark) else b" " + p.encode() for p in vocabulary]


class Automaton:
    def __init__(self, pieces: list[bytes]):
        edges: dict[int, int] = {}
        depth, is_piece = [0], [False]
        for piece in pieces:
            state = 0
            for c in piece:
                nxt = edges.get(state << 8 | c)
                if nxt is None:
                    nxt = edges[state << 8 | c] = len(depth)
                    depth.append(depth[state] + 1)
                    is_piece.append(False)
                state = nxt
            is_piece[state] = bool(piece)
        self.edges = edges
        self.fail, self.pops = [NONE] * len(depth), [0] * len(depth)
        for key in sorted(edges, key=lambda k: depth[edges[k]]):  # by depth: shorter states are complete
            state, parent, c = edges[key], key >> 8, key & 255
            if is_piece[state]:
                self.fail[state], self.pops[state] = 0, 1
                continue
            at, popped = self.fail[parent], self.pops[parent]
            while at != NONE and (at << 8 | c) not in edges:
                popped += self.pops[at]
                at = self.fail[at]
            if at != NONE:
                self.fail[state], self.pops[state] = edges[at << 8 | c], popped
        # At a word's end: the pieces left to pop until nothing is left, or NONE if something can't be.
        self.rest = [0] + [NONE] * (len(depth) - 1)
        for state in sorted(range(1, len(depth)), key=lambda s: depth[s]):
            if (to := self.fail[state]) != NONE and self.rest[to] != NONE:
                self.rest[state] = self.pops[state] + self.rest[to]
        order = np.array(sorted(edges), np.int64)
        self.keys, self.to = order, np.array([edges[k] for k in order.tolist()], np.int64)
        self.fails, self.popped, self.rests = (np.array(x, np.int64) for x in (self.fail, self.pops, self.rest))
        self.begin = edges.get(0x20, NONE)

    def length(self, word: bytes) -> int:
        """The number of pieces of one word; a word that can't be split is one unknown piece."""
        state, n = self.begin, 0
        for c in word:
            while state != NONE and (state << 8 | c) not in self.edges:
                n += self.pops[state]
                state = self.fail[state]
            if state == NONE:
                return 1
            state = self.edges[state << 8 | c]
        return n + self.rest[state] if state != NONE and self.rest[state] != NONE else 1

    def lengths(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """length() of the spans of buf."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state, n = np.full(len(order), self.begin), np.zeros(len(order), np.int64)
        long = int(np.searchsorted(-sizes, -TOGETHER, "left"))
        for at in range(int(sizes[long]) if long < len(sizes) else 0):
            live = np.arange(long, np.searchsorted(-sizes, -at, "left"))
            live = live[state[live] != NONE]
            c = buf[starts[live] + at]
            while len(live):
                key = state[live] << 8 | c
                edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[edge] == key
                state[live[hit]] = self.to[edge[hit]]
                live, c = live[~hit], c[~hit]
                n[live] += self.popped[state[live]]
                state[live] = self.fails[state[live]]
                c, live = c[state[live] != NONE], live[state[live] != NONE]
        left = np.where(state == NONE, NONE, self.rests[state])
        out = np.empty(len(order), np.int64)
        out[order] = np.where(left == NONE, 1, n + left)
        for i in range(long):
            out[order[i]] = self.length(buf[starts[i] : starts[i] + sizes[i]].tobytes())
        return out


_automata: dict[str, Automaton] = {}


def count_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words (separated by ASCII white space), n_tokens (their pieces). Null and
    empty texts have 0 of both; repeated rows and null ids stay; an empty table gives none; other columns are dropped."""
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))

    def run(batches):
        if path not in _automata:
            _automata[path] = Automaton(ranked_pieces(path))
        automaton = _automata[path]
        for rows, buf, offs in slices(batches, "_text"):
            starts, ends, at = words(buf, offs, NOT_WHITE)
            codes, spans = distinct_spans(buf, starts, ends)
            _, edge, data = spans.buffers()
            n = np.zeros(0, np.int64)
            if len(spans):
                edge = np.frombuffer(edge, np.int64)[: len(spans) + 1]
                n = automaton.lengths(np.frombuffer(data, np.uint8), edge[:-1], np.diff(edge))[codes]
            total = np.concatenate([[0], np.cumsum(n)])[at]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(np.diff(total))], ["doc_id", "n_words", "n_tokens"])

    return picked.mapInArrow(run, f"doc_id {dict(picked.dtypes)['doc_id']}, n_words bigint, n_tokens bigint")
