"""Token ids of whole texts by the tokenizers library.

Where a tokenizer drops white space and lower-cases ASCII letters, the ids of a text are those of its words one after
another. Then each distinct word is encoded once, by the library, and texts are put together from the words' ids.
Whether that holds is found out from the tokenizer itself; where it does not, texts are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from tesselix.llm.common import LOWER, NOT_WHITE, distinct_spans, ragged, release, slices

_DIGIT_OR_LETTER = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _DIGIT_OR_LETTER[_a:_b] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
#: Words whose ids are kept from one slice to the next.
KEPT = 600_000
MARK = b"~"
#: At a task's end, words that came in one slice only are given up where more than this many are kept.
KEPT_ON = 400_000
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+")
# Fixed values of byte-level vocabularies: these bytes stand for themselves, the others, in order, for 256 and on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SELF)))}
#: Bytes of text encoded together.
TOGETHER = 1 << 22


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """ids of texts, as encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda *texts: [i for t in texts for i in self.tokenizer.encode(t, add_special_tokens=False).ids]
        probes = (("Ab cD", "Ab", "cD"), ("ab\n\t éx.,» it's 12,5.", "ab", "éx.,»", "it's", "12,5."), ("ΣaΣ x\r\x0b\x0cY", "ΣaΣ", "x", "Y"), ("ab...\"", "ab", "...\""), ("7,́x", "7", ",́x"), ("AB's", "ab's"), ("",))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = all(ids(whole) == ids(*parts) for whole, *parts in probes) and not any(c.isspace() for t in added for c in t)
        #: Added tokens are looked for before letters are lowered: with any sign of one, letters stay as they are.
        self.guard = {t[0].encode()[0] for t in added if t}
        mark = ids("~")
        self.mark = mark[0] if self.by_words and len(mark) == 1 and ids("ab ~ ~\n,é") == ids("ab", "~", "~", ",é") else None
        self.direct = self.by_words and not any(t.isalpha() for t in added)
        self.letters = self.direct and self.tokenizer.normalizer is not None
        self.checked = self.tried = False
        self.start()

    def start(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths, self.slices = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def forget(self) -> None:
        """Keeps the words that have been in more than one slice, if they are half of what is kept at most."""
        old, flat, starts, lengths, slices = self.known, self.flat, self.starts, self.lengths, self.slices
        order = [w for w, i in old.items() if slices[i] > 1]
        self.start()
        if 2 * len(order) > KEPT:
            return
        of = np.fromiter((old[w] for w in order), np.int64, len(order))
        n = lengths[of]
        self.flat = np.concatenate([flat[ragged(starts[of], n)], np.zeros(1 << 16, np.uint32)])
        room = np.zeros(1 << 14, np.int64)
        self.used = int(n.sum())
        self.starts, self.lengths, self.slices = np.concatenate([np.cumsum(n) - n, room]), np.concatenate([n, room]), np.zeros(len(n) + len(room), np.int32)
        self.slices[: len(n)] = 1
        self.known = {w: i for i, w in enumerate(order)}

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, spans: list[bytes]) -> tuple[list[int], list[list[int]]]:
        """Which spans are words of Latin letters once the library has normalised them, and their ids by the model."""
        which, out, model = [], [], self.tokenizer.model
        usable = [i for i, s in enumerate(spans) if MARK not in s]
        for at in range(0, len(usable), 500):
            some = usable[at : at + 500]
            # apart by the mark: a word may hold white space of other scripts, or be nothing else
            parts = self.tokenizer.normalizer.normalize_str(MARK.join([spans[i] for i in some]).decode()).split(MARK.decode())
            if len(parts) != len(some):
                continue
            for i, p in zip(some, parts, strict=True):
                if _LATIN.fullmatch(p):
                    which.append(i)
                    out.append([t.id for t in model.tokenize(p.encode().decode("latin-1").translate(_BYTES))])
        return which, out

    def _together(self, spans: list[bytes]) -> list[list[int]]:
        """Words as one text, apart by a mark that is one id and in none of them."""
        if self.mark is None or any(MARK in s or not self.guard.isdisjoint(s) for s in spans):
            return self._plain([s.decode() for s in spans])
        out = []
        for at in range(0, len(spans), 500):
            some = spans[at : at + 500]
            ids = np.array(self.tokenizer.encode(b" ~ ".join(some).decode(), add_special_tokens=False).ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(some) - 1:
                out += self._plain([s.decode() for s in some])
                continue
            cuts = [-1, *marks.tolist(), len(ids)]
            ids = ids.tolist()
            out += [ids[i + 1 : j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _learn(self, spans: list[bytes]) -> None:
        for at in range(0, len(spans), 20_000):
            some = spans[at : at + 20_000]
            # A run of small ASCII letters is one word of the model's as it is: nothing to normalise or split.
            direct = [s for s in some if self.direct and s.isalpha() and s.islower()]
            model = self.tokenizer.model
            got = [[t.id for t in model.tokenize(s.decode())] for s in direct]
            if direct and not self.checked:
                self.checked = True
                if self._plain([s.decode() for s in direct[:500]]) != got[:500]:
                    self.direct, direct, got = False, [], []
            if len(direct) < len(some):
                rest = [s for s in some if not s.isalpha() or not s.islower()] if direct else some
                if self.letters:
                    which, ids = self._letters(rest)
                    words = [rest[i] for i in which]
                    if which and not self.tried:
                        self.tried = True
                        self.letters = self._plain([s.decode() for s in words[:500]]) == ids[:500]
                    if which and self.letters:
                        other = set(range(len(rest))).difference(which)
                        direct, got, rest = direct + words, got + ids, [rest[i] for i in sorted(other)]
                got += self._together(rest)
                some = direct + rest
            n, first = np.fromiter(map(len, got), np.int64, len(got)), len(self.known)
            total = int(n.sum())
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while first + len(some) > len(self.starts):
                self.starts, self.lengths, self.slices = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.slices))
            self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.starts[first : first + len(some)] = self.used + np.cumsum(n) - n
            self.lengths[first : first + len(some)] = n
            self.used += total
            self.known.update(zip(some, range(first, first + len(some)), strict=True))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in buf, and the ids before each text."""
        if not self.by_words:
            data = buf.tobytes()
            got = [e.ids for e in self.tokenizer.encode_batch([data[i:j].decode() for i, j in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])
            return np.fromiter((i for x in got for i in x), np.uint32, int(at[-1])), at
        guarded = np.isin(np.array(sorted(self.guard), np.uint8), np.unique(buf)).any() if self.guard else False
        low = buf if guarded else LOWER[buf]
        w = NOT_WHITE[buf]
        cut = np.zeros(len(buf), bool)  # a full stop or comma after a letter begins a run of its own
        cut[1:] = _DIGIT_OR_LETTER[buf[:-1]] & _STOP[buf[1:]]
        begin = offs[:-1][offs[1:] > offs[:-1]]
        fresh = np.empty(len(buf), bool)
        fresh[:1], fresh[1:] = True, ~w[:-1]
        fresh[begin] = True
        starts = np.flatnonzero(w & (fresh | cut))
        stop = np.empty(len(buf), bool)
        stop[-1:] = True
        stop[:-1] = ~w[1:] | cut[1:]
        stop[begin[1:] - 1] = True
        ends = np.flatnonzero(w & stop) + 1
        codes, spans = distinct_spans(low, starts, ends)
        spans = spans.to_pylist()
        if len(self.known) + len(spans) > KEPT:
            self.forget()
        known = self.known.get
        of = np.fromiter((known(s, -1) for s in spans), np.int64, len(spans))
        new = np.flatnonzero(of < 0)
        if len(new):
            fresh = [spans[i] for i in new.tolist()]
            self._learn(fresh)
            of[new] = np.fromiter((self.known[s] for s in fresh), np.int64, len(fresh))
        self.slices[of] += 1
        lengths = self.lengths[of][codes]
        at = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offs)]
        return self.flat[ragged(self.starts[of][codes], lengths)], at


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], column: str, path: str, end: int | None, together: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, ids before each row's text) for slices of the batches of at most `together` bytes or one text; `end` is
    appended to each text's ids."""
    own = encoder(path)
    for rows, buf, offs in slices(batches, column, together):
        ids, at = own.encode(buf, offs)
        if end is not None:
            n = len(at) - 1
            out = np.empty(len(ids) + n, np.uint32)
            last = at[1:] + np.arange(n)
            text = np.ones(len(out), bool)
            text[last] = False
            out[last], out[text] = end, ids
            ids, at = out, at + np.arange(n + 1)
        yield rows, ids, at
    if len(own.known) > KEPT_ON:  # Spark keeps the worker; it needn't keep words that came once
        own.forget()
        release()
