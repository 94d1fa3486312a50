"""Toxicity: a factorization machine over hashed terms.

Terms are hashed to DIMENSIONS buckets: lower-case runs of letters and digits, their beginnings (compounds and endings
differ, stems don't), the same again where they repeat, and the order of the text's length. A text is the set of its
buckets. The machine adds to linear weights a product of small factor vectors for each pair of terms, so that a pair, such as an
insult with the mention of a group, can weigh more or less than its terms do alone.

Fitting: of the labelled rows to learn from, at most `sample` distinct texts (those with the smallest hashes) are
used. A term enters the machine by its own evidence or by that of a pair it is in: a term whose texts are toxic at
another rate than all texts, and two words whose common texts are toxic at another rate than the two words' own rates,
added up, would make them. So words that say nothing alone enter as well. Evidence is n KL(observed | expected) for n texts,
which bounds the logarithm of the chance of such a count; it must exceed the logarithm of the number of terms, or pairs,
that were looked at, so noise is expected to bring in one at most, whatever the size. Every term and every pair of words is looked at; words in
so few texts that no pair of theirs could reach the bar are passed over. Pairs are counted over at most `pair_texts` of the texts,
in blocks of words that tasks work on by themselves; no pair is written anywhere.

One fifth of the learnable texts, by their hashes, is kept from the choice of terms: it chooses the weight decay. The
weights are then fitted to all of them. Rows that are held out for others are in none of this. Scoring covers all rows.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import ALNUM, LOWER, materialise, mix, ragged, slices, span_hashes, text_or_empty, unused, words
from tesselix.sources.shipping import ship

DIMENSIONS = 1 << 20
#: Bytes of a word's beginning that are terms as well, and how often a term must stand in a text to count once more.
PREFIXES = (4, 5, 6)
REPEATS = (2, 3, 5, 8)
#: Weight decays that the inner split chooses from.
DECAYS = (1e-3, 1e-4, 1e-5)
#: Cells (texts by terms) of a table that the driver fits, 128 MB of them; of more, only those that are set are kept.
CELLS = 1 << 25
#: Pairs that a task holds at once.
PAIRS = 1 << 22


def _buckets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and buckets of all words and of their beginnings, and the words of each text."""
    starts, ends, at = words(buf, offs, ALNUM)
    text, low = np.repeat(np.arange(len(offs) - 1), np.diff(at)), LOWER[buf]
    mask = np.uint64(DIMENSIONS - 1)
    texts, found = [text], [mix(span_hashes(low, starts, ends), 7) & mask]
    for n in PREFIXES:
        longer = ends - starts > n
        texts.append(text[longer])
        found.append(mix(span_hashes(low, starts[longer], starts[longer] + n), 7 + n) & mask)
    return np.concatenate(texts), np.concatenate(found).astype(np.int64), np.diff(at)


def _distinct(buf: np.ndarray, offs: np.ndarray, base: np.ndarray | None = None, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs without repeats, ascending by text. `of` maps buckets to terms in use, -1 for the others;
    `base` marks the buckets of which any repeat count is in use, so that the others are left out early."""
    text, found, n_words = _buckets(buf, offs)
    if base is not None:
        text, found = text[base[found]], found[base[found]]
    pairs, times = np.unique(text * DIMENSIONS + found, return_counts=True)
    text, found = pairs // DIMENSIONS, pairs % DIMENSIONS
    texts, terms = [text], [found]
    for n in REPEATS:
        texts.append(text[times >= n])
        terms.append(repeated(found[times >= n], n))
    texts.append(np.arange(len(offs) - 1))
    terms.append(repeated(np.log2(n_words + 1.0).astype(np.int64), 0))
    text, found = np.concatenate(texts), np.concatenate(terms)
    if of is not None:
        found = of[found]
        text, found = text[found >= 0], found[found >= 0]
    pairs = np.unique(text * DIMENSIONS + found)
    return pairs // DIMENSIONS, pairs % DIMENSIONS


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs of whole words, without repeats, ascending."""
    starts, ends, at = words(buf, offs, ALNUM)
    found = (mix(span_hashes(LOWER[buf], starts, ends), 7) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    pairs = np.unique(np.repeat(np.arange(len(offs) - 1), np.diff(at)) * DIMENSIONS + found)
    return pairs // DIMENSIONS, pairs % DIMENSIONS


def repeated(buckets: np.ndarray, n: int) -> np.ndarray:
    """The bucket of `this bucket's term at least n times`; n = 0: of a length of text."""
    return (mix(buckets.astype(np.uint64), 100 + n) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


class Machine:
    """score(x) = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms i, j of a text that are in use."""

    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.bias, self.w, self.v = buckets, bias, w, v

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Which buckets matter, at once or repeated, and the term of each bucket in use."""
        of = np.full(DIMENSIONS, -1, np.int64)
        of[self.buckets] = np.arange(len(self.buckets))
        every = np.arange(DIMENSIONS)
        return np.logical_or.reduce([of >= 0, *(of[repeated(every, n)] >= 0 for n in REPEATS)]), of

    def scores(self, text: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(text, self.w[term], n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            v = self.v[term, f]
            pairs += np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))


def evidence(n: np.ndarray, pos: np.ndarray, expected: np.ndarray | float) -> np.ndarray:
    """n KL(pos / n | expected): by Chernoff's bound, a count at least as far off has at most exp(-this) of chance."""
    r = pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        up, down = np.where(pos > 0, r * np.log(r / expected), 0.0), np.where(pos < n, (1 - r) * np.log((1 - r) / (1 - expected)), 0.0)
    return n * (up + down)


class WordSets:
    """The words of some labelled texts, renumbered by rising number of texts, those left out that no pair could have
    evidence with."""

    def __init__(self, sets: list[np.ndarray], toxic: np.ndarray):
        of, own = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([*sets, np.zeros(0, np.int64)])
        self.toxic, self.rate = toxic.astype(bool), min(max(float(toxic.mean()), 1e-9), 1 - 1e-9)
        n = np.bincount(own, minlength=DIMENSIONS)
        self.bar = np.log(max(float((np.bincount(of) ** 2.0).sum()) / 2, 2.0)) if len(own) else np.inf
        order = np.argsort(n, kind="stable")
        order = order[n[order] * -np.log(min(self.rate, 1 - self.rate)) >= self.bar]
        self.words, self.n = order, n[order]
        number = np.full(DIMENSIONS, -1, np.int32)
        number[order] = np.arange(len(order))
        kept = number[own] >= 0
        of, own = of[kept], number[own[kept]]
        order = np.lexsort((own, of))
        self.of, self.own = of[order].astype(np.int32), own[order].astype(np.int32)
        self.ends = np.searchsorted(self.of, np.arange(len(sets)), "right").astype(np.int64)
        self.places = np.argsort(self.own, kind="stable").astype(np.int32)  # by word
        self.firsts = np.searchsorted(self.own[self.places], np.arange(len(self.words) + 1)).astype(np.int64)
        pos = np.bincount(self.own, self.toxic[self.of], len(self.words))
        rate = (pos + 2 * self.rate) / (self.n + 2)
        self.logit = np.log(rate / (1 - rate)) - np.log(self.rate / (1 - self.rate))

    def blocks(self) -> list[tuple[int, int]]:
        """Runs of words with a bounded number of cells beside all words."""
        step = max(1, PAIRS // max(len(self.words), 1))
        return [(i, min(i + step, len(self.words))) for i in range(0, len(self.words), step)]

    def telling(self, low: int, high: int) -> np.ndarray:
        """The words of pairs with evidence, of the pairs of a word from low to high with one after it."""
        places = self.places[self.firsts[low] : self.firsts[high]].astype(np.int64)
        after = self.ends[self.of[places]] - places - 1
        wide, cuts = len(self.words), np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + PAIRS, PAIRS)[1:], "right")
        n, pos, at = np.zeros((high - low) * wide, np.int64), np.zeros((high - low) * wide, np.int64), 0
        for to in np.unique(np.append(cuts, len(places))).tolist():
            some, count = places[at:to], after[at:to]
            at = to
            code = np.repeat((self.own[some].astype(np.int64) - low) * wide, count) + self.own[ragged(some + 1, count)]
            n += np.bincount(code, minlength=len(n))
            pos += np.bincount(code[np.repeat(self.toxic[self.of[some]], count)], minlength=len(n))
        met = np.flatnonzero(n)
        a, b = met // wide + low, met % wide
        expected = 1 / (1 + np.exp(-np.clip(np.log(self.rate / (1 - self.rate)) + self.logit[a] + self.logit[b], -30, 30)))
        told = evidence(n[met], pos[met], expected) >= self.bar
        return self.words[np.unique(np.concatenate([a[told], b[told]]))]


class Ones:
    """A table of zeros and ones by the places of the ones, for products."""

    def __init__(self, row: np.ndarray, column: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.shape = row, column, shape

    @property
    def T(self) -> Ones:  # noqa: N802
        return Ones(self.column, self.row, self.shape[::-1])

    def __matmul__(self, m: np.ndarray) -> np.ndarray:
        columns = m.reshape(len(m), -1)
        out = np.column_stack([np.bincount(self.row, c[self.column], self.shape[0]) for c in columns.T]).astype(np.float32)
        return out[:, 0] if m.ndim == 1 else out


def fit_machine(sets: list[np.ndarray], toxic: np.ndarray, buckets: np.ndarray, factors: int = 4, rounds: int = 250, rate: float = 0.05, decay: float = 1e-5) -> Machine:
    """Adam on the logistic loss with weight decay; equal sets of terms are one row with a weight."""
    rows: dict[bytes, list] = {}
    for s, y in zip(sets, toxic, strict=True):
        row = rows.setdefault(s.tobytes(), [s, 0, 0])
        row[1 + int(y)] += 1
    fitted = list(rows.values())
    of, own = np.repeat(np.arange(len(fitted)), [len(s) for s, _, _ in fitted]), np.concatenate([*(s for s, _, _ in fitted), np.zeros(0, np.int64)])
    if len(fitted) * len(buckets) <= CELLS:
        x = np.zeros((len(fitted), len(buckets)), np.float32)
        x[of, own] = 1
    else:
        x = Ones(of, own, (len(fitted), len(buckets)))
    neg, pos = (np.array([r[k] for r in fitted], np.float32) for k in (1, 2))
    total = neg.sum() + pos.sum()
    rng = np.random.default_rng(1)
    start = [np.array([np.log((pos.sum() + 1) / (neg.sum() + 1))]), np.zeros(len(buckets)), rng.normal(0, 0.05, (len(buckets), factors))]
    params = [p.astype(np.float32) for p in start]
    m, s2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        bias, w, v = params
        xv = x @ v
        z = bias + ((xv**2).sum(1) + x @ (2 * w - (v * v).sum(1))) / 2
        grads = gradients(x, xv, z, w, v, neg, pos, total, decay)
        for k, grad in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * grad
            s2[k] = 0.999 * s2[k] + 0.001 * grad**2
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets, float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64))


def gradients(x, xv, z, w, v, neg, pos, total, decay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean logistic loss plus decay / 2 times the squares of w and v, by bias, w and v; all in one product."""
    g = ((pos + neg) / (1 + np.exp(-np.clip(z, -30, 30))) - pos) / total
    both = x.T @ np.column_stack([g, g[:, None] * xv])
    xg = both[:, 0]
    return g.sum(keepdims=True), xg + decay * w, both[:, 1:] - xg[:, None] * v + decay * v


def log_loss(machine: Machine, sets: list[np.ndarray], toxic: np.ndarray) -> float:
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    p = np.clip(machine.scores(text, np.concatenate([*sets, np.zeros(0, np.int64)]), len(sets)), 1e-6, 1 - 1e-6)
    return float(-np.where(toxic > 0, np.log(p), np.log(1 - p)).mean())


def learnable(id_col: str = "doc_id"):
    """The rows whose labels may be learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """_y, _inner, _nth (an order by hash) and _text of at most `sample` distinct learnable texts."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_y"))
    marked = marked.filter(learnable("doc_id"))
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_h")).join(marked, "doc_id")
    chosen = keyed.groupBy("_h").agg(F.min("doc_id").alias("doc_id"), (F.avg("_y") >= 0.5).cast("int").alias("_y"))
    chosen = chosen.select("doc_id", "_y", (F.pmod(F.xxhash64("_h", F.lit(5)), F.lit(5)) == 0).alias("_inner"), F.xxhash64("_h", F.lit(3)).alias("_nth")).orderBy("_nth", "doc_id").limit(sample)
    chosen = materialise(chosen, "toxic-sample")
    # at most `sample` rows of four numbers
    return materialise(docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).join(F.broadcast(chosen), "doc_id").select("_y", "_inner", "_nth", "_text"), "toxic-texts")


def _telling_terms(rows: DataFrame) -> np.ndarray | None:
    """The buckets whose own texts differ from all texts; None if the texts are of one kind."""

    def count(batches):
        n = np.zeros((2, DIMENSIONS), np.int64)
        texts = np.zeros(2, np.int64)
        for b, buf, offs in slices(batches, "_text"):
            y = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            text, bucket = _distinct(buf, offs)
            n += np.bincount(y[text] * DIMENSIONS + bucket, minlength=2 * DIMENSIONS).reshape(2, -1)
            texts += np.bincount(y, minlength=2)
        used = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(n[0][used], texts[0])), pa.array(np.append(n[1][used], texts[1]))], ["bucket", "neg", "pos"])

    counts = rows.select("_y", "_text").mapInArrow(count, "bucket long, neg long, pos long").groupBy("bucket").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    counts = materialise(counts, "toxic-counts")
    totals = counts.filter("bucket = -1").first()
    neg, pos = (totals["neg"], totals["pos"]) if totals else (0, 0)
    if not neg or not pos:
        return None
    n, base = F.col("neg") + F.col("pos"), pos / (neg + pos)
    part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / n / F.lit(q))).otherwise(0.0)
    terms = counts.filter("bucket >= 0")
    told = terms.filter(part("pos", base) + part("neg", 1 - base) >= F.lit(float(np.log(max(terms.count(), 2)))))
    return np.array(sorted(r["bucket"] for r in told.select("bucket").collect()), np.int64)  # at most DIMENSIONS numbers


def _telling_pairs(rows: DataFrame, pair_texts: int) -> np.ndarray:
    """The buckets of words in pairs with evidence. The driver holds the word sets of at most `pair_texts` texts, and
    tasks count all pairs of a block of words against them."""

    def sets(batches):
        for b, buf, offs in slices(batches, "_text"):
            text, bucket = _words(buf, offs)
            cut = np.searchsorted(text, np.arange(len(offs)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bucket[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["_y", "_nth", "words"])

    last = rows.select("_nth").orderBy("_nth").limit(pair_texts).agg(F.max("_nth")).first()[0]
    some = rows.select("_y", "_nth", "_text").filter(F.col("_nth") <= F.lit(last))
    got = some.mapInArrow(sets, "_y int, _nth bigint, words binary").collect()  # at most `pair_texts` sets of DIMENSIONS numbers
    got.sort(key=lambda r: r["_nth"])
    own = WordSets([np.frombuffer(bytes(r["words"]), np.int32).astype(np.int64) for r in got], np.array([r["_y"] for r in got]))
    blocks = own.blocks()
    if not blocks:
        return np.zeros(0, np.int64)
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(own)

    def count(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(held.value.telling(*blocks[i]))], ["bucket"])

    found = spark.range(0, len(blocks), 1, min(len(blocks), 256)).mapInArrow(count, "bucket bigint").distinct().collect()  # at most DIMENSIONS numbers
    held.unpersist()
    return np.array(sorted(r["bucket"] for r in found), np.int64)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 30_000, pair_texts: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fits a machine to the labels of docs (0 or 1; null labels, null ids and ids without a row in docs count for
    nothing; a repeated text counts once, as toxic if most of its labels say so). With no labels, or labels of one kind,
    the machine scores every text alike, by the share of toxic ones (0 without labels). So it does, with a warning, where labels are so few
    that no term's or pair's evidence passes the bar: four toxic texts with one term among a hundred texts may not."""
    ship(docs.sparkSession)
    rows = _sampled(docs, labels, sample, id_col, text_col, label_col)
    kinds = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0, np.int64)
    if len(kinds) < 2:
        return Machine(none, 30.0 if 1 in kinds else -30.0, np.zeros(0), np.zeros((0, 1)))
    outer = rows.filter("not _inner")
    own = _telling_terms(outer)
    buckets = none if own is None else np.union1d(own, _telling_pairs(outer, pair_texts))
    if not len(buckets):
        warnings.warn(f"{kinds} texts tell no term from chance: all texts get one score, the share of toxic ones", stacklevel=2)
    base, of = Machine(buckets, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), 1))).lookup()

    def sets(batches):
        for b, buf, offs in slices(batches, "_text"):
            text, term = _distinct(buf, offs, base, of)
            cut = np.searchsorted(text, np.arange(len(offs)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([term[i:j].astype(np.int32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["_y", "_inner", "_nth", "terms"])

    got = rows.mapInArrow(sets, "_y int, _inner boolean, _nth bigint, terms binary").collect()  # at most `sample` sets of the terms in use
    got.sort(key=lambda r: (r["_nth"], bytes(r["terms"])))
    all_sets, toxic = [np.frombuffer(bytes(r["terms"]), np.int32).astype(np.int64) for r in got], np.array([r["_y"] for r in got])
    inner = np.array([r["_inner"] for r in got])
    part = lambda mask: ([s for s, m in zip(all_sets, mask, strict=True) if m], toxic[mask])
    best = DECAYS[0]
    if inner.any() and not inner.all():
        best = min(DECAYS, key=lambda d: log_loss(fit_machine(*part(~inner), buckets, decay=d, rounds=120), *part(inner)))
    return fit_machine(all_sets, toxic, buckets, decay=best)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a column `out` (any column of that name is replaced). Null texts count as empty; empty texts score by
    the bias and the term of their length; repeated rows score alike."""
    ship(docs.sparkSession)
    base, of = machine.lookup()
    (text,) = unused(docs, "_text")
    kept = [c for c in docs.columns if c != out]
    given = docs.select(*kept, text_or_empty(text_col).alias(text))

    def run(batches):
        for b, buf, offs in slices(batches, text):
            found, term = _distinct(buf, offs, base, of)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(machine.scores(found, term, len(offs) - 1))], [*kept, out])

    return given.mapInArrow(run, docs.select(*kept).withColumn(out, F.lit(0.0).cast("double")).schema)


def drop_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, columns unchanged."""
    (out,) = unused(docs, "_toxicity")
    return score(docs, machine, text_col, out).filter(F.col(out) < threshold).drop(out)
