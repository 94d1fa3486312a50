"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A text is a set of weighted shingles of SHINGLE words (lower-case letters and digits): a shingle weighs the times it
stands in the text by the mean inverse document frequency of its words, counted over all documents in a table of
hashed words of fixed size. Two texts are near copies if their weighted Jaccard similarity (sum of the smaller by sum of
the larger weights) is `similarity` or more; classes are the connected components of that.

Equal texts are one node from the start, so copies never meet. SAMPLES improved consistent weighted samples a text
agree each with a probability equal to the similarity; BANDS bands of them put nodes into buckets (at a similarity of
0.8 all bands miss a pair with probability 0.0002, at 0.85 with 0.000007).

1. In each bucket one pivot meets every other member. Samples are compared first: a pair of which fewer agree than all but one in
   a million pairs of the least similarity do is settled. The others are verified by the exact similarity.
2. What buckets then still hold several classes of meets by samples only, which finds the nodes that have a likely
   partner in another class.
3. Those are settled pair by pair: nodes that such buckets connect are a family, families are dealt to groups of two
   chunks of bounded size each, and every two nodes of a group that share a bucket and are of different classes are
   verified. The largest class of a family meets the others only, never itself.

Pairs are compared inside the tasks; only links, and in step 2 nodes, leave them. Texts are moved compressed, and only
those that a pair is verified for. A text is worked on whole; beside it a task holds some tens of bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tesselix.llm.common import ALNUM, HOT, LOWER, SLICE_BYTES, hot_keys, materialise, mix, salted_join, shingle_hashes, slices, span_hashes, text_or_empty, words
from tesselix.llm.components import components
from tesselix.sources.shipping import ship

SHINGLE = 5
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
WORDS = 1 << 16
#: Members that meet a pivot in one group, and nodes of a family in one chunk; shingles of a chunk.
GROUP = 512
GROUP_SHINGLES = 1 << 20
#: Nodes of a bucket that meet by samples in one chunk.
SKETCHES = 8192
#: Shingles sampled at once.
SHINGLES = 1 << 15
_NO_ID = -(1 << 63)


def _word_hashes(buf, offs):
    starts, ends, at = words(buf, offs, ALNUM)
    return span_hashes(LOWER[buf], starts, ends), at


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def inverse_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """1 + ln((1 + N) / (1 + n)) of each hashed word, over all documents."""

    def run(batches):
        count, n = np.zeros(WORDS, np.int64), 0
        for _, buf, offs in slices(batches, "_text"):
            hashes, at = _word_hashes(buf, offs)
            doc = np.repeat(np.arange(len(offs) - 1), np.diff(at))
            key = np.sort(doc * WORDS + _bucket(hashes))
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            count += np.bincount(key % WORDS, minlength=WORDS)
            n += len(offs) - 1
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(count[used], n))], ["word", "n"])

    counted = docs.select(text_or_empty(text_col).alias("_text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(WORDS), 0
    for r in counted:  # at most WORDS + 1 rows
        if r["word"] < 0:
            total = r["n"]
        else:
            df[r["word"]] = r["n"]
    return (1 + np.log((1 + total) / (1 + df))).astype(np.float32)


def weighted_shingles(buf: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(48-bit shingles, ascending in each text; their weights; the shingles before each text). A text of fewer than
    SHINGLE words is one shingle of all of them; one without words has none."""
    hashes, at = _word_hashes(buf, offs)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    grams = shingle_hashes(hashes, SHINGLE)
    weight = idf[_bucket(hashes)]
    total = np.zeros(len(grams), np.float32)
    for k in range(SHINGLE):
        total += weight[k : k + len(grams)]
    inside = doc[: len(grams)] == doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    grams, total, gram_doc = grams[inside], total[inside] / np.float32(SHINGLE), doc[: len(inside)][inside]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = [hashes[at[d] : at[d + 1]] for d in short]
        grams = np.concatenate([grams, mix(np.array([int(np.sum(mix(h, 1) * np.arange(1, len(h) + 1, dtype=np.uint64))) & (2**64 - 1) for h in own], np.uint64), 9)])
        total = np.concatenate([total, np.array([idf[_bucket(h)].mean() for h in own], np.float32)])
        gram_doc = np.concatenate([gram_doc, short])
    # a slice has at most 2 ** 16 texts
    key = (gram_doc.astype(np.uint64) << np.uint64(48)) | (grams >> np.uint64(16))
    order = np.argsort(key)
    key, total = key[order], total[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key))).astype(np.float32)
    key, weight = key[first], total[first] * times
    return key & np.uint64((1 << 48) - 1), weight, np.searchsorted(key >> np.uint64(48), np.arange(len(n) + 1, dtype=np.uint64))


def _quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middles of 4096 equal parts, by bisection of its distribution 1 - (1 + x) exp(-x)."""
    p = (np.arange(4096) + 0.5) / 4096
    low, high = np.zeros(4096), np.full(4096, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return ((low + high) / 2).astype(np.float32)


_GAMMA = _quantiles()


def band_keys(shingles: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys of each text that has shingles, 16 bits for each of a band's samples: improved consistent weighted
    sampling (Ioffe, 2010). Per sample and shingle r and c are Gamma(2, 1) and beta uniform, drawn by hash;
    t = floor(ln S / r + beta), and the sample is the shingle of least c / exp(r (t - beta + 1)) with its t. Shingles are
    taken in bounded runs; of a text in several, the least of all runs counts."""
    begin = at[:-1][at[1:] > at[:-1]]
    least, sample = np.full((SAMPLES, len(begin)), np.inf, np.float32), np.zeros((SAMPLES, len(begin)), np.uint64)
    for low in range(0, len(shingles), SHINGLES):
        own, log_s = shingles[low : low + SHINGLES], np.log(weights[low : low + SHINGLES])
        first = int(np.searchsorted(begin, low, "right")) - 1
        last = int(np.searchsorted(begin, low + len(own)))
        cut = np.maximum(begin[first:last] - low, 0)
        lengths = np.diff(np.append(cut, len(own)))
        for j in range(SAMPLES):
            x = own * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1)) + np.uint64((0xD1B54A32D192ED03 * (j + 1)) & (2**64 - 1))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            y = x * np.uint64(0x94D049BB133111EB)
            y ^= y >> np.uint64(31)
            r = _GAMMA[(x >> np.uint64(52)).astype(np.int64)]
            beta = (x.astype(np.uint32) >> np.uint32(8)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_s / r + beta)
            u = ((y >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
            v = (y.astype(np.uint32).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
            cost = np.log(-np.log(np.minimum(u * v, np.float32(1 - 2**-24)))) - r * (t - beta + np.float32(1))
            here = np.minimum.reduceat(cost, cut)
            place = np.flatnonzero(cost == np.repeat(here, lengths))
            pick = place[np.searchsorted(place, cut)]  # of equal ones the smallest shingle
            got = mix(own[pick] ^ (t[pick].astype(np.int64).astype(np.uint64) << np.uint64(48)), j)
            less = here < least[j, first:last]
            sample[j, first:last] = np.where(less, got, sample[j, first:last])
            least[j, first:last] = np.where(less, here, least[j, first:last])
    lanes = (sample >> np.uint64(48)).reshape(BANDS, ROWS, len(begin))
    return sum((lanes[:, k] << np.uint64(16 * k) for k in range(ROWS)), np.zeros((BANDS, len(begin)), np.uint64))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many samples agree, of each row's keys."""
    return (np.ascontiguousarray(a).view(np.uint16) == np.ascontiguousarray(b).view(np.uint16)).sum(-1)


def least_agreeing(similarity: float) -> int:
    """The samples that agree in all but one in a million pairs of that similarity."""
    chance, n = 0.0, 0
    while n < SAMPLES:
        chance += comb(SAMPLES, n) * similarity**n * (1 - similarity) ** (SAMPLES - n)
        if chance > 1e-6:
            break
        n += 1
    return n


def similarity_of(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two ascending sets of shingles."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    same = a[at] == b
    shared = float(np.minimum(wa[at[same]], wb[same]).sum(dtype=np.float64))
    whole = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - shared
    return shared / whole if whole else 0.0


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """slices() of texts that are compressed, in the last column."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        at, texts, size = 0, [], 0
        for i, z in enumerate(batch.columns[-1]):
            texts.append(expand.decompress(z.as_py()))
            size += len(texts[-1])
            if size >= SLICE_BYTES or i == batch.num_rows - 1:
                offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
                yield batch.slice(at, i + 1 - at), np.frombuffer(b"".join(texts), np.uint8), offs
                at, texts, size = i + 1, [], 0


def _links(groups: DataFrame, idf, similarity: float) -> DataFrame:
    """groups: group, role, own, node, class, bands, z. Rows of role 0 are verified against rows of role 1 and, where
    `own` holds, against each other, if they share a band and their classes differ. Gives links (a, b), as many as join
    the classes met in a group. Rows of a group lie together, those of role 0 first, which alone are held."""
    rows = groups.repartition("group").sortWithinPartitions("group", "role", "node")
    enough = least_agreeing(similarity)

    def run(batches):
        weights = idf.value
        current, first, sets, classes, bands, n, root = None, [], [], [], np.zeros((0, BANDS), np.int64), 0, {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for got, buf, offs in _unpacked(batches):
            shingles, weight, at = weighted_shingles(buf, offs, weights)
            keys = got.column(5).flatten().to_numpy().reshape(-1, BANDS)
            out = []
            for i, (group, role, own, node, cls) in enumerate(zip(*(got.column(k).to_pylist() for k in range(5)), strict=True)):
                if group != current:
                    current, first, sets, classes, n, root = group, [], [], [], 0, {}
                mine = (shingles[at[i] : at[i + 1]], weight[at[i] : at[i + 1]])
                if role or own:
                    near = np.flatnonzero((bands[:n] == keys[i]).any(1))
                    near = near[agreeing(bands[near], keys[i]) >= enough]
                    for k in near.tolist():
                        a, b = find(classes[k]), find(cls)
                        if a != b and similarity_of(*sets[k], *mine) >= similarity:
                            root[b] = a
                            out.append((first[k], node))
                if not role:
                    if n == len(bands):
                        bands = np.concatenate([bands, np.zeros((max(n, 16), BANDS), np.int64)])
                    bands[n] = keys[i]
                    n += 1
                    first.append(node)
                    classes.append(cls)
                    sets.append((mine[0].copy(), mine[1].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return rows.select("group", "role", "own", "node", "class", "bands", "z").mapInArrow(run, "a binary, b binary")


def _likely(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (pivot, node, and the keys of both) whose samples agree often enough."""
    enough = least_agreeing(similarity)

    def run(batches):
        for b in batches:
            p, q = (b.column(k).flatten().to_numpy().reshape(-1, BANDS) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["pivot", "node"]).filter(pa.array(agreeing(p, q) >= enough))

    return pairs.select("pivot", "node", "p_bands", "bands").mapInArrow(run, "pivot binary, node binary")


def _with_partners(groups: DataFrame, similarity: float) -> DataFrame:
    """groups: group, role, own, node, class, bands, as for _links(). The nodes that have, in their group, one of another
    class whose samples agree often enough."""
    rows = groups.repartition("group").sortWithinPartitions("group", "role", "node")
    enough = least_agreeing(similarity)

    def run(batches):
        current, names, classes, bands, n, found = None, [], [], np.zeros((0, BANDS), np.int64), 0, set()
        for got in batches:
            keys, out = got.column(5).flatten().to_numpy().reshape(-1, BANDS), set()
            for i, (group, role, own, node, cls) in enumerate(zip(*(got.column(k).to_pylist() for k in range(5)), strict=True)):
                if group != current:
                    current, names, classes, n, found = group, [], [], 0, set()
                if role or own:
                    near = np.flatnonzero((bands[:n] == keys[i]).any(1))
                    near = near[agreeing(bands[near], keys[i]) >= enough]
                    met = [names[k] for k in near.tolist() if classes[k] != cls]
                    if met:
                        out.update(x for x in met if x not in found)
                        found.update(met)
                        out.add(node)
                if not role:
                    if n == len(bands):
                        bands = np.concatenate([bands, np.zeros((max(n, 16), BANDS), np.int64)])
                    bands[n] = keys[i]
                    n += 1
                    names.append(node)
                    classes.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.binary())], ["node"])

    return rows.select("group", "role", "own", "node", "class", "bands").mapInArrow(run, "node binary").distinct()


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, node, class, size, hub of what buckets hold several classes of beside their pivots."""
    now = members.filter("node <> pivot").select("bucket", "node", "size").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    now = materialise(now, "open")
    open_ = now.groupBy("bucket").agg(F.min("class").alias("l"), F.max("class").alias("h"), F.min("node").alias("hub")).filter("l < h").select("bucket", "hub")
    return salted_join(now, open_, "bucket", "node", hot_keys(now, "bucket"))


def _dealt(rows: DataFrame, key: str, most: int, shingles: int) -> DataFrame:
    """rows: key, node, class, size (shingles). The groups in which every two nodes of a key meet, but for those of its
    largest class: group, role, own, node, class. A chunk has about `most` nodes and `shingles` shingles at most."""
    sizes = rows.groupBy(key, "class").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sizes = sizes.groupBy(key).agg(F.max(F.struct("n", "class", "s")).alias("m"), F.sum("n").alias("all"), F.sum("s").alias("whole"))
    chunks = lambda n, s: F.greatest(F.ceil(n / F.lit(most)), F.ceil(s / F.lit(shingles)))
    others = F.col("all") - F.col("m.n")
    sizes = sizes.filter(others > 0).select(key, F.col("m.class").alias("major"), chunks(others, F.col("whole") - F.col("m.s")).alias("minors"), chunks(F.col("m.n"), F.col("m.s")).alias("majors"))
    # a hot key is one row of sizes and many nodes
    dealt = salted_join(rows, sizes, key, "node", hot_keys(rows, key)).withColumn("large", F.col("class") == F.col("major"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("majors")).otherwise(F.col("minors"))))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)).alias("o")
    low, high = F.least("chunk", "o"), F.greatest("chunk", "o")
    minor = dealt.filter("not large")
    row = lambda kind, a, b, role, own: (F.xxhash64(key, F.lit(kind), a, b).alias("group"), role.cast("int").alias("role"), own.alias("own"), "node", "class")
    among = minor.select("*", each("minors")).select(*row(0, low, high, F.col("chunk") > F.col("o"), F.col("chunk") == F.col("o")))
    left = minor.select("*", each("majors")).select(*row(1, F.col("chunk"), F.col("o"), F.lit(0), F.lit(False)))
    right = dealt.filter("large").select("*", each("minors")).select(*row(1, F.col("o"), F.col("chunk"), F.lit(1), F.lit(False)))
    return among.unionByName(left).unionByName(right)


def _families(open_: DataFrame) -> DataFrame:
    """family, node, class, size: nodes that open buckets connect."""
    found = components(open_.select("hub", "node").distinct(), "hub", "node").select("node", F.col("root").alias("family"))
    return found.join(open_.select("node", "class", "size").distinct(), "node")


def _class_of(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes (node, class) with the classes that `found` (node, root) has joined."""
    return materialise(nodes.join(found.select(F.col("node").alias("class"), "root"), "class", "left").select("node", F.coalesce("root", "class").alias("class")), "classes")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_md5, class_id (the smallest id of its class), class_size (rows), kept (the
    row's id and text are those that stand for the class; repeated rows of one id and text are all marked).

    A null text counts as empty; texts without words are near copies of equal texts only. Null ids count as smaller than
    any other. An empty table gives no rows; other columns are dropped. Ids must be integers.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_or_empty(text_col)
    named = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("_text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, text_col))

    def sketch(batches):
        pack = zstandard.ZstdCompressor(level=1)
        packed: set[bytes] = set()  # of each text the first row of a task carries it
        for rows, buf, offs in slices(batches, "_text"):
            shingles, weight, at = weighted_shingles(buf, offs, idf.value)
            has = np.flatnonzero(np.diff(at))
            keys = np.zeros((0, BANDS), np.int64)
            if len(has):
                keys = np.ascontiguousarray(band_keys(shingles, weight, at).T).view(np.int64)
            cut = np.zeros(rows.num_rows + 1, np.int32)
            cut[1:] = np.cumsum(np.where(np.diff(at) > 0, BANDS, 0))
            data, z = buf.data, []
            for node, n, i, j in zip(rows.column(1).to_pylist(), np.diff(at).tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                z.append(pack.compress(data[i:j]) if n and node not in packed else None)
                packed.add(node)
            if len(packed) > GROUP * GROUP:
                packed.clear()
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(cut), pa.array(keys.ravel())), pa.array(z, pa.binary())], ["_id", "node", "size", "bands", "z"])

    rows = materialise(named.mapInArrow(sketch, "_id bigint, node binary, size bigint, bands array<bigint>, z binary"), "sketches")
    nodes = materialise(rows.groupBy("node").agg(F.min("_id").alias("_id"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")

    def texts_of(picked: DataFrame, what: str) -> DataFrame:
        """The texts of some nodes, one row each; a hot text is in one row a task at most."""
        found = rows.filter("z is not null").select("node", "z").join(picked.select("node").distinct(), "node", "left_semi")
        return materialise(found.groupBy("node").agg(F.first("z").alias("z")).join(nodes.select("node", "bands"), "node"), what)

    each = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    placed = each.select("node", "size", F.xxhash64("band", "key").alias("bucket"))
    # a bucket with a third of all nodes is one row of `buckets`; its members are dealt to several tasks
    buckets = materialise(placed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).filter("members > 1"), "buckets")
    shared = buckets.agg(F.sum("members")).first()[0] or 0
    hot = [r["bucket"] for r in buckets.filter(F.col("members") * HOT > shared).select("bucket").collect()]  # fewer than HOT
    members = materialise(salted_join(placed, buckets.select("bucket", "pivot"), "bucket", "node", hot), "members")
    hot_pivots = hot_keys(members, "pivot")

    pairs = members.filter("node <> pivot").select("pivot", "node").distinct().join(nodes.select("node", "bands"), "node")
    pivots = nodes.select(F.col("node").alias("pivot"), F.col("bands").alias("p_bands"))
    pairs = materialise(_likely(salted_join(pairs, pivots, "pivot", "node", hot_pivots), similarity), "pairs")
    parts = pairs.groupBy("pivot").agg((F.count("*") / GROUP + 1).cast("int").alias("parts"))
    dealt = salted_join(pairs, parts, "pivot", "node", hot_pivots).select(F.xxhash64("pivot", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("group"), "pivot", "node")
    ends = dealt.select("group", F.lit(1).alias("role"), "node").unionByName(dealt.select("group", F.lit(0).alias("role"), F.col("pivot").alias("node")).distinct())
    ends = ends.select("group", "role", F.lit(False).alias("own"), "node", F.col("node").alias("class"))
    links = _links(ends.join(texts_of(ends, "texts"), "node"), idf, similarity)
    classes = components(materialise(links, "verified")).select("node", F.col("root").alias("class"))
    classes = materialise(nodes.select("node").join(classes, "node", "left").select("node", F.coalesce("class", "node").alias("class")), "classes")

    open_ = materialise(_open(members, classes), "open")
    met = _dealt(open_.select("bucket", "node", "class", F.lit(0).alias("size")), "bucket", SKETCHES, 1)
    likely = materialise(_with_partners(met.join(nodes.select("node", "bands"), "node"), similarity), "likely")
    families = materialise(_families(open_.join(likely, "node", "left_semi")), "families")
    groups = _dealt(families, "family", GROUP, GROUP_SHINGLES)
    links = materialise(_links(groups.join(texts_of(families, "texts"), "node"), idf, similarity), "verified")
    to_class = classes.select(F.col("node").alias("a"), F.col("class").alias("ca"))
    joined = links.join(to_class, "a").join(classes.select(F.col("node").alias("b"), F.col("class").alias("cb")), "b").select("ca", "cb")
    classes = _class_of(classes, components(joined, "ca", "cb"))

    labelled = nodes.select("node", "_id", "rows").join(classes, "node")
    summed = labelled.groupBy("class").agg(F.min("_id").alias("class_id"), F.sum("rows").alias("class_size"), F.min(F.struct("_id", "node")).alias("_best"))
    known = labelled.join(summed, "class").select("node", "class_id", "class_size", "_best")
    no_id = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    n_rows = nodes.agg(F.sum("rows")).first()[0] or 0
    hot = [r["node"] for r in nodes.filter(F.col("rows") * HOT > n_rows).select("node").collect()]  # texts with many rows, fewer than HOT
    return salted_join(rows.select("_id", "node"), known, "node", "_id", hot).select(no_id("_id").alias("doc_id"), F.lower(F.hex("node")).alias("text_md5"), no_id("class_id").alias("class_id"), "class_size", ((F.col("_id") == F.col("_best._id")) & (F.col("node") == F.col("_best.node"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the smallest id (of equal ids that of the smallest text hash; of repeated
    rows any). Columns are unchanged."""
    columns, named = docs.columns, docs
    extra = ["_near_id", "_near_md5"]
    while set(extra) & set(columns):
        extra = [c + "_" for c in extra]
    kept = near_duplicates(docs, similarity, id_col, text_col).filter("kept").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(extra[0]), F.col("text_md5").alias(extra[1])).distinct()
    named = docs.withColumns({extra[0]: F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)), extra[1]: F.md5(text_or_empty(text_col).cast("binary"))})
    return named.join(kept, extra).dropDuplicates(extra).select(*columns)
