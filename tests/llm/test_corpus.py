"""Operators that look at the whole corpus, and the pipeline."""

import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark import cloudpickle

from tesselix.llm import components, neardup, repeats, toxicity
from tests.llm.test_texts import brute_linked
from tests.llm.helpers import DOCS, documents, empty_documents, odd_documents, prose, rows, vocabulary

SLOW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# --- near copies ---------------------------------------------------------------------------------------------------


@SLOW
@given(links=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, links):
    root = list(range(26))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for link in links for x in link if link[0] != link[1]}
    want |= {(x, find(x)) for x, _ in want}
    got = components.components(spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_samples_agree_as_often_as_weights_do():
    rng = np.random.default_rng(0)
    shingles = np.sort(rng.choice(1 << 48, 400, replace=False).astype(np.uint64))
    a, b = np.arange(400) < 330, np.arange(400) >= 70
    wa, wb = rng.uniform(0.5, 6, 400).astype(np.float32), rng.uniform(0.5, 6, 400).astype(np.float32)
    agree, total = 0, 0
    for seed in range(60):  # other shingles, the same weights: 60 x 16 bands
        own = np.sort((shingles * np.uint64(2 * seed + 3) + np.uint64(seed)) & np.uint64((1 << 48) - 1))
        ka = neardup.band_keys(own[a], wa[a], np.array([0, a.sum()]))
        kb = neardup.band_keys(own[b], wb[b], np.array([0, b.sum()]))
        agree, total = agree + int((ka == kb).sum()), total + len(ka)
    j = neardup.similarity_of(shingles[a], wa[a], shingles[b], wb[b])
    assert abs(agree / total - j**neardup.ROWS) < 4 * (j**neardup.ROWS / total) ** 0.5 + 0.01


def brute_classes(docs, similarity=0.8):
    """doc_id -> smallest id of its class, by all pairs of texts."""
    data = [(t or "").encode() for _, t in docs]
    df = np.zeros(neardup.WORDS)
    for d in data:
        h, _ = neardup._word_hashes(np.frombuffer(d, np.uint8), np.array([0, len(d)]))
        df[np.unique(neardup._bucket(h))] += 1
    idf = (1 + np.log((1 + len(data)) / (1 + df))).astype(np.float32)
    sets = []
    for d in data:
        s, w, _ = neardup.weighted_shingles(np.frombuffer(d, np.uint8), np.array([0, len(d)]), idf)
        sets.append((s, w))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if data[i] == data[j] or (len(sets[i][0]) and len(sets[j][0]) and neardup.similarity_of(*sets[i], *sets[j]) >= similarity):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}


def near_copies(rng, words, n_groups=12):
    texts = []
    for g in range(n_groups):
        base = prose(rng, rng.randint(20, 200), words).split()
        for _ in range(rng.choice([1, 2, 3, 12])):
            texts.append(" ".join(w if rng.random() > rng.choice([0, 0.01, 0.03, 0.05]) else rng.choice(words) for w in base))
        texts += [texts[-1]] * rng.choice([0, 0, 3])
    rng.shuffle(texts)
    return texts


def test_near_duplicates_against_all_pairs(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        texts = near_copies(rng, vocabulary(3000)) + ["a b", "a b", "b a", None, ""]
        got = neardup.near_duplicates(documents(spark, texts)).collect()
        want = brute_classes(list(enumerate(texts)))
        assert {r["doc_id"]: r["class_id"] for r in got} == want
        sizes = Counter(want.values())
        assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
        kept = neardup.drop_near_duplicates(documents(spark, texts))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("group", [4, 512])
def test_chains_in_a_bucket_are_found(spark, monkeypatch, group):
    """Bands that always match: all texts are one bucket and one family, in one chunk or in several."""
    monkeypatch.setattr(neardup, "GROUP", group)
    rng, words = random.Random(4), vocabulary(3000)
    chain = [prose(rng, 120, words).split()]
    for _ in range(14):  # each near the one before, far from the first
        nxt = list(chain[-1])
        at = rng.randrange(0, 110)
        nxt[at : at + 4] = [rng.choice(words) for _ in range(4)]
        chain.append(nxt)
    texts = [" ".join(t) for t in chain] + [prose(rng, 120, words) for _ in range(10)]
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks can't import this module
    monkeypatch.setattr(neardup, "band_keys", _same_band)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def _same_band(shingles, weights, at):
    return np.ones((neardup.BANDS, int((np.diff(at) > 0).sum())), np.uint64)


def test_near_duplicates_of_odd_rows(spark):
    df = odd_documents(spark)
    got = neardup.near_duplicates(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= {r["text"] or "" for r in df.collect()}
    assert neardup.near_duplicates(empty_documents(spark)).collect() == [] == neardup.drop_near_duplicates(empty_documents(spark)).collect()


# --- repeats -----------------------------------------------------------------------------------------------------------


def brute_repeats(docs, window=50):
    first, out = {}, Counter()
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def passages(rng, words, n=60):
    shared = [prose(rng, rng.choice([49, 50, 51, 80, 130]), words).split() for _ in range(6)]
    docs = []
    for d in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(shared)
            cut = rng.choice([0, 0, 0, rng.randint(0, 30)])
            w += prose(rng, rng.choice([0, 0, 1, 20]), words).split() + own[cut:]
        docs.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    rng.shuffle(docs)
    return docs


def test_repeats_against_all_windows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 6_000)
    for seed, n_words in ((1, 500), (2, 2)):  # two words: windows repeat within texts and anchors tie
        rng = random.Random(seed)
        docs = passages(rng, vocabulary(n_words)) + [(None, prose(rng, 60, ["p"])), (70, prose(rng, 60, ["p"])), (71, prose(rng, 70, ["p"])), (71, prose(rng, 61, ["p"])), (72, None), (73, "")]
        df = spark.createDataFrame([(d, t, "", "", 0) for d, t in docs], DOCS).repartition(3)
        got = Counter(tuple(r) for r in repeats.drop_repeats(df).collect())
        assert got == brute_repeats(docs)


def _finds_nothing(own, phrases):
    return np.zeros(0, np.int64)


def test_repeats_come_from_the_automaton(spark, monkeypatch):
    """With an automaton that finds nothing, nothing goes."""
    rng = random.Random(3)
    df = spark.createDataFrame([(d, t, "", "", 0) for d, t in passages(rng, vocabulary(500))], DOCS)
    assert repeats.drop_repeats(df).agg({"n_removed": "sum"}).first()[0] > 0
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the tasks can't import this module
    cloudpickle.register_pickle_by_value(repeats)
    try:
        monkeypatch.setattr(repeats, "occurrences", _finds_nothing)
        assert repeats.drop_repeats(df).agg({"n_removed": "sum"}).first()[0] == 0
    finally:
        cloudpickle.unregister_pickle_by_value(repeats)


def test_occurrences_against_a_scan(spark, tmp_path):
    rng, words = random.Random(4), vocabulary(3)
    docs = spark.createDataFrame([(i, prose(rng, 80, words), "", "", 0) for i in range(9)], DOCS).coalesce(1)
    file = repeats.write_buckets(docs, str(tmp_path), "doc_id", "text").first()["file"]
    own = repeats.Bucket(file).split()
    every = [own.data[own.starts[i] : own.ends[i + 2]] for i in range(len(own.starts) - 2)]
    phrases = [p for p in dict.fromkeys(every) if b"\n" not in p][::3]
    got = sorted(repeats.occurrences(own, phrases).tolist())
    assert got == [i for i, p in enumerate(every) if p in phrases]


def test_repeats_of_odd_rows(spark):
    df = odd_documents(spark)
    got = repeats.drop_repeats(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert repeats.drop_repeats(empty_documents(spark)).collect() == []


def test_sliding_argmin():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 40, 41, 200):
        v = rng.integers(0, 20, n).astype(np.uint64)
        assert repeats.sliding_argmin(v, 41).tolist() == [i + int(np.argmin(v[i : i + 41])) for i in range(n)]


# --- toxicity ------------------------------------------------------------------------------------------------------------


def learn_from(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 != 0


def test_held_out_accuracy_with_pairs(spark):
    """Toxic: an insult with the mention of a group; either alone is not."""
    rng, words = random.Random(1), vocabulary(300)
    texts, labels = [], []
    for i in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        w = prose(rng, rng.randint(5, 40), words).split() + ["Insult!"] * a + ["group,"] * b
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(a and b))
    df = documents(spark, texts)
    machine = toxicity.fit(df, spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, machine).collect()}
    held = [i for i in range(1500) if not learn_from(i)]
    assert sum((got[i] >= 0.5) == labels[i] for i in held) / len(held) > 0.97


def test_held_out_accuracy_where_only_the_pair_tells(spark):
    """Toxic: one of two words; both or neither is not. Neither word says anything alone."""
    rng, words = random.Random(6), vocabulary(2000, 5)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = prose(rng, rng.randint(5, 40), words).split() + ["Alpha"] * a + ["(beta)"] * b
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(a != b))
    df = documents(spark, texts)
    machine = toxicity.fit(df, spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, machine).collect()}
    held = [i for i in range(3000) if not learn_from(i)]
    assert sum((got[i] >= 0.5) == labels[i] for i in held) / len(held) > 0.95
    without = toxicity.Machine(machine.buckets, machine.bias, machine.w, machine.v * 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, without).collect()}
    assert sum((got[i] >= 0.5) == labels[i] for i in held) / len(held) < 0.8  # it is the pair that tells


def test_all_texts_are_fitted_however_many_terms(monkeypatch):
    """A table too large for one piece is kept by its ones: the same machine, no text left out."""
    rng = np.random.default_rng(2)
    x = rng.random((200, 30)) < 0.2
    toxic = (x[:, 0] & x[:, 1]).astype(int)
    sets = [np.flatnonzero(r) for r in x]
    whole = toxicity.fit_machine(sets, toxic, np.arange(30), rounds=60)
    monkeypatch.setattr(toxicity, "CELLS", 0)
    ones = toxicity.fit_machine(sets, toxic, np.arange(30), rounds=60)
    assert np.allclose(whole.w, ones.w, atol=1e-3) and np.allclose(whole.bias, ones.bias, atol=1e-3)


def test_labels_that_tell_nothing_are_said_to(spark):
    df = documents(spark, [f"word{i} and text{i}" for i in range(40)])
    labels = spark.createDataFrame([(i, int(i == 7)) for i in range(40)], "doc_id bigint, toxic int")
    with pytest.warns(UserWarning, match="one score"):
        machine = toxicity.fit(df, labels)
    scores = {r["score"] for r in toxicity.score(df, machine).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 0.5


def explicit_scores(x, bias, w, v):
    z = [bias + sum(w[i] for i in s) + sum(float(v[i] @ v[j]) for k, i in enumerate(s) for j in s[k + 1 :]) for s in x]
    return 1 / (1 + np.exp(-np.array(z)))


@settings(max_examples=50, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_scores_and_gradients_against_explicit_pairs(seed):
    rng = np.random.default_rng(seed)
    terms, n = rng.integers(1, 7), rng.integers(1, 6)
    x = rng.random((n, terms)) < 0.5
    sets = [np.flatnonzero(r).tolist() for r in x]
    bias, w, v = rng.normal(), rng.normal(size=terms), rng.normal(size=(terms, 3))
    machine = toxicity.Machine(np.arange(terms), bias, w, v)
    text, term = np.repeat(np.arange(n), x.sum(1)), np.array([i for s in sets for i in s], np.int64)
    assert np.allclose(machine.scores(text, term, n), explicit_scores(sets, bias, w, v))
    neg, pos, decay = rng.integers(0, 3, n).astype(float), rng.integers(0, 3, n).astype(float), 0.1
    total = max(neg.sum() + pos.sum(), 1)

    def loss(bias, w, v):
        p = explicit_scores(sets, bias, w, v)
        return -(pos * np.log(p) + neg * np.log(1 - p)).sum() / total + decay / 2 * ((w**2).sum() + (v**2).sum())

    f, xv = x.astype(float), x.astype(float) @ v
    z = bias + ((xv**2).sum(1) + f @ (2 * w - (v * v).sum(1))) / 2
    got = toxicity.gradients(f, xv, z, w, v, neg, pos, total, decay)
    e = 1e-6
    assert abs(got[0][0] - (loss(bias + e, w, v) - loss(bias - e, w, v)) / (2 * e)) < 1e-5
    for i in range(terms):
        d = np.eye(terms)[i] * e
        assert abs(got[1][i] - (loss(bias, w + d, v) - loss(bias, w - d, v)) / (2 * e)) < 1e-5
        for k in range(3):
            d = np.zeros_like(v)
            d[i, k] = e
            assert abs(got[2][i, k] - (loss(bias, w, v + d) - loss(bias, w, v - d)) / (2 * e)) < 1e-5


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_pairs_with_evidence_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n, terms = 60, 12
    x = rng.random((n, terms)) < rng.uniform(0.1, 0.9, terms)
    toxic = (x[:, 0] ^ x[:, 1]) & (rng.random(n) < 0.95)
    own = toxicity.WordSets([np.flatnonzero(r) for r in x], toxic.astype(int))
    want = set()
    for a in range(len(own.words)):
        for b in range(a + 1, len(own.words)):
            both = x[:, own.words[a]] & x[:, own.words[b]]
            if both.any():
                expected = 1 / (1 + np.exp(-(np.log(own.rate / (1 - own.rate)) + own.logit[a] + own.logit[b])))
                if toxicity.evidence(np.array([both.sum()]), np.array([(both & toxic).sum()]), expected)[0] >= own.bar:
                    want |= {int(own.words[a]), int(own.words[b])}
    got = set()
    for cells in (1, 1 << 20):  # a word at a time, all at once
        toxicity.PAIRS, kept = cells, toxicity.PAIRS
        got = {int(i) for low, high in own.blocks() for i in own.telling(low, high)}
        toxicity.PAIRS = kept
        assert got == want


def test_labels_that_are_held_out_are_not_looked_at(spark):
    rng, words = random.Random(2), vocabulary(100)
    texts = [prose(rng, 20, words) + (" bad" if i % 4 == 0 else "") for i in range(300)]
    df = documents(spark, texts)
    scores = []
    for flip in (0, 1):
        labels = [(i, int(i % 4 == 0) if learn_from(i) else flip) for i in range(300)]
        machine = toxicity.fit(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        scores.append({r["doc_id"]: round(r["score"], 4) for r in toxicity.score(df, machine).collect()})
    assert scores[0] == scores[1]


def test_toxicity_of_odd_rows(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, None), (999, 1)], "doc_id bigint, toxic int")
    for own in (labels, labels.limit(0)):
        machine = toxicity.fit(df, own)
        got = toxicity.score(df, machine)
        assert got.count() == df.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert set(toxicity.drop_toxic(df, machine).columns) == set(df.columns)
    assert toxicity.score(empty_documents(spark), toxicity.fit(empty_documents(spark), labels)).collect() == []


# --- the pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    from tesselix.llm import secrets
    from tokenizers import Tokenizer

    from tesselix.llm.tokens import default_path

    rng, words = random.Random(9), vocabulary(2000)
    passage = prose(rng, 30, words)
    texts = near_copies(rng, words, 20)
    texts += [prose(rng, 40, words) + " " + passage, prose(rng, 30, words) + ' password = "hunter2hunter2"', None, ""]
    texts += [prose(rng, 30, words) + '\n\nlogin: bob99 at https://db.example.com/x, token = "0123456789abcdef"\n\n' + prose(rng, 30, words) + " https://example.com/clean"]
    texts += [prose(rng, rng.randint(10, 60), words) + (" vile scum" if i % 5 == 0 else "") for i in range(200)]
    n = len(texts)
    spark.createDataFrame(rows(texts), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    toxic = {i for i in range(n) if "vile" in (texts[i] or "")}
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(n)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # brute force
    left = [(i, t) for i, t in enumerate(texts) if i not in toxic]
    classes = brute_classes(left)
    left = [(i, t) for i, t in left if classes[i] == i]
    left = [(i, t) for i, t in left if passage not in (t or "")]
    spans = {i: [*(base := secrets.base_spans(t or "")), *brute_linked(t or "", base)] for i, t in left}
    left = {i: secrets.redact(t or "", sorted(spans[i], key=lambda s: (s[1], secrets.KINDS.index(s[0])))) for i, t in left}
    assert any("[ASSIGN]" in t for t in left.values()) and sum("[ENDPOINT]" in t and "[ACCOUNT]" in t and "example.com/clean" in t for t in left.values()) == 1
    library = Tokenizer.from_file(default_path())
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append((r["start"], bytes(r["ids"])))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in left.items()}
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in got.items()} == want


def test_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline

    empty_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    df = documents(spark, ["one text", None, "", "one text", "another text that is longer"])
    for name, stage in corpus_pipeline.STAGES[:-1]:  # no labels, no items: only copies go
        left = sorted((r["text"] or "") for r in stage(spark, df, str(tmp_path)).collect())
        assert left == (["", "another text that is longer", "one text"] if name == "near_dedup" else sorted(["one text", "", "", "one text", "another text that is longer"])), name


def test_stages_return_documents(spark):
    import corpus_pipeline

    df = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "/root/testdata/sf0.001")
        assert out.columns == df.columns and out.count() <= df.count(), name
