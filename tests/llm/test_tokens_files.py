"""Token ids, packing and binary files."""

import io
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tesselix.llm import packing, simple8b, tokens
from tesselix.sources.storage import materialise
from tests.llm.helpers import DOCS, documents, empty_documents, odd_documents, prose, rows, vocabulary

TEXT = st.text(st.one_of(st.sampled_from("aAbé ,.'\n\t\r\x0b\x1c~<|0９ſΣ ̸́ﬁİ"), st.characters(exclude_categories=["Cs"])), max_size=40)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encode(texts, kept=None):
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    ids, at = tokens.encoder(tokens.default_path()).encode(np.frombuffer(b"".join(data), np.uint8), offs)
    return [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=6))
def test_ids_of_words_are_ids_of_texts(plain, texts):
    assert encode(texts) == [plain(t) for t in texts]


def test_other_white_space_in_words(plain):
    own = tokens.Encoder(tokens.default_path())
    for text in ("naïve déjà", "Éa\u00a0bon \u00a0 café Über", "été\u3000ça ~é \u2028 \u0301x Garçon", "Ñu\u0085né ～ö ´ É\u2003 À"):  # the first are tried against the library
        data = np.frombuffer(text.encode(), np.uint8)
        assert own.encode(data, np.array([0, len(data)]))[0].tolist() == plain(text)
    assert own.letters


def test_words_are_forgotten_and_learned_again(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    rng, words = random.Random(1), vocabulary(300)
    for _ in range(6):
        texts = [prose(rng, 30, words) for _ in range(3)]
        assert encode(texts) == [plain(t) for t in texts]


def test_other_tokenizers_take_texts_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, t = tokens.Encoder(path), Tokenizer.from_file(path)
    data = "Ab cD  é".encode()
    assert not own.by_words
    assert own.encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist() == t.encode(data.decode(), add_special_tokens=False).ids


def little(ids):
    return np.array(ids, "<u4").tobytes()


def check_packing(got, want, window):
    """got: rows of pack(); want: Counter of (doc_id, ids with the end)."""
    texts, sequences = {}, {}
    for r in got:
        texts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] <= 4 * window
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r["length"] for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, n), parts in texts.items():
        copies = Counter(parts)
        assert {len(i) for (d, i), _ in want.items() if d == doc} >= {n}
        if max(copies.values()) == 1:
            starts = sorted(parts)
            assert [s for s, _ in starts] == [sum(len(b) // 4 for _, b in starts[:k]) for k in range(len(starts))]
            assert b"".join(b for _, b in starts) in {little(i) for (d, i) in want if d == doc}


@pytest.mark.parametrize("window", [16, 4096])
def test_packing(spark, plain, window):
    df = odd_documents(spark)
    want = Counter((r["doc_id"], (*plain(r["text"]), 2)) for r in df.select("doc_id", "text").collect())
    check_packing(packing.pack(df, tokens.default_path(), window).collect(), want, window)
    assert packing.pack(empty_documents(spark), tokens.default_path(), window).collect() == []


def test_places_by_files_and_by_rows(spark, plain):
    """The general interface, with columns of any name, and the one that leaves ids where they lie."""
    df = odd_documents(spark)
    cut = packing.pieces(df, tokens.default_path(), 16, 2)
    clash = cut.withColumns({c: F.lit(-1) for c in ("_b", "_n", "_o", "_rank", "_places", "_p")})
    want = Counter((r["doc_id"], (*plain(r["text"]), 2)) for r in df.select("doc_id", "text").collect())
    got = packing.place(materialise(clash), 16)
    assert got.columns == [*clash.columns, "sequence_id", "offset"]
    assert got.filter("_b + _n + _o + _rank + _places + _p <> -6").count() == 0
    check_packing(got.collect(), want, 16)
    check_packing(packing.place_files(materialise(cut.repartition(5)), 16, batch_rows=7).collect(), want, 16)


def test_packing_leaves_little_room(spark):
    rng, words = random.Random(5), vocabulary()
    df = documents(spark, [prose(rng, rng.randint(1, 300), words) for _ in range(400)])
    got = packing.pack(df, tokens.default_path(), 512).collect()
    assert sum(r["length"] for r in got) / (512 * (1 + max(r["sequence_id"] for r in got))) > 0.99


@settings(max_examples=150, deadline=None)
@given(left=st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=5), room=st.integers(0, 30))
def test_fill_is_the_best_subset(left, room):
    got = packing.fill(room, left)
    assert all(0 < n <= left[k] for k, n in got.items())
    sums = [sum(k * n for k, n in zip(left, ns)) for ns in product(*(range(n + 1) for n in left.values()))]
    assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


@settings(max_examples=100, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 20), st.integers(1, 50), max_size=8))
def test_plan_places_every_piece_once(counts):
    seen, used = Counter(), Counter()
    for length, first, n, each, sequence, offset in packing.plan(counts, 20):
        assert first == seen[length] and n % each == 0
        seen[length] += n
        for s in range(sequence, sequence + n // each):
            used[s] += each * length
    assert seen == Counter(counts) and all(v <= 20 for v in used.values())


VALUE = st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.sampled_from([2**60 - 1, 2**60, 2**64 - 1]))


@settings(max_examples=100, deadline=None)
@given(ids=st.lists(VALUE, max_size=700), n=st.integers(0, 1500), fill=VALUE)
def test_simple8b_round_trip(ids, n, fill):
    ids = np.array([*ids, *[fill] * n], np.uint64)
    words, offsets, escapes = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, escapes, len(ids)) == ids).all()
    b = int(len(offsets) // 2)  # a block by itself
    if len(ids) > simple8b.BLOCK and b < len(offsets) - 1:
        own = words[int(offsets[b]) : int(offsets[b + 1])]
        part = ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        assert (simple8b.decode(own, offsets[b : b + 2] - offsets[b], escapes, len(part)) == part).all()


def test_small_ids_take_little_room():
    words, _, _ = simple8b.encode(np.arange(10_000, dtype=np.uint64) % 8)
    assert len(words) * 8 < 10_000 / 2


def test_files(spark, plain, monkeypatch):
    df = odd_documents(spark)
    given = [(r["doc_id"], plain(r["text"]) + [1]) for r in df.select("doc_id", "text").collect()]
    got = simple8b.read_ids(simple8b.write_ids(df, tokens.default_path())).orderBy("start").collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((d, little(i)) for d, i in given)
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    order = [(r["doc_id"] is not None, r["doc_id"]) for r in got]
    assert order == sorted(order)
    assert simple8b.read_ids(simple8b.write_ids(empty_documents(spark), tokens.default_path())).collect() == []


def test_stated_texts_by_their_blocks(spark, plain, monkeypatch):
    df = odd_documents(spark)
    files = simple8b.write_ids(df, tokens.default_path())
    everything = simple8b.read_ids(files).collect()
    known = sorted({r["doc_id"] for r in everything if r["doc_id"] is not None})
    wanted = [*known[::3], known[0], max(known) + 1]
    got = simple8b.read_texts(files, wanted).collect()
    assert Counter(map(tuple, got)) == Counter(tuple(r) for r in everything if r["doc_id"] in wanted)
    assert simple8b.read_texts(files, []).collect() == simple8b.read_texts(files, [max(known) + 1]).collect() == []


class Counted(io.BytesIO):
    seen = 0

    def read(self, n=-1):
        data = super().read(n)
        self.seen += len(data)
        return data


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(0, 1200), max_size=12), most=st.integers(1, 3000), seed=st.integers(0, 9), step=st.integers(1, 3))
def test_runs_of_blocks_are_the_ids(lengths, most, seed, step):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 2 ** rng.integers(1, 63, sum(lengths), dtype=np.uint64), dtype=np.uint64) if sum(lengths) else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    keys = [None if i % 4 == 1 else i for i in range(len(lengths))]
    own = simple8b.IdFile(io.BytesIO(simple8b.file_bytes(ids, np.array(lengths, np.int64), keys)))
    assert [None if z else k for k, z in zip(own.keys.tolist(), own.nulls.tolist(), strict=True)] == keys
    seen = []
    for which, some, cut in own.texts(np.arange(0, len(lengths), step), most):
        for k, i in enumerate(which.tolist()):
            assert (some[cut[k] : cut[k + 1]] == ids[at[i] : at[i + 1]]).all()
        assert len(which) == 1 or len(some) <= most
        seen += which.tolist()
    assert seen == list(range(0, len(lengths), step))


def test_a_text_takes_its_own_blocks_only():
    ids = np.arange(200_000, dtype=np.uint64) % 50_000
    f = Counted(simple8b.file_bytes(ids, np.full(200, 1000, np.int64), list(range(200))))
    own = simple8b.IdFile(f)
    f.seen = 0
    assert (own.ids(100_000, 101_000) == ids[100_000:101_000]).all()
    assert f.seen < 4 * simple8b.BLOCK * 8  # of 200,000 ids


def test_damaged_files_are_refused():
    whole = simple8b.file_bytes(np.arange(3000, dtype=np.uint64), np.array([3000]), [1])
    with pytest.raises(ValueError):
        simple8b.IdFile(io.BytesIO(b"something else"))
    with pytest.raises(ValueError):
        simple8b.IdFile(io.BytesIO(whole[:60]))
    with pytest.raises(ValueError):
        simple8b.IdFile(io.BytesIO(whole[:-8])).ids(0, 3000)


def test_queries(spark, plain, tmp_path):
    from tesselix.llm import queries

    rng, words = random.Random(7), vocabulary()
    texts = [prose(rng, rng.randint(0, 6000), words) for _ in range(20)] + [None, ""]
    spark.createDataFrame(rows(texts), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {i: plain(t) for i, t in enumerate(texts)}
    start = 0
    for r in queries.op4_simple8b_ids(spark, str(tmp_path)).orderBy("doc_id").collect():
        own = [*ids[r["doc_id"]], 1]
        assert tuple(r) == (r["doc_id"], start, len(own), zlib.crc32(little(own)))
        start += len(own)
    pieces = queries.op2_min_slack_packing(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in pieces) == sum(len(i) + 1 for i in ids.values())
    for r in pieces:
        own = [*ids[r["doc_id"]], 2]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(little(own[r["start"] : r["start"] + r["length"]]))
    assert queries.op2_min_slack_packing(spark, str(tmp_path)).agg(F.max("length")).first()[0] <= 4096
