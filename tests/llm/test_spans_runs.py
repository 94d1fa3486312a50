"""Personal data, periodic runs, filter audit."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations, product

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tesselix.llm import audit, periodic, personal
from tests.llm.helpers import documents, empty_documents, odd_documents, prose, vocabulary

# --- personal data -------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and brute_luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="a.@-+ 0159()é\n_", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert personal.base_spans(text) == brute_base(text)


@settings(max_examples=200, deadline=None)
@given(parts=st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.256", ".5.6.7", "+1 (521) 555-6210", "+12345678", "a.b@c.d", "@", "a@b", "@x.y-z", " ", "-", "0", "٣٤"]), max_size=8))
def test_base_spans_of_pieces(parts):
    text = "".join(parts)
    assert personal.base_spans(text) == brute_base(text)


def test_rules_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "+1" + "(" * 400_000, "@" * 400_000, "a@" * 200_000, "x " * 200_000 + "1"):
        personal.base_spans(text)
        personal.candidates(text)


def exact_marginals(field, g):
    local, total = personal.own(field, g), None
    out = np.zeros_like(local)
    for labels in product(range(personal.LABELS), repeat=len(local)):
        e = sum(local[i, x] for i, x in enumerate(labels)) + sum(field.links[s][labels[a], labels[b]] for a, b, s in g.links.tolist())
        p = np.exp(e)
        total = p if total is None else total + p
        for i, x in enumerate(labels):
            out[i, x] += p
    return out / total


def test_messages_on_a_tree_give_the_marginals():
    rng = np.random.default_rng(1)
    field = personal.Field(rng.normal(size=(personal.SHAPES, personal.LABELS)), rng.normal(size=(5, personal.LABELS)), rng.normal(size=(5, personal.LABELS, personal.LABELS)))
    field.links[1:] = (field.links[1:] + field.links[1:].transpose(0, 2, 1)) / 2
    g = personal.Graph(np.arange(6), np.arange(6), np.array([-1, 0, 1, 2, 3, -1]), np.array([(0, 1, 0), (1, 2, 0), (1, 3, 2), (3, 5, 1), (0, 4, 3)]))
    assert np.allclose(personal.beliefs(field, g, 200)[0], exact_marginals(field, g), atol=1e-3)


def test_messages_on_a_loop_come_near():
    field = personal.Field.zero()
    field.rules[1:, 1:] += 2 * np.eye(4)
    field.links[1:] += np.eye(personal.LABELS)
    g = personal.Graph(np.arange(4), np.arange(4), np.array([0, -1, -1, -1]), np.array([(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1)]))
    exact, got = exact_marginals(field, g), personal.beliefs(field, g, 200)[0]
    assert (got.argmax(1) == exact.argmax(1)).all() and np.abs(got - exact).max() < 0.2


def number(rng, card=False):
    while True:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if brute_luhn(d) == card:
            return d


def people(n, seed):
    """Texts, each with one entity, written again in another way, and a stranger; and the spans to be added."""
    rng, words = random.Random(seed), vocabulary(200)
    texts, want = [], []
    for i in range(n):
        sort = i % 4
        area, line = f"({rng.randint(100, 999)})", f"555-{rng.randint(1000, 9999)}"
        if sort == 0:
            own = number(rng, True)
            again = own[:5] + str((int(own[5]) + 1) % 10) + own[6:]
            stranger = number(rng)
        elif sort == 1:
            own, again, stranger = f"+1 {area} {line}", f"{area} {line}", f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        elif sort == 2:
            local = f"{rng.choice(words)}{rng.choice(words)}.{rng.randint(10, 99)}"
            own, again, stranger = f"{local}@mail{rng.randint(1, 9)}.example.com", local, f"{rng.choice(words)}{rng.choice(words)}.{rng.randint(10, 99)}"
        else:
            own = again = stranger = ""
        parts = [prose(rng, 20, words), own, prose(rng, 20, words), again, prose(rng, 20, words), stranger, prose(rng, 5, words)]
        text = " ".join(parts)
        at = len(" ".join(parts[:3])) + 1
        texts.append(text)
        want.append([(personal.KINDS[{0: 2, 1: 3, 2: 0}[sort]], at, at + len(again))] if again else [])
    return texts, want


def test_rewritten_entities_are_found_and_strangers_are_not(spark):
    """Learned on some texts, held against others."""
    field = personal.learned(documents(spark, people(400, 1)[0]))
    texts, want = people(400, 2)
    found = personal.find_personal(documents(spark, texts).repartition(3), field).orderBy("doc_id").collect()
    added = [[(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["base"]] for r in found]
    assert [[(personal.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"] if s["base"]] for r in found] == [brute_base(t) for t in texts]
    hit, false = sum(w == a for w, a in zip(want, added, strict=True) if w), sum(x not in w for w, a in zip(want, added, strict=True) for x in a)
    assert hit >= 0.95 * 300 and false <= 3


def test_links_grow_with_the_nodes():
    doc = personal.nodes_of(t := "4111111111111111 " * 5000, personal.base_spans(t), personal.candidates(t))
    assert len(personal.graph([doc]).links) < 25 * 5000


def test_personal_odd_rows(spark):
    odd = odd_documents(spark)
    field = personal.learned(odd)
    assert field.shapes.shape == (personal.SHAPES, personal.LABELS)
    got = personal.find_personal(odd, field).collect()
    assert Counter((r["doc_id"], len(r["spans"])) for r in got) == Counter((r["doc_id"], len(brute_base(r["text"] or ""))) for r in odd.collect())
    assert personal.find_personal(empty_documents(spark), personal.learned(empty_documents(spark))).count() == 0


# --- periodic runs -------------------------------------------------------------------------------------------------


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((i, j - i, q) for (i, j), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def runs_of(w):
    codes = np.array(w, np.int64)
    return periodic.runs(codes, periodic.next_same(codes, np.zeros(len(codes), np.int64)))


@settings(max_examples=300, deadline=None)
@given(seed=st.integers(0, 10**9))
def test_runs_against_all_periods(seed):
    rng = random.Random(seed)
    w = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 5)):
        block = [rng.randrange(rng.choice([2, 4, 50])) for _ in range(rng.randint(1, 25))]
        at = rng.randint(0, len(w))
        w[at:at] = (block * rng.randint(2, 7))[: rng.randint(12, 160)]
    assert runs_of(w) == brute_runs(w)


@pytest.mark.parametrize("w", [fibonacci(700), [bin(i).count("1") % 2 for i in range(700)], [0] * 700, [0, 0, 1] * 200, ([0] * 40 + [1]) * 12, [0] * 11, list(range(50)) * 9, [*([0, 1] * 10), *([2, 3, 4] * 10)] * 8])
def test_runs_of_words_known_for_them(w):
    assert runs_of(w) == brute_runs(w)


def test_long_texts_with_few_words_and_no_run():
    """All words recur near enough for the longest blocks: their keys stay short."""
    w = np.random.default_rng(1).integers(0, 3000, 1_500_000)
    assert runs_of(w) == []
    half = w[:700_000]
    assert runs_of(np.concatenate([half, half])) == [(0, 1_400_000, 700_000)]


def test_long_repetitions_take_little_time():
    for w in ([0] * 300_000, list(range(7)) * 40_000, list(range(5000)) * 40):
        assert len(runs_of(w)) == 1


def brute_collapsed(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return len(w), found, " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_documents(spark):
    rng, words = random.Random(5), vocabulary(30)
    texts = [prose(rng, rng.randint(0, 120), words) + "\n" + "\t".join(words[i % 9 : i % 9 + 3] * (i % 7)) for i in range(120)]
    df = documents(spark, texts).repartition(3)
    got = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(df, plant=True).collect()}
    assert got == {i: brute_collapsed(i, t) for i, t in enumerate(texts)}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in got) > 5


def test_runs_odd_rows(spark):
    got = Counter((r["doc_id"], r["n_words"], len(r["runs"])) for r in periodic.find_runs(odd_documents(spark)).collect())
    want = Counter()
    for r in odd_documents(spark).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        want[r["doc_id"], len(w), 1 if len(set(w)) == 1 and len(w) >= 12 else 0] += 1
    assert got == want
    assert periodic.find_runs(empty_documents(spark), plant=True).count() == 0


# --- filter audit --------------------------------------------------------------------------------------------------


def test_table_of_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120) and len(set(audit.ORDERS)) == 120
    for fails in range(32):
        for o, order in enumerate(audit.ORDERS):
            assert table[fails, o] == next((s for s, f in enumerate(order) if fails >> "ABCDE".index(f) & 1), 5)


def brute_audit(docs, labels):
    """docs: (doc_id, text, source); applies the filters one after another, in every order."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if x}
        own = [x for x in labels if i is not None and x[0] == i]
        rows.append((source or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, shapley = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = [r for r in mine if f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def audited(df, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in audit.COUNTS] for r in audit.audit(df, labels).collect()}


LABELS = "doc_id bigint, quality int, toxic int"


def test_audit_against_filtering(spark, monkeypatch):
    rng, words = random.Random(3), vocabulary(150)
    texts = []
    for i in range(300):
        t = prose(rng, rng.choice([0, 5, 49, 50, 60, 90]), words[: rng.choice([20, 150])])
        t = t.upper() if rng.random() < 0.2 else t
        texts.append(t + rng.choice(["", "", " #", "|", "é"]))
    texts += rng.choices(texts, k=100) + ["copy of one " * 20] * 200 + [None, ""]
    docs = [(i, t, rng.choice(["a", "b", "b", None, ""])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(5)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 600, 2)] + [(4, 1, 1), (None, 1, 1), (10**9, 1, 0)]
    assert audited(df, spark.createDataFrame(labels, LABELS)) == brute_audit(docs, labels)


def test_words_of_long_texts_are_counted_by_pieces(monkeypatch):
    monkeypatch.setattr(audit, "PIECE_BYTES", 50)
    rng, words = random.Random(3), vocabulary(60)
    for text in (prose(rng, 500, words), "x" * 400, "x" * 400 + " y", " " * 300, "\ta " * 80):
        w = text.split()
        assert audit.count_words(text.encode()) == (len(w), len(set(w)))


def test_audit_odd_rows(spark):
    odd = odd_documents(spark)
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    labels = [(1, 1, 0), (None, 1, 1), (3, None, 1)]
    assert audited(odd, spark.createDataFrame(labels, LABELS)) == brute_audit(docs, labels)
    none = spark.createDataFrame([], LABELS)
    assert audited(odd, none) == brute_audit(docs, []) and audited(empty_documents(spark), none) == {}
