"""Personal data by a skip-chain conditional random field.

Four base rules (mail addresses, network addresses, card and phone numbers) find what is well formed. What is written
differently, or mistyped, elsewhere in the same document is found by the field:

* Its nodes are the tokens with a digit or an @ in them; all other tokens are outside any entity, so the chain falls apart into
  runs of such tokens and only those are worked on.
* Adjacent nodes share a chain potential. Distant nodes share a skip potential if they are the same token, have the same
  digits or last ten digits, differ in one digit, or share an address's local part. Each node is linked with the next one
  of its kind in the document, so links grow with the nodes, not with their pairs.
* A node's own potential looks at its shape and at whether a base rule covers it.
* Beliefs come from loopy message passing over all links of a slice of documents at once. Runs of nodes that a base rule doesn't cover
  and that get one label are added to the base spans.

Weights are learned by gradient steps on the likelihood, its expectations being beliefs, from about SAMPLE documents. Labels come from
the base rules, and two things are made from each labelled span: a copy elsewhere in the document that the rule misses
(mistyped, or without its sign), of the same label; and a stranger of the same shape, of none. So the shape of what the rules reject
says nothing by itself: only a link to something well formed does.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tesselix.sources.shipping import ship

# The kinds in the order in which spans are listed, their patterns and bounds.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the same matches as the plain patterns, without looking at a long run again from each of its characters
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MAYBE_IP = r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"
MAYBE_CARD = r"[0-9](?:[ -]?[0-9]){12}"
MAYBE_PHONE = r"\+[0-9][ ().0-9-]"

SPACE = re.compile(r"[\x20\x09-\x0D]")
MARK = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
EDGE = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "+()@")
NUMBER = re.compile(r"[0-9+().-]+\Z")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Labels: none, then the kinds.
LABELS = 1 + len(KINDS)
SHAPES = 24
SKIPS = 4
SAMPLE = 10_000
#: What is learned from: documents of so many nodes at most, of tokens of so many characters, and so many nodes in all.
LEARN_NODES = 100
LEARN_CHARS = 64
LEARN_TOTAL = 50_000
#: Links whose tables of pairs are held at once.
LINKS = 1 << 16
SWEEPS = 30
STEPS = 100


# --- the base rules -------------------------------------------------------------------------------------------


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(.[A-Za-z0-9-]+)+, from each @ to both sides."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > low and text[begin - 1] in LOCAL:
            begin -= 1
        rest = DOMAIN.match(text, at + 1) if begin < at else None
        if rest:
            out.append((begin, rest.end()))
            low = rest.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def _digits(s: str) -> str:
    return NOT_DIGIT.sub("", s)


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(part := part.lstrip("0")) < 4 and int(part or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    found = [(m.span(), _digits(m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 13]
    return [span for span, d in found if 13 <= len(d) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) by kind, then start, in code points."""
    return [(k, *span) for k, rule in enumerate((emails, ips, cards, phones)) for span in rule(text)]


# --- nodes and links ------------------------------------------------------------------------------------------


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an @, without marks around them."""
    out, low = [], 0
    for m in MARK.finditer(text):
        begin = m.start()
        while begin > low and not SPACE.match(text, begin - 1):
            begin -= 1
        token, low = text[begin : m.end()], m.end()
        left = len(token) - len(token.lstrip(EDGE))
        out.append((begin + left, begin + len(token.rstrip(EDGE))))
    return out


@dataclass
class Nodes:
    """The nodes of one document: tokens, whether one stands right after the one before, the kind (or -1) of the base span over it
    and the digits of that whole span, or else of the run of numbers it is in."""

    tokens: list[str]
    joined: list[bool]
    rule: list[int]
    whole: list[str]


def nodes_of(text: str, base: list[tuple[int, int, int]], tokens: list[tuple[int, int]]) -> Nodes:
    n = len(tokens)
    rule, whole, begins = [-1] * n, [""] * n, np.array([i for i, _ in tokens])
    ends = np.array([j for _, j in tokens])
    for kind, start, end in reversed(base):  # of overlapping spans the first kind counts
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(begins, end))
        digits = _digits(text[start:end])
        for i in range(first, last):
            rule[i], whole[i] = kind, digits
    between = [text[tokens[i - 1][1] : tokens[i][0]] if i and tokens[i][0] - tokens[i - 1][1] < 4 else "xxxx" for i in range(n)]
    words, joined = [text[i:j] for i, j in tokens], [len(b) - len(b.strip("\x20\t\n\v\f\r")) == 1 for b in between]
    i = 0
    while i < n:
        j, number = i + 1, rule[i] < 0 and bool(NUMBER.match(words[i]))
        while number and j < n and joined[j] and rule[j] < 0 and NUMBER.match(words[j]):
            j += 1
        if number:
            whole[i:j] = [_digits("".join(words[i:j]))] * (j - i)
        i = j
    return Nodes(words, joined, rule, whole)


def shape(token: str) -> list[int]:
    """Numbers of the features that hold of a token."""
    digits = sum(map(token.count, "0123456789"))
    letters = sum(c.isalpha() for c in token)
    some = [0, 1 + min(digits, 4) if digits < 5 else 6 + min((digits - 5) // 3, 5)]
    tests = ("@" in token, letters > 0, token.count(".") == 3 and not letters, token.count(".") in (1, 2), token[:1] == "+", "(" in token or ")" in token, "-" in token and not letters, digits == len(token), letters > 2 * digits, not token.isascii(), len(token) > 32)
    return some + [12 + i for i, holds in enumerate(tests) if holds]


def keys(token: str, whole: str) -> list[tuple[int, object]]:
    """What a node's partners have in common with it: (sort of link, key)."""
    out: list[tuple[int, object]] = []
    digits = _digits(token)
    if len(digits) >= 5 or "@" in token or (digits and len(token) >= 6):
        out.append((0, token.lower()))
    for d in {digits, whole}:
        if 7 <= len(d) <= 19:
            out.append((1, d))
        if 10 <= len(d) <= 19:
            out.append((1, d[-10:]))
            out += [(2, (d[:i], d[i + 1 :])) for i in range(len(d))]
    local = token.lower().split("@")[0]
    if len(local) >= 4 and not local.isdigit():
        out.append((3, local))
    return out


@dataclass
class Graph:
    """Nodes of many documents: features by node (row, feature), rule, and links (from, to, sort: 0 the chain, then the sorts of skips)."""

    rows: np.ndarray
    features: np.ndarray
    rule: np.ndarray
    links: np.ndarray


def graph(documents: list[Nodes]) -> Graph:
    rows, features, rule, links, first = [], [], [], [], 0
    for doc in documents:
        last: dict[tuple[int, object], int] = {}
        met: set[tuple[int, int]] = set()
        for i, (token, joined, whole) in enumerate(zip(doc.tokens, doc.joined, doc.whole, strict=True)):
            held = shape(token)
            rows += [first + i] * len(held)
            features += held
            if joined:
                links.append((first + i - 1, first + i, 0))
                met.add((i - 1, i))
            for key in sorted(keys(token, whole), key=lambda k: k[0]):
                before = last.get(key)
                if before is not None and before != i and (before, i) not in met:
                    met.add((before, i))
                    links.append((first + before, first + i, 1 + key[0]))
                last[key] = i
        rule += doc.rule
        first += len(doc.tokens)
    return Graph(np.array(rows, np.int64), np.array(features, np.int64), np.array(rule, np.int64), np.array(links, np.int64).reshape(-1, 3))


# --- the field ------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights: of features by label, of the rules' kinds by label, and between labels by sort of link (skips alike both ways)."""

    shapes: np.ndarray
    rules: np.ndarray
    links: np.ndarray

    @staticmethod
    def zero() -> Field:
        return Field(np.zeros((SHAPES, LABELS)), np.zeros((1 + len(KINDS), LABELS)), np.zeros((1 + SKIPS, LABELS, LABELS)))


def own(field: Field, g: Graph) -> np.ndarray:
    out = field.rules[g.rule + 1].copy()
    np.add.at(out, g.rows, field.shapes[g.features])
    return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def beliefs(field: Field, g: Graph, sweeps: int = SWEEPS, joint: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Of each node the shares of its labels, of each link (if joint) those of its pairs of labels, by loopy message passing: all messages
    at once, half of each from the one before, until none changes. On a tree they are the marginals. Tables of pairs are made for
    LINKS links at a time."""
    local = own(field, g)
    a, b, sort = g.links.T
    src, dst, n = np.concatenate([a, b]), np.concatenate([b, a]), len(a)
    back = np.concatenate([np.arange(n) + n, np.arange(n)])
    both = np.concatenate([field.links, field.links.transpose(0, 2, 1)])  # there, and the other way
    which = np.concatenate([sort, sort + len(field.links)])
    message = np.zeros((len(src), LABELS))

    def together():
        out = local.copy()
        np.add.at(out, dst, message)
        return out

    for _ in range(sweeps if n else 0):
        total, new = together(), np.empty_like(message)
        for k in range(0, len(src), LINKS):
            some = slice(k, k + LINKS)
            new[some] = _sum_exp((total[src[some]] - message[back[some]])[:, :, None] + both[which[some]], 1)
        new -= new.max(1, keepdims=True)
        change = np.abs(new - message).max()
        message = (message + new) / 2
        if change < 1e-3:
            break
    total = together()
    single = np.exp(total - _sum_exp(total, 1)[:, None])
    if not joint or not n:
        return single, np.zeros((0, LABELS, LABELS))
    pairs = (total[src] - message[back])[:n, :, None] + (total[dst] - message)[:n, None, :] + field.links[sort]
    pairs = pairs.reshape(n, LABELS * LABELS)
    return single, np.exp(pairs - _sum_exp(pairs, 1)[:, None]).reshape(n, LABELS, LABELS)


def learn(g: Graph, labels: np.ndarray, steps: int = STEPS, decay: float = 1e-3) -> Field:
    """Gradient steps of adaptive size from zero."""
    field = Field.zero()
    if not len(labels):
        return field
    seen = {name: np.zeros_like(getattr(field, name)) + 1e-6 for name in ("shapes", "rules", "links")}
    target = np.eye(LABELS)[labels]
    a, b, sort = g.links.T
    target_pair = target[a][:, :, None] * target[b][:, None, :]
    for _ in range(steps):
        single, joint = beliefs(field, g, 10)
        miss, miss_pair = (target - single) / len(labels), (target_pair - joint) / len(labels)
        grad = Field.zero()
        np.add.at(grad.shapes, g.features, miss[g.rows])
        np.add.at(grad.rules, g.rule + 1, miss)
        np.add.at(grad.links, sort, miss_pair)
        grad.links[1:] = (grad.links[1:] + grad.links[1:].transpose(0, 2, 1)) / 2
        for name, past in seen.items():
            w, d = getattr(field, name), getattr(grad, name)
            d = d - decay * w / len(labels) ** 0.5
            past += d * d
            w += 0.3 * d / np.sqrt(past)
    return field


# --- what it learns from --------------------------------------------------------------------------------------


def _mistyped(tokens: list[str], rng: random.Random) -> list[str]:
    """One digit is another."""
    k, i = rng.choice([(k, i) for k, t in enumerate(tokens) for i, c in enumerate(t) if c.isdigit()])
    t = tokens[k]
    return [*tokens[:k], t[:i] + rng.choice([c for c in "0123456789" if c != t[i]]) + t[i + 1 :], *tokens[k + 1 :]]


def _stranger(token: str, rng: random.Random) -> str:
    return "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isascii() and c.isalpha() else c for c in token)


def lesson(doc: Nodes, rng: random.Random) -> tuple[Nodes, list[int]]:
    """The document's nodes with, for each entity, a copy that the rule misses and strangers; and the labels. Nodes that no rule
    covers but that have partners which one does are left out: what they are isn't known."""
    partners = [set(keys(t, w)) for t, w in zip(doc.tokens, doc.whole, strict=True)]
    covered = set().union(*(p for p, r in zip(partners, doc.rule, strict=True) if r >= 0))
    known = [i for i, r in enumerate(doc.rule) if r >= 0 or not partners[i] & covered]
    doc = Nodes([doc.tokens[i] for i in known], [doc.joined[i] and n > 0 and known[n - 1] == i - 1 for n, i in enumerate(known)], [doc.rule[i] for i in known], [doc.whole[i] for i in known])
    out, labels = Nodes(list(doc.tokens), list(doc.joined), list(doc.rule), list(doc.whole)), [r + 1 for r in doc.rule]

    def put(tokens: list[str], label: int) -> None:
        digits = _digits("".join(tokens)) if all(map(NUMBER.match, tokens)) else ""
        for i, t in enumerate(tokens):
            out.tokens.append(t)
            out.joined.append(i > 0)
            out.rule.append(-1)
            out.whole.append(digits)
            labels.append(label)

    i = 0
    while i < len(doc.tokens):
        j = i + 1
        while j < len(doc.tokens) and doc.joined[j] and doc.rule[j] == doc.rule[i] and doc.whole[j] == doc.whole[i]:
            j += 1
        if (kind := doc.rule[i]) >= 0:
            tokens, sort = doc.tokens[i:j], rng.random()
            if KINDS[kind] == "email":
                other = [tokens[0].split("@")[0]] if sort < 0.5 else tokens
            elif sort < 0.35 and len(doc.whole[i]) >= 10:
                other = _mistyped(tokens, rng)
            elif KINDS[kind] == "phone" and sort < 0.7:
                other = tokens[1:] if len(tokens) > 1 and tokens[0][0] == "+" and len(tokens[0]) < 5 else ["".join(map(_digits, tokens))]
            else:
                other = tokens
            put(other, kind + 1)
            for _ in range(2):
                strange = [_stranger(t, rng) for t in rng.choice((tokens, other))]
                for _ in range(rng.choice((1, 1, 2))):
                    put(strange, 0)
        i = j
    return out, labels


# --- over documents -------------------------------------------------------------------------------------------


def _marked(texts: pa.Array) -> tuple[list[bool], ...]:
    """Which texts can have nodes, and which can match the rules, by scans of a linear-time matcher."""
    hit = lambda p: pc.match_substring_regex(texts, p)
    at = pc.match_substring(texts, "@")
    rules = pc.or_(pc.or_(at, hit(MAYBE_IP)), pc.or_(hit(MAYBE_CARD), hit(MAYBE_PHONE)))
    return pc.or_(at, hit("[0-9]")).to_pylist(), rules.to_pylist()


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """The field, learned from about `sample` documents (at most twice as many, and LEARN_TOTAL nodes), picked by the hash of their id. A table without any
    personal data gives a field of zeros, under which nothing is added."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.count()
    share = int(min(1.0, sample / max(rows, 1)) * (1 << 31))
    picked = docs.filter(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    picked = picked.filter(F.shiftrightunsigned("h", 33) <= share)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            out = []
            for h, text, rules in zip(b.column(0).to_pylist(), texts, _marked(texts)[1], strict=True):
                if rules:
                    text = text.as_py()
                    doc = nodes_of(text, base_spans(text), candidates(text))
                    if 0 < len(doc.tokens) <= LEARN_NODES and max(map(len, doc.tokens)) <= LEARN_CHARS:
                        out.append((h, doc.tokens, doc.joined, doc.rule, doc.whole))
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["h", "tokens", "joined", "rule", "whole"])

    found = picked.mapInArrow(run, "h bigint, tokens array<string>, joined array<boolean>, rule array<int>, whole array<string>")
    got, n = [], 0
    for r in found.orderBy("h", "tokens").limit(2 * sample).collect():  # bounded: documents, their nodes and tokens
        n += len(r["tokens"])
        if n <= LEARN_TOTAL:
            got.append(r)
    lessons = [lesson(Nodes(r["tokens"], r["joined"], r["rule"], r["whole"]), random.Random(r["h"])) for r in got]
    return learn(graph([d for d, _ in lessons]), np.array([x for _, labels in lessons for x in labels], np.int64))


def added_spans(g_rule: list[int], joined: list[bool], tokens: list[tuple[int, int]], label: list[int]) -> list[tuple[int, int, int]]:
    """Runs of adjacent nodes of one label that no rule covers."""
    out: list[tuple[int, int, int]] = []
    for i, (start, end) in enumerate(tokens):
        if g_rule[i] >= 0 or not label[i]:
            continue
        if joined[i] and out and out[-1][2] == tokens[i - 1][1] and g_rule[i - 1] < 0 and label[i - 1] == label[i]:
            out[-1] = (out[-1][0], out[-1][1], end)
        else:
            out.append((label[i] - 1, start, end))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
#: Nodes whose messages are passed together; a document of more is taken alone.
GRAPH_NODES = 20_000


def find_personal(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, spans array<struct<kind, start, end, base>> by kind, then start, in code points, end exclusive;
    base: found by a rule. Added spans don't overlap base ones.

    A null or empty text has none. Repeated rows give repeated rows, an empty table none, a null id stays null; other
    columns are dropped. A text is worked on whole."""
    ship(docs.sparkSession)

    def label(held: list[tuple[Nodes, list, list]]) -> list[list[tuple[int, int, int]]]:
        if not held:
            return []
        single = beliefs(field, graph([doc for doc, _, _ in held]), joint=False)[0]
        best = np.where(single.max(1) > 0.5, single.argmax(1), 0).tolist()
        out, at = [], 0
        for doc, _, tokens in held:
            out.append(added_spans(doc.rule, doc.joined, tokens, best[at : at + len(tokens)]))
            at += len(tokens)
        return out

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_string()).fill_null("")
            spans: list[list[dict]] = [[] for _ in range(len(texts))]
            held, where, size = [], [], 0

            def settle():
                for i, (_, base, _), more in zip(where, held, label(held), strict=True):
                    every = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                    spans[i] = [{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in every]

            for i, (text, nodes, rules) in enumerate(zip(texts, *_marked(texts), strict=True)):
                if not nodes:
                    continue
                text = text.as_py()
                tokens = candidates(text)
                base = base_spans(text) if rules else []
                if size and size + len(tokens) > GRAPH_NODES:
                    settle()
                    held, where, size = [], [], 0
                held.append((nodes_of(text, base, tokens), base, tokens))
                where.append(i)
                size += len(tokens)
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(picked.dtypes)["doc_id"]
    return picked.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")
