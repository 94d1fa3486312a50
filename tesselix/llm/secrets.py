"""Secret scans: multipart credential linking.

Single patterns find strong parts (assignments to a secret's name, access-key ids, long hex). Weak parts (account
names, endpoints, opaque strings) are everywhere in clean text and are reported only when a complementary part stands
in the same scope: the parts, sorted by position, are joined with the scopes (blocks between blank lines) as
intervals, and a weak part stays if its scope holds both a secret and something to use it with (an identifier or an
endpoint). One text's parts are joined in the task that holds it; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tesselix.sources.shipping import ship

# The kinds in the order that breaks ties of position, their patterns and least lengths.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
WEAK = {
    "account": re.compile(r"""\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", re.I | re.A),
    "endpoint": re.compile(r"""\b(?:https?|wss?|ftps?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""", re.I | re.A),
    "opaque": re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}"),
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "opaque": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
SCOPE_END = re.compile(r"\n[ \t\r]*\n")
#: Texts that none of the patterns can match are passed over by one scan of a linear-time matcher.
MAYBE_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]"""
MAYBE_ACCESS = r"AKIA[A-Z0-9]{12}"
MAYBE_HEX = r"[0-9a-f]{32}"
MAYBE_WEAK = r"""(?i)://|[A-Za-z0-9+/_-]{24}|(user|name|login|client_?id|account|account_?id|access_?key_?id)["']? *[:=]"""


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def opaque(s: str) -> bool:
    """A string without words: digits, both letter cases and at least 3.5 bits a character."""
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and entropy(s) >= 3.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [(kind, m.start(), m.end()) for kind, (pattern, group, least) in BASE.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def linked_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The weak parts that a complementary part in their scope confirms. Parts that overlap a strong one are that one."""
    weak = [(kind, m.start(), m.end()) for kind, pattern in WEAK.items() for m in pattern.finditer(text) if kind != "opaque" or opaque(m[0])]
    if not weak:
        return []
    parts, covered, begins = [], 0, [s for _, s, _ in base]  # ascending
    for kind, start, end in sorted([*base, *weak], key=lambda s: (s[1], KINDS.index(s[0]))):
        if kind in WEAK:
            after = bisect_left(begins, start)
            if start < covered or (after < len(begins) and begins[after] < end):
                continue
        parts.append((kind, start, end))
        covered = max(covered, end)
    kept, i = [], 0
    for scope_end in [*(m.start() for m in SCOPE_END.finditer(text)), len(text) + 1]:  # both sides ascend: a merge
        here = []
        while i < len(parts) and parts[i][1] < scope_end:
            here.append(parts[i])
            i += 1
        roles = {ROLE[kind] for kind, _, _ in here}
        if "secret" in roles and len(roles) > 1:
            kept += [p for p in here if p[0] in WEAK]
    return kept


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(texts: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
    """All spans of each text, by start, then kind."""
    hit = lambda p: pc.match_substring_regex(texts, p)
    strong = pc.or_(pc.or_(hit(MAYBE_ASSIGN), hit(MAYBE_ACCESS)), hit(MAYBE_HEX))
    weak = hit(MAYBE_WEAK)
    for text, s, w in zip(texts, strong.to_pylist(), weak.to_pylist(), strict=True):
        if not (s or w):
            yield []
            continue
        text = text.as_py()
        base = base_spans(text) if s else []
        yield sorted([*base, *(linked_spans(text, base) if w else [])], key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, secrets array<struct<kind, start, end>> in code points, end exclusive.

    A null or empty text has none. Repeated rows give repeated rows, an empty table none, a null id stays null; other
    columns are dropped. Spans of different kinds may overlap, those of one kind don't.
    """

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_string()).fill_null("")
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in _scan(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "secrets"])

    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(picked.dtypes)["doc_id"]
    return picked.mapInArrow(run, f"doc_id {kind}, secrets array<struct<kind: string, start: bigint, end: bigint>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets."""
    out, at, open_until = [], 0, -1
    for kind, start, end in spans:
        if start >= open_until:
            out += [text[at:start], f"[{kind.upper()}]"]
        open_until = max(open_until, end)
        at = open_until
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced in the text, and its length column, if there is one, brought up to date. Rows without
    secrets, null texts and all other columns are unchanged."""
    schema = docs.schema
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).cast(pa.large_string()).fill_null("")
            changed = {i: redact(texts[i].as_py(), spans) for i, spans in enumerate(_scan(texts)) if spans}
            columns = list(b.columns)
            if changed:
                new = columns[at].to_pylist()
                for i, t in changed.items():
                    new[i] = t
                columns[at] = pa.array(new, columns[at].type)
                if (n := b.schema.get_field_index(length_col or "")) >= 0:
                    lengths = columns[n].to_pylist()
                    for i, t in changed.items():
                        lengths[i] = len(t)
                    columns[n] = pa.array(lengths, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, schema)
