"""Operator 6: secret scan behind a trigram index.

A Boolean trigram query is derived from the parse tree of each rule's regular
expression: literal runs give conjunctions, alternatives disjunctions.  For each
block of texts an inverted index (trigram -> texts) of the lower-cased bytes is
built with array operations; the postings are intersected and united as the
queries say, and only candidate texts are matched.  A rule that has no mandatory
trigram is matched against every text.  Trigrams can only rule texts out that
cannot match, so the result equals that of a full scan.

Rows are handled one by one: no shuffle, no skew, memory bounded by a block.
Null text counts as empty; repeated rows give repeated results; other columns, also
of clashing names, are ignored; an empty table gives no rows.  Spans that start at
one place are listed in the order of the rules.  The rules take time in proportion to
the text, however long it is.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ship, text_bytes, tidy


@dataclass(frozen=True)
class Rule:
    """``least``: the size that group ``group`` of a match must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: The three base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
)
#: Further kinds with well-known public prefixes.
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    # starts where no token goes on, and gives no character back: one pass over any text
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("vcs_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + EXTRA

#: Sets of more alternatives than this stop being tracked as exact strings.
MOST_STRINGS = 64


def trigram_query(pattern: str):
    """True (no mandatory trigram), or ("tri", bytes), ("and", [...]), ("or", [...]).

    The trigrams are of the lower-cased text.
    """
    return _closed(*_sequence(parser.parse(pattern, re.ASCII)))


def _all(parts: list):
    parts = [p for p in dict.fromkeys(map(_frozen, parts)) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list):
    parts = list(dict.fromkeys(map(_frozen, parts)))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _frozen(q):
    return q


def _of_string(s: bytes):
    return _all([("tri", s[i : i + 3]) for i in range(len(s) - 2)])


def _closed(strings, query):
    """The query of something of which ``strings`` are all exact forms (None: unknown)."""
    return query if strings is None else _all([query, _any([_of_string(s) for s in strings])])


def _sequence(items) -> tuple[set | None, object]:
    """(exact strings or None, query that holds besides)."""
    current: set | None = {b""}
    exact, found = True, []
    for op, value in items:
        strings, query = _item(op, value)
        found.append(query)
        if strings is not None and len(strings) * len(current) <= MOST_STRINGS:
            current = {a + b for a in current for b in strings}
        else:
            found.append(_any([_of_string(s) for s in current]))
            if strings is not None:
                found.append(_any([_of_string(s) for s in strings]))
            current, exact = {b""}, False
    if exact:
        return current, _all(found)
    return None, _all([*found, _any([_of_string(s) for s in current])])


def _item(op, value) -> tuple[set | None, object]:
    if op is C.LITERAL:
        return {chr(value).encode().lower()}, True
    if op is C.IN:
        if any(kind is not C.LITERAL for kind, _ in value) or len(value) > 8:
            return None, True
        return {chr(v).encode().lower() for _, v in value}, True
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS and all(q is True for _, q in parts):
            return set().union(*(s for s, _ in parts)), True
        return None, _any([_closed(s, q) for s, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, item = value
        strings, query = _sequence(item)
        if strings is not None and query is True and most == 1:
            return strings | ({b""} if least == 0 else set()), True
        if strings is not None and query is True and least == most and len(strings) ** int(least) <= MOST_STRINGS and least * max(map(len, strings)) <= 64:
            out = {b""}
            for _ in range(int(least)):
                out = {a + b for a in out for b in strings}
            return out, True
        return None, True if least == 0 else _closed(strings, query)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {b""}, True
    return None, True


def _trigrams(q) -> set[bytes]:
    if q is True:
        return set()
    return {q[1]} if q[0] == "tri" else set().union(*map(_trigrams, q[1]))


class TrigramScanner:
    """Finds the spans of all rules in blocks of texts."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        listed = sorted(set().union(*map(_trigrams, self.queries)))
        self.number = {t: i for i, t in enumerate(listed)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, texts: list[bytes], slice_bytes: int = 2 << 20) -> np.ndarray:
        """present[t, d]: whether text d has trigram t."""
        present = np.zeros((len(self.number) + 1, len(texts)), bool)
        joined = b"\x00\x00".join(texts).lower()
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
        for at in range(0, max(0, len(joined) - 2), slice_bytes):
            part = np.frombuffer(joined, np.uint8, min(slice_bytes + 2, len(joined) - at), at).astype(np.uint32)
            ids = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(ids)
            present[ids[where], np.searchsorted(starts, where + at, "right") - 1] = True
        return present[1:]

    def candidates(self, query, present: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(present.shape[1], bool)
        if query[0] == "tri":
            return present[self.number[query[1]]]
        parts = [self.candidates(q, present) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), sorted; code points."""
        out: list[list] = [[] for _ in texts]
        present = self.postings(texts)
        decoded: dict[int, str] = {}
        for k, (rule, compiled, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for d in np.flatnonzero(self.candidates(query, present)):
                text = decoded.get(d)
                if text is None:
                    text = decoded[d] = texts[d].decode("utf-8", "replace")
                for m in compiled.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and secrets: array of (kind, start, end, base) by start, then by
    the order of ``rules``."""
    ship(docs.sparkSession)
    schema = "doc_id long, secrets array<struct<kind:string,start:long,`end`:long,base:boolean>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        scanner = kept(("secrets", rules), lambda: TrigramScanner(rules))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [
                    [{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, k, e in spans]
                    for spans in scanner.spans(part.column(1).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(tidy(run, keeps=True), schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the result of :func:`scan`."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in BASE],
        F.sha2(listed(F.filter("secrets", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def brute_force(text: str | None) -> tuple[list[tuple[str, int, int]], str]:
    """Base spans and digest of one text by plain matching (for tests)."""
    spans = []
    for k, rule in enumerate(BASE):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                spans.append((m.start(), k, m.end()))
    listed = [(BASE[k].kind, s, e) for s, k, e in sorted(spans)]
    return listed, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in listed).encode()).hexdigest()
