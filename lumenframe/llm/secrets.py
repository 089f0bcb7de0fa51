"""Secret scans through a trigram index.

Each rule's regular expression is read as a parse tree and turned into a Boolean query over
trigrams that every match must contain (lower-cased, on UTF-8 bytes): literal runs give AND of
their trigrams, alternatives give OR. A block of documents is indexed by the trigrams that some
query mentions - postings are sorted document numbers - the queries intersect and unite postings,
and only the candidates are verified with the expression itself. A rule without a mandatory
trigram (a bare character class) scans every document of the block.

One pass, no shuffle; a task holds one block (about `block_chars` characters, or one document).

Base rules follow fixed definitions: matches of the open-ended pattern are found leftmost and
without overlap, and those too short are dropped afterwards. Further rules only add spans. Spans
count code points, the end is exclusive.

Defined cases: a null or empty text has no spans. Null or repeated ids stay as they are, a row a
document. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as C
from re import _parser as parser

from lumenframe.llm.common import ship_package


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    any_case: bool = False
    least: int = 0
    group: int = 0

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", False, 20),
    Rule("hex", r"[0-9a-f]+", False, 24),
)
# Public key and token formats.
FURTHER = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[0-9a-zA-Z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[^\s/@]+"),
)

# A query is True (every document), a trigram (int), ("and", [...]) or ("or", [...]).
MOST_STRINGS = 64


def _both(kind: str, parts: list):
    neutral = kind == "and"
    kept = []
    for p in parts:
        if p is True:
            if neutral:
                continue
            return True
        kept.append(p)
    if not kept:
        return True
    return kept[0] if len(kept) == 1 else (kind, kept)


def _of_strings(strings: set[bytes]):
    return _both("or", [_both("and", [int.from_bytes(s[i : i + 3], "big") for i in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def _lowered(code: int) -> bytes:
    return chr(code).encode().lower()


def _exact(op, arg) -> set[bytes] | None:
    """All strings that a node can match, lower-cased, if few."""
    if op is C.LITERAL:
        return {_lowered(arg)}
    if op is C.IN:
        found: set[bytes] = set()
        for kind, value in arg:
            if kind is C.LITERAL:
                found.add(_lowered(value))
            elif kind is C.RANGE and value[1] - value[0] < MOST_STRINGS:
                found |= {_lowered(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is C.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is C.BRANCH:
        parts = [_exact_sequence(x) for x in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
        one = _exact_sequence(arg[2])
        return None if one is None else {b"".join(x) for k in range(arg[0], arg[1] + 1) for x in product(sorted(one), repeat=k)}
    return {b""} if op is C.AT else None


def _exact_sequence(nodes) -> set[bytes] | None:
    out = {b""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(nodes):
    """The trigrams that any match of the parsed expression must contain."""
    parts, run = [], {b""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_of_strings(run))
        run = one if one is not None else {b""}
        if one is None:
            if op is C.SUBPATTERN:
                parts.append(trigram_query(arg[-1]))
            elif op is C.BRANCH:
                parts.append(_both("or", [trigram_query(x) for x in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                parts.append(trigram_query(arg[2]))
    parts.append(_of_strings(run))
    return _both("and", parts)


def rule_query(rule: Rule):
    return trigram_query(parser.parse(rule.pattern, rule.regex.flags))


def mentioned(query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(mentioned, query[1]))


class TrigramIndex:
    """Postings of a block of texts, for the trigrams of a vocabulary."""

    def __init__(self, texts: list[bytes], vocabulary: set[int]):
        self.n = len(texts)
        wanted = np.zeros(1 << 24, bool)
        wanted[list(vocabulary)] = True
        joined = np.frombuffer(b"\n\n\n".join(texts).lower(), np.uint8)
        ends = np.cumsum([len(t) + 3 for t in texts])
        postings: dict[int, list[np.ndarray]] = {}
        for i in range(0, max(0, len(joined) - 2), 1 << 20):
            b = joined[i : i + (1 << 20) + 2].astype(np.uint32)
            codes = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
            at = np.flatnonzero(wanted[codes])
            docs = np.searchsorted(ends, at + i, "right")
            pairs = np.unique(codes[at].astype(np.int64) << 32 | docs)
            for code, start, stop in zip(*self._runs(pairs >> 32), strict=True):
                postings.setdefault(code, []).append(pairs[start:stop] & 0xFFFFFFFF)
        self.postings = {k: np.unique(np.concatenate(v)) for k, v in postings.items()}

    @staticmethod
    def _runs(keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], int)
        return keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)][: len(starts)]

    def find(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.postings.get(query, np.array([], np.int64))
        found = self.find(query[1][0])
        for q in query[1][1:]:
            found = np.intersect1d(found, self.find(q), assume_unique=True) if query[0] == "and" else np.union1d(found, self.find(q))
        return found


def matches(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_block(texts: list[str], rules: tuple[Rule, ...], queries: list) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end), sorted."""
    index = TrigramIndex([t.encode() for t in texts], set().union(*map(mentioned, queries)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex = rule.regex
        for i in index.find(query).tolist():
            found[i].extend((a, k, b) for a, b in matches(rule, regex, texts[i]))
    return [sorted(f) for f in found]


def secrets(docs: DataFrame, further: tuple[Rule, ...] = FURTHER, block_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end: by start, then kind as the rules are listed)."""
    ship_package(docs.sparkSession)
    rules = BASE + tuple(further)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [rule_query(r) for r in rules]
        for batch in batches:
            ids, start, size = batch.column(0), 0, 0
            texts: list[str] = []
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py())
                size += len(texts[-1])
                if size >= block_chars or i == batch.num_rows - 1:
                    spans = [[{"kind": rules[k].name, "start": a, "end": b} for a, k, b in f] for f in scan_block(texts, rules, queries)]
                    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.array(spans, kind)], ["doc_id", "spans"])
                    texts, start, size = [], i + 1, 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
