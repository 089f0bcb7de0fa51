"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a string into phrases by what stands near each place, never by
its offset: a symbol is replaced by the lowest bit in which it differs from its left neighbour
(and that bit), repeated until few labels remain, which are brought down to three; local maxima,
and local minima not next to one, are landmarks at most a few symbols apart. A phrase is what lies
between landmarks; its name is a hash of its symbols. Names are the symbols of the next level, so
phrases of phrases form a hierarchy, about 2.3 times as long at each level. A run of one repeated
symbol is one phrase (its symbol and length), since neighbours must differ for coin tossing. Equal
substrings so get equal names inside, at every level, wherever they stand.

A fingerprint holds, for the levels whose phrases are long enough to tell texts apart, the
minimum of the names' hashes in each of 128 bins (one-permutation min-hashing, 16 bits each). The
likeness of two fingerprints is the share of equal bins among those filled in either.

All of it is numpy over many texts at once; a text boundary is a landmark. op1 needs each text's
successor in falling doc_id: rows are dealt into ranges whose bounds are ids that occur, the first
row of a range is also sent to the range before, and the sorted rows are read in one pass. The
texts are shuffled once, no range grows with skew, and there is no global sort in one task.

Defined cases: a null text counts as empty; the empty text's fingerprint is the hash of nothing in
every bin, like any text without phrases. Equal ids stand in the order of their texts' hashes (a
null id is the smallest); rows that are equal in both are interchangeable. A single row is its own
successor. Very long texts are parsed whole; a worker holds about 50 bytes a character of one. ids
must be integers (an error otherwise). Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import ship_package

BINS = 128
LEVELS = 6
#: Levels whose names count: phrases of about 12 symbols and of about 28; lower ones while these are few.
FINE, COARSE, FEW = 3, 4, 8
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: 2 * (lowest differing bit) + that bit, against the left neighbour, as bytes; a text's start tosses against its complement."""
    one = labels.dtype.type(1)
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[first] = ~labels[first]
    differ = labels ^ left
    low = np.bitwise_count((differ & (~differ + one)) - one)
    return (low << np.uint8(1)) | ((labels >> low.astype(labels.dtype)) & one).astype(np.uint8)


def _three(labels: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Labels 0..5, neighbours different, to 0..2, neighbours different."""
    out = labels.astype(np.int8)
    for value in (5, 4, 3):
        at = np.flatnonzero(out == value)
        if not len(at):
            continue
        left = np.where(first[at], -1, out[np.maximum(at - 1, 0)])
        right = np.where(last[at], -1, out[np.minimum(at + 1, len(out) - 1)])
        free = np.where((left != 0) & (right != 0), 0, np.where((left != 1) & (right != 1), 1, 2))
        out[at] = free
    return out


def _landmarks(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where phrases begin: text starts and landmarks. Neighbours inside a text differ."""
    n = len(symbols)
    first = np.zeros(n, bool)
    first[starts] = True
    last = np.r_[first[1:], True]
    labels = symbols
    for _ in range(5):
        labels = _toss(labels, first)
    c = _three(np.minimum(labels, np.uint8(5)), first, last)
    left, right = np.r_[np.int8(-1), c[:-1]], np.r_[c[1:], np.int8(-1)]
    left[first], right[last] = -1, -1
    top = (c > left) & (c > right) & ~first & ~last
    beside = np.r_[False, top[:-1]] | np.r_[top[1:], False]
    bottom = (c < left) & (c < right) & ~first & ~last & ~beside
    return top | bottom | first


def _named(symbols: np.ndarray, begins: np.ndarray, level: int) -> np.ndarray:
    """One name for each phrase."""
    at = np.flatnonzero(begins)
    inside = np.arange(len(symbols)) - np.repeat(at, np.diff(np.r_[at, len(symbols)]))
    spread = mix64(symbols + (inside.astype(np.uint64) + np.uint64(1 + 64 * level)) * _M1)
    return mix64(np.add.reduceat(spread, at) + np.uint64(level))


def hierarchy(texts: list[str], levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level: the phrase names of all texts (in order) and the text of each."""
    kept = [(i, t) for i, t in enumerate(texts) if t]
    symbols = np.frombuffer("".join(t for _, t in kept).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.array([i for i, _ in kept], np.int64), [len(t) for _, t in kept])
    symbols = mix64(symbols * _M1 + np.uint64(7))
    for level in range(levels):
        if not len(symbols):
            return
        new = np.r_[True, owner[1:] != owner[:-1]]
        heads = np.flatnonzero(new | np.r_[True, symbols[1:] != symbols[:-1]])
        lengths = np.diff(np.r_[heads, len(symbols)])
        symbols, owner = symbols[heads], owner[heads]
        runs = lengths > 1
        symbols[runs] = mix64(symbols[runs] ^ (lengths[runs].astype(np.uint64) * _M2))
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        same = np.flatnonzero(np.r_[False, (symbols[1:] == symbols[:-1]) & (owner[1:] == owner[:-1])])
        symbols[same] += _M3
        begins = _landmarks(symbols, starts)
        symbols = _named(symbols, begins, level)
        owner = owner[begins]
        yield symbols, owner


def sketches(texts: list[str]) -> np.ndarray:
    """texts by BINS, unsigned 16-bit; 65535 is an empty bin."""
    n = len(texts)
    out = np.full((n, BINS), 0xFFFF, np.uint16)
    seen = list(hierarchy(texts, COARSE))
    counts = [np.bincount(owner, minlength=n) for _, owner in seen]
    for level, (names, owner) in enumerate(seen, 1):
        if level in (FINE, COARSE):
            use = np.ones(n, bool)
        elif level < FINE:
            above = counts[level] if level < len(counts) else np.zeros(n, int)
            use = above < FEW
        else:
            continue
        chosen = use[owner]
        h = mix64(names[chosen] + np.uint64(level * int(_M1) % (1 << 64)))
        value = np.minimum(h >> np.uint64(48), np.uint64(0xFFFE)).astype(np.uint16)
        np.minimum.at(out.reshape(-1), owner[chosen] * BINS + (h % np.uint64(BINS)).astype(np.int64), value)
    return out


def in_blocks(texts: list[str], chars: int = 1_000_000) -> np.ndarray:
    parts, block, size = [np.zeros((0, BINS), np.uint16)], [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= chars:
            parts.append(sketches(block))
            block, size = [], 0
    if block:
        parts.append(sketches(block))
    return np.concatenate(parts)


def to_text(sketch: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sketch]


def from_text(prints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(prints)), ">u2").reshape(-1, BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    filled = (a != 0xFFFF) | (b != 0xFFFF)
    return np.where(filled.any(axis=1), ((a == b) & filled).sum(axis=1) / np.maximum(filled.sum(axis=1), 1), 1.0)


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint column (hex), one pass."""
    ship_package(docs.sparkSession)
    at, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches):
        for batch in batches:
            prints = to_text(in_blocks([t or "" for t in batch.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(prints, pa.string())], [*batch.schema.names, out])

    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{inner}, `{out}` string")


def in_falling_order(docs: DataFrame, ranges: int) -> DataFrame:
    """docs: doc_id (long), text. Rows (r, ahead, doc_id, text), sorted inside partitions: those of a range in falling
    doc_id, then (ahead = 1) the first row of the range that follows; the first range follows the last."""
    least = -(1 << 63)
    steps = [i / ranges for i in range(1, ranges)] + [1.0]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, 10 * ranges), F.max("doc_id")).head()
    heads = sorted({*(bounds[0] or []), least if bounds[1] is None else bounds[1]})  # a range: from one head down to the next
    # which range: first the block of heads by their last ones, then inside it, so a row looks at 2 sqrt(ranges) heads
    size = max(1, int(len(heads) ** 0.5))
    blocks = [heads[i : i + size] for i in range(0, len(heads), size)]
    lasts, nested = F.lit(np.array([b[-1] for b in blocks], np.int64)), F.array(*[F.lit(np.array(b, np.int64)) for b in blocks])
    rows = docs.withColumn("at", F.coalesce("doc_id", F.lit(least)))
    block = F.size(F.filter(lasts, lambda h: h < F.col("at")))  # there is one: the last head is the greatest id
    own = F.element_at(nested, block + 1)
    k = F.lit(len(heads) - 1) - (block * size + F.size(F.filter(own, lambda h: h < F.col("at"))))
    before = F.when(k > 0, k - 1).otherwise(F.lit(len(heads) - 1))
    place = lambda r, ahead: F.struct(r.alias("r"), F.lit(ahead).alias("ahead"))
    places = F.when(F.array_contains(own, F.col("at")), F.array(place(k, 0), place(before, 1))).otherwise(F.array(place(k, 0)))
    placed = rows.withColumn("place", F.explode(places)).select("place.r", "place.ahead", "at", "doc_id", "text")
    return placed.repartition("r").sortWithinPartitions("r", "ahead", F.col("at").desc(), F.xxhash64("text")).select("r", "ahead", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each row's fingerprint and that of its edited text (last third replaced by the start of the next document)."""
    spark = docs.sparkSession
    ship_package(spark)
    if docs.schema[id_col].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise ValueError(f"{id_col} must be an integer")
    ranges = ranges or min(1 << 16, max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of the batch before, whose next row is still to come
        for batch in batches:
            rows = held + list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            prints = in_blocks([r[3] for r in rows[len(held) :]])
            prints = np.concatenate([last, prints]) if held else prints
            own = [i for i in range(len(rows) - 1) if not rows[i][1]]  # a row that is ahead has no row of its own after it
            edited = []
            for i in own:
                text = rows[i][3]
                third = len(text) // 3
                edited.append(text[: len(text) - third] + rows[i + 1][3][:third])
            changed, mine = in_blocks(edited), prints[own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][2] for i in own], pa.int64()),
                    pa.array([len(rows[i][3]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                    pa.array(to_text(mine), pa.string()),
                    pa.array(to_text(changed), pa.string()),
                    pa.array(likeness(mine, changed)),
                    pa.array(likeness(mine, prints[[i + 1 for i in own]])),
                ],
                names,
            )
            held, last = rows[-1:], prints[-1:]

    types = ("bigint", "bigint", "string", "string", "string", "double", "double")
    return in_falling_order(base, ranges).mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
