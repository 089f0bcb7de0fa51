"""Pairs of a real shingle similarity: the parts of a complete set-similarity join, put together in simhash.similar_documents().

Every text becomes the set of its word shingles (64-bit XXH3 each). Two sets of Jaccard similarity t
or more must share one of the first n - ceil(t n) + 1 shingles in any order that all sets agree on
(prefix filter), so candidates are the sets that meet under such a shingle, and none is missed. The
order is by how often a bounded sample of sets has the shingle, rare ones first, then by hash; the
sample changes the cost only.

A candidate pair is dropped early by sizes, by places, and by parity sketches (about a bit a shingle): they
differ in at most as many bits as the sets differ in shingles. Places: two sets share nothing before the
first shingle in the order that they share, so there a pair whose rests are too short is none, and at later
shingles it need not be found again. What is left is verified on the sets. At first
neighbours in a bucket only are tried, in two orders, so that most of a large group of near copies falls
together in proportion to its size; then every pair that is still in different components. Shingles of one passage
share their bucket: of buckets with the same nodes one is looked at.

Scale: equal sets collapse to one node; prefix rows are shuffled once, without texts, and those that
stand alone are dropped there. Sets are shuffled only for candidates, picked out by a bitmap of bounded size. A bucket of more than `block` rows is cut into cells as in simhash.link().

Defined cases: null text counts as empty; fewer words than a shingle: the whole sequence is one; none:
the empty set, equal to itself only. Null ids are returned with the smallest id of their component
(null if it has none). Repeated rows give repeated rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import released


def sketch(h: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles fall on it. 256 to 8192 bits; a half's width is the exclusive or of both halves."""
    bits = min(8192, max(256, 1 << max(len(h) - 1, 0).bit_length()))
    return np.packbits(np.bincount(h & (bits - 1), minlength=bits).astype(np.uint8) & 1).tobytes()


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half the hashes have, as a signed long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of `words` words, A-Z lowered, split at ASCII white space; a shorter text is one."""
    found = text.lower().split()
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined] if found else []
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def _sets(words: int, common=None):
    """(doc_id, bytes, key) to (doc_id, key, node, f0, size, first, sketch, shingles); node: a hash of the set; f0: its SimHash; first: not met before in the batch; shingles: in the common order, so that each prefix is a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        listed, times = ((), ()) if common is None else common.value
        for batch in batches:
            met: set[int] = set()
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, sketches, nodes, prints, first = [], [], [], [], []
                for t in part.column(1):
                    h = np.unique(np.array([digest(p) for p in shingles(t.as_py(), words)], np.uint64).view(np.int64))
                    sets.append(h)
                    nodes.append(digest(h.tobytes()))
                    sketches.append(sketch(h))
                    prints.append(majority(h))
                    first.append(nodes[-1] not in met)
                    met.add(nodes[-1])
                sizes = np.array([len(h) for h in sets], np.int32)
                offsets, flat = np.r_[0, np.cumsum(sizes)].astype(np.int32), np.concatenate(sets)
                if len(listed):
                    i = np.minimum(np.searchsorted(listed, flat), len(listed) - 1)
                    flat = flat[np.lexsort((flat, np.where(listed[i] == flat, times[i], 0), np.repeat(np.arange(len(sizes)), sizes)))]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(prints, np.int64)), pa.array(sizes), pa.array(first), pa.array(sketches, pa.binary()), lists],
                    ["doc_id", "key", "node", "f0", "size", "first", "sketch", "shingles"],
                )

    return run


def _shingled(rows: DataFrame, words: int, common=None) -> DataFrame:
    """The set of every row (doc_id, t, key)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(_sets(words, common)), f"doc_id {kind}, key binary, node bigint, f0 bigint, size int, first boolean, sketch binary, shingles array<bigint>")


def _common(rows: DataFrame, words: int, sample: int = 8000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample have, sorted, and how many have them."""
    m = max(1, rows.count() // sample)
    drawn = _shingled(rows.where(F.pmod(F.xxhash64("t"), F.lit(m)) == 0), words)
    counts = drawn.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = sorted((r["s"], r["n"]) for r in counts.orderBy(F.desc("n"), "s").limit(most).collect())
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def _prefixes(sets: DataFrame, similarity: Fraction) -> DataFrame:
    """token, node, place: each set's prefix of n - ceil(t n) + 1 shingles and their places in the set's order, from 0."""
    num, den = similarity.numerator, similarity.denominator
    length = F.expr(f"cast(size + 1 - (cast(size as bigint) * {num} + {den - 1}) div {den} as int)")
    return sets.where("first and size > 0").select(F.posexplode(F.slice("shingles", 1, length)).alias("place", "token"), "node").select("token", "node", "place")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, node, place) sorted by token and node: once each, without tokens of one node."""
    last, met = None, False  # the row before, and whether its token has another node

    def made(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy()), pa.array(rows[:, 2].astype(np.int32))], ["token", "node", "place"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if last is not None:
            rows = np.concatenate([last, rows])
        if not len(rows):
            continue
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
        same = rows[1:, 0] == rows[:-1, 0]
        keep = np.r_[met, same] | np.r_[same, False]
        last, met = rows[-1:], bool(keep[-1])
        if keep[:-1].any():
            yield made(rows[:-1][keep[:-1]])
    if last is not None and met:
        yield made(last)


def _pairs(similarity: Fraction, every: bool, small: int = 48):
    """Rows (token, cell, size, place, node, label, sketch) in order to pairs u < v of unlike labels that may be similar; not every: neighbours and the first."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            token, cell, size, place_of, node, label = (whole.column(i).to_numpy().astype(np.int64) for i in range(6))
            left = size - place_of  # the most that a set shares if this is the first shingle it shares
            texts = whole.column(6).to_pylist()
            width = np.fromiter(map(len, texts), np.int64, len(texts))
            place, of_width = np.zeros(len(texts), np.int64), {}
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                place[own] = np.arange(len(own))
                of_width[w] = np.frombuffer(b"".join(texts[i] for i in own.tolist()), np.uint64).reshape(len(own), -1)

            def sketches(i, w):
                out = np.empty((len(i), w // 8), np.uint64)
                for own in np.unique(width[i]).tolist():
                    k = np.flatnonzero(width[i] == own)
                    wide = of_width[own][place[i[k]]]
                    while wide.shape[1] > w // 8:
                        wide = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
                    out[k] = wide
                return out

            def likely(i, j):
                near = (label[i] != label[j]) & (np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num)
                near &= np.minimum(left[i], left[j]) * (num + den) >= (size[i] + size[j]) * num
                i, j = i[near], j[near]
                near, least = np.zeros(len(i), bool), np.minimum(width[i], width[j])
                for w in np.unique(least).tolist():
                    k = np.flatnonzero(least == w)
                    apart = np.bitwise_count(sketches(i[k], w) ^ sketches(j[k], w)).sum(axis=1, dtype=np.int64)
                    near[k] = apart * (num + den) <= (den - num) * (size[i[k]] + size[j[k]])
                i, j = i[near], j[near]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["u", "v"])

            starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])])
            sizes = np.diff(np.r_[starts, len(token)])
            size_of, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
            at = np.arange(len(token)) - first
            if not every:
                for d in range(1, 5):
                    i = np.flatnonzero(at >= d)
                    yield likely(i - d, i)
                i = np.flatnonzero(at > 0)
                yield likely(first[i], i)
                return
            for d in range(1, min(small, sizes.max())):
                i = np.flatnonzero((size_of <= small) & (at + d < size_of))
                yield likely(i, i + d)
            for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
                ends = s + np.searchsorted(size[s : s + n], size[s : s + n] * den // num, "right")  # sorted by size
                for i in range(s, s + n):
                    j = np.arange(i + 1, ends[i - s])
                    if len(j):
                        yield likely(np.full(len(j), i), j)

        for batch in batches:
            if not batch.num_rows:
                continue
            token, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.flatnonzero((token != token[-1]) | (cell != cell[-1]))
            last = int(ends[-1]) + 1 if len(ends) else 0
            if not last and held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) == (token[0], cell[0]):
                held.append(batch)
                continue
            if last or held:
                yield from found([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield from found(held)

    return run


def _candidates(shared: DataFrame, nodes: DataFrame, labels: DataFrame | None, similarity: Fraction, every: bool, block: int, mixed: bool = False) -> DataFrame:
    """u, v: pairs of different components that meet in a bucket and that sizes and sketches allow."""
    rows = shared.withColumn("label", F.col("node")) if labels is None else shared.join(labels, "node", "left").select("token", "node", "place", F.coalesce("root", "node").alias("label"))
    same = {f"x{k}": F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (0, 1)}
    buckets = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("place", "node").alias("at"), *[x.alias(k) for k, x in same.items()]).where("low <> high")
    # tokens of one passage mostly have the same nodes (128 bits of them agree): the first such bucket in the common order is enough
    buckets = buckets.groupBy("n", *same).agg(F.min_by("token", "at").alias("token")).select("token", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = rows.join(buckets, "token").join(nodes, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.transform(others, lambda b: F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own"))))
    dealt = cut.select("token", F.explode(cells).alias("cell"), "size", "place", "node", "label", "sketch")
    placed = dealt.repartition("token", "cell").sortWithinPartitions("token", "cell", F.xxhash64("node") if mixed else F.col("size"), "node")
    return placed.mapInArrow(released(_pairs(similarity, every)), "u bigint, v bigint").distinct()


def _perhaps(sets: DataFrame, needed: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """(node, shingles) of the needed nodes and few others, without a shuffle or Python: a bitmap of node hashes, bits / 64 rows at most, goes to all tasks."""
    place = F.pmod(F.xxhash64("node"), F.lit(bits))
    words = needed.select(place.alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
    marked = sets.select("node", "shingles", place.alias("p")).withColumn("w", F.expr("p div 64")).join(F.broadcast(words), "w")
    return marked.where("shiftright(b, cast(p % 64 as int)) & 1 = 1").select("node", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs whose sets have the similarity."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    own = _perhaps(sets.select("node", "shingles"), needed).join(needed, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b")).cast("bigint")
    counted = both.select("u", "v", shared.alias("both"), (F.size("a") + F.size("b")).cast("bigint").alias("total"))
    return counted.where(F.col("both") * similarity.denominator >= (F.col("total") - F.col("both")) * similarity.numerator).select("u", "v")
