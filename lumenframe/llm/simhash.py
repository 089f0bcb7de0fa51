"""SimHash near-duplicates by the general pigeonhole principle.

fingerprints() hashes word shingles with XXH64 and takes each bit's majority. link() finds every
pair of different fingerprints that differ in at most `radius` bits: bits are grouped into
partitions of correlated bits, each partition gets a threshold of its own (-1: not probed) by
dynamic programming on estimated candidate counts, and the thresholds sum to radius - parts + 1,
so that a pair within the radius must meet in one partition at least. Every fingerprint is stored
under its partition value and probed under all values within the threshold; whatever meets is
verified on all bits. Bit counts and co-occurrences are taken over all fingerprints; they
choose the plan only, every plan finds the same links.

similar_documents() is for links of a given shingle similarity (0.8 on five words in the pipeline).
The same probe finds candidates first - most near copies - and each is verified on its shingles.
Texts of 0.8 may differ in more bits than a sure plan can afford, so what the fingerprints leave in
different components then goes through a complete join of the shingle sets (similar.py).

Scale: equal fingerprints collapse first (map-side combine), so copies cost one row. A bucket of
more than `block` rows is cut into blocks by hash and handled in pairs of blocks, one task cell
each: no task holds an unbounded bucket and no pair is emitted - a cell returns a spanning
forest of its links. Components are found on tables (components.py).

Defined cases: null text counts as empty; fewer words than a shingle: the whole sequence is one;
none: fingerprint zero, linked like any other. Null ids are returned with the smallest id of their
component (null if it has none). Repeated rows give repeated rows. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import discard, materialize, released, ship_package, text_or_empty
from lumenframe.llm.components import connected
from lumenframe.llm.similar import _candidates, _common, _prefixes, _shared, _shingled, _verified, shingles

SEED = 42


def _hashes(pieces: list[bytes], bits: int) -> np.ndarray:
    """pieces by bits / 64, unsigned. 64 bits: XXH64; more: XXH3 of 128 bits for each further seed."""
    if bits == 64:
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces)).reshape(-1, 1)
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(p, SEED + i) for p in pieces for i in range(bits // 128)), "<u8").reshape(-1, bits // 64)


def fingerprint(text: bytes, words: int = 4, bits: int = 64) -> np.ndarray:
    """bits / 64 unsigned longs of the UTF-8 text: A-Z lowered, split at ASCII white space, each bit by majority."""
    pieces = shingles(text, words)
    if not pieces:
        return np.zeros(bits // 64, np.uint64)
    h, counts = _hashes(pieces, bits), np.zeros(bits, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")


def names(bits: int) -> list[str]:
    return [f"f{i}" for i in range(bits // 64)]


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and f0, f1, ... (64 bits each, as signed longs), one row per row of docs."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, bits) for t in batch.column(1)], np.uint64).reshape(-1, bits // 64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, i].copy()) for i in range(bits // 64))], ["doc_id", *names(bits)])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{f} bigint" for f in names(bits)))


def bit_counts(fps: DataFrame, bits: int = 64) -> tuple[int, np.ndarray]:
    """Rows, and how often bits i and j are both set: sums over all fingerprints, one row a bit to the driver."""
    ship_package(fps.sparkSession)

    def run(batches):
        n, both = 0, np.zeros((bits, bits))
        for batch in batches:
            h = np.stack([c.to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns], axis=1)
            for i in range(0, len(h), 8192):
                b = np.unpackbits(np.ascontiguousarray(h[i : i + 8192]).view(np.uint8), axis=1, bitorder="little").astype(np.float64)
                both += b.T @ b
            n += len(h)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(bits)), pa.array([n] * bits), pa.array(both.astype(np.int64).tolist())], ["i", "n", "row"])

    parts = fps.select(*names(bits)).mapInArrow(run, "i bigint, n bigint, row array<bigint>")
    summed = parts.select("i", "n", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    both, n = np.zeros((bits, bits)), 0
    for r in summed.groupBy("i").agg(F.max("n").alias("n"), F.collect_list(F.struct("j", "c")).alias("row")).collect():
        n = r["n"]
        for j, c in r["row"]:
            both[r["i"], j] = c
    return n, both


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each starts at the bit most correlated to what is left and takes its closest."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, parts = list(range(len(both))), []
    for k in range(m):
        size = (len(left) + (m - k) - 1) // (m - k)
        first = max(left, key=lambda i: (corr[i, left].sum() - corr[i, i], -i))
        part = [first]
        left.remove(first)
        while len(part) < size:
            best = max(left, key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def thresholds(n: int, both: np.ndarray, parts: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Least cost and the thresholds, at least -1 each, that sum to radius - parts + 1."""
    p = np.diag(both) / max(n, 1)
    costs = []
    for part in parts:
        chance = np.array([1.0])
        for i in part:
            differ = 2 * p[i] * (1 - p[i])
            chance = np.convolve(chance, [1 - differ, differ])
        costs.append([0.0] + [n * 300.0 * sum(comb(len(part), k) for k in range(t + 1)) + n * n / 2 * chance[: t + 1].sum() for t in range(min(3, len(part)))])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, extra in enumerate(cost, -1):
                if total + t not in step or c + extra < step[total + t][0]:
                    step[total + t] = (c + extra, [*chosen, t])
        best = step
    return best.get(radius - len(parts) + 1, (float("inf"), []))


def probe_plan(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], list[list[int]]]]:
    """(bits, flips) for each probed partition of the cheapest plan; flips[0] is empty, where the fingerprint is stored."""
    plans = []
    for m in range(2, 9):
        parts = correlated_parts(n, both, m)
        plans.append((*thresholds(n, both, parts, radius), parts))
    _, chosen, parts = min(plans, key=lambda x: x[0])
    return [(part, [list(flip) for k in range(t + 1) for flip in combinations(part, k)]) for part, t in zip(parts, chosen, strict=True) if t >= 0]


def _mask(bits: list[int], word: int) -> int:
    return _signed(sum(1 << (i % 64) for i in bits if i // 64 == word))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16) <= radius


def _root(labels: np.ndarray) -> np.ndarray:
    while True:
        upper = labels[labels]
        if (upper == labels).all():
            return labels
        labels = upper


def _forest(group: np.ndarray, fp: np.ndarray, stored: np.ndarray, radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group, stored ones first. Spanning edges of the links inside groups, as positions."""
    n = len(fp)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    size_of = np.repeat(sizes, sizes)
    at = np.arange(n) - np.repeat(starts, sizes)
    us, vs = [], []
    for d in range(1, min(small, sizes.max())):
        i = np.flatnonzero((size_of <= small) & (at + d < size_of) & stored)
        i = i[_near(fp[i], fp[i + d], radius)]
        us.append(i)
        vs.append(i + d)
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        while len(u):
            a, b = labels[u], labels[v]
            keep = a != b
            u, v, a, b = u[keep], v[keep], a[keep], b[keep]
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
            labels = _root(labels)
    for s, size in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        own, f, k = np.arange(size), fp[s : s + size], int(stored[s : s + size].sum())
        for i in range(0, k, 64):
            hits = _near(f[i : min(k, i + 64), None], f[None, i:], radius)
            for j in np.flatnonzero(hits.sum(axis=1) > 1).tolist():
                met = np.unique(own[i:][hits[j]])
                if len(met) > 1:
                    own[np.isin(own, met)] = met[0]
        labels[s : s + size] = own + s
    moved = np.flatnonzero(labels != np.arange(n))
    return moved, labels[moved]


def _cells(radius: int):
    """Links inside each run of equal (g, key, cell) rows; runs are short, see link()."""

    def run(batches):
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            group = np.r_[0, np.cumsum(change)]
            moved, to = _forest(group, np.ascontiguousarray(rows[:, 5:]).view(np.uint64), rows[:, 3] == 0, radius)
            keep = rows[moved, 4] != rows[to, 4]
            return pa.RecordBatch.from_arrays([pa.array(rows[moved[keep], 4]), pa.array(rows[to[keep], 4])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if held and np.array_equal(held[0][0, :3], rows[-1, :3]):
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            last = int(np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))[-1] + 1) if np.any(rows[0, :3] != rows[-1, :3]) else 0
            held = [rows[last:]]
            if last:
                yield edges(rows[:last])
        if held:
            yield edges(np.concatenate(held))

    return run


def link(nodes: DataFrame, plan: list[tuple[list[int], list[list[int]]]], radius: int, bits: int = 64, block: int = 4096) -> DataFrame:
    """nodes: node (long) and its fingerprint. u, v: edges that join exactly the nodes reachable by links of <= radius bits that a probe brings together."""
    ship_package(nodes.sparkSession)
    fs = names(bits)

    def key(part: list[int], flip: list[int]):
        words = sorted({i // 64 for i in part})
        at = [F.col(fs[w]).bitwiseAND(F.lit(_mask(part, w)).cast("bigint")).bitwiseXOR(F.lit(_mask(flip, w)).cast("bigint")) for w in words]
        return at[0] if len(at) == 1 else F.xxhash64(*at)

    probes = F.array(*[F.struct(F.lit(g).alias("g"), key(part, flip).alias("key"), F.lit(int(bool(flip))).alias("probe")) for g, (part, flips) in enumerate(plan) for flip in flips])
    rows = nodes.select("node", *fs, F.explode(probes).alias("p")).select("p.g", "p.key", "p.probe", "node", *fs)
    sizes = rows.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("least")).where("n > 1 and least = 0")
    cut = rows.join(sizes, ["g", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.when(b != F.col("own"), F.least(b, F.col("own")) * F.col("blocks") + F.greatest(b, F.col("own")))),
            lambda c: c.isNotNull(),
        )
    )
    dealt = cut.withColumn("own", own).select("g", "key", F.explode(cells).alias("cell"), "probe", "node", *fs)
    placed = dealt.repartition("g", "key", "cell").sortWithinPartitions("g", "key", "cell", "probe", "node")
    return placed.mapInArrow(_cells(radius), "u bigint, v bigint")


def _components(seen: DataFrame, plan, radius: int, bits: int) -> DataFrame:
    """seen: doc_id and fingerprints. Each distinct fingerprint with the smallest doc_id of its component."""
    fs = names(bits)
    node = F.col(fs[0]) if len(fs) == 1 else F.xxhash64(*fs)
    nodes = materialize(seen.groupBy(*fs).agg(F.min("doc_id").alias("least")).withColumn("node", node), "nodes")
    n, both = bit_counts(nodes, bits)
    roots = connected(link(nodes.select("node", *fs), plan(n, both), radius, bits))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(whole, "root").select(*fs, "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for every row of docs."""
    seen = materialize(fingerprints(docs, words, 64, id_col, text_col), "fingerprints")
    named = _components(seen, lambda n, both: probe_plan(n, both, radius), radius, 64)
    return seen.join(named, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text_col: str = "text"):
    """16 bytes that tell the texts of one id apart."""
    return F.unhex(F.md5(text_or_empty(text_col).cast("binary")))


def _probed(sets: DataFrame, radius: int) -> DataFrame:
    """u, v: candidates by fingerprints. Sets of one fingerprint with the least of them, and those within the radius of each other."""
    nodes = materialize(sets.select("node", "f0").distinct(), "prints")
    least = materialize(nodes.groupBy("f0").agg(F.min("node").alias("least")), "print-nodes")
    equal = nodes.join(least, "f0").where("node <> least").select(F.least("node", "least").alias("u"), F.greatest("node", "least").alias("v"))
    n, both = bit_counts(least)
    near = link(least.select(F.col("least").alias("node"), "f0"), probe_plan(n, both, radius), radius)
    return equal.unionByName(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """For every row doc_id, key (text_key), component_id (the smallest doc_id reachable by links of at least `similarity`, Jaccard over word shingles) and kept: the first of its component by id (null last), then key."""
    spark, t = docs.sparkSession, Fraction(str(similarity))
    ship_package(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t"), text_key(text_col).alias("key"))
    common = spark.sparkContext.broadcast(_common(rows, words))
    sets = materialize(_shingled(rows, words, common), "shingles")
    common.destroy()
    found: list[DataFrame] = []

    def joined(candidates: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        pairs = materialize(candidates, "candidates")
        links = None if pairs.isEmpty() else materialize(_verified(pairs, sets, t), "links")
        discard(pairs)
        if links is None or links.isEmpty():
            return labels
        found.append(links)
        return connected(reduce(DataFrame.unionByName, found))

    labels = joined(_probed(sets, radius), None)
    prefixes = _prefixes(sets, t).repartition("token").sortWithinPartitions("token", "node")
    shared = materialize(prefixes.mapInArrow(released(_shared), "token bigint, node bigint, place int"), "buckets")
    met = shared.select("node").distinct()
    nodes = materialize(sets.select("node", "size", "sketch").join(met, "node", "left_semi").dropDuplicates(["node"]), "sketches")
    for every, mixed in ((False, False), (False, True), (True, False)):
        labels = joined(_candidates(shared, nodes, labels, t, every, block, mixed), labels)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    seen = sets.select("doc_id", "key", F.col("node").alias("root"))
    if labels is not None:
        seen = sets.select("doc_id", "key", "node").join(labels, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    whole = seen.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(place).alias("first"))
    done = materialize(seen.join(whole, "root").select("doc_id", "key", "component_id", place.eqNullSafe(F.col("first")).alias("kept")), "similar")
    discard(sets, shared, nodes, *found)
    return done
