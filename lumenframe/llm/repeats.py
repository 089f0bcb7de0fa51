"""Suffix-array deduplication: every byte covered by a `length`-byte string that also starts earlier goes.

Suffix arrays over all bytes of all shards would send every suffix across the network, so shards
are built only where a repeat is possible, which loses none:

1. Anchors. Every window of `length` bytes picks its least 32-byte gram (by hash, the leftmost).
   Equal windows pick the same gram at the same place, so a repeat shows as a repeated gram.
   Successive windows share their pick; about one anchor per 34 bytes stands for all of them,
   with the stretch of text that they cover.
2. Grams are brought together (hash, document, place - no text). A gram seen once can't repeat.
   Where whole stretches are equal, all but the first are repeats throughout: equal means the same
   64 bits of the gram and the same 128 bits (XXH3) of the stretch, beside which a chance
   agreement over 10**12 anchors is below 10**-14. Within an Arrow batch this is settled before
   the shuffle and touching spans unite, so a passage in a third of all documents, or a periodic
   text, sends a few rows per batch.
3. Only for grams with different stretches are texts needed: the first of each different stretch
   is cut out of its document and sent to the gram's shard. A shard (about `shard_bytes`) gets a
   suffix array by Larsson-Sadakane refinement in numpy: ranks by the first eight bytes, doubled
   for the groups that are not yet single. Kasai's common prefixes (by its rule that a prefix
   shrinks by one from a place to the next, unless the byte before differs) give the windows
   that share `length` bytes; the earliest stays. A gram whose stretches fill several shards is
   merged across them by binary search in the sorted windows seen before.
4. The stretches to remove go to their documents; overlaps unite.

Hot grams. Grams that are frequent in a bounded sample of documents are dealt by gram and stretch instead of by gram, so no task takes all their rows; such
grams, and any with over `hot_bytes` of different stretches, are cut at the picks of two further
gram orders, and the three picks together name the shard. If a shard's seen windows still pass
`hot_bytes`, the rest of that key goes on as single windows, each dealt by its own hash. Every
route finds the same bytes; the sample and the limits change the cost only.

Memory. Texts are worked on in pieces of about `chunk` bytes and shards of `shard_bytes`, whatever
the length of a document; an Arrow batch and its longest text are what a worker must hold.

"Earlier" is by (doc_id, start); strings are judged on the input. Documents are shuffled once (the
cut of step 3 and the removal of step 4 share the exchange), anchors once.

Defined cases: null text counts as empty. Rows with the same id and text are one document: each is
reported alike and none is a repeat of the other. Rows with the same id but other texts are ordered
by the texts' SHA-256; null ids come first. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lumenframe.llm.common import ship_package, text_or_empty
from lumenframe.llm.parsing import mix64

GRAM = 32
_LOW = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15


def _byte_table(order: int = 0) -> np.ndarray:
    return mix64(np.arange(1 + 256 * order, 257 + 256 * order, dtype=np.uint64) * np.uint64(_ODD))


def gram_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    h, step = table[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(_ODD, step, 1 << 64)) + h[step:]
        step *= 2
    return mix64(h)


def anchors(data: np.ndarray, lengths: np.ndarray, length: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: documents' bytes joined (under 2**24). Hash of the picked grams (one a table), begin and end (in data) of each stretch of windows that pick the same."""
    n, span = len(data), length - GRAM + 1
    nothing = np.zeros(0, np.int64)
    if n < length:
        return nothing.astype(np.uint64), nothing, nothing
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    p = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
    if not len(p):
        return nothing.astype(np.uint64), nothing, nothing
    new = np.r_[True, p[1:] != p[:-1] + 1]
    picks = []
    for table in tables:
        h = gram_hashes(data, table)
        least, step = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1
        while step * 2 <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        a = (least[p] & _LOW).astype(np.int32)
        new[1:] |= a[1:] != a[:-1]
        picks.append((h, a))
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(p)] - 1
    h, a = picks[0]
    key = h[a[at]]
    for h, a in picks[1:]:
        key = mix64(key * np.uint64(_ODD) + h[a[at]])
    return key, p[at], p[last] + length


def _pieces(size: int, length: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a document that hold each window once."""
    for start in range(0, max(1, size - length + 1), most):
        yield start, min(size, start + most + length - 1)


def _united(ords: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in any order to maximal runs by (ord, begin): those that overlap or touch unite."""
    if not len(ords):
        return ords, begin, size
    by = np.lexsort((begin, ords))
    ords, begin, end = ords[by], begin[by], (begin + size)[by]
    head = np.r_[True, ords[1:] != ords[:-1]]
    base = (np.cumsum(head) - 1) * (int(end.max()) + 2)  # keeps the running maximum inside a document
    reach = np.maximum.accumulate(end + base)
    new = head | np.r_[True, (begin + base)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return ords[at], begin[at], (reach - base)[np.r_[at[1:], len(ords)] - 1] - begin[at]


ANCHOR = ["kind", "key", "s1", "s2", "ord", "span"]


def _anchor_rows(length: int, hot=None, chunk: int = 1 << 19, held_bytes: int = 1 << 23):
    """Batches of (ord, bytes) to anchors. kind 1: known to be a repeat; 2: of a hot gram, dealt by gram and stretch; 0: of another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, digest = [_byte_table()], xxhash.xxh3_128_digest
        frequent = hot.value if hot is not None else np.zeros(0, np.int64)
        found: list[tuple] = []
        held: list[tuple[int, int, bytes]] = []
        size = total = 0

        def close() -> None:
            nonlocal size
            joined = b"".join(x[2] for x in held)
            lengths = np.array([len(x[2]) for x in held])
            keys, begin, end = anchors(np.frombuffer(joined, np.uint8), lengths, length, tables)
            stretch = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
            starts = np.cumsum(lengths) - lengths
            of = np.searchsorted(starts, begin, "right") - 1
            found.append((keys.view(np.int64), stretch[:, 0], stretch[:, 1], np.array([x[0] for x in held], np.int64)[of], begin - starts[of] + np.array([x[1] for x in held], np.int64)[of], end - begin))
            held.clear()
            size = 0

        def rows() -> pa.RecordBatch:
            nonlocal total
            key, s1, s2, ident, begin, n = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            total = 0
            order = np.lexsort((begin, ident, s2, s1, key))
            key, s1, s2, ident, begin, n = (x[order] for x in (key, s1, s2, ident, begin, n))
            again = np.r_[False, (key[1:] == key[:-1]) & (s1[1:] == s1[:-1]) & (s2[1:] == s2[:-1])]
            own, spans = packed(*_united(ident[again], begin[again], n[again]))
            key, s1, s2, ident, begin, n = (x[~again] for x in (key, s1, s2, ident, begin, n))
            i = np.minimum(np.searchsorted(frequent, key), max(len(frequent) - 1, 0))
            often = frequent[i] == key if len(frequent) else np.zeros(len(key), bool)
            dealt = np.where(often, mix64(key.view(np.uint64) * np.uint64(_ODD) ^ s1.view(np.uint64)).view(np.int64), key)
            zero, more = np.zeros(len(own), np.int64), len(own)
            dealt_own = mix64(own.view(np.uint64) * np.uint64(_ODD) + spans.view(np.uint64)).view(np.int64)
            columns = (np.r_[often.astype(np.int8) * 2, np.ones(more, np.int8)], np.r_[dealt, dealt_own], np.r_[s1, zero], np.r_[s2, zero], np.r_[ident, own], np.r_[(begin << 16) | n, spans])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ANCHOR)

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer()
                if data.size < length:
                    continue
                for a, b in _pieces(data.size, length, chunk):
                    held.append((ident, a, data.slice(a, b - a).to_pybytes()))
                    size += b - a
                    total += b - a
                    if size >= chunk:
                        close()
                    if total >= held_bytes:
                        if held:
                            close()
                        yield rows()
        if held:
            close()
        if found:
            yield rows()

    return run


def frequent_grams(texts: DataFrame, length: int, sample: int = 20_000, every: int = 64, least: int = 64, most: int = 20_000) -> np.ndarray:
    """Grams that `least` or more stretches of a sample pick (one document in `every`, about `sample` at most), the most frequent first to go in; sorted."""
    m = max(every, texts.count() // sample)
    part = texts.where(F.pmod(F.xxhash64("ord"), F.lit(m)) == 0)
    rows = part.mapInArrow(_anchor_rows(length), ANCHOR_SCHEMA).where("kind = 0")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {least}").orderBy(F.desc("n"), "key").limit(most)
    return np.array(sorted(r["key"] for r in counts.collect()), np.int64)


ANCHOR_SCHEMA = "kind tinyint, key bigint, s1 bigint, s2 bigint, ord bigint, span bigint"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key, s1, s2, ord, span). Gives kind 1: repeats; 0: first stretches of grams with several; 2: first stretches of hot grams."""
    before = None  # kind, key, s1, s2 of the row before
    waiting = None  # the first row of the gram in hand, until a second stretch shows up

    def made(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), *(pa.array(rows[:, i].copy()) for i in (1, 4, 5))], ["kind", "key", "ord", "span"])

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        known = rows[:, 0] == 1
        if known.any():
            yield made(1, rows[known])
            rows = rows[~known]
        if not len(rows):
            continue
        names = rows[:, :4]
        above = np.concatenate([before if before is not None else names[:1] - 1, names[:-1]])
        same_key = (names[:, :2] == above[:, :2]).all(axis=1)
        same = same_key & (names[:, 2:] == above[:, 2:]).all(axis=1)
        before = names[-1:].copy()
        if same.any():
            yield made(1, rows[same])
        often = ~same & (rows[:, 0] == 2)
        if often.any():
            yield made(2, rows[often])
        plain = ~same & (rows[:, 0] == 0)
        firsts = rows[plain]
        if len(firsts):
            key_again = same_key[plain]  # a further stretch of the gram before it
            need = key_again.copy()
            need[:-1] |= key_again[1:]
            need_rows = firsts[need]
            if waiting is not None and key_again[0]:
                need_rows = np.concatenate([waiting, need_rows])
            waiting = None if need[-1] else firsts[-1:]
            if len(need_rows):
                yield made(0, need_rows)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: suffixes in order, and each one's rank (int32: under 2**31 bytes). Only groups that are not single are refined."""
    n = len(data)
    wide = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | wide[i : i + n]
    if n and data.min() > 0:
        order = np.argsort(first).astype(np.int32)
        new = np.r_[True, first[order[1:]] != first[order[:-1]]]
    else:
        short = np.minimum(n - np.arange(n), 8)  # a suffix that ends comes before one that goes on with zeros
        order = np.lexsort((short, first)).astype(np.int32)
        new = np.r_[True, (first[order[1:]] != first[order[:-1]]) | (short[order[1:]] != short[order[:-1]])] if n else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    del first, wide
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    step = 8
    while True:
        open_at = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in groups of more than one
        if not len(open_at):
            return order, rank
        s = order[open_at]
        after = s.astype(np.int64) + step
        key = rank[s].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        s, key = s[by], key[by]
        order[open_at] = s
        first_of = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        heads = open_at[first_of]
        rank[s] = np.repeat(heads, np.diff(np.r_[first_of, len(s)]))
        new[heads] = True
        step *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix of order[i] and order[i - 1] (0 for the first).

    By text place a prefix is at least the one before less one, and exactly that unless the bytes
    before the two suffixes differ; so only those places are compared, all at once.
    """
    n = len(order)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    place = np.arange(n, dtype=np.int32)
    fresh = (place == 0) | (before <= 0)
    inner = ~fresh
    fresh[inner] = data[place[inner] - 1] != data[before[inner] - 1]
    fresh[1:] |= before[:-1] < 0
    at = np.flatnonzero(fresh)
    size = np.zeros(len(at), np.int64)
    alive = np.flatnonzero(before[at] >= 0)
    while len(alive):
        a, b = at[alive] + size[alive], before[at[alive]].astype(np.int64) + size[alive]
        inside = (a < n) & (b < n)
        alive, a, b = alive[inside], a[inside], b[inside]
        equal = data[a] == data[b]
        alive = alive[equal]
        size[alive] += 1
    lengths = np.repeat(size, np.diff(np.r_[at, n])) - (place - np.repeat(at, np.diff(np.r_[at, n])))
    out = lengths[order]
    out[:1] = 0
    return np.maximum(out, 0)


class Shard:
    """Stretches of one or more grams: finds windows that also stand elsewhere, the earliest apart."""

    def __init__(self, length: int):
        self.length = length
        self.seen = np.zeros(0, f"S{length + 1}")
        self.seen_ord = self.seen_at = np.zeros(0, np.int64)

    def forget(self) -> None:
        self.__init__(self.length)

    def repeats(self, ords: np.ndarray, begins: np.ndarray, texts: list[bytes], remember: bool) -> tuple[np.ndarray, np.ndarray]:
        """Document and place of each repeated window. remember: the gram goes on in the next shard."""
        length, sizes = self.length, np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        order, _ = suffix_array(data)
        shared = common_prefixes(data, order)
        starts = np.cumsum(sizes) - sizes
        of = np.searchsorted(starts, order, "right") - 1
        window = order - starts[of] + length <= sizes[of]
        group = np.cumsum(shared < length)[window]
        where, of = order[window].astype(np.int64), of[window]
        del order, shared, window
        ident, at = ords[of], begins[of] + where - starts[of]
        by = np.lexsort((at, ident, group))
        group, ident, at, where = group[by], ident[by], at[by], where[by]
        head = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        out = [(ident[~head], at[~head])]
        if remember or len(self.seen):
            at_head = where[head]
            text = np.empty((len(at_head), length + 1), np.uint8)
            text[:, :length] = data[at_head[:, None] + np.arange(length)]
            text[:, length] = 1  # numpy drops trailing zeros
            text = np.ascontiguousarray(text).view(f"S{length + 1}").ravel()
            h_ord, h_at = ident[head], at[head]
            i = np.searchsorted(self.seen, text)  # both sorted
            i_in = np.minimum(i, max(len(self.seen) - 1, 0))
            met = (self.seen[i_in] == text) if len(self.seen) else np.zeros(len(text), bool)
            j = i_in[met]
            older = (self.seen_ord[j] < h_ord[met]) | ((self.seen_ord[j] == h_ord[met]) & (self.seen_at[j] < h_at[met]))
            out.append((np.where(older, h_ord[met], self.seen_ord[j]), np.where(older, h_at[met], self.seen_at[j])))
            self.seen_ord[j], self.seen_at[j] = np.where(older, self.seen_ord[j], h_ord[met]), np.where(older, self.seen_at[j], h_at[met])
            text, h_ord, h_at = (np.concatenate(x) for x in ((self.seen, text[~met]), (self.seen_ord, h_ord[~met]), (self.seen_at, h_at[~met])))
            by = np.argsort(text, kind="stable")
            self.seen, self.seen_ord, self.seen_at = text[by], h_ord[by], h_at[by]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _shards(length: int, shard_bytes: int, hot_bytes: int):
    """Batches of (key, ord, begin, bytes) sorted by key to (key, ord, span, t): spans of repeats (t null; the key deals them), and windows that a key leaves to be dealt anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(length)
        keys: list[int] = []
        rows: list[tuple[int, int, bytes]] = []
        size, last_key, passed = 0, None, False  # passed: the key in hand goes on as windows

        def spans(ords: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            ords, packs = packed(*_united(ords, at, np.full(len(at), length, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(mix64(ords.astype(np.uint64)).view(np.int64)), pa.array(ords), pa.array(packs), pa.nulls(len(ords), pa.binary())], ["key", "ord", "span", "t"])

        def windows(ords: list[int], at: list[int], texts: list[bytes]) -> pa.RecordBatch:
            own = pa.array(np.array([xxhash.xxh64_intdigest(w, 1) for w in texts], np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([own, pa.array(ords, pa.int64()), pa.array([(a << 16) | length for a in at], pa.int64()), pa.array(texts, pa.binary())], ["key", "ord", "span", "t"])

        def close(count: int, remember: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size, passed
            part = rows[:count]
            if passed:
                for ident, begin, text in part:
                    n = len(text) - length + 1
                    yield windows([ident] * n, [begin + i for i in range(n)], [text[i : i + length] for i in range(n)])
            else:
                ords, at = shard.repeats(np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.int64), [r[2] for r in part], remember)
                yield spans(ords, at)
            del rows[:count], keys[:count]
            size = sum(len(r[2]) for r in rows)
            if not remember:
                shard.forget()
                passed = False
            elif len(shard.seen) > 1 and len(shard.seen) * length > hot_bytes and not passed:
                for i in range(0, len(shard.seen), 4096):
                    yield windows(shard.seen_ord[i : i + 4096].tolist(), shard.seen_at[i : i + 4096].tolist(), [w[:length] for w in shard.seen[i : i + 4096].tolist()])
                shard.forget()
                passed = True

        for batch in batches:
            for key, ident, begin, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if keys and size >= shard_bytes:
                    cut = next((i for i in range(len(keys) - 1, -1, -1) if keys[i] != key), -1) + 1
                    yield from close(cut or len(keys), not cut)
                if key != last_key and (passed or shard.seen.size):
                    if keys:
                        yield from close(len(keys), False)
                    shard.forget()
                    passed = False
                keys.append(key)
                rows.append((ident, begin, text))
                size += len(text)
                last_key = key
        if rows:
            yield from close(len(rows), False)

    return run


def _rest(length: int, shard_bytes: int, hot_bytes: int):
    """What _shards gave, sorted by (key, ord, span), to (ord, span): spans pass, windows dealt anew are searched."""
    search = _shards(length, shard_bytes, hot_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []

        def windows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left = batch.column(3).is_valid()
                done.append(batch.filter(batch.column(3).is_null()).select(["ord", "span"]))
                rows = batch.filter(left)
                begin = rows.column(2).to_numpy() >> 16
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(begin), rows.column(3)], ["key", "ord", "begin", "t"])

        for found in search(windows()):
            yield found.select(["ord", "span"])
            while done:
                yield done.pop()
        yield from done

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """ord (long, in the order of documents), doc_id, t (bytes); whether several rows may have one ord."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("t"))
    simple = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    if simple and rows.agg((F.count("doc_id") == F.count(F.lit(1))).alias("all")).head()[0] and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("ord"), "doc_id", "t"), False
    rows = rows.withColumn("s", F.sha2("t", 256))
    named = rows.select("doc_id", "s").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "s")
    schema = StructType([*named.schema.fields, StructField("ord", LongType())])
    order = docs.sparkSession.createDataFrame(named.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])), schema)
    order = order.select(F.col("doc_id").alias("d"), F.col("s").alias("z"), "ord")
    return rows.join(order, rows["doc_id"].eqNullSafe(order["d"]) & (rows["s"] == order["z"])).select("ord", "doc_id", "t"), True


def _cut(length: int, most: int = 1 << 21):
    """(ord, bytes, needed stretches) to (key, ord, begin, bytes); those of hot grams cut and keyed by three picks."""

    def run(batches):
        tables = [_byte_table(i) for i in range(3)]

        def made(keys, ords, begins, texts):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ords, pa.int64()), pa.array(begins, pa.int64()), pa.array(texts, pa.binary())], ["key", "ord", "begin", "t"])

        for batch in batches:
            keys, ords, begins, texts, size = [], [], [], [], 0
            for ident, text, needs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, needs = text.as_buffer(), needs.values
                spans = needs.field("span").to_numpy(zero_copy_only=False)
                for key, at, n, hot in zip(needs.field("key").to_pylist(), (spans >> 16).tolist(), (spans & 0xFFFF).tolist(), needs.field("hot").to_pylist(), strict=True):
                    piece = data.slice(at, n).to_pybytes()
                    if hot:
                        own, a, b = anchors(np.frombuffer(piece, np.uint8), np.array([n]), length, tables)
                        keys.extend(own.view(np.int64).tolist())
                        begins.extend((a + at).tolist())
                        texts.extend(piece[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True))
                        ords.extend([ident] * len(a))
                        size += int((b - a).sum())
                    else:
                        keys.append(key)
                        ords.append(ident)
                        begins.append(at)
                        texts.append(piece)
                        size += n
                    if size >= most:
                        yield made(keys, ords, begins, texts)
                        keys, ords, begins, texts, size = [], [], [], [], 0
            if keys:
                yield made(keys, ords, begins, texts)

    return run


def packed(ords: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 65535) -> tuple[np.ndarray, np.ndarray]:
    """Runs as packed spans (begin << 16 | size); a longer run is several that touch, which merged() unites."""
    parts = -(-size // most)
    of = np.repeat(np.arange(len(size)), parts)
    done = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * most
    return ords[of], ((begin[of] + done) << 16) | np.minimum(size[of] - done, most)


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Packed spans (begin << 16 | size) to maximal runs (begin, end)."""
    if not len(spans):
        return []
    s = np.sort(spans)
    begin, end = s >> 16, np.maximum.accumulate((s >> 16) + (s & 0xFFFF))
    new = np.r_[True, begin[1:] > end[:-1]]
    at = np.flatnonzero(new)
    return list(zip(begin[at].tolist(), end[np.r_[at[1:], len(s)] - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = 100, shard_bytes: int = 1 << 18, hot_bytes: int = 1 << 22, id_col: str = "doc_id", text_col: str = "text", **frequent) -> DataFrame:
    """doc_id, n_bytes, spans (array of begin, end in bytes: the maximal removed runs), kept (bytes)."""
    if not GRAM < length <= 32_000:
        raise ValueError(f"length must be over {GRAM} and at most 32000")
    spark = docs.sparkSession
    ship_package(spark)
    rows, once = _numbered(docs, id_col, text_col)
    texts = rows.select("ord", "t")
    if once:
        texts = texts.dropDuplicates(["ord"])
    hot = spark.sparkContext.broadcast(frequent_grams(texts, length, **frequent))
    found = texts.mapInArrow(_anchor_rows(length, hot), ANCHOR_SCHEMA)
    settled = (
        found.repartition("key").sortWithinPartitions("kind", "key", "s1", "s2", "ord", "span")
        .mapInArrow(_settle, "kind tinyint, key bigint, ord bigint, span bigint")
    )
    needs = settled.where("kind <> 1")
    size = F.col("span").bitwiseAND(F.lit(0xFFFF))
    hot_keys = needs.where("kind = 0").groupBy("key").agg(F.sum(size).alias("n")).where(f"n > {hot_bytes}").select("key", F.lit(True).alias("hot"))
    marked = needs.join(hot_keys, "key", "left").select("ord", F.struct("key", "span", (F.coalesce("hot", F.lit(False)) | (F.col("kind") == 2)).alias("hot")).alias("need"))
    needs = marked.groupBy("ord").agg(F.collect_list("need").alias("needs"))
    by_doc = rows.repartition("ord")
    # doc_id goes along, so that both joins want the same columns and share the exchange of the texts
    cuts = by_doc.join(needs, "ord").select("ord", "t", "needs", "doc_id")
    if once:
        cuts = cuts.dropDuplicates(["ord"])
    pieces = cuts.mapInArrow(_cut(length), "key bigint, ord bigint, begin bigint, t binary")
    partial = pieces.repartition("key").sortWithinPartitions("key", "ord", "begin").mapInArrow(_shards(length, shard_bytes, hot_bytes), "key bigint, ord bigint, span bigint, t binary")
    # spans take the same way as the windows that hot keys leave: each part of the plan is used once
    one_key = partial.repartition("key").sortWithinPartitions("key", "ord", "span").mapInArrow(_rest(length, shard_bytes, hot_bytes), "ord bigint, span bigint")
    spans = settled.where("kind = 1").select("ord", "span").unionByName(one_key).groupBy("ord").agg(F.collect_set("span").alias("spans"))
    whole = by_doc.join(spans, "ord", "left").select("doc_id", "t", "spans")
    kind = whole.schema["doc_id"].dataType.simpleString()

    def run(batches):
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

        def made(first, sizes, out, kept):
            return pa.RecordBatch.from_arrays([first, pa.array(sizes, pa.int64()), pa.array(out, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

        for batch in batches:
            sizes, out, kept, begun, size = [], [], [], 0, 0
            for i, (text, packs) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                data = text.as_buffer()
                runs = merged(packs.values.to_numpy() if packs.is_valid else np.zeros(0, np.int64))
                edges = [0, *(x for r in runs for x in r), data.size]
                sizes.append(data.size)
                out.append([{"begin": a, "end": b} for a, b in runs])
                kept.append(b"".join(data.slice(a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True)))
                size += data.size
                if size >= 1 << 22:
                    yield made(batch.column(0).slice(begun, i + 1 - begun), sizes, out, kept)
                    sizes, out, kept, begun, size = [], [], [], i + 1, 0
            if sizes:
                yield made(batch.column(0).slice(begun), sizes, out, kept)

    return whole.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")
