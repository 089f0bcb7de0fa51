"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

Each task tokenises its documents and packs them as it goes: full sequences are cut off long
documents; what is left is cut into pieces of at most `grain` tokens, gathered into blocks of
about `block` sequences and dealt into k = ceil(tokens / capacity) windows. Differencing keeps a
heap of partial partitions (one sum per window, largest first) by spread, and merges the two of
largest spread with opposing order, so that imbalances cancel. If a window still exceeds the
capacity, k rises by one and the block is dealt anew. Pieces inside a window keep document order.

No shuffle: a task holds one block of ids and one Arrow batch, whatever the table's size, and a
lost task is redone with the same result. sequence_id is the task's number in its upper bits and
a counter below them.

Defined cases: a null or empty text is the end-of-document id alone. Ids may be null or repeated;
each row is a document. Very long texts are packed whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import released, ship_package
from lumenframe.llm.tokens import document_ids

CAPACITY = 1024


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of the sizes in each of k windows, near-equal in sum. Windows may come out empty."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            keep_a, keep_b = len(a) - over, len(b) - over
            merged = a[:keep_a] + b[:keep_b] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[keep_a:], reversed(b[keep_b:]), strict=True)]
        merged.sort(key=lambda x: -x[0])
        number += 1
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), number, merged))
    windows = []
    for _, tree in heap[0][2] if heap else []:
        found, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                found.append(x)
        windows.append(sorted(found))
    return windows


def windows_within(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows, of those that differencing finds, with no sum above the capacity."""
    k = -(-sum(sizes) // capacity) if sizes else 0
    while k:
        found = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        k += 1
    return []


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = 256, block: int = 128, ranks_file: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def close() -> None:
            nonlocal sequence, held
            for window in windows_within([len(p[2]) for p in waiting], capacity):
                offset = 0
                for i in window:
                    doc, start, ids, total = waiting[i]
                    out.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
                    offset += len(ids)
                sequence += 1
            waiting.clear()
            held = 0

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = document_ids(text.as_py(), ranks_file)
                total = len(ids)
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, ids[start : start + capacity].tobytes(), total, sequence, 0))
                    sequence += 1
                for start in range(whole, total, grain):
                    waiting.append((doc, start, ids[start : start + grain].copy(), total))
                held += total - whole
                if held >= block * capacity:
                    close()
                if len(out) >= 4096:
                    yield taken()
        close()
        if out:
            yield taken()

    kind_name = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind_name}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
