"""Packed token-id matrices by best-fit decreasing.

A block of documents is packed at a time: a document longer than a row is split, without loss,
into full rows and a rest; rests are placed in falling length, each into the fullest row that
still holds it. Rows are found by a segment tree over free capacities (0..width): a node knows
whether some open row has a free capacity below it, so the least sufficient one is found in
log(width) steps. A block becomes one row of the output: the id matrix (unsigned 16-bit, row
after row, unused places 0), the cumulative lengths of its segments, where each row's segments
begin in that list, and the position of every token in its segment (positions restart at each
segment). write() stores blocks as Parquet; read_segments() gives the documents back.

No shuffle; a task holds one block. Defined cases: a null or empty text is the end-of-document id
alone; very long texts are split, never cut; ids may be null or repeated; an empty table gives no
blocks; other columns are ignored. A vocabulary beyond 16 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import ship_package
from lumenframe.llm.tokens import document_ids, encoder

SCHEMA = "block_id bigint, n_rows bigint, width bigint, n_tokens bigint, ids binary, segment_docs array<{id}>, segment_starts array<bigint>, cu_seqlens binary, row_segments binary, positions binary"


class CapacityTree:
    """Open rows by free capacity; take(n) gives one with the least free capacity of at least n."""

    def __init__(self, width: int):
        self.base = 1 << width.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        i = free + self.base
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        i = need + self.base
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.base
        while i:
            self.count[i] -= 1
            i >>= 1
        return free, self.rows[free].pop()


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Positions of the sizes (each at most width) in each row, in the order of placing."""
    tree, rows = CapacityTree(width), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        if found is None:
            found = (width, len(rows))
            rows.append([])
        free, row = found
        rows[row].append(i)
        tree.put(free - sizes[i], row)
    return rows


def matrices(docs: DataFrame, width: int = 2048, block_tokens: int = 1 << 20, ranks_file: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per block, see SCHEMA. segment_docs and segment_starts: each segment's document and its first token there."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def packed(block: int, pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        placed = best_fit_decreasing([len(p[2]) for p in pieces], width)
        ids = np.zeros((len(placed), width), "<u2")
        positions = np.zeros((len(placed), width), "<u2")
        order, lengths, firsts = [], [], [0]
        for r, row in enumerate(placed):
            at = 0
            for i in row:
                n = len(pieces[i][2])
                ids[r, at : at + n] = pieces[i][2]
                positions[r, at : at + n] = np.arange(n)
                at += n
                order.append(i)
                lengths.append(n)
            firsts.append(len(order))
        cu = np.r_[0, np.cumsum(lengths)].astype("<i8")
        values = [block, len(placed), width, int(cu[-1]), ids.tobytes(), [pieces[i][0] for i in order], [pieces[i][1] for i in order], cu.tobytes(), np.array(firsts, "<i8").tobytes(), positions.tobytes()]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(kind), pa.list_(pa.int64())] + [pa.binary()] * 3
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encoder(ranks_file).n_vocab > 1 << 16:
            raise ValueError(f"{ranks_file} has ids beyond 16 bits")
        block, pieces, held = TaskContext.get().partitionId() << 32, [], 0
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = document_ids(text.as_py(), ranks_file)
                for start in range(0, len(ids), width):
                    pieces.append((doc, start, ids[start : start + width].astype("<u2")))
                    held += len(pieces[-1][2])
                    if held >= block_tokens:
                        yield packed(block, pieces, kind)
                        block, pieces, held = block + 1, [], 0
        if pieces:
            yield packed(block, pieces, kind)

    return rows.mapInArrow(run, schema)


def write(blocks: DataFrame, path: str) -> None:
    blocks.write.parquet(path)


def read_segments(blocks: DataFrame) -> DataFrame:
    """doc_id, start, ids (array) of every segment, cut out of the matrices again."""
    ship_package(blocks.sparkSession)
    kind = blocks.schema["segment_docs"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids = np.frombuffer(b["ids"], "<u2").reshape(b["n_rows"], b["width"])
                cu, firsts = np.frombuffer(b["cu_seqlens"], "<i8"), np.frombuffer(b["row_segments"], "<i8")
                cut = []
                for r in range(b["n_rows"]):
                    at = 0
                    for s in range(firsts[r], firsts[r + 1]):
                        n = int(cu[s + 1] - cu[s])
                        cut.append(ids[r, at : at + n].astype(np.int32).tolist())
                        at += n
                docs = pa.array(b["segment_docs"], batch.schema.field("segment_docs").type.value_type)
                yield pa.RecordBatch.from_arrays([docs, pa.array(b["segment_starts"], pa.int64()), pa.array(cut, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, f"doc_id {kind}, start bigint, ids array<int>")
