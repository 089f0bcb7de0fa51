"""TIFF-based containers as tag relations: one row a directory entry, values typed and side by side."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF field types as (code, bytes a value, struct format).
TYPES = {"byte": (1, 1, "B"), "ascii": (2, 1, "B"), "short": (3, 2, "H"), "long": (4, 4, "I"), "rational": (5, 8, "II"), "sbyte": (6, 1, "b"), "undefined": (7, 1, "B"), "sshort": (8, 2, "h"), "ifd": (13, 4, "I"), "slong": (9, 4, "i"), "srational": (10, 8, "ii"), "float": (11, 4, "f"), "double": (12, 8, "d")}
_BY_CODE = {code: (name, size, form) for name, (code, size, form) in TYPES.items()}
#: Tags whose values are offsets of further directories.
BELOW = (330, 34665, 34853)
SCHEMA = "ifd int, parent int, tag int, type string, count bigint, ints array<bigint>, reals array<double>, rationals array<struct<num:bigint,den:bigint>>, text string, raw binary"


def directories(data: bytes, longest: int = 1 << 16) -> Iterator[tuple]:
    """Rows as in SCHEMA, depth-first; a value list beyond `longest` entries comes as its bytes alone (raw, else null), in the file's byte order."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return
    e = "<" if data[:2] == b"II" else ">"
    waiting, seen, number = [(struct.unpack_from(e + "I", data, 4)[0], -1)], set(), 0
    while waiting:
        at, parent = waiting.pop(0)
        if not at or at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        mine, number = number, number + 1
        entries = struct.unpack_from(e + "H", data, at)[0]
        if at + 2 + 12 * entries + 4 > len(data):
            continue
        for k in range(entries):
            tag, code, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
            if code not in _BY_CODE:
                continue
            name, size, form = _BY_CODE[code]
            place = at + 2 + 12 * k + 8
            if size * count > 4:
                place = struct.unpack_from(e + "I", data, place)[0]
            ints = reals = rationals = text = raw = None
            if place + size * count <= len(data) and count > longest:
                raw = bytes(data[place : place + size * count])
            elif place + size * count <= len(data):
                values = struct.unpack_from(e + form * count, data, place)
                if name == "ascii":
                    text = bytes(values).split(b"\0")[0].decode("utf-8", "replace")
                elif "rational" in name:
                    rationals = [{"num": a, "den": b} for a, b in zip(values[::2], values[1::2], strict=True)]
                elif name in ("float", "double"):
                    reals = list(map(float, values))
                else:
                    ints = list(values)
                    if tag in BELOW:
                        waiting.extend((v, mine) for v in values)
            yield mine, parent, tag, name, count, ints, reals, rationals, text, raw
        waiting.insert(0, (struct.unpack_from(e + "I", data, at + 2 + 12 * entries)[0], parent))


def tags_of(files: DataFrame) -> DataFrame:
    """(path, ...SCHEMA) of a binaryFile scan; files that aren't such containers give no rows."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.struct([("num", pa.int64()), ("den", pa.int64())])), pa.string(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.replace("num:bigint,den:bigint", "").split(", ")]

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(directories(data.as_py() or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["path", *names])

    return files.select("path", "content").mapInArrow(run, "path string, " + SCHEMA)


def file_tags(spark: SparkSession, path: str) -> DataFrame:
    return tags_of(spark.read.format("binaryFile").load(path))


def metadata(tags: DataFrame) -> DataFrame:
    """One row a file with the commonly wanted fields; pixels are never touched."""
    pick = lambda tag, what: F.max(F.when(F.col("tag") == tag, F.col(what)))
    first = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("ints")[0]))
    rational = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("rationals")[0]["num"] / F.nullif(F.col("rationals")[0]["den"], F.lit(0))))
    return tags.groupBy("path").agg(
        first(256).alias("width"), first(257).alias("height"), F.max(F.when(F.col("tag") == 259, F.col("ints")[0])).alias("compression"), pick(271, "text").alias("make"), pick(272, "text").alias("model"),
        rational(33434).alias("exposure_time"), rational(33437).alias("f_number"), first(34855).alias("iso"), pick(36867, "text").alias("taken"),
    )


def tiff_bytes(ifds: list[dict[int, tuple[str, object]]]) -> bytes:
    """A little-endian container of chained directories: tag -> (type, values)."""
    out, links = bytearray(b"II*\0\0\0\0\0"), 4
    for ifd in ifds:
        extra, entries = bytearray(), []
        base = len(out) + len(out) % 2
        out += b"\0" * (base - len(out))
        struct.pack_into("<I", out, links, base)
        after = base + 2 + 12 * len(ifd) + 4
        for tag, (name, values) in sorted(ifd.items()):
            code, size, form = TYPES[name]
            if name == "ascii":
                values = list(values.encode() + b"\0")
            flat = [x for v in values for x in (v if isinstance(v, tuple) else (v,))]
            raw = struct.pack("<" + form * len(values), *flat)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, code, len(values), after + len(extra)))
                extra += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0"))
        out += struct.pack("<H", len(ifd)) + b"".join(entries)
        links = len(out)
        out += b"\0\0\0\0" + extra
    return bytes(out)
