"""The wavelet codec as an image-to-bytes map: one Arrow row an image, nothing shuffled.

The byte stream is 32-bit big-endian tag-value segments. Sections nest (channel, wavelet, subband)
and repeat the state that they need, so each can be decoded by itself; their segment and the one
before a subband's payload hold the size in segments, so a reader takes the subbands that a
resolution needs and steps over the rest. Sizes are made bottom-up: a section is built from its
finished parts.

Coefficients are coded by a prefix code. Its sizes are the format's (entropy.py), so streams are as
long as the format's; its words are the canonical ones of these sizes unless `words` gives others:
rows (size, bits, count, value) of a whole code, as read_codebook() reads them from a text file.
Streams made with one set of words are read with the same set.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.operators.bayer import CELLS, GAINS
from lumenframe.operators.entropy import END_BITS, MAGNITUDE_BITS, RUN_BITS
from lumenframe.operators.wavelet import PRESCALE, QUANTIZERS, SUBBANDS, midpoint

# The stream's start marker, its tags, and the chunks that sections and payloads begin with.
START = 0x56432D35
TAGS = {
    "channels": 12, "subbands": 14, "width": 20, "height": 21, "lowpass_precision": 35, "subband": 48, "quantization": 53, "channel": 62, "format": 84, "bits": 101, "max_bits": 102, "pattern_width": 106, "pattern_height": 107, "components": 108, "prescale": 109,
}
SECTIONS = {"subband": 0x2000, "wavelet": 0x2100, "channel": 0x2400, "header": 0x2500, "image": 0x2700}
PAYLOAD, IDENTIFIER, VENDOR = 0x6000, 0x4004, 0x4000
RESOLUTIONS = {"sixteenth": 1, "eighth": 4, "quarter": 7, "half": 10, "full": 10}
#: Codec state before the first segment.
DEFAULTS = {"channel": 0, "subband": 0, "quantization": 1, "lowpass_precision": 16}
Words = tuple[tuple[int, int, int, int], ...]


@lru_cache(maxsize=4)
def codebook(words: Words | None = None) -> Words:
    """(size, bits, count, value) of each code without sign bits: count 1 a magnitude (0: one zero), more a run of zeros, 0 the band's end. Canonical: by size, then zeros before values, in rising order."""
    if words is not None:
        return words
    rows, size = [(END_BITS, 0, 1)] + [(bits, n, 0) for n, bits in RUN_BITS.items()], 0
    for m in range(1, 256):
        size = MAGNITUDE_BITS.get(m, size)
        rows.append((size, 1, m))
    code, last, out = 0, 0, []
    for size, count, value in sorted(rows, key=lambda r: (r[0], r[1] == 0, r[2], r[1])):
        code <<= size - last
        out.append((size, code, count, value))
        code, last = code + 1, size
    return tuple(out)


def read_codebook(lines: Iterator[str]) -> Words:
    """A code from lines `size bits count value` (bits in any Python notation); checked to be prefix-free, complete and whole."""
    rows = tuple(tuple(int(x, 0) for x in line.replace(",", " ").split()[:4]) for line in lines if line.strip())
    names = sorted(f"{bits:0{size}b}" for size, bits, _, _ in rows)
    if any(b.startswith(a) for a, b in zip(names, names[1:])) or sum(2.0**-size for size, *_ in rows) != 1:
        raise ValueError("not a complete prefix code")
    if {v for _, _, count, v in rows if count == 1} != set(range(256)) or not any(count == 0 for _, _, count, _ in rows):
        raise ValueError("a code needs the magnitudes 0 to 255 and a band end")
    return rows


@lru_cache(maxsize=4)
def _encoder(words: Words | None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], tuple[int, int]]:
    """Sizes and bits of magnitudes, runs (count, size, bits) longest first, and the band's end."""
    sizes, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    runs, end = [], (0, 0)
    for size, code, count, value in codebook(words):
        if count == 1:
            sizes[value], bits[value] = size, code
        if count and value == 0:
            runs.append((count, size, code))
        if not count:
            end = (size, code)
    return sizes, bits, sorted(runs, reverse=True), end


FIRST = 13  # bits of the decoder's first table


@lru_cache(maxsize=4)
def _decoder(words: Words | None) -> tuple[list, dict, int]:
    """A table by the next FIRST bits: (bits used, zeros, value; value -1: the band's end), None where the code is longer; then a dictionary by (size, bits); the longest size.

    Entries of single zeros take as many as stand there.
    """
    table: list = [None] * (1 << FIRST)
    longer, longest = {}, 0
    for size, code, count, value in codebook(words):
        entry = (size, count if value == 0 and count else 0, value if count else -1)
        longest = max(longest, size)
        if size <= FIRST:
            for k in range(1 << (FIRST - size)):
                table[code << (FIRST - size) | k] = entry
        else:
            longer[size, code] = entry
    single = next((size, code) for size, code, count, value in codebook(words) if count == 1 and value == 0)
    if single == (1, 0):
        for i in range(1 << (FIRST - 1)):
            n = FIRST - i.bit_length()
            table[i] = (n, n, 0)
    return table, longer, longest


def encode_band(v: np.ndarray, words: Words | None = None) -> bytes:
    """Companded coefficients (-255..255) in reading order to bytes, padded to 32 bits."""
    v = v.ravel()
    sizes, codes, runs, end = _encoder(words)
    at = np.flatnonzero(v)
    left = np.diff(np.r_[-1, at, len(v)]) - 1
    ends = len(left)
    out_size: list[np.ndarray] = []
    out_code: list[np.ndarray] = []
    out_place: list[np.ndarray] = []
    for k, (n, size, code) in enumerate(runs):
        times, left = left // n, left % n
        many = int(times.sum())
        out_size.append(np.full(many, size))
        out_code.append(np.full(many, code))
        out_place.append(np.repeat(np.arange(ends) * 16 + k, times))
    m = np.abs(v[at])
    out_size.append(sizes[m] + 1)
    out_code.append(codes[m] << 1 | (v[at] < 0))
    out_place.append(np.arange(len(at)) * 16 + 15)
    order = np.argsort(np.concatenate(out_place), kind="stable")
    size = np.r_[np.concatenate(out_size)[order], end[0]]
    code = np.r_[np.concatenate(out_code)[order], end[1]]
    owner = np.repeat(np.arange(len(size)), size)
    shift = size[owner] - 1 - (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size))
    data = np.packbits((code[owner] >> shift & 1).astype(np.uint8)).tobytes()
    return data + bytes(-len(data) % 4)


def decode_band(data: bytes, count: int, words: Words | None = None) -> np.ndarray:
    """The inverse of encode_band, a table look-up a code; a code is never looked for bit by bit."""
    table, longer, longest = _decoder(words)
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    wide = np.zeros(len(data) + 1, np.uint64)  # the 40 bits from each byte on
    for k in range(5):
        wide |= padded[k : k + len(wide)] << np.uint64(32 - 8 * k)
    wide, places, values, n, p, last = wide.tolist(), [], [], 0, 0, 8 * len(data)
    while p < last:
        window = wide[p >> 3] >> (40 - FIRST - (p & 7)) & ((1 << FIRST) - 1)
        entry = table[window]
        if entry is None:
            at, off = wide[p >> 3], p & 7
            for size in range(FIRST + 1, longest + 1):
                entry = longer.get((size, at >> (40 - size - off) & ((1 << size) - 1)))
                if entry:
                    break
            else:
                raise ValueError("no code here")
        used, zeros, value = entry
        p += used
        if value > 0:
            places.append(n)
            values.append(-value if wide[p >> 3] >> (39 - (p & 7)) & 1 else value)
            n += 1
            p += 1
        elif value < 0:
            break
        else:
            n += zeros
    if value >= 0 or n > count:
        raise ValueError("a band without its end, or longer than its size")
    out = np.zeros(count, np.int64)
    out[places] = values
    return out


def segment(tag: int, value: int) -> bytes:
    return struct.pack(">HH", tag & 0xFFFF, value & 0xFFFF)


def chunk(tag: int, content: bytes) -> bytes:
    """An optional segment with the size of what follows, and that; large chunks carry eight more bits of size in the tag."""
    n = len(content) // 4
    return segment(-(tag | (n >> 16 & 0xFF)) if tag & 0x2000 else -tag, n) + content


def planes_of(samples: np.ndarray, cell: str = "rggb") -> list[np.ndarray]:
    """Bayer samples (12 bit) to the four planes."""
    encode, _ = arrays.log_tables()
    x = encode[samples[: samples.shape[0] // 2 * 2, : samples.shape[1] // 2 * 2]]
    r, g1, g2, b = (x[CELLS[cell][k][0] :: 2, CELLS[cell][k][1] :: 2] for k in ("r", "g1", "g2", "b"))
    gs = (g1 + g2) >> 1
    half = lambda d: np.clip((d + 2 * arrays.MIDPOINT) >> 1, 0, 4095)
    return [gs, half(r - gs), half(b - gs), half(g1 - g2)]


def samples_of(planes: list[np.ndarray], cell: str = "rggb", bits: int = 12) -> np.ndarray:
    _, decode = arrays.log_tables()
    gs, (rg, bg, gd) = planes[0], (p - arrays.MIDPOINT for p in planes[1:])
    out = np.empty((2 * gs.shape[0], 2 * gs.shape[1]), np.int64)
    for k, level in {"r": 2 * rg + gs, "b": 2 * bg + gs, "g1": gs + gd, "g2": gs - gd}.items():
        out[CELLS[cell][k][0] :: 2, CELLS[cell][k][1] :: 2] = decode[np.clip(level, 0, 4095)] >> (16 - bits)
    return out


def header_bytes(width: int, height: int, identifier: bytes = b"") -> bytes:
    """Start marker, header and extension: sizes, a 2x2 pattern of single components, prescales, and an identifier chunk if given."""
    values = {"channels": 4, "width": width, "height": height, "format": 4, "pattern_width": 2, "pattern_height": 2, "components": 1, "max_bits": 12, "prescale": prescale_word()}
    out = struct.pack(">I", START) + b"".join(segment(TAGS[k], v) for k, v in values.items())
    return out + (chunk(IDENTIFIER, identifier + bytes(-len(identifier) % 4)) if identifier else b"")


def prescale_word(shifts: tuple[int, ...] = PRESCALE) -> int:
    """Two bits a level, the first level in the highest."""
    return sum(p << (14 - 2 * i) for i, p in enumerate(shifts))


def coded_bands(plane: np.ndarray, quality: str, words: Words | None = None) -> list[tuple[int, int, bytes]]:
    """(subband, quantizer, payload) of a plane's ten subbands."""
    quant, compand, bands = QUANTIZERS[quality], arrays.compand_table(), {}
    for level in range(3):
        found = arrays.forward_2d(plane, PRESCALE[level])
        bands |= {(level, b): x for b, x in enumerate(found)}
        plane = found[0]
    out = []
    for s, place in enumerate(SUBBANDS):
        v, q = bands[place], quant[s]
        if s == 0:
            data = v.astype(">u2").tobytes()
            out.append((s, q, data + bytes(-len(data) % 4)))
            continue
        level = np.sign(v) * (((np.abs(v) + midpoint(q)) * (65536 // q)) >> 16)
        out.append((s, q, encode_band(np.sign(level) * compand[np.minimum(1023, np.abs(level))], words)))
    return out


def encode_image(samples: np.ndarray, cell: str = "rggb", quality: str = "fs1", words: Words | None = None) -> bytes:
    state, out = dict(DEFAULTS), [header_bytes(samples.shape[1], samples.shape[0])]
    out.append(chunk(VENDOR, cell.encode()))  # the mosaic, for readers of a bare stream

    def repeated(*names: str) -> bytes:
        return b"".join(segment(TAGS[n], prescale_word() if n == "prescale" else state[n]) for n in names)

    for channel, plane in enumerate(planes_of(samples, cell)):
        state |= {"channel": channel, "subband": 0}
        head = repeated("channel", "subband", "lowpass_precision", "quantization", "prescale")
        wavelets: list[bytes] = []
        bands = coded_bands(plane, quality, words)
        for level in (2, 1, 0):
            mine = [x for x in bands if SUBBANDS[x[0]][0] == level]
            state["subband"] = mine[0][0]
            before, parts = repeated("channel", "subband", "lowpass_precision"), []
            for s, q, data in mine:
                state["subband"] = s
                known = repeated("channel", "subband", "lowpass_precision", "quantization")
                inner = b"" if q == state["quantization"] or s == 0 else segment(TAGS["quantization"], q)
                state["quantization"] = q if s else state["quantization"]
                parts.append(known + chunk(SECTIONS["subband"], inner + chunk(PAYLOAD, data)))
                state["subband"] = s + 1
            wavelets.append(before + chunk(SECTIONS["wavelet"], b"".join(parts)))
        out.append(head + chunk(SECTIONS["channel"], b"".join(wavelets)))
    return b"".join(out)


def segments(data: bytes) -> Iterator[tuple[int, int, int, bool, bytes]]:
    """(position, tag, value, optional, payload) of each segment, sections entered; a payload is sliced, never decoded, here."""
    if len(data) < 4 or struct.unpack_from(">I", data)[0] != START:
        raise ValueError("not a coded image: no start marker")
    at = 4
    while at + 4 <= len(data):
        tag, value = struct.unpack_from(">hH", data, at)
        optional, tag = tag < 0, abs(tag)
        at += 4
        if tag & 0x4000:
            n = ((tag & 0xFF) << 16 | value) * 4 if tag & 0x2000 else value * 4
            if at + n > len(data):
                raise ValueError("a chunk goes beyond the stream")
            yield at // 4 - 1, tag, value, optional, data[at : at + n]
            at += n
        else:
            yield at // 4 - 1, tag, value, optional, b""


#: Header segments that must stand before the first channel, once each.
REQUIRED = ("channels", "width", "height", "prescale")


def decode_planes(data: bytes, resolution: str = "full", words: Words | None = None) -> tuple[list[np.ndarray], dict]:
    """The planes at a resolution: lowpass planes (14 bit) or, for half and full, whole planes (12 bit). Bands beyond the resolution are stepped over."""
    limit, head, state, bands = RESOLUTIONS[resolution], {}, dict(DEFAULTS) | {"cell": "rggb"}, {}
    names = {v: k for k, v in TAGS.items()}
    for _, tag, value, _, payload in segments(data):
        if tag in names:
            name = names[tag]
            if name in ("channels", "width", "height") and name in state:
                raise ValueError(f"{name} is given twice")
            state[name] = value
        elif tag == VENDOR:
            state["cell"] = payload.rstrip(b"\0").decode()
        elif tag & 0xFF00 == PAYLOAD:
            if not head:
                if missing := [n for n in REQUIRED if n not in state]:
                    raise ValueError(f"the header lacks {missing}")
                head = dict(state)
            if state["subband"] >= limit:
                continue
            c, s, q = state["channel"], state["subband"], state["quantization"]
            h, w = head["height"] // 2, head["width"] // 2
            for _ in range(SUBBANDS[s][0] + 1):
                h, w = -(-h // 2), -(-w // 2)
            if s == 0:
                bands[c, 0] = np.frombuffer(payload, ">u2")[: h * w].astype(np.int64).reshape(h, w)
            else:
                bands[c, s] = np.clip(arrays.uncompand(decode_band(payload, h * w, words)) * q, -32768, 32767).reshape(h, w)
    planes = []
    for c in range(head["channels"] if head else 0):
        low = bands[c, 0]
        for level in (2, 1, 0)[: {1: 0, 4: 1, 7: 2, 10: 3}[limit]]:
            h, w = head["height"] // 2, head["width"] // 2
            for _ in range(level):
                h, w = -(-h // 2), -(-w // 2)
            low = arrays.inverse_2d([low, *(bands[c, s] for s, (at, b) in enumerate(SUBBANDS) if at == level and b)], (h, w), PRESCALE[level] == 2)
        planes.append(np.clip(low, 0, 4095) if limit == 10 else low)
    return planes, state | head


def decode_image(data: bytes, bits: int = 12, words: Words | None = None) -> np.ndarray:
    planes, head = decode_planes(data, words=words)
    return samples_of(planes, head["cell"], bits)


def preview_image(data: bytes, resolution: str, bits: int = 8, gains: tuple = GAINS, words: Words | None = None) -> np.ndarray:
    """(height, width, 3) at a reduced resolution, mirrored like the format's previews."""
    planes, _ = decode_planes(data, resolution, words)
    _, decode = arrays.log_tables()
    precision = 12 if resolution == "half" else 14
    g, rg, bg = planes[:3]
    middle = 1 << (precision - 1)
    rgb = [decode[np.clip(x >> (precision - 12), 0, 4095)] for x in (2 * (rg - middle) + g, g, 2 * (bg - middle) + g)]
    if bits == 8:
        rgb = [np.minimum(255, np.sqrt(((x * n) >> d).astype(np.float32)).astype(np.int64)) for x, (n, d) in zip(rgb, gains, strict=True)]
    return np.stack(rgb, axis=-1)[:, ::-1]


def ppm(rgb: np.ndarray, bits: int = 8) -> bytes:
    head = f"P6\n{rgb.shape[1]} {rgb.shape[0]}\n{(1 << bits) - 1}\n".encode()
    return head + rgb.astype(np.uint8 if bits == 8 else ">u2").tobytes()


def _mapped(images: DataFrame, column: str, out: str, f) -> DataFrame:
    """images with one binary column replaced by f of the row; other columns pass through."""
    names = images.columns
    kept = [c for c in names if c != column]
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in images.schema.fields if x.name != column)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = pa.array([f(r) for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), made], [*kept, out])

    return images.mapInArrow(run, f"{fields}, `{out}` binary" if kept else f"`{out}` binary")


def encode(images: DataFrame, quality: str = "fs1", words: Words | None = None) -> DataFrame:
    """images: width, height, pixel_format (rggb12, rggb14, gbrg12, rggb12p, gbrg12p) and raw bytes; raw becomes vc5."""

    def one(r):
        if r["raw"] is None:
            return None
        kind = r["pixel_format"]
        x = arrays.unpack_bits(r["raw"]) if kind.endswith("p") else np.frombuffer(r["raw"], "<u2").astype(np.int64)
        x = x.reshape(r["height"], r["width"])
        return encode_image(x >> 2 if "14" in kind else x, kind[:4], quality, words)

    return _mapped(images, "raw", "vc5", one)


def decode(images: DataFrame, bits: int = 12, words: Words | None = None) -> DataFrame:
    """vc5 back to little-endian 16-bit raw samples."""
    return _mapped(images, "vc5", "raw", lambda r: None if r["vc5"] is None else decode_image(r["vc5"], bits, words).astype("<u2").tobytes())


def render(images: DataFrame, resolution: str, bits: int = 8, gains: tuple = GAINS, words: Words | None = None) -> DataFrame:
    """vc5 to PPM bytes at half, quarter, eighth or sixteenth; only the subbands needed are decoded."""
    if resolution not in ("half", "quarter", "eighth", "sixteenth"):
        raise ValueError(f"no {resolution} preview: half, quarter, eighth or sixteenth")
    return _mapped(images, "vc5", "ppm", lambda r: None if r["vc5"] is None else ppm(preview_image(r["vc5"], resolution, bits, gains, words), bits))


def segment_rows(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(image_id, pos, tag, value, optional, payload_bytes) of every segment."""
    rows = images.select(F.col(id_col).cast("bigint").alias("image_id"), "vc5").where("vc5 is not null")

    def run(batches):
        for batch in batches:
            found = [(i, *s[:4], len(s[4])) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for s in segments(data)]
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["image_id", "pos", "tag", "value", "optional", "payload_bytes"])

    return rows.mapInArrow(run, "image_id bigint, pos bigint, tag int, value int, optional boolean, payload_bytes bigint")


#: What turns one kind of image into another: the columns that a conversion reads and makes.
CONVERSIONS = {
    ("RAW", "VC5"): encode, ("VC5", "RAW"): decode,
    **{("VC5", f"PPM-{k}"): (lambda df, k=k, **how: render(df, k, **how)) for k in ("half", "quarter", "eighth", "sixteenth")},
    ("VC5", "SEGMENTS"): segment_rows,
}


def convert(images: DataFrame, source: str, target: str, **how) -> DataFrame:
    """The conversion from one kind to another; unknown pairs are an error."""
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}; there are {sorted(CONVERSIONS)}")
    return CONVERSIONS[source, target](images, **how)
