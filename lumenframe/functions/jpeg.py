"""Baseline JPEG over numpy arrays: 8 bits, one or three components without subsampling, Huffman tables made for each image.

A writer and a reader; the reader takes any baseline stream, subsampled ones and restart markers too.
"""

from __future__ import annotations

import re
import struct
from collections import Counter

import numpy as np

from lumenframe.functions.lossless_jpeg import _codes, code_lengths

# The standard's quantizers of luminance and chrominance at quality 50, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99) + (99,) * 32


def zigzag() -> np.ndarray:
    """Places of a row-major 8x8 block in the order of the diagonals, every other one backwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def cosines() -> np.ndarray:
    k, x = np.mgrid[:8, :8]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)


def quantizers(quality: int) -> list[np.ndarray]:
    """Tables of luminance and chrominance, 1 (coarse) to 100 (all ones)."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def _size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1]


def encode(rgb: np.ndarray, quality: int = 90) -> bytes:
    """(rows, columns, 3) RGB or (rows, columns) grey, unsigned 8 bits."""
    grey = rgb.ndim == 2
    x = rgb.astype(np.float64)
    if grey:
        planes = [x - 128]
    else:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    h, w = x.shape[:2]
    tables, order, basis, coded = quantizers(quality), zigzag(), cosines(), []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        coded.append(np.rint(basis @ blocks @ basis.T / tables[min(i, 1)].reshape(8, 8)).astype(np.int64).reshape(-1, 64)[:, order])
    comps = len(coded)
    z = np.stack(coded, axis=1)  # block, component, coefficient
    n = z.shape[0] * comps
    dc = np.diff(z[:, :, 0], axis=0, prepend=0).reshape(-1)
    flat, chroma = z.reshape(n, 64), np.tile(np.arange(comps) > 0, z.shape[0])
    block, at = np.nonzero(flat[:, 1:])
    at = at + 1
    before = np.where(np.r_[True, block[1:] != block[:-1]], 0, np.r_[0, at[:-1]]) if len(block) else at
    run, v = at - before - 1, flat[block, at]
    sixteen = run // 16
    last = np.zeros(n, np.int64)
    last[block] = at  # the greatest place is written last
    ends = np.flatnonzero(last < 63)
    # events: (block, place, symbol, extra bits, their number)
    events = [
        (np.arange(n), np.zeros(n, np.int64), _size(dc), dc), (np.repeat(block, sixteen), np.repeat(at * 2 - 1, sixteen), np.full(int(sixteen.sum()), 0xF0), np.zeros(int(sixteen.sum()), np.int64)),
        (block, at * 2, run % 16 * 16 + _size(v), v), (ends, np.full(len(ends), 200), np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)),
    ]
    where, place, symbol, value = (np.concatenate([e[k] for e in events]) for k in range(4))
    by = np.lexsort((place, where))
    where, place, symbol, value = where[by], place[by], symbol[by], value[by]
    extra = np.where(symbol == 0xF0, 0, np.where(place == 0, symbol, symbol & 15))
    kind = chroma[where] * 2 + (place > 0)  # table: luminance dc, ac, chrominance dc, ac
    sizes, codes, parts = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64), []
    for k in range(2 if grey else 4):
        mine = kind == k
        counts = Counter(symbol[mine].tolist()) or Counter({0: 1})
        lengths = code_lengths(counts)
        symbols = sorted(lengths, key=lambda s: (lengths[s], s))
        number = [sum(x == size for x in lengths.values()) for size in range(1, 17)]
        table = _codes(number, symbols)
        look = np.zeros((256, 2), np.int64)
        for s, (code, size) in table.items():
            look[s] = (size, code)
        sizes[mine], codes[mine] = look[symbol[mine], 0], look[symbol[mine], 1]
        parts.append(bytes([(k % 2) << 4 | k // 2]) + bytes(number) + bytes(symbols))
    whole = codes << extra | np.where(value >= 0, value, value + (1 << extra) - 1)
    total = sizes + extra
    owner = np.repeat(np.arange(len(total)), total)
    shift = total[owner] - 1 - (np.arange(len(owner)) - np.repeat(np.cumsum(total) - total, total))
    bits = (whole[owner] >> shift & 1).astype(np.uint8)
    bits = np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]
    data = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i in range(1 if grey else 2):
        out += part(0xDB, bytes([i]) + bytes(tables[i][order].tolist()))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, comps) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(comps)))
    out += b"".join(part(0xC4, p) for p in parts)
    out += part(0xDA, bytes([comps]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(comps)) + b"\0\x3f\0")
    return out + data + b"\xff\xd9"


def decode(data: bytes) -> np.ndarray:
    """(rows, columns, 3) RGB or (rows, columns) grey of a baseline stream; ValueError for others."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at, quants, tables, frame, restart = 2, {}, {}, None, 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide, n = body[i] >> 4, body[i] & 15
                quants[n] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
                i += 1 + 64 * (wide + 1)
        elif marker in (0xC0, 0xC1):
            _, h, w, comps = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(comps)]
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = {(size, code): s for s, (code, size) in _codes(list(body[i + 1 : i + 17]), list(body[i + 17 : i + 17 + n])).items()}
                i += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline frame")
    if frame is None:
        raise ValueError("no frame")
    end = data.rfind(b"\xff\xd9")
    rest = data[at : end if end > at else len(data)]
    pieces = [p.replace(b"\xff\0", b"\xff") for p in (re.split(rb"\xff[\xd0-\xd7]", rest) if restart else [rest])]
    tall, broad = max(f[2] for f in frame), max(f[1] for f in frame)
    down, across = -(-h // (8 * tall)), -(-w // (8 * broad))
    z = {f[0]: np.zeros((down * f[2], across * f[1], 64), np.int64) for f in frame}
    looks = {k: _look(t) for k, t in tables.items()}
    done = 0
    for piece in pieces:
        padded = np.frombuffer(piece + b"\xff" * 8, np.uint8).astype(np.uint64)
        wide = np.zeros(len(piece) + 4, np.uint64)  # the 40 bits from each byte on
        for k in range(5):
            wide |= padded[k : k + len(wide)] << np.uint64(32 - 8 * k)
        wide, p, before = wide.tolist(), 0, dict.fromkeys(z, 0)
        for _ in range(min(restart or down * across, down * across - done)):
            r0, c0 = divmod(done, across)
            for name, hs, vs, _ in frame:
                look_dc, look_ac = looks[scan[name] >> 4], looks[0x10 | scan[name] & 15]
                for unit in range(hs * vs):
                    size, s = look_dc[wide[p >> 3] >> (24 - (p & 7)) & 0xFFFF]
                    p += size
                    if s:
                        x = wide[p >> 3] >> (40 - s - (p & 7)) & ((1 << s) - 1)
                        p += s
                        before[name] += x if x >> (s - 1) else x - (1 << s) + 1
                    block, k = z[name][r0 * vs + unit // hs, c0 * hs + unit % hs], 1
                    block[0] = before[name]
                    while k < 64:
                        size, s = look_ac[wide[p >> 3] >> (24 - (p & 7)) & 0xFFFF]
                        p += size
                        if s == 0:
                            break
                        k += s >> 4
                        s &= 15
                        if s:
                            x = wide[p >> 3] >> (40 - s - (p & 7)) & ((1 << s) - 1)
                            p += s
                            block[k] = x if x >> (s - 1) else x - (1 << s) + 1
                        k += 1
            done += 1
    order, basis, planes = zigzag(), cosines(), []
    for name, hs, vs, q in frame:
        blocks = np.zeros_like(z[name])
        blocks[:, :, order] = z[name] * quants[q]
        rows, cols = blocks.shape[:2]
        x = (basis.T @ blocks.reshape(rows, cols, 8, 8) @ basis).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        planes.append(x.repeat(tall // vs, axis=0).repeat(broad // hs, axis=1)[:h, :w])
    if len(planes) == 1:
        return np.clip(np.rint(planes[0] + 128), 0, 255).astype(np.uint8)
    y, cb, cr = planes[0] + 128, planes[1], planes[2]
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)), 0, 255).astype(np.uint8)


def _look(codes: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """By the next 16 bits: the size and the symbol of the code they begin with; size 16 and symbol 0 where none does."""
    out = [(16, 0)] * (1 << 16)
    for (size, code), s in codes.items():
        first = code << (16 - size)
        out[first : first + (1 << (16 - size))] = [(size, s)] * (1 << (16 - size))
    return out
