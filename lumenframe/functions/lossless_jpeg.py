"""Lossless JPEG (process 14): Huffman-coded prediction differences, any of the seven predictors.

Sequential by nature: one tile or image a call, inside an Arrow function.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np


def _category(d: int) -> int:
    return 16 if d == -32768 else abs(d).bit_length()


def _predicted(x: np.ndarray, predictor: int, start: int) -> np.ndarray:
    """Prediction of every sample (rows, columns, components) from its neighbours; the edges as the standard has them."""
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    out = {1: left, 2: up, 3: corner, 4: left + up - corner, 5: left + ((up - corner) >> 1), 6: up + ((left - corner) >> 1), 7: (left + up) >> 1}[predictor].copy()
    out[0, 1:] = left[0, 1:]
    out[1:, 0] = up[1:, 0]
    out[0, 0] = start
    return out


def code_lengths(counts: dict[int, int], longest: int = 16) -> dict[int, int]:
    """Huffman code lengths of at most `longest` bits; the all-ones code stays free."""
    heap = [(n, s, (s,)) for s, n in sorted(counts.items())] + [(0, 999, ())]
    length = dict.fromkeys(counts, 0)
    heapq.heapify(heap)
    number = 1000
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        number += 1
        heapq.heappush(heap, (a[0] + b[0], number, a[2] + b[2]))
    over = sorted(length, key=lambda s: length[s])
    for s in over:
        length[s] = min(max(length[s], 1), longest)
    while sum(2.0 ** -length[s] for s in length) > 1 - 2.0**-longest:  # too many short codes after the cut
        s = max((s for s in length if length[s] < longest), key=lambda s: length[s])
        length[s] += 1
    return length


def _codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, size), from the number of codes of each size 1..16."""
    code, at, out = 0, 0, {}
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[at]] = (code, size)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def encode(x: np.ndarray, precision: int = 16, predictor: int = 1) -> bytes:
    """x: (rows, columns) or (rows, columns, components), unsigned samples."""
    x = (x if x.ndim == 3 else x[:, :, None]).astype(np.int64)
    rows, cols, comps = x.shape
    d = (x - _predicted(x, predictor, 1 << (precision - 1))) & 0xFFFF
    d = np.where(d >= 32768, d - 65536, d).ravel().tolist()
    lengths = code_lengths(Counter(map(_category, d)))
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    table = [sum(v == size for v in lengths.values()) for size in range(1, 17)]
    codes = _codes(table, symbols)
    bits: list[str] = []
    for v in d:
        s = _category(v)
        code, size = codes[s]
        bits.append(f"{code:0{size}b}")
        if 0 < s < 16:
            bits.append(f"{v if v > 0 else v + (1 << s) - 1:0{s}b}")
    joined = "".join(bits)
    joined += "1" * (-len(joined) % 8)
    data = int(joined, 2).to_bytes(len(joined) // 8, "big").replace(b"\xff", b"\xff\0") if joined else b""
    frame = struct.pack(">BHHB", precision, rows, cols, comps) + b"".join(bytes([c, 0x11, 0]) for c in range(comps))
    scan = bytes([comps]) + b"".join(bytes([c, 0]) for c in range(comps)) + bytes([predictor, 0, 0])
    huffman = b"\0" + bytes(table) + bytes(symbols)
    part = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + part(0xC3, frame) + part(0xC4, huffman) + part(0xDA, scan) + data + b"\xff\xd9"


def decode(data: bytes) -> np.ndarray:
    """(rows, columns, components); raises ValueError for anything but a lossless frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at, tables, frame = 2, {}, None
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            precision, rows, cols, comps = struct.unpack_from(">BHHB", body)
            frame = (precision, rows, cols, comps, [body[6 + 3 * i] for i in range(comps)])
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                lengths = list(body[i + 1 : i + 17])
                n = sum(lengths)
                tables[body[i] & 15] = {v: k for k, v in _codes(lengths, list(body[i + 17 : i + 17 + n])).items()}
                i += 17 + n
        elif marker == 0xDA:
            if frame is None:
                raise ValueError("not a lossless frame")
            scan = {body[1 + 2 * i]: body[2 + 2 * i] >> 4 for i in range(body[0])}
            predictor, shift = body[1 + 2 * body[0]], body[3 + 2 * body[0]] & 15
            break
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a lossless frame")
    precision, rows, cols, comps, names = frame
    raw = data[at:].split(b"\xff\xd9")[0].replace(b"\xff\0", b"\xff")
    bits = "".join(f"{b:08b}" for b in raw)
    d, i, order = np.zeros((rows, cols, comps), np.int64), 0, [tables[scan[c]] for c in names]
    flat = d.reshape(-1)
    for k in range(flat.size):
        table, code, size = order[k % comps], 0, 0
        while True:
            code, size = code << 1 | (bits[i] == "1"), size + 1
            i += 1
            if (code, size) in table:
                break
            if size > 16:
                raise ValueError("no such code")
        s = table[code, size]
        if s == 16:
            flat[k] = 32768
        elif s:
            v = int(bits[i : i + s], 2)
            i += s
            flat[k] = v if v >> (s - 1) else v - (1 << s) + 1
    out = np.zeros_like(d)
    first = 1 << (precision - shift - 1)
    if predictor == 1:
        out[:, 0] = np.cumsum(d[:, 0], axis=0) + first
        d[:, 0] = out[:, 0]
        out = np.cumsum(d, axis=1)
    else:
        for r in range(rows):
            for c in range(cols):
                if not r and not c:
                    p = first
                elif not r:
                    p = out[r, c - 1]
                elif not c:
                    p = out[r - 1, c]
                else:
                    a, b, e = out[r, c - 1], out[r - 1, c], out[r - 1, c - 1]
                    p = {2: b, 3: e, 4: a + b - e, 5: a + ((b - e) >> 1), 6: b + ((a - e) >> 1), 7: (a + b) >> 1}[predictor]
                out[r, c] = (p + d[r, c]) & 0xFFFF
    return (out & 0xFFFF) << shift
