"""The same integer formulas over numpy arrays: one image row or plane at a time inside Arrow functions."""

from __future__ import annotations

import numpy as np

MIDPOINT = 2048


def log_tables() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(4096) / 4095.0
    encode = (4095.0 * np.log10(i * 112.0 + 1.0) / np.log10(113.0)).astype(np.int64)
    decode = np.minimum(65535, (65535.0 * (np.power(113.0, i) - 1.0) / 112.0).astype(np.float32).astype(np.int64))
    return encode, decode


def uncompand(m: np.ndarray) -> np.ndarray:
    return np.sign(m) * (np.abs(m) + (np.abs(m).astype(np.float64) ** 3 * 768.0 / 16581375.0).astype(np.int64))


def compand_table() -> np.ndarray:
    """Magnitude 0..1023 to 0..255: the greatest whose uncompanded value is not above it."""
    return np.searchsorted(np.minimum(1023, uncompand(np.arange(256))), np.arange(1024), "right") - 1


def forward(x: np.ndarray, prescale: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves along the last axis, at least six samples long."""
    n = x.shape[-1]
    if n < 6:
        raise ValueError(f"a side of {n} samples is too short for the wavelet; six are needed")
    x = x.astype(np.int64)
    if n % 2:
        x = np.concatenate([x, x[..., -1:]], axis=-1)
    r = (1 << prescale) - 1
    even, odd = x[..., ::2], x[..., 1::2]
    p = (x + r) >> prescale
    a, b = p[..., ::2], p[..., 1::2]
    high = np.empty_like(a)
    high[..., 1:-1] = -a[..., :-2] - b[..., :-2] + 8 * a[..., 1:-1] - 8 * b[..., 1:-1] + a[..., 2:] + b[..., 2:]
    high[..., 0] = 5 * p[..., 0] - 11 * p[..., 1] + 4 * p[..., 2] + 4 * p[..., 3] - p[..., 4] - p[..., 5]
    high[..., -1] = p[..., -6] + p[..., -5] - 4 * p[..., -4] - 4 * p[..., -3] + 11 * p[..., -2] - 5 * p[..., -1]
    return (even + odd + r) >> prescale, (high + 4) >> 3


def inverse(low: np.ndarray, high: np.ndarray, n: int, descale: bool, clamp: tuple[int, int]) -> np.ndarray:
    before, after = low[..., :-2], low[..., 2:]
    even, odd = np.empty_like(low), np.empty_like(low)
    even[..., 1:-1] = ((before - after + 4) >> 3) + low[..., 1:-1] + high[..., 1:-1]
    odd[..., 1:-1] = ((after - before + 4) >> 3) + low[..., 1:-1] - high[..., 1:-1]
    even[..., 0] = ((11 * low[..., 0] - 4 * low[..., 1] + low[..., 2] + 4) >> 3) + high[..., 0]
    odd[..., 0] = ((5 * low[..., 0] + 4 * low[..., 1] - low[..., 2] + 4) >> 3) - high[..., 0]
    even[..., -1] = ((5 * low[..., -1] + 4 * low[..., -2] - low[..., -3] + 4) >> 3) + high[..., -1]
    odd[..., -1] = ((11 * low[..., -1] - 4 * low[..., -2] + low[..., -3] + 4) >> 3) - high[..., -1]
    out = np.stack([even, odd], axis=-1).reshape(*low.shape[:-1], -1)[..., :n]
    return np.clip(out * 2 if descale else out >> 1, *clamp)


def forward_2d(x: np.ndarray, prescale: int) -> list[np.ndarray]:
    """LL, LH, HL, HH."""
    low, high = forward(x, prescale)
    (ll, hl), (lh, hh) = (tuple(y.T for y in forward(np.ascontiguousarray(h.T), 0)) for h in (low, high))
    return [ll, lh, hl, hh]


def inverse_2d(bands: list[np.ndarray], shape: tuple[int, int], descale: bool) -> np.ndarray:
    ll, lh, hl, hh = (np.ascontiguousarray(b.T) for b in bands)
    low = inverse(ll, hl, shape[0], False, (-32768, 32767)).T
    high = inverse(lh, hh, shape[0], False, (-32768, 32767)).T
    return inverse(np.ascontiguousarray(low), np.ascontiguousarray(high), shape[1], descale, (-32768, 32767) if descale else (0, 16383))


def unpack_bits(data: bytes) -> np.ndarray:
    """12-bit packed bytes to samples."""
    b = np.frombuffer(data, np.uint8).astype(np.int64).reshape(-1, 3)
    return np.stack([b[:, 0] + ((b[:, 1] & 15) << 8), (b[:, 2] << 4) + (b[:, 1] >> 4)], axis=1).ravel()


def packbits_decode(data: bytes) -> bytes:
    """n >= 0: n + 1 literal bytes; n < 0: the next byte 1 - n times; -128: nothing."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i] - 256 if data[i] > 127 else data[i]
        if n >= 0:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n != -128:
                out += data[i + 1 : i + 2] * (1 - n)
            i += 2
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """TIFF LZW: codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; the width grows one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out += entry
        last = entry
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes, table, width, last = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for i in range(len(data)):
        step = last + data[i : i + 1]
        if step in table:
            last = step
            continue
        codes.append((table[last], width))
        table[step] = size
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
        if size >= 4094:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        last = data[i : i + 1]
    if last:
        codes.append((table[last], width))
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    codes.append((257, width))
    value = bits = 0
    out = bytearray()
    for code, w in codes:
        value, bits = value << w | code, bits + w
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def predictor_apply(x: np.ndarray, step: int = 1) -> np.ndarray:
    """Horizontal differences, modulo the sample type."""
    out = x.copy()
    out[..., step:] = x[..., step:] - x[..., :-step]
    return out


def predictor_undo(d: np.ndarray, step: int = 1) -> np.ndarray:
    out = d.copy()
    for k in range(step):
        out[..., k::step] = np.cumsum(d[..., k::step], axis=-1, dtype=d.dtype)
    return out
