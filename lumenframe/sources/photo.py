"""Whole photos in TIFF-based containers: reading the raw image, writing containers, and conversions between kinds.

A photo row has path, width, height, pixel_format (rggb12, rggb14, gbrg12, gbrg14), raw (16-bit little-endian samples), vc5 (the
coded image), and what metadata is wanted. One Arrow row a photo: bytes are taken where they stand.

Defined cases: files that aren't such containers, or have no raw image, give a row with nulls and the reason in `error`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import arrays, jpeg, lossless_jpeg
from lumenframe.operators import codec
from lumenframe.sources.container import directories, tiff_bytes

# Compressions of a raw image, the mosaic's colours in a 2x2 cell, and the kind of image that a mosaic is.
PLAIN, LZW, JPEG, LOSSY, VC5, PACKBITS, MOSAIC = 1, 5, 7, 34892, 9, 32773, 32803
PATTERNS = {"rggb": (0, 1, 1, 2), "gbrg": (1, 2, 0, 1)}
SCHEMA = "path string, width int, height int, pixel_format string, compression int, raw binary, vc5 binary, payload binary, preview binary, make string, model string, black array<bigint>, white array<bigint>, error string"


def _ifds(data: bytes) -> dict[int, dict[int, tuple]]:
    """Directory number to tag to (ints, reals, rationals, text, raw)."""
    found: dict[int, dict[int, tuple]] = {}
    for ifd, _, tag, _, _, *values in directories(data, longest=1 << 24):
        found.setdefault(ifd, {})[tag] = tuple(values)
    return found


def _pixels(data: bytes, tags: dict[int, tuple], width: int, height: int, compression: int) -> np.ndarray:
    """The raw image from its strips or tiles, whichever there are."""
    ints = lambda tag, other=None: tags[tag][0] if tag in tags else other
    if 322 in tags:
        tw, th, offsets, sizes = ints(322)[0], ints(323)[0], ints(324), ints(325)
    else:
        tw, th, offsets, sizes = width, min(height, ints(278, [height])[0]), ints(273), ints(279)
    bits, step = ints(258, [16])[0], ints(317, [1])[0]
    out, across = np.zeros((height, width), np.uint16), -(-width // tw)
    order = "<u2" if data[:2] == b"II" else ">u2"
    for i, (at, n) in enumerate(zip(offsets, sizes, strict=True)):
        part, r, c = data[at : at + n], i // across * th, i % across * tw
        rows = th if 322 in tags else min(th, height - r)
        if compression == JPEG:
            x = lossless_jpeg.decode(part)
            tile = x.reshape(x.shape[0], -1)[:rows, :tw].astype(np.uint16)
        elif compression == LOSSY:
            x = jpeg.decode(part)
            tile = (x if x.ndim == 2 else x[..., 0])[:rows, :tw].astype(np.uint16)
        else:
            part = arrays.lzw_decode(part) if compression == LZW else arrays.packbits_decode(part) if compression == PACKBITS else part
            if bits == 12:
                packed = np.frombuffer(part, np.uint8)[: rows * tw * 3 // 2].astype(np.uint16).reshape(-1, 3)
                tile = np.stack([packed[:, 0] << 4 | packed[:, 1] >> 4, (packed[:, 1] & 15) << 8 | packed[:, 2]], axis=1).reshape(rows, tw)
            else:
                tile = np.frombuffer(part, "u1" if bits == 8 else order)[: rows * tw].reshape(rows, tw).astype(np.uint16)
            if step > 1:
                tile = arrays.predictor_undo(tile, {2: 1, 34892: 2, 34893: 4}.get(step, 1))
        tile = tile[: height - r, : width - c]
        out[r : r + tile.shape[0], c : c + tile.shape[1]] = tile
    return out


def parse(data: bytes, decode: bool = True) -> dict:
    """One container's fields; the raw samples only if asked for."""
    ifds = _ifds(data)
    image = next((t for t in ifds.values() if 262 in t and t[262][0] and t[262][0][0] == MOSAIC and 256 in t), None)
    if image is None:
        raise ValueError("no raw image")
    first = ifds[0]
    width, height, compression = image[256][0][0], image[257][0][0], image[259][0][0] if 259 in image else PLAIN
    pattern = tuple(image[33422][0]) if 33422 in image else PATTERNS["rggb"]
    cell = next((k for k, v in PATTERNS.items() if v == pattern), None)
    if cell is None:
        raise ValueError(f"no mosaic of the kinds {sorted(PATTERNS)}")
    white = image[50717][0] if 50717 in image else [65535]
    out = {
        "width": width, "height": height, "pixel_format": f"{cell}{14 if white[0] > 4095 else 12}", "compression": compression, "white": white,
        "black": image[50714][0] if 50714 in image and image[50714][0] else [a["num"] // max(1, a["den"]) for a in image[50714][2]] if 50714 in image and image[50714][2] else [0],
        "make": first[271][3] if 271 in first else None, "model": first[272][3] if 272 in first else None, "raw": None, "vc5": None, "preview": None,
        "payload": bytes(first[50740][0]) if 50740 in first and first[50740][0] else first[50740][4] if 50740 in first else None,
    }
    if compression == VC5:
        at, n = (image[324][0][0], image[325][0][0]) if 324 in image else (image[273][0][0], image[279][0][0])
        out["vc5"] = data[at : at + n]
        if decode:
            out["raw"] = codec.decode_image(out["vc5"], 14 if out["pixel_format"].endswith("14") else 12).astype("<u2").tobytes()
    elif decode:
        out["raw"] = _pixels(data, image, width, height, compression).astype("<u2").tobytes()
    small = next((t for t in ifds.values() if t is not image and 259 in t and t[259][0][0] == JPEG and 273 in t), None)
    if small:
        out["preview"] = data[small[273][0][0] : small[273][0][0] + small[279][0][0]]
    return out


def photos(files: DataFrame, decode: bool = True) -> DataFrame:
    """Rows as in SCHEMA of a binaryFile scan. decode: also the raw samples (else metadata and coded bytes only)."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    lists = pa.list_(pa.int64())
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 4, pa.string(), pa.string(), lists, lists, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = parse(content.as_py() or b"", decode) | {"error": None}
                except (ValueError, KeyError, IndexError, TypeError) as problem:
                    found = {"error": str(problem) or type(problem).__name__}
                yield pa.RecordBatch.from_arrays([pa.array([path if n == "path" else found.get(n)], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def container(width: int, height: int, pixel_format: str, raw: bytes | None = None, vc5: bytes | None = None, preview: bytes | None = None, payload: bytes | None = None, make: str | None = None, model: str | None = None, black: list | None = None, white: list | None = None, extra: dict | None = None) -> bytes:
    """A container around raw samples or, where given, a coded image; extra: more tags of the first directory, tag -> (type, values)."""
    body, compression = (vc5, VC5) if vc5 is not None else (raw, PLAIN)
    main = {
        254: ("long", [0]), 256: ("long", [width]), 257: ("long", [height]), 258: ("short", [16]), 259: ("short", [compression]), 262: ("short", [MOSAIC]), 273: ("long", [0]), 277: ("short", [1]),
        278: ("long", [height]), 279: ("long", [len(body)]), 33421: ("short", [2, 2]), 33422: ("byte", list(PATTERNS[pixel_format[:4]])), 50706: ("byte", [1, 4, 0, 0]),
        50713: ("short", [2, 2]), 50714: ("short", list(black or [0, 0, 0, 0])), 50717: ("long", list(white or [16383 if "14" in pixel_format else 4095])),
    }
    if make:
        main[271] = ("ascii", make)
    if model:
        main[272] = ("ascii", model)
    if payload:
        main[50740] = ("byte", list(payload))
    chain, blobs = [main | (extra or {})], [body]
    if preview:
        chain.append({254: ("long", [1]), 259: ("short", [JPEG]), 262: ("short", [6]), 273: ("long", [0]), 279: ("long", [len(preview)])})
        blobs.append(preview)
    start = len(tiff_bytes(chain))
    for ifd, blob in zip(chain, blobs, strict=True):
        start += start % 2
        ifd[273] = ("long", [start])
        start += len(blob)
    out = tiff_bytes(chain)
    for blob in blobs:
        out += b"\0" * (len(out) % 2) + blob
    return out


def _each(rows: DataFrame, out: str, f: Callable[[dict], bytes | None]) -> DataFrame:
    """rows with a binary column `out` made of each row; raw and vc5 leave unless `out` is one of them."""
    kept = [c for c in rows.columns if c not in ("raw", "vc5", out)]
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields if x.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                made = pa.array([f(one.to_pylist()[0])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(one.column(one.schema.get_field_index(c)) for c in kept), made], [*kept, out])

    return rows.mapInArrow(run, ", ".join(x for x in (fields, f"`{out}` binary") if x))


def _contained(r: dict, **body) -> bytes | None:
    if next(iter(body.values())) is None:
        return None
    more = {k: r[k] for k in ("preview", "payload", "make", "model", "black", "white") if r.get(k) is not None}
    return container(r["width"], r["height"], r["pixel_format"].removesuffix("p"), **body, **more)


def _samples(r: dict) -> np.ndarray | None:
    if r.get("raw") is None:
        return None
    x = arrays.unpack_bits(r["raw"]) if r["pixel_format"].endswith("p") else np.frombuffer(r["raw"], "<u2").astype(np.int64)
    return x[: r["width"] * r["height"]].reshape(r["height"], r["width"])


def _coded(r: dict, quality: str = "fs1") -> bytes | None:
    x = _samples(r)
    return None if x is None else codec.encode_image(x >> 2 if "14" in r["pixel_format"] else x, r["pixel_format"][:4], quality)


def _decoded(r: dict) -> bytes | None:
    return None if r.get("vc5") is None else codec.decode_image(r["vc5"], 14 if "14" in r["pixel_format"] else 12).astype("<u2").tobytes()


def _shown(r: dict, resolution: str, quality: int) -> bytes | None:
    return None if r.get("vc5") is None else jpeg.encode(codec.preview_image(r["vc5"], resolution, 8).astype(np.uint8), quality)


def with_preview(rows: DataFrame, resolution: str = "eighth", quality: int = 80) -> DataFrame:
    """Photo rows (with vc5) with a JPEG of a reduced resolution as their preview."""
    kept = [c for c in rows.columns if c != "preview"]
    made = _each(rows.withColumn("_vc5", F.col("vc5")), "preview", lambda r: _shown({"vc5": r["_vc5"]}, resolution, quality))
    return made.withColumnRenamed("_vc5", "vc5").select(*[c for c in kept if c != "raw"], "preview")


RESOLUTIONS = ("half", "quarter", "eighth", "sixteenth")
#: (source, target) -> function of photo rows. DNG holds plain samples, CODED a coded image; files of both are read by photos().
CONVERSIONS: dict[tuple[str, str], Callable[..., DataFrame]] = {
    ("RAW", "DNG"): lambda rows: _each(rows, "dng", lambda r: None if r["raw"] is None else _contained(r, raw=_samples(r).astype("<u2").tobytes())),
    ("DNG", "RAW"): lambda rows: rows,
    ("DNG", "DNG"): lambda rows: _each(rows, "dng", lambda r: _contained(r, raw=r["raw"])),
    ("VC5", "CODED"): lambda rows: _each(rows, "dng", lambda r: _contained(r, vc5=r["vc5"])),
    ("CODED", "VC5"): lambda rows: rows.where("vc5 is not null"),
    ("RAW", "CODED"): lambda rows, quality="fs1": _each(rows, "dng", lambda r: _contained(r, vc5=_coded(r, quality))),
    ("DNG", "CODED"): lambda rows, quality="fs1": _each(rows, "dng", lambda r: _contained(r, vc5=_coded(r, quality))),
    ("DNG", "VC5"): lambda rows, quality="fs1": _each(rows, "vc5", lambda r: _coded(r, quality)),
    ("CODED", "DNG"): lambda rows: _each(rows, "dng", lambda r: _contained(r, raw=_decoded(r))),
    ("VC5", "DNG"): lambda rows: _each(rows, "dng", lambda r: _contained(r, raw=_decoded(r))),
    ("CODED", "RAW"): lambda rows: _each(rows, "raw", _decoded),
    **{(source, f"JPG-{k}"): (lambda rows, k=k, quality=90: _each(rows, "jpg", lambda r: _shown(r, k, quality))) for source in ("CODED", "VC5") for k in RESOLUTIONS},
    **{("CODED", f"PPM-{k}"): (lambda rows, k=k, bits=8: _each(rows, "ppm", lambda r: None if r.get("vc5") is None else codec.ppm(codec.preview_image(r["vc5"], k, bits), bits))) for k in RESOLUTIONS},
}


def convert(rows: DataFrame, source: str, target: str, **how) -> DataFrame:
    """Photo rows from one kind to another; unknown pairs are an error."""
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}; there are {sorted(CONVERSIONS)}")
    return CONVERSIONS[source, target](rows, **how)
