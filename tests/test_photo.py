import numpy as np
import pytest

from lumenframe.functions import arrays, jpeg, lossless_jpeg
from lumenframe.operators import codec
from lumenframe.sources import photo
from lumenframe.sources.container import tiff_bytes
from tests.test_codec import image

X = image(96, 112)
FILES = "path string, content binary"


def table(spark, rows):
    fields = "path string, width int, height int, pixel_format string, raw binary, make string, payload binary"
    return spark.createDataFrame(rows, fields)


@pytest.fixture(scope="module")
def raws(spark):
    packed = b"".join(bytes([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4]) for a, b in X.reshape(-1, 2).tolist())
    return table(spark, [("a", 112, 96, "rggb12", X.astype("<u2").tobytes(), "M", b"extra"), ("b", 112, 96, "rggb14", (X << 2).astype("<u2").tobytes(), None, None), ("c", 112, 96, "gbrg12p", packed, "M", None), ("d", 112, 96, "rggb12", None, None, None)])


def read(spark, rows, column, **how):
    return photo.photos(rows.where(f"{column} is not null").selectExpr("path", f"{column} as content"), **how)


def test_raw_to_container_and_back(spark, raws):
    made = photo.convert(raws, "RAW", "DNG")
    found = {r.path: r for r in read(spark, made, "dng").collect()}
    assert set(found) == {"a", "b", "c"} and all(r.error is None and (r.width, r.height, r.compression) == (112, 96, 1) for r in found.values())
    assert found["a"].raw == found["c"].raw == X.astype("<u2").tobytes() and found["b"].raw == (X << 2).astype("<u2").tobytes()
    assert (found["a"].pixel_format, found["b"].pixel_format, found["c"].pixel_format) == ("rggb12", "rggb14", "gbrg12")
    assert found["a"].make == "M" and bytes(found["a"].payload) == b"extra" and found["b"].payload is None


def test_coded_containers(spark, raws):
    coded = photo.convert(raws.where("path <> 'd'"), "RAW", "CODED")
    found = read(spark, coded, "dng").cache()
    rows = {r.path: r for r in found.collect()}
    want = codec.encode_image(X)
    assert rows["a"].vc5 == want and rows["a"].compression == 9
    assert np.frombuffer(rows["a"].raw, "<u2").tolist() == codec.decode_image(want).ravel().tolist()
    assert all(r.raw is None and r.vc5 for r in read(spark, coded, "dng", decode=False).collect())
    plain = {r.path: r for r in read(spark, photo.convert(found, "CODED", "DNG"), "dng").collect()}
    assert plain["a"].compression == 1 and plain["a"].raw == rows["a"].raw
    again = photo.convert(photo.convert(found, "CODED", "VC5").select("path", "width", "height", "pixel_format", "vc5"), "VC5", "CODED")
    assert {r.path: r.vc5 for r in read(spark, again, "dng").collect()} == {p: r.vc5 for p, r in rows.items()}
    shown = {r.path: r.jpg for r in photo.convert(found, "CODED", "JPG-quarter").collect()}
    want = codec.preview_image(rows["a"].vc5, "quarter").astype(int)
    assert np.abs(jpeg.decode(shown["a"]).astype(int) - want).mean() < 6
    with_small = photo.convert(photo.with_preview(found.select("path", "width", "height", "pixel_format", "vc5")), "VC5", "CODED")
    small = next(r for r in read(spark, with_small, "dng").collect() if r.path == "a").preview
    assert jpeg.decode(small).shape == (12, 14, 3)
    with pytest.raises(ValueError):
        photo.convert(raws, "PPM", "DNG")


@pytest.mark.parametrize("kind", ["strips", "tiles", "lzw", "packbits", "lossless", "twelve"])
def test_ways_to_store_samples(spark, kind):
    h, w = X.shape
    base = {256: ("long", [w]), 257: ("long", [h]), 258: ("short", [16]), 262: ("short", [32803]), 50717: ("long", [4095])}
    plain = lambda a: np.ascontiguousarray(a).astype("<u2").tobytes()
    if kind == "tiles":
        tile, parts = (40, 48), []
        for r in range(0, h, tile[0]):
            for c in range(0, w, tile[1]):
                t = np.zeros(tile, np.int64)
                part = X[r : r + tile[0], c : c + tile[1]]
                t[: part.shape[0], : part.shape[1]] = part
                parts.append(plain(t))
        base |= {259: ("short", [1]), 322: ("long", [tile[1]]), 323: ("long", [tile[0]])}
        places = (324, 325)
    else:
        rows = 20 if kind in ("strips", "lzw", "packbits") else h
        parts = [plain(X[r : r + rows]) for r in range(0, h, rows)]
        code = {"strips": 1, "twelve": 1, "lzw": 5, "packbits": 32773, "lossless": 7}[kind]
        if kind == "lzw":
            parts = [arrays.lzw_encode(plain(arrays.predictor_apply(X[r : r + rows].astype(np.uint16)))) for r in range(0, h, rows)]
            base[317] = ("short", [2])
        if kind == "packbits":
            parts = [arrays.packbits_encode(p) for p in parts]
        if kind == "lossless":
            parts = [lossless_jpeg.encode(X)]
        if kind == "twelve":
            parts = [b"".join(bytes([a >> 4, (a & 15) << 4 | b >> 8, b & 255]) for a, b in X.reshape(-1, 2).tolist())]
            base[258] = ("short", [12])
        base |= {259: ("short", [code]), 278: ("long", [rows])}
        places = (273, 279)
    base |= {places[0]: ("long", [0] * len(parts)), places[1]: ("long", [len(p) for p in parts])}
    at = len(tiff_bytes([base]))
    base[places[0]] = ("long", (at + np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]).tolist())
    data = tiff_bytes([base]) + b"".join(parts)
    found = photo.photos(spark.createDataFrame([("x", data)], FILES)).head()
    assert found.error is None and np.array_equal(np.frombuffer(found.raw, "<u2").reshape(h, w), X)


def test_other_files_are_named_not_raised(spark):
    files = [("empty", b""), ("none", None), ("text", b"no container"), ("bare", tiff_bytes([{256: ("long", [4])}]))]
    found = photo.photos(spark.createDataFrame(files, FILES)).collect()
    assert len(found) == 4 and all(r.error and r.raw is None for r in found)
