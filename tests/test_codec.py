"""The codec: round trips, equality with the long-form plans, and the byte formats."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.functions import arrays
from lumenframe.operators import bayer, codec, entropy, wavelet
from lumenframe.sources.container import file_tags, tiff_bytes


def image(h, w, seed=0):
    y, x = np.mgrid[:h, :w]
    return np.clip(1500 + 900 * np.sin(x / 9) + 600 * np.cos(y / 7) + np.random.default_rng(seed).normal(0, 6, (h, w)), 0, 4095).astype(np.int64)


def test_codebook_is_prefix_free_and_complete_enough():
    words = [f"{b:0{s}b}" for s, b, *_ in codec.codebook()]
    assert len(set(words)) == 264
    words.sort()
    assert all(not b.startswith(a) for a, b in zip(words, words[1:]))


def test_code_sizes_are_the_tables():
    """Sizes of the words equal the long form's tables, and the code is complete."""
    assert sum(2.0**-s for s, *_ in codec.codebook()) == 1
    assert {(n, s) for s, _, n, v in codec.codebook() if v == 0 and n} == set(entropy.RUN_BITS.items())
    sizes = {v: s for s, _, n, v in codec.codebook() if n == 1}
    assert sizes[1] == 2 and sizes[3] == 5 and sizes[115] == 24 and sizes[116] == 26 and sizes[255] == 25


def test_a_band_by_hand():
    """Words of sizes 1 and 2 are 0 and 10: one value of 1 after three zeros, a -1, then the band's end."""
    sizes, codes, runs, end = codec._encoder(None)
    assert (sizes[1], codes[1]) == (2, 0b10) and runs[-1] == (1, 1, 0)
    bits = "000" + "10" + "0" + "10" + "1" + f"{end[1]:026b}"
    bits += "0" * (-len(bits) % 32)
    assert codec.encode_band(np.array([0, 0, 0, 1, -1])) == int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_other_words():
    """A code given as text is used for writing and reading; a broken one is refused."""
    flipped = [(s, (1 << s) - 1 - b, n, v) for s, b, n, v in codec.codebook()]
    words = codec.read_codebook(f"{s} {b:#x} {n} {v}" for s, b, n, v in flipped)
    v = np.random.default_rng(3).integers(-3, 4, 500) * (np.arange(500) % 5 == 0)
    made = codec.encode_band(v, words)
    assert made != codec.encode_band(v) and (codec.decode_band(made, 500, words) == v).all()
    x = image(96, 96)
    assert (codec.decode_image(codec.encode_image(x, words=words), words=words) == codec.decode_image(codec.encode_image(x))).all()
    for broken in (flipped[1:], [(1, 0, 1, 0), (1, 1, 0, 1)]):
        with pytest.raises(ValueError):
            codec.read_codebook(f"{s} {b} {n} {v}" for s, b, n, v in broken)


def test_sections_hold_their_sizes():
    """Every section's and chunk's size leads to the next segment, and bad streams are errors."""
    import struct

    data = codec.encode_image(image(96, 112))
    at, channels = 4, 0
    while at < len(data):
        tag, value = struct.unpack_from(">hH", data, at)
        tag, at = abs(tag), at + 4
        if tag & 0xFF00 == codec.SECTIONS["channel"] or tag & 0x4000:
            at += ((tag & 0xFF) << 16 | value) * 4 if tag & 0x2000 else value * 4
            channels += tag & 0xFF00 == codec.SECTIONS["channel"]
    assert at == len(data) and channels == 4
    for bad in (b"", b"none" + data[4:], data[:200], codec.segment(20, 1).join([data[:4], data[4:]])):
        with pytest.raises((ValueError, KeyError)):
            codec.decode_image(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(-255, 255)), min_size=0, max_size=300), st.integers(0, 900))
def test_bands_round_trip(values, zeros):
    v = np.array([0] * zeros + values + [0] * zeros, np.int64)
    assert (codec.decode_band(codec.encode_band(v), len(v)) == v).all()


@pytest.mark.parametrize("shape", [(96, 96), (100, 104), (98, 110)])
@pytest.mark.parametrize("cell", ["rggb", "gbrg"])
def test_images_come_back_close(shape, cell):
    x = image(*shape)
    back = codec.decode_image(codec.encode_image(x, cell))
    assert back.shape == x.shape and np.abs(back - x).mean() < 40
    for k, name in ((2, "half"), (4, "quarter"), (8, "eighth"), (16, "sixteenth")):
        assert codec.preview_image(codec.encode_image(x, cell), name).shape == (-(-shape[0] // k), -(-shape[1] // k), 3)


def test_arrays_equal_the_long_form(spark):
    x = image(52, 48)
    px = spark.createDataFrame([(0, r, c, int(v)) for r, row in enumerate(x) for c, v in enumerate(row)], "image_id int, row int, col int, v int")
    found = wavelet.pyramid(bayer.unpack(px), 2).collect()
    planes = codec.planes_of(x)
    for channel, plane in enumerate(planes):
        for level in range(2):
            bands = arrays.forward_2d(plane, wavelet.PRESCALE[level])
            for b, band in enumerate(bands):
                rows = {(r.row, r.col): r.v for r in found if (r.channel, r.level, r.band) == (channel, level, b)} if b or level == 1 else {}
                assert all(rows[i, j] == band[i, j] for i, j in rows) and (not rows or len(rows) == band.size)
            plane = bands[0]


def test_conversions_over_a_table(spark):
    x = image(96, 112)
    packed = b"".join(bytes([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4]) for a, b in x.reshape(-1, 2).tolist())
    rows = [(1, 112, 96, "rggb12", x.astype("<u2").tobytes(), "n"), (2, 112, 96, "rggb14", (x << 2).astype("<u2").tobytes(), None), (3, 112, 96, "gbrg12p", packed, "p"), (4, 112, 96, "rggb12", None, "q")]
    images = spark.createDataFrame(rows, "image_id int, width int, height int, pixel_format string, raw binary, note string")
    coded = codec.convert(images, "RAW", "VC5").cache()
    raw = {r.image_id: r.raw for r in codec.convert(coded, "VC5", "RAW").collect()}
    assert raw[1] == raw[2] and raw[4] is None and len(raw[3]) == x.size * 2
    made = {r.image_id: r.ppm for r in codec.convert(coded, "VC5", "PPM-quarter").collect()}
    assert made[1].startswith(b"P6\n28 24\n255\n") and len(made[1]) == 13 + 28 * 24 * 3
    tags = codec.segment_rows(coded).where("image_id = 1").collect()
    assert sum(r.payload_bytes > 0 and r.tag & 0xFF00 == codec.PAYLOAD for r in tags) == 40
    assert sum(r.tag & 0xFF00 == codec.SECTIONS["subband"] for r in tags) == 40 and sum(r.tag & 0xFF00 == codec.SECTIONS["channel"] for r in tags) == 4
    with pytest.raises(ValueError):
        codec.convert(images, "RAW", "JPG")
    with pytest.raises(ValueError):
        codec.encode_image(image(40, 40))


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=600))
def test_byte_codes_round_trip(data):
    data = data + data[:50] * 3
    assert arrays.packbits_decode(arrays.packbits_encode(data)) == data
    assert arrays.lzw_decode(arrays.lzw_encode(data)) == data
    x = np.frombuffer(data[: len(data) // 4 * 4], "<u2").reshape(2, -1) if len(data) >= 4 else np.zeros((2, 4), "<u2")
    assert (arrays.predictor_undo(arrays.predictor_apply(x)) == x).all() and (arrays.predictor_undo(arrays.predictor_apply(x, 2), 2) == x).all()


def test_long_lzw():
    data = np.random.default_rng(0).integers(0, 7, 60_000).astype(np.uint8).tobytes()
    assert arrays.lzw_decode(arrays.lzw_encode(data)) == data


def test_tags_of_a_container(spark, tmp_path):
    made = tiff_bytes([{256: ("long", [112]), 257: ("long", [96]), 271: ("ascii", "Maker"), 33434: ("rational", [(1, 60)]), 50706: ("byte", [1, 4, 0, 0])}, {259: ("short", [9])}])
    (tmp_path / "a.dng").write_bytes(made)
    (tmp_path / "b.dng").write_bytes(b"not a container")
    found = {(r.ifd, r.tag): r for r in file_tags(spark, str(tmp_path)).collect() if r.path.endswith("a.dng")}
    assert found[0, 256].ints == [112] and found[0, 271].text == "Maker" and found[0, 33434].rationals[0].num == 1 and found[0, 33434].rationals[0].den == 60
    assert found[0, 50706].ints == [1, 4, 0, 0] and found[1, 259].ints == [9]
    assert all(not r.path.endswith("b.dng") for r in file_tags(spark, str(tmp_path)).collect())
