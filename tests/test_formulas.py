"""Known values and round trips of the exact formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import curves
from lumenframe.operators import bayer, entropy, wavelet
from lumenframe.sources import pixels


def test_curve_ends(spark):
    rows = {r.i: (r.e, r.d) for r in curves.curve_table(spark, curves.log_encode, "e").withColumn("d", curves.log_decode(F.col("i"))).collect()}
    assert rows[0] == (0, 0) and rows[4095] == (4095, 65535)
    assert [rows[i][1] for i in (3741, 4070)] == [int(np.float32(65535 * (113 ** (i / 4095) - 1) / 112)) for i in (3741, 4070)]


def test_companding_is_exact_for_small_values_and_close_above(spark):
    inverse = {r.i: r.m for r in curves.inverse_companding(spark).collect()}
    back = {m: m + int(m**3 * 768 / 16581375) for m in range(256)}
    assert all(back[inverse[i]] == i for i in range(28))
    assert max(abs(back[inverse[i]] - i) for i in range(1024)) <= 9


def lines(spark, values):
    return spark.createDataFrame([(0, r, c, int(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "image_id int, row int, col int, v int")


@pytest.mark.parametrize("size", [6, 7, 12, 13, 40])
def test_one_line_forward_and_inverse(spark, size):
    rng = np.random.default_rng(size)
    x = rng.integers(0, 16384, (20, size))
    done = wavelet.forward_line(lines(spark, x), ["image_id", "row"], "col", "v", 0, "low", "high")
    back = wavelet.inverse_line(done, ["image_id", "row"], "col", "low", "high", lambda t: curves.clamp(F.shiftright(t, 1), 0, 16383))
    found = {(r["row"], r["col"]): r["v"] for r in back.collect()}
    assert all(found[i, j] == x[i, j] for i in range(20) for j in range(size))


def test_prescaled_inverse_is_within_five(spark):
    x = np.random.default_rng(3).integers(0, 16384, (30, 16))
    done = wavelet.forward_line(lines(spark, x), ["image_id", "row"], "col", "v", 2, "low", "high")
    back = wavelet.inverse_line(done, ["image_id", "row"], "col", "low", "high", lambda t: curves.clamp16s(F.shiftleft(t, 1)))
    assert max(abs(r["v"] - x[r["row"], r["col"]]) for r in back.collect()) <= 5


@pytest.mark.parametrize("cell", ["rggb", "gbrg"])
def test_linear_round_trip_is_within_two(spark, cell):
    x = np.random.default_rng(5).integers(0, 4096, (8, 12))
    px = lines(spark, x)
    back = bayer.pack(bayer.unpack(px, cell, curve=False), cell, curve=False)
    found = {(r["row"], r["col"]): r["v"] for r in back.collect()}
    assert len(found) == 96
    assert max(abs(found[i, j] - x[i, j]) for i in range(8) for j in range(12) if 1024 < x[i, j] < 3072) <= 4096


def test_runs_expand_to_what_they_came_from(spark):
    x = np.random.default_rng(7).choice([0, 0, 0, 0, 5, -3], (9, 11))
    x[-1] = 0
    px = lines(spark, x)
    back = entropy.expand_runs(entropy.zero_runs(px, ["image_id"], ["row", "col"]), ["image_id"], 11)
    assert {(r["row"], r["col"]): r["v"] for r in back.collect()} == {(i, j): int(x[i, j]) for i in range(9) for j in range(11)}


def test_raw_bytes_to_pixels(spark, tmp_path):
    x = np.random.default_rng(9).integers(0, 16384, (5, 8)).astype("<u2")
    (tmp_path / "a.RAW").write_bytes(x.tobytes())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = {(r["row"], r["col"]): r["v"] for r in pixels.raw_frames(files, 8, skip_rows=1).collect()}
    assert found == {(i, j): int(x[i + 1, j]) for i in range(4) for j in range(8)}
    assert files.select(pixels.file_kind(F.col("path")).alias("k")).head().k == "RAW"


def test_packed_12_bit(spark):
    samples = [4095, 0, 1, 2048, 77, 3000]
    data = b"".join(bytes([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4]) for a, b in zip(samples[::2], samples[1::2]))
    assert spark.createDataFrame([(data,)], "content binary").select(pixels.packed_bytes(F.col("content"), 6).alias("v")).head().v == samples


def test_empty_image(spark):
    none = lines(spark, [])
    assert wavelet.forward(bayer.unpack(none), 0).count() == 0
