"""Pixel relations: (image_id, row, col, v), one row a sample; partitioned work keys on image_id first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import arrays


def matrix_pixels(rows: DataFrame, row_col: str, values_col: str, image_id: int = 0) -> DataFrame:
    """A table of value arrays as a 12-bit image: row_col is the row, the array position the column; values -1..1."""
    level = F.least(F.lit(4095), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 1.0) * 2048.0).cast("int")))
    return rows.select(F.col(row_col).cast("int").alias("row"), F.posexplode(values_col).alias("col", "e")).select(
        F.lit(image_id).alias("image_id"), "row", "col", level.alias("v")
    )


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_pixels(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def packed_bytes(content, width: int):
    """12-bit packed samples of a binary column as an array of ints: three bytes hold two samples."""
    at = lambda i: F.conv(F.hex(F.substring(content, i + F.lit(1), F.lit(1))), 16, 10).cast("int")
    pair = F.sequence(F.lit(0), F.floor(F.octet_length(content) / 3).cast("int") - 1)
    both = F.transform(pair, lambda k: F.array(at(k * 3) + F.shiftleft(at(k * 3 + 1).bitwiseAND(F.lit(15)), 8), F.shiftleft(at(k * 3 + 2), 4) + F.shiftright(at(k * 3 + 1), 4)))
    return F.slice(F.flatten(both), 1, width)


def raw_frames(files: DataFrame, width: int, skip_rows: int = 0, pixel_format: str = "rggb16") -> DataFrame:
    """Rows of a binaryFile scan (path, content) holding little-endian 16-bit samples, or 12-bit packed ones (formats that end in p), as (path, row, col, v).

    A file's bytes are read in place, a band of lines at a time; a trailing part of a line is left out. Null content gives no rows.
    """
    packed = pixel_format.endswith("p")
    pitch = width * 3 // 2 if packed else 2 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer() if content.is_valid else b""
                lines = len(data) // pitch
                step = max(1, (1 << 20) // width)
                for first in range(skip_rows, lines, step):
                    n = min(step, lines - first)
                    part = data[first * pitch : (first + n) * pitch]
                    v = arrays.unpack_bits(part) if packed else np.frombuffer(part, "<u2")
                    rows = np.repeat(np.arange(first - skip_rows, first - skip_rows + n, dtype=np.int32), width)
                    yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n * width, np.int32))), pa.array(rows), pa.array(np.tile(np.arange(width, dtype=np.int32), n)), pa.array(v.astype(np.int32))], ["path", "row", "col", "v"])

    return files.select("path", "content").mapInArrow(run, "path string, row int, col int, v int")


def tiles(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """pixels with the tile that holds each sample and its place there: (tile_row, tile_col, row_in, col_in)."""
    return pixels.withColumns({"tile_row": F.floor(F.col("row") / height), "tile_col": F.floor(F.col("col") / width), "row_in": F.col("row") % height, "col_in": F.col("col") % width})


def file_kind(path, kinds: tuple[str, ...] = ("raw", "dng", "ppm", "jpg", "vc5")):
    """The suffix in capitals if it is one of `kinds`, any case; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(suffix.isin(*kinds), F.upper(suffix))
