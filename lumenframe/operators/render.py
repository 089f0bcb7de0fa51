"""Rendering steps as column expressions: white balance and matrices, tone and gamma curves, hue, noise, warps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.curves import horner


def pin(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1.0 / 2.4)) - 0.055)


def srgb_decode(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def gamma_encode(x: Column, gamma: float) -> Column:
    return F.pow(x, F.lit(1.0 / gamma))


def exposure_ramp(x: Column, black: float, white: float, soft: float) -> Column:
    """0 up to black, linear to white, with a quadratic toe of width `soft` around black."""
    slope = 1.0 / (white - black)
    toe = slope / (4.0 * soft) * (x - (black - soft)) * (x - (black - soft))
    return pin(F.when(x <= black - soft, F.lit(0.0)).when(x >= black + soft, (x - black) * slope).otherwise(toe))


def matrix3(r: Column, g: Column, b: Column, m: list[float]) -> list[Column]:
    return [r * F.lit(m[3 * i]) + g * F.lit(m[3 * i + 1]) + b * F.lit(m[3 * i + 2]) for i in range(3)]


def balanced(r: Column, g: Column, b: Column, gains: tuple[float, float, float], m: list[float]) -> list[Column]:
    """White-balance gains, clipped at 1, then the matrix, pinned."""
    scaled = [F.least(F.lit(1.0), x * F.lit(k)) for x, k in zip((r, g, b), gains, strict=True)]
    return [pin(x) for x in matrix3(*scaled, m)]


def hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue 0..6, saturation and value 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    gap = top - low
    hue = F.when(gap == 0, F.lit(0.0)).when(r == top, (g - b) / gap + F.when(g < b, 6.0).otherwise(0.0)).when(g == top, 2.0 + (b - r) / gap).otherwise(4.0 + (r - g) / gap)
    return [hue, F.when(top > 0, gap / top).otherwise(F.lit(0.0)), top]


def noise_sigma(x: Column, scale: float, offset: float) -> Column:
    return F.sqrt(x * F.lit(scale) + F.lit(offset))


def lerp_maps(a: Column, b: Column, weight: float) -> Column:
    """Element-wise interpolation of two tables of one length."""
    return F.zip_with(a, b, lambda x, y: x + (y - x) * F.lit(weight))


def warp_nearest(pixels: DataFrame, center: tuple[float, float], radius: float, k: list[float]) -> DataFrame:
    """Radial warp: each sample of the result from the nearest source place at r * (k0 + k1 r2 + k2 r2^2 + ...).

    The source place is computed from the target's, so the gather is an equi-join on (row, col); places outside are left out.
    """
    target = pixels.select("image_id", "row", "col")
    dr, dc = (F.col("row") - F.lit(center[0])) / F.lit(radius), (F.col("col") - F.lit(center[1])) / F.lit(radius)
    ratio = horner(dr * dr + dc * dc, k)
    exact = target.select("image_id", "row", "col", (F.lit(center[0]) + dr * ratio * radius + 0.5).alias("sr"), (F.lit(center[1]) + dc * ratio * radius + 0.5).alias("sc"))
    inside = lambda x: (F.col(x) >= 0.0) & (F.col(x) < 2.0**31)  # noqa: E731 (far places have no INT)
    at = exact.where(inside("sr") & inside("sc")).select("image_id", "row", "col", *[F.when(inside(x), F.floor(x)).cast("int").alias(x) for x in ("sr", "sc")])
    source = pixels.select("image_id", F.col("row").alias("sr"), F.col("col").alias("sc"), "v")
    return at.join(source, ["image_id", "sr", "sc"]).select("image_id", "row", "col", "v")


PARTS = 128  # places between two samples that a warp can take from
TILE = 256  # lines and columns of a result that are gathered together
FAR = 2.0**40  # in 1 / PARTS samples, beyond the edges of any image: rows are INT


def warp_places(pixels: DataFrame, center: tuple[float, float], radius: float, radial: list[float], tangential: tuple[float, float] = (0.0, 0.0), fisheye: bool = False) -> DataFrame:
    """(image_id, row, col, sr, sc): for each sample of the result its source place in 1 / PARTS samples, BIGINT, pinned to -FAR..FAR.

    Rectilinear: the distance times k0 + k1 r2 + k2 r2^2 + k3 r2^3, and tangential terms. Fisheye: k0 t + k1 t^3 + k2 t^5 + k3 t^7 for the angle t = atan(r).
    """
    y, x = (F.col("row") - F.lit(center[0])) / F.lit(radius), (F.col("col") - F.lit(center[1])) / F.lit(radius)
    r2 = x * x + y * y
    if fisheye:
        r = F.sqrt(r2)
        t = F.atan(r)
        ratio = F.when(r > 0, t * horner(t * t, radial) / r).otherwise(F.lit(radial[0]))
    else:
        ratio = horner(r2, radial)
    k0, k1 = tangential
    dy = ratio * y + F.lit(k0) * (r2 + 2.0 * y * y) + F.lit(2.0 * k1) * (x * y)
    dx = ratio * x + F.lit(2.0 * k0) * (x * y) + F.lit(k1) * (r2 + 2.0 * x * x)
    place = lambda c, d: F.floor(F.least(F.lit(FAR), F.greatest(F.lit(-FAR), (F.lit(c) + d * F.lit(radius)) * F.lit(float(PARTS)) + 0.5)))
    return pixels.select("image_id", "row", "col", place(center[0], dy).alias("sr"), place(center[1], dx).alias("sc"))


def _near(place: str, n: int) -> Column:
    """The sample before a place along a side of n; beyond the edges -2 or n, where all four taps are the edge's sample already."""
    return F.least(F.lit(n), F.greatest(F.lit(-2), F.floor(F.col(place) / PARTS))).cast("int")


def _tap_weights() -> np.ndarray:
    """(PARTS, 4): weights of 1/1024 of the four samples around each place between two; stage.cubic_weight in numpy."""
    d = np.abs(np.arange(PARTS)[:, None] / float(PARTS) - np.arange(-1, 3))
    near, far = ((1.25 * d - 2.25) * d) * d + 1.0, ((-0.75 * d + 3.75) * d - 6.0) * d + 3.0
    return np.floor(np.where(d < 1, near, np.where(d < 2, far, 0.0)) * 1024.0 + 0.5).astype(np.int64)


def _columns(rows) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in rows.columns] if isinstance(rows, pa.RecordBatch) else [c.to_numpy().astype(np.int64) for c in rows.columns]


def _asked(height: int, width: int):
    """Rows (image_id, tile_row, tile_col, r, c) to the samples (gr, gc) that their taps need: each once a tile and batch, asked being the batch's own number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taps = np.arange(-1, 3)
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            image, tile_row, tile_col, r, c = _columns(batch)
            order = np.lexsort((tile_col, tile_row, image))
            image, tile_row, tile_col, r, c = (x[order] for x in (image, tile_row, tile_col, r, c))
            starts = np.flatnonzero(np.r_[True, (image[1:] != image[:-1]) | (tile_row[1:] != tile_row[:-1]) | (tile_col[1:] != tile_col[:-1])])
            for first, end in zip(starts, [*starts[1:], len(r)], strict=True):
                at = np.unique((r[first:end] + 2) * (width + 3) + c[first:end] + 2)
                gr = np.clip((at // (width + 3) - 2)[:, None] + taps, 0, height - 1)
                gc = np.clip((at % (width + 3) - 2)[:, None] + taps, 0, width - 1)
                need = np.unique(gr[:, :, None] * width + gc[:, None, :])
                same = lambda x, kind, n=len(need): pa.array(np.full(n, x, kind))
                yield pa.RecordBatch.from_arrays(
                    [same(image[first], np.int32), same(tile_row[first], np.int32), same(tile_col[first], np.int32), pa.array((need // width).astype(np.int32)), pa.array((need % width).astype(np.int32)), same((TaskContext.get().partitionId() << 32) + number, np.int64)],
                    ["image_id", "tile_row", "tile_col", "gr", "gc", "asked"],
                )

    return run


def _gathered(height: int, width: int):
    """Places of a tile (image_id, tile_row, tile_col, row, col, r, c, pr, pc) and samples that it asked for (.., gr, gc, asked, v) to weighted sums."""

    def run(places: pa.Table, samples: pa.Table) -> pa.Table:
        weights = _tap_weights()
        _, _, _, row, col, r, c, pr, pc = _columns(places)
        _, _, _, gr, gc, asked, v = _columns(samples)
        once = np.unique(row * (1 << 31) + col, return_index=True)[1]
        row, col, r, c, pr, pc = (x[once] for x in (row, col, r, c, pr, pc))
        key = gr * width + gc
        order = np.lexsort((asked, key))
        key, asked, v = key[order], asked[order], v[order]
        have, first, at = np.unique(key, return_index=True, return_inverse=True)
        own = asked == asked[first][at] if len(key) else np.zeros(0, bool)  # several batches may have asked for a sample
        total, count = (np.bincount(at[own], weights=x, minlength=len(have)).astype(np.int64) for x in (v[own], None))
        s, w, met = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), bool)
        for i in range(4) if len(have) else ():
            line = np.clip(r + (i - 1), 0, height - 1) * width
            for j in range(4):
                need = line + np.clip(c + (j - 1), 0, width - 1)
                k = np.minimum(np.searchsorted(have, need), len(have) - 1)
                there, weight = have[k] == need, weights[pr, i] * weights[pc, j]
                s += np.where(there, weight * total[k], 0)
                w += np.where(there, weight * count[k], 0)
                met |= there
        image = np.full(int(met.sum()), places.column(0)[0].as_py() if len(row) else 0, np.int32)
        return pa.table({"image_id": image, "row": row[met].astype(np.int32), "col": col[met].astype(np.int32), "s": s[met], "w": w[met]})

    return run


def gather_bicubic(pixels: DataFrame, places: DataFrame, height: int, width: int) -> DataFrame:
    """The samples at places of warp_places(), bicubic over 4 x 4 neighbours with weights of 1/1024; beyond an edge its nearest sample counts.

    The result is made in tiles of TILE x TILE. A tile asks for each sample that it needs once, however many of its places
    share it: where a warp takes most of its places from a few samples, a sample is sent to tiles, not to places. A task holds one tile.
    """
    tile = lambda x: F.floor(F.col(x) / TILE).cast("int")
    at = places.select("image_id", tile("row").alias("tile_row"), tile("col").alias("tile_col"), "row", "col", _near("sr", height).alias("r"), _near("sc", width).alias("c"), F.pmod("sr", F.lit(PARTS)).cast("int").alias("pr"), F.pmod("sc", F.lit(PARTS)).cast("int").alias("pc"))
    asked = at.select("image_id", "tile_row", "tile_col", "r", "c").mapInArrow(_asked(height, width), "image_id int, tile_row int, tile_col int, gr int, gc int, asked bigint")
    source = pixels.select("image_id", F.col("row").alias("gr"), F.col("col").alias("gc"), "v")
    samples = asked.join(source.hint("merge"), ["image_id", "gr", "gc"]).select("image_id", "tile_row", "tile_col", "gr", "gc", "asked", "v")
    keys = ["image_id", "tile_row", "tile_col"]
    sums = at.groupBy(*keys).cogroup(samples.groupBy(*keys)).applyInArrow(_gathered(height, width), "image_id int, row int, col int, s bigint, w bigint")
    value = F.floor((F.col("s") * 2 + F.col("w")) / (F.col("w") * 2))
    return sums.select("image_id", "row", "col", F.least(F.lit(4095), F.greatest(F.lit(0), value)).alias("v"))


def replicated_edges(pixels: DataFrame, height: int, width: int, border: int) -> DataFrame:
    """Images of one size: the image with `border` more samples on every side, each a copy of the nearest inside: only edge samples are multiplied."""
    def reach(x: str, n: int) -> Column:
        i = F.col(x)
        return F.when(i == 0, F.sequence(F.lit(-border), F.lit(0))).when(i == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + border))).otherwise(F.array(i))

    tall = pixels.select("image_id", "col", "v", F.explode(reach("row", height)).alias("row"))
    return tall.select("image_id", "row", "v", F.explode(reach("col", width)).alias("col")).select("image_id", "row", "col", "v")


def inverse_table(spark, values: list[int], wanted, one: int = 1024) -> DataFrame:
    """(y, x): where a rising function given at 0, 1, 2, ... takes the wanted values, in units of 1 / one, between two given points by a line; beyond the last point, that point."""
    last = len(values) - 1
    ys = F.lit(values)
    rows = spark.createDataFrame([(int(y),) for y in wanted], "y bigint")
    at = rows.withColumn("i", F.size(F.filter(ys, lambda v: v <= F.col("y"))) - 1)
    low, high = F.element_at(ys, F.col("i") + 1), F.element_at(ys, F.least(F.col("i") + 2, F.lit(last + 1)))
    return at.where("i >= 0").select("y", low.alias("a"), high.alias("b"), "i").select("y", F.expr(f"i * {one} + case when i < {last} then (y - a) * {one} div (b - a) else 0 end").alias("x"))
