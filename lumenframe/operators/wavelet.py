"""The 2/6 wavelet as window functions, exact in integers.

Long form: one row a coefficient. Each pass partitions by image, channel and the line that it runs
along, so a pass costs one shuffle by line and lines never exceed an image side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import arrays
from lumenframe.functions.curves import clamp, clamp16s, pairs, quantize, sar, uncompand

PRESCALE = (0, 2, 2)
# Quantizers of subbands 0..9, by quality.
QUANTIZERS = {
    "low": (1, 24, 24, 12, 64, 64, 48, 512, 512, 768),
    "medium": (1, 24, 24, 12, 48, 48, 32, 256, 256, 384),
    "high": (1, 24, 24, 12, 32, 32, 24, 128, 128, 192),
    "fs1": (1, 24, 24, 12, 24, 24, 12, 96, 96, 144),
    "fsx": (1, 24, 24, 12, 24, 24, 12, 64, 64, 96),
    "fs2": (1, 24, 24, 12, 24, 24, 12, 32, 32, 48),
}
# Level and band of subbands 0..9.
SUBBANDS = ((2, 0), (2, 1), (2, 2), (2, 3), (1, 1), (1, 2), (1, 3), (0, 1), (0, 2), (0, 3))


def forward_line(rows: DataFrame, keys: list[str], along: str, value: str, prescale: int, low: str, high: str) -> DataFrame:
    """Each line (keys) of `value`, ordered by `along`, to half as many (keys, along, low, high)."""
    line = Window.partitionBy(*keys).orderBy(along)
    whole = Window.partitionBy(*keys)
    r = (1 << prescale) - 1
    x = F.col(value)
    at = {0: x} | {-k: F.lag(x, k).over(line) for k in range(1, 5)}
    last = F.max_by(value, along).over(whole)
    at |= {k: F.coalesce(F.lead(x, k).over(line), last) for k in range(1, 6)}
    taps = rows.select(*keys, along, *[v.alias(f"x{k}".replace("-", "m")) for k, v in at.items()], (F.max(along).over(whole) + 1).alias("n"))
    p = {k: sar(F.col(f"x{k}".replace("-", "m")) + r, prescale) for k in at}
    first = 5 * p[0] - 11 * p[1] + 4 * p[2] + 4 * p[3] - p[4] - p[5]
    final = p[-4] + p[-3] - 4 * p[-2] - 4 * p[-1] + 11 * p[0] - 5 * p[1]
    inner = -p[-2] - p[-1] + 8 * p[0] - 8 * p[1] + p[2] + p[3]
    chosen = F.when(F.col(along) == 0, first).when(F.col(along) >= F.col("n") - 2, final).otherwise(inner)
    return taps.where(F.col(along) % 2 == 0).select(
        *keys, sar(F.col(along), 1).alias(along), sar(F.col("x0") + F.col("x1") + r, prescale).alias(low), F.shiftright(chosen + 4, 3).alias(high)
    )


def forward(planes: DataFrame, prescale: int) -> DataFrame:
    """(image_id, channel, row, col, v) to (image_id, channel, band, row, col, v): bands 0=LL 1=LH 2=HL 3=HH."""
    halves = forward_line(planes, ["image_id", "channel", "row"], "col", "v", prescale, "l", "h")
    both = halves.select("image_id", "channel", "row", "col", F.explode(pairs("half", "v", (F.lit(0), F.col("l")), (F.lit(1), F.col("h")))).alias("x"))
    both = both.select("image_id", "channel", "x.half", "row", "col", "x.v")
    done = forward_line(both, ["image_id", "channel", "half", "col"], "row", "v", 0, "l", "h")
    bands = pairs("band", "v", (F.col("half"), F.col("l")), (F.col("half") + 2, F.col("h")))
    return done.select("image_id", "channel", "row", "col", F.explode(bands).alias("x")).select("image_id", "channel", "x.band", "row", "col", "x.v")


def lowpass(cells: DataFrame, prescale: int, values: list[str]) -> DataFrame:
    """LL of one level from (image_id, row, col, values): sums of 2x2 cells, without the bands that a preview doesn't show.

    One aggregation, combined on the map side, of a quarter of the rows; an odd side repeats its last sample.
    """
    r = (1 << prescale) - 1
    place = lambda v, i, j: F.max(F.when((F.col("row") % 2 == i) & (F.col("col") % 2 == j), F.col(v)))
    taps = [place(v, i, j).alias(f"{v}{i}{j}") for v in values for i in (0, 1) for j in (0, 1)]
    found = cells.groupBy("image_id", sar(F.col("row"), 1).alias("r0"), sar(F.col("col"), 1).alias("c0")).agg(*taps)

    def line(v: str, i: int) -> Column:
        left = F.col(f"{v}{i}0")
        return sar(left + F.coalesce(F.col(f"{v}{i}1"), left) + r, prescale)

    low = lambda v: (line(v, 0) + F.coalesce(line(v, 1), line(v, 0))).alias(v)
    return found.select("image_id", F.col("r0").alias("row"), F.col("c0").alias("col"), *[low(v) for v in values])


LINES = 512  # of a plane that are transformed together: a multiple of what one line of the lowest level stands for


def _margin(levels: int) -> int:
    """Lines above and below a part that its coefficients can reach: four lines of the lowest level's input at an edge, and as many again."""
    return 8 << (levels - 1)


def _parts(batches: Iterator[pa.RecordBatch], margin: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """Rows sorted by (image_id, channel, part, row, col) to image, channel, first line of the part, first line held and samples, one part with its margins at a time."""
    held: list[np.ndarray] = []

    def part() -> Iterator[tuple[int, int, int, int, np.ndarray]]:
        rows = np.concatenate(held)
        held.clear()
        start, last = int(rows[0, 2]) * LINES, int(rows[-1, 3])
        if last < start:  # the image ends in the part before
            return
        first = max(0, start - margin)
        h, w = last + 1 - first, int(rows[:, 4].max()) + 1
        if len(rows) != h * w or rows[0, 3] != first:
            raise ValueError(f"channel {rows[0, 1]} of image {rows[0, 0]} has {len(rows)} samples, not {h} x {w}, from line {first}")
        yield int(rows[0, 0]), int(rows[0, 1]), start, first, rows[:, 5].reshape(h, w)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(rows):
            continue
        for own in np.split(rows, np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1):
            if held and (held[-1][-1, :3] != own[0, :3]).any():
                yield from part()
            held.append(own)
    if held:
        yield from part()


def _transformed(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image, channel, start, first, plane in _parts(batches, _margin(levels)):
            for level in range(levels):
                bands = arrays.forward_2d(plane, PRESCALE[level])
                plane = bands[0]
                top, own = start >> (level + 1), (start - first) >> (level + 1)
                for band in range(0 if level == levels - 1 else 1, 4):
                    v = bands[band][own : own + (LINES >> (level + 1))]  # a margin's coefficients are its own part's
                    row, col = (x.ravel().astype(np.int32) for x in np.indices(v.shape))
                    same = lambda x, n=v.size: pa.array(np.full(n, x, np.int32))
                    yield pa.RecordBatch.from_arrays([same(image), same(channel), same(level), same(band), pa.array(row + np.int32(top)), pa.array(col), pa.array(v.ravel().astype(np.int32))], ["image_id", "channel", "level", "band", "row", "col", "v"])

    return run


def pyramid(planes: DataFrame, levels: int = 3) -> DataFrame:
    """(image_id, channel, level, band, row, col, v): all bands of `levels` levels; the lowest level's LL only.

    One exchange by image, channel and part of LINES lines, then all levels of a part in one Arrow function: as windows
    (forward()), every level would cost two exchanges more and be computed again for each band above it.
    A coefficient reaches a few lines up and down, so a part is sent with the margins that it needs of its neighbours.
    A task holds one part, whatever the height; images of whole rectangles of at least six samples a side at every level.
    """
    part, at, margin = F.floor(F.col("row") / LINES).cast("int"), F.col("row") % LINES, _margin(levels)
    near = F.when((at < margin) & (part > 0), F.array(part - 1, part)).when(at >= LINES - margin, F.array(part, part + 1)).otherwise(F.array(part))
    rows = planes.select("image_id", "channel", F.explode(near).alias("part"), "row", "col", "v").repartition("image_id", "channel", "part")
    return rows.sortWithinPartitions("image_id", "channel", "part", "row", "col").mapInArrow(_transformed(levels), "image_id int, channel int, level int, band int, row int, col int, v int")


def midpoint(q: int, correction: int = 2) -> int:
    """What is added before quantizing: half of q less one for the correction 2, q / correction for 3 to 8, else nothing."""
    if correction == 2:
        return max(0, (q >> 1) - 1)
    return q // correction if 2 < correction < 9 else 0


def quantizer_table(spark: SparkSession, quality: str = "fs1") -> DataFrame:
    """(subband, level, band, q, mid, mult): ten rows."""
    rows = [(i, *SUBBANDS[i], q, midpoint(q), 65536 // q) for i, q in enumerate(QUANTIZERS[quality])]
    return spark.createDataFrame(rows, "subband int, level int, band int, q int, mid int, mult int")


def quantized(bands: DataFrame, quality: str = "fs1") -> DataFrame:
    table = F.broadcast(quantizer_table(bands.sparkSession, quality))  # ten rows
    return bands.join(table, ["level", "band"]).select("image_id", "channel", "subband", "level", "band", "row", "col", quantize(F.col("v"), F.col("mid"), F.col("mult")).alias("v"))


def dequantized(bands: DataFrame, quality: str = "fs1", companded: bool = True) -> DataFrame:
    table = F.broadcast(quantizer_table(bands.sparkSession, quality).select("subband", "q"))
    value = uncompand(F.col("v")) if companded else F.col("v")
    value = F.when(F.col("subband") == 0, F.col("v")).otherwise(clamp16s(value * F.col("q")))
    return bands.join(table, "subband").select("image_id", "channel", "subband", "level", "band", "row", "col", value.alias("v"))


def inverse_line(rows: DataFrame, keys: list[str], along: str, low: str, high: str, finish, out: str = "v") -> DataFrame:
    """Low and high of each line back to twice as many samples; finish: the last shift and clamp."""
    line, whole = Window.partitionBy(*keys).orderBy(along), Window.partitionBy(*keys)
    x, h = F.col(low), F.col(high)
    lag, lead = (lambda k: F.lag(x, k).over(line)), (lambda k: F.lead(x, k).over(line))
    taps = rows.select(*keys, along, x.alias("x0"), h.alias("h"), lag(1).alias("m1"), lag(2).alias("m2"), lead(1).alias("p1"), lead(2).alias("p2"), F.max(along).over(whole).alias("top"))
    c = {k: F.col(k) for k in ("x0", "h", "m1", "m2", "p1", "p2")}
    third = lambda t: F.shiftright(t + 4, 3)
    first = (third(11 * c["x0"] - 4 * c["p1"] + c["p2"]) + c["h"], third(5 * c["x0"] + 4 * c["p1"] - c["p2"]) - c["h"])
    final = (third(5 * c["x0"] + 4 * c["m1"] - c["m2"]) + c["h"], third(11 * c["x0"] - 4 * c["m1"] + c["m2"]) - c["h"])
    inner = (third(c["m1"] - c["p1"]) + c["x0"] + c["h"], third(c["p1"] - c["m1"]) + c["x0"] - c["h"])
    pick = lambda i: F.when(F.col(along) == 0, first[i]).when(F.col(along) == F.col("top"), final[i]).otherwise(inner[i])
    pair = pairs("k", "v", (F.col(along) * 2, finish(pick(0))), (F.col(along) * 2 + 1, finish(pick(1))))
    return taps.select(*keys, F.explode(pair).alias("s")).select(*keys, F.col("s.k").alias(along), F.col("s.v").alias(out))


def inverse(bands: DataFrame, prescale: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """(image_id, channel, band, row, col, v) of one level to (image_id, channel, row, col, v); an odd side is cut to size."""
    at = lambda b: F.max(F.when(F.col("band") == b, F.col("v")))
    cells = bands.groupBy("image_id", "channel", "row", "col").agg(at(0).alias("ll"), at(1).alias("lh"), at(2).alias("hl"), at(3).alias("hh"))
    both = [(0, "ll", "hl"), (1, "lh", "hh")]
    halves = F.array(*[F.struct(F.lit(i).alias("half"), F.col(a).alias("l"), F.col(b).alias("h")) for i, a, b in both])
    columns = cells.select("image_id", "channel", "row", "col", F.explode(halves).alias("x")).select("image_id", "channel", "x.half", "row", "col", "x.l", "x.h")
    upright = inverse_line(columns, ["image_id", "channel", "half", "col"], "row", "l", "h", lambda t: clamp16s(F.shiftright(t, 1)))
    if height is not None:
        upright = upright.where(F.col("row") < height)
    lines = upright.groupBy("image_id", "channel", "row", "col").agg(F.max(F.when(F.col("half") == 0, F.col("v"))).alias("l"), F.max(F.when(F.col("half") == 1, F.col("v"))).alias("h"))
    finish = (lambda t: clamp16s(F.shiftleft(t, 1))) if prescale == 2 else (lambda t: clamp(F.shiftright(t, 1), 0, 16383))
    out = inverse_line(lines, ["image_id", "channel", "row"], "col", "l", "h", finish)
    return out if width is None else out.where(F.col("col") < width)
