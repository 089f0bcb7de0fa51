"""Bayer cells to colour-difference planes and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.curves import MIDPOINT, clamp12, log_decode, log_encode, pairs, sar

#: Where red, the two greens and blue stand in a 2x2 cell, as (row, column).
CELLS = {"rggb": {"r": (0, 0), "g1": (0, 1), "g2": (1, 0), "b": (1, 1)}, "gbrg": {"g1": (0, 0), "b": (0, 1), "r": (1, 0), "g2": (1, 1)}}


def unpack(pixels: DataFrame, cell: str = "rggb", curve: bool = True, bits: int = 12) -> DataFrame:
    """(image_id, channel, row, col, v): channels 0=GS 1=RG 2=BG 3=GD of half size. A trailing odd row or column is left out; samples of more than 12 bits lose the lowest."""
    level = sar(F.col("v"), bits - 12)
    value = log_encode(level) if curve else level
    at = lambda place: F.max(F.when((F.col("row") % 2 == place[0]) & (F.col("col") % 2 == place[1]), F.col("lv")))
    cells = (
        pixels.select("image_id", "row", "col", value.alias("lv"))
        .groupBy("image_id", sar(F.col("row"), 1).alias("r0"), sar(F.col("col"), 1).alias("c0"))
        .agg(*[at(p).alias(k) for k, p in CELLS[cell].items()])
        .where("r is not null and g1 is not null and g2 is not null and b is not null")
        .withColumn("gs", F.shiftright(F.col("g1") + F.col("g2"), 1))
    )
    half = lambda x: clamp12(F.shiftright(x + 2 * MIDPOINT, 1))
    planes = pairs("channel", "v", (F.lit(0), F.col("gs")), (F.lit(1), half(F.col("r") - F.col("gs"))), (F.lit(2), half(F.col("b") - F.col("gs"))), (F.lit(3), half(F.col("g1") - F.col("g2"))))
    return cells.select("image_id", F.col("r0").alias("row"), F.col("c0").alias("col"), F.explode(planes).alias("p")).select("image_id", "p.channel", "row", "col", "p.v")


def pack(planes: DataFrame, cell: str = "rggb", bits: int = 16, curve: bool = True) -> DataFrame:
    """(image_id, row, col, v): the four planes back to Bayer samples of the given width."""
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("v")))
    cells = planes.groupBy("image_id", "row", "col").agg(at(0).alias("gs"), at(1).alias("rg"), at(2).alias("bg"), at(3).alias("gd"))
    rg, bg, gd, gs = (F.col("rg") - MIDPOINT, F.col("bg") - MIDPOINT, F.col("gd") - MIDPOINT, F.col("gs"))
    level = {"r": 2 * rg + gs, "b": 2 * bg + gs, "g1": gs + gd, "g2": gs - gd}
    out = lambda x: F.shiftright(log_decode(clamp12(x)), 16 - bits) if curve else clamp12(x)
    taps = F.array(*[F.struct(F.lit(p[0]).alias("dr"), F.lit(p[1]).alias("dc"), out(level[k]).alias("v")) for k, p in CELLS[cell].items()])
    return cells.select("image_id", "row", "col", F.explode(taps).alias("t")).select(
        "image_id", (F.col("row") * 2 + F.col("t.dr")).alias("row"), (F.col("col") * 2 + F.col("t.dc")).alias("col"), "t.v"
    )


# The gains of red, green and blue, as numerator and power of two under it.
GAINS = ((30, 4), (1, 0), (7, 2))


def wide(planes: DataFrame) -> DataFrame:
    """(image_id, row, col, gs, rg, bg): the three planes that a preview shows, one row a place."""
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("v")))
    return planes.where("channel < 3").groupBy("image_id", "row", "col").agg(at(0).alias("gs"), at(1).alias("rg"), at(2).alias("bg"))


def preview(cells: DataFrame, precision: int, width: int, bits: int = 8, gains: tuple = GAINS) -> DataFrame:
    """(image_id, row, col, r, g, b) of wide() planes of that precision (12: whole planes, 14: lowpass): mirrored columns, as the format's previews are.

    Colours are added first and shifted to 12 bits after. 8 bits: gain, then square root; 16 bits: without gain, bytes swapped.
    """
    middle, g = 1 << (precision - 1), F.col("gs")
    levels = {"r": 2 * (F.col("rg") - middle) + g, "g": g, "b": 2 * (F.col("bg") - middle) + g}

    def shown(x, gain):
        linear = log_decode(clamp12(sar(x, precision - 12)))
        if bits == 16:
            return F.shiftleft(linear.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(linear, 8))
        return F.least(F.lit(255), F.sqrt(F.shiftright(linear * gain[0], gain[1]).cast("double")).cast("int"))

    return cells.select("image_id", "row", (F.lit(width - 1) - F.col("col")).alias("col"), *[shown(x, k).alias(n) for (n, x), k in zip(levels.items(), gains, strict=True)])
