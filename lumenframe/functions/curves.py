"""Exact integer formulas as column expressions: computed in INT or wider, narrowed last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIDPOINT = 2048


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def clamp12(x: Column) -> Column:
    return clamp(x, 0, 4095)


def clamp16s(x: Column) -> Column:
    return clamp(x, -32768, 32767)


def sar(x: Column, n: int) -> Column:
    return F.shiftright(x, n) if n else x


def log_encode(v: Column) -> Column:
    """12-bit linear to 12-bit log."""
    return (F.lit(4095.0) * F.log10(v / F.lit(4095.0) * 112.0 + 1.0) / F.log10(F.lit(113.0))).cast("int")


def log_decode(v: Column) -> Column:
    """12-bit log to 16-bit linear; goes through FLOAT, which decides two of the 4096 values."""
    return F.least(F.lit(65535), (65535.0 * (F.pow(F.lit(113.0), v / F.lit(4095.0)) - 1.0) / 112.0).cast("float").cast("int"))


def unpacked12(b0: Column, b1: Column, b2: Column) -> tuple[Column, Column]:
    """The two 12-bit samples of three bytes."""
    return b0 + F.shiftleft(b1.bitwiseAND(F.lit(15)), 8), F.shiftleft(b2, 4) + F.shiftright(b1, 4)


def uncompand(v: Column) -> Column:
    m = F.abs(v)
    return F.signum(v).cast("int") * (m + (m.cast("double") * m * m * 768.0 / 16581375.0).cast("int"))


def legacy_compand(v: Column) -> Column:
    m = F.abs(v)
    once = F.when(m < 40, m).otherwise(F.lit(40) + F.shiftright(m - 38, 2))
    twice = F.when(once < 54, once).otherwise(F.lit(54) + F.shiftright(once - 52, 2))
    return F.when(v < 0, -twice).otherwise(twice)


def quantize(v: Column, mid: Column, mult: Column) -> Column:
    return F.signum(v).cast("int") * F.shiftright((F.abs(v) + mid) * mult, 16)


def horner(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(float(c)), reversed(coefficients[:-1]), F.lit(float(coefficients[-1])))


def pairs(first: str, second: str, *items: tuple[Column, Column]) -> Column:
    """Array of structs of two fields."""
    return F.array(*[F.struct(a.alias(first), b.alias(second)) for a, b in items])


def curve_table(spark: SparkSession, expression, name: str) -> DataFrame:
    """4096 rows (i, name): a lookup table of fixed size, small enough to broadcast by construction."""
    return spark.range(4096).select(F.col("id").cast("int").alias("i")).withColumn(name, expression(F.col("i")))


def inverse_companding(spark: SparkSession) -> DataFrame:
    """(i, m): slot i of 0..1023 holds the greatest magnitude 0..255 whose uncompanded value is at most i."""
    from pyspark.sql import Window

    m = spark.range(256).select(F.col("id").cast("int").alias("m"))
    slots = m.select(F.least(F.lit(1023), uncompand(F.col("m"))).alias("i"), "m").groupBy("i").agg(F.max("m").alias("m"))
    every = spark.range(1024).select(F.col("id").cast("int").alias("i")).join(slots, "i", "left")
    return every.select("i", F.last("m", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("i")).alias("m"))
