"""Zero runs, code lengths and their inverses as gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def zero_runs(rows: DataFrame, keys: list[str], order: list[str], value: str = "v") -> DataFrame:
    """(keys, seq, zeros, value): each non-zero value with the zeros before it in reading order; a last run without a value has value 0."""
    reading = Window.partitionBy(*keys).orderBy(*order)
    before = reading.rowsBetween(Window.unboundedPreceding, -1)
    seq = F.coalesce(F.sum(F.when(F.col(value) != 0, 1).otherwise(0)).over(before), F.lit(0).cast("bigint"))
    return (
        rows.withColumn("seq", seq)
        .groupBy(*keys, "seq")
        .agg(F.sum(F.when(F.col(value) == 0, 1).otherwise(0)).alias("zeros"), F.sum(value).alias("value"))
    )


def expand_runs(runs: DataFrame, keys: list[str], width: int | Column) -> DataFrame:
    """(keys, row, col, v): runs back to coefficients, wrapping at the line width (an expression of the keys). A run's place is a running sum, not a row count."""
    reading = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.when(F.col("value") != 0, F.array(F.col("value"))).otherwise(F.array().cast("array<bigint>"))
    whole = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.col("zeros").cast("int")), tail)
    placed = runs.withColumn("whole", whole).withColumn("first", F.coalesce(F.sum(F.size("whole")).over(reading), F.lit(0)))
    flat = placed.select(*keys, "first", F.posexplode("whole").alias("i", "v"))
    at = F.col("first") + F.col("i")
    return flat.select(*keys, F.floor(at / width).alias("row"), (at % width).alias("col"), "v")


# Code sizes of zero runs, longest run first, and of the band's end.
RUN_BITS = {320: 13, 180: 13, 100: 11, 60: 10, 32: 9, 20: 8, 12: 7, 1: 1}
END_BITS = 26
RUN_LENGTHS = tuple(RUN_BITS)[:-1]
# Code sizes of magnitudes (without sign): from each magnitude on, up to the next.
MAGNITUDE_BITS = {
    1: 2, 2: 3, 3: 5, 4: 6, 6: 7, 9: 8, 11: 9, 14: 10, 19: 11, 23: 12, 30: 13, 36: 14, 41: 15, 48: 16, 54: 17, 62: 18, 69: 19, 77: 20, 85: 21, 94: 22, 101: 23, 108: 24, 116: 26, 117: 25,
}
LONGEST_RUN, LONGEST_CODE = 3071, 31


def magnitude_size(m: Column) -> Column:
    """Bits of a companded magnitude's code (1..255), without its sign."""
    size = F.lit(0)
    for first, bits in MAGNITUDE_BITS.items():
        size = F.when(m >= first, bits).otherwise(size)
    return size


def coefficient_size(m: Column) -> Column:
    """Bits of a coefficient's magnitude (not companded, over 0): the thresholds are taken through the companding curve."""
    size = F.lit(0)
    for first, bits in MAGNITUDE_BITS.items():
        size = F.when(m >= min(1023, first + int(first**3 * 768 / 255**3)), bits).otherwise(size)
    return size


def codebook(spark: SparkSession) -> DataFrame:
    """(size, count, value): 264 codes - 256 magnitudes (0 is a single zero), seven zero runs and the band's end (count 0)."""
    m = spark.range(1, 256).select(magnitude_size(F.col("id")).alias("size"), F.lit(1).alias("count"), F.col("id").cast("int").alias("value"))
    runs = spark.createDataFrame([(bits, n, 0) for n, bits in RUN_BITS.items()] + [(END_BITS, 0, 1)], "size int, count int, value int")
    return m.unionByName(runs)


def run_codes(spark: SparkSession) -> DataFrame:
    """(run, size, covered) for runs of 0..3071 zeros: the codes of the longest runs that fit, again and again, up to 31 bits; what a table entry doesn't cover is looked up next."""
    table = spark.range(LONGEST_RUN + 1).select(F.col("id").cast("int").alias("run"), F.col("id").cast("int").alias("rest"), F.lit(0).alias("size"), F.lit(False).alias("full"))
    for n, bits in RUN_BITS.items():
        times, room = F.expr(f"rest div {n}").cast("int"), F.expr(f"({LONGEST_CODE} - size) div {bits}").cast("int")
        used = F.when(F.col("full"), 0).otherwise(F.least(times, room))
        table = table.select("run", (F.col("rest") - used * n).alias("rest"), (F.col("size") + used * bits).alias("size"), (F.col("full") | (times > room)).alias("full"))
    return table.select("run", "size", (F.col("run") - F.col("rest")).alias("covered"))


def code_bits(runs: DataFrame) -> DataFrame:
    """runs with `bits`: the length of each run's code with its value's and the sign. Runs are greedily made of the longest codes."""
    left, bits = F.col("zeros"), F.lit(0).cast("bigint")
    for n, size in RUN_BITS.items():
        k = F.floor(left / n)
        bits = bits + k * size
        left = left - k * n
    return runs.withColumn("bits", bits + F.when(F.col("value") != 0, coefficient_size(F.abs("value")) + 1).otherwise(0))


def equal_runs(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, start, length, value): maximal runs of one value, as run-length encoders see a line."""
    line = Window.partitionBy(*keys).orderBy(order)
    changes = F.when(F.lag(value).over(line).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = rows.withColumn("change", changes).withColumn("run", F.sum("change").over(line))
    return marked.groupBy(*keys, "run").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length"), F.max(value).alias("value")).drop("run")


def carried_forward(rows: DataFrame, keys: list[str], order: str, states: dict[str, tuple]) -> DataFrame:
    """rows with one column per state: the last value where its condition held, else its default. states: name -> (condition, value, default)."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({name: F.coalesce(F.last(F.when(cond, value), ignorenulls=True).over(so_far), F.lit(default)) for name, (cond, value, default) in states.items()})


def chunk_sizes(bands: DataFrame) -> DataFrame:
    """Payload sizes in 32-bit segments of subband, channel and image, bottom-up. bands: image_id, channel, subband and the bits of its codes, end marker included."""
    base = bands.select("image_id", "channel", "subband", F.ceil(F.col("bits") / 32).cast("bigint").alias("segments"))
    return base.rollup("image_id", "channel", "subband").agg(F.sum("segments").alias("segments"), F.grouping_id().cast("int").alias("depth"))
