"""Image-stage operators and opcodes on pixel relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.curves import clamp, horner


def linearize(pixels: DataFrame, black: DataFrame, white: int, repeat: tuple[int, int]) -> DataFrame:
    """Subtract a repeating black pattern (pr, pc, black) and scale to 0..65535. The pattern has repeat[0] * repeat[1] rows."""
    pattern = F.broadcast(black)  # bounded by the repeat sizes, a few rows
    level = pixels.join(pattern, (F.col("row") % repeat[0] == F.col("pr")) & (F.col("col") % repeat[1] == F.col("pc")))
    out = F.floor((F.greatest(F.lit(0), F.col("v") - F.col("black")).cast("bigint") * 65535 + F.expr(f"({white} - black) div 2")) / (F.lit(white) - F.col("black")))
    return level.select("image_id", "row", "col", F.least(F.lit(65535), out).alias("v"))


def black_pattern(pixels: DataFrame, repeat: tuple[int, int]) -> DataFrame:
    """Least, rounded mean and greatest value at each place of the repeating pattern."""
    return pixels.groupBy("image_id", (F.col("row") % repeat[0]).alias("pr"), (F.col("col") % repeat[1]).alias("pc")).agg(
        F.min("v").alias("low"), F.floor((F.sum("v") * 2 + F.count("v")) / (F.count("v") * 2)).alias("mean"), F.max("v").alias("high")
    )


def downsample_colors(pixels: DataFrame, size: int) -> DataFrame:
    """Rounded mean of each colour (by Bayer place) in cells of size x size."""
    color = (F.col("row") % 2) * 2 + F.col("col") % 2
    n = F.count(F.lit(1))
    return pixels.groupBy("image_id", F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col"), color.alias("color")).agg(
        F.floor((F.sum("v") + F.shiftright(n, 1)) / n).alias("v")
    )


def neighbours(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """pixels with one column n0, n1, ... per offset (null beyond the edge), by windows along rows and columns."""
    across, down = Window.partitionBy("image_id", "row").orderBy("col"), Window.partitionBy("image_id", "col").orderBy("row")
    step = lambda d, w: F.lead("v", d).over(w) if d > 0 else F.lag("v", -d).over(w)
    return pixels.withColumns({f"n{i}": step(dc, across) if dr == 0 else step(dr, down) for i, (dr, dc) in enumerate(offsets)})


def fix_bad_constant(pixels: DataFrame, bad: int) -> DataFrame:
    """Samples equal to `bad` become the rounded mean of their same-colour neighbours (two away) that are not; else they stay."""
    near = neighbours(pixels, [(-2, 0), (2, 0), (0, -2), (0, 2)])
    good = [F.when(F.col(f"n{i}") != bad, F.col(f"n{i}")) for i in range(4)]
    total, count = reduce(lambda a, b: a + b, [F.coalesce(g, F.lit(0)) for g in good]), reduce(lambda a, b: a + b, [F.when(g.isNotNull(), 1).otherwise(0) for g in good])
    fixed = F.floor((total * 2 + count) / (count * 2))
    return near.select("image_id", "row", "col", F.when((F.col("v") == bad) & (count > 0), fixed).otherwise(F.col("v")).alias("v"))


def fix_bad_list(pixels: DataFrame, bad: DataFrame) -> DataFrame:
    """bad: distinct (row, col). Listed samples become the rounded mean of their same-colour neighbours (two away) that aren't listed; without any they stay.

    Only listed samples are gathered for: four equalities a place, not a window over the image.
    """
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((-2, 0), (2, 0), (0, -2), (0, 2))])
    near = bad.select("row", "col", F.explode(steps).alias("s")).select(F.col("row").alias("br"), F.col("col").alias("bc"), (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    good = near.join(bad, ["row", "col"], "left_anti").join(pixels, ["row", "col"])
    n = F.count("v")
    means = good.groupBy("image_id", "br", "bc").agg(F.floor((F.sum("v") * 2 + n) / (n * 2)).alias("mean")).select("image_id", F.col("br").alias("row"), F.col("bc").alias("col"), "mean")
    return pixels.join(means, ["image_id", "row", "col"], "left").select("image_id", "row", "col", F.coalesce("mean", "v").alias("v"))


def isolated(bad: DataFrame, reach: int) -> DataFrame:
    """(row, col, isolated): whether no other listed place is within `reach` rows and columns. Equalities on places, no range join."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if r or c])
    around = bad.select(F.explode(steps).alias("s"), "row", "col").select((F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col")).distinct()
    return bad.join(around.withColumn("met", F.lit(True)), ["row", "col"], "left").select("row", "col", F.col("met").isNull().alias("isolated"))


def apply_opcodes(pixels: DataFrame, steps: list[tuple]) -> DataFrame:
    """Operators of this module with their arguments, one after the other."""
    for operator, arguments in steps:
        pixels = operator(pixels, *arguments)
    return pixels


def max_black(pattern: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """level: the greatest black of the pattern, and the greatest row and column delta where that is over 0."""
    parts = pattern.select(F.lit(0).alias("k"), F.col("black").alias("x")).unionByName(rows.select(F.lit(1).alias("k"), F.col("d").alias("x"))).unionByName(columns.select(F.lit(2).alias("k"), F.col("d").alias("x")))
    most = parts.groupBy("k").agg(F.max("x").alias("x"))
    return most.agg(F.sum(F.when(F.col("k") == 0, F.col("x")).otherwise(F.greatest(F.lit(0), F.col("x")))).alias("level"))


def proxy(pixels: DataFrame, size: int, white: int) -> DataFrame:
    """A smaller 8-bit stand-in: rounded means of size x size cells, under a square-root curve."""
    n = F.count(F.lit(1))
    cells = pixels.groupBy("image_id", F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(F.floor((F.sum("v") + F.floor(n / 2)) / n).alias("v"))
    return cells.withColumn("v", F.floor(F.sqrt(F.col("v") / F.lit(float(white))) * 255.0 + 0.5))


def get(pixels: DataFrame, area: tuple[int, int, int, int]) -> DataFrame:
    """The samples of an area, counted from its corner."""
    return pixels.where(in_area(area)).withColumns({"row": F.col("row") - area[0], "col": F.col("col") - area[1]})


def put(pixels: DataFrame, part: DataFrame, row: int, col: int) -> DataFrame:
    """part laid over pixels with its corner at (row, col); what would fall outside is left out."""
    moved = part.select("image_id", (F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), F.col("v").alias("w"))
    return pixels.join(moved, ["image_id", "row", "col"], "left").select("image_id", "row", "col", F.coalesce("w", "v").alias("v"))


def line_digests(pixels: DataFrame) -> DataFrame:
    """(image_id, row, digest): MD5 of each line's samples, comma-joined."""
    lines = pixels.groupBy("image_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("s"))
    return lines.select("image_id", "row", F.md5(F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ",").cast("binary")).alias("digest"))


def validated(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(image_id, lines, valid, first_bad): digests that agree, and the first line whose digest doesn't."""
    both = found.join(expected.select("image_id", "row", F.col("digest").alias("wanted")), ["image_id", "row"])
    same = F.col("digest") == F.col("wanted")
    return both.groupBy("image_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.when(same, 1).otherwise(0)).alias("valid"), F.min(F.when(~same, F.col("row"))).alias("first_bad"))


def demosaic_bilinear(pixels: DataFrame) -> DataFrame:
    """(image_id, row, col, r, g, b) of an RGGB mosaic: the mean of the nearest same-colour samples, rounded; edges use those that exist."""
    taps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    spread = pixels.select("image_id", "row", "col", "v", (F.col("row") % 2 * 2 + F.col("col") % 2).alias("phase"), F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in taps])).alias("t"))
    plane = F.when(F.col("phase") == 0, "r").when(F.col("phase") == 3, "b").otherwise("g")
    near = F.abs(F.col("t.dr")) + F.abs(F.col("t.dc"))
    moved = spread.select("image_id", (F.col("row") + F.col("t.dr")).alias("row"), (F.col("col") + F.col("t.dc")).alias("col"), plane.alias("plane"), near.alias("near"), "v")
    sums = {}
    for p in ("r", "g", "b"):
        mine = F.col("plane") == p
        # an own sample alone; else the four next to it; else the diagonal ones
        for d in (0, 1, 2):
            sums[f"{p}{d}"] = F.sum(F.when(mine & (F.col("near") == d), F.col("v")))
            sums[f"{p}{d}n"] = F.count(F.when(mine & (F.col("near") == d), 1))
    cells = moved.groupBy("image_id", "row", "col").agg(F.max(F.when(F.col("near") == 0, 1)).alias("inside"), *[v.alias(k) for k, v in sums.items()]).where("inside = 1")
    mean = lambda p, d: F.floor((F.col(f"{p}{d}") * 2 + F.col(f"{p}{d}n")) / (F.col(f"{p}{d}n") * 2))
    pick = lambda p: F.when(F.col(f"{p}0n") > 0, mean(p, 0)).when(F.col(f"{p}1n") > 0, mean(p, 1)).otherwise(mean(p, 2))
    return cells.select("image_id", "row", "col", *[pick(p).alias(p) for p in ("r", "g", "b")])


def rectangle_sums(pixels: DataFrame, rects: DataFrame, width: int) -> DataFrame:
    """(rect_id, samples, total) of rectangles (rect_id, t, l, b, r, all inclusive) over images of that width, without a range join.

    Running sums along the rows make a rectangle's row the difference of two samples: equalities on (row, col).
    Both sides are dealt out: the lines of the rectangles are many times what Spark takes them for, so neither may be broadcast.
    """
    so_far = Window.partitionBy("image_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    sums = pixels.select("image_id", "row", "col", F.sum("v").over(so_far).alias("s"), F.count("v").over(so_far).alias("n"))
    ends = F.array(F.struct(F.least(F.col("r"), F.lit(width - 1)).alias("col"), F.lit(1).alias("sign")), F.struct((F.col("l") - 1).alias("col"), F.lit(-1).alias("sign")))
    lines = rects.select("rect_id", F.explode(F.sequence("t", "b")).alias("row"), ends.alias("e")).select("rect_id", "row", F.explode("e").alias("e")).select("rect_id", "row", "e.col", "e.sign")
    met = lines.join(sums.hint("merge"), ["row", "col"]).groupBy("rect_id").agg(F.sum(F.col("n") * F.col("sign")).alias("samples"), F.sum(F.col("s") * F.col("sign")).alias("total"))
    return met.where("samples > 0")


def unit(v: Column) -> Column:
    return v / F.lit(65535.0)


def from_unit(x: Column) -> Column:
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 65535.0 + 0.5)


def in_area(area: tuple[int, int, int, int], pitch: tuple[int, int] = (1, 1)) -> Column:
    """area: top, left, bottom, right (the last two exclusive)."""
    t, left, b, r = area
    return F.col("row").between(t, b - 1) & F.col("col").between(left, r - 1) & ((F.col("row") - t) % pitch[0] == 0) & ((F.col("col") - left) % pitch[1] == 0)


def where_in(pixels: DataFrame, area, pitch, value: Column) -> DataFrame:
    return pixels.withColumn("v", F.when(in_area(area, pitch), value).otherwise(F.col("v")))


def trim_bounds(pixels: DataFrame, area) -> DataFrame:
    return pixels.where(in_area(area))


def map_polynomial(pixels: DataFrame, area, pitch, coefficients: list[float]) -> DataFrame:
    return where_in(pixels, area, pitch, from_unit(horner(unit(F.col("v")), coefficients)))


def map_table(pixels: DataFrame, table: DataFrame, area, pitch=(1, 1)) -> DataFrame:
    """table: (i, to) of at most 65536 rows, so it may be broadcast; values beyond it keep its last entry."""
    last = table.agg(F.max("i")).head()[0]
    joined = pixels.withColumn("i", F.least(F.lit(last), F.col("v"))).join(F.broadcast(table), "i", "left")
    return joined.select("image_id", "row", "col", F.when(in_area(area, pitch), F.col("to")).otherwise(F.col("v")).alias("v"))


def per_line(pixels: DataFrame, deltas: DataFrame, line: str, scale: bool) -> DataFrame:
    """deltas: (line, d). Adds d (or multiplies by it) in unit scale, pinned to 0..1; lines without one stay."""
    x = unit(F.col("v"))
    value = from_unit(x * F.col("d") if scale else x + F.col("d"))
    return pixels.join(deltas, line, "left").select("image_id", "row", "col", F.when(F.col("d").isNotNull(), value).otherwise(F.col("v")).alias("v"))


def gain_map(pixels: DataFrame, grid: DataFrame, spacing: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """grid: (gr, gc, gain). Bilinear gain between the four corners of a pixel's cell; equi-joins on the corner."""
    fr, fc = F.col("row") / float(spacing[0]), F.col("col") / float(spacing[1])
    cell = pixels.withColumns({"r0": F.least(F.lit(last[0]), F.floor(fr)), "c0": F.least(F.lit(last[1]), F.floor(fc))}).withColumns({"r1": F.least(F.lit(last[0]), F.col("r0") + 1), "c1": F.least(F.lit(last[1]), F.col("c0") + 1)})
    for name, (r, c) in {"a": ("r0", "c0"), "b": ("r0", "c1"), "c": ("r1", "c0"), "d": ("r1", "c1")}.items():
        cell = cell.join(grid.select(F.col("gr").alias(r), F.col("gc").alias(c), F.col("gain").alias(f"gain_{name}")), [r, c])
    tr, tc = fr - F.col("r0"), fc - F.col("c0")
    top, bottom = F.col("gain_a") * (1.0 - tc) + F.col("gain_b") * tc, F.col("gain_c") * (1.0 - tc) + F.col("gain_d") * tc
    return cell.select("image_id", "row", "col", from_unit(unit(F.col("v")) * (top * (1.0 - tr) + bottom * tr)).alias("v"))


def vignette(pixels: DataFrame, center: tuple[float, float], radius: float, k: list[float]) -> DataFrame:
    """Radial gain 1 + k0 r2 + k1 r2^2 + ..., r2 the squared distance from the centre over the squared radius."""
    dr, dc = F.col("row") - F.lit(center[0]), F.col("col") - F.lit(center[1])
    r2 = (dr * dr + dc * dc) / F.lit(radius * radius)
    return pixels.withColumn("v", from_unit(unit(F.col("v")) * (F.lit(1.0) + r2 * horner(r2, k))))


def cubic_weight(x: Column) -> Column:
    """The cubic kernel with a = -0.75."""
    d = F.abs(x)
    near = ((1.25 * d - 2.25) * d) * d + 1.0
    far = ((-0.75 * d + 3.75) * d - 6.0) * d + 3.0
    return F.when(d < 1, near).when(d < 2, far).otherwise(F.lit(0.0))


def resample(pixels: DataFrame, line: str, size_in: int, size_out: int) -> DataFrame:
    """One direction of a bicubic resize to size_out lines; weights are 1/1024 integers that sum to 1024 over the taps inside.

    The weight table has four rows an output line: it joins by equality on the input line.
    """
    spark = pixels.sparkSession
    at = (F.col("o") + 0.5) * (size_in / size_out) - 0.5
    base = spark.range(size_out).select(F.col("id").cast("int").alias("o")).withColumn("at", at)
    taps = base.select("o", "at", F.explode(F.sequence(F.floor("at") - 1, F.floor("at") + 2)).alias("i")).where(F.col("i").between(0, size_in - 1))
    weights = taps.select("o", F.col("i").cast("int").alias(line), F.floor(cubic_weight(F.col("at") - F.col("i")) * 1024 + 0.5).cast("bigint").alias("w"))
    other = "col" if line == "row" else "row"
    sums = pixels.join(weights, line).groupBy("image_id", "o", other).agg(F.sum(F.col("v") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    value = clamp(F.floor((F.col("s") * 2 + F.col("w")) / (F.col("w") * 2)), 0, 4095)
    return sums.select("image_id", F.col("o").alias(line), other, value.alias("v")).select("image_id", "row", "col", "v")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row an image: samples in either, those that differ or lack a partner, and the greatest difference."""
    both = a.select("image_id", "row", "col", F.col("v").alias("a")).join(b.select("image_id", "row", "col", F.col("v").alias("b")), ["image_id", "row", "col"], "full")
    return both.groupBy("image_id").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), 0).otherwise(1)).alias("differing"), F.max(F.abs(F.col("a") - F.col("b"))).alias("greatest"))


def tile_digest(pixels: DataFrame, tile: int) -> DataFrame:
    """One row an image: MD5 over the MD5s of its tiles in order; a tile is its samples in reading order, comma-joined."""
    tiles = pixels.groupBy("image_id", F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).agg(F.sort_array(F.collect_list(F.struct("row", "col", "v"))).alias("s"))
    each = tiles.select("image_id", "tr", "tc", F.md5(F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ",").cast("binary")).alias("d"))
    whole = each.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("tr", "tc", "d"))).alias("s"))
    return whole.select("image_id", F.size("s").cast("bigint").alias("tiles"), F.md5(F.array_join(F.transform("s", lambda x: x["d"]), "").cast("binary")).alias("digest"))
