"""Registry of the engine's own queries and of the SQL they are checked against.

The sensor image is the embeddings table read as a 12-bit Bayer mosaic. Integer results are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import curves, scalars
from lumenframe.operators import bayer, entropy, render, stage, wavelet
from lumenframe.plans import metadata  # noqa: F401  (registers its queries)
from lumenframe.plans import oracle as O
from lumenframe.plans.registry import FOUND, query, wide
from lumenframe.plans.registry import table as _table
from lumenframe.sources.pixels import sensor

FLAGSHIP = "rgb_preview_16"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: wide(f(spark, sf_dir))) for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}


def _planes(spark, sf_dir, cell="rggb"):
    return bayer.unpack(sensor(spark, sf_dir), cell)


PLANE = "image_id channel row col v"
BAND = "image_id channel band row col v"
PIXEL = "image_id row col v"

# --- sources and projections -------------------------------------------------------------------


@query("pixel_scan", O.plain(O.PX, "px", PIXEL))
def _(spark, d):
    return sensor(spark, d)


@query("log_curve_encode", O.out(f"{O.PX}, {O.LUT}", "px JOIN enc ON px.v = enc.i", image_id="image_id", row='"row"', col="col", v="e"))
def _(spark, d):
    table = curves.curve_table(spark, curves.log_encode, "e")
    return sensor(spark, d).withColumnRenamed("v", "i").join(F.broadcast(table), "i").select("image_id", "row", "col", F.col("e").alias("v"))


@query("log_curve_decode", O.out(f"{O.PX}, {O.LUT}", "px JOIN dec ON px.v = dec.i", image_id="image_id", row='"row"', col="col", v="d"))
def _(spark, d):
    return sensor(spark, d).withColumn("v", curves.log_decode(F.col("v")))


for _cell in ("rggb", "gbrg"):

    @query(f"bayer_unpack_{_cell}", O.plain(O.planes(_cell), "planes", PLANE))
    def _(spark, d, cell=_cell):
        return _planes(spark, d, cell)


@query("bayer_unpack_14", O.plain(O.planes("gbrg"), "planes", PLANE))
def _(spark, d):
    return bayer.unpack(sensor(spark, d).withColumn("v", F.col("v") * 4 + F.col("col") % 4), "gbrg", bits=14)


@query("bayer_unpack_12p", O.plain(O.planes(), "planes", PLANE))
def _(spark, d):
    px = sensor(spark, d)
    pair = px.groupBy("image_id", "row", F.shiftright("col", 1).alias("k")).agg(F.max(F.when(F.col("col") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("col") % 2 == 1, F.col("v"))).alias("b"))
    b0, b1, b2 = F.col("a") % 256, F.shiftright("a", 8) + (F.col("b") % 16) * 16, F.shiftright("b", 4)
    three = pair.select("image_id", "row", "k", b0.alias("b0"), b1.alias("b1"), b2.alias("b2"))
    taps = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("v")) for i, x in enumerate(curves.unpacked12(F.col("b0"), F.col("b1"), F.col("b2")))])
    flat = three.select("image_id", "row", "k", F.explode(taps).alias("t")).select("image_id", "row", (F.col("k") * 2 + F.col("t.i")).alias("col"), "t.v")
    return bayer.unpack(flat)


@query("curve_dump", f"WITH {O.LUT} SELECT format('{{:04d}}: {{:04d}}', enc.i, e) AS enc, format('{{:04d}}: {{:05d}}', dec.i, d) AS dec FROM enc JOIN dec ON enc.i = dec.i")
def _(spark, d):
    both = curves.curve_table(spark, curves.log_encode, "e").withColumn("d", curves.log_decode(F.col("i")))
    return both.select(F.format_string("%04d: %04d", "i", "e").alias("enc"), F.format_string("%04d: %05d", "i", "d").alias("dec"))


_PACKED = """cell4 AS (SELECT image_id, "row", col, max(CASE WHEN channel = 0 THEN v END) AS gs, max(CASE WHEN channel = 1 THEN v END) - 2048 AS rg,
  max(CASE WHEN channel = 2 THEN v END) - 2048 AS bg, max(CASE WHEN channel = 3 THEN v END) - 2048 AS gd FROM planes GROUP BY ALL),
taps AS (SELECT image_id, 2 * "row" AS "row", 2 * col AS col, 2 * rg + gs AS x FROM cell4 UNION ALL SELECT image_id, 2 * "row", 2 * col + 1, gs + gd FROM cell4
  UNION ALL SELECT image_id, 2 * "row" + 1, 2 * col, gs - gd FROM cell4 UNION ALL SELECT image_id, 2 * "row" + 1, 2 * col + 1, 2 * bg + gs FROM cell4),
packed AS (SELECT image_id, "row", col, d AS v FROM taps JOIN dec ON least(4095, greatest(0, x)) = dec.i)"""


@query("bayer_pack", O.plain(f"{O.planes()}, {_PACKED}", "packed", PIXEL))
def _(spark, d):
    return bayer.pack(_planes(spark, d))


@query(
    "roundtrip_error",
    O.out(
        f"{O.planes()}, {_PACKED}, diff AS (SELECT p.image_id, abs((p.v >> 4) - px.v) AS e FROM packed p JOIN px USING (image_id, \"row\", col))",
        "(SELECT image_id, max(e) AS m, sum(e) AS s, count(*) AS n FROM diff GROUP BY image_id)",
        image_id="image_id", greatest="m", total="s", samples="n",
    ),
)
def _(spark, d):
    px = sensor(spark, d)
    back = bayer.pack(bayer.unpack(px), bits=12).withColumnRenamed("v", "w")
    e = F.abs(F.col("w") - F.col("v"))
    return back.join(px, ["image_id", "row", "col"]).groupBy("image_id").agg(F.max(e).alias("greatest"), F.sum(e).alias("total"), F.count(F.lit(1)).alias("samples"))


@query(
    "unpack_12p",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (b0 + ((b1 & 15) * 256))::BIGINT AS "left", (b2 * 16 + (b1 >> 4))::BIGINT AS "right"
    FROM (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT % 256 AS b0, l_partkey % 256 AS b1, l_suppkey % 256 AS b2 FROM lineitem)""",
)
def _(spark, d):
    b = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") % 256).alias("b0"), (F.col("l_partkey") % 256).alias("b1"), (F.col("l_suppkey") % 256).alias("b2"))
    return b.select("l_orderkey", "l_linenumber", (F.col("b0") + F.shiftleft(F.col("b1").bitwiseAND(F.lit(15)), 8)).alias("left"), (F.shiftleft("b2", 4) + F.shiftright("b1", 4)).alias("right"))


@query(
    "uncompand_values",
    f"""WITH {O.PX}, c AS (SELECT image_id, "row", col, v - 2048 AS x, least(1023, abs(v - 2048)) AS m FROM px)
    SELECT image_id::BIGINT AS image_id, "row"::BIGINT AS "row", col::BIGINT AS col, (sign(x) * (m + trunc(m::DOUBLE * m * m * 768.0::DOUBLE / 16581375.0::DOUBLE)))::BIGINT AS cubic,
      (sign(x) * CASE WHEN once < 54 THEN once ELSE 54 + ((once - 52) >> 2) END)::BIGINT AS legacy
    FROM (SELECT *, CASE WHEN m < 40 THEN m ELSE 40 + ((m - 38) >> 2) END AS once FROM c)""",
)
def _(spark, d):
    x = F.col("v") - 2048
    v = F.signum(x).cast("int") * F.least(F.lit(1023), F.abs(x))
    return sensor(spark, d).select("image_id", "row", "col", curves.uncompand(v).alias("cubic"), curves.legacy_compand(v).alias("legacy"))


@query(
    "inverse_companding_table",
    """WITH m AS (SELECT i AS m, least(1023, (i + trunc(i::DOUBLE * i * i * 768.0::DOUBLE / 16581375.0::DOUBLE))::BIGINT) AS slot FROM range(256) t(i))
    SELECT s.i::BIGINT AS i, (SELECT max(m) FROM m WHERE slot <= s.i)::BIGINT AS m FROM range(1024) s(i)""",
)
def _(spark, d):
    return curves.inverse_companding(spark)


# --- wavelets ----------------------------------------------------------------------------------


@query("wavelet_h_l1", O.plain(f"{O.planes()}, {O.forward_line('h', 'planes', 'image_id, channel, \"row\"', 'col', 0)}", "h", "image_id channel row col low high"))
def _(spark, d):
    return wavelet.forward_line(_planes(spark, d), ["image_id", "channel", "row"], "col", "v", 0, "low", "high")


@query("wavelet_v_l1", O.plain(f"{O.planes()}, {O.forward_line('h', 'planes', 'image_id, channel, col', 'row', 0)}", "h", "image_id channel row col low high"))
def _(spark, d):
    return wavelet.forward_line(_planes(spark, d), ["image_id", "channel", "col"], "row", "v", 0, "low", "high")


for _level in (1, 2, 3):

    @query(f"wavelet_2d_l{_level}", O.plain(O.pyramid(_level), f"(SELECT * FROM pyr WHERE level = {_level - 1})", BAND))
    def _(spark, d, level=_level):
        return wavelet.pyramid(_planes(spark, d), level).where(F.col("level") == level - 1).drop("level")


@query("quantize_fs1", O.plain(f"{O.pyramid()}, {O.QUANTIZED}", "qz", "image_id channel subband level band row col v"))
def _(spark, d):
    return wavelet.quantized(wavelet.pyramid(_planes(spark, d)))


@query("dequantize_fs1", O.plain(f"{O.pyramid()}, {O.QUANTIZED}, {O.DEQUANTIZED}", "dq", "image_id channel subband level band row col v"))
def _(spark, d):
    return wavelet.dequantized(wavelet.quantized(wavelet.pyramid(_planes(spark, d))))


@query("inverse_l1", O.plain(f"{O.pyramid(1)}, {O.inverse('i', 'l0bands', 0)}", "iout", PLANE))
def _(spark, d):
    return wavelet.inverse(wavelet.forward(_planes(spark, d), 0), 0)


@query("inverse_l2", O.plain(f"{O.pyramid(2)}, {O.inverse('i', 'l1bands', 2)}", "iout", PLANE))
def _(spark, d):
    low = wavelet.forward(_planes(spark, d), 0).where("band = 0").drop("band")
    return wavelet.inverse(wavelet.forward(low, 2), 2)


@query("lossless_l1", O.out(f"{O.planes()}", "(SELECT image_id, channel, count(*) AS n FROM planes GROUP BY ALL)", image_id="image_id", channel="channel", samples="n", differing="0"))
def _(spark, d):
    planes = _planes(spark, d)
    back = wavelet.inverse(wavelet.forward(planes, 0), 0).withColumnRenamed("v", "w")
    both = planes.join(back, ["image_id", "channel", "row", "col"], "left")
    return both.groupBy("image_id", "channel").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.when(F.col("v").eqNullSafe(F.col("w")), 0).otherwise(1)).alias("differing"))


for _name, _n in {"sixteenth": 1, "eighth": 4, "quarter": 7}.items():

    @query(
        f"subband_limit_{_name}",
        O.out(f"{O.pyramid()}, {O.QUANTIZED}", f"(SELECT image_id, channel, subband, count(*) AS n, sum(abs(v)) AS s FROM qz WHERE subband < {_n} GROUP BY ALL)", image_id="image_id", channel="channel", subband="subband", coefficients="n", magnitude="s"),
    )
    def _(spark, d, n=_n):
        bands = wavelet.quantized(wavelet.pyramid(_planes(spark, d))).where(F.col("subband") < n)
        return bands.groupBy("image_id", "channel", "subband").agg(F.count(F.lit(1)).alias("coefficients"), F.sum(F.abs("v")).alias("magnitude"))


def _preview_sql(levels: int, width: int, bits: int) -> str:
    source, precision = (f"l{levels - 1}ll", 14) if levels else ("planes", 12)
    at = lambda c: f"max(CASE WHEN channel = {c} THEN v END)"
    pin = lambda x: f"least(4095, greatest(0, ({x}) >> {precision - 12}))"
    ctes = (O.pyramid(levels) if levels else O.planes()) + f""", lv AS (SELECT image_id, "row", {width - 1} - col AS col, {at(0)} AS g, {at(1)} - {1 << (precision - 1)} AS rg, {at(2)} - {1 << (precision - 1)} AS bg FROM {source} WHERE channel < 3 GROUP BY ALL),
    px3 AS (SELECT image_id, "row", col, {pin('2 * rg + g')} AS r, {pin('g')} AS g, {pin('2 * bg + g')} AS b FROM lv)"""
    if bits == 16:
        shown = [f"({t}.d & 255) * 256 + ({t}.d >> 8)" for t in "ace"]
    else:
        shown = [f"least(255, trunc(sqrt((({t}.d * {n}) >> {k})::DOUBLE)))" for t, n, k in (("a", 30, 4), ("c", 1, 0), ("e", 7, 2))]
    return O.out(ctes, "px3 JOIN dec a ON px3.r = a.i JOIN dec c ON px3.g = c.i JOIN dec e ON px3.b = e.i", image_id="image_id", row='"row"', col="col", **dict(zip("rgb", shown, strict=True)))


for _name, _levels in {"rgb_preview_2": 0, "rgb_preview_4": 1, "rgb_preview_8": 2, "rgb_preview_16": 3}.items():
    for _bits in (8, 16):

        @query(_name if _bits == 8 else f"{_name}_16bit", _preview_sql(_levels, 32 >> _levels, _bits))
        def _(spark, d, levels=_levels, bits=_bits):
            cells = bayer.wide(_planes(spark, d))
            for level in range(levels):  # the other bands are never computed: only LL feeds the next level
                cells = wavelet.lowpass(cells, wavelet.PRESCALE[level], ["gs", "rg", "bg"])
            return bayer.preview(cells, 14 if levels else 12, 32 >> levels, bits)


@query("quantizer_constants", """SELECT q::BIGINT AS q, c::BIGINT AS correction, (CASE WHEN c = 2 THEN greatest(0, q // 2 - 1) WHEN c BETWEEN 3 AND 8 THEN q // c ELSE 0 END)::BIGINT AS mid, (65536 // q)::BIGINT AS mult
    FROM (SELECT DISTINCT unnest([1, 12, 24, 32, 48, 64, 96, 128, 144, 192, 256, 384, 512, 768]) AS q), range(0, 11) t(c)""")
def _(spark, d):
    qs = sorted({q for row in wavelet.QUANTIZERS.values() for q in row})
    return spark.createDataFrame([(q, c, wavelet.midpoint(q, c), 65536 // q) for q in qs for c in range(11)], "q int, correction int, mid int, mult int")


@query("level_dimensions", O.out(O.planes(), '(SELECT image_id, channel, max(col) + 1 AS w, max("row") + 1 AS h FROM planes GROUP BY ALL), range(1, 4) t(n)', image_id="image_id", channel="channel", level="n - 1", width="ceil(w / power(2.0, n))", height="ceil(h / power(2.0, n))"))
def _(spark, d):
    sides = _planes(spark, d).groupBy("image_id", "channel").agg((F.max("col") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    return sides.select("image_id", "channel", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("level"), "w", "h").select("image_id", "channel", "level", *[F.expr(f"({s} + shiftleft(2, level) - 1) div shiftleft(2, level)").alias(n) for s, n in (("w", "width"), ("h", "height"))])


@query("reconstruct_ll", O.plain(f"{O.pyramid()}, {O.QUANTIZED}, {O.DEQUANTIZED}, top AS (SELECT image_id, channel, band, \"row\", col, v FROM dq WHERE level = 2), {O.inverse('i', 'top', 2)}", "iout", PLANE))
def _(spark, d):
    bands = wavelet.dequantized(wavelet.quantized(wavelet.pyramid(_planes(spark, d))).where("level = 2"))
    return wavelet.inverse(bands, wavelet.PRESCALE[2])


def _rebuilt_sql() -> str:
    side = lambda n: f'(SELECT ceil((max("row") + 1) / {2 ** n}.0) FROM planes)'
    ctes, low = f"{O.pyramid()}, {O.QUANTIZED}, {O.DEQUANTIZED}", "SELECT image_id, channel, 0 AS band, \"row\", col, v FROM dq WHERE subband = 0"
    for level in (2, 1, 0):
        ctes += f', b{level} AS ({low} UNION ALL SELECT image_id, channel, band, "row", col, v FROM dq WHERE level = {level} AND band > 0), {O.inverse(f"i{level}", f"b{level}", wavelet.PRESCALE[level])}'
        low = f'SELECT image_id, channel, 0 AS band, "row", col, v FROM i{level}out WHERE "row" < {side(level)}'
    return O.out(ctes, f"(SELECT * FROM i0out JOIN planes p USING (image_id, channel, \"row\", col))", image_id="image_id", channel="channel", row='"row"', col="col", v="least(4095, greatest(0, v))", w="v_1")


@query(
    "reconstruct_planes",
    _rebuilt_sql().replace("SELECT * FROM i0out JOIN planes p USING", "SELECT i0out.*, p.v AS v_1 FROM i0out JOIN planes p USING"),
)
def _(spark, d):
    planes = _planes(spark, d)
    bands = wavelet.dequantized(wavelet.quantized(wavelet.pyramid(planes)))
    height = planes.agg(F.max("row")).head()[0] + 1
    low = bands.where("subband = 0").select("image_id", "channel", "band", "row", "col", "v")
    for level in (2, 1, 0):
        whole = low.unionByName(bands.where((F.col("level") == level) & (F.col("band") > 0)).select("image_id", "channel", "band", "row", "col", "v"))
        low = wavelet.inverse(whole, wavelet.PRESCALE[level], height=-(-height // (1 << level))).select("image_id", "channel", F.lit(0).alias("band"), "row", "col", "v")
    back = low.select("image_id", "channel", "row", "col", curves.clamp12(F.col("v")).alias("back"))
    return planes.join(back, ["image_id", "channel", "row", "col"]).select("image_id", "channel", "row", "col", F.col("back").alias("v"), F.col("v").alias("w"))


# --- entropy -----------------------------------------------------------------------------------

_RUNS = """zr AS (SELECT image_id, channel, subband, seq, sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS zeros, sum(v) AS value FROM (
  SELECT *, coalesce(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, channel, subband ORDER BY "row", col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq
  FROM qz WHERE subband > 0) GROUP BY ALL)"""
_RUN_KEYS = ["image_id", "channel", "subband"]
def _runs(spark, d):
    return entropy.zero_runs(wavelet.quantized(wavelet.pyramid(_planes(spark, d))).where("subband > 0"), _RUN_KEYS, ["row", "col"])


@query("zero_runs", O.plain(f"{O.pyramid()}, {O.QUANTIZED}, {_RUNS}", "zr", "image_id channel subband seq zeros value"))
def _(spark, d):
    return _runs(spark, d)


@query("run_expand", O.plain(f"{O.pyramid()}, {O.QUANTIZED}", "(SELECT * FROM qz WHERE subband > 0)", "image_id channel subband row col v"))
def _(spark, d):
    level = F.element_at(F.array(*[F.lit(at) for at, _ in wavelet.SUBBANDS]), F.col("subband").cast("int") + 1)
    return entropy.expand_runs(_runs(spark, d), _RUN_KEYS, (F.lit(16) / F.pow(F.lit(2.0), level)).cast("bigint"))


# Fixed values of the code again, as the SQL's own tables.
_CODE_SQL = """zcode AS (SELECT * FROM (VALUES (320, 13), (180, 13), (100, 11), (60, 10), (32, 9), (20, 8), (12, 7), (1, 1)) t(n, bits)),
  sizes AS (SELECT * FROM (VALUES (1, 2), (2, 3), (3, 5), (4, 6), (6, 7), (9, 8), (11, 9), (14, 10), (19, 11), (23, 12), (30, 13), (36, 14), (41, 15), (48, 16), (54, 17), (62, 18), (69, 19), (77, 20), (85, 21), (94, 22), (101, 23), (108, 24), (116, 26), (117, 25)) t(first, bits)),
  mcode AS (SELECT m, (SELECT arg_max(bits, first) FROM sizes WHERE first <= m) AS bits FROM range(1, 256) t(m)),
  slot AS (SELECT m, least(1023, m + trunc(m::DOUBLE * m * m * 768.0::DOUBLE / 16581375.0::DOUBLE)::BIGINT) AS s FROM range(256) t(m)),
  ccode AS (SELECT i, m, coalesce(bits, 1) AS bits FROM (SELECT i, (SELECT max(m) FROM slot WHERE s <= i) AS m FROM range(1024) t(i)) LEFT JOIN mcode USING (m))"""


def _greedy_sql(zeros: str) -> str:
    left, bits = f"({zeros})::BIGINT", "0"
    for n, size in ((320, 13), (180, 13), (100, 11), (60, 10), (32, 9), (20, 8), (12, 7)):
        bits += f" + ({left} // {n}) * {size}"
        left = f"({left} % {n})"
    return f"{bits} + {left}"


_BITS = f"""{O.pyramid()}, {O.QUANTIZED}, {_RUNS}, {_CODE_SQL},
  coded AS (SELECT zr.*, {_greedy_sql('zeros')} + CASE WHEN value <> 0 THEN bits + 1 ELSE 0 END AS b FROM zr JOIN ccode ON i = least(1023, abs(value))),
  bandbits AS (SELECT image_id, channel, subband, sum(b) + 26 AS bits, count(*) AS runs FROM coded GROUP BY ALL)"""


def _coded(spark, d):
    bits = entropy.code_bits(_runs(spark, d))
    return bits.groupBy(*_RUN_KEYS).agg((F.sum("bits") + entropy.END_BITS).alias("bits"), F.count(F.lit(1)).alias("runs"), F.sum(F.col("zeros") + F.when(F.col("value") != 0, 1).otherwise(0)).alias("coefficients"))


@query("code_lengths", O.out(_BITS, "bandbits", image_id="image_id", channel="channel", subband="subband", bits="bits", segments="ceil(bits / 32)", runs="runs"))
def _(spark, d):
    return _coded(spark, d).select(*_RUN_KEYS, "bits", F.ceil(F.col("bits") / 32).alias("segments"), "runs")


@query(
    "compression_ratio",
    f"""WITH {_BITS}, n AS (SELECT image_id, channel, subband, count(*) AS c FROM qz WHERE subband > 0 GROUP BY ALL)
    SELECT image_id::BIGINT AS image_id, channel::BIGINT AS channel, subband::BIGINT AS subband, sum(c)::BIGINT AS coefficients, sum(bits)::BIGINT AS bits, (sum(c)::BIGINT * 12000 // sum(bits)::BIGINT)::BIGINT AS permille
    FROM n JOIN bandbits USING (image_id, channel, subband) GROUP BY ROLLUP (image_id, channel, subband)""",
)
def _(spark, d):
    return _coded(spark, d).rollup(*_RUN_KEYS).agg(F.sum("coefficients").alias("coefficients"), F.sum("bits").alias("bits")).withColumn("permille", F.expr("coefficients * 12000 div bits"))


@query("codebook_sizes", f"WITH {_CODE_SQL} SELECT bits::BIGINT AS size, 1::BIGINT AS count, m::BIGINT AS value FROM mcode UNION ALL SELECT bits, n, 0 FROM zcode UNION ALL SELECT 26, 0, 1")
def _(spark, d):
    return entropy.codebook(spark)


@query("codebook_runs_sorted", f"WITH {_CODE_SQL} SELECT row_number() OVER (ORDER BY n DESC)::BIGINT AS place, n::BIGINT AS count, bits::BIGINT AS size FROM zcode")
def _(spark, d):
    runs = entropy.codebook(spark).where("value = 0 and count > 0")
    return runs.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("count"))).alias("place"), "count", "size")  # eight rows


@query("codebook_greatest_magnitude", f"WITH {_CODE_SQL} SELECT max(m)::BIGINT AS value, count(*)::BIGINT AS codes FROM mcode")
def _(spark, d):
    return entropy.codebook(spark).where("count = 1 and value > 0").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("codes"))


@query("magnitude_codes", f"WITH {_CODE_SQL} SELECT i::BIGINT AS magnitude, m::BIGINT AS value, bits::BIGINT AS size FROM ccode")
def _(spark, d):
    table = curves.inverse_companding(spark)
    return table.select(F.col("i").alias("magnitude"), F.col("m").alias("value"), F.when(F.col("m") == 0, entropy.RUN_BITS[1]).otherwise(entropy.magnitude_size(F.col("m"))).alias("size"))


def _run_codes_sql() -> str:
    source = "SELECT n AS run, n AS rest, 0 AS size, false AS stop FROM range(3072) t(n)"
    for n, bits in ((320, 13), (180, 13), (100, 11), (60, 10), (32, 9), (20, 8), (12, 7), (1, 1)):
        use = f"CASE WHEN stop THEN 0 ELSE least(rest // {n}, (31 - size) // {bits}) END"
        source = f"SELECT run, rest - ({use}) * {n} AS rest, size + ({use}) * {bits} AS size, stop OR rest // {n} > (31 - size) // {bits} AS stop FROM ({source})"
    return f"SELECT run::BIGINT AS run, size::BIGINT AS size, (run - rest)::BIGINT AS covered FROM ({source})"


@query("run_length_codes", _run_codes_sql())
def _(spark, d):
    return entropy.run_codes(spark)


@query(
    "packbits_runs",
    """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND rn > 1 THEN 0 ELSE 1 END AS change FROM (
        SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
    SELECT user_id, min(event_id) AS start, count(*) AS length, max(event_type) AS value FROM r GROUP BY user_id, run""",
)
def _(spark, d):
    return entropy.equal_runs(_table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(
    "carry_forward_state",
    """SELECT event_id, user_id,
      coalesce(last_value(CASE WHEN event_type = 'click' THEN floor(value)::BIGINT END IGNORE NULLS) OVER w, 0) AS last_click,
      coalesce(last_value(CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT END IGNORE NULLS) OVER w, 16) AS last_purchase
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(spark, d):
    whole = F.floor("value")
    states = {"last_click": (F.col("event_type") == "click", whole, 0), "last_purchase": (F.col("event_type") == "purchase", whole, 16)}
    return entropy.carried_forward(_table(spark, d, "events"), ["user_id"], "event_id", states).select("event_id", "user_id", *states)


@query(
    "chunk_sizes",
    f"""WITH {_BITS}, b AS (SELECT image_id, channel, subband, ceil(bits / 32) AS s FROM bandbits UNION ALL SELECT image_id, channel, 0, ceil(count(*) * 16 / 32) FROM qz WHERE subband = 0 GROUP BY image_id, channel)
    SELECT image_id::BIGINT AS image_id, channel::BIGINT AS channel, subband::BIGINT AS subband, sum(s)::BIGINT AS segments, grouping(image_id, channel, subband)::BIGINT AS depth
    FROM b GROUP BY ROLLUP (image_id, channel, subband)""",
)
def _(spark, d):
    low = wavelet.quantized(wavelet.pyramid(_planes(spark, d))).where("subband = 0").groupBy(*_RUN_KEYS).agg((F.count(F.lit(1)) * 16).alias("bits"))
    return entropy.chunk_sizes(_coded(spark, d).select(*_RUN_KEYS, "bits").unionByName(low))


@query("predictor_apply", O.out(O.PX, '(SELECT *, v - coalesce(lag(v) OVER (PARTITION BY image_id, "row" ORDER BY col), 0) AS dv FROM px)', image_id="image_id", row='"row"', col="col", v="dv"))
def _(spark, d):
    line = Window.partitionBy("image_id", "row").orderBy("col")
    return sensor(spark, d).withColumn("v", F.col("v") - F.coalesce(F.lag("v").over(line), F.lit(0)))


@query("predictor_undo", O.out(O.PX, '(SELECT *, sum(v) OVER (PARTITION BY image_id, "row" ORDER BY col) % 65536 AS s FROM px)', image_id="image_id", row='"row"', col="col", v="s"))
def _(spark, d):
    line = Window.partitionBy("image_id", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return sensor(spark, d).withColumn("v", F.sum("v").over(line) % 65536)


for _step in (2, 4):

    @query(f"predictor_apply_step{_step}", O.out(O.PX, f'(SELECT *, v - coalesce(lag(v) OVER (PARTITION BY image_id, "row", col % {_step} ORDER BY col), 0) AS dv FROM px)', image_id="image_id", row='"row"', col="col", v="(dv + 65536) % 65536"))
    def _(spark, d, step=_step):
        line = Window.partitionBy("image_id", "row", F.col("col") % step).orderBy("col")
        return sensor(spark, d).withColumn("v", (F.col("v") - F.coalesce(F.lag("v").over(line), F.lit(0)) + 65536) % 65536)

    @query(f"predictor_undo_step{_step}", O.out(O.PX, f'(SELECT *, sum(v) OVER (PARTITION BY image_id, "row", col % {_step} ORDER BY col) % 65536 AS s FROM px)', image_id="image_id", row='"row"', col="col", v="s"))
    def _(spark, d, step=_step):
        line = Window.partitionBy("image_id", "row", F.col("col") % step).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
        return sensor(spark, d).withColumn("v", F.sum("v").over(line) % 65536)


# --- image stage -------------------------------------------------------------------------------

_BLACK = [(0, 0, 60), (0, 1, 64), (1, 0, 66), (1, 1, 62)]


@query(
    "linearize",
    O.out(
        f"{O.PX}, blk AS (SELECT * FROM (VALUES {', '.join(map(str, _BLACK))}) t(pr, pc, black))",
        'px JOIN blk ON "row" % 2 = pr AND col % 2 = pc',
        image_id="image_id", row='"row"', col="col", v="least(65535, (greatest(0, v - black)::BIGINT * 65535 + (4095 - black) // 2) // (4095 - black))",
    ),
)
def _(spark, d):
    return stage.linearize(sensor(spark, d), spark.createDataFrame(_BLACK, "pr int, pc int, black int"), 4095, (2, 2))


@query("black_pattern", O.out(O.PX, '(SELECT image_id, "row" % 2 AS pr, col % 2 AS pc, min(v) AS low, (sum(v) * 2 + count(v)) // (count(v) * 2) AS mean, max(v) AS high FROM px GROUP BY ALL)', image_id="image_id", pr="pr", pc="pc", low="low", mean="mean", high="high"))
def _(spark, d):
    return stage.black_pattern(sensor(spark, d), (2, 2))


@query(
    "demosaic_fast",
    O.out(O.PX, '(SELECT image_id, "row" // 4 AS "row", col // 4 AS col, "row" % 2 * 2 + col % 2 AS color, (sum(v) + (count(*) >> 1)) // count(*) AS v FROM px GROUP BY ALL)', image_id="image_id", row='"row"', col="col", color="color", v="v"),
)
def _(spark, d):
    return stage.downsample_colors(sensor(spark, d), 4)


_BILINEAR = f"""WITH {O.PX}, t AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)),
m AS (SELECT p.image_id, p."row", p.col, q.v, abs(dr) + abs(dc) AS near, CASE WHEN q."row" % 2 = 0 AND q.col % 2 = 0 THEN 'r' WHEN q."row" % 2 = 1 AND q.col % 2 = 1 THEN 'b' ELSE 'g' END AS plane
  FROM px p, t JOIN px q ON q.image_id = p.image_id AND q."row" = p."row" + dr AND q.col = p.col + dc),
s AS (SELECT image_id, "row", col, plane, near, (sum(v) * 2 + count(*)) // (count(*) * 2) AS mean FROM m GROUP BY ALL),
k AS (SELECT image_id, "row", col, plane, min_by(mean, near) AS v FROM s GROUP BY ALL)
SELECT image_id::BIGINT AS image_id, "row"::BIGINT AS "row", col::BIGINT AS col, max(CASE WHEN plane = 'r' THEN v END)::BIGINT AS r, max(CASE WHEN plane = 'g' THEN v END)::BIGINT AS g, max(CASE WHEN plane = 'b' THEN v END)::BIGINT AS b
FROM k GROUP BY ALL"""


@query("demosaic_bilinear", _BILINEAR)
def _(spark, d):
    return stage.demosaic_bilinear(sensor(spark, d))


_BAD = 2100


def _bad_sql() -> str:
    lag = lambda n, p, o: f'lag(v, {n}) OVER (PARTITION BY image_id, "{p}" ORDER BY "{o}")'
    lead = lambda n, p, o: f'lead(v, {n}) OVER (PARTITION BY image_id, "{p}" ORDER BY "{o}")'
    n = [lag(2, "col", "row"), lead(2, "col", "row"), lag(2, "row", "col"), lead(2, "row", "col")]
    total = " + ".join(f"CASE WHEN n{i} <> {_BAD} THEN n{i} ELSE 0 END" for i in range(4))
    count = " + ".join(f"CASE WHEN n{i} <> {_BAD} THEN 1 ELSE 0 END" for i in range(4))
    return O.out(
        O.PX, f"(SELECT *, {total} AS s, {count} AS c FROM (SELECT *, {', '.join(f'{x} AS n{i}' for i, x in enumerate(n))} FROM px))",
        image_id="image_id", row='"row"', col="col", v=f"CASE WHEN v = {_BAD} AND c > 0 THEN (s * 2 + c) // (c * 2) ELSE v END",
    )


@query("bad_pixel_constant", _bad_sql())
def _(spark, d):
    return stage.fix_bad_constant(sensor(spark, d), _BAD)


@query("bad_pixel_semi", O.plain(f"{O.PX}, bad AS (SELECT o_orderkey % 500 AS br, o_custkey % 64 AS bc FROM orders)", '(SELECT * FROM px WHERE EXISTS (SELECT 1 FROM bad WHERE br = px."row" AND bc = px.col))', PIXEL))
def _(spark, d):
    bad = _table(spark, d, "orders").select((F.col("o_orderkey") % 500).cast("int").alias("row"), (F.col("o_custkey") % 64).cast("int").alias("col"))
    return sensor(spark, d).join(bad, ["row", "col"], "left_semi").select("image_id", "row", "col", "v")


@query("good_pixel_anti", O.plain(f"{O.PX}, bad AS (SELECT o_orderkey % 500 AS br, o_custkey % 64 AS bc FROM orders)", '(SELECT * FROM px WHERE NOT EXISTS (SELECT 1 FROM bad WHERE br = px."row" AND bc = px.col))', PIXEL))
def _(spark, d):
    bad = _table(spark, d, "orders").select((F.col("o_orderkey") % 500).cast("int").alias("row"), (F.col("o_custkey") % 64).cast("int").alias("col"))
    return sensor(spark, d).join(bad, ["row", "col"], "left_anti").select("image_id", "row", "col", "v")


_RECTS = "SELECT p_partkey AS rect_id, p_partkey % 480 AS t, p_size % 60 AS l, p_partkey % 480 + p_size % 7 AS b, p_size % 60 + 3 AS r FROM part"


@query("bad_rect_range", O.out(f"{O.PX}, rects AS ({_RECTS})", '(SELECT rect_id, count(*) AS n, sum(v) AS s FROM px JOIN rects ON "row" BETWEEN t AND b AND col BETWEEN l AND r GROUP BY rect_id)', rect_id="rect_id", samples="n", total="s"))
def _(spark, d):
    rects = _table(spark, d, "part").select(F.col("p_partkey").alias("rect_id"), (F.col("p_partkey") % 480).cast("int").alias("t"), (F.col("p_size") % 60).alias("l"), (F.col("p_partkey") % 480 + F.col("p_size") % 7).cast("int").alias("b"), (F.col("p_size") % 60 + 3).alias("r"))
    return stage.rectangle_sums(sensor(spark, d), rects, 64)


_AREA, _PITCH = (10, 4, 200, 60), (2, 3)
_IN = f'("row" BETWEEN 10 AND 199 AND col BETWEEN 4 AND 59 AND ("row" - 10) % 2 = 0 AND (col - 4) % 3 = 0)'
_U = "(v / 65535.0::DOUBLE)"


def _pin(x: str) -> str:
    return f"floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x})) * 65535.0::DOUBLE + 0.5::DOUBLE)"


@query("trim_bounds", O.plain(O.PX, '(SELECT * FROM px WHERE "row" BETWEEN 10 AND 199 AND col BETWEEN 4 AND 59)', PIXEL))
def _(spark, d):
    return stage.trim_bounds(sensor(spark, d), _AREA)


@query("map_table", O.out(f"{O.PX}, lut AS (SELECT i, (i * 3) // 2 + 7 AS t FROM range(3000) t(i))", "px JOIN lut ON lut.i = least(2999, v)", image_id="image_id", row='"row"', col="col", v=f"CASE WHEN {_IN} THEN t ELSE v END"))
def _(spark, d):
    table = spark.range(3000).select(F.col("id").cast("int").alias("i"), F.expr("cast(id * 3 div 2 + 7 as int)").alias("to"))
    return stage.map_table(sensor(spark, d), table, _AREA, _PITCH)


@query("map_polynomial", O.out(O.PX, "px", image_id="image_id", row='"row"', col="col", v=f"CASE WHEN {_IN} THEN {_pin(f'((2.5::DOUBLE * {_U} + -1.25::DOUBLE) * {_U} + 0.75::DOUBLE) * {_U} + 0.01::DOUBLE')} ELSE v END"))
def _(spark, d):
    return stage.map_polynomial(sensor(spark, d), _AREA, _PITCH, [0.01, 0.75, -1.25, 2.5])


@query("delta_row", O.out(f"{O.PX}, dl AS (SELECT i, (i % 7 - 3) / 1024.0::DOUBLE AS d FROM range(0, 400) t(i))", 'px LEFT JOIN dl ON dl.i = "row"', image_id="image_id", row='"row"', col="col", v=f"CASE WHEN d IS NULL THEN v ELSE {_pin(f'{_U} + d')} END"))
def _(spark, d):
    return stage.per_line(sensor(spark, d), spark.range(400).select(F.col("id").cast("int").alias("row"), ((F.col("id") % 7 - 3) / 1024.0).alias("d")), "row", False)


@query("scale_col", O.out(f"{O.PX}, dl AS (SELECT i, 1.0::DOUBLE + (i % 5) / 64.0::DOUBLE AS d FROM range(0, 50) t(i))", "px LEFT JOIN dl ON dl.i = col", image_id="image_id", row='"row"', col="col", v=f"CASE WHEN d IS NULL THEN v ELSE {_pin(f'{_U} * d')} END"))
def _(spark, d):
    return stage.per_line(sensor(spark, d), spark.range(50).select(F.col("id").cast("int").alias("col"), (1.0 + (F.col("id") % 5) / 64.0).alias("d")), "col", True)


@query("delta_col", O.out(f"{O.PX}, dl AS (SELECT i, (i % 5 - 2) / 512.0::DOUBLE AS d FROM range(0, 50) t(i))", "px LEFT JOIN dl ON dl.i = col", image_id="image_id", row='"row"', col="col", v=f"CASE WHEN d IS NULL THEN v ELSE {_pin(f'{_U} + d')} END"))
def _(spark, d):
    return stage.per_line(sensor(spark, d), spark.range(50).select(F.col("id").cast("int").alias("col"), ((F.col("id") % 5 - 2) / 512.0).alias("d")), "col", False)


@query("scale_row", O.out(f"{O.PX}, dl AS (SELECT i, 1.0::DOUBLE + (i % 3) / 32.0::DOUBLE AS d FROM range(0, 400) t(i))", 'px LEFT JOIN dl ON dl.i = "row"', image_id="image_id", row='"row"', col="col", v=f"CASE WHEN d IS NULL THEN v ELSE {_pin(f'{_U} * d')} END"))
def _(spark, d):
    return stage.per_line(sensor(spark, d), spark.range(400).select(F.col("id").cast("int").alias("row"), (1.0 + (F.col("id") % 3) / 32.0).alias("d")), "row", True)


@query(
    "opcode_list",
    O.out(
        f"""{O.PX}, lut AS (SELECT i, (i * 3) // 2 + 7 AS t FROM range(3000) t(i)), a AS (SELECT image_id, "row", col, CASE WHEN {_IN} THEN t ELSE v END AS v FROM px JOIN lut ON lut.i = least(2999, v)),
        b AS (SELECT image_id, "row", col, CASE WHEN {_IN} THEN {_pin(f'(-0.5::DOUBLE * {_U} + 1.25::DOUBLE) * {_U} + 0.0::DOUBLE')} ELSE v END AS v FROM a)""",
        '(SELECT * FROM b WHERE "row" BETWEEN 10 AND 199 AND col BETWEEN 4 AND 59)', image_id="image_id", row='"row"', col="col", v="v",
    ),
)
def _(spark, d):
    table = spark.range(3000).select(F.col("id").cast("int").alias("i"), F.expr("cast(id * 3 div 2 + 7 as int)").alias("to"))
    steps = [(stage.map_table, (table, _AREA, _PITCH)), (stage.map_polynomial, (_AREA, _PITCH, [0.0, 1.25, -0.5])), (stage.trim_bounds, (_AREA,))]
    return stage.apply_opcodes(sensor(spark, d), steps)


_LIST = "bad AS (SELECT DISTINCT o_orderkey % 500 AS br, o_custkey % 64 AS bc FROM orders WHERE o_orderstatus = 'P')"


@query("bad_pixel_isolated", O.out(_LIST, "(SELECT a.br, a.bc, NOT EXISTS (SELECT 1 FROM bad b WHERE abs(a.br - b.br) <= 2 AND abs(a.bc - b.bc) <= 2 AND (a.br <> b.br OR a.bc <> b.bc)) AS i, row_number() OVER (ORDER BY br, bc) AS n FROM bad a)", row="br", col="bc", place="n", isolated=("i", "BOOLEAN")))
def _(spark, d):
    return stage.isolated(_bad_list(spark, d), 2).withColumn("place", F.row_number().over(Window.orderBy("row", "col")))  # a bad list is small by nature


def _bad_list(spark, d) -> DataFrame:
    return _table(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 500).cast("int").alias("row"), (F.col("o_custkey") % 64).cast("int").alias("col")).distinct()


@query(
    "bad_pixel_list",
    f"""WITH {O.PX}, {_LIST}, n AS (SELECT dr, dc FROM (VALUES (-2, 0), (2, 0), (0, -2), (0, 2)) t(dr, dc)),
    f AS (SELECT b.br, b.bc, p.image_id, sum(p.v) AS s, count(*) AS c FROM bad b, n JOIN px p ON p."row" = b.br + dr AND p.col = b.bc + dc LEFT JOIN bad o ON o.br = p."row" AND o.bc = p.col WHERE o.br IS NULL GROUP BY ALL)
    SELECT px.image_id::BIGINT AS image_id, px."row"::BIGINT AS "row", px.col::BIGINT AS col, coalesce((s * 2 + c) // (c * 2), v)::BIGINT AS v FROM px LEFT JOIN f ON f.image_id = px.image_id AND br = px."row" AND bc = px.col""",
)
def _(spark, d):
    return stage.fix_bad_list(sensor(spark, d), _bad_list(spark, d))


@query("max_black", O.out(f"{O.PX}, p AS (SELECT \"row\" % 2 AS pr, col % 2 AS pc, min(v) AS b FROM px GROUP BY ALL), r AS (SELECT \"row\", min(v) - 900 AS d FROM px GROUP BY ALL), c AS (SELECT col, min(v) - 900 AS d FROM px GROUP BY ALL)", "(SELECT (SELECT max(b) FROM p) + greatest(0, (SELECT max(d) FROM r)) + greatest(0, (SELECT max(d) FROM c)) AS m)", level="m"))
def _(spark, d):
    px = sensor(spark, d)
    low = F.min("v")
    return stage.max_black(stage.black_pattern(px, (2, 2)).select(F.col("low").alias("black")), px.groupBy("row").agg((low - 900).alias("d")), px.groupBy("col").agg((low - 900).alias("d")))


@query("transparency_mask", O.out(f"{O.PX}", "px", image_id="image_id", row='"row"', col="col", v="CASE WHEN \"row\" BETWEEN 10 AND 199 AND col BETWEEN 4 AND 59 THEN v ELSE 0 END", alpha="CASE WHEN \"row\" BETWEEN 10 AND 199 AND col BETWEEN 4 AND 59 THEN 255 ELSE 0 END"))
def _(spark, d):
    inside = stage.in_area(_AREA)
    return sensor(spark, d).select("image_id", "row", "col", F.when(inside, F.col("v")).otherwise(0).alias("v"), F.when(inside, 255).otherwise(0).alias("alpha"))


@query("proxy_8bit", O.out(f"{O.PX}, c AS (SELECT image_id, \"row\" // 2 AS \"row\", col // 2 AS col, sum(v) AS s, count(*) AS n FROM px GROUP BY ALL)", "c", image_id="image_id", row='"row"', col="col", v="floor(sqrt(((s + n // 2) // n) / 4095.0::DOUBLE) * 255.0::DOUBLE + 0.5::DOUBLE)"))
def _(spark, d):
    return stage.proxy(sensor(spark, d), 2, 4095)


@query("area_put", O.out(f"{O.PX}, s AS (SELECT image_id, \"row\" + 100 AS \"row\", col + 7 AS col, v AS w FROM px WHERE \"row\" < 20 AND col < 30)", 'px LEFT JOIN s USING (image_id, "row", col)', image_id="image_id", row='"row"', col="col", v="coalesce(w, v)"))
def _(spark, d):
    return stage.put(sensor(spark, d), stage.get(sensor(spark, d), (0, 0, 20, 30)), 100, 7)


@query("sample_conversions", O.out(O.PX, "px", image_id="image_id", row='"row"', col="col", u8="v >> 4", s16="v - 2048", milli="floor(v / 4095.0::DOUBLE * 1000.0::DOUBLE + 0.5::DOUBLE)", filled="CASE WHEN v < 1500 THEN 0 ELSE v END", equal=('v = 2100', "BOOLEAN")))
def _(spark, d):
    v = F.col("v")
    return sensor(spark, d).select("image_id", "row", "col", F.shiftright(v, 4).alias("u8"), (v - 2048).alias("s16"), F.floor(v / F.lit(4095.0) * 1000.0 + 0.5).alias("milli"), F.when(v < 1500, 0).otherwise(v).alias("filled"), (v == 2100).alias("equal"))


@query("image_buffer", O.out(O.PX, "(SELECT image_id, \"row\", list(v ORDER BY col) AS l FROM px GROUP BY ALL)", image_id="image_id", row='"row"', samples="len(l)", line=("array_to_string(l, ',')", "VARCHAR")))
def _(spark, d):
    lines = sensor(spark, d).groupBy("image_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", "v"))).alias("l"))
    return lines.select("image_id", "row", F.size("l").alias("samples"), F.array_join(F.transform("l", lambda x: x["v"].cast("string")), ",").alias("line"))


@query("digest_check", f"""WITH {O.PX}, t AS (SELECT image_id, "row", md5(string_agg(v::VARCHAR, ',' ORDER BY col)) AS d FROM px GROUP BY ALL), u AS (SELECT image_id, "row", md5(string_agg((CASE WHEN "row" % 50 = 0 AND col = 3 THEN v + 1 ELSE v END)::VARCHAR, ',' ORDER BY col)) AS e FROM px GROUP BY ALL)
    SELECT image_id::BIGINT AS image_id, count(*)::BIGINT AS lines, sum(CASE WHEN d = e THEN 1 ELSE 0 END)::BIGINT AS valid, min(CASE WHEN d <> e THEN "row" END)::BIGINT AS first_bad FROM t JOIN u USING (image_id, "row") GROUP BY image_id""")
def _(spark, d):
    px = sensor(spark, d)
    changed = px.withColumn("v", F.when((F.col("row") % 50 == 0) & (F.col("col") == 3), F.col("v") + 1).otherwise(F.col("v")))
    return stage.validated(stage.line_digests(px), stage.line_digests(changed))


@query("inverse_function", """WITH g AS (SELECT i, (i * i * 3 + i * 40) // 64 AS y FROM range(0, 257) t(i)), t AS (SELECT o, max(i) AS lo FROM range(0, 3000, 7) u(o) JOIN g ON y <= o GROUP BY o)
    SELECT o::BIGINT AS y, (CASE WHEN b.y IS NULL THEN a.i * 1024 ELSE a.i * 1024 + (o - a.y) * 1024 // (b.y - a.y) END)::BIGINT AS x FROM t JOIN g a ON a.i = lo LEFT JOIN g b ON b.i = lo + 1""")
def _(spark, d):
    return render.inverse_table(spark, [(i * i * 3 + i * 40) // 64 for i in range(257)], range(0, 3000, 7))


_GAIN = """grid AS (SELECT r AS gr, c AS gc, 1.0::DOUBLE + (r * 5 + c * 3) % 8 / 16.0::DOUBLE AS gain FROM range(0, 64) a(r), range(0, 5) b(c)),
g AS (SELECT image_id, "row", col, v, "row" / 32.0::DOUBLE AS fr, col / 16.0::DOUBLE AS fc, least(63, "row" // 32) AS r0, least(4, col // 16) AS c0 FROM px),
g4 AS (SELECT g.*, fr - r0 AS tr, fc - c0 AS tc, a.gain AS ga, b.gain AS gb, c.gain AS gc_, e.gain AS gd FROM g
  JOIN grid a ON a.gr = r0 AND a.gc = c0 JOIN grid b ON b.gr = r0 AND b.gc = least(4, c0 + 1) JOIN grid c ON c.gr = least(63, r0 + 1) AND c.gc = c0 JOIN grid e ON e.gr = least(63, r0 + 1) AND e.gc = least(4, c0 + 1))"""


@query("gain_map", O.out(f"{O.PX}, {_GAIN}", "g4", image_id="image_id", row='"row"', col="col", v=_pin(f"{_U} * ((ga * (1.0 - tc) + gb * tc) * (1.0 - tr) + (gc_ * (1.0 - tc) + gd * tc) * tr)")))
def _(spark, d):
    grid = spark.range(64 * 5).select(F.expr("id div 5").alias("gr"), (F.col("id") % 5).alias("gc")).withColumn("gain", 1.0 + (F.col("gr") * 5 + F.col("gc") * 3) % 8 / 16.0)
    return stage.gain_map(sensor(spark, d), grid, (32, 16), (63, 4))


_R2 = '((("row" - 250.0::DOUBLE) * ("row" - 250.0::DOUBLE) + (col - 32.0::DOUBLE) * (col - 32.0::DOUBLE)) / 65536.0::DOUBLE)'


@query("vignette", O.out(O.PX, "px", image_id="image_id", row='"row"', col="col", v=_pin(f"{_U} * (1.0::DOUBLE + {_R2} * (-0.125::DOUBLE * {_R2} + 0.5::DOUBLE))")))
def _(spark, d):
    return stage.vignette(sensor(spark, d), (250.0, 32.0), 256.0, [0.5, -0.125])


def _resample_sql() -> str:
    def one(name: str, source: str, line: str, size_in: str, size_out: str) -> str:
        other = "col" if line == "row" else "row"
        d = "abs(a - i)"
        w = f"floor(CASE WHEN {d} < 1 THEN ((1.25::DOUBLE * {d} - 2.25::DOUBLE) * {d}) * {d} + 1.0::DOUBLE WHEN {d} < 2 THEN ((-0.75::DOUBLE * {d} + 3.75::DOUBLE) * {d} - 6.0::DOUBLE) * {d} + 3.0::DOUBLE ELSE 0 END * 1024 + 0.5::DOUBLE)::BIGINT"
        return f"""{name}o AS (SELECT unnest(range(0, {size_out})) AS o, ({size_in})::DOUBLE / ({size_out})::DOUBLE AS ratio),
{name}w AS (SELECT o, i, {w} AS w FROM (SELECT o, a, floor(a)::BIGINT - 1 + k AS i FROM (SELECT o, (o + 0.5::DOUBLE) * ratio - 0.5::DOUBLE AS a FROM {name}o), range(4) u(k)) WHERE i BETWEEN 0 AND {size_in} - 1),
{name} AS (SELECT image_id, o AS "{line}", "{other}", least(4095, greatest(0, (sum(v * w)::BIGINT * 2 + sum(w)::BIGINT) // (sum(w)::BIGINT * 2))) AS v FROM {source} JOIN {name}w ON i = "{line}" GROUP BY ALL)"""

    height = '(SELECT max("row") + 1 FROM px)'
    return O.plain(f"{O.PX}, {one('a', 'px', 'row', height, f'({height} // 4)')}, {one('b', 'a', 'col', '64', '24')}", "b", PIXEL)


def _height(pixels: DataFrame) -> int:
    """Rows of the images: one aggregate, read before the plan that needs it is made."""
    return (pixels.agg(F.max("row")).head()[0] or 0) + 1


@query("resample_bicubic", _resample_sql())
def _(spark, d):
    px = sensor(spark, d)
    height = _height(px)
    return stage.resample(stage.resample(px, "row", height, height // 4), "col", 64, 24)


@query("histogram", O.out(O.PX, '(SELECT image_id, v, count(*) AS n FROM px WHERE "row" BETWEEN 10 AND 199 GROUP BY ALL)', image_id="image_id", v="v", n="n"))
def _(spark, d):
    return sensor(spark, d).where("row between 10 and 199").groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


@query(
    "image_diff",
    O.out(f"{O.PX}, b AS (SELECT image_id, \"row\" + 1 AS \"row\", col, v AS w FROM px)", '(SELECT image_id, count(*) AS n, sum(CASE WHEN v IS NOT DISTINCT FROM w THEN 0 ELSE 1 END) AS k, max(abs(v - w)) AS m FROM px FULL JOIN b USING (image_id, "row", col) GROUP BY image_id)', image_id="image_id", samples="n", differing="k", greatest="m"),
)
def _(spark, d):
    px = sensor(spark, d)
    return stage.differences(px, px.withColumn("row", F.col("row") + 1))


@query(
    "tile_digest",
    f"""WITH {O.PX}, t AS (SELECT image_id, "row" // 16 AS tr, col // 16 AS tc, md5(string_agg(v::VARCHAR, ',' ORDER BY "row", col)) AS d FROM px GROUP BY ALL)
    SELECT image_id::BIGINT AS image_id, count(*)::BIGINT AS tiles, md5(string_agg(d, '' ORDER BY tr, tc)) AS digest FROM t GROUP BY image_id""",
)
def _(spark, d):
    return stage.tile_digest(sensor(spark, d), 16)


for _flip, (_r, _c) in {"horizontal": ('"row"', "63 - col"), "vertical": ('-"row"', "col"), "both": ('-"row"', "63 - col")}.items():

    @query(f"flip_{_flip}", O.out(O.PX, "px", image_id="image_id", row=_r, col=_c, v="v >> 2"))
    def _(spark, d, flip=_flip):
        row = F.col("row") if flip == "horizontal" else -F.col("row")
        col = F.col("col") if flip == "vertical" else F.lit(63) - F.col("col")
        return sensor(spark, d).select("image_id", row.alias("row"), col.alias("col"), F.shiftright("v", 2).alias("v"))


@query("channel_geometry", O.out(O.planes(), '(SELECT image_id, channel, max(col) + 1 AS w, max("row") + 1 AS h FROM planes GROUP BY ALL)', image_id="image_id", channel="channel", width="w", height="h"))
def _(spark, d):
    return _planes(spark, d).groupBy("image_id", "channel").agg((F.max("col") + 1).alias("width"), (F.max("row") + 1).alias("height"))


# --- scalars -----------------------------------------------------------------------------------


@query("string_ops", scalars.STRING_SQL)
def _(spark, d):
    return scalars.string_ops(_table(spark, d, "customer"))


@query("iso_dates", scalars.DATES_SQL)
def _(spark, d):
    return scalars.iso_dates(_table(spark, d, "orders"))


@query("exif_dates", scalars.EXIF_SQL)
def _(spark, d):
    return scalars.exif_dates(_table(spark, d, "orders"))


@query("json_props", scalars.JSON_SQL)
def _(spark, d):
    return scalars.json_props(_table(spark, d, "events"))


@query("map_merge", scalars.MERGE_SQL)
def _(spark, d):
    return scalars.map_merge(_table(spark, d, "customer"), _table(spark, d, "nation"))


@query("dyadic_rational", scalars.DYADIC_SQL)
def _(spark, d):
    return scalars.dyadic(_table(spark, d, "lineitem"))


@query("color_matrix", scalars.MATRIX_SQL)
def _(spark, d):
    return scalars.color_matrix(_table(spark, d, "supplier"))


@query("pixel_format", scalars.FORMAT_SQL)
def _(spark, d):
    return scalars.pixel_format(_table(spark, d, "lineitem"))


# --- rendering ---------------------------------------------------------------------------------

_X = "(v / 4095.0::DOUBLE)"


def _milli(x: str) -> str:
    return f"floor(({x}) * 1000.0::DOUBLE + 0.5::DOUBLE)"


@query(
    "tone_curves",
    O.out(
        O.PX, "px", image_id="image_id", row='"row"', col="col",
        srgb=_milli(f"CASE WHEN {_X} <= 0.0031308::DOUBLE THEN {_X} * 12.92::DOUBLE ELSE 1.055::DOUBLE * power({_X}, 1.0::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE END"),
        linear=_milli(f"CASE WHEN {_X} <= 0.04045::DOUBLE THEN {_X} / 12.92::DOUBLE ELSE power(({_X} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"),
        gamma=_milli(f"power({_X}, 1.0::DOUBLE / 1.8::DOUBLE)"),
        ramp=_milli(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN {_X} <= 0.375::DOUBLE THEN 0.0 WHEN {_X} >= 0.625::DOUBLE THEN ({_X} - 0.5::DOUBLE) * 4.0::DOUBLE ELSE 8.0::DOUBLE * ({_X} - 0.375::DOUBLE) * ({_X} - 0.375::DOUBLE) END))"),
        sigma=_milli(f"sqrt({_X} * 0.25::DOUBLE + 0.0625::DOUBLE)"),
    ),
)
def _(spark, d):
    x = F.col("v") / F.lit(4095.0)
    milli = lambda e: F.floor(e * 1000.0 + 0.5)
    return sensor(spark, d).select(
        "image_id", "row", "col", milli(render.srgb_encode(x)).alias("srgb"), milli(render.srgb_decode(x)).alias("linear"), milli(render.gamma_encode(x, 1.8)).alias("gamma"),
        milli(render.exposure_ramp(x, 0.5, 0.75, 0.125)).alias("ramp"), milli(render.noise_sigma(x, 0.25, 0.0625)).alias("sigma"),
    )


_GAINS, _M = (1.875, 1.0, 1.75), [1.5, -0.25, -0.25, -0.375, 1.625, -0.25, 0.125, -0.5, 1.375]


def _balanced_sql() -> str:
    c = [f"least(1.0::DOUBLE, {x} / 4095.0::DOUBLE * {k}::DOUBLE)" for x, k in zip("rgb", _GAINS, strict=True)]
    ctes = f"""{O.PX}, cell AS (SELECT image_id, "row" // 2 AS "row", col // 2 AS col, max(CASE WHEN "row" % 2 = 0 AND col % 2 = 0 THEN v END) AS r, max(CASE WHEN "row" % 2 = 0 AND col % 2 = 1 THEN v END) AS g, max(CASE WHEN "row" % 2 = 1 AND col % 2 = 1 THEN v END) AS b FROM px GROUP BY ALL),
    s AS (SELECT image_id, "row", col, {c[0]} AS x, {c[1]} AS y, {c[2]} AS z FROM cell),
    m AS (SELECT image_id, "row", col, {', '.join(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, x * {_M[3 * i]}::DOUBLE + y * {_M[3 * i + 1]}::DOUBLE + z * {_M[3 * i + 2]}::DOUBLE)) AS {n}" for i, n in enumerate("rgb"))} FROM s),
    h AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS gap FROM m)"""
    hue = "CASE WHEN gap = 0 THEN 0.0::DOUBLE WHEN r = top THEN (g - b) / gap + CASE WHEN g < b THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END WHEN g = top THEN 2.0::DOUBLE + (b - r) / gap ELSE 4.0::DOUBLE + (r - g) / gap END"
    return O.out(ctes, "h", image_id="image_id", row='"row"', col="col", r=_milli("r"), g=_milli("g"), b=_milli("b"), hue=_milli(hue), saturation=_milli("CASE WHEN top > 0 THEN gap / top ELSE 0.0::DOUBLE END"))


@query("white_balance_hsv", _balanced_sql())
def _(spark, d):
    place = lambda r, c: F.max(F.when((F.col("row") % 2 == r) & (F.col("col") % 2 == c), F.col("v"))) / F.lit(4095.0)
    cells = sensor(spark, d).groupBy("image_id", F.shiftright("row", 1).alias("r0"), F.shiftright("col", 1).alias("c0")).agg(place(0, 0).alias("r"), place(0, 1).alias("g"), place(1, 1).alias("b"))
    done = cells.select("image_id", F.col("r0").alias("row"), F.col("c0").alias("col"), *[x.alias(n) for x, n in zip(render.balanced(F.col("r"), F.col("g"), F.col("b"), _GAINS, _M), "rgb", strict=True)])
    h, s, _v = render.hsv(F.col("r"), F.col("g"), F.col("b"))
    milli = lambda e: F.floor(e * 1000.0 + 0.5)
    return done.select("image_id", "row", "col", *[milli(F.col(n)).alias(n) for n in "rgb"], milli(h).alias("hue"), milli(s).alias("saturation"))


@query(
    "warp_radial",
    O.out(
        f"""{O.PX}, m AS MATERIALIZED (SELECT * FROM px), t AS (SELECT image_id, "row", col, ("row" - 250.0::DOUBLE) / 256.0::DOUBLE AS dr, (col - 32.0::DOUBLE) / 256.0::DOUBLE AS dc FROM m),
        q AS (SELECT *, 0.0625::DOUBLE * (dr * dr + dc * dc) + 0.9375::DOUBLE AS k FROM t),
        s AS MATERIALIZED (SELECT *, floor(250.0::DOUBLE + dr * k * 256.0::DOUBLE + 0.5::DOUBLE)::INT AS sr, floor(32.0::DOUBLE + dc * k * 256.0::DOUBLE + 0.5::DOUBLE)::INT AS sc FROM q)""",
        's JOIN m p ON p.image_id = s.image_id AND p."row" = sr AND p.col = sc', image_id="s.image_id", row='s."row"', col="s.col", v="p.v",
    ),
)
def _(spark, d):
    return render.warp_nearest(sensor(spark, d), (250.0, 32.0), 256.0, [0.9375, 0.0625])


@query(
    "edge_replicate",
    O.out(f'{O.PX}, h AS (SELECT max("row") + 1 AS h FROM px), g AS (SELECT unnest(range(-2, h + 2)) AS r, h FROM h), gc AS (SELECT * FROM g, range(-2, 66) b(c))', 'gc JOIN px ON px."row" = least(h - 1, greatest(0, r)) AND px.col = least(63, greatest(0, c))', image_id="image_id", row="r", col="c", v="v"),
)
def _(spark, d):
    px = sensor(spark, d)
    return render.replicated_edges(px, _height(px), 64, 2)


def _warp_sql(places: str) -> str:
    cubic = lambda d: f"floor(CASE WHEN {d} < 1 THEN ((1.25::DOUBLE * {d} - 2.25::DOUBLE) * {d}) * {d} + 1.0::DOUBLE WHEN {d} < 2 THEN ((-0.75::DOUBLE * {d} + 3.75::DOUBLE) * {d} - 6.0::DOUBLE) * {d} + 3.0::DOUBLE ELSE 0.0 END * 1024.0::DOUBLE + 0.5::DOUBLE)::BIGINT"
    return O.out(
        f"""{O.PX}, m AS MATERIALIZED (SELECT * FROM px), h AS (SELECT max("row") + 1 AS h FROM m), t AS (SELECT image_id, "row", col, ("row" - 250.0::DOUBLE) / 256.0::DOUBLE AS y, (col - 32.0::DOUBLE) / 256.0::DOUBLE AS x FROM m),
        q AS (SELECT *, x * x + y * y AS r2 FROM t), {places},
        w AS (SELECT p, k, {cubic('abs(p / 128.0::DOUBLE - k)')} AS w FROM range(128) a(p), range(-1, 3) b(k)),
        g AS (SELECT image_id, "row", col, a.w * b.w AS w, least(h - 1, greatest(0, r + a.k)) AS gr, least(63, greatest(0, c + b.k)) AS gc
          FROM (SELECT *, floor(sr / 128.0) AS r, floor(sc / 128.0) AS c, sr - floor(sr / 128.0) * 128 AS pr, sc - floor(sc / 128.0) * 128 AS pc FROM s) JOIN w a ON a.p = pr JOIN w b ON b.p = pc, h),
        d AS (SELECT g.image_id, g."row", g.col, sum(v * w)::BIGINT AS s, sum(w)::BIGINT AS w FROM g JOIN m ON m.image_id = g.image_id AND m."row" = gr AND m.col = gc GROUP BY ALL)""",
        "d", image_id="image_id", row='"row"', col="col", v="least(4095, greatest(0, floor((s * 2 + w)::DOUBLE / (w * 2)::DOUBLE)))",
    )


_PLACE = "floor(({c}::DOUBLE + ({d}) * 256.0::DOUBLE) * 128.0::DOUBLE + 0.5::DOUBLE)::BIGINT"


@query(
    "warp_rectilinear",
    _warp_sql(
        f"""u AS (SELECT *, ((0.015625::DOUBLE * r2 + -0.03125::DOUBLE) * r2 + 0.0625::DOUBLE) * r2 + 0.9375::DOUBLE AS k FROM q),
        s AS (SELECT image_id, "row", col, {_PLACE.format(c='250.0', d='k * y + 0.0078125::DOUBLE * (r2 + 2.0::DOUBLE * y * y) + -0.0078125::DOUBLE * (x * y)')} AS sr,
          {_PLACE.format(c='32.0', d='k * x + 0.015625::DOUBLE * (x * y) + -0.00390625::DOUBLE * (r2 + 2.0::DOUBLE * x * x)')} AS sc FROM u)"""
    ),
)
def _(spark, d):
    px = sensor(spark, d)
    return render.gather_bicubic(px, render.warp_places(px, (250.0, 32.0), 256.0, [0.9375, 0.0625, -0.03125, 0.015625], (0.0078125, -0.00390625)), _height(px), 64)


@query(
    "warp_fisheye",
    _warp_sql(
        f"""u0 AS (SELECT *, sqrt(r2) AS r, atan(sqrt(r2)) AS t FROM q), u AS (SELECT *, CASE WHEN r > 0 THEN t * (((0.0::DOUBLE * (t * t) + 0.03125::DOUBLE) * (t * t) + 0.125::DOUBLE) * (t * t) + 0.9375::DOUBLE) / r ELSE 0.9375::DOUBLE END AS k FROM u0),
        s AS (SELECT image_id, "row", col, {_PLACE.format(c='250.0', d='k * y')} AS sr, {_PLACE.format(c='32.0', d='k * x')} AS sc FROM u)"""
    ),
)
def _(spark, d):
    px = sensor(spark, d)
    return render.gather_bicubic(px, render.warp_places(px, (250.0, 32.0), 256.0, [0.9375, 0.125, 0.03125, 0.0], fisheye=True), _height(px), 64)
