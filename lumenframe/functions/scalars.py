"""Metadata scalar functions (strings, dates, JSON, maps, small matrices) as column expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_upper(x: Column) -> Column:
    return F.translate(x, LOWER, UPPER)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def replace_first(x: Column, what: str, by: str) -> Column:
    at = F.instr(x, what)
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), F.lit(by), F.substring(x, at + len(what), F.length(x)))).otherwise(x)


def trim_prefix(x: Column, prefix: str) -> Column:
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)


def force_ascii(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\x00-\x7F]", "?")


def string_ops(customers: DataFrame) -> DataFrame:
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return customers.select(
        "c_custkey", F.octet_length(name).alias("bytes"), ascii_upper(name).alias("up"), ascii_lower(seg).alias("low"), replace_first(name, "0", "_").alias("first"),
        trim_prefix(name, "Customer#").alias("rest"), F.startswith(ascii_lower(name), F.lit("cust")).alias("starts"), F.endswith(seg, F.lit("E")).alias("ends"),
        F.contains(seg, F.lit("IL")).alias("has"), F.rtrim(F.concat(seg, F.lit("  "))).alias("trimmed"), F.base64(name.cast("binary")).alias("b64"), force_ascii(name).alias("ascii"),
        F.md5(name.cast("binary")).alias("digest"),
    )


STRING_SQL = """SELECT c_custkey, strlen(c_name)::BIGINT AS bytes, upper(c_name) AS up, lower(c_mktsegment) AS low,
  CASE WHEN instr(c_name, '0') > 0 THEN c_name[:instr(c_name, '0') - 1] || '_' || c_name[instr(c_name, '0') + 1:] ELSE c_name END AS "first",
  CASE WHEN starts_with(c_name, 'Customer#') THEN c_name[10:] ELSE c_name END AS rest, starts_with(lower(c_name), 'cust') AS starts, ends_with(c_mktsegment, 'E') AS ends,
  contains(c_mktsegment, 'IL') AS has, rtrim(c_mktsegment || '  ') AS trimmed, base64(c_name::BLOB) AS b64, regexp_replace(c_name, '[^\\x00-\\x7F]', '?', 'g') AS ascii, md5(c_name) AS digest
FROM customer"""


def iso_dates(orders: DataFrame) -> DataFrame:
    t = F.col("o_orderdate")
    return orders.select(
        "o_orderkey", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format(t, "yyyyMMdd").alias("iptc"),
        F.format_string("%d-%d-%d %d:%d:%d", *[f(t) for f in (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)]).alias("printed"),
        F.datediff(t, F.lit("1992-01-01").cast("date")).alias("days"),
    )


DATES_SQL = """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y%m%d') AS iptc,
  format('{}-{}-{} {}:{}:{}', year(o_orderdate), month(o_orderdate), day(o_orderdate), hour(o_orderdate), minute(o_orderdate), second(o_orderdate)) AS printed,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS days FROM orders"""


def exif_parts(text: Column) -> Column:
    """Six integers in order, separated by blanks and colons only; null if the text has another shape."""
    shape = r"^[ :]*\d+[ :]+\d+[ :]+\d+[ :]+\d+[ :]+\d+[ :]+\d+"
    return F.when(text.rlike(shape), F.slice(F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint")), 1, 6))


def valid_date(parts: Column) -> Column:
    """Field ranges only: a 31st of February passes."""
    y, m, d, h, i, s = (parts[k] for k in range(6))
    return y.between(1, 9999) & m.between(1, 12) & d.between(1, 31) & h.between(0, 23) & i.between(0, 59) & s.between(0, 59)


def exif_dates(orders: DataFrame) -> DataFrame:
    pattern = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "yyyy:15:dd HH:mm:ss"))
    parts = exif_parts(pattern)
    return orders.select("o_orderkey", pattern.alias("text"), parts[0].alias("year"), parts[1].alias("month"), parts[2].alias("day"), F.coalesce(valid_date(parts), F.lit(False)).alias("valid"))


EXIF_SQL = """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y:15:%d %H:%M:%S') END AS "text" FROM orders),
p AS (SELECT *, CASE WHEN o_orderkey % 3 <> 1 THEN regexp_extract_all("text", '\\d+') END AS x FROM t)
SELECT o_orderkey, "text", x[1]::BIGINT AS "year", x[2]::BIGINT AS "month", x[3]::BIGINT AS "day", coalesce(x[2]::BIGINT BETWEEN 1 AND 12, false) AS valid FROM p"""


def json_props(events: DataFrame) -> DataFrame:
    page = F.get_json_object("props", "$.page")
    return events.select(
        "event_id", F.json_object_keys("props").alias("keys"), page.alias("page"), F.get_json_object("props", "$.missing").isNull().alias("no_missing"), F.size(F.json_object_keys("props")).alias("n_keys"),
    )


JSON_SQL = """SELECT event_id, json_keys(props) AS "keys", json_extract_string(props, '$.page') AS "page", json_extract(props, '$.missing') IS NULL AS no_missing, len(json_keys(props))::BIGINT AS n_keys FROM events"""


def merged(base: Column, over: Column) -> Column:
    """Two maps; entries of `over` win."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def map_merge(customers: DataFrame, nations: DataFrame) -> DataFrame:
    n = nations.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    base = F.create_map(F.lit("maker"), F.col("n_name"), F.lit("model"), F.col("c_name"), F.lit("unit"), F.lit("mm"))
    over = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("model"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("note"), F.col("c_mktsegment")))
    entries = F.array_sort(F.transform(F.map_entries(merged(base, over)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return customers.join(n, "c_nationkey").select("c_custkey", F.array_join(entries, ";").alias("merged"))


MERGE_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'maker=' || n_name || ';model=' || c_mktsegment || ';unit=mm'
  ELSE 'maker=' || n_name || ';model=' || c_name || ';note=' || c_mktsegment || ';unit=mm' END AS merged FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def dyadic(lines: DataFrame, tolerance: float = 0.125) -> DataFrame:
    """The least k of 1..30 for which g - trunc(g 2^k) / 2^k is under the tolerance, and that numerator."""
    g = F.col("l_tax") * 3.7 + F.col("l_discount")
    within = F.filter(F.sequence(F.lit(1), F.lit(30)), lambda k: g - F.floor(g * F.pow(F.lit(2.0), k)) / F.pow(F.lit(2.0), k) < tolerance)
    k = within[0]
    return lines.select("l_orderkey", "l_linenumber", k.alias("k"), F.floor(g * F.pow(F.lit(2.0), k)).alias("num"))


DYADIC_SQL = """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, k::BIGINT AS k, floor(g * power(2.0::DOUBLE, k))::BIGINT AS num FROM (
  SELECT *, list_filter(range(1, 31), lambda k: g - floor(g * power(2.0::DOUBLE, k)) / power(2.0::DOUBLE, k) < 0.125)[1] AS k
  FROM (SELECT l_orderkey, l_linenumber, l_tax * 3.7::DOUBLE + l_discount AS g FROM lineitem))"""


def adjugate_inverse(m: list[Column]) -> list[Column]:
    """Inverse of a row-major 3x3 matrix in closed form; null where it is singular."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cof = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return [x / F.nullif(det, F.lit(0.0)) for x in cof]


def matrix_product(x: list[Column], y: list[Column]) -> list[Column]:
    return [x[3 * r] * y[c] + x[3 * r + 1] * y[3 + c] + x[3 * r + 2] * y[6 + c] for r in range(3) for c in range(3)]


def _camera() -> list[Column]:
    k = F.col("s_suppkey").cast("double")
    off = lambda n: (F.col("s_suppkey") % n).cast("double") / 64.0
    return [F.lit(1.5) + off(7), off(5), off(3), off(4), F.lit(1.25) + off(9), off(2), off(6), off(8), F.lit(1.75) + k * 0.0]


# Linear sRGB to XYZ under D50, row by row.
SRGB_TO_XYZ = (0.4361, 0.3851, 0.1431, 0.2225, 0.7169, 0.0606, 0.0139, 0.0971, 0.7142)


def camera_matrix(camera: list[Column], gains: list[Column], weight: Column) -> list[Column]:
    """XYZ to camera: the inverse of sRGB_TO_XYZ x (weight x camera + (1 - weight) x identity) x diagonal of the gains. Null where singular."""
    mixed = [c * weight + (1.0 - weight) if i % 4 == 0 else c * weight for i, c in enumerate(camera)]
    whole = matrix_product([F.lit(x) for x in SRGB_TO_XYZ], mixed)
    return adjugate_inverse([x * gains[i % 3] for i, x in enumerate(whole)])


def color_matrix(suppliers: DataFrame) -> DataFrame:
    """camera_matrix of a camera, gains and a weight that depend on the supplier, in units of 1/1000."""
    k = F.col("s_suppkey")
    gains = [1.0 + (k % 11).cast("double") / 16.0, F.lit(1.0), 1.0 + (k % 13).cast("double") / 16.0]
    found = camera_matrix(_camera(), gains, (k % 5).cast("double") / 4.0)
    return suppliers.select("s_suppkey", *[F.floor(x * 1000.0 + 0.5).alias(f"m{i}") for i, x in enumerate(found)])


def _matrix_sql() -> str:
    """Gauss-Jordan elimination without pivoting, column by column, on the matrix beside the identity."""
    off = lambda n: f"(s_suppkey % {n})::DOUBLE / 64.0::DOUBLE"
    camera = [f"1.5::DOUBLE + {off(7)}", off(5), off(3), off(4), f"1.25::DOUBLE + {off(9)}", off(2), off(6), off(8), "1.75::DOUBLE"]
    source = f"SELECT s_suppkey, (s_suppkey % 5)::DOUBLE / 4.0::DOUBLE AS w, 1.0::DOUBLE + (s_suppkey % 11)::DOUBLE / 16.0::DOUBLE AS g0, 1.0::DOUBLE AS g1, 1.0::DOUBLE + (s_suppkey % 13)::DOUBLE / 16.0::DOUBLE AS g2, {', '.join(f'{x} AS c{i}' for i, x in enumerate(camera))} FROM supplier"
    source = f"SELECT s_suppkey, g0, g1, g2, {', '.join(f'c{i} * w' + (' + (1.0::DOUBLE - w)' if i % 4 == 0 else '') + f' AS t{i}' for i in range(9))} FROM ({source})"
    rows = [[" + ".join(f"{SRGB_TO_XYZ[3 * r + k]}::DOUBLE * t{3 * k + c}" for k in range(3)) for c in range(3)] for r in range(3)]
    cells = [f"({rows[r][c]}) * g{c} AS a{r}{c}" if c < 3 else f"{float(c - 3 == r)}::DOUBLE AS a{r}{c}" for r in range(3) for c in range(6)]
    source = f"SELECT s_suppkey, {', '.join(cells)} FROM ({source})"
    for p in range(3):
        scaled = [f"a{r}{c} / a{p}{p} AS a{r}{c}" if r == p else f"a{r}{c}" for r in range(3) for c in range(6)]
        source = f"SELECT s_suppkey, {', '.join(scaled)} FROM ({source})"
        cleared = [f"a{r}{c}" if r == p else f"a{r}{c} - a{p}{c} * a{r}{p} AS a{r}{c}" for r in range(3) for c in range(6)]
        source = f"SELECT s_suppkey, {', '.join(cleared)} FROM ({source})"
    return f"SELECT s_suppkey, {', '.join(f'floor(a{i // 3}{3 + i % 3} * 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS m{i}' for i in range(9))} FROM ({source})"


MATRIX_SQL = _matrix_sql()


def pixel_format(lines: DataFrame) -> DataFrame:
    """Format from the Bayer phase and the white level; null where there is none."""
    phase = F.when(F.col("l_returnflag") == "R", "rggb").otherwise("gbrg")
    white = F.when(F.col("l_quantity") < 10, 4095).when(F.col("l_quantity") < 30, 16383).otherwise(65535)
    named = (
        F.when((phase == "rggb") & (white == 4095), "rggb12").when((phase == "rggb") & (white == 16383), "rggb14").when((phase == "gbrg") & (white == 4095), "gbrg12")
    )
    return lines.select("l_orderkey", "l_linenumber", named.alias("format"), (1.0 / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("neutral"))


FORMAT_SQL = """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 'rggb12' WHEN l_returnflag = 'R' AND l_quantity < 30 THEN 'rggb14'
  WHEN l_returnflag <> 'R' AND l_quantity < 10 THEN 'gbrg12' END AS format, 1.0::DOUBLE / nullif(l_quantity, 0) AS neutral FROM lineitem"""
