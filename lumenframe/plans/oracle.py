"""DuckDB SQL pieces that the catalogue's queries are checked against; written apart from the Spark plans."""

from __future__ import annotations

PX = """px AS (
  SELECT 0 AS image_id, vec_id::INT AS "row", (i - 1)::INT AS col,
    least(4095, greatest(0, floor((embedding[i]::DOUBLE + 1.0) * 2048.0)::INT)) AS v
  FROM embeddings, range(1, 65) t(i))"""

ENC = "trunc(4095.0::DOUBLE * log10(i / 4095.0::DOUBLE * 112.0::DOUBLE + 1.0) / log10(113.0::DOUBLE))::INT"
DEC = "least(65535, trunc((65535.0::DOUBLE * (power(113.0::DOUBLE, i / 4095.0::DOUBLE) - 1.0) / 112.0::DOUBLE)::FLOAT)::INT)"
LUT = f"enc AS (SELECT i::INT AS i, {ENC} AS e FROM range(4096) t(i)), dec AS (SELECT i::INT AS i, {DEC} AS d FROM range(4096) t(i))"
CELLS = {"rggb": ((0, 0), (0, 1), (1, 0), (1, 1)), "gbrg": ((1, 0), (0, 0), (1, 1), (0, 1))}  # r, g1, g2, b


def planes(cell: str = "rggb") -> str:
    r, g1, g2, b = (f'max(CASE WHEN "row" % 2 = {p[0]} AND col % 2 = {p[1]} THEN e END)' for p in CELLS[cell])
    c12 = lambda x: f"least(4095, greatest(0, ({x}) >> 1))"
    return f"""{PX}, {LUT},
cells AS (SELECT image_id, "row" // 2 AS "row", col // 2 AS col, {r} AS r, {g1} AS g1, {g2} AS g2, {b} AS b FROM px JOIN enc ON px.v = enc.i GROUP BY ALL
  HAVING {r} IS NOT NULL AND {g1} IS NOT NULL AND {g2} IS NOT NULL AND {b} IS NOT NULL),
gcell AS (SELECT *, (g1 + g2) >> 1 AS gs FROM cells),
planes AS (
  SELECT image_id, 0 AS channel, "row", col, gs AS v FROM gcell UNION ALL
  SELECT image_id, 1, "row", col, {c12("r - gs + 4096")} FROM gcell UNION ALL
  SELECT image_id, 2, "row", col, {c12("b - gs + 4096")} FROM gcell UNION ALL
  SELECT image_id, 3, "row", col, {c12("g1 - g2 + 4096")} FROM gcell)"""


def forward_line(name: str, source: str, keys: str, along: str, p: int) -> str:
    """CTE `name`: keys, along, low, high."""
    x = lambda k: f"p{k}" if k >= 0 else f"pm{-k}"
    over = f'OVER (PARTITION BY {keys} ORDER BY "{along}")'
    r = (1 << p) - 1
    raw = ", ".join([f"v AS x0", *(f"lag(v, {k}) {over} AS xm{k}" for k in range(1, 5)), *(f"coalesce(lead(v, {k}) {over}, last_value(v) OVER (PARTITION BY {keys} ORDER BY \"{along}\" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS x{k}" for k in range(1, 6))])
    pre = ", ".join(f"(x{n} + {r}) >> {p} AS p{n}" for n in ["0", "m1", "m2", "m3", "m4", "1", "2", "3", "4", "5"])
    first = f"5*{x(0)} - 11*{x(1)} + 4*{x(2)} + 4*{x(3)} - {x(4)} - {x(5)}"
    final = f"{x(-4)} + {x(-3)} - 4*{x(-2)} - 4*{x(-1)} + 11*{x(0)} - 5*{x(1)}"
    inner = f"-{x(-2)} - {x(-1)} + 8*{x(0)} - 8*{x(1)} + {x(2)} + {x(3)}"
    return f"""{name} AS (
  SELECT {keys}, ("{along}" // 2)::INT AS "{along}", ((x0 + x1 + {r}) >> {p})::INT AS low,
    (((CASE WHEN "{along}" = 0 THEN {first} WHEN "{along}" >= n - 2 THEN {final} ELSE {inner} END) + 4) >> 3)::INT AS high
  FROM (SELECT *, {pre} FROM (SELECT {keys}, "{along}", {raw}, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}))
  WHERE "{along}" % 2 = 0)"""


def forward(prefix: str, source: str, p: int) -> str:
    """CTE {prefix}bands: image_id, channel, band, row, col, v."""
    return f"""{forward_line(prefix + "h", source, 'image_id, channel, "row"', "col", p)},
{prefix}both AS (SELECT image_id, channel, 0 AS half, "row", col, low AS v FROM {prefix}h UNION ALL SELECT image_id, channel, 1, "row", col, high FROM {prefix}h),
{forward_line(prefix + "v", prefix + "both", "image_id, channel, half, col", "row", 0)},
{prefix}bands AS (SELECT image_id, channel, half AS band, "row", col, low AS v FROM {prefix}v UNION ALL SELECT image_id, channel, half + 2, "row", col, high FROM {prefix}v)"""


def pyramid(levels: int = 3, cell: str = "rggb") -> str:
    """CTE pyr: image_id, channel, level, band, row, col, v."""
    parts, source = [planes(cell)], "planes"
    unions = []
    for level in range(levels):
        parts.append(forward(f"l{level}", source, (0, 2, 2)[level]))
        parts.append(f"l{level}ll AS (SELECT image_id, channel, \"row\", col, v FROM l{level}bands WHERE band = 0)")
        source = f"l{level}ll"
        unions.append(f"SELECT image_id, channel, {level} AS level, band, \"row\", col, v FROM l{level}bands" + ("" if level == levels - 1 else " WHERE band > 0"))
    return ", ".join(parts) + ", pyr AS (" + " UNION ALL ".join(unions) + ")"


FS1 = (1, 24, 24, 12, 24, 24, 12, 96, 96, 144)
PLACES = ((2, 0), (2, 1), (2, 2), (2, 3), (1, 1), (1, 2), (1, 3), (0, 1), (0, 2), (0, 3))
QUANT = "quant AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {l}, {b}, {q}, {max(0, (q >> 1) - 1)}, {65536 // q})" for i, ((l, b), q) in enumerate(zip(PLACES, FS1, strict=True))) + ") t(subband, level, band, q, mid, mult))"
QUANTIZED = f'{QUANT}, qz AS (SELECT image_id, channel, subband, pyr.level, pyr.band, "row", col, (sign(v) * (((abs(v) + mid) * mult) >> 16))::INT AS v FROM pyr JOIN quant ON pyr.level = quant.level AND pyr.band = quant.band)'
DEQUANTIZED = """dq AS (SELECT image_id, channel, z.subband, z.level, z.band, "row", col,
  CASE WHEN z.subband = 0 THEN v ELSE least(32767, greatest(-32768, (sign(v) * (abs(v) + trunc(abs(v)::DOUBLE * abs(v) * abs(v) * 768.0::DOUBLE / 16581375.0::DOUBLE)))::BIGINT * quant.q)) END AS v
  FROM qz z JOIN quant ON z.subband = quant.subband)"""


def inverse_line(name: str, source: str, keys: str, along: str, finish: str) -> str:
    over = f'OVER (PARTITION BY {keys} ORDER BY "{along}")'
    case = lambda f, l, i: f'CASE WHEN "{along}" = 0 THEN {f} WHEN "{along}" = top THEN {l} ELSE {i} END'
    even = case("((11*low - 4*p1 + p2 + 4) >> 3) + high", "((5*low + 4*m1 - m2 + 4) >> 3) + high", "((m1 - p1 + 4) >> 3) + low + high")
    odd = case("((5*low + 4*p1 - p2 + 4) >> 3) - high", "((11*low - 4*m1 + m2 + 4) >> 3) - high", "((p1 - m1 + 4) >> 3) + low - high")
    return f"""{name}t AS (SELECT {keys}, "{along}", low, high, lag(low) {over} AS m1, lag(low, 2) {over} AS m2, lead(low) {over} AS p1, lead(low, 2) {over} AS p2, max("{along}") OVER (PARTITION BY {keys}) AS top FROM {source}),
{name} AS (SELECT {keys}, 2 * "{along}" AS "{along}", {finish.format(even)} AS v FROM {name}t UNION ALL SELECT {keys}, 2 * "{along}" + 1, {finish.format(odd)} FROM {name}t)"""


def inverse(prefix: str, bands: str, p: int) -> str:
    """CTE {prefix}out from one level's bands."""
    at = lambda b: f"max(CASE WHEN band = {b} THEN v END)"
    last = "least(32767, greatest(-32768, ({}) * 2))" if p == 2 else "least(16383, greatest(0, ({}) >> 1))"
    return f"""{prefix}cells AS (SELECT image_id, channel, "row", col, {at(0)} AS ll, {at(1)} AS lh, {at(2)} AS hl, {at(3)} AS hh FROM {bands} GROUP BY ALL),
{prefix}cols AS (SELECT image_id, channel, 0 AS half, "row", col, ll AS low, hl AS high FROM {prefix}cells UNION ALL SELECT image_id, channel, 1, "row", col, lh, hh FROM {prefix}cells),
{inverse_line(prefix + "up", prefix + "cols", "image_id, channel, half, col", "row", "least(32767, greatest(-32768, ({}) >> 1))")},
{prefix}lines AS (SELECT image_id, channel, "row", col, max(CASE WHEN half = 0 THEN v END) AS low, max(CASE WHEN half = 1 THEN v END) AS high FROM {prefix}up GROUP BY ALL),
{inverse_line(prefix + "out", prefix + "lines", 'image_id, channel, "row"', "col", last)}"""


def out(ctes: str, source: str, **columns: str) -> str:
    """SELECT with BIGINT columns unless given as (expression, type)."""
    cols = ", ".join(f'({e})::BIGINT AS "{k}"' if isinstance(e, str) else f'({e[0]})::{e[1]} AS "{k}"' for k, e in columns.items())
    return f"WITH {ctes} SELECT {cols} FROM {source}"


def plain(ctes: str, source: str, names: str) -> str:
    return out(ctes, source, **{n: f'"{n}"' for n in names.split()})
