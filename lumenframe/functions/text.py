"""Strings, dates and typed text of the metadata layer as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_endings(x: Column, ending: str) -> Column:
    """Each of CR LF, LF CR, CR and LF becomes the ending; '' takes them out."""
    return F.regexp_replace(x, r"\r\n|\n\r|\n|\r", ending)


def strip_low(x: Column) -> Column:
    """Without control characters but CR and LF."""
    return F.regexp_replace(x, r"[\x01-\x09\x0b\x0c\x0e-\x1f]", "")


def comma_numbers(x: Column) -> Column:
    """Digits, points, signs and exponents stay; whatever stands between becomes one comma."""
    return F.regexp_replace(x, r"[^0-9.+eE-]+", ",")


def truncate(x: Column, most: int) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that cuts no character."""
    data = x.cast("binary")
    byte = lambda k: F.conv(F.hex(F.substring(data, most - k + 1, 1)), 16, 10).cast("int")
    size = F.lit(max(0, most - 3))
    for k in (2, 1, 0):
        if most - k >= 0:
            size = F.when(byte(k).bitwiseAND(F.lit(0xC0)) != 0x80, most - k).otherwise(size)
    return F.when(F.octet_length(x) <= most, x).otherwise(F.substring(data, F.lit(1), size).cast("string"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by bytes."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def bool_text(x: Column) -> Column:
    return F.when(x, "True").otherwise("False")


def bool_of(x: Column) -> Column:
    """true, t, 1 and false, f, 0 in either case; else null."""
    low = F.lower(x)
    return F.when(low.isin("true", "t", "1"), True).when(low.isin("false", "f", "0"), False)


ISO = r"^(\d+)-(\d+)-(\d+)(?:T(\d+):(\d+)(?::(\d+))?(?:\.(\d+))?(Z|[+-]\d+:\d+)?)?"


def iso_parts(x: Column) -> dict[str, Column]:
    """year, month, day, hour, minute, second, milli and offset (minutes, null without a zone) of ISO-8601 text; null where it is none."""
    group = lambda i: F.nullif(F.regexp_extract(x, ISO, i), F.lit(""))
    out = {n: group(i).cast("bigint") for i, n in enumerate(("year", "month", "day", "hour", "minute", "second"), 1)}
    out["milli"] = F.substring(F.concat(F.coalesce(group(7), F.lit("")), F.lit("000")), 1, 3).cast("bigint")
    zone = group(8)
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    minutes = F.regexp_extract(zone, r"(\d+):", 1).cast("bigint") * 60 + F.regexp_extract(zone, r":(\d+)", 1).cast("bigint")
    out["offset"] = F.when(zone == "Z", 0).otherwise(sign * minutes)
    return out


def to_utc(parts: dict[str, Column]) -> Column:
    """The moment in UTC as a timestamp without zone; a text without a zone is taken as UTC."""
    local = F.make_timestamp_ntz(*(F.coalesce(parts[n], F.lit(0)).cast("int") for n in ("year", "month", "day", "hour", "minute")), F.coalesce(parts["second"], F.lit(0)).cast("decimal(8,6)"))
    return local - F.make_dt_interval(F.lit(0), F.lit(0), F.coalesce(parts["offset"], F.lit(0)).cast("int"))


def iptc_time(seconds: Column, offset: Column) -> Column:
    """HHMMSS+HHMM of seconds since midnight and an offset in minutes."""
    zone = F.abs(offset)
    return F.format_string("%02d%02d%02d%s%02d%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60, F.when(offset < 0, "-").otherwise("+"), F.floor(zone / 60), zone % 60)


def iptc_parts(x: Column) -> tuple[Column, Column]:
    """Seconds since midnight and offset in minutes; null unless the text has eleven characters of that form."""
    shape = r"^(\d\d)(\d\d)(\d\d)([+-])(\d\d)(\d\d)$"
    part = lambda i: F.nullif(F.regexp_extract(x, shape, i), F.lit("")).cast("bigint")
    sign = F.when(F.regexp_extract(x, shape, 4) == "-", -1).otherwise(1)
    return part(1) * 3600 + part(2) * 60 + part(3), sign * (part(5) * 60 + part(6))


def json_type(x: Column) -> Column:
    """object, array, string, number, bool or null of a JSON text by how it begins."""
    first = F.substring(F.ltrim(x), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "bool").when(first == "n", "null").when(first.rlike("[-0-9]"), "number")


def swap32(x: Column) -> Column:
    """The four bytes of an unsigned 32-bit number in reverse."""
    byte = lambda k: F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("bigint"))
    return F.shiftleft(byte(0), 24) + F.shiftleft(byte(1), 16) + F.shiftleft(byte(2), 8) + byte(3)


def localised(texts: Column, specific: str, generic: str) -> Column:
    """Of a language map, the specific language's text, else the generic one's, else x-default."""
    return F.coalesce(texts[specific], texts[generic], texts["x-default"])


def catenated(items: Column, separator: str, quote: str) -> Column:
    """Items joined; those that contain the separator's mark or the quote are quoted, quotes inside doubled."""
    mark = separator.strip()
    quoted = lambda x: F.concat(F.lit(quote), F.replace(x, F.lit(quote), F.lit(quote * 2)), F.lit(quote))
    return F.array_join(F.transform(items, lambda x: F.when(F.contains(x, F.lit(mark)) | F.contains(x, F.lit(quote)), quoted(x)).otherwise(x)), separator)


def separated(x: Column, quote: str) -> Column:
    """The items of a text at commas and semicolons outside quotes, trimmed, without their quotes."""
    found = F.regexp_extract_all(x, F.lit(rf'({quote}(?:[^{quote}]|{quote}{quote})*{quote}|[^,;\s{quote}][^,;]*)'), F.lit(1))
    bare = lambda t: F.when(F.startswith(t, F.lit(quote)), F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(quote * 2), F.lit(quote))).otherwise(t)
    return F.transform(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != ""), bare)


def segment_word(tag: Column, value: Column) -> Column:
    """A tag (negative: optional) and a value as one unsigned 32-bit word."""
    return F.shiftleft(tag.cast("bigint").bitwiseAND(F.lit(0xFFFF).cast("bigint")), 16) + value


def segment_parts(word: Column) -> dict[str, Column]:
    """tag, value and whether the segment is optional."""
    high = F.shiftright(word, 16)
    signed = F.when(high >= 0x8000, high - 0x10000).otherwise(high)
    return {"tag": F.abs(signed), "value": word.bitwiseAND(F.lit(0xFFFF).cast("bigint")), "optional": signed < 0}


def chunk_word(segments: Column, tag: int) -> tuple[Column, Column]:
    """Tag and value of a large chunk's segment: 24 bits of size, eight of them in the tag."""
    low = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    return F.lit(tag) + low(F.shiftright(segments, 16), 8), low(segments, 16)


def chunk_size(tag: Column, value: Column) -> Column:
    return F.shiftleft(tag.bitwiseAND(F.lit(255).cast("bigint")), 16) + value


def header_rules(rows: DataFrame, key: str, tag: str, required: tuple[str, ...]) -> DataFrame:
    """(key, repeated, missing, complete): tags given more than once, required ones that lack."""
    counts = rows.groupBy(key, tag).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.sum(F.when(F.col(tag).isin(*required), 1).otherwise(0))
    return counts.groupBy(key).agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("repeated"), (F.lit(len(required)) - wanted).alias("missing"), (wanted == len(required)).alias("complete"))
