"""Queries of the metadata layer (text, dates, JSON, properties, parameters) with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import parameters, scalars, text, trees
from lumenframe.plans.registry import query, table
from lumenframe.sources import sinks
from lumenframe.sources.pixels import file_kind

_MESSY = "'  ' || c_name || E'\\r\\n' || c_mktsegment || E'\\t\\x01' || E'\\n\\r' || 'end' || E'\\r'"


@query(
    "text_clean",
    f"""SELECT c_custkey, ltrim(t) AS lead, replace(replace(replace(replace(t, E'\\r\\n', '|'), E'\\n\\r', '|'), E'\\n', '|'), E'\\r', '|') AS lines,
      regexp_replace(t, '[\\x01-\\x09\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS printable, regexp_replace(t, '[^0-9.+eE-]+', ',', 'g') AS numbers, c_name || c_mktsegment AS appended,
      CASE WHEN c_name < c_mktsegment THEN -1 WHEN c_name > c_mktsegment THEN 1 ELSE 0 END::BIGINT AS compared FROM (SELECT *, {_MESSY} AS t FROM customer)""",
)
def _(spark, d):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    t = F.concat(F.lit("  "), name, F.lit("\r\n"), seg, F.lit("\t\x01"), F.lit("\n\r"), F.lit("end"), F.lit("\r"))
    return table(spark, d, "customer").select(
        "c_custkey", F.ltrim(t).alias("lead"), text.line_endings(t, "|").alias("lines"), text.strip_low(t).alias("printable"), text.comma_numbers(t).alias("numbers"), F.concat(name, seg).alias("appended"), text.compare(name, seg).alias("compared")
    )


@query(
    "text_truncate",
    """SELECT doc_id, substring(x, 1, list_max(list_filter(range(0, 32), lambda k: strlen(substring(x, 1, k::INT)) <= 31))::INT) AS head, strlen(x)::BIGINT AS bytes,
      (2 * length(x) + 2 * len(regexp_extract_all(x, '[\\x{10000}-\\x{10FFFF}]')))::BIGINT AS wide_bytes FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""",
)
def _(spark, d):
    x = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.truncate(x, 31).alias("head"), F.octet_length(x).alias("bytes"), F.octet_length(F.encode(x, "UTF-16BE")).alias("wide_bytes"))


@query(
    "typed_text",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END AS b, c_nationkey::VARCHAR AS n, printf('%.6f', c_acctbal) AS x, TRY_CAST(c_name[10:] AS BIGINT) AS whole, TRY_CAST(c_mktsegment AS BIGINT) AS none,
      CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, decode(from_base64(to_base64(c_name::BLOB))) AS back FROM customer""",
)
def _(spark, d):
    key = F.col("c_custkey")
    flag = F.when(key % 4 == 0, "TRUE").when(key % 4 == 1, "f").when(key % 4 == 2, "1").otherwise("maybe")
    return table(spark, d, "customer").select(
        "c_custkey", text.bool_text(F.col("c_acctbal") > 0).alias("b"), F.col("c_nationkey").cast("string").alias("n"), F.format_string("%f", "c_acctbal").alias("x"), F.substring("c_name", 10, 20).try_cast("bigint").alias("whole"),
        F.col("c_mktsegment").try_cast("bigint").alias("none"), text.bool_of(flag).alias("flag"), F.unbase64(F.base64(F.col("c_name").cast("binary"))).cast("string").alias("back"),
    )


@query(
    "iso_parse",
    """SELECT o_orderkey, year(o_orderdate)::BIGINT AS y, month(o_orderdate)::BIGINT AS m, day(o_orderdate)::BIGINT AS dd, (o_orderkey % 24)::BIGINT AS h, CASE o_orderkey % 4 WHEN 1 THEN 250 ELSE 0 END::BIGINT AS milli,
      CASE o_orderkey % 4 WHEN 2 THEN 0 WHEN 3 THEN -330 END::BIGINT AS "offset",
      strftime(o_orderdate::DATE + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT) + CASE o_orderkey % 4 WHEN 3 THEN to_minutes(330) ELSE to_minutes(0) END, '%Y-%m-%d %H:%M:%S') AS utc FROM orders""",
)
def _(spark, d):
    key = F.col("o_orderkey")
    zone = F.when(key % 4 == 1, ".250").when(key % 4 == 2, "Z").when(key % 4 == 3, "-05:30").otherwise("")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.format_string("T%02d:%02d:00", key % 24, key % 60), zone)
    parts = text.iso_parts(F.col("stamp"))
    rows = table(spark, d, "orders").select("o_orderkey", stamp.alias("stamp"))
    return rows.select("o_orderkey", parts["year"].alias("y"), parts["month"].alias("m"), parts["day"].alias("dd"), parts["hour"].alias("h"), parts["milli"].alias("milli"), parts["offset"].alias("offset"), F.date_format(text.to_utc(parts), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query(
    "iptc_time",
    """SELECT o_orderkey, format('{:02d}{:02d}{:02d}{}{:02d}{:02d}', s // 3600, s // 60 % 60, s % 60, CASE WHEN z < 0 THEN '-' ELSE '+' END, abs(z) // 60, abs(z) % 60) AS packed, s AS seconds, z AS "offset"
    FROM (SELECT o_orderkey, (o_custkey * 37 % 86400)::BIGINT AS s, (o_orderkey % 1500 - 700)::BIGINT AS z FROM orders)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 37 % 86400).alias("s"), (F.col("o_orderkey") % 1500 - 700).alias("z"))
    packed = rows.select("o_orderkey", text.iptc_time(F.col("s"), F.col("z")).alias("packed"))
    seconds, offset = text.iptc_parts(F.col("packed"))
    return packed.select("o_orderkey", "packed", seconds.alias("seconds"), offset.alias("offset"))


_MADE = """CASE event_id % 6 WHEN 0 THEN '[1, 2, 3]' WHEN 1 THEN '"text"' WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN '-2.5' ELSE props END"""


@query(
    "json_types",
    f"""SELECT event_id, CASE json_type(j) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
      CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) END::BIGINT AS items, json_extract_string(props, '/k') AS pointed FROM (SELECT *, {_MADE} AS j FROM events)""",
)
def _(spark, d):
    key, props = F.col("event_id"), F.col("props")
    made = F.when(key % 6 == 0, "[1, 2, 3]").when(key % 6 == 1, '"text"').when(key % 6 == 2, "true").when(key % 6 == 3, "null").when(key % 6 == 4, "-2.5").otherwise(props)
    return table(spark, d, "events").select("event_id", text.json_type(made).alias("kind"), F.when(text.json_type(made) == "array", F.json_array_length(made)).alias("items"), trees.pointer(props, "/k").alias("pointed"))


@query(
    "json_made",
    """SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","flags":[true,false],"list":[' || user_id || ',' || user_id + 1 || ']}' AS made,
      '{"a":' || user_id || ',"b":{"c":1,"d":2},"k":' || (json_extract(props, '/k'))::VARCHAR || '}' AS merged, event_id % 2 = 0 AS equal FROM events""",
)
def _(spark, d):
    made = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.array(F.lit(True), F.lit(False)).alias("flags"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("list")))
    base = F.concat(F.lit('{"b":{"d":2,"c":9,"x":0},"gone":1,"a":'), F.col("user_id").cast("string"), F.lit("}"))
    patch = F.concat(F.lit('{"gone":null,"b":{"c":1,"x":null},"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    other = F.concat(F.lit('{"y": '), (F.col("event_id") % 2).cast("string"), F.lit(', "x": [1, 2]}'))
    return table(spark, d, "events").select("event_id", made.alias("made"), trees.sorted_keys(trees.merge_patch(base, patch)).alias("merged"), (trees.sorted_keys(other) == trees.sorted_keys(F.lit('{"x":[1,2],"y":0}'))).alias("equal"))


def _properties(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    tree = F.create_map(F.lit("dc:title[x-default]"), name, F.lit("dc:title[de]"), F.concat(F.lit("de "), name), F.lit("exif:Model"), seg, F.lit("exif:GPS/Lat"), F.col("n_name"), F.lit("exif:Count"), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").join(n, "c_nationkey").select("c_custkey", tree.alias("tree"), "n_name", "c_mktsegment", "c_name")


@query(
    "property_access",
    """SELECT c_custkey, c_mktsegment AS model, false AS has_iso, c_custkey AS counted, CASE WHEN c_custkey % 3 = 0 THEN 'fr' ELSE c_mktsegment END AS after_set, 4::BIGINT AS after_delete,
      CASE WHEN c_custkey % 2 = 0 THEN 'de ' || c_name ELSE c_name END AS title FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def _(spark, d):
    tree = F.col("tree")
    put = F.when(F.col("c_custkey") % 3 == 0, scalars.merged(tree, F.create_map(F.lit("exif:Model"), F.lit("fr")))).otherwise(tree)
    texts = F.transform_keys(F.map_filter(tree, lambda k, _: F.startswith(k, F.lit("dc:title["))), lambda k, _: F.regexp_extract(k, r"\[(.*)\]", 1))
    title = F.when(F.col("c_custkey") % 2 == 0, text.localised(texts, "de", "en")).otherwise(text.localised(texts, "fr", "en"))
    return _properties(spark, d).select(
        "c_custkey", tree["exif:Model"].alias("model"), F.map_contains_key(tree, "exif:ISO").alias("has_iso"), tree["exif:Count"].try_cast("bigint").alias("counted"), put["exif:Model"].alias("after_set"),
        F.size(F.map_filter(tree, lambda k, _: k != "exif:Model")).alias("after_delete"), title.alias("title"),
    )


@query(
    "property_iterate",
    """SELECT c_custkey, place::BIGINT AS place, prefix, path, value FROM (
      SELECT c_custkey, unnest([1, 2, 3, 4, 5]) AS place, unnest(['dc', 'dc', 'exif', 'exif', 'exif']) AS prefix, unnest(['title[de]', 'title[x-default]', 'Count', 'GPS/Lat', 'Model']) AS path,
        unnest(['de ' || c_name, c_name, c_custkey::VARCHAR, n_name, c_mktsegment]) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
)
def _(spark, d):
    entries = F.array_sort(F.map_entries("tree"))
    rows = _properties(spark, d).select("c_custkey", F.posexplode(entries).alias("place", "e"))
    return rows.select("c_custkey", (F.col("place") + 1).alias("place"), F.substring_index("e.key", ":", 1).alias("prefix"), F.regexp_extract("e.key", "^[^:]*:(.*)$", 1).alias("path"), F.col("e.value").alias("value"))


@query(
    "property_namespaces",
    """SELECT p.prefix, uri, count(*)::BIGINT AS properties FROM (SELECT unnest(['dc', 'dc', 'exif', 'exif', 'exif']) AS prefix FROM customer JOIN nation ON c_nationkey = n_nationkey) p
    JOIN (VALUES ('dc', 'urn:dublin'), ('exif', 'urn:exif'), ('tiff', 'urn:tiff')) n(prefix, uri) USING (prefix) GROUP BY ALL""",
)
def _(spark, d):
    names = spark.createDataFrame([("dc", "urn:dublin"), ("exif", "urn:exif"), ("tiff", "urn:tiff")], "prefix string, uri string")
    used = _properties(spark, d).select(F.explode(F.map_keys("tree")).alias("k")).groupBy(F.substring_index("k", ":", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("properties"))
    return used.join(F.broadcast(names), "prefix").select("prefix", "uri", "properties")  # the registry is a handful of rows


@query(
    "array_items",
    '''SELECT c_custkey, c_name || '; "a;b"; "say ""hi"""; ' || c_mktsegment AS joined, 4::BIGINT AS items, [c_name, 'a;b', 'say "hi"', c_mktsegment] AS parts FROM customer''',
)
def _(spark, d):
    items = F.array(F.col("c_name"), F.lit("a;b"), F.lit('say "hi"'), F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select("c_custkey", text.catenated(items, "; ", '"').alias("joined"))
    return rows.select("c_custkey", "joined", F.size(text.separated(F.col("joined"), '"')).alias("items"), text.separated(F.col("joined"), '"').alias("parts"))


_DEFAULTS = ", ".join(f"('{p}', '{n}', {i}, '{v}')" for p, n, i, v in parameters.flat())


@query("parameter_defaults", f"SELECT part, name, i::BIGINT AS i, value FROM (VALUES {_DEFAULTS}) t(part, name, i, value)")
def _(spark, d):
    return parameters.defaults(spark)


@query(
    "parameters_given",
    f"""WITH g AS (SELECT s_suppkey AS image_id, 'exif' AS part, 'iso_speed_rating' AS name, 0 AS i, (100 + s_suppkey)::VARCHAR AS own FROM supplier)
    SELECT image_id, t.part, t.name, t.i::BIGINT AS i, coalesce(own, value) AS value FROM (SELECT DISTINCT image_id FROM g) CROSS JOIN (VALUES {_DEFAULTS}) t(part, name, i, value) LEFT JOIN g USING (image_id, part, name, i)""",
)
def _(spark, d):
    given = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit("exif").alias("part"), F.lit("iso_speed_rating").alias("name"), F.lit(0).alias("i"), (F.col("s_suppkey") + 100).cast("string").alias("value"))
    return parameters.with_defaults(given)


@query(
    "levels_and_names",
    """SELECT p_partkey, p_name || ' ' || p_brand AS camera, CASE p_size % 5 WHEN 0 THEN 16383 WHEN 1 THEN 16384 WHEN 2 THEN 16385 WHEN 3 THEN 16386 END::BIGINT AS saturation,
      CASE WHEN p_size % 2 = 0 THEN [p_size, p_size + 1, p_size + 2, p_size + 3] ELSE [p_size + 2, p_size + 3, p_size, p_size + 1] END::BIGINT[] AS black,
      CASE WHEN p_size % 3 = 0 THEN [4095] ELSE [4095, 4095, 4095, 4000] END::BIGINT[] AS white, CASE WHEN p_size % 7 = 0 THEN 'medium' ELSE 'fs1' END AS quality FROM part""",
)
def _(spark, d):
    size = F.col("p_size").cast("bigint")
    channel = F.when(size % 5 == 0, "red").when(size % 5 == 1, "green_even").when(size % 5 == 2, "green_odd").when(size % 5 == 3, "blue").otherwise("none")
    cell, last = F.when(size % 2 == 0, "rggb").otherwise("gbrg"), F.when(size % 3 == 0, 4095).otherwise(4000).cast("bigint")
    full = F.lit(4095).cast("bigint")
    return table(spark, d, "part").select(
        "p_partkey", parameters.camera_name(F.col("p_name"), F.col("p_brand")).alias("camera"), parameters.saturation(channel, (16383, 16384, 16385, 16386)).alias("saturation"),
        parameters.black_levels(cell, [size, size + 1, size + 2, size + 3]).alias("black"), parameters.white_levels([full, full, full, last]).alias("white"),
        F.when(size % 7 == 0, parameters.QUALITY[True]).otherwise(parameters.QUALITY[False]).alias("quality"),
    )


@query(
    "integer_helpers",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, abs(l_partkey - l_suppkey) AS gap, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high,
      ((l_partkey & 255) * 16777216 + (l_partkey >> 8 & 255) * 65536 + (l_partkey >> 16 & 255) * 256 + (l_partkey >> 24 & 255)) AS swapped, l_partkey::DOUBLE / nullif(l_suppkey, 0)::DOUBLE AS ratio FROM lineitem""",
)
def _(spark, d):
    a, b = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.abs(a - b).alias("gap"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), text.swap32(a).alias("swapped"), parameters.rational(a, b).alias("ratio"))


# --- segments and state --------------------------------------------------------------------------


@query(
    "segment_words",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (CASE WHEN t < 0 THEN t + 65536 ELSE t END) * 65536 + v AS word, abs(t) AS tag, v AS value, t < 0 AS optional
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN -(l_partkey % 32768) ELSE l_partkey % 32768 END AS t, (l_suppkey * 7919) % 65536 AS v FROM lineitem)""",
)
def _(spark, d):
    tag = F.when(F.col("l_linenumber") % 2 == 0, -(F.col("l_partkey") % 32768)).otherwise(F.col("l_partkey") % 32768)
    words = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.segment_word(tag, (F.col("l_suppkey") * 7919) % 65536).alias("word"))
    found = text.segment_parts(F.col("word"))
    return words.select("l_orderkey", "l_linenumber", "word", *[c.alias(n) for n, c in found.items()])


@query(
    "chunk_words",
    """SELECT o_orderkey, n AS segments, 24576 + (n >> 16 & 255) AS tag, n & 65535 AS value, (n >> 16 & 255) * 65536 + (n & 65535) AS size FROM (SELECT o_orderkey, (o_custkey * 104729 + o_orderkey) % 16777216 AS n FROM orders)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", ((F.col("o_custkey") * 104729 + F.col("o_orderkey")) % 16777216).alias("n"))
    tag, value = text.chunk_word(F.col("n"), 0x6000)
    made = rows.select("o_orderkey", F.col("n").alias("segments"), tag.alias("tag"), value.alias("value"))
    return made.withColumn("size", text.chunk_size(F.col("tag"), F.col("value")))


@query("prescale_words", "SELECT i::BIGINT AS i, (a * 16384 + b * 4096 + c * 1024)::BIGINT AS word, [a, b, c]::BIGINT[] AS shifts FROM (SELECT i, i % 4 AS a, i // 4 % 4 AS b, i // 16 AS c FROM range(64) t(i))")
def _(spark, d):
    i = F.col("id")
    word = (i % 4) * 16384 + (F.floor(i / 4) % 4) * 4096 + F.floor(i / 16) * 1024
    return spark.range(64).select(i.alias("i"), word.alias("word"), F.array(*[F.shiftright(word, s).bitwiseAND(F.lit(3).cast("bigint")) for s in (14, 12, 10)]).alias("shifts"))


@query("enabled_parts", "SELECT s_suppkey, n::BIGINT AS part, (s_suppkey >> (n - 1)) & 1 = 1 AS enabled FROM supplier, range(1, 8) t(n)")
def _(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("part"))
    return rows.withColumn("enabled", F.expr("(shiftright(s_suppkey, part - 1) & 1) = 1"))


_REQUIRED = ("click", "purchase", "view")


@query(
    "header_rules",
    """SELECT user_id, coalesce(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END), 0)::BIGINT AS repeated, (3 - sum(CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1 ELSE 0 END))::BIGINT AS missing,
      sum(CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 1 ELSE 0 END) = 3 AS complete FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""",
)
def _(spark, d):
    return text.header_rules(table(spark, d, "events"), "user_id", "event_type", _REQUIRED)


@query(
    "file_kinds",
    """SELECT c_custkey, path, CASE c_custkey % 6 WHEN 0 THEN 'RAW' WHEN 1 THEN 'DNG' WHEN 2 THEN 'VC5' WHEN 3 THEN 'JPG' WHEN 4 THEN 'PPM' END AS kind
    FROM (SELECT c_custkey, 'in.put/' || c_name || CASE c_custkey % 6 WHEN 0 THEN '.raw' WHEN 1 THEN '.Dng' WHEN 2 THEN '.VC5' WHEN 3 THEN '.jpg' WHEN 4 THEN '.ppm' ELSE '.txt' END AS path FROM customer)""",
)
def _(spark, d):
    key = F.col("c_custkey") % 6
    ends = F.when(key == 0, ".raw").when(key == 1, ".Dng").when(key == 2, ".VC5").when(key == 3, ".jpg").when(key == 4, ".ppm").otherwise(".txt")
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("in.put/"), F.col("c_name"), ends).alias("path"))
    return rows.withColumn("kind", file_kind(F.col("path")))


@query(
    "parameter_dump",
    """SELECT s_suppkey, '{"input_width":' || 4000 + s_suppkey || ',"input_height":3000,"fast_encoding":' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END || ',"exposure_time":[1,' || 60 + s_suppkey || '],"note":null}' AS dump,
      (4000 + s_suppkey)::BIGINT AS width, (60 + s_suppkey)::BIGINT AS den, s_suppkey % 2 = 0 AS fast FROM supplier""",
)
def _(spark, d):
    key = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", (key + 4000).alias("input_width"), F.lit(3000).alias("input_height"), (key % 2 == 0).alias("fast_encoding"), F.array(F.lit(1).cast("bigint"), key + 60).alias("exposure_time"), F.lit(None).cast("string").alias("note"))
    dumped = sinks.parameters_json(rows, ["input_width", "input_height", "fast_encoding", "exposure_time", "note"], "dump")
    back = F.from_json("dump", "input_width bigint, fast_encoding boolean, exposure_time array<bigint>")
    return dumped.select("s_suppkey", "dump", back.alias("p")).select("s_suppkey", "dump", F.col("p.input_width").alias("width"), F.col("p.exposure_time")[1].alias("den"), F.col("p.fast_encoding").alias("fast"))
