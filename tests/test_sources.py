import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumenframe.functions import trees
from lumenframe.sources import pixels, sinks
from lumenframe.sources.container import metadata, file_tags, tiff_bytes
from lumenframe.streaming import ingest


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a.ppm", b"123"), ("b.ppm", None), ("x/c.ppm", b"")], "name string, data binary")
    sinks.write_files(rows, str(tmp_path / "out"), "name", "data")
    out = tmp_path / "out"
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == {"a.ppm": b"123", "x/c.ppm": b""}
    for bad in ([("a", b"1"), ("a", b"2")], [("../a", b"1")]):
        with pytest.raises(Exception):
            sinks.write_files(spark.createDataFrame(bad, "name string, data binary"), str(out), "name", "data")


def test_raw_frames(spark):
    x = np.arange(7 * 10).reshape(7, 10) * 37 % 4096
    flat = x.reshape(-1, 2).tolist()
    packed = b"".join(bytes([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4]) for a, b in flat)
    for name, data, form in (("a", x.astype("<u2").tobytes(), "rggb16"), ("b", packed, "gbrg12p")):
        files = spark.createDataFrame([(name, data + b"x"), ("none", None)], "path string, content binary")
        found = {(r.row, r.col): r.v for r in pixels.raw_frames(files, 10, 2, form).collect()}
        assert found == {(r - 2, c): int(x[r, c]) for r in range(2, 7) for c in range(10)}


def test_curve_dump_and_parameters(spark):
    lines = [r.value for r in sinks.curve_dump(spark).collect()]
    assert len(lines) == 4096 and lines[0] == "0000: 0000" and lines[-1] == "4095: 4095"
    row = sinks.parameters_json(spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>"), ["a", "b", "c"]).head()
    assert json.loads(row.json) == {"a": 1, "b": None, "c": [1, 2]}


def test_patches(spark):
    cases = [
        ('{"a":1,"b":{"c":2}}', '{"b":{"c":null,"d":3}}', '{"a":1,"b":{"d":3}}'),
        ("[1,2]", '{"a":1}', '{"a":1}'),
        ("bad", "{}", None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, t string, p string")
    assert [r.m for r in df.orderBy("i").select(trees.merge_patch("t", "p").alias("m")).collect()] == [c[2] for c in cases]
    ops = [
        ('{"a":[1,2]}', '[{"op":"add","path":"/a/-","value":3},{"op":"remove","path":"/a/0"}]', '{"a":[2,3]}'),
        ('{"a":{"x":1}}', '[{"op":"move","from":"/a/x","path":"/b"},{"op":"test","path":"/b","value":1}]', '{"a":{},"b":1}'),
        ('{"a":1}', '[{"op":"replace","path":"/z","value":1}]', None),
        ("[1]", '[{"op":"add","path":"/2","value":1}]', None),
        ("[1]", '[{"op":"add","path":"/-1","value":1}]', None),
        ("[1]", '[{"op":"add","path":"/1","value":2}]', "[1,2]"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(ops)], "i int, t string, p string")
    assert [r.m for r in df.orderBy("i").select(trees.json_patch("t", "p").alias("m")).collect()] == [c[2] for c in ops]
    row = spark.range(1).select(trees.sorted_keys(F.lit('{"b":1,"a":{"d":1,"c":2}}')).alias("s"), trees.pointer(F.lit('{"a":[{"b":7}]}'), "/a/0/b").alias("p"), trees.pointer(F.lit('{"a":{"0":8}}'), "/a/0").alias("q"), trees.made_patch(F.lit('{"a":1,"b":[1,2],"c":{"x":1}}'), F.lit('{"b":[1,3],"c":{"x":1,"y":2}}')).alias("g")).head()
    assert row.q == "8"
    assert trees.apply_patch(json.loads('{"a":1,"b":[1,2],"c":{"x":1}}'), json.loads(row.g)) == json.loads('{"b":[1,3],"c":{"x":1,"y":2}}')
    assert row.s == '{"a":{"c":2,"d":1},"b":1}' and row.p == "7"


def test_metadata_packets(spark):
    xml = """<x:xmpmeta xmlns:x="urn:meta"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:e="urn:e" e:Make="M">
    <e:Subject><rdf:Bag><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Bag></e:Subject><e:Place><e:City>C</e:City></e:Place></rdf:Description></rdf:RDF></x:xmpmeta>"""
    found = trees.properties(spark.createDataFrame([(1, xml), (2, "no xml"), (3, None)], "k int, x string"), "k", "x").collect()
    assert {(r.path, r.value) for r in found} == {("Make", "M"), ("Subject[1]", "one"), ("Subject[2]", "two"), ("Place/City", "C")}


def test_tags_as_files_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dng").write_bytes(tiff_bytes([{256: ("long", [64]), 271: ("ascii", "M"), 33434: ("rational", [(1, 4)])}]))
    assert metadata(file_tags(spark, str(tmp_path / "in"))).head().exposure_time == 0.25
    stream = ingest.arriving_tags(spark, str(tmp_path / "in"), "*.dng").writeStream.format("memory").queryName("tags").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("tags").count() == 3


def test_windowed_counts_of_a_stream(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = ingest.windowed_counts(stream, "1 day", "3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r.start, r.event_type): r.events for r in spark.table("counts").collect()} == want
