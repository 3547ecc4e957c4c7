"""Properties, registry, catalog, alignment, addresses and reports on small cases: nulls, ties, repeated rows, empty tables."""

from pyspark.sql import functions as F

from tessera.functions import addresses
from tessera.operators import alignment, properties, search, sinks
from tessera.sources import catalog, definitions, dimensions


def test_properties(spark):
    frame = spark.createDataFrame([(1, "a", 5), (2, None, None), (1, "again", 6)], "id long, name string, year int")
    changes = spark.createDataFrame([(1, "year", "7", 1), (1, "year", "x", 2), (2, "year", "9", 1), (2, "name", "n", 3), (1, "name", None, 5), (1, "vin", "v", 1), (None, "year", "1", 1)], "id long, property string, value string, seq int")
    done = properties.set_properties(frame.withColumnRenamed("id", "key"), "key", changes, {"year": "year", "name": "name", "vin": "key"}, read_only=("vin",))
    assert sorted(map(tuple, done.collect()), key=repr) == sorted([(1, None, 5), (2, "n", 9), (1, None, 6)], key=repr)
    assert properties.set_properties(frame.withColumnRenamed("id", "key"), "key", changes.limit(0), {"year": "year"}).count() == 3
    got = frame.select(properties.property_of({0: F.col("name"), 1: F.col("year")}, F.col("id")).alias("p")).collect()
    assert [r.p for r in got] == ["5", None, "6"]


def test_registry(spark):
    schema = "path string, name string, opened int"
    known = spark.createDataFrame([("a", "old", 1), ("b", "b", 5), (None, "x", 9)], schema)
    opened = spark.createDataFrame([("a", "new", 7), ("a", "older", 2), ("c", "c", 5)], schema)
    assert [tuple(r) for r in properties.upsert_projects(known, opened).collect()] == [("a", "new", 7), ("b", "b", 5), ("c", "c", 5)]


def test_catalog(spark):
    frame = spark.createDataFrame([(1, "x", 2.0), (None, "y", None), (3, None, 4.0)], "ID long, Title string, v double")
    wanted = {"key": ["no", "id"], "label": ["title"], "gone": ["nowhere"]}
    assert catalog.is_catalog(frame, wanted, ("key", "label")) and not catalog.is_catalog(frame, wanted, ("gone",))
    assert [tuple(r) for r in catalog.project(frame, wanted, 2, None, "key").collect()] == [(3, None, None)]
    assert catalog.project(frame, wanted).count() == 3 and catalog.project(frame, wanted, 1, 1, "gone").count() == 3
    entries = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5)], "source string, entry int")
    known = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, None), ("d", 1, 1)], "source string, mtime long, size long")
    listed = spark.createDataFrame([("a", 2, 1, True), ("b", 1, 1, True), ("c", 1, None, False), ("e", 1, 1, True)], "source string, mtime long, size long, readable boolean")
    read = spark.createDataFrame([("a", 10), ("b", 30), ("c", 40), ("e", 60)], "source string, entry int")
    assert sorted(map(tuple, catalog.synchronised(entries, known, listed, read).collect())) == [("a", 10), ("b", 3), ("c", 4), ("d", 5), ("e", 60)]


def test_alignment(spark):
    image = lambda rows: spark.createDataFrame(rows, "image_id long, address long, value long")
    left, right = image([(1, k, k) for k in range(6)]), image([(1, k + 2, k if k != 3 else None) for k in range(5)])
    regions = spark.createDataFrame([(1, 1, 10, 2), (1, 0, 0, 0), (2, 0, 9, 0), (None, 0, 9, 0)], "image_id long, begin long, length long, shift long")
    both = alignment.aligned(left, right, regions)
    assert sorted((r.address, r.value, r.other) for r in both.collect()) == [(1, 1, 1), (2, 2, 2), (3, 3, None), (4, 4, 4)]
    match = alignment.region_match(both, F.col("value") == F.col("other")).collect()
    assert [(r.begin, r.percent, r.addresses) for r in match] == [(1, 75.0, 4)]
    assert alignment.differences(both).count() == 0 == alignment.aligned(left.limit(0), right, regions).count()
    copied = alignment.copy_differences(left, left, right.withColumn("value", F.col("value") + 10), regions, regions.withColumn("shift", F.lit(-1).cast("long")), F.lit(True))
    assert sorted((r.address, r.value) for r in copied.collect()) == [(0, 11), (1, 12), (2, 2), (3, 14), (4, 4), (5, 5)]


def test_addresses(spark):
    rows = [(150, 200, 500, 0, 300, 150), (0x7F, 200, 500, 0, 300, None), (200, 200, 500, 0, 300, None), (1150, 1200, 500, 1000, 300, 150), (1250, 1400, 500, 1000, 300, None), (150, 200, 0, 0, 300, None), (150, 200, 0xFFFFFFFF, 0, 300, None), (150, 600, 500, 0, 0, None), (150, 200, 500, 0, 0, 150), (150, None, 500, 0, 300, None)]
    frame = spark.createDataFrame(rows, "b long, e long, l long, base long, size long, want long")
    assert all(r.got == r.want for r in frame.withColumn("got", addresses.map_offset(*(F.col(c) for c in ("b", "e", "l", "base", "size")))).collect())


def test_dominant_votes(spark):
    rows = [("a", 1)] * 9 + [("a", None)] + [("b", 1), ("b", 2), ("c", None)]
    got = search.dominant(spark.createDataFrame(rows, "k string, v int"), "k", "v").collect()
    assert {(r.k, r.v, r.share) for r in got} == {("a", 1, 0.9), ("c", None, 1.0)}


def test_texts(spark):
    summary = spark.createDataFrame([("r", "<a>&'", 16, 2, 3, -1.0, 2.5), ("r", "same", 32, 0, 3, 0.0, 0.0), ("s", None, 1, 0, 1, None, None)], "report_id string, name string, address long, changed long, cells long, least double, most double")
    html = {r.report_id: r.html for r in sinks.change_report(summary, "T & T").collect()}
    assert "&lt;a&gt;&amp;&#39;" in html["r"] and "2 / 3" in html["r"] and "same" not in html["r"] and "No map has changed" in html["s"] and "T &amp; T" in html["s"]
    maps = spark.createDataFrame([("f", "one", 8, 1, 1, 1, True, 2.0, -3.5, None, None), ("f", "two", 16, 4, 1, 2, False, 1.0, 0.0, "<V>", "x & y")], "file_id string, name string, address long, cols int, rows int, width int, signed boolean, a double, b double, unit string, folder string")
    back = {r.name: r for r in definitions.xdf_maps(sinks.xdf_text(maps)).collect()}
    assert (back["one"].type, back["one"].a, back["one"].b, back["one"].width) == ("VALUE", 2.0, -3.5, 1)
    assert (back["two"].type, back["two"].columns, back["two"].address, back["two"].unit) == ("CURVE", 4, 16, "<V>")
    assert sinks.xdf_text(maps.limit(0)).count() == 0
    texts = spark.createDataFrame([('{"make":"m","models":[{"key":1,"model":"a"},{"key":null}]}',), ("{",), (None,), ('{"make":"n"}',)], "json string")
    assert sorted(map(tuple, dimensions.makes(texts).collect()), key=repr) == sorted([("m", 1, "a"), ("m", None, None)], key=repr)
