"""Queries over whole images, definitions, links, channels and text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import channels, units
from ..operators import arrays, images, linking, sequences, sinks
from ..sources import definitions
from ..sources import images as image_files
from .carriers import CELLS, PAIR, RAW, SAMPLES, cells, next_cells, raw_cells, read, samples
from .registry import query


def texts(spark, d):
    """Documents as images, whole; a null text stays null."""
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("data"))


def named(spark, d):
    """Bytes of the parts' names, one image a part."""
    return image_files.to_rows(read(spark, d, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("image_id"), F.col("p_name").cast("binary").alias("bytes")))


@query("S1_raw_image", "SELECT p_partkey AS image_id, CAST(i - 1 AS BIGINT) AS address, CAST(ord(substr(p_name, i, 1)) AS INTEGER) AS byte FROM part, range(1, 200) t(i) WHERE i <= length(p_name)")
def s1(spark, d):
    return named(spark, d).select("image_id", F.col("address").cast("long").alias("address"), F.col("byte").cast("int").alias("byte"))


@query("S2_intel_hex_round_trip", "SELECT p_partkey AS image_id, p_name AS name FROM part")
def s2(spark, d):
    lines = sinks.intel_hex_lines(named(spark, d)).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").cast("binary").alias("content"))
    return image_files.assemble(image_files.intel_hex(lines)).select("image_id", F.decode("bytes", "UTF-8").alias("name"))


@query("S3_s_record", "SELECT p_partkey AS image_id, p_name AS name FROM part")
def s3(spark, d):
    count = F.lpad(F.hex((F.length("p_name") + 3).cast("long")), 2, "0")
    content = F.concat(F.lit("S1"), count, F.lit("0000"), F.hex(F.col("p_name").cast("binary")), F.lit("00\nS9030000FC"))
    return image_files.assemble(image_files.s_records(read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), content.cast("binary").alias("content")))).select("image_id", F.decode("bytes", "UTF-8").alias("name"))


def _a2l(spark, d):
    """One definition file a brand: each part a line of p_size words."""
    block = F.format_string("/begin CHARACTERISTIC P_%d \"%s\" CURVE 0x%X L 0 C 0 1 /begin AXIS_DESCR COM_AXIS n NO_COMPU_METHOD %d 0 1 /end AXIS_DESCR /end CHARACTERISTIC", "p_partkey", "p_name", (F.col("p_partkey") * 256).cast("long"), "p_size")
    head = "/begin RECORD_LAYOUT L FNC_VALUES 1 SWORD ROW_DIR DIRECT /end RECORD_LAYOUT\n/begin COMPU_METHOD C \"\" LINEAR \"%5.1\" \"bar\" COEFFS_LINEAR 0.5 2 /end COMPU_METHOD\n"
    return read(spark, d, "part").groupBy(F.col("p_brand").alias("file_id")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(block), "\n")).alias("text"))


@query("S4_characteristics", "SELECT p_brand AS file_id, 'P_' || p_partkey AS name, p_name AS description, CAST(p_partkey * 256 AS BIGINT) AS raw_address, CAST(p_size AS INTEGER) AS columns FROM part")
def s4(spark, d):
    return definitions.characteristics(_a2l(spark, d)).select("file_id", "name", "description", "raw_address", "columns")


@query("S5_map_list", "SELECT p_brand AS file_id, 'P_' || p_partkey AS name, CAST(p_partkey * 256 AS BIGINT) AS address, CAST(2 AS INTEGER) AS width, CAST(p_size * 2 AS INTEGER) AS length, 'P' AS folder, 0.5::DOUBLE AS a, 'bar' AS unit FROM part")
def s5(spark, d):
    return definitions.a2l_maps(_a2l(spark, d)).select("file_id", "name", "address", "width", "length", "folder", "a", "unit")


@query("S6_xml_tables", "SELECT p_brand AS file_id, p_name AS name, CAST(p_partkey AS BIGINT) AS address, CAST(p_size AS INTEGER) AS columns, CASE WHEN p_size > 1 THEN 'CURVE' ELSE 'VALUE' END AS type, 0.25::DOUBLE AS a, -1.0::DOUBLE AS b FROM part")
def s6(spark, d):
    table = F.format_string('<XDFTABLE><title>%s</title><XDFAXIS id="z"><EMBEDDEDDATA mmedaddress="0x%X" mmedelementsizebits="16" mmedcolcount="%d"/><MATH equation="X*0.25-1"/></XDFAXIS></XDFTABLE>', "p_name", F.col("p_partkey").cast("long"), "p_size")
    files = read(spark, d, "part").groupBy(F.col("p_brand").alias("file_id")).agg(F.array_join(F.collect_list(table), "\n").alias("text"))
    return definitions.xdf_maps(files).select("file_id", "name", "address", "columns", "type", "a", "b")


@query("K2_map_objects", f"WITH {CELLS} SELECT array_id, round(min(value), 6) AS low, round(avg(value), 6) AS mean, CAST(8 AS INTEGER) AS columns, CAST(count(*) AS INTEGER) AS cells, round(arg_min(value, pos), 6) AS first FROM cells GROUP BY array_id")
def k2(spark, d):
    return sinks.map_rows(cells(spark, d)).select("array_id", F.round("low", 6).alias("low"), F.round("mean", 6).alias("mean"), F.col("columns").cast("int").alias("columns"), F.size("values").alias("cells"), F.round(F.get("values", F.lit(0)), 6).alias("first"))


@query("K3_hex_lines", "SELECT p_partkey AS image_id, ceil(length(p_name) / 16.0)::BIGINT + 1 AS lines FROM part")
def k3(spark, d):
    return sinks.intel_hex_lines(named(spark, d)).groupBy("image_id").agg(F.count("*").alias("lines"))


PATCH = f"WITH {RAW}, b AS (SELECT a.array_id AS image_id, a.pos AS address, a.raw & 255 AS before, n.raw & 255 AS after FROM raw_cells a JOIN raw_cells n ON n.array_id = a.array_id + 1 AND n.pos = a.pos WHERE a.raw & 255 <> n.raw & 255), g AS (SELECT *, CASE WHEN address - lag(address) OVER w = 1 THEN 0 ELSE 1 END AS gap FROM b WINDOW w AS (PARTITION BY image_id ORDER BY address)), r AS (SELECT *, sum(gap) OVER (PARTITION BY image_id ORDER BY address ROWS UNBOUNDED PRECEDING) AS run FROM g)"


@query("K4_patch_runs", f"{PATCH} SELECT image_id, CAST(min(address) AS INTEGER) AS address, count(*) AS length, string_agg(printf('%02X', before), '' ORDER BY address) AS before, string_agg(printf('%02X', after), '' ORDER BY address) AS after FROM r GROUP BY image_id, run")
def k4(spark, d):
    now = raw_cells(spark, d).select(F.col("array_id").alias("image_id"), F.col("pos").cast("int").alias("address"), F.col("raw").bitwiseAND(F.lit(255)).alias("before"))
    after = raw_cells(spark, d).select((F.col("array_id") - 1).alias("image_id"), F.col("pos").cast("int").alias("address"), F.col("raw").bitwiseAND(F.lit(255)).alias("after"))
    return sinks.patch_runs(now.join(after, ["image_id", "address"])).select("image_id", "address", "length", "before", "after")


@query("M1_image_sketch")
def m1(spark, d):
    s = texts(spark, d).select("doc_id", images.sketch(F.col("data")).alias("s"))
    return s.select("doc_id", F.col("s.scanned").alias("scanned"), F.size("s.postings").alias("buckets"), F.array_min(F.transform("s.postings", lambda p: p["hash"])).alias("least"))


@query("K7_postings")
def k7(spark, d):
    return images.postings(texts(spark, d), "doc_id", "data")


@query("M3_similar_images")
def m3(spark, d):
    index = images.postings(texts(spark, d), "doc_id", "data")
    wanted = images.postings(texts(spark, d).join(read(spark, d, "documents").agg(F.min("doc_id").alias("doc_id")), "doc_id"), "doc_id", "data")
    return images.similar(index, wanted, "doc_id").orderBy(F.desc("shared"), "doc_id").limit(200)


def _next_text(spark, d):
    return texts(spark, d).join(texts(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), F.col("data").alias("other")), "doc_id")


@query("M4_byte_match")
def m4(spark, d):
    return _next_text(spark, d).select("doc_id", F.round(images.byte_match(F.col("data"), F.col("other")), 6).alias("percent"))


@query("M10_structure")
def m10(spark, d):
    return texts(spark, d).select("doc_id", images.structure(F.col("data")).alias("s")).select("doc_id", "s.*")


@query("W13_axis_runs")
def w13(spark, d):
    return texts(spark, d).select("doc_id", F.inline(images.axes(F.col("data"))))


@query("M8_linked_maps")
def m8(spark, d):
    pairs = _next_text(spark, d).select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("source_id"), F.col("data").alias("source"), F.col("other").alias("target"))
    at = F.sequence(F.lit(0).cast("long"), F.length("data").cast("long"), F.lit(256).cast("long"))
    maps = texts(spark, d).where("data IS NOT NULL").select(F.col("doc_id").alias("source_id"), F.explode(at).alias("address"))
    none = {c: F.lit(None).cast(t) for c, t in (("axis_address", "long"), ("axis_length", "long"), ("columns", "int"))}
    return linking.link(pairs, maps.withColumns({"name": F.col("address").cast("string"), "data_offset": F.lit(0).cast("long"), "length": F.lit(64).cast("long"), **none}))


ANCHORS = "m AS (SELECT o_custkey AS k, o_orderkey AS place, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 600 END AS shift FROM orders), x AS (SELECT * FROM m WHERE shift IS NOT NULL), j AS (SELECT m.k, m.place, b.place AS b_at, b.shift AS b, a.place AS a_at, a.shift AS a FROM m ASOF LEFT JOIN x b ON m.k = b.k AND m.place > b.place ASOF LEFT JOIN x a ON m.k = a.k AND m.place <= a.place)"


@query("J9_near_anchors", f"WITH {ANCHORS} SELECT place, CASE WHEN abs(b - a) <= 256 THEN (a + b) // 2 WHEN b IS NOT NULL AND a IS NOT NULL THEN CASE WHEN place - b_at <= a_at - place THEN b ELSE a END ELSE coalesce(b, a, 0) END AS guess, CAST(CASE WHEN abs(b - a) <= 256 THEN 60 WHEN b IS NOT NULL AND a IS NOT NULL THEN 40 WHEN b IS NOT NULL OR a IS NOT NULL THEN 50 ELSE 40 END AS INTEGER) AS guess_confidence FROM j")
def j9(spark, d):
    m = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("place"), F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice") % 600).alias("shift"))
    return linking.blend(linking.near_anchors(m, ["k"], "place", "shift"), "place", F.lit(0).cast("long")).select("place", "guess", "guess_confidence")


@query("J21_first_place", "SELECT p_partkey, CAST(instr(p_name, substr(p_name, 2, 2)) - 1 AS BIGINT) AS place FROM part WHERE length(p_name) >= 3")
def j21(spark, d):
    p = read(spark, d, "part", "p_partkey", "p_name").where(F.length("p_name") >= 3).withColumn("b", F.col("p_name").cast("binary"))
    span = F.array(F.struct(F.lit(1).cast("long").alias("begin"), F.lit(2).cast("long").alias("length")))
    return p.select("p_partkey", F.get(linking.locate(F.col("b"), F.col("b"), span, 2, 64), F.lit(0)).alias("place"))


UNIT_OF = {"click": " mbar", "view": "hPa", "purchase": "kPa", "signup": "1/min", "error": "furlong"}


@query("P13_units", f"WITH {SAMPLES} SELECT event_id, CASE channel WHEN 'signup' THEN 'rpm' WHEN 'error' THEN 'furlong' ELSE 'bar' END AS unit, round(value * CASE channel WHEN 'click' THEN 0.001 WHEN 'view' THEN 0.001 WHEN 'purchase' THEN 0.01 ELSE 1.0 END, 6) AS value FROM samples")
def p13(spark, d):
    raw = F.create_map(*(F.lit(x) for kv in UNIT_OF.items() for x in kv))[F.col("channel")]
    s = samples(spark, d).withColumn("u", units.normal_unit(raw))
    return s.select("event_id", F.col("u.unit").alias("unit"), F.round(F.col("value") * F.col("u.scale"), 6).alias("value"))


@query("P14_cylinders", "SELECT p_partkey, p_name AS channel, CAST(CASE WHEN p_size > 25 THEN p_size ELSE p_size + 1 END AS INTEGER) AS cylinder FROM part")
def p14(spark, d):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(" Cylinder "), size)).otherwise(F.concat("p_name", F.lit("["), size, F.lit("]")))
    return read(spark, d, "part").select("p_partkey", units.cylinder(name).alias("c")).select("p_partkey", "c.channel", "c.cylinder")


@query("M16_log_families", "SELECT o_custkey AS log_id, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'BmwMedc17' WHEN bool_or(o_orderstatus = 'O') THEN 'BmwMssS55' ELSE 'Unknown' END AS family FROM orders GROUP BY o_custkey")
def m16(spark, d):
    name = F.when(F.col("o_orderstatus") == "F", "Epm_nEng").when(F.col("o_orderstatus") == "O", "nmot").otherwise("x")
    return channels.families(read(spark, d, "orders", "o_custkey", "o_orderstatus").select(F.col("o_custkey").alias("log_id"), name.alias("channel")))


@query("F18_channel_filter", f"WITH {SAMPLES} SELECT log_id, channel, count(*) AS n FROM samples WHERE contains(lower(channel), 'i') GROUP BY 1, 2")
def f18(spark, d):
    return samples(spark, d).where(F.contains(F.lower("channel"), F.lit("i"))).groupBy("log_id", "channel").agg(F.count("*").alias("n"))


@query("F14_part_number", "SELECT p_partkey, coalesce(nullif(regexp_extract(p_brand, '[0-9]{2}$'), ''), nullif(regexp_extract(p_type, '^[A-Z]{5,}'), ''), 'none') AS mark FROM part")
def f14(spark, d):
    first = lambda column, pattern: F.nullif(F.regexp_extract(column, pattern, 0), F.lit(""))
    return read(spark, d, "part").select("p_partkey", F.coalesce(first("p_brand", "[0-9]{2}$"), first("p_type", "^[A-Z]{5,}"), F.lit("none")).alias("mark"))


@query("F15_software_numbers", "WITH c AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]{4,}'))) AS mark FROM documents) SELECT doc_id, mark, CAST(length(mark) AS INTEGER) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(mark) DESC, mark) = 1")
def f15(spark, d):
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), 0))
    best = F.array_min(F.transform(marks, lambda m: F.struct((-F.length(m)).alias("k"), m.alias("mark"))))
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", best.alias("b")).where("b IS NOT NULL").select("doc_id", "b.mark", (-F.col("b.k")).alias("score"))


@query(
    "U6_newest_region_wins",
    """WITH s AS (SELECT p_brand, p_partkey % 997 AS a, p_partkey % 997 + p_size AS b, p_partkey AS seq FROM part WHERE p_size > 0), p AS (SELECT DISTINCT p_brand, unnest([a, b]) AS a FROM s),
    q AS (SELECT p_brand, a, lead(a) OVER (PARTITION BY p_brand ORDER BY a) AS b FROM p), h AS (SELECT q.p_brand, q.a, q.b, max(seq) AS seq FROM q JOIN s ON s.p_brand = q.p_brand AND s.a <= q.a AND s.b >= q.b GROUP BY ALL),
    m AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(seq) OVER w = seq THEN 0 ELSE 1 END AS n FROM h WINDOW w AS (PARTITION BY p_brand ORDER BY a)), r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT p_brand, min(a) AS "begin", max(b) AS "end", any_value(seq) AS seq FROM r GROUP BY p_brand, run""",
)
def u6(spark, d):
    spans = read(spark, d, "part").select("p_brand", (F.col("p_partkey") % 997).alias("begin"), (F.col("p_partkey") % 997 + F.col("p_size")).alias("end"), F.col("p_partkey").alias("seq"))
    return sequences.newest_wins(spans, "p_brand")


@query("E3_write_modes", f"WITH {RAW} SELECT array_id, pos, CAST(CASE col WHEN 0 THEN 100 WHEN 1 THEN raw + 5 WHEN 2 THEN round(raw * 1.1) WHEN 3 THEN (row % 2) * 255 ELSE raw END AS BIGINT) AS raw FROM raw_cells")
def e3(spark, d):
    c, raw = F.col("col"), F.col("raw")
    return raw_cells(spark, d).select("array_id", "pos", F.when(c == 0, 100).when(c == 1, raw + 5).when(c == 2, F.round(raw * 1.1).cast("long")).when(c == 3, (F.col("row") % 2) * 255).otherwise(raw).cast("long").alias("raw"))


@query("E10_pack_swap", f"WITH {RAW} SELECT array_id, pos, ((raw & 255) << 8) | ((raw >> 8) & 255) AS swapped FROM raw_cells")
def e10(spark, d):
    raw, low = F.col("raw"), F.lit(255)
    return raw_cells(spark, d).select("array_id", "pos", F.shiftleft(raw.bitwiseAND(low), 8).bitwiseOR(F.shiftright(raw, 8).bitwiseAND(low)).alias("swapped"))


@query("M14_harvest", f"WITH {PAIR}, n AS (SELECT array_id, count(*) FILTER (abs(delta) > 0.3) AS voices FROM pair GROUP BY array_id) SELECT array_id, voices FROM n WHERE voices > 0")
def m14(spark, d):
    both = arrays.compare(cells(spark, d), next_cells(spark, d))
    return both.where(F.abs("delta") > 0.3).groupBy("array_id").agg(F.count("*").alias("voices"))


@query("O14_changed_order", f"WITH {PAIR}, n AS (SELECT array_id, max(abs(delta)) AS size, count(*) FILTER (changed) AS changed, count(*) AS total FROM pair GROUP BY array_id) SELECT array_id, round(size, 6) AS size, changed, total FROM n WHERE changed > 0 ORDER BY n.size DESC, array_id")
def o14(spark, d):
    n = arrays.compare(cells(spark, d), next_cells(spark, d)).groupBy("array_id").agg(F.max(F.abs("delta")).alias("size"), F.count_if("changed").alias("changed"), F.count("*").alias("total"))
    return n.where("changed > 0").orderBy(F.desc("size"), "array_id").withColumn("size", F.round("size", 6))


@query("O3_twin_order", "SELECT p_partkey, p_type, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, levenshtein(p_type, 'STANDARD'), p_partkey) AS INTEGER) AS place FROM part")
def o3(spark, d):
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), F.levenshtein("p_type", F.lit("STANDARD")), "p_partkey")
    return read(spark, d, "part").select("p_partkey", "p_type", F.row_number().over(order).alias("place"))


@query("O6_folder_order", "SELECT p_brand, p_partkey, p_name FROM part ORDER BY p_brand, p_partkey")
def o6(spark, d):
    return read(spark, d, "part", "p_brand", "p_partkey", "p_name").orderBy("p_brand", "p_partkey")


@query("O5_best_candidates", f"WITH {CELLS} SELECT array_id, round(stddev_pop(value), 6) AS score FROM cells GROUP BY array_id ORDER BY stddev_pop(value) DESC, array_id LIMIT 500")
def o5(spark, d):
    s = cells(spark, d).groupBy("array_id").agg(F.stddev_pop("value").alias("score"))
    return s.orderBy(F.desc("score"), "array_id").limit(500).withColumn("score", F.round("score", 6))
