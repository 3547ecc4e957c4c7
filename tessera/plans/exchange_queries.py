"""Queries that write packs, patches, lists and logs and read them back, and twins in a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses
from ..operators import edits, packs, properties, sinks, twins
from ..sources import definitions, dimensions, logs, sidecars
from ..sources import images as image_files
from .carriers import RAW, raw_cells, read
from .image_queries import named
from .registry import query

HELD = "CAST(least(greatest(round(raw), -32768), 32767) AS BIGINT)"


def held(spark, d):
    return edits.edit(raw_cells(spark, d), "add", 0)


def pack(spark, d):
    """A pack a folder, one entry an array; odd arrays have their big end first."""
    data = packs.build(held(spark, d)).withColumnRenamed("array_id", "vec_id")
    of = read(spark, d, "embeddings", "vec_id", "label").join(data, "vec_id")
    big = F.col("vec_id") % 2 == 1
    tall = F.col("vec_id") % 5 == 0
    return of.select(F.col("label").alias("pack_id"), F.concat(F.lit("map "), F.col("vec_id").cast("string")).alias("name"), F.when(tall, 16).otherwise(8).alias("cols"), F.when(tall, 4).otherwise(8).alias("rows"), F.lit(2).alias("width"), big.alias("big_endian"), (F.col("vec_id") * 128).alias("address"), F.when(big, F.col("data")).otherwise(packs.swapped(F.col("data"), 2)).alias("data"))


PACKED = "packed AS (SELECT label AS pack_id, 'map ' || vec_id AS name, CASE WHEN vec_id % 5 = 0 THEN 16 ELSE 8 END AS cols, CASE WHEN vec_id % 5 = 0 THEN 4 ELSE 8 END AS rows, 2 AS width, vec_id % 2 = 1 AS big_endian, vec_id * 128 AS address, vec_id FROM embeddings)"


@query("K4_pack_json", f"WITH {RAW}, {PACKED} SELECT pack_id, name, cols, rows, big_endian, address, list({HELD} ORDER BY pos) AS raw FROM packed JOIN raw_cells ON array_id = vec_id GROUP BY ALL")
def k4_pack_json(spark, d):
    back = packs.from_json(packs.to_json(pack(spark, d)))
    data = F.when(F.col("big_endian"), F.col("data")).otherwise(packs.swapped(F.col("data"), 2))
    return back.select("pack_id", "name", "cols", "rows", "big_endian", "address", packs.raw_values(data, 2).alias("raw"))


@query("S10_pack_read", f"WITH {PACKED} SELECT pack_id, count(*) AS maps, CAST(sum(cols * rows * width) AS BIGINT) AS bytes, CAST(sum(address) AS BIGINT) AS addresses FROM packed GROUP BY pack_id")
def s10(spark, d):
    texts = packs.to_json(pack(spark, d))
    other = texts.withColumn("json", F.replace("json", F.lit('"format":"pack"'), F.lit('"format":"other"')))  # not a pack
    back = packs.from_json(texts.unionAll(other).unionAll(texts.withColumn("json", F.lit("{"))))
    return back.groupBy("pack_id").agg(F.count("*").alias("maps"), F.sum(F.length("data")).cast("long").alias("bytes"), F.sum("address").alias("addresses"))


@query("K4_pack_csv", f"WITH {PACKED} SELECT pack_id, address, printf('0x%08X', address) || ';' || name || ';' || (cols * rows * width) AS line FROM packed")
def k4_pack_csv(spark, d):
    return packs.to_csv(pack(spark, d))


@query(
    "K4_patch_json",
    "WITH b AS (SELECT p_partkey AS image_id, CAST(i - 1 AS BIGINT) AS address, CAST(ord(substr(p_name, i, 1)) AS INTEGER) AS before FROM part, range(1, 200) t(i) WHERE i <= length(p_name)) SELECT *, CAST(before - 32 AS INTEGER) AS after FROM b WHERE before BETWEEN 97 AND 109",
)
def k4_patch_json(spark, d):
    before = F.col("byte").cast("int")
    changed = named(spark, d).select("image_id", F.col("address").cast("long").alias("address"), before.alias("before"), F.when(before.between(97, 109), before - 32).otherwise(before).alias("after"))
    return packs.patch_bytes(packs.patch_json(sinks.patch_runs(changed)))


@query(
    "E10_pack_apply",
    f"""WITH {RAW}, {PACKED}, bytes AS (SELECT array_id, string_agg(printf('%02X%02X', (({HELD} + 65536) % 65536) % 256, (({HELD} + 65536) % 65536) // 256), '' ORDER BY pos) AS little FROM raw_cells GROUP BY array_id)
    SELECT pack_id, name, CASE WHEN a + cols * rows * width > 20000 THEN 'bounds' WHEN vec_id % 5 = 0 AND vec_id % 3 <> 0 THEN 'mismatch' ELSE 'applied' END AS status, a AS address,
        CASE WHEN a + cols * rows * width <= 20000 AND NOT (vec_id % 5 = 0 AND vec_id % 3 <> 0) THEN little END AS written
    FROM (SELECT *, CASE WHEN vec_id % 3 <> 0 THEN vec_id * 64 WHEN address <> 0 THEN address END AS a FROM packed) JOIN bytes ON array_id = vec_id WHERE a IS NOT NULL
    UNION ALL SELECT pack_id, name, 'address', NULL, NULL FROM packed WHERE vec_id = 0""",
)
def e10_pack_apply(spark, d):
    project = read(spark, d, "embeddings", "vec_id").where("vec_id % 3 <> 0").select(F.concat(F.lit("map "), F.col("vec_id").cast("string")).alias("name"), F.lit(8).alias("cols"), F.lit(8).alias("rows"), (F.col("vec_id") * 64).alias("address"))
    return packs.apply(pack(spark, d), project, 20000).withColumn("written", F.hex("written"))


def maps(spark, d):
    stats = held(spark, d).groupBy(F.col("array_id").alias("vec_id")).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.round(F.avg("raw"), 3).alias("mean"), F.count_if(F.col("raw") > 0).alias("modified"))
    of = read(spark, d, "embeddings", "vec_id", "label").join(stats, "vec_id")
    return of.select(F.col("vec_id").alias("array_id"), F.concat(F.lit('map "'), F.col("vec_id").cast("string"), F.lit('", wide')).alias("name"), (F.col("vec_id") * 128).alias("address"), F.lit("MAP").alias("kind"), F.lit(8).alias("cols"), F.lit(8).alias("rows"), F.lit(2).alias("width"), F.lit(True).alias("signed"), F.lit(False).alias("big_endian"), "low", "high", "mean", "modified", F.lit("rpm").alias("x_name"), F.lit("1/min").alias("x_unit"), F.lit("load").alias("y_name"), F.lit("%").alias("y_unit"))


@query("K1_map_csv", f"WITH {RAW}, s AS (SELECT array_id, min({HELD}) AS low, max({HELD}) AS high, round(avg({HELD}), 3) AS mean, count(*) FILTER ({HELD} > 0) AS modified FROM raw_cells GROUP BY array_id) SELECT array_id, '\"map \"\"' || array_id || '\"\", wide\",' || printf('0x%08X', array_id * 128) || ',128,MAP,8,8,2,yes,little,' || low || '.000,' || high || '.000,' || printf('%.3f', mean) || ',' || modified AS line FROM s")
def k1(spark, d):
    return sinks.map_lines(maps(spark, d))


@query("K2_map_json", f"WITH {RAW} SELECT array_id, 'map \"' || array_id || '\", wide' AS name, printf('0x%08X', array_id * 128) AS address, CAST(128 AS INTEGER) AS length, 'rpm' AS x_name, '%' AS y_unit, list({HELD} ORDER BY pos) AS cells, min({HELD}) AS low, max({HELD}) AS high FROM raw_cells GROUP BY array_id")
def k2_json(spark, d):
    texts = sinks.map_json(maps(spark, d), held(spark, d).select("array_id", "pos", F.col("raw").cast("long").alias("value")))
    axis = "struct<name: string, unit: string>"
    m = F.from_json("json", f"name string, address string, length int, xAxis {axis}, yAxis {axis}, cells array<bigint>, min bigint, max bigint").alias("m")
    return texts.select("array_id", m).select("array_id", "m.name", "m.address", "m.length", F.col("m.xAxis.name").alias("x_name"), F.col("m.yAxis.unit").alias("y_unit"), "m.cells", F.col("m.min").alias("low"), F.col("m.max").alias("high"))


@query("K3_s_record_round_trip", "SELECT p_partkey AS image_id, p_name AS name FROM part")
def k3_s_record(spark, d):
    lines = sinks.s_record_lines(named(spark, d)).groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").cast("binary").alias("content"))
    return image_files.assemble(image_files.s_records(lines)).select("image_id", F.decode("bytes", "UTF-8").alias("name"))


TWIN_RANK = "CASE kind WHEN 'project' THEN 0 WHEN 'data' THEN 1 ELSE 2 END"
_BITS = "(bit_count(xor(CAST('0x' || substr({0}, 1, 15) AS BIGINT), CAST('0x' || substr({1}, 1, 15) AS BIGINT))) + bit_count(xor(CAST('0x' || substr({0}, 16, 15) AS BIGINT), CAST('0x' || substr({1}, 16, 15) AS BIGINT))) + bit_count(xor(CAST('0x' || substr({0}, 31, 2) AS BIGINT), CAST('0x' || substr({1}, 31, 2) AS BIGINT)))) / 128.0::DOUBLE"


@query(
    "M6_twins",
    f"""WITH e AS (SELECT p_partkey AS entry_id, md5(p_brand) AS id_project, md5(substr(p_brand, 2, 4)) AS id_data, md5(p_type) AS chunk0, md5(CAST(p_size AS VARCHAR)) AS chunk1 FROM part),
    image AS (SELECT p_brand AS data FROM part WHERE p_partkey = 1),
    project AS (SELECT e.* FROM e, image WHERE id_project = md5(data)),
    data AS (SELECT e.* FROM e, image WHERE id_project <> md5(data) AND id_data = md5(substr(data, 2, 4)) ORDER BY entry_id LIMIT 300),
    needle AS (SELECT arg_min(chunk0, entry_id) AS c0, arg_min(chunk1, entry_id) AS c1 FROM project),
    far AS (SELECT entry_id, least({_BITS.format('chunk0', 'c0')}, {_BITS.format('chunk1', 'c1')}) AS distance FROM e, needle WHERE entry_id NOT IN (SELECT entry_id FROM project UNION ALL SELECT entry_id FROM data)),
    near AS (SELECT * FROM far WHERE distance > 0 AND distance <= 0.33 ORDER BY distance, entry_id LIMIT 200),
    every AS (SELECT entry_id, 'project' AS kind, 0.0::DOUBLE AS distance FROM project UNION ALL SELECT entry_id, 'data', 0.0 FROM data UNION ALL SELECT entry_id, 'near', distance FROM near)
    SELECT entry_id, kind, distance, CAST(row_number() OVER (ORDER BY {TWIN_RANK}, distance, entry_id) AS INTEGER) AS place FROM every""",
)
def m6(spark, d):
    part = read(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_size")
    catalog = part.select(F.col("p_partkey").alias("entry_id"), F.md5(F.col("p_brand").cast("binary")).alias("id_project"), F.md5(F.substring("p_brand", 2, 4).cast("binary")).alias("id_data"), F.lit("1: 000001-000004").alias("regions"), F.md5(F.col("p_type").cast("binary")).alias("chunk0"), F.md5(F.col("p_size").cast("string").cast("binary")).alias("chunk1"))
    image = part.where("p_partkey = 1").select(F.col("p_brand").cast("binary").alias("data"))
    return twins.twins(image, catalog, F.md5)


@query(
    "S9_map_list",
    """WITH lines AS (SELECT p_size AS path, p_partkey AS no, p_partkey % 40 AS address, p_brand AS name, p_size * 2 AS size FROM part),
    last AS (SELECT path, address, arg_max(name, no) AS name, CAST(arg_max(size, no) AS INTEGER) AS size FROM lines GROUP BY path, address)
    SELECT path, address, CASE WHEN row_number() OVER (PARTITION BY path, name ORDER BY address) > 1 THEN name || ' [$' || printf('%X', address) || ']' ELSE name END AS name, size FROM last""",
)
def s9(spark, d):
    line = F.concat(F.lit("0x"), F.hex(F.col("p_partkey") % 40), F.lit(";"), "p_brand", F.lit(";"), (F.col("p_size") * 2).cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda s: s["line"]), "\r\n")
    files = read(spark, d, "part").groupBy(F.col("p_size").alias("path")).agg(F.concat(F.lit("﻿Address;Name;Size\n"), text).cast("binary").alias("content"))
    return logs.map_list_of(files)


@query(
    "S11_log_files",
    """WITH s AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, epoch_us(ts) // 1000 AS t, value FROM events)
    SELECT log_id, CAST(CASE WHEN log_id % 2 = 0 THEN n ELSE n + 2 END AS INTEGER) AS row_idx, t::DOUBLE AS time_ms, c.channel, CASE WHEN c.channel = 'boost' THEN 'bar' ELSE '°C' END AS unit, CASE WHEN c.channel = 'boost' THEN round(value, 3) ELSE 0.0 END AS value
    FROM s, (VALUES ('boost'), ('air "x", in')) c(channel)""",
)
def s11(spark, d):
    t, v = F.unix_millis(F.col("ts").cast("timestamp")), F.format_string("%.3f", F.round("value", 3))
    one = F.concat_ws(";", t.cast("string"), v, F.lit("bad"))
    three = F.concat_ws(",", F.concat((t / 1000).cast("decimal(20,3)").cast("string")), v, F.lit(""))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", c.alias("l")))), lambda s: s["l"]), "\n")
    rows = read(spark, d, "events").groupBy(F.col("user_id").alias("log_id")).agg(text(one).alias("one"), text(three).alias("three"))
    first = F.concat(F.lit('timestamp;boost (bar);air "x", in (°C)\n'), "one")
    second = F.concat(F.lit('Time,boost,"air ""x"", in"\nt,b,a\ns,bar,°C\n'), "three")
    return logs.samples_of(rows.select("log_id", F.when(F.col("log_id") % 2 == 0, first.cast("binary")).otherwise(F.encode(second, "ISO-8859-1")).alias("content")))


@query(
    "S12_trouble_codes",
    "SELECT p_brand AS file_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS no, printf('%05X', p_partkey) AS code, p_name AS description, 'P' || (p_size + 1000) AS obd_code, p_type AS label, lpad(bin(p_size), 8, '0') AS bits, ['stored', 'size ' || p_size] AS flags FROM part",
)
def s12(spark, d):
    code = F.format_string("%05X", "p_partkey")  # five digits at least; lpad would cut a longer number
    section = F.concat(code, F.lit("  "), "p_name", F.lit("\n  P"), (F.col("p_size") + 1000).cast("string"), F.lit("  "), "p_type", F.lit("\n"), F.lpad(F.bin("p_size"), 8, "0"), F.lit("  stored\nsize "), F.col("p_size").cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", section.alias("s")))), lambda s: s["s"]), "\n\n")
    files = read(spark, d, "part").groupBy(F.col("p_brand").alias("file_id")).agg(F.concat(F.lit("2 DTC entries\n\n"), text).alias("text"))
    return sidecars.trouble_codes(files)


ADDRESSES = "a AS (SELECT p_partkey, p_partkey * 97 % 3000 AS b, p_partkey * 97 % 3000 + p_size * 8 - 16 AS e, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 4294967295 ELSE 2500 END AS l, CASE p_partkey % 3 WHEN 0 THEN 0 ELSE 1000 END AS base, CASE p_partkey % 5 WHEN 0 THEN 0 ELSE 2048 END AS rom FROM part)"


@query(
    "P11_pack_addresses",
    f"""WITH {ADDRESSES} SELECT p_partkey,
        CASE WHEN b < 128 OR e <= b OR l IN (0, 4294967295) THEN NULL WHEN rom > 0 THEN CASE WHEN e <= rom THEN b WHEN base <> 0 AND b >= base AND e <= base + rom THEN b - base END WHEN e <= l THEN b END AS map_at,
        CASE WHEN b = 0 THEN NULL WHEN rom = 0 THEN CASE WHEN base <> 0 AND b >= base THEN b - base ELSE b END WHEN b + 32 <= rom THEN b WHEN base <> 0 AND b >= base AND b + 32 <= base + rom THEN b - base END AS axis_at FROM a""",
)
def p11(spark, d):
    k, z = F.col("p_partkey"), F.lit(0).cast("long")
    begin = k * 97 % 3000
    end = begin + F.col("p_size") * 8 - 16
    limit = F.when(k % 4 == 0, z).when(k % 4 == 1, F.lit(4294967295)).otherwise(2500)
    base, rom = F.when(k % 3 == 0, z).otherwise(1000), F.when(k % 5 == 0, z).otherwise(2048)
    return read(spark, d, "part").select("p_partkey", addresses.map_offset(begin, end, limit, base, rom).alias("map_at"), addresses.axis_offset(begin, F.lit(16), F.lit(2), base, rom).alias("axis_at"))


@query("P16_property_by_id", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment WHEN 2 THEN CAST(c_nationkey AS VARCHAR) WHEN 3 THEN md5(c_name) END AS property FROM customer")
def p16(spark, d):
    fields = {0: F.col("c_name"), 1: F.col("c_mktsegment"), 2: F.col("c_nationkey"), 3: F.md5(F.col("c_name").cast("binary"))}
    return read(spark, d, "customer").select("c_custkey", properties.property_of(fields, F.col("c_custkey") % 5).alias("property"))


@query(
    "P17_set_properties",
    """WITH x AS (SELECT o_custkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'segment' WHEN 1 THEN 'nation' WHEN 2 THEN 'name' ELSE 'colour' END AS property, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 'many' ELSE CAST(o_orderkey % 90 AS VARCHAR) END AS value, o_orderkey AS seq FROM orders),
    l AS (SELECT id, arg_max({'v': value}, seq) FILTER (property = 'segment') AS s, arg_max({'v': value}, seq) FILTER (property = 'nation') AS n FROM x GROUP BY id)
    SELECT c_custkey, c_name, CASE WHEN s IS NULL THEN c_mktsegment ELSE s.v END AS c_mktsegment, CASE WHEN n IS NULL OR (n.v IS NOT NULL AND TRY_CAST(n.v AS INTEGER) IS NULL) THEN c_nationkey ELSE TRY_CAST(n.v AS INTEGER) END AS c_nationkey FROM customer LEFT JOIN l ON id = c_custkey""",
)
def p17(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, "segment").when(k % 4 == 1, "nation").when(k % 4 == 2, "name").otherwise("colour")
    value = F.when(k % 7 == 0, F.lit(None)).when((k % 4 == 1) & (k % 3 == 0), "many").otherwise((k % 90).cast("string"))
    changes = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), name.alias("property"), value.alias("value"), k.alias("seq"))
    customers = read(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return properties.set_properties(customers, "c_custkey", changes, {"segment": "c_mktsegment", "nation": "c_nationkey", "name": "c_name"}, read_only=("name",))


@query("S19_project_registry", "WITH b AS (SELECT o_custkey AS path, o_orderpriority AS name, o_orderdate AS opened FROM orders) SELECT path, arg_max(name, (opened, name)) AS name, max(opened) AS opened FROM b GROUP BY path ORDER BY opened DESC, path")
def s19(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("opened"), "o_orderstatus")
    return properties.upsert_projects(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F' or o_orderstatus is null"))


@query("S20_dimension_json", "SELECT r_name AS make, n_nationkey AS key, n_name AS model FROM nation JOIN region ON n_regionkey = r_regionkey")
def s20(spark, d):
    nested = read(spark, d, "nation").join(F.broadcast(read(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("model")))).alias("models"))
    return dimensions.makes(nested.select(F.to_json(F.struct(F.col("r_name").alias("make"), "models")).alias("json")))


@query("K5_xdf_round_trip", "SELECT vec_id // 50 AS file_id, 'map <' || vec_id || '> & \"co\"' AS name, CASE WHEN vec_id % 4 = 0 THEN 'VALUE' WHEN vec_id % 4 = 1 THEN 'CURVE' ELSE 'MAP' END AS type, vec_id * 128 AS address, CAST(CASE vec_id % 4 WHEN 0 THEN 1 ELSE 8 END AS INTEGER) AS columns, CAST(CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 8 END AS INTEGER) AS rows, 0.5::DOUBLE AS a, -(vec_id % 3)::DOUBLE + 1 AS b, 'group ' || label AS folder FROM embeddings")
def k5(spark, d):
    k = F.col("vec_id")
    rest = k % 4
    rows = read(spark, d, "embeddings", "vec_id", "label").select(F.floor(k / 50).cast("long").alias("file_id"), F.concat(F.lit("map <"), k.cast("string"), F.lit('> & "co"')).alias("name"), (k * 128).alias("address"), F.when(rest == 0, 1).otherwise(8).alias("cols"), F.when(rest <= 1, 1).otherwise(8).alias("rows"), F.lit(2).alias("width"), F.lit(False).alias("signed"), F.lit(0.5).alias("a"), (1.0 - k % 3).alias("b"), F.lit("%").alias("unit"), F.concat(F.lit("group "), F.col("label").cast("string")).alias("folder"))
    back = definitions.xdf_maps(sinks.xdf_text(rows))
    return back.select("file_id", "name", "type", F.col("address").cast("long").alias("address"), "columns", "rows", "a", "b", "folder")


@query(
    "K6_change_report",
    f"""WITH {RAW}, p AS (SELECT a.array_id, a.folder, count(*) FILTER (a.raw <> b.raw) AS changed, count(*) AS cells, min(b.raw - a.raw) AS least, max(b.raw - a.raw) AS most FROM raw_cells a JOIN raw_cells b ON b.array_id = a.array_id + 1 AND a.pos = b.pos GROUP BY ALL),
    r AS (SELECT array_id // 20 AS report_id, string_agg('<tr><td>map ' || array_id || ' &amp; more</td><td>0x' || printf('%X', array_id * 128) || '</td><td>' || changed || ' / ' || cells || '</td><td>' || least || '.000</td><td>' || most || '.000</td></tr>', '' ORDER BY changed DESC, array_id) AS rows FROM p WHERE changed > 0 GROUP BY 1)
    SELECT report_id, '<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Changes</title></head><body><h1>Changes</h1><table><tr><th>Map</th><th>Address</th><th>Changed</th><th>Least</th><th>Most</th></tr>' || rows || '</table></body></html>' AS html FROM r""",
)
def k6(spark, d):
    now = raw_cells(spark, d)
    new = now.select((F.col("array_id") - 1).alias("array_id"), "pos", F.col("raw").alias("new"))
    delta = F.col("new") - F.col("raw")
    summary = now.join(new, ["array_id", "pos"]).groupBy("array_id").agg(F.count_if(delta != 0).alias("changed"), F.count("*").alias("cells"), F.min(delta).alias("least"), F.max(delta).alias("most"))
    named_maps = summary.select(F.floor(F.col("array_id") / 20).cast("long").alias("report_id"), F.concat(F.lit("map "), F.col("array_id").cast("string"), F.lit(" & more")).alias("name"), (F.col("array_id") * 128).alias("address"), "changed", "cells", "least", "most")
    return sinks.change_report(named_maps, "Changes")
