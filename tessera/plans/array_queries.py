"""Queries over cells: decoding, statistics, differences, edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.formula import formula
from ..operators import arrays
from .carriers import CELLS, PAIR, RAW, cells, next_cells, raw_cells, read
from .registry import query


def r6(*names: str):
    """The named columns, rounded."""
    return {n: F.round(n, 6) for n in names}


def pair(spark, d):
    return arrays.compare(cells(spark, d), next_cells(spark, d))


@query("A1_map_statistics", f"WITH {CELLS} SELECT array_id, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(max(value) - min(value), 6) AS spread FROM cells GROUP BY array_id")
def a1(spark, d):
    return arrays.statistics(cells(spark, d)).withColumns(r6("low", "high", "mean", "deviation", "spread"))


@query("P1_typed_read", "SELECT p_partkey, CAST(ord(p_name[1]) AS BIGINT) AS u8, CAST(ord(p_name[1]) + 256 * ord(p_name[2]) AS BIGINT) AS u16_le, CAST(256 * ord(p_name[1]) + ord(p_name[2]) AS BIGINT) AS u16_be, CAST(ord(p_name[1]) + 256 * ord(p_name[2]) + 65536 * ord(p_name[3]) + 16777216 * ord(p_name[4]) AS BIGINT) AS u32_le, -99999.0 AS beyond FROM part")
def p1(spark, d):
    b = F.col("p_name").cast("binary")
    return read(spark, d, "part", "p_partkey", "p_name").select("p_partkey", codec.read_unsigned(b, 0, 1).alias("u8"), codec.read_unsigned(b, 0, 2).alias("u16_le"), codec.read_unsigned(b, 0, 2, True).alias("u16_be"), codec.read_unsigned(b, 0, 4).alias("u32_le"), codec.or_sentinel(codec.read_unsigned(b, 10_000, 2)).alias("beyond"))


@query("P2_cell_decode", f"WITH {RAW} SELECT array_id, pos, raw, round(raw * 0.001 + 0.5, 6) AS phys, round(CASE WHEN raw = 0 THEN 0 ELSE 1000.0 / raw END, 6) AS rational FROM raw_cells")
def p2(spark, d):
    return raw_cells(spark, d).select("array_id", "pos", "raw", F.round(codec.linear(F.col("raw"), 0.001, 0.5), 6).alias("phys"), F.round(codec.rational_to_phys(F.col("raw"), 0.0, 0.0, 1000.0, 0.0, 1.0, 0.0), 6).alias("rational"))


@query("P3_cell_encode", f"WITH {RAW} SELECT array_id, pos, CAST(least(greatest(round(value * 600), -128), 127) AS BIGINT) AS stored, CASE WHEN round(value * 600) < -128 OR round(value * 600) > 127 THEN 'Clamped' ELSE 'Ok' END AS status FROM raw_cells")
def p3(spark, d):
    return cells(spark, d).withColumn("e", codec.encode(F.col("value") * 600, 1, True)).select("array_id", "pos", F.col("e.value").alias("stored"), F.col("e.status").alias("status"))


@query("P4_raw_text", f"WITH {RAW} SELECT array_id, pos, printf('%04X', raw & 65535) AS hexadecimal, printf('%.2f', value) AS shown FROM raw_cells")
def p4(spark, d):
    return raw_cells(spark, d).select("array_id", "pos", codec.hex_text(F.col("raw"), 2).alias("hexadecimal"), F.format_string("%.2f", "value").alias("shown"))


@query("P5_matrix_read", f"WITH {CELLS} SELECT array_id, CAST(pos % 8 AS INTEGER) AS row, CAST(pos // 8 AS INTEGER) AS col, round(value, 6) AS value FROM cells")
def p5(spark, d):
    found = arrays.cells_of(read(spark, d, "embeddings"), "vec_id", "embedding", 8, column_major=True, rows=8)
    return found.select("array_id", "row", "col", F.round("value", 6).alias("value"))


@query("P6_axis_read", f"WITH {RAW} SELECT array_id, list(round(CASE WHEN array_id % 2 = 0 THEN col * 10.0::DOUBLE ELSE raw * 0.001::DOUBLE END, 6) ORDER BY col) AS axis FROM raw_cells WHERE row = 0 GROUP BY array_id")
def p6(spark, d):
    fixed = F.when(F.col("array_id") % 2 == 0, F.col("col") * 10.0)
    rows = raw_cells(spark, d).where("row = 0").select("array_id", "col", F.round(F.coalesce(fixed, codec.linear(F.col("raw"), 0.001, 0.0)), 6).alias("x"))
    return rows.groupBy("array_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "x"))), lambda s: s["x"]).alias("axis"))


@query("P7_hex_dump", "SELECT p_partkey, hex(encode(p_name)[3:8]) AS dump FROM part")
def p7(spark, d):
    return read(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.hex(F.substring(F.col("p_name").cast("binary"), 3, 6)).alias("dump"))


@query("P8_version_values", f"WITH {CELLS} SELECT a.array_id, a.pos, round(a.value, 6) AS current, round(b.value, 6) AS original FROM cells a LEFT JOIN cells b ON b.array_id = a.array_id + 1 AND b.pos = a.pos")
def p8(spark, d):
    original = next_cells(spark, d).select("array_id", "pos", F.round("value", 6).alias("original"))
    return cells(spark, d).select("array_id", "pos", F.round("value", 6).alias("current")).join(original, ["array_id", "pos"], "left")


@query("P9_base_detection", "WITH bases(base, rank) AS (VALUES (0, 1), (500, 2), (1000, 3)), ends AS (SELECT p_size, min(p_partkey) AS low, max(p_partkey) AS high FROM part GROUP BY p_size) SELECT p_size, CAST(arg_min(base, rank) FILTER (low >= base AND high < base + 1500) AS INTEGER) AS base FROM ends, bases GROUP BY p_size")
def p9(spark, d):
    ends = read(spark, d, "part", "p_size", "p_partkey").groupBy("p_size").agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    fits = [F.when((F.col("low") >= base) & (F.col("high") < base + 1500), F.lit(base)) for base in (0, 500, 1000)]
    return ends.select("p_size", F.coalesce(*fits).alias("base"))


@query("P10_pack_offset", "WITH o(off) AS (VALUES (0), (200), (-200)), hits AS (SELECT p_size, off, count(*) FILTER (p_partkey + off BETWEEN 1 AND 1000) AS inside, count(*) AS n FROM part, o GROUP BY p_size, off), best AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY inside DESC, abs(off), off) AS k FROM hits) SELECT p_size, CAST(off AS INTEGER) AS off, round(100.0 * inside / n, 4) AS percent FROM best WHERE k = 1")
def p10(spark, d):
    offsets = (0, -200, 200)  # first wins a tie
    hits = read(spark, d, "part", "p_size", "p_partkey").groupBy("p_size").agg(F.count("*").alias("n"), *(F.count_if((F.col("p_partkey") + o).between(1, 1000)).alias(f"h{k}") for k, o in enumerate(offsets)))
    best = F.array_max(F.array(*(F.struct(F.col(f"h{k}").alias("inside"), F.lit(-k).alias("rank"), F.lit(o).alias("off")) for k, o in enumerate(offsets))))
    return hits.withColumn("best", best).select("p_size", F.col("best.off").alias("off"), F.round(100.0 * F.col("best.inside") / F.col("n"), 4).alias("percent"))


@query("P12_formula", f"WITH {CELLS} SELECT array_id, pos, round(pow(value, 2) + greatest(row, col) / 2.0 - abs(value), 6) AS result FROM cells")
def p12(spark, d):
    return cells(spark, d).select("array_id", "pos", F.round(formula("pow(v, 2) + max(r, c) / 2 - abs(v)", v=F.col("value"), r=F.col("row"), c=F.col("col")), 6).alias("result"))


@query("P15_trouble_code", "SELECT p_partkey, substr('PCBU', CAST((p_partkey * 37) % 65536 >> 14 AS INTEGER) + 1, 1) || CAST((p_partkey * 37) % 65536 >> 12 & 3 AS VARCHAR) || printf('%03X', (p_partkey * 37) % 65536 & 4095) AS code FROM part")
def p15(spark, d):
    return read(spark, d, "part", "p_partkey").select("p_partkey", codec.trouble_code(F.col("p_partkey") * 37 % 65536).alias("code"))


@query("J1_compare_cells", f"WITH {PAIR} SELECT array_id, row, col, round(value, 6) AS value, round(other, 6) AS other, round(delta, 6) AS delta, changed FROM pair")
def j1(spark, d):
    return pair(spark, d).withColumns(r6("value", "other", "delta"))


@query("J2_linked_compare", f"WITH {CELLS}, link AS (SELECT vec_id AS array_id, vec_id + 2 AS linked, 50 + vec_id % 50 AS confidence FROM embeddings) SELECT l.array_id, l.linked, count(*) AS cells, round(avg(b.value - a.value), 6) AS mean_delta FROM link l JOIN cells a ON a.array_id = l.array_id JOIN cells b ON b.array_id = l.linked AND a.pos = b.pos WHERE confidence >= 60 GROUP BY l.array_id, l.linked")
def j2(spark, d):
    link = read(spark, d, "embeddings", "vec_id").select(F.col("vec_id").alias("array_id"), (F.col("vec_id") + 2).alias("linked"), (50 + F.col("vec_id") % 50).alias("confidence")).where("confidence >= 60")
    other = cells(spark, d).select(F.col("array_id").alias("linked"), "pos", F.col("value").alias("other"))
    return cells(spark, d).join(link, "array_id").join(other, ["linked", "pos"]).groupBy("array_id", "linked").agg(F.count("*").alias("cells"), F.round(F.avg(F.col("other") - F.col("value")), 6).alias("mean_delta"))


@query("J3_two_maps", f"WITH {CELLS} SELECT a.pos, round(a.value, 6) AS first, round(b.value, 6) AS second FROM cells a JOIN cells b ON a.pos = b.pos AND a.array_id = 3 AND b.array_id = 7 WHERE abs(a.value - b.value) > 1e-9")
def j3(spark, d):
    one = cells(spark, d).where("array_id = 3").select("pos", F.col("value").alias("a"))
    two = cells(spark, d).where("array_id = 7").select("pos", F.col("value").alias("b"))
    return one.join(two, "pos").where(F.abs(F.col("a") - F.col("b")) > 1e-9).select("pos", F.round("a", 6).alias("first"), F.round("b", 6).alias("second"))


@query("A2_export_statistics", f"WITH {PAIR} SELECT array_id, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, count(*) FILTER (changed) AS modified FROM pair GROUP BY array_id")
def a2(spark, d):
    v = F.col("value")
    return pair(spark, d).groupBy("array_id").agg(F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.count_if("changed").alias("modified"))


@query("A3_change_summary", f"WITH {PAIR} SELECT array_id, count(*) FILTER (changed) AS changed, round(min(delta) FILTER (changed), 6) AS least, round(max(delta) FILTER (changed), 6) AS most FROM pair GROUP BY array_id HAVING count(*) FILTER (changed) > 0")
def a3(spark, d):
    return arrays.change_summary(pair(spark, d)).where("changed > 0").select("array_id", "changed", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"))


@query("A4_difference_totals", f"WITH {PAIR}, m AS (SELECT array_id, count(*) FILTER (changed) AS changed, avg(delta) FILTER (changed) AS mean FROM pair GROUP BY array_id) SELECT count(*) FILTER (changed > 0) AS maps, CAST(sum(changed) AS BIGINT) AS cells, round(avg(mean), 6) AS mean_of_means FROM m")
def a4(spark, d):
    return arrays.change_summary(pair(spark, d)).agg(F.count_if(F.col("changed") > 0).alias("maps"), F.sum("changed").alias("cells"), F.round(F.avg("mean_changed"), 6).alias("mean_of_means"))


@query("A5_map_difference", f"WITH {PAIR} SELECT array_id, count(*) FILTER (changed) AS changed, round(max(abs(delta)), 6) AS largest, round(avg(abs(delta)), 6) AS mean_all FROM pair GROUP BY array_id HAVING count(*) FILTER (changed) > 0")
def a5(spark, d):
    return arrays.change_summary(pair(spark, d)).where("changed > 0").select("array_id", "changed", F.round("largest", 6).alias("largest"), F.round("mean_all", 6).alias("mean_all"))


@query("A6_stock_and_tuned", f"WITH {PAIR} SELECT array_id, round(min(value), 6) AS stock_low, round(max(value), 6) AS stock_high, round(avg(value), 6) AS stock_mean, round(min(other), 6) AS tuned_low, round(max(other), 6) AS tuned_high, round(avg(other), 6) AS tuned_mean FROM pair GROUP BY array_id")
def a6(spark, d):
    made = [F.round(f(c), 6).alias(f"{n}_{s}") for n, c in (("stock", "value"), ("tuned", "other")) for s, f in (("low", F.min), ("high", F.max), ("mean", F.avg))]
    return pair(spark, d).groupBy("array_id").agg(*made)


@query("A7_modified_maps", f"WITH {PAIR} SELECT array_id FROM pair GROUP BY array_id HAVING bool_or(changed)")
def a7(spark, d):
    return pair(spark, d).groupBy("array_id").agg(F.bool_or("changed").alias("any")).where("any").select("array_id")


@query("A8_equal_bytes", f"WITH {PAIR} SELECT count(*) FILTER (round(value * 10) = round(other * 10)) AS equal, count(*) FILTER (round(value * 10) <> round(other * 10)) AS different FROM pair")
def a8(spark, d):
    same = F.round(F.col("value") * 10) == F.round(F.col("other") * 10)
    return pair(spark, d).agg(F.count_if(same).alias("equal"), F.count_if(~same).alias("different"))


@query("A9_byte_difference", f"WITH {PAIR} SELECT array_id, count(*) AS differing, CAST(min(row * 8 + col) AS INTEGER) AS first FROM pair WHERE abs(delta) > 0.2 GROUP BY array_id")
def a9(spark, d):
    return pair(spark, d).where("abs(delta) > 0.2").groupBy("array_id").agg(F.count("*").alias("differing"), F.min(F.col("row") * 8 + F.col("col")).alias("first"))


@query("A10_shape", f"WITH {CELLS}, s AS (SELECT *, value - lag(value) OVER (PARTITION BY array_id ORDER BY pos) AS step FROM cells) SELECT array_id, round(avg(CAST(step = 0 AS DOUBLE)), 6) AS flat_share, bool_and(step >= 0) AS rising, bool_and(step <= 0) AS falling, arg_max(pos, value) AS peak, arg_min(pos, value) AS valley, round(avg(abs(step)), 6) AS mean_step, round(max(abs(step)), 6) AS cliff FROM s GROUP BY array_id")
def a10(spark, d):
    return arrays.shape(cells(spark, d)).withColumns(r6("flat_share", "mean_step", "cliff"))


@query("A11_anomalies", f"WITH {CELLS}, s AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM cells WINDOW w AS (PARTITION BY array_id)) SELECT array_id, min(value) = max(value) AS flat, count(*) FILTER (abs(value - m) > 2 * sd) AS outliers, count(*) FILTER (value <= -0.25 OR value >= 0.25) AS at_limits FROM s GROUP BY array_id")
def a11(spark, d):
    return arrays.anomalies(cells(spark, d), sigmas=2.0, low=-0.25, high=0.25)


@query("A12_folder_counts", "SELECT label AS folder, count(*) AS arrays FROM embeddings GROUP BY label")
def a12(spark, d):
    return read(spark, d, "embeddings", "label").groupBy(F.col("label").alias("folder")).agg(F.count("*").alias("arrays"))


@query("A13_histogram", f"WITH {CELLS}, s AS (SELECT array_id, value, min(value) OVER w AS low, max(value) OVER w AS high FROM cells WINDOW w AS (PARTITION BY array_id)) SELECT array_id, CAST(least(floor((value - low) * 32 / (high - low)), 31) AS INTEGER) AS bin, count(*) AS n FROM s GROUP BY 1, 2")
def a13(spark, d):
    return arrays.histogram(cells(spark, d), 32)


@query("A14_cell_consensus", f"WITH {CELLS} SELECT folder, row, col, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sigma, count(*) AS n FROM cells GROUP BY folder, row, col")
def a14(spark, d):
    return cells(spark, d).groupBy("folder", "row", "col").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sigma"), F.count("*").alias("n"))


@query("A16_dominant_delta", f"WITH {RAW}, x AS (SELECT a.folder, b.raw - a.raw AS delta, count(*) AS n FROM raw_cells a JOIN raw_cells b ON b.array_id = a.array_id + 1 AND a.pos = b.pos GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY n DESC, delta) AS k FROM x) SELECT folder, delta, n FROM k WHERE k = 1")
def a16(spark, d):
    other = raw_cells(spark, d).select((F.col("array_id") - 1).alias("array_id"), "pos", F.col("raw").alias("other"))
    counts = raw_cells(spark, d).join(other, ["array_id", "pos"]).groupBy("folder", (F.col("other") - F.col("raw")).alias("delta")).agg(F.count("*").alias("n"))
    best = counts.groupBy("folder").agg(F.max(F.struct(F.col("n"), (-F.col("delta")).alias("d"))).alias("b"))
    return best.select("folder", (-F.col("b.d")).alias("delta"), F.col("b.n").alias("n"))


@query("A25_match_percent", f"WITH {PAIR} SELECT array_id, round(100 * avg(CAST(abs(delta) < 0.05 AS DOUBLE)), 6) AS percent FROM pair GROUP BY array_id")
def a25(spark, d):
    return pair(spark, d).groupBy("array_id").agg(F.round(100 * F.avg((F.abs("delta") < 0.05).cast("double")), 6).alias("percent"))


@query("A26_relative_delta", f"WITH {PAIR}, p AS (SELECT array_id, CASE WHEN value = 0 THEN 100 * sign(delta) ELSE 100 * delta / abs(value) END AS percent FROM pair) SELECT array_id, round(max(abs(percent)), 4) AS largest, round(min(percent), 4) AS least, round(max(percent), 4) AS most FROM p GROUP BY array_id")
def a26(spark, d):
    percent = F.when(F.col("value") == 0, 100 * F.signum("delta")).otherwise(F.try_divide(100 * F.col("delta"), F.abs("value")))
    p = pair(spark, d).select("array_id", percent.alias("percent"))
    return p.groupBy("array_id").agg(F.round(F.max(F.abs("percent")), 4).alias("largest"), F.round(F.min("percent"), 4).alias("least"), F.round(F.max("percent"), 4).alias("most"))


@query("A27_bucket_mean", f"WITH {CELLS} SELECT array_id, CAST(pos // 16 AS INTEGER) AS bucket, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sigma FROM cells WHERE pos % 16 % 2 = 0 GROUP BY 1, 2")
def a27(spark, d):
    strided = cells(spark, d).where("pos % 16 % 2 = 0").withColumn("bucket", F.floor(F.col("pos") / 16).cast("int"))
    return strided.groupBy("array_id", "bucket").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sigma"))


@query("W7_moving_average", f"WITH {CELLS} SELECT array_id, pos, round(avg(value) OVER (PARTITION BY array_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM cells")
def w7(spark, d):
    return arrays.smooth_line(cells(spark, d), 2).withColumns(r6("smooth"))


@query("W8_smooth_plane", f"WITH {CELLS} SELECT a.array_id, a.row, a.col, round(sum(b.value * CASE WHEN a.pos = b.pos THEN 2 ELSE 1 END) / sum(CASE WHEN a.pos = b.pos THEN 2 ELSE 1 END), 6) AS value FROM cells a JOIN cells b ON a.array_id = b.array_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.array_id, a.row, a.col")
def w8(spark, d):
    return arrays.smooth_plane(cells(spark, d)).select("array_id", "row", "col", F.round("value", 6).alias("value"))


@query("W9_line_between_ends", f"WITH {CELLS} SELECT array_id, pos, round(first_value(value) OVER w + (last_value(value) OVER w - first_value(value) OVER w) * (pos - 10) / 20.0, 6) AS line FROM cells WHERE pos BETWEEN 10 AND 30 WINDOW w AS (PARTITION BY array_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def w9(spark, d):
    ends = cells(spark, d).where("pos between 10 and 30")
    whole = Window.partitionBy("array_id")
    a, b = F.max(F.when(F.col("pos") == 10, F.col("value"))).over(whole), F.max(F.when(F.col("pos") == 30, F.col("value"))).over(whole)
    return ends.select("array_id", "pos", F.round(a + (b - a) * (F.col("pos") - 10) / 20.0, 6).alias("line"))


@query("W10_bilinear", f"WITH {CELLS}, g AS (SELECT array_id, max(value) FILTER (row = 2 AND col = 3) AS a, max(value) FILTER (row = 2 AND col = 4) AS b, max(value) FILTER (row = 3 AND col = 3) AS c, max(value) FILTER (row = 3 AND col = 4) AS e FROM cells GROUP BY array_id) SELECT array_id, round(a * 0.75 * 0.5 + b * 0.75 * 0.5 + c * 0.25 * 0.5 + e * 0.25 * 0.5, 6) AS surface FROM g")
def w10(spark, d):
    points = read(spark, d, "embeddings", "vec_id").select(F.col("vec_id").alias("array_id"), F.lit(2.25).alias("y"), F.lit(3.5).alias("x"))
    return arrays.bilinear(cells(spark, d), points).select("array_id", F.round("surface", 6).alias("surface"))


SIZES = "sizes AS (SELECT vec_id AS array_id, CAST(CASE WHEN label % 2 = 0 THEN 8 ELSE 16 END AS INTEGER) AS cols, CAST(CASE WHEN label % 3 = 0 THEN 8 ELSE 4 END AS INTEGER) AS rows, CAST(CASE WHEN label % 5 = 0 THEN 1 ELSE 2 END AS INTEGER) AS width FROM embeddings)"


@query(
    "M7_map_similarity",
    f"""WITH {CELLS}, {SIZES}, d AS (SELECT array_id, value, value - lag(value) OVER (PARTITION BY array_id ORDER BY pos) AS delta FROM cells),
    e AS (SELECT array_id, min(value) AS l, max(value) AS h, min(delta) AS dl, max(delta) AS dh FROM d GROUP BY array_id),
    b AS (SELECT array_id, 0 AS kind, CAST(least(floor(coalesce((value - l) * 32 / nullif(h - l, 0), 0)), 31) AS INTEGER) AS bin FROM d JOIN e USING (array_id)
        UNION ALL SELECT array_id, 1, CAST(least(floor(coalesce((delta - dl) * 64 / nullif(dh - dl, 0), 0)), 63) AS INTEGER) FROM d JOIN e USING (array_id) WHERE delta IS NOT NULL),
    c AS (SELECT array_id, kind, bin, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY ALL),
    norms AS (SELECT array_id, kind, sum(n * n) AS nn FROM c GROUP BY ALL),
    dots AS (SELECT x.array_id, x.kind, sum(x.n * y.n) AS p FROM c x JOIN c y ON y.array_id = 1 AND x.kind = y.kind AND x.bin = y.bin WHERE x.array_id <> 1 GROUP BY ALL),
    parts AS (SELECT m.array_id, sum((CASE WHEN m.kind = 0 THEN 0.6 ELSE 0.4 END) * coalesce(p, 0) / sqrt(m.nn * o.nn)) AS s FROM norms m JOIN norms o ON o.array_id = 1 AND m.kind = o.kind LEFT JOIN dots q ON q.array_id = m.array_id AND q.kind = m.kind WHERE m.array_id <> 1 GROUP BY m.array_id),
    scored AS (SELECT CAST(1 AS BIGINT) AS "of", a.array_id, s * CASE CAST(a.cols = o.cols AS INTEGER) + CAST(a.rows = o.rows AS INTEGER) WHEN 2 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END * CASE WHEN a.width = o.width THEN 1.0 ELSE 0.85 END AS score FROM parts p JOIN sizes a ON a.array_id = p.array_id, sizes o WHERE o.array_id = 1)
    SELECT "of", array_id, round(score, 6) AS score FROM scored WHERE score >= 0.5 ORDER BY scored.score DESC, array_id LIMIT 20""",
)
def m7(spark, d):
    of = F.col("label")
    sizes = read(spark, d, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("array_id"), F.when(of % 2 == 0, 8).otherwise(16).alias("cols"), F.when(of % 3 == 0, 8).otherwise(4).alias("rows"), F.when(of % 5 == 0, 1).otherwise(2).alias("width"))
    prints = arrays.fingerprint(cells(spark, d)).join(sizes, "array_id")
    return arrays.similar_to(prints, F.col("array_id") == 1, 0.5, 20).withColumns(r6("score"))


@query("F1_value_search", f"WITH {CELLS} SELECT array_id, pos, round(value * 2 + 1, 6) AS found FROM cells WHERE abs(value * 2 + 1 - 1.25) <= 0.01")
def f1(spark, d):
    found = codec.linear(F.col("value"), 2.0, 1.0)
    return cells(spark, d).where(F.abs(found - 1.25) <= 0.01).select("array_id", "pos", F.round(found, 6).alias("found"))


@query("F7_maps_with_value", f"WITH {CELLS} SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT array_id FROM cells WHERE value BETWEEN 0.3 AND 0.4)")
def f7(spark, d):
    hits = cells(spark, d).where(F.col("value").between(0.3, 0.4)).select(F.col("array_id").alias("vec_id"))
    return read(spark, d, "embeddings", "vec_id").join(hits, "vec_id", "left_semi")


@query("E7_apply_deltas", f"WITH {RAW}, link AS (SELECT vec_id AS array_id, vec_id + 1 AS linked, 50 + vec_id % 50 AS confidence FROM embeddings) SELECT c.array_id, c.pos, c.raw + coalesce(b.raw - o.raw, 0) AS raw FROM raw_cells c LEFT JOIN link l ON l.array_id = c.array_id AND confidence >= 60 LEFT JOIN raw_cells b ON b.array_id = l.linked AND b.pos = c.pos LEFT JOIN raw_cells o ON o.array_id = l.linked + 1 AND o.pos = c.pos")
def e7(spark, d):
    link = read(spark, d, "embeddings", "vec_id").select(F.col("vec_id").alias("array_id"), (F.col("vec_id") + 1).alias("linked"), (50 + F.col("vec_id") % 50).alias("confidence")).where("confidence >= 60")
    tuned = raw_cells(spark, d).select(F.col("array_id").alias("linked"), "pos", F.col("raw").alias("tuned"))
    stock = raw_cells(spark, d).select((F.col("array_id") - 1).alias("linked"), "pos", F.col("raw").alias("stock"))
    deltas = link.join(tuned, "linked").join(stock, ["linked", "pos"]).select("array_id", "pos", (F.col("tuned") - F.col("stock")).alias("delta"))
    return raw_cells(spark, d).join(deltas, ["array_id", "pos"], "left").select("array_id", "pos", (F.col("raw") + F.coalesce("delta", F.lit(0))).alias("raw"))


@query("E9_patch", f"WITH {RAW}, patch AS (SELECT a.array_id, a.pos, a.raw AS before, b.raw AS after FROM raw_cells a JOIN raw_cells b ON b.array_id = a.array_id + 1 AND a.pos = b.pos WHERE a.raw < b.raw) SELECT c.array_id, count(p.pos) AS patched, count(*) FILTER (p.before <> c.raw) AS mismatched, CAST(sum(coalesce(p.after, c.raw)) AS BIGINT) AS total FROM raw_cells c LEFT JOIN patch p ON p.array_id = c.array_id AND p.pos = c.pos GROUP BY c.array_id")
def e9(spark, d):
    now = raw_cells(spark, d)
    after = now.select((F.col("array_id") - 1).alias("array_id"), "pos", F.col("raw").alias("after"))
    patch = now.join(after, ["array_id", "pos"]).where("raw < after").select("array_id", "pos", F.col("raw").alias("before"), "after")
    done = now.join(patch, ["array_id", "pos"], "left")
    return done.groupBy("array_id").agg(F.count("before").alias("patched"), F.count_if(F.col("before") != F.col("raw")).alias("mismatched"), F.sum(F.coalesce("after", "raw")).alias("total"))


@query("E12_apply_verdict", f"WITH {RAW}, v AS (SELECT folder, pos, avg(raw) AS mean FROM raw_cells GROUP BY folder, pos) SELECT c.array_id, c.pos, CAST(least(greatest(c.raw + round(v.mean), 0), 255) AS BIGINT) AS raw FROM raw_cells c JOIN v ON v.folder = c.folder AND v.pos = c.pos")
def e12(spark, d):
    now = raw_cells(spark, d)
    verdict = now.groupBy("folder", "pos").agg(F.avg("raw").alias("mean"))
    return now.join(verdict, ["folder", "pos"]).select("array_id", "pos", codec.encode(F.col("raw") + F.round("mean"), 1, False)["value"].alias("raw"))
