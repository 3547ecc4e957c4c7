"""Queries that edit cells, bytes and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits
from .carriers import RAW, cells, next_cells, raw_cells, read
from .registry import query

#: The cells that the queries edit, and what two bytes with a sign hold.
CHOSEN = "pos BETWEEN 8 AND 40"
HELD = "CAST(least(greatest(round({}), -32768), 32767) AS BIGINT)"


def selected():
    return F.col("pos").between(8, 40)


def kept(frame):
    return frame.select("array_id", "pos", F.col("raw").cast("long").alias("raw"))


def sql(value: str, where: str = CHOSEN, source: str = "raw_cells") -> str:
    return f"WITH {RAW} SELECT array_id, pos, CASE WHEN {where} THEN {HELD.format(value)} ELSE raw END AS raw FROM {source}"


SIMPLE = {
    "E1_set": ("1234.0", lambda c: edits.edit(c, "set", 1234, selected())),
    "E1_add": ("raw + 40000.0", lambda c: edits.edit(c, "add", 40000, selected())),
    "E1_increment": ("raw + 7.0", lambda c: edits.edit(c, "add", 7, selected())),
    "E1_scale": ("raw * 1.5::DOUBLE", lambda c: edits.edit(c, "scale", 1.5, selected())),
    "E1_round_limit": ("least(greatest(round(raw / 25.0::DOUBLE) * 25, -150), 150)", lambda c: edits.round_limit(c, 25, -150, 150, selected())),
    "E1_flatten": (f"avg(raw) FILTER ({CHOSEN}) OVER (PARTITION BY array_id)", lambda c: edits.flatten(c, selected())),
    "E2_percent": ("raw * (1 + 20 / 100.0::DOUBLE)", lambda c: edits.edit(c, "percent", 20, selected())),
    "E2_delta": ("(raw * 0.5::DOUBLE + 10 + 5 - 10) / 0.5::DOUBLE", lambda c: edits.edit(c, "add", 5, selected(), scaling=(0.5, 10.0))),
    "E2_set": ("(25.0 - 10.0) / 0.5::DOUBLE", lambda c: edits.edit(c, "set", 25, selected(), scaling=(0.5, 10.0))),
    "E5_zero": ("(0 - 10.0) / 0.5::DOUBLE", lambda c: edits.edit(c, "zero", 0, selected(), scaling=(0.5, 10.0))),
    "E5_scale": ("((raw * 0.5::DOUBLE + 10) * 2 - 10) / 0.5::DOUBLE", lambda c: edits.edit(c, "scale", 2, selected(), scaling=(0.5, 10.0))),
    "E5_fill": ("(99.0 - 10.0) / 0.5::DOUBLE", lambda c: edits.edit(c, "set", 99, selected(), scaling=(0.5, 10.0))),
    "E5_offset": ("(raw * 0.5::DOUBLE + 10 - 3 - 10) / 0.5::DOUBLE", lambda c: edits.edit(c, "add", -3, selected(), scaling=(0.5, 10.0))),
    "E5_clamp": ("least(greatest(raw, -100), 100)", lambda c: edits.edit(edits.edit(c, "least", -100, selected()), "most", 100, selected())),
}
for _name, (_value, _edit) in SIMPLE.items():
    query(_name, sql(_value))(lambda spark, d, edit=_edit: kept(edit(raw_cells(spark, d))))


@query("E1_restore", f"WITH {RAW} SELECT c.array_id, c.pos, CASE WHEN c.{CHOSEN} THEN coalesce(o.raw, c.raw) ELSE c.raw END AS raw FROM raw_cells c LEFT JOIN raw_cells o ON o.array_id = c.array_id + 1 AND o.pos = c.pos")
def e1_restore(spark, d):
    original = next_cells(spark, d).withColumn("raw", F.round(F.col("value") * 1000).cast("long"))
    return kept(edits.restore(raw_cells(spark, d), original, selected()))


@query("E4_restore_map", f"WITH {RAW} SELECT c.array_id, c.pos, coalesce(o.raw, c.raw) AS raw FROM raw_cells c LEFT JOIN raw_cells o ON o.array_id = c.array_id + 1 AND o.pos = c.pos")
def e4_restore_map(spark, d):
    original = next_cells(spark, d).withColumn("raw", F.round(F.col("value") * 1000).cast("long"))
    return kept(edits.restore(raw_cells(spark, d), original))


@query("E4_restore_range", f"WITH {RAW} SELECT array_id, pos, CASE WHEN pos BETWEEN 8 AND 15 THEN raw ELSE {HELD.format('raw + 1')} END AS raw FROM raw_cells")
def e4_restore_range(spark, d):
    edited = edits.edit(raw_cells(spark, d), "add", 1)
    return kept(edits.restore(edited, raw_cells(spark, d), F.col("pos").between(8, 15)))


@query("W9_edit_line", f"WITH {RAW}, e AS (SELECT array_id, arg_min(raw, pos) AS a, arg_max(raw, pos) AS b FROM raw_cells WHERE {CHOSEN} GROUP BY array_id) SELECT c.array_id, pos, CASE WHEN {CHOSEN} THEN {HELD.format('a + (pos - 8) / 32.0::DOUBLE * (b - a)')} ELSE raw END AS raw FROM raw_cells c JOIN e USING (array_id)")
def w9_edit_line(spark, d):
    return kept(edits.line(raw_cells(spark, d), selected()))


@query(
    "W9_bilinear_block",
    f"""WITH {RAW}, k AS (SELECT array_id, max(raw) FILTER (row = 1 AND col = 2) AS a, max(raw) FILTER (row = 1 AND col = 6) AS b, max(raw) FILTER (row = 5 AND col = 2) AS c, max(raw) FILTER (row = 5 AND col = 6) AS e FROM raw_cells GROUP BY array_id),
    t AS (SELECT r.*, (row - 1) / 4.0::DOUBLE AS y, (col - 2) / 4.0::DOUBLE AS x, a, b, c, e FROM raw_cells r JOIN k USING (array_id))
    SELECT array_id, pos, CASE WHEN row BETWEEN 1 AND 5 AND col BETWEEN 2 AND 6 THEN {HELD.format('(a * (1 - x) + b * x) * (1 - y) + (c * (1 - x) + e * x) * y')} ELSE raw END AS raw FROM t""",
)
def w9_bilinear_block(spark, d):
    return kept(edits.corners(raw_cells(spark, d), (1, 5), (2, 6)))


@query("E5_set_values", f"WITH {RAW} SELECT c.array_id, c.pos, CASE WHEN o.value IS NULL THEN c.raw ELSE {HELD.format('o.value * 500')} END AS raw FROM raw_cells c LEFT JOIN cells o ON o.array_id = c.array_id + 1 AND o.pos = c.pos AND o.row = 3")
def e5_set_values(spark, d):
    values = next_cells(spark, d).where("row = 3").select("array_id", "pos", F.col("value") * 500)
    return kept(edits.replace_values(raw_cells(spark, d), values.toDF("array_id", "pos", "value")))


@query("E5_set_cell", f"WITH {RAW} SELECT array_id, pos, CASE WHEN pos = array_id % 64 THEN 77 ELSE raw END AS raw FROM raw_cells")
def e5_set_cell(spark, d):
    one = read(spark, d, "embeddings", "vec_id").select(F.col("vec_id").alias("array_id"), (F.col("vec_id") % 64).cast("int").alias("pos"), F.lit(77.0).alias("value"))
    return kept(edits.replace_values(raw_cells(spark, d), one))


@query("E5_set_axis", f"WITH {RAW} SELECT array_id, pos, CASE WHEN row = 0 THEN {HELD.format('(col * 12.5::DOUBLE - 10) / 0.5::DOUBLE')} ELSE raw END AS raw FROM raw_cells")
def e5_set_axis(spark, d):
    axis = cells(spark, d).where("row = 0").select("array_id", "pos", (F.col("col") * 12.5).alias("value"))
    return kept(edits.replace_values(raw_cells(spark, d), axis, scaling=(0.5, 10.0)))


@query("E5_copy", f"WITH {RAW} SELECT c.array_id, c.pos, CASE WHEN o.raw IS NULL THEN c.raw ELSE {HELD.format('o.raw')} END AS raw FROM raw_cells c LEFT JOIN raw_cells o ON o.array_id = c.array_id - 3 AND o.pos = c.pos")
def e5_copy(spark, d):
    pairs = read(spark, d, "embeddings", "vec_id").select(F.col("vec_id").alias("source"), (F.col("vec_id") + 3).alias("target"))
    return kept(edits.copy(raw_cells(spark, d), pairs))


@query("E5_write_bytes", "WITH b AS (SELECT p_partkey AS image_id, CAST(i - 1 AS BIGINT) AS address, CAST(ord(substr(p_name, i, 1)) AS INTEGER) AS byte FROM part, range(1, 200) t(i) WHERE i <= length(p_name)) SELECT image_id, address, CASE WHEN address = image_id % 9 THEN 255 ELSE byte END AS byte FROM b")
def e5_write_bytes(spark, d):
    from .image_queries import named

    patch = read(spark, d, "part", "p_partkey").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 9).alias("address"), F.lit(255).alias("byte"))
    data = named(spark, d).select("image_id", F.col("address").cast("long").alias("address"), F.col("byte").cast("int").alias("byte"))
    return edits.write_bytes(data, patch)


STEPS = "steps AS (SELECT vec_id AS array_id, CASE label % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'percent' ELSE 'add' END AS mode, CAST(label AS DOUBLE) AS argument FROM embeddings)"


def steps(spark, d):
    of = F.col("label") % 3
    return read(spark, d, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("array_id"), F.when(of == 0, "zero").when(of == 1, "percent").otherwise("add").alias("mode"), F.col("label").cast("double").alias("argument"))


@query("E6_batch_zero", f"WITH {RAW} SELECT array_id, pos, CAST(0 AS BIGINT) AS raw FROM raw_cells")
def e6_batch_zero(spark, d):
    return kept(edits.batch(raw_cells(spark, d), steps(spark, d).withColumn("mode", F.lit("zero"))))


@query("E6_batch_modify", f"WITH {RAW}, {STEPS} SELECT c.array_id, pos, {HELD.format('CASE mode WHEN ' + chr(39) + 'zero' + chr(39) + ' THEN 0 WHEN ' + chr(39) + 'percent' + chr(39) + ' THEN raw * (1 + argument / 100) ELSE raw + argument END')} AS raw FROM raw_cells c JOIN steps USING (array_id)")
def e6_batch_modify(spark, d):
    return kept(edits.batch(raw_cells(spark, d), steps(spark, d)))


@query("E6_batch_refused", f"WITH {RAW} SELECT array_id, pos, raw FROM raw_cells")
def e6_batch_refused(spark, d):
    bad = spark.createDataFrame([(-5, "zero", 0.0)], "array_id long, mode string, argument double")
    return kept(edits.batch(raw_cells(spark, d), steps(spark, d).unionAll(bad)))


#: Names, six times over, as images: the original, a version with every third byte raised by its place, and a target that has two bytes before it and every fifth byte lowered.
_BYTES = "SELECT p_partkey, CAST(i - 1 AS INTEGER) AS k, CAST(ord(substr(repeat(p_name, 6), i, 1)) AS INTEGER) AS o FROM part, range(1, 1000) t(i) WHERE i <= 6 * length(p_name)"
_NEW = {"absolute": "v", "relative": "(n + v - o) % 256", "percent": "CAST(floor(n * (v / greatest(o, 1)::DOUBLE)) AS INTEGER) % 256", "all original": "o", "all version": "v"}


def imported(spark, d, mode):
    from .image_queries import named

    name = F.repeat("p_name", 6)
    byte = lambda h: F.conv(h, 16, 10).cast("int")
    changed = lambda f: F.unhex(F.array_join(F.transform(F.regexp_extract_all(F.hex(name.cast("binary")), F.lit("(..)"), F.lit(1)), lambda h, k: F.lpad(F.hex(f(byte(h), k)), 2, "0")), ""))
    version = changed(lambda o, k: F.when(k % 3 == 0, o + k % 50).otherwise(o))
    current = F.concat(F.unhex(F.lit("0102")), changed(lambda o, k: F.when((k % 5 == 0) & (k >= 32), o - 1).otherwise(o)))
    images = read(spark, d, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("image_id"), name.cast("binary").alias("original"), version.alias("version"), current.alias("current"))
    done = edits.import_changes(images, mode)
    return done.select("image_id", F.hex("changed").alias("changed"))


for _mode, _sql in _NEW.items():
    _all = "TRUE" if _mode.startswith("all") else "v <> o"
    query(
        "E8_import_" + _mode.replace(" ", "_"),
        f"""WITH b AS ({_BYTES}), w AS (SELECT *, CASE WHEN k % 3 = 0 THEN o + k % 50 ELSE o END AS v, CASE WHEN k % 5 = 0 AND k >= 32 THEN o - 1 ELSE o END AS n FROM b),
        z AS (SELECT p_partkey, string_agg(printf('%02X', CASE WHEN {_all} THEN {_sql} ELSE n END), '' ORDER BY k) AS h, max(k) + 1 AS size FROM w GROUP BY p_partkey)
        SELECT p_partkey AS image_id, '0102' || h AS changed FROM z""",
    )(lambda spark, d, mode=_mode: imported(spark, d, mode))


@query("E13_last_write", "SELECT l_suppkey AS image_id, l_partkey AS off, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS after FROM lineitem GROUP BY ALL")
def e13(spark, d):
    log = read(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_orderkey", "l_linenumber")
    return edits.state(log.select(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("off"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("after")))


_LOG = "hist AS (SELECT o_custkey AS image_id, o_orderkey AS seq, CASE o_orderpriority WHEN '2-HIGH' THEN 'undo' WHEN '3-MEDIUM' THEN 'redo' ELSE 'edit' END AS action, o_orderkey % 7 AS off, o_totalprice AS after FROM orders)"


def history(spark, d):
    action = F.when(F.col("o_orderpriority") == "2-HIGH", "undo").when(F.col("o_orderpriority") == "3-MEDIUM", "redo").otherwise("edit")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("seq"), action.alias("action"), (F.col("o_orderkey") % 7).alias("off"), F.lit(0.0).alias("before"), F.col("o_totalprice").alias("after"))


@query(
    "E13_undo_redo",
    f"""WITH RECURSIVE {_LOG}, steps AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq) AS n FROM hist),
    walk(image_id, n, done, undone) AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM hist UNION ALL
        SELECT w.image_id, s.n,
            CASE WHEN action = 'edit' THEN list_append(done, seq) WHEN action = 'undo' AND len(done) > 0 THEN done[1:len(done) - 1] WHEN action = 'redo' AND len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END,
            CASE WHEN action = 'edit' THEN [] WHEN action = 'undo' AND len(done) > 0 THEN list_append(undone, done[len(done)]) WHEN action = 'redo' AND len(undone) > 0 THEN undone[1:len(undone) - 1] ELSE undone END
        FROM walk w JOIN steps s ON s.image_id = w.image_id AND s.n = w.n + 1),
    ends AS (SELECT image_id, arg_max(done, n) AS done FROM walk GROUP BY image_id), live AS (SELECT image_id, unnest(done) AS seq FROM ends)
    SELECT image_id, off, arg_max(after, seq) AS after FROM live JOIN hist USING (image_id, seq) GROUP BY ALL""",
)
def e13_undo_redo(spark, d):
    return edits.state(edits.live_edits(history(spark, d)))


@query(
    "E13_savepoints",
    f"WITH {_LOG}, e AS (SELECT * FROM hist WHERE action = 'edit'), p AS (SELECT image_id, off, coalesce(arg_max(after, seq) FILTER (seq <= 5000), 0.0) AS before, coalesce(arg_max(after, seq) FILTER (seq <= 10000), 0.0) AS after FROM e GROUP BY ALL) SELECT * FROM p WHERE before <> after",
)
def e13_savepoints(spark, d):
    return edits.between_states(history(spark, d).where("action = 'edit'"), 5000, 10000)
