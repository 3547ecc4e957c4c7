"""Queries over found maps, gated consensus and algorithm matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detection
from .carriers import RAW, raw_cells, read
from .registry import query


@query("M9_likely_maps")
def m9(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", F.inline(detection.likely_maps(F.col("text").cast("binary"))))


GATED = f"WITH {RAW}, q AS (SELECT array_id, folder, pos, CAST(floor(raw / 200.0) AS BIGINT) AS v FROM raw_cells), v AS (SELECT a.folder, a.array_id AS voice, a.pos AS address, a.v AS before, b.v AS after FROM q a JOIN q b ON b.array_id = a.array_id + 1 AND b.pos = a.pos WHERE a.v <> b.v), base AS (SELECT folder, pos AS address, arg_min(v, array_id) AS value FROM q GROUP BY folder, pos), u AS (SELECT DISTINCT folder, address FROM v), s AS (SELECT *, CASE WHEN address - lag(address) OVER w <= 1 THEN NULL ELSE address END AS start FROM u WINDOW w AS (PARTITION BY folder ORDER BY address)), r AS (SELECT folder, address, last_value(start IGNORE NULLS) OVER (PARTITION BY folder ORDER BY address) AS region FROM s), p AS (SELECT v.*, r.region, base.value FROM v JOIN r USING (folder, address) JOIN base USING (folder, address)), f AS (SELECT folder, region, voice FROM p GROUP BY ALL HAVING avg(CAST(before = value AS DOUBLE)) >= 0.5)"


@query("M12_gated_consensus", f"{GATED} SELECT folder, address, region, count(*) AS voices, round(avg(after - before), 6) AS mean, round(stddev_pop(after - before), 6) AS deviation FROM p JOIN f USING (folder, region, voice) GROUP BY ALL")
def m12(spark, d):
    q = raw_cells(spark, d).select("array_id", "folder", F.col("pos").alias("address"), F.floor(F.col("raw") / 200).alias("v"))
    after = q.select((F.col("array_id") - 1).alias("array_id"), "address", F.col("v").alias("after"))
    voices = q.join(after, ["array_id", "address"]).where("v <> after").select("folder", F.col("array_id").alias("voice"), "address", F.col("v").alias("before"), "after")
    baseline = q.groupBy("folder", "address").agg(F.min_by("v", "array_id").alias("value"))
    found = detection.gated_consensus(voices, baseline, ["folder"], 1, 0.5)
    return found.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("M15_algorithm_match", "SELECT p_partkey, CAST(CASE WHEN contains(p_type, 'ECONOMY ME7 PROMO') THEN 100 ELSE 0 END + CASE WHEN contains(p_type, 'ECONOMY') THEN 21 ELSE 0 END + CASE WHEN contains(p_type, 'ME7') THEN 49 ELSE 0 END + CASE WHEN contains(p_type, 'PROMO') THEN 15 ELSE 0 END AS INTEGER) AS score FROM part")
def m15(spark, d):
    return read(spark, d, "part").select("p_partkey", detection.algorithm_score(F.col("p_type"), F.col("p_size"), "economy me7-promo").alias("score"))
