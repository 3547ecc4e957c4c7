"""Queries over aligned images: arrays beside their next ones, whose second half stands eight cells earlier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment
from .carriers import RAW, raw_cells, read
from .registry import query

_ALIGNED = f"""{RAW}, regions AS (SELECT vec_id AS image_id, b AS "begin", n AS length, s AS shift FROM embeddings, (VALUES (0, 24, 0), (32, 32, -8)) v(b, n, s)),
    aligned AS (SELECT r.image_id, r."begin", a.pos AS address, a.raw AS value, b.raw AS other FROM regions r JOIN raw_cells a ON a.array_id = r.image_id AND a.pos BETWEEN r."begin" AND r."begin" + r.length - 1 JOIN raw_cells b ON b.array_id = r.image_id + 1 AND b.pos = a.pos + r.shift)"""


def image(spark, d, shift=0):
    return raw_cells(spark, d).select((F.col("array_id") - shift).alias("image_id"), F.col("pos").cast("long").alias("address"), F.col("raw").alias("value"))


def regions(spark, d, parts=((0, 24, 0), (32, 32, -8))):
    each = F.explode(F.array(*(F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip(("begin", "length", "shift"), p, strict=True))) for p in parts))).alias("r")
    return read(spark, d, "embeddings", "vec_id").select(F.col("vec_id").alias("image_id"), each).select("image_id", "r.*")


def pair(spark, d):
    return alignment.aligned(image(spark, d), image(spark, d, 1), regions(spark, d))


@query("M5_region_match", f"WITH {_ALIGNED} SELECT image_id, \"begin\", round(100 * avg(CAST(trunc(value / 100.0) = trunc(other / 100.0) AS DOUBLE)), 6) AS percent, count(*) AS addresses FROM aligned GROUP BY ALL")
def m5(spark, d):
    hundred = lambda c: F.expr(f"{c} div 100")
    found = alignment.region_match(pair(spark, d), hundred("value") == hundred("other"))
    return found.withColumn("percent", F.round("percent", 6))


@query("M18_aligned_diff", f"WITH {_ALIGNED} SELECT image_id, \"begin\", address, value, other, CASE WHEN other > value THEN 'up' ELSE 'down' END AS sign FROM aligned WHERE value <> other")
def m18(spark, d):
    return alignment.differences(pair(spark, d))


@query(
    "E11_aligned_copy",
    f"""WITH {_ALIGNED}, new AS (SELECT image_id, address + 4 AS address, max(other) AS value FROM aligned WHERE value <> other AND abs(other - value) >= 150 AND address BETWEEN 0 AND 49 GROUP BY ALL)
    SELECT c.array_id AS image_id, c.pos AS address, coalesce(n.value, c.raw) AS value FROM (SELECT array_id - 2 AS array_id, pos, raw FROM raw_cells) c LEFT JOIN new n ON n.image_id = c.array_id AND n.address = c.pos""",
)
def e11(spark, d):
    chosen = F.abs(F.col("other") - F.col("value")) >= 150
    return alignment.copy_differences(image(spark, d, 2), image(spark, d), image(spark, d, 1), regions(spark, d), regions(spark, d, ((0, 50, 4),)), chosen)
