"""Ordered operators: islands, pulls, intervals, nearest and as-of joins, downsampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(frame: DataFrame, keys: list[str], order: str, gap: int = 1) -> DataFrame:
    """Runs of places at most ``gap`` apart: ``keys, first, last, n``."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = frame.withColumn("__new", F.coalesce((F.col(order) - F.lag(order).over(by) > gap).cast("int"), F.lit(1)))
    numbered = marked.withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("__run")


def rises(frame: DataFrame, keys: list[str], order: list[str], value: str, holds: Column, least_rise: float, least_time: float, time: str) -> DataFrame:
    """Longest stretches where ``value`` does not fall and ``holds`` is true, with enough rise and time.

    The time is taken to the sample that breaks the stretch, if there is one.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    on = frame.withColumn("__on", F.coalesce(holds & (F.col(value) >= F.lag(value).over(by)), F.lit(False)))
    marked = on.withColumn("__break", F.when(F.col("__on"), 0).otherwise(1)).withColumn("__after", F.lead(time).over(by))
    run = marked.withColumn("__run", F.sum("__break").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("__on")
    found = run.groupBy(*keys, "__run").agg(F.min(time).alias("begin_at"), F.max(time).alias("end_at"), F.max_by("__after", F.col(time)).alias("after"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).drop("__run")
    return found.where((F.col("high") - F.col("low") >= least_rise) & (F.coalesce("after", "end_at") - F.col("begin_at") >= least_time)).drop("after")


#: Bucket widths of intervals, as powers of this number.
LEVEL = 8


def _by_level(spans: DataFrame, begin: str, end: str) -> DataFrame:
    """Intervals with the level and the buckets, at most ``LEVEL`` + 1 of them, that they touch at the level of their length."""
    size = F.greatest(F.col(end) - F.col(begin), F.lit(1)).cast("double")
    level = F.greatest(F.ceil(F.log(size) / math.log(LEVEL)) - 1, F.lit(0)).cast("int")
    wide = F.pow(F.lit(float(LEVEL)), F.col("__level")).cast("long")
    return spans.where(F.col(begin) <= F.col(end)).withColumn("__level", level).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(begin) / wide), F.floor(F.col(end) / wide))))


def _at_levels(points: DataFrame, at: str, placed: DataFrame) -> DataFrame:
    """Points with their bucket at each level that an interval has."""
    levels = placed.agg(F.coalesce(F.array_sort(F.collect_set("__level")), F.array().cast("array<int>"))).scalar()  # some 20 levels
    wide = F.pow(F.lit(float(LEVEL)), F.col("__level")).cast("long")
    return points.withColumn("__level", F.explode(levels)).withColumn("__bucket", F.floor(F.col(at) / wide))


def in_intervals(points: DataFrame, at: str, spans: DataFrame, begin: str, end: str, keys: list[str] = ()) -> DataFrame:
    """Points joined to the intervals that hold them (both ends included), of equal ``keys`` if any are given.

    An interval enters the few buckets that it touches at the level of its length, and a
    point one bucket a level, so the join is on equality whatever the lengths; the exact
    condition is checked after. Null ends and places, and intervals that end before they
    begin, match nothing; repeated rows match as often as they occur.
    """
    placed = _by_level(spans, begin, end)
    held = _at_levels(points, at, placed).join(placed, [*keys, "__level", "__bucket"])
    return held.where(F.col(at).between(F.col(begin), F.col(end))).drop("__bucket", "__level")


def outside_intervals(points: DataFrame, at: str, spans: DataFrame, begin: str, end: str) -> DataFrame:
    """Points in none of the intervals; a point with a null place is in none."""
    places = points.select(at).where(F.col(at).isNotNull()).distinct()
    inside = in_intervals(places, at, spans.select(F.col(begin).alias("__b"), F.col(end).alias("__e")), "__b", "__e").select(F.col(at).alias("__in")).distinct()
    return points.join(inside, F.col(at) == F.col("__in"), "left_anti")


def nearest_marks(points: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Each point with the marks at or before and after it, and their line's value there: an as-of join by one sort."""
    both = points.withColumn("__value", F.lit(None).cast("double")).withColumn("__mark", F.lit(False)).unionByName(marks.select(*keys, at, F.col(value).alias("__value"), F.lit(True).alias("__mark")), allowMissingColumns=True)
    mark = F.when(F.col("__mark"), F.struct(F.col(at).alias("t"), F.col("__value").alias("v")))
    order = Window.partitionBy(*keys).orderBy(F.col(at), F.desc("__mark"), F.col("__value"))
    before = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = both.withColumn("__before", before).withColumn("__after", after).where("not __mark")
    share = F.try_divide(F.col(at) - F.col("__before.t"), F.col("__after.t") - F.col("__before.t"))
    line = F.col("__before.v") + share * (F.col("__after.v") - F.col("__before.v"))
    return found.select(*points.columns, F.col("__before.v").alias("before"), F.col("__after.v").alias("after"), F.coalesce(line, F.col("__before.v"), F.col("__after.v")).alias("midway"))


def neighbours(frame: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each place with the next and the previous one, going round at the ends."""
    by, whole = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys)
    return frame.select(*keys, at, F.coalesce(F.lead(at).over(by), F.min(at).over(whole)).alias("next"), F.coalesce(F.lag(at).over(by), F.max(at).over(whole)).alias("previous"))


def envelope(frame: DataFrame, keys: list[str], bucket: Column, time: str, value: str) -> DataFrame:
    """Least and greatest value of each bucket and when they first occur."""
    return frame.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.min_by(time, F.struct(value, time)).alias("low_at"), F.max_by(time, F.struct(F.col(value), -F.col(time))).alias("high_at"))


def newest_wins(spans: DataFrame, key: str) -> DataFrame:
    """Non-overlapping spans (key, begin, end, seq), ends excluded, whole numbers: where several overlap, the highest ``seq`` holds.

    Pieces between all begins and ends are joined to the spans that hold them; neighbouring
    pieces of one ``seq`` are one. Empty spans and nulls give nothing.
    """
    whole = spans.select(key, *(F.col(c).cast("long").alias(c) for c in ("begin", "end", "seq"))).where("begin < end")
    points = whole.select(key, F.explode(F.array("begin", "end")).alias("from")).distinct()
    order = Window.partitionBy(key).orderBy("from")
    pieces = points.withColumn("till", F.lead("from").over(order)).where("till is not null")
    held = in_intervals(pieces, "from", whole.select(key, "begin", (F.col("end") - 1).alias("last"), "seq"), "begin", "last", [key])
    best = held.groupBy(key, "from", "till").agg(F.max("seq").alias("seq"))
    new = ~((F.lag("till").over(order) == F.col("from")) & (F.lag("seq").over(order) == F.col("seq")))
    marked = best.withColumn("run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.min("from").alias("begin"), F.max("till").alias("end"), F.first("seq").alias("seq")).drop("run")


def loaded(load: Column, throttle: Column, keys: list[str], share: float = 0.85, open_from: float = 95.0) -> Column:
    """Whether a sample is under load: from ``share`` of its log's greatest load; without any load in the log by the throttle; without either always."""
    whole = Window.partitionBy(*keys)
    most, any_throttle = F.max(load).over(whole), F.max(throttle).over(whole)
    return F.when(most.isNotNull(), F.coalesce(load >= share * most, F.lit(False))).when(any_throttle.isNotNull(), F.coalesce(throttle >= open_from, F.lit(False))).otherwise(True)


def longest_rise(found: DataFrame, keys: list[str]) -> DataFrame:
    """Each log's longest of ``rises``, the first one on ties: a window over a log's few rises."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("end_at") - F.col("begin_at")), "begin_at")
    return found.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def rise_metrics(frame: DataFrame, found: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Seven metrics of one rise a log, unpivoted to ``keys, metric, v``: peak, low, mean, spread, seconds to the first peak and to the end, samples."""
    held = frame.join(found.select(*keys, "begin_at", "end_at"), keys).where(F.col(time).between(F.col("begin_at"), F.col("end_at")))
    v = F.col(value)
    stats = held.groupBy(*keys).agg(
        F.max(v).alias("peak"), F.min(v).alias("low"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("spread"), ((F.min_by(time, F.struct(-v, time)) - F.min("begin_at")) / 1000.0).alias("peak_after"), ((F.max("end_at") - F.min("begin_at")) / 1000.0).alias("duration"), F.count("*").cast("double").alias("samples")
    )
    return stats.unpivot(keys, ["peak", "low", "mean", "spread", "peak_after", "duration", "samples"], "metric", "v")
