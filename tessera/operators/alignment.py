"""Two images compared and copied over the stretches at which they are aligned.

Images are rows (image_id, address, value); ``regions`` are (image_id, begin, length, shift):
what stands at an address of the first image from ``begin`` on stands ``shift`` further in
the second. Addresses in several regions are compared once a region; those in none, and
those that the second image hasn't got, not at all. Nulls never align.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import in_intervals


def aligned(left: DataFrame, right: DataFrame, regions: DataFrame) -> DataFrame:
    """``image_id, begin, address, value, other``: each address of a region with both images' values."""
    spans = regions.where("length > 0").select("image_id", "begin", (F.col("begin") + F.col("length") - 1).alias("last"), "shift")
    placed = in_intervals(left.select("image_id", "address", "value"), "address", spans, "begin", "last", ["image_id"])
    other = right.select("image_id", F.col("address").alias("there"), F.col("value").alias("other"))
    return placed.withColumn("there", F.col("address") + F.col("shift")).join(other, ["image_id", "there"]).select("image_id", "begin", "address", "value", "other")


def region_match(compared: DataFrame, equal: Column) -> DataFrame:
    """The share of each region's aligned addresses, in percent, that are equal; null conditions count as unequal."""
    return compared.groupBy("image_id", "begin").agg((100 * F.avg(F.coalesce(equal, F.lit(False)).cast("double"))).alias("percent"), F.count("*").alias("addresses"))


def differences(compared: DataFrame) -> DataFrame:
    """Aligned addresses whose values differ, with ``sign``: up where the second is larger, else down."""
    return compared.where("value <> other").withColumn("sign", F.when(F.col("other") > F.col("value"), "up").otherwise("down"))


def copy_differences(target: DataFrame, first: DataFrame, second: DataFrame, regions: DataFrame, to_target: DataFrame, chosen: Column) -> DataFrame:
    """``target`` with the second image's values where the aligned first and second differ and ``chosen`` holds.

    ``regions`` align the first with the second, ``to_target`` the first with the target;
    both apply to the first image's addresses. Of several values for an address the
    greatest holds.
    """
    new = differences(aligned(first, second, regions)).where(F.coalesce(chosen, F.lit(False))).select("image_id", "address", F.col("other").alias("value"))
    spans = to_target.where("length > 0").select("image_id", "begin", (F.col("begin") + F.col("length") - 1).alias("last"), "shift")
    moved = in_intervals(new, "address", spans, "begin", "last", ["image_id"]).groupBy("image_id", (F.col("address") + F.col("shift")).alias("address")).agg(F.max("value").alias("__new"))
    return target.join(moved, ["image_id", "address"], "left").select("image_id", "address", F.coalesce("__new", "value").alias("value"))
