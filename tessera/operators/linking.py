"""Where the maps of one image lie in another: content, axes, and the shift of their neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

SAMPLE_BYTES = 64
AXIS_BYTES = 32
AGREE = 256


def locate(source: Column, target: Column, spans: Column, least: int, most: int) -> Column:
    """First place in ``target`` of each span (begin, length) of ``source``, of at most ``most`` bytes.

    Null for a span shorter than ``least``, beyond the source's end or not found.
    """

    @F.pandas_udf("array<long>")
    def run(sources: pd.Series, targets: pd.Series, wanted: pd.Series) -> pd.Series:
        def places(a, b, rows):
            if a is None or b is None or rows is None:
                return None
            out = []
            for r in rows:
                begin, size = (-1 if x is None or x != x else int(x) for x in (r["begin"], r["length"]))  # a null may be a NaN here
                size = min(size, most)
                at = b.find(a[begin : begin + size]) if size >= least and 0 <= begin <= len(a) - size else -1
                out.append(at if at >= 0 else None)
            return out

        return pd.Series([places(*r) for r in zip(sources, targets, wanted)], dtype=object)

    ship_package(SparkSession.active())
    return run(source, target, spans)


def near_anchors(maps: DataFrame, keys: list[str], at: str, shift: str) -> DataFrame:
    """Each row with the nearest anchors, rows whose ``shift`` isn't null: ``below`` it, and at it or ``above``.

    Structs of (at, shift), by two running windows over one order.
    """
    anchor = F.when(F.col(shift).isNotNull(), F.struct(F.col(at).alias("at"), F.col(shift).alias("shift")))
    up = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, 0)
    return maps.withColumns({"below": F.last(anchor, ignorenulls=True).over(up), "above": F.last(anchor, ignorenulls=True).over(down)})


def blend(found: DataFrame, at: str, usual: Column) -> DataFrame:
    """``guess`` and ``guess_confidence`` from ``below`` and ``above``.

    Shifts that agree within 256 give their mean (60), others the nearer one's, the lower
    at a tie (40); a single anchor gives its own (50); without any it is ``usual`` (40).
    """
    low, high = F.col("below.shift"), F.col("above.shift")
    both = low.isNotNull() & high.isNotNull()
    agree = both & (F.abs(low - high) <= AGREE)
    nearer = F.when(F.col(at) - F.col("below.at") <= F.col("above.at") - F.col(at), low).otherwise(high)
    guess = F.when(agree, ((low + high) / 2).cast("long")).when(both, nearer).otherwise(F.coalesce(low, high, usual))
    sure = F.when(agree, 60).when(both, 40).when(low.isNotNull() | high.isNotNull(), 50).otherwise(40)
    return found.withColumns({"guess": guess, "guess_confidence": sure})


def link(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """Maps of each pair's source found in its target: ``pair_id, name, address, linked, status, confidence``.

    ``pairs``: pair_id, source_id, source, target (binary). ``maps``: source_id, name,
    address, data_offset, length, axis_address, axis_length, columns (nulls where a map
    has no axis of its own). Confidence is 100 for content at the same place, 95
    elsewhere, 75 by an inline axis whose count fits, 60, 50 or 40 by neighbours; an
    address outside the target is ``not found`` (0, null). A pair is one row with the
    list of its source's maps, which is as large as one definition file.
    """
    listed = maps.groupBy("source_id").agg(F.collect_list(F.struct("name", "address", "data_offset", "length", "axis_address", "axis_length", "columns")).alias("maps"))
    body = F.transform("maps", lambda m: F.struct((m.address + m.data_offset).cast("long").alias("begin"), m.length.cast("long").alias("length")))
    axis = F.transform("maps", lambda m: F.struct(m.axis_address.cast("long").alias("begin"), m.axis_length.cast("long").alias("length")))
    placed = pairs.join(listed, "source_id").withColumns({"cells_at": locate(F.col("source"), F.col("target"), body, 2, SAMPLE_BYTES), "axis_at": locate(F.col("source"), F.col("target"), axis, 4, AXIS_BYTES)})
    # the two count bytes before an axis, read here so that the images go no further
    heads = F.transform(F.arrays_zip("maps", "axis_at"), lambda z: F.conv(F.hex(F.substring(F.col("target"), (z.axis_at - z.maps.axis_address + z.maps.address + 1).cast("int"), F.lit(2))), 16, 10).cast("int"))
    # the images end here, below the generator, or each exploded row would carry them
    listed = placed.select("pair_id", F.length("target").alias("size"), F.arrays_zip("maps", "cells_at", "axis_at", heads.alias("head")).alias("found"))
    rows = listed.select("pair_id", "size", F.explode("found").alias("z"))
    rows = rows.select("pair_id", "size", "z.maps.*", F.when(F.col("z.cells_at").isNotNull(), F.greatest(F.col("z.cells_at") - F.col("z.maps.data_offset"), F.lit(0))).alias("exact"), (F.col("z.axis_at") - F.col("z.maps.axis_address") + F.col("z.maps.address")).alias("start"), "z.head")
    inside = (F.col("data_offset") > 0) & (F.col("start") >= 0) & (F.col("start") + F.col("data_offset") + F.col("length") <= F.col("size"))
    counted = (F.col("axis_address") - F.col("address") < 2) | (F.col("head") == F.col("columns"))
    rows = rows.withColumn("by_axis", F.when(F.col("exact").isNull() & inside & counted, F.col("start")))
    rows = rows.withColumn("shift", F.coalesce("exact", "by_axis") - F.col("address"))
    votes = rows.where("exact IS NOT NULL").groupBy("pair_id", (F.col("exact") - F.col("address")).alias("usual")).agg(F.count("*").alias("n"))
    usual = votes.groupBy("pair_id").agg(F.max_by("usual", F.struct("n", -F.col("usual"))).alias("usual"))
    found = blend(near_anchors(rows.join(usual, "pair_id", "left"), ["pair_id"], "address", "shift"), "address", F.coalesce("usual", F.lit(0)))
    guessed = F.col("address") + F.col("guess")
    guessed = F.when((guessed >= 0) & (guessed < F.col("size")), guessed)
    linked = F.coalesce("exact", "by_axis", guessed)
    status = F.when(F.col("exact").isNotNull(), "exact").when(linked.isNotNull(), "fuzzy").otherwise("not found")
    sure = F.when(F.col("exact") == F.col("address"), 100).when(F.col("exact").isNotNull(), 95).when(F.col("by_axis").isNotNull(), 75).when(guessed.isNotNull(), F.col("guess_confidence")).otherwise(0)
    return found.select("pair_id", "name", "address", linked.alias("linked"), status.alias("status"), sure.alias("confidence"))
