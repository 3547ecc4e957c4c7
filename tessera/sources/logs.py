"""Log files with unknown encoding, delimiter and header, as samples in long form; map lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t")


def _text(content: str):
    """UTF-8 where it is valid, else Latin-1; without a byte order mark."""
    text = F.when(F.is_valid_utf8(F.col(content).cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def _unquoted(cell):
    """A cell without the quotes around it; a quote within them is written twice."""
    return F.when(cell.rlike('^".*"$'), F.replace(F.regexp_replace(cell, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(cell)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """``samples_of`` the files of a path; a log's id is its path."""
    return samples_of(spark.read.format("binaryFile").load(path).select(F.col("path").alias("log_id"), "content"))


def samples_of(files: DataFrame) -> DataFrame:
    """``log_id, row_idx, time_ms, channel, unit, value`` of files (log_id, content: binary).

    The delimiter is the one that the first line has most of. A header is either one
    line with ``timestamp`` and ``name (unit)``, or three lines (names with ``Time``,
    descriptions, units), whose times are seconds. A missing or bad cell is 0.
    """
    files = files.select("log_id", F.split(_text("content"), r"\r?\n").alias("lines"))
    count = lambda c: F.length(F.col("lines")[0]) - F.length(F.replace(F.col("lines")[0], F.lit(c), F.lit("")))
    best = F.array_max(F.array(*(F.struct(count(c).alias("n"), F.lit(-k).alias("rank"), F.lit(c).alias("c")) for k, c in enumerate(DELIMITERS))))["c"]
    rows = files.select("log_id", best.alias("d"), F.posexplode("lines").alias("no", "line")).where("trim(line) <> ''")
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'  # a delimiter within quotes doesn't count
    parts = F.when(F.col("d") == ",", F.split("line", "," + outside)).when(F.col("d") == ";", F.split("line", ";" + outside)).otherwise(F.split("line", "\t" + outside))
    cells = rows.select("log_id", "no", F.transform(parts, lambda x: _unquoted(F.trim(x))).alias("cells"))
    head = cells.where("no < 3").groupBy("log_id").agg(F.max(F.when(F.col("no") == 0, F.col("cells"))).alias("names"), F.max(F.when(F.col("no") == 2, F.col("cells"))).alias("units"))
    head = head.withColumn("three", ~F.exists("names", lambda x: F.lower(x).startswith("timestamp")))
    body = cells.join(head, "log_id").where(F.col("no") >= F.when(F.col("three"), 3).otherwise(1))
    time = F.coalesce(F.element_at(F.transform(F.filter(F.arrays_zip("names", "cells"), lambda z: F.lower(z["names"]).rlike("^time")), lambda z: z["cells"].try_cast("double")), 1), F.lit(0.0))
    long = body.select("log_id", F.col("no").alias("row_idx"), F.when(F.col("three"), time * 1000).otherwise(time).alias("time_ms"), "three", "units", "cells", F.posexplode("names").alias("k", "name")).where(~F.lower("name").rlike("^time"))
    channel = F.when(F.col("three"), F.col("name")).otherwise(F.trim(F.regexp_replace("name", r"\([^()]*\)\s*$", "")))
    unit = F.when(F.col("three"), F.get("units", "k")).otherwise(F.regexp_extract("name", r"\(([^()]*)\)\s*$", 1))
    return long.select("log_id", "row_idx", "time_ms", channel.alias("channel"), unit.alias("unit"), F.coalesce(F.get("cells", "k").try_cast("double"), F.lit(0.0)).alias("value"))


def map_list(spark: SparkSession, path: str) -> DataFrame:
    """``map_list_of`` the files of a path."""
    return map_list_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def map_list_of(files: DataFrame) -> DataFrame:
    """``path, address, name, size`` of files (path, content: binary), lists ``Address;Name;Size``: the last row of an address holds; repeated names get `` [$ADDRESS]``."""
    files = files.select("path", F.posexplode(F.split(_text("content"), r"\r?\n")).alias("no", "line"))
    p = F.split("line", ";")
    rows = files.where(F.col("line").rlike(r"^\s*(0x|\$)?[0-9A-Fa-f]+\s*;")).select("path", "no", F.conv(F.regexp_replace(F.trim(p[0]), r"^(0x|\$)", ""), 16, 10).cast("long").alias("address"), F.trim(p[1]).alias("name"), F.get(p, F.lit(2)).try_cast("int").alias("size"))
    last = rows.groupBy("path", "address").agg(F.max_by(F.struct("name", "size"), "no").alias("r")).select("path", "address", "r.name", "r.size")
    from pyspark.sql import Window

    twice = F.row_number().over(Window.partitionBy("path", "name").orderBy("address")) > 1
    return last.select("path", "address", F.when(twice, F.concat("name", F.lit(" [$"), F.hex("address"), F.lit("]"))).otherwise(F.col("name")).alias("name"), "size")
