"""Byte images from Intel HEX, S-record and raw files, as rows (image_id, address, byte) and as one row an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files below a path: ``image_id, content``; the format is told by the first character that isn't blank."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    first = F.left(F.ltrim(F.decode(F.substring("content", 1, 64), "ISO-8859-1")), F.lit(1))
    return found.select(F.col("path").alias("image_id"), F.when(first == ":", "hex").when(first == "S", "srec").otherwise("raw").alias("format"), "content", "length", "modificationTime")


def _lines(images: DataFrame) -> DataFrame:
    text = F.decode("content", "ISO-8859-1")
    return images.select("image_id", F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


def _number(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def _bytes(lines: DataFrame) -> DataFrame:
    """Rows (image_id, address, byte) of lines (image_id, line_no, start, data); the last line to write an address wins."""
    each = F.posexplode(F.regexp_extract_all("data", F.lit("(..)"), F.lit(1)))
    out = lines.select("image_id", "line_no", "start", each.alias("k", "h"))
    return out.groupBy("image_id", (F.col("start") + F.col("k")).alias("address")).agg(F.max_by(_number(F.col("h")), F.col("line_no")).cast("int").alias("byte"))


def intel_hex(images: DataFrame) -> DataFrame:
    """Bytes of Intel HEX files: record types 00, 01, 02 and 04; checksums are not verified; an address is upper OR segment OR low."""
    r = _lines(images).where(F.col("line").startswith(":")).select("image_id", "line_no", _number(F.substring("line", 2, 2)).alias("n"), _number(F.substring("line", 4, 4)).alias("low"), F.substring("line", 8, 2).alias("kind"), "line")
    data = F.col("line").substr(F.lit(10), (F.col("n") * 2).cast("int"))
    order = Window.partitionBy("image_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    based = lambda kind, shift: F.coalesce(F.last(F.when(F.col("kind") == kind, F.shiftleft(_number(data), shift)), ignorenulls=True).over(order), F.lit(0).cast("long"))
    ended = F.max((F.col("kind") == "01").cast("int")).over(order)
    marked = r.select("*", based("04", 16).alias("upper"), based("02", 4).alias("segment"), ended.alias("ended")).where("kind = '00' and ended = 0")
    return _bytes(marked.select("image_id", "line_no", F.col("upper").bitwiseOR(F.col("segment")).bitwiseOR(F.col("low")).alias("start"), data.alias("data")))


def s_records(images: DataFrame) -> DataFrame:
    """Bytes of S-record files: S1, S2 and S3 data up to an S7, S8 or S9."""
    r = _lines(images).where(F.col("line").rlike("^S[0-9]")).withColumn("kind", F.substring("line", 2, 1))
    order = Window.partitionBy("image_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("ended", F.max(F.col("kind").isin("7", "8", "9").cast("int")).over(order)).where(F.col("kind").isin("1", "2", "3") & (F.col("ended") == 0))
    width = F.col("kind").cast("int") + 1
    size = _number(F.substring("line", 3, 2)).cast("int")
    return _bytes(r.select("image_id", "line_no", _number(F.col("line").substr(F.lit(5), width * 2)).alias("start"), F.col("line").substr(5 + width * 2, (size - width - 1) * 2).alias("data")))


def assemble(data: DataFrame) -> DataFrame:
    """One row an image: ``image_id, base_address, bytes``, gaps filled with 0xFF. An image is one row, as in its file.

    Its bytes are gathered once and gaps written between neighbours, so no address is joined.
    """
    held = data.where("address is not null").select("image_id", "address", F.lpad(F.hex(F.coalesce("byte", F.lit(255))), 2, "0").alias("h"))
    images = held.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("address", "h"))).alias("held"))
    gap = lambda s, k: s["address"] - F.get("held", k - 1)["address"] - 1
    filled = F.transform("held", lambda s, k: F.concat(F.repeat(F.lit("FF"), F.when(k > 0, gap(s, k)).otherwise(0).cast("int")), s["h"]))
    return images.select("image_id", F.get("held", F.lit(0))["address"].alias("base_address"), F.unhex(F.array_join(filled, "")).alias("bytes"))


def to_rows(images: DataFrame, data: str = "bytes", base: Column | int = 0) -> DataFrame:
    """Rows (image_id, address, byte) of whole images."""
    pairs = F.posexplode(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)))
    at = F.lit(base) if isinstance(base, int) else base
    return images.select("image_id", at.cast("long").alias("__base"), pairs.alias("k", "h")).select("image_id", (F.col("__base") + F.col("k")).alias("address"), _number(F.col("h")).cast("int").alias("byte"))
