"""Text files beside a log: trouble codes, identification, profile. Each takes ``file_id, text``, a file a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"\s{2,}"


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.posexplode(F.split("text", r"\r?\n")).alias("no", "line"))


def _two(line: Column) -> tuple[Column, Column]:
    """What stands before and after the first gap of two blanks; the latter null without a gap."""
    parts = F.split(F.trim(line), GAP, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def trouble_codes(files: DataFrame) -> DataFrame:
    """``file_id, no, code, description, obd_code, label, bits, flags``: one row a section between blank lines.

    The first line is the code and what it means, the second the standard code and its
    label, the others a mask of eight bits and flags. The heading with the count and
    sections without any code are left out.
    """
    sections = files.select("file_id", F.posexplode(F.split(F.regexp_replace("text", r"\r", ""), r"\n\s*\n\s*")).alias("no", "section"))
    lines = F.filter(F.split("section", "\n"), lambda x: F.trim(x) != "")
    s = sections.select("file_id", "no", lines.alias("lines")).where((F.size("lines") > 0) & ~F.get("lines", F.lit(0)).rlike(r"(?i)^\s*\d+\s+DTC\s+entr"))
    (code, text), (obd, label) = _two(F.get("lines", F.lit(0))), _two(F.get("lines", F.lit(1)))
    rest = F.transform(F.slice("lines", 3, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.trim(x))
    mask = lambda x: x.rlike(r"^[01]{8}(\s{2,}|$)")
    bits = F.substring(F.get(F.filter(rest, mask), F.lit(0)), 1, 8)
    flags = F.filter(F.transform(rest, lambda x: F.when(mask(x), F.regexp_replace(x, r"^[01]{8}\s*", "")).otherwise(x)), lambda x: x != "")
    return s.select("file_id", "no", code.alias("code"), text.alias("description"), obd.alias("obd_code"), label.alias("label"), bits.alias("bits"), flags.alias("flags"))


def identification(files: DataFrame) -> DataFrame:
    """``file_id, vin, fields``: pairs ``key: value`` after an optional time; the first without a key is the number of the vehicle, the last of a key holds."""
    line = F.trim(F.regexp_replace("line", r"^\[\d{2}:\d{2}:\d{2}\]\s*", ""))
    rows = _lines(files).withColumn("line", line).where(F.contains("line", F.lit(":")))
    rows = rows.select("file_id", "no", F.trim(F.substring_index("line", ":", 1)).alias("key"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    last = rows.groupBy("file_id", "key").agg(F.max_by("value", "no").alias("last"), F.min_by("value", F.when(F.col("value") != "", F.col("no"))).alias("first"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("key") != "", F.struct("key", "last")))))
    return last.groupBy("file_id").agg(F.max(F.when(F.col("key") == "", F.col("first"))).alias("vin"), pairs.alias("fields"))


def profile(files: DataFrame) -> DataFrame:
    """``file_id, no, channel``: the text before the first semicolon of each line that isn't blank."""
    return _lines(files).where(F.trim("line") != "").select("file_id", "no", F.trim(F.when(F.trim("line").startswith(";"), F.col("line")).otherwise(F.substring_index("line", ";", 1))).alias("channel"))
