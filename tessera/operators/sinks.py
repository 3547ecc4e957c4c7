"""Text forms of images, maps and patches, as DataFrames to write with Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intel_hex_lines(data: DataFrame) -> DataFrame:
    """Lines (image_id, line_no, line) of rows (image_id, address, byte): 16 bytes a record, broken at gaps, type 04 where the upper half changes."""
    order = Window.partitionBy("image_id").orderBy("address")
    run = data.withColumn("gap", F.when(F.col("address") - F.lag("address").over(order) == 1, 0).otherwise(1)).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    record = run.groupBy("image_id", F.floor(F.col("address") / 16).alias("row"), "run").agg(F.min("address").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("address", F.lpad(F.hex("byte"), 2, "0").alias("h")))), lambda s: s["h"]), "").alias("data"))
    upper = F.shiftright("start", 16)
    by = Window.partitionBy("image_id").orderBy("start")
    body = record.withColumn("extend", (upper != F.coalesce(F.lag(upper).over(by), F.lit(0))))
    pad = lambda value, n: F.lpad(F.hex(value), n, "0")
    lines = F.array_compact(F.array(F.when(F.col("extend"), F.concat(F.lit("02000004"), pad(upper, 4))), F.concat(pad((F.length("data") / 2).cast("long"), 2), pad(F.col("start").bitwiseAND(F.lit(65535)), 4), F.lit("00"), F.col("data"))))
    out = body.select("image_id", "start", F.posexplode(lines).alias("k", "body"))
    ends = data.select("image_id").distinct().select("image_id", F.lit((1 << 62)).alias("start"), F.lit(0).alias("k"), F.lit("00000001").alias("body"))
    total = F.aggregate(F.regexp_extract_all("body", F.lit("(..)"), F.lit(1)), F.lit(0).cast("long"), lambda s, h: s + F.conv(h, 16, 10).cast("long"))
    line = F.concat(F.lit(":"), F.col("body"), pad(F.pmod(256 - total % 256, F.lit(256)), 2))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("start", "k"))
    return out.unionByName(ends).select("image_id", number.alias("line_no"), line.alias("line"))


def map_rows(cells: DataFrame) -> DataFrame:
    """Per array: statistics and the nested values, row by row, for JSON."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
    return cells.groupBy("array_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), (F.max("col") + 1).alias("columns"), row.alias("values"))


def patch_runs(compared: DataFrame) -> DataFrame:
    """Changed bytes (image_id, address, before, after) as runs with their bytes in hexadecimal."""
    order = Window.partitionBy("image_id").orderBy("address")
    run = compared.where("before <> after").withColumn("gap", F.when(F.col("address") - F.lag("address").over(order) == 1, 0).otherwise(1)).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("address", F.lpad(F.hex(c), 2, "0").alias("h")))), lambda s: s["h"]), "")
    return run.groupBy("image_id", "run").agg(F.min("address").alias("address"), F.count("*").alias("length"), text("before").alias("before"), text("after").alias("after")).drop("run")


def s_record_lines(data: DataFrame) -> DataFrame:
    """S-records (image_id, line_no, line) of rows (image_id, address, byte): a header, records of up to 16 bytes with four-byte addresses, broken at gaps, and an end."""
    order = Window.partitionBy("image_id").orderBy("address")
    run = data.withColumn("gap", F.when(F.col("address") - F.lag("address").over(order) == 1, 0).otherwise(1)).withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("address", F.lpad(F.hex("byte"), 2, "0").alias("h")))), lambda s: s["h"]), "")
    record = run.groupBy("image_id", F.floor(F.col("address") / 16).alias("row"), "run").agg(F.min("address").alias("start"), joined.alias("data"))
    pad = lambda value, n: F.lpad(F.hex(value), n, "0")
    body = record.select("image_id", "start", F.lit("3").alias("kind"), F.concat(pad((F.length("data") / 2 + 5).cast("long"), 2), pad(F.col("start"), 8), F.col("data")).alias("body"))
    images = data.select("image_id").distinct()
    ends = images.select("image_id", F.lit(-1).cast("long").alias("start"), F.lit("0").alias("kind"), F.lit("030000").alias("body")).unionAll(images.select("image_id", F.lit(1 << 62), F.lit("7"), F.lit("0500000000")))
    total = F.aggregate(F.regexp_extract_all("body", F.lit("(..)"), F.lit(1)), F.lit(0).cast("long"), lambda s, h: s + F.conv(h, 16, 10).cast("long"))
    line = F.concat(F.lit("S"), "kind", "body", pad(255 - total % 256, 2))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("start"))
    return body.unionAll(ends).select("image_id", number.alias("line_no"), line.alias("line"))


MAP_HEADER = "Name,Address,Size (bytes),Type,Cols,Rows,DataSize,Signed,ByteOrder,MinValue,MaxValue,MeanValue,ModifiedCells"


def map_lines(maps: DataFrame) -> DataFrame:
    """CSV lines (array_id, line) of maps (array_id, name, address, kind, cols, rows, width, signed, big_endian, low, high, mean, modified); ``MAP_HEADER`` names the fields."""
    quoted = lambda c: F.when(F.col(c).rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    number = lambda c: F.format_string("%.3f", F.round(F.col(c).cast("double"), 3))
    size = (F.col("cols") * F.col("rows") * F.col("width")).cast("string")
    order = F.when(F.col("big_endian"), "big").otherwise("little")
    address = F.concat(F.lit("0x"), F.lpad(F.hex("address"), 8, "0"))
    fields = [quoted("name"), address, size, quoted("kind"), *(F.col(c).cast("string") for c in ("cols", "rows", "width")), F.when(F.col("signed"), "yes").otherwise("no"), order, number("low"), number("high"), number("mean"), F.col("modified").cast("string")]
    return maps.select("array_id", F.concat_ws(",", *fields).alias("line"))


def map_json(maps: DataFrame, cells: DataFrame) -> DataFrame:
    """JSON texts (array_id, json) of maps as above with x_name, x_unit, y_name and y_unit, and their cells (array_id, pos, value)."""
    values = cells.groupBy("array_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("cells"))
    address = F.concat(F.lit("0x"), F.lpad(F.hex("address"), 8, "0"))
    axis = lambda a: F.struct(F.col(f"{a}_name").alias("name"), F.col(f"{a}_unit").alias("unit")).alias(f"{a}Axis")
    body = F.struct("name", F.col("kind").alias("type"), address.alias("address"), F.col("address").alias("addressDec"), (F.col("cols") * F.col("rows") * F.col("width")).alias("length"), "cols", "rows", F.col("width").alias("dataSize"), "signed", axis("x"), axis("y"), "cells", F.col("low").alias("min"), F.col("high").alias("max"), "mean", F.col("modified").alias("modifiedCells"))
    return maps.join(values, "array_id", "left").select("array_id", F.to_json(body).alias("json"))


def escaped(text) -> Column:
    """Text for XML and HTML: the five special characters as references, nulls as nothing."""
    out = F.coalesce(text, F.lit(""))
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#39")):
        out = F.replace(out, F.lit(c), F.lit(f"&{name};"))
    return out


def xdf_text(maps: DataFrame) -> DataFrame:
    """``file_id, text``: XDF files of maps (file_id, name, address, cols, rows, width, signed, a, b, unit, folder), their tables by address and name.

    A map of one cell is a constant. Folders become categories, numbered by name; a file is one row.
    """
    order = F.dense_rank().over(Window.partitionBy("file_id").orderBy(F.coalesce("folder", F.lit(""))))
    m = maps.withColumn("category", order - 1)
    number = lambda c: F.concat(F.lit("0x"), F.hex(c))
    tag = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    flags = F.when(F.col("signed"), "0x01").otherwise("0x00")
    data = F.concat(F.lit("<EMBEDDEDDATA"), tag("mmedtypeflags", flags), tag("mmedaddress", number("address")), tag("mmedelementsizebits", (F.col("width") * 8).cast("string")), tag("mmedrowcount", F.col("rows").cast("string")), tag("mmedcolcount", F.col("cols").cast("string")), F.lit("/>"))
    equation = F.concat(F.lit('<MATH equation="X*'), F.col("a").cast("double").cast("string"), F.when(F.col("b") < 0, "").otherwise("+"), F.col("b").cast("double").cast("string"), F.lit('"/>'))
    title = F.concat(F.lit("<title>"), escaped(F.col("name")), F.lit('</title><CATEGORYMEM index="0" category="'), (F.col("category") + 1).cast("string"), F.lit('"/>'))
    unit = F.concat(F.lit("<units>"), escaped(F.col("unit")), F.lit("</units>"))
    table = F.concat(F.lit("<XDFTABLE>"), title, F.lit('<XDFAXIS id="z">'), unit, data, equation, F.lit("</XDFAXIS></XDFTABLE>"))
    constant = F.concat(F.lit("<XDFCONSTANT>"), title, unit, data, equation, F.lit("</XDFCONSTANT>"))
    body = F.when((F.col("cols") > 1) | (F.col("rows") > 1), table).otherwise(constant)
    named = F.struct("category", F.concat(F.lit("<CATEGORY"), tag("index", number("category")), tag("name", escaped(F.col("folder"))), F.lit("/>")).alias("xml"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda s: s["xml"]), "\n")
    files = m.groupBy("file_id").agg(joined(F.collect_set(named)).alias("categories"), joined(F.collect_list(F.struct("address", "name", body.alias("xml")))).alias("objects"))
    head = F.lit('<XDFFORMAT version="1.60"><XDFHEADER><BASEOFFSET offset="0" subtract="0"/><DEFAULTS datasizeinbits="8" lsbfirst="1" signed="0" float="0"/>\n')
    return files.select("file_id", F.concat(head, "categories", F.lit("\n</XDFHEADER>\n"), "objects", F.lit("\n</XDFFORMAT>\n")).alias("text"))


def change_report(summary: DataFrame, title: str) -> DataFrame:
    """``report_id, html``: a page a report of changed maps (report_id, name, address, changed, cells, least, most), the most changed first.

    Maps without changes are left out; a report of none says so. A report is one row.
    """
    number = lambda c: F.format_string("%.3f", F.round(F.col(c).cast("double"), 3))
    cell = lambda value: F.concat(F.lit("<td>"), value, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(escaped(F.col("name"))), cell(F.concat(F.lit("0x"), F.hex("address"))), cell(F.concat(F.col("changed").cast("string"), F.lit(" / "), F.col("cells").cast("string"))), cell(number("least")), cell(number("most")), F.lit("</tr>"))
    held = F.when(F.col("changed") > 0, F.struct((-F.col("changed")).alias("n"), "address", "name", row.alias("html")))
    reports = summary.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.array_compact(F.collect_list(held))), lambda s: s["html"]), "").alias("rows"), F.count_if(F.col("changed") > 0).alias("maps"))
    head = escaped(F.lit(title))
    body = F.when(F.col("maps") == 0, "<p>No map has changed.</p>").otherwise(F.concat(F.lit("<table><tr><th>Map</th><th>Address</th><th>Changed</th><th>Least</th><th>Most</th></tr>"), "rows", F.lit("</table>")))
    return reports.select("report_id", F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), head, F.lit("</title></head><body><h1>"), head, F.lit("</h1>"), body, F.lit("</body></html>")).alias("html"))
