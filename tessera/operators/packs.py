"""Map packs and patches: built from cells, written as JSON or CSV, read back and applied.

Packs are rows (pack_id, name, cols, rows, width, big_endian, address, data). Entries with
null data are definitions only: written, but never applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec

ENTRY = "name string, cols int, rows int, dataSize int, bigEndian boolean, address long, data string"
PACK = f"format string, version int, label string, maps array<struct<{ENTRY.replace(' ', ': ').replace(',: ', ', ')}>>"
RUN = "array<struct<off: string, ref: string, new: string>>"


def build(cells: DataFrame, width: int = 2) -> DataFrame:
    """``array_id, data``: raw cells (array_id, pos, raw) as bytes, big end first; values that don't fit are cut to their low bytes."""
    each = F.struct("pos", codec.hex_text(F.col("raw").cast("long"), width).alias("h"))
    return cells.groupBy("array_id").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda s: s["h"]), "")).alias("data"))


def swapped(data: Column, width: int) -> Column:
    """Bytes with each cell's order turned round."""
    if width == 1:
        return data
    cell = lambda h: F.array_join(F.reverse(F.regexp_extract_all(h, F.lit("(..)"), F.lit(1))), "")
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(F.hex(data), F.lit(f"({'..' * width})"), F.lit(1)), cell), ""))


def raw_values(data: Column, width: int, signed: bool = True) -> Column:
    """The cells of big-end-first bytes."""
    half, whole = 1 << (8 * width - 1), 1 << (8 * width)
    value = lambda h: F.conv(h, 16, 10).cast("long")
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit(f"({'..' * width})"), F.lit(1)), lambda h: F.when(F.lit(signed) & (value(h) >= half), value(h) - whole).otherwise(value(h)))


def to_json(packs: DataFrame) -> DataFrame:
    """One JSON text a pack: ``pack_id, json``, its maps by name."""
    entry = F.struct("name", "cols", "rows", F.col("width").alias("dataSize"), F.col("big_endian").alias("bigEndian"), F.col("address").cast("long").alias("address"), F.base64("data").alias("data"))
    maps = packs.groupBy("pack_id").agg(F.array_sort(F.collect_list(entry)).alias("maps"))
    return maps.select("pack_id", F.to_json(F.struct(F.lit("pack").alias("format"), F.lit(1).alias("version"), F.col("pack_id").cast("string").alias("label"), "maps")).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """The rows of packs in JSON (pack_id, json); other texts and formats give none. A missing size is 2, a missing order big end first."""
    read = texts.select("pack_id", F.from_json("json", PACK).alias("p")).where(F.col("p.format") == "pack")
    m = read.select("pack_id", F.explode("p.maps").alias("m"))
    return m.select("pack_id", "m.name", F.coalesce("m.cols", F.lit(1)).alias("cols"), F.coalesce("m.rows", F.lit(1)).alias("rows"), F.coalesce("m.dataSize", F.lit(2)).alias("width"), F.coalesce("m.bigEndian", F.lit(True)).alias("big_endian"), F.coalesce("m.address", F.lit(0).cast("long")).alias("address"), F.unbase64("m.data").alias("data"))


def to_csv(packs: DataFrame) -> DataFrame:
    """``Address;Name;Size`` lines: ``pack_id, address, line``; blanks replace semicolons and line feeds in names."""
    name = F.regexp_replace("name", "[;\r\n]", " ")
    return packs.select("pack_id", "address", F.concat(F.lit("0x"), codec.hex_text(F.col("address"), 4), F.lit(";"), name, F.lit(";"), (F.col("cols") * F.col("rows") * F.col("width")).cast("string")).alias("line"))


def apply(packs: DataFrame, project: DataFrame, size: int, big_endian: bool = False, width: int = 2) -> DataFrame:
    """What each entry writes into a project of ``size`` bytes: ``pack_id, name, status, address, written``.

    ``project`` has (name, cols, rows, address); of repeated names the smallest address
    counts. An entry without such a map goes to its own address. ``status`` is applied or
    says why not, in this order: definition, address, dimensions, short, bounds, mismatch.
    """
    maps = project.groupBy("name").agg(F.min_by(F.struct("cols", "rows", "address"), "address").alias("__map"))
    m = packs.join(maps, "name", "left")
    base = F.coalesce(F.col("__map.address"), F.when(F.col("address") != 0, F.col("address")))
    length = F.col("cols") * F.col("rows") * F.col("width")
    status = (
        F.when(F.coalesce(F.length("data"), F.lit(0)) == 0, "definition")
        .when(base.isNull(), "address")
        .when((F.col("cols") <= 0) | (F.col("rows") <= 0) | (F.col("width") <= 0) | (F.col("cols") > 10000) | (F.col("rows") > 10000) | (length > 10_000_000), "dimensions")
        .when(F.length("data") < length, "short")
        .when(base + length > size, "bounds")
        .when(F.col("__map").isNotNull() & ((F.col("cols") != F.col("__map.cols")) | (F.col("rows") != F.greatest(F.col("__map.rows"), F.lit(1)))), "mismatch")
        .otherwise("applied")
    )
    bytes_ = F.substring("data", F.lit(1), length)
    turned = F.when(F.col("big_endian") != F.lit(big_endian), swapped(bytes_, width)).otherwise(bytes_)
    return m.select("pack_id", "name", status.alias("status"), base.alias("address"), F.when(status == "applied", turned).alias("written"))


def patch_json(runs: DataFrame) -> DataFrame:
    """One JSON text an image of runs (image_id, address, before, after: hexadecimal): ``image_id, json``."""
    run = F.struct("address", F.struct(F.concat(F.lit("0x"), F.lower(F.hex("address"))).alias("off"), F.lower("before").alias("ref"), F.lower("after").alias("new")).alias("run"))
    gathered = runs.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(run)), lambda s: s["run"]).alias("rawBytes"))
    return gathered.select("image_id", F.to_json(F.struct(F.lit("patch").alias("format"), F.lit(1).alias("version"), "rawBytes")).alias("json"))


def patch_bytes(texts: DataFrame) -> DataFrame:
    """The bytes of patches in JSON (image_id, json): ``image_id, address, before, after``; a run counts as far as both its texts reach."""
    read = texts.select("image_id", F.from_json("json", f"format string, rawBytes {RUN}").alias("p")).where(F.col("p.format") == "patch")
    run = read.select("image_id", F.explode("p.rawBytes").alias("r"))
    pairs = lambda c: F.regexp_extract_all(c, F.lit("([0-9A-Fa-f]{2})"), F.lit(1))
    at = F.conv(F.regexp_replace("r.off", "^0[xX]", ""), 16, 10).cast("long")
    each = run.select("image_id", at.alias("at"), F.posexplode(F.arrays_zip(pairs(F.col("r.ref")).alias("a"), pairs(F.col("r.new")).alias("b"))).alias("k", "z"))
    number = lambda c: F.conv(c, 16, 10).cast("int")
    return each.select("image_id", (F.col("at") + F.col("k")).alias("address"), number(F.col("z.a")).alias("before"), number(F.col("z.b")).alias("after")).where("before is not null and after is not null")
