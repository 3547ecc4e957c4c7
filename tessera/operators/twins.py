"""Twins of an image in a catalog: equal files, equal data areas, and near ones by their chunks' bits.

The catalog has (entry_id, id_project, id_data, regions, chunk0, chunk1); regions are text
with pairs ``from-to`` in hexadecimal, chunks hexadecimal of equal lengths. Nulls never match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec

FARTHEST = 0.33
MOST_DATA, MOST_NEAR = 300, 200


def regions(text: Column) -> Column:
    """The pairs ``begin, end`` (both included) named in a text, without those that end before they begin."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9A-Fa-f]+\s*-\s*[0-9A-Fa-f]+)"), F.lit(1))
    number = lambda x: F.conv(F.trim(x), 16, 10).cast("long")
    pairs = F.transform(found, lambda x: F.struct(number(F.split_part(x, F.lit("-"), F.lit(1))).alias("begin"), number(F.split_part(x, F.lit("-"), F.lit(2))).alias("end")))
    return F.filter(pairs, lambda p: p["end"] >= p["begin"])


def bits_apart(a: Column, b: Column) -> Column:
    """The share of bits in which two hexadecimal texts differ; 1 where one is empty, null or of another length."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit("(.{1,15})"), F.lit(1))
    number = lambda x: F.conv(x, 16, 10).cast("long")
    bits = F.aggregate(F.zip_with(pieces(a), pieces(b), lambda x, y: F.bit_count(number(x).bitwiseXOR(number(y)))), F.lit(0), lambda s, n: s + n)
    return F.when((F.length(a) > 0) & (F.length(a) == F.length(b)), bits / (4.0 * F.length(a))).otherwise(1.0)


def twins(image: DataFrame, catalog: DataFrame, identity: Callable[[Column], Column] = codec.crc_identity) -> DataFrame:
    """``entry_id, kind, distance, place`` of the twins of an image, the one row of ``image`` (data: binary).

    Entries with the image's identity are ``project`` twins. Their regions, cut from the
    image, give identities of data areas: entries that share one are ``data`` twins, at
    most ``MOST_DATA`` by id. The first project twin's chunks (else the first data twin's second chunk) are
    compared with all other entries': those that differ in some bits, but at most
    ``FARTHEST`` of either chunk's, are ``near``, the nearest ``MOST_NEAR``. The image's few
    values are single rows that are broadcast; the catalog is scanned, not shuffled.
    """
    own = F.broadcast(image.select(F.col("data").alias("__data"), identity(F.col("data")).alias("__id")).limit(1))
    marked = catalog.join(own, F.lit(True)).withColumn("__project", F.coalesce(F.col("id_project") == F.col("__id"), F.lit(False)))
    area = marked.where("__project").select("__data", F.explode(regions(F.col("regions"))).alias("r")).distinct()
    size = F.length("__data")
    inside = area.where(F.col("r.begin") < size)
    ids = inside.select(identity(F.substring("__data", (F.col("r.begin") + 1).cast("int"), F.least(F.col("r.end") - F.col("r.begin") + 1, size).cast("int"))).alias("id_data")).distinct()
    data = marked.where(~F.col("__project")).join(ids, "id_data", "left_semi").orderBy("entry_id").limit(MOST_DATA)
    exact = marked.where("__project").select("entry_id", F.lit("project").alias("kind"), "chunk0", "chunk1").unionAll(data.select("entry_id", F.lit("data"), F.lit(None).cast("string"), "chunk1"))
    first = F.struct((F.col("kind") != "project").alias("k"), "entry_id")
    needle = F.broadcast(exact.agg(F.min_by("chunk0", F.when(F.col("kind") == "project", F.col("entry_id"))).alias("__c0"), F.min_by("chunk1", F.when(F.col("chunk1") != "", first)).alias("__c1")))
    listed = exact.select("entry_id")
    others = catalog.join(listed, "entry_id", "left_anti").join(needle, F.lit(True))
    near = others.withColumn("distance", F.least(bits_apart(F.col("chunk0"), F.col("__c0")), bits_apart(F.col("chunk1"), F.col("__c1"))))
    near = near.where((F.col("distance") > 0) & (F.col("distance") <= FARTHEST)).orderBy("distance", "entry_id").limit(MOST_NEAR)
    found = exact.select("entry_id", "kind", F.lit(0.0).alias("distance")).unionAll(near.select("entry_id", F.lit("near"), "distance"))
    rank = F.when(F.col("kind") == "project", 0).when(F.col("kind") == "data", 1).otherwise(2)
    # at most the project twins and the two limits
    return found.withColumn("place", F.row_number().over(Window.orderBy(rank, "distance", "entry_id")))
