"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's rate is its target share of all characters divided by its present
share. Each document gets a uniform number from a hash of seed and id; the
Poisson distribution with the source's rate, inverted at that number, says how
often the document occurs. Copies are exploded and dealt out by a hash, so that
the rows of a partition, sorted by ``shuffle_key``, are a random mix of all sources.

The table of sources is broadcast only if its distribution functions hold at most
``BROADCAST_CELLS`` numbers (8 bytes each); beyond that the join is left to Spark,
which splits a hot source.

Edge cases: a null source is a source of its own; a null text has no characters
(each document counts one more than its characters, so an empty source still has a
size); a source without a given weight gets none; repeated rows are replicated
alike; an empty table gives no rows; columns named ``copy`` or ``shuffle_key`` in
the input are replaced, and other names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

BROADCAST_CELLS = 1_000_000


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, scale: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row a source: ``source, size, rate``. Without ``weights`` a source weighs its size to the power of ``exponent``."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(float(exponent)))
    else:
        weight = F.lit(float(weights.get(None, 0.0)))
        for name, w in weights.items():
            weight = F.when(F.col("source") == F.lit(name), F.lit(float(w))).otherwise(weight) if name is not None else weight
        if any(name is not None for name in weights):
            known = F.col("source").isin([n for n in weights if n is not None])
            weight = F.when(F.col("source").isNotNull() & ~known, F.lit(0.0)).otherwise(weight)
    whole = Window.partitionBy()  # one row a source
    share = F.try_divide(F.col("weight"), F.sum("weight").over(whole))
    return sizes.withColumn("weight", weight).select("source", "size", F.coalesce(share * F.sum("size").over(whole) * F.lit(float(scale)) / F.col("size"), F.lit(0.0)).alias("rate"))


def _distribution(rate):
    """The Poisson distribution function at 0, 1, ... as far as doubles tell it from 1, summed from logarithms."""
    log_rate = F.log(F.greatest(rate, F.lit(1e-300)))
    first = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out"))

    def add(so_far, k):
        log_p = so_far["log_p"] + log_rate - F.log(k.cast("double"))
        total = so_far["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.concat(so_far["out"], F.array(total)).alias("out"))

    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    return F.aggregate(F.sequence(F.lit(1), last), first, add, lambda x: x["out"])


def _hash(digits: int, *parts):
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, exponent: float = 0.5, scale: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs``, each row as often as its Poisson count says, with ``copy`` (from 0) and ``shuffle_key``, globally shuffled.

    ``scale`` is the wanted size of the result against the input's.
    """
    own = docs.drop("copy", "shuffle_key")
    table = cut_lineage(rates(docs, weights, exponent, scale, source_col, text_col).select(F.col("source").alias("__mix_source"), _distribution(F.col("rate")).alias("__mix_cdf")))
    cells = table.agg(F.sum(F.size("__mix_cdf"))).first()[0] or 0
    if cells <= BROADCAST_CELLS:
        table = F.broadcast(table)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    uniform = _hash(13, F.lit(str(seed)), name) / F.lit(float(1 << 52))
    joined = own.withColumn("__mix_u", uniform).join(table, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    count = F.size(F.filter("__mix_cdf", lambda x: x <= F.col("__mix_u")))
    copies = joined.withColumn("__mix_count", count).filter("__mix_count > 0").select(*own.columns, F.explode(F.sequence(F.lit(0), F.col("__mix_count") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", _hash(15, F.lit(str(seed)), name, F.col("copy").cast("string")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", id_col)
