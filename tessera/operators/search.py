"""Text search and ranking, set overlap, consensus across versions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wildcard(text: Column, pattern: str) -> Column:
    """Whether the text matches ``*`` and ``?``, or holds the pattern if it has neither; case is ignored."""
    if not re.search(r"[*?]", pattern):
        return F.contains(F.lower(text), F.lit(pattern.lower()))
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return F.lower(text).rlike(f"^{body}$")


def match_score(name: Column, description: Column, unit: Column, wanted: str) -> Column:
    """100 for an equal name, 70 for its start, 50 for a part of it; 30 more by description, 20 by unit."""
    w, low = wanted.lower(), F.lower(name)
    base = F.when(low == w, 100).when(low.startswith(w), 70).when(F.contains(low, F.lit(w)), 50).otherwise(0)
    return base + F.when(F.contains(F.lower(description), F.lit(w)), 30).otherwise(0) + F.when(F.contains(F.lower(unit), F.lit(w)), 20).otherwise(0)


def fuzzy_rank(name: Column, query: str) -> Column:
    """All words must match: the least word's rank of 1000 equal, 800 start, 600 word start, 400 part, 100 letters in order; else null."""
    low = F.lower(name)

    def one(word: str) -> Column:
        return F.when(low == word, 1000).when(low.startswith(word), 800).when(low.rlike(r"\b" + re.escape(word)), 600).when(F.contains(low, F.lit(word)), 400).when(low.rlike(".*".join(map(re.escape, word))), 100)

    words = [one(w) for w in query.lower().split()]
    every = words[0].isNotNull()
    for w in words[1:]:
        every &= w.isNotNull()
    return F.when(every, F.least(*words) if len(words) > 1 else words[0])


def first_rule(text: Column, rules: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """The label of the first wildcard rule that matches."""
    found = F.lit(other)
    for pattern, label in reversed(rules):
        found = F.when(wildcard(text, pattern), F.lit(label)).otherwise(found)
    return found


def find_masked(data: Column, pattern: str) -> Column:
    """All places, overlapping ones too, of a byte pattern such as ``"61 ?? 62"``, where ``??`` fits any byte."""
    parts = pattern.split()
    text = F.hex(data)
    places = F.sequence(F.lit(0), F.greatest(F.length(data) - len(parts), F.lit(-1)))

    def fits(at: Column) -> Column:
        tests = [F.substring(text, 2 * (at + k) + 1, F.lit(2)) == p.upper() for k, p in enumerate(parts) if p != "??"]
        out = F.lit(True)
        for t in tests:
            out &= t
        return out

    return F.when(F.length(data) >= len(parts), F.filter(places, fits)).otherwise(F.array().cast("array<int>"))


#: Keys whose pairs with all others are counted in one place.
KEYS_A_BLOCK = 500


def overlap_pairs(sets: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """Jaccard similarity of the sets of items of each two keys that share one: ``a, b, jaccard``.

    Items held by very many keys cost the square of their number. An item's keys go as one
    array to each block of keys that holds some of them, and pairs are made and counted
    there, so no pair is shuffled before it shares enough for the smallest set. Blocks of
    whole numbers are ranges.
    """
    own = sets.select(F.col(key).alias("a"), item).distinct()
    size = own.groupBy("a").agg(F.count("*").alias("size"))
    low, high, keys = sets.agg(F.min(key), F.max(key), F.approx_count_distinct(key)).first()
    blocks = -(-keys // KEYS_A_BLOCK) or 1
    ranges = isinstance(low, int) and not isinstance(low, bool)
    block = lambda k: (F.floor((k - low) / F.lit((high - low + 1) / blocks)) if ranges else F.pmod(F.xxhash64(k), F.lit(blocks))).cast("int")
    held = own.where(F.col("a").isNotNull() & F.col(item).isNotNull()).groupBy(item).agg(F.collect_list("a").alias("held")).where(F.size("held") > 1)
    dealt = held.select("held", F.explode(F.array_distinct(F.transform("held", block))).alias("block"))
    dealt = dealt.select("block", "held", F.filter("held", lambda k: block(k) == F.col("block")).alias("mine"))
    tasks = max(blocks, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mine = dealt.repartition(tasks, "block").select("block", "held", F.explode("mine").alias("a"))
    shared = mine.select("block", "a", F.explode(F.filter("held", lambda k: k > F.col("a"))).alias("b")).groupBy("block", "a", "b").agg(F.count("*").alias("both")).drop("block")
    shared = shared.where(F.col("both") >= least * size.agg(F.min("size")).scalar() - 1e-6)
    sized = shared.join(size, "a").join(size.select(F.col("a").alias("b"), F.col("size").alias("other")), "b")
    return sized.select("a", "b", (F.col("both") / (F.col("size") + F.col("other") - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= least)


def best_by_shared(postings: DataFrame, key: str, item: str, wanted: Column, candidates: int = 6000) -> DataFrame:
    """The keys that share most items with the wanted one: ``key, shared``; ties by key."""
    needle = postings.where(wanted).select(item).distinct()
    hits = postings.where(~wanted).join(needle, item).groupBy(key).agg(F.count_distinct(item).alias("shared"))
    return hits.orderBy(F.desc("shared"), key).limit(candidates)


def sketch(items: DataFrame, key: str, item: str, buckets: int = 128) -> DataFrame:
    """One-permutation MinHash: ``key, bucket, hash``, the least hash of each bucket that has an item."""
    h = F.xxhash64(item)
    return items.select(key, F.pmod(h, F.lit(buckets)).cast("int").alias("bucket"), h.alias("hash")).groupBy(key, "bucket").agg(F.min("hash").alias("hash"))


def sketch_similarity(sketches: DataFrame, sizes: DataFrame, key: str, least_shared: int = 4) -> DataFrame:
    """``a, b, jaccard, containment`` of keys whose sketches share hashes, joined on bucket and hash.

    Containment is J (|A| + |B|) / (1 + J) / min(|A|, |B|); below 0.6 the score of sets of
    very different size is damped by their ratio.
    """
    other = sketches.select(F.col(key).alias("b"), "bucket", "hash")
    shared = sketches.withColumnRenamed(key, "a").join(other, ["bucket", "hash"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("matched")).where(F.col("matched") >= least_shared)
    filled = sketches.groupBy(key).agg(F.count("*").alias("filled")).join(sizes, key)
    both = shared.join(filled.select(F.col(key).alias("a"), F.col("filled").alias("fa"), F.col("size").alias("sa")), "a").join(filled.select(F.col(key).alias("b"), F.col("filled").alias("fb"), F.col("size").alias("sb")), "b")
    j = F.col("matched") / F.greatest("fa", "fb")
    small, large = F.least("sa", "sb"), F.greatest("sa", "sb")
    c = F.least(F.lit(1.0), j * (F.col("sa") + F.col("sb")) / (1 + j) / small)
    damped = F.when((large > 2 * small) & (c < 0.6), c * small * 2 / large).otherwise(c)
    return both.select("a", "b", j.alias("jaccard"), damped.alias("containment"))


def consensus(voices: DataFrame, address: str, delta: str, whole: int) -> DataFrame:
    """Per address: voices, mean and population deviation of their deltas, tag, and strength = coverage x agreement."""
    g = voices.groupBy(address).agg(F.count("*").alias("n"), F.avg(delta).alias("mean"), F.stddev_pop(delta).alias("sigma"))
    cover, spread = F.col("n") / F.lit(whole), F.coalesce(F.try_divide(F.col("sigma"), F.abs("mean")), F.lit(0.0))
    agreement = F.greatest(F.lit(0.0), 1 - spread)
    tag = F.when(F.col("n") <= 1, "Heretic").when((cover >= 0.95) & (spread <= 0.02), "Unanimous").when((cover >= 0.5) & (spread <= 0.2), "StrongConsensus").otherwise("Majority")
    return g.select(address, "n", "mean", "sigma", tag.alias("tag"), (F.least(F.lit(1.0), cover) * agreement).alias("strength"))


def first_of(frame: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return frame.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def family(text: Column, patterns: list[tuple[str, str, int]], fallback: Column, sure: int = 80) -> Column:
    """``family, sure`` by the pattern (needle, family, score) of the highest score that occurs with no letter or digit behind it; the first on ties.

    Without any the fallback, which is never sure; a null text has the fallback.
    """
    best = F.struct(F.lit(None).cast("int").alias("score"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("family"))
    hits = [F.when(text.rlike(re.escape(needle) + "(?![0-9A-Za-z])"), F.struct(F.lit(score).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("family"))) for k, (needle, name, score) in enumerate(patterns)]
    found = F.array_max(F.array_compact(F.array(*hits, F.when(F.lit(False), best))))
    return F.struct(F.coalesce(found["family"], fallback).alias("family"), F.coalesce(found["score"] >= sure, F.lit(False)).alias("sure"))


def resolve_folder(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted, path, status`` of texts (wanted): a folder (path) by its full path or else its last segment, if just one fits; case doesn't matter."""
    last = F.lower(F.element_at(F.split("path", "/"), -1))
    keyed = folders.select("path", F.explode(F.array(F.struct(F.lower("path").alias("key"), F.lit(True).alias("whole")), F.struct(last.alias("key"), F.lit(False).alias("whole")))).alias("k")).select("path", "k.key", "k.whole")
    hits = keyed.groupBy("key", "path").agg(F.bool_or("whole").alias("whole")).groupBy("key").agg(F.count_if("whole").alias("full"), F.count("*").alias("every"), F.min(F.when(F.col("whole"), F.col("path"))).alias("exact"), F.min("path").alias("any"))
    found = wanted.join(hits, F.lower("wanted") == F.col("key"), "left")
    path = F.when(F.col("full") == 1, F.col("exact")).when(F.col("every") == 1, F.col("any"))
    return found.select("wanted", path.alias("path"), F.when(F.col("key").isNull(), "missing").when(path.isNotNull(), "found").otherwise("ambiguous").alias("status"))


def tree_filter(nodes: DataFrame, text: str, condition: Column | None = None) -> DataFrame:
    """``path, hit`` of the nodes (path) that hold a text, as it is or without separators, and meet a condition; and of all their parents."""
    plain = lambda c: F.regexp_replace(c, r"[\s/_.-]", "")
    low, wanted = F.lower("path"), F.lower(F.lit(text))
    hits = nodes.where((F.contains(low, wanted) | F.contains(plain(low), plain(wanted))) & (F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))))
    parts = F.split("path", "/")
    shown = hits.select(parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"))
    return shown.groupBy(F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("path")).agg(F.bool_or(F.col("k") == F.size("parts")).alias("hit"))


def dominant(votes: DataFrame, key: str, vote: str, least: float = 0.9) -> DataFrame:
    """``key, vote, share`` where at least ``least`` of a key's votes agree; a null vote is a vote of its own. Votes are counted before they meet by key."""
    counted = votes.groupBy(key, vote).agg(F.count("*").alias("n"))
    best = counted.groupBy(key).agg(F.max_by(F.struct(vote), "n").alias("best"), (F.max("n") / F.sum("n")).alias("share"))
    return best.where(F.col("share") >= least).select(key, F.col(f"best.{vote}").alias(vote), "share")
