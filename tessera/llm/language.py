"""Language identification: words first, then progressively shorter character n-grams.

A known word scores, in each language, the logarithm of its smoothed frequency. An
unseen word scores the mean over its character n-grams of the longest length at
which any of them is known, from ``LONGEST`` letters (with marks for the word's two
ends) down to one. A text's score is the sum over all its words; its probability is
that of the softmax over the languages, which soon comes near 0 or 1. ``fit`` says how
well the text's words are known at all: the mean over its words of ``LONGEST`` + 1 for a
known word and of that longest length for another, less the same mean of texts of its
language that the tables were not learnt from, in standard errors (``Model.spread``).

A word is a run of Unicode letters and combining marks, in lower case. Words and n-grams
are kept as 64-bit hashes, in one sorted array a length, with one row of scores each; the
tables hold every word and n-gram of the sample, however rare. The model is learnt from
at most about ``MAX_TRAIN`` documents, chosen by a hash of the id; of these one in
``CALIBRATION`` only serves to measure ``fit``, where there are so many.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; a text of
letters in no table ties, and the language with most training words wins; repeated
rows score alike; an empty table gives no rows; a model without any training row
predicts ``und``; columns named as the results are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .simhash import ShingleHasher, _mixed

MAX_TRAIN = 10_000
CALIBRATION = 10
LONGEST = 5
UNKNOWN = "und"
#: Characters handled at once; bounds a task's memory.
CHUNK = 1 << 18
SMOOTHING = 0.1
#: The marks of a word's begin and end: no code points.
BEGIN, END = 0x110000, 0x110001
_BASE = np.uint64(ShingleHasher.BASE)


@cache
def _classes() -> np.ndarray:
    """For each code point: 2 for letters, 1 for combining marks, 0 for others."""
    return np.fromiter((2 * (c[0] == "L") + (c[0] == "M") for c in map(unicodedata.category, map(chr, range(0x110000)))), dtype=np.uint8, count=0x110000)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(ShingleHasher.BASE, -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(CHUNK - 1, base, dtype=np.uint64)))) for base in (_BASE, inverse))


def pieces(text: str) -> Iterator[str]:
    """A text in lower case, in pieces of at most ``CHUNK`` characters cut between words; a longer word is cut within."""
    at = 0
    while at < len(text):
        end = at + CHUNK // 4  # lower case can be longer
        if end < len(text):
            cut = end
            while cut > at and unicodedata.category(text[cut - 1])[0] in "LM":
                cut -= 1
            end = cut if cut > at else end
        yield text[at:end].lower()
        at = end


@dataclass
class Words:
    """The words of some pieces of text: code points, begins and lengths, hashes, and the piece of each."""

    points: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    letters: np.ndarray  # a piece: whether it has a letter

    @classmethod
    def of(cls, parts: list[str]) -> Words:
        points = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = _classes()[points]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], kinds > 0, [False]))))
        begins, ends = edges[::2], edges[1::2]
        powers, inverses = _powers()
        values = _mixed(points.astype(np.uint64))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * powers[: len(values)], dtype=np.uint64)))
        hashes = (sums[ends] - sums[begins]) * inverses[begins]
        starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        letters = np.zeros(len(parts), dtype=bool)
        letters[np.searchsorted(starts, np.flatnonzero(kinds == 2), side="right") - 1] = True
        return cls(points, begins, ends - begins, _mixed(hashes + (ends - begins).astype(np.uint64)), np.searchsorted(starts, begins, side="right") - 1, letters)

    def marked(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the characters of the given words, with marks, one word after the other; lengths."""
        lengths = self.lengths[words] + 2
        starts = np.cumsum(lengths) - lengths
        inside = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        out = self.points[np.clip(np.repeat(self.begins[words], lengths) + inside - 1, 0, max(0, len(self.points) - 1))].astype(np.uint64)
        out[starts], out[starts + lengths - 1] = BEGIN, END
        return _mixed(out), lengths


def grams(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``size`` characters of marked words, and the word of each."""
    rows = len(values) - size + 1
    if rows <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    word = np.repeat(np.arange(len(lengths)), lengths)
    kept = word[:rows] == word[size - 1 :]
    out = np.full(rows, size, dtype=np.uint64)
    for k in range(size):
        out = out * _BASE + values[k : k + rows]
    return _mixed(out[kept]), word[:rows][kept]


@dataclass
class Table:
    """Hashes in order, and for each a logarithmic score in every language."""

    keys: np.ndarray
    scores: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 for an unknown one."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


@dataclass
class Model:
    languages: list[str]
    tables: list[Table]  # of words, then of n-grams of 1 to LONGEST characters
    #: For each language: the mean of the levels of words, their deviation within texts, and that of texts' means.
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))

    def score_words(self, words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores of the given words in each language, and the level at which each is known."""
        scores, level = np.zeros((len(chosen), len(self.languages))), np.zeros(len(chosen))
        found = self.tables[0].find(words.hashes[chosen])
        known = found >= 0
        scores[known], level[known] = self.tables[0].scores[found[known]], LONGEST + 1
        open_ = np.flatnonzero(~known)
        for size in range(LONGEST, 0, -1):
            if not len(open_):
                break
            values, lengths = words.marked(chosen[open_])
            hashes, word = grams(values, lengths, size)
            found = self.tables[size].find(hashes)
            rows, word = self.tables[size].scores[found[found >= 0]], word[found >= 0]
            hits = np.bincount(word, minlength=len(open_))
            sums = np.stack([np.bincount(word, rows[:, k], minlength=len(open_)) for k in range(rows.shape[1])], axis=1)
            met = hits > 0
            scores[open_[met]], level[open_[met]] = sums[met] / hits[met, None], size
            open_ = open_[~met]
        return scores, level

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the sum of its words' scores, (words, sum and sum of squares of their levels), whether it has a letter."""
        scores, levels, letters = np.zeros((len(texts), len(self.languages))), np.zeros((len(texts), 3)), np.zeros(len(texts), dtype=bool)
        for parts, owners in grouped(texts):
            words = Words.of(parts)
            letters[owners[words.letters]] = True
            _, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
            own, level = self.score_words(words, first)
            text = owners[words.piece]
            for k in range(own.shape[1]):
                scores[:, k] += np.bincount(text, own[place, k], minlength=len(texts))
            for k in range(3):
                levels[:, k] += np.bincount(text, level[place] ** k, minlength=len(texts))
        return scores, levels, letters

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.languages or not texts:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "fit": 0.0})
        scores, levels, letters = self.totals(texts)
        best = scores.argmax(axis=1)
        with np.errstate(over="ignore"):
            chance = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        words = np.maximum(levels[:, 0], 1)
        mean, within, between = self.spread[best].T
        fit = (levels[:, 1] / words - mean) / np.sqrt(between**2 + within**2 / words + 1e-6)
        return pd.DataFrame({"lang_pred": np.where(letters, np.array(self.languages, dtype=object)[best], UNKNOWN), "score": np.where(letters, chance, 0.0), "fit": np.where(letters, fit, 0.0)})


def grouped(texts: list[str | list[str] | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces of texts, of at most about ``CHUNK`` characters together, and the text of each; a text may be given as pieces."""
    parts, owners, size = [], [], 0
    for k, text in enumerate(texts):
        for part in pieces(text) if isinstance(text, str) else text if isinstance(text, list) else ():
            if size + len(part) + 1 > CHUNK and parts:
                yield parts, np.array(owners)
                parts, owners, size = [], [], 0
            parts.append(part)
            owners.append(k)
            size += len(part) + 1
    if parts:
        yield parts, np.array(owners)


def sampled(frame: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` rows, all if there are no more, chosen by a hash of the id."""
    count = frame.count()
    if count <= most:
        return frame
    return frame.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * most / count))


def counted(texts: list[str], languages: list[int]) -> Iterator[pa.RecordBatch]:
    """``size, lang, key, n``: how often words (size 0) and n-grams occur in texts of each language, some texts a batch."""
    owner = np.array(languages, dtype=np.int64)
    for parts, owners in grouped(texts):
        words = Words.of(parts)
        lang = owner[owners[words.piece]]
        for k in np.unique(lang).tolist():
            keys, first, times = np.unique(words.hashes[lang == k], return_index=True, return_counts=True)
            values, lengths = words.marked(np.flatnonzero(lang == k)[first])
            for size in range(LONGEST + 1):
                if size:
                    hashes, word = grams(values, lengths, size)
                    keys, place = np.unique(hashes, return_inverse=True)
                    n = np.bincount(place, times[word], minlength=len(keys)).astype(np.int64)
                else:
                    n = times
                columns = (np.full(len(keys), size, dtype=np.int32), np.full(len(keys), k, dtype=np.int32), keys.view(np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["size", "lang", "key", "n"])


def tables_of(counts: pa.Table, languages: int) -> list[Table]:
    """The tables of all counted words and n-grams: smoothed logarithmic frequencies."""
    size, lang, key, n = (counts.column(c).to_numpy() for c in ("size", "lang", "key", "n"))
    out = []
    for k in range(LONGEST + 1):
        rows = size == k
        keys, place = np.unique(key[rows].view(np.uint64), return_inverse=True)
        hits = np.zeros((len(keys), languages))
        np.add.at(hits, (place, lang[rows]), n[rows])
        out.append(Table(keys, np.log((hits + SMOOTHING) / (hits.sum(axis=0) + SMOOTHING * max(1, len(keys)))).astype(np.float32)))
    return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model:
    """A model from the rows with a text and a language."""
    ship_package(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = sampled(named.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), "id", max_train)
    share = rows.groupBy("lang").count().collect()  # the languages
    if not share:
        return Model([], [])
    names = sorted(r["lang"] for r in share)
    held = F.lit(sum(r["count"] for r in share) >= 50 * CALIBRATION) & (F.pmod(F.xxhash64("id", F.lit(12)), F.lit(CALIBRATION)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: k for k, name in enumerate(names)}
        for batch in batches:
            yield from counted(batch.column(0).to_pylist(), [number[x] for x in batch.column(1).to_pylist()])

    found = rows.where(~F.coalesce(held, F.lit(False))).select("text", "lang").mapInArrow(count, "size int, lang int, key long, n long")
    counts = found.groupBy("size", "lang", "key").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    words = np.bincount(counts.column("lang").to_numpy(), np.where(counts.column("size").to_numpy() == 0, counts.column("n").to_numpy(), 0), minlength=len(names))
    order = sorted(range(len(names)), key=lambda k: (-words[k], names[k]))
    tables = [Table(t.keys, t.scores[:, order]) for t in tables_of(counts, len(names))]
    model = Model([names[k] for k in order], tables)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, levels, _ = shared.value.totals(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in levels.T)], names=["lang", "words", "level", "square"])

    kept = rows.where(F.coalesce(held, F.lit(False))).select("text", "lang").mapInArrow(measure, "lang string, words double, level double, square double").where("words > 0")
    measured = kept.groupBy("lang").agg(F.sum("words").alias("w"), F.sum("level").alias("l"), F.sum("square").alias("s"), F.stddev_pop(F.col("level") / F.col("words")).alias("between")).collect()
    model.spread = np.tile([LONGEST + 1.0, LONGEST + 1.0, LONGEST + 1.0], (len(names), 1))
    for r in measured:
        mean = r["l"] / r["w"]
        model.spread[model.languages.index(r["lang"])] = mean, np.sqrt(max(0.0, r["s"] / r["w"] - mean**2)), r["between"]
    return model


def language(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct ``lang_pred, score, fit`` for a text column."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, fit double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts.tolist())

    return run(text.cast("string"))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``fit``."""
    new = ("lang_pred", "score", "fit")
    own = [c for c in docs.columns if c not in new]
    scored = docs.select(*own, language(docs.sparkSession, model, F.col(text_col)).alias("__language"))
    return scored.select(*own, *(F.col(f"__language.{c}").alias(c) for c in new))
