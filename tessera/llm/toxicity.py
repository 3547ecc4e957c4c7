"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word's subwords are itself and its character n-grams of 3 to 5 letters with marks
for its ends, hashed to ``BUCKETS`` rows of an embedding table, so an unseen
misspelling shares rows with the words it resembles. A few words make a long text toxic,
so a text's different words, in order of first occurrence, fall into runs of ``RUN``
words; a run's vector is the mean over the subwords of its words, and the text is as
toxic as its most toxic run. (Words of a text longer than a piece of ``language.pieces``
are told apart within a piece.) Table and softmax are learnt together by AdaGrad: after two
rounds over all runs of a text, each round learns from the run that is then the most
toxic one and, where the label is 0, from another one. Only subwords of two or more
texts get a vector, as no other text could tell them.

Learning takes at most about ``MAX_TRAIN`` labelled documents of ``MAX_CHARACTERS`` in
all, chosen by a hash of the id; of the label-0 rows at most ``NEGATIVES`` times as many as of label 1 are learnt
from. The other label-0 rows measure where the model errs: where less than ``WRONG`` of
them would be taken for toxic at a lower score, that score becomes 0.5.

For scoring, each row's product with the softmax's weights is taken once: a run's
logit is the mean of these numbers, as averaging and the softmax are linear.

Edge cases: null and empty texts, and texts without a letter, score the share of label 1;
rows without a label are not learnt from; repeated rows count as often as they occur;
an empty table gives no rows; a model without both labels scores the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .language import Words, grams, grouped, sampled

MAX_TRAIN, MAX_CHARACTERS = 16_000, 200_000_000
NEGATIVES = 4
WRONG = 0.005
BUCKETS = 1 << 17
DIMENSIONS = 4
RUN = 4
EPOCHS, WHOLE_EPOCHS = 24, 2
BATCH = 256
RATE = 0.4
#: Scales the mean before the softmax.
GAIN = 6.0
#: Ids up to this number are broadcast to pick the labelled texts.
BROADCAST_ROWS = 1_000_000


def subwords(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the chosen words and of their character n-grams, word by word, and how many each has."""
    values, lengths = words.marked(chosen)
    found = [(words.hashes[chosen], np.arange(len(chosen))), *(grams(values, lengths, n) for n in (3, 4, 5))]
    place = np.concatenate([p for _, p in found])
    rows = (np.concatenate([h for h, _ in found]) % np.uint64(BUCKETS)).astype(np.int32)
    return rows[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(chosen))


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words (indices) of each piece that differ, where their runs begin, and the piece of each run.

    A last run of less than half the length joins the one before.
    """
    order = np.lexsort((words.hashes, words.piece))
    hashes, piece = words.hashes[order], words.piece[order]
    first = np.sort(order[np.append(True, (hashes[1:] != hashes[:-1]) | (piece[1:] != piece[:-1]))[: len(order)]])
    piece = words.piece[first]
    counts = np.bincount(piece, minlength=len(words.letters))
    inside = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - inside
    begins = np.flatnonzero((inside % RUN == 0) & ((inside == 0) | (left >= RUN // 2)))
    return first, begins, piece[begins]


def condensed(text: str | None) -> list[str]:
    """A text's pieces with each different word once, which has the same runs."""
    out = []
    for parts, _ in grouped([text]):
        words = Words.of(parts)
        first, _, _ = runs_of(words)
        spelled = ["".join(map(chr, words.points[a : a + n])) for a, n in zip(words.begins[first], words.lengths[first], strict=True)]
        out += [" ".join(w for w, p in zip(spelled, words.piece[first], strict=True) if p == k) for k in range(len(parts))]
    return [part for part in out if part]


@dataclass
class Model:
    rows: np.ndarray
    bias: float
    empty: float  # the logit of a text without words

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """The logits of texts, given as pieces."""
        best = np.full(len(texts), -np.inf)
        for parts, owners in grouped(texts):
            words = Words.of(parts)
            first, begins, piece = runs_of(words)
            if not len(begins):
                continue
            _, some, place = np.unique(words.hashes[first], return_index=True, return_inverse=True)
            rows, counts = subwords(words, first[some])
            sums = np.add.reduceat(self.rows[rows], np.cumsum(counts) - counts)
            runs = np.add.reduceat(sums[place], begins) / np.add.reduceat(counts[place], begins)
            np.maximum.at(best, owners[piece], runs)
        return np.where(np.isneginf(best), self.empty, best + self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -700, 700)))


@dataclass
class Bags:
    """Texts as runs of words, and words as rows of the table."""

    words: np.ndarray  # the words' numbers, run by run
    runs: np.ndarray  # where each run begins in ``words``, and the end
    texts: np.ndarray  # the text of each run
    rows: np.ndarray  # the subwords' rows, word by word
    begins: np.ndarray  # where each word begins in ``rows``, and the end

    @classmethod
    def of(cls, texts: list[list[str]]) -> Bags:
        """From texts as pieces; texts without words have no run."""
        number: dict[int, int] = {}
        words, runs, owned, rows, sizes, at = [], [], [], [], [], 0
        for parts, owners in grouped(texts):
            found = Words.of(parts)
            first, begins, piece = runs_of(found)
            hashes, some, place = np.unique(found.hashes[first], return_index=True, return_inverse=True)
            new = np.array([h not in number for h in hashes.tolist()], dtype=bool)
            for h in hashes[new].tolist():
                number[h] = len(number)
            more, counts = subwords(found, first[some[new]])
            rows.append(more)
            sizes.append(counts)
            words.append(np.array([number[h] for h in hashes.tolist()], dtype=np.int64)[place])
            runs.append(begins + at)
            owned.append(owners[piece])
            at += len(first)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, dtype=kind)
        runs, owned = join([*runs, [at]], np.int64), join(owned, np.int64)
        return cls(join(words, np.int64), runs, owned, join(rows, np.int32), np.concatenate(([0], np.cumsum(join(sizes, np.int64)))))

    def sizes(self) -> np.ndarray:
        """The subwords of each run."""
        return np.add.reduceat(np.diff(self.begins)[self.words], self.runs[:-1]) if len(self.texts) else np.zeros(0)

    def logits(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The mean of each run's subwords' numbers."""
        words = np.add.reduceat(rows[self.rows], self.begins[:-1])
        return np.add.reduceat(words[self.words], self.runs[:-1]) / sizes

    def expand(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some runs' subwords, and for each its place among these runs."""
        first, place = _spread(self.runs, chosen)
        second, inner = _spread(self.begins, self.words[first])
        return self.rows[second], place[inner]


def _spread(begins: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the chosen stretches, and the place of each one's stretch in ``chosen``."""
    counts = begins[chosen + 1] - begins[chosen]
    place = np.repeat(np.arange(len(chosen)), counts)
    return np.arange(counts.sum()) + np.repeat(begins[chosen] - np.cumsum(counts) + counts, counts), place


def _last_of_each(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each group the index of its greatest value."""
    order = np.lexsort((values, groups))
    return order[np.append(groups[order][1:] != groups[order][:-1], True)]


def fit(texts: list[list[str]], labels: np.ndarray, seed: int = 5) -> Model:
    """Learns the table and the softmax from texts, as pieces, and labels 0 and 1."""
    labels = np.asarray(labels, dtype=np.int64)
    positive, negative = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    rate = (len(positive) + 0.5) / (len(labels) + 1)
    prior = float(np.log(rate / (1 - rate)))
    untaught = Model(np.zeros(BUCKETS), prior, prior)
    if not len(positive) or not len(negative):
        return untaught
    rng = np.random.default_rng(seed)
    chosen = np.sort(rng.choice(negative, min(len(negative), NEGATIVES * len(positive)), replace=False))
    use = np.concatenate((positive, chosen))
    bags, target = Bags.of([texts[k] for k in use.tolist()]), labels[use]
    if not len(bags.texts):
        return untaught
    sizes, owner = bags.sizes(), bags.texts
    seen = np.zeros(BUCKETS, dtype=np.int64)
    ends = np.searchsorted(owner, np.arange(len(use)), side="right")
    for k in np.unique(owner).tolist():
        begin = ends[k - 1] if k else 0
        words = bags.words[bags.runs[begin] : bags.runs[ends[k]]]
        seen[np.unique(bags.rows[_spread(bags.begins, words)[0]])] += 1
    shared = seen > 1
    table = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    weights, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    seen_table, seen_weights, seen_bias = np.full(table.shape, 1e-3, dtype=np.float32), np.full(weights.shape, 1e-3), np.full(2, 1e-3)
    many = np.bincount(owner, minlength=len(use))
    for epoch in range(EPOCHS):
        if epoch < WHOLE_EPOCHS:
            learnt, share = np.arange(len(owner)), 1.0 / many[owner]
        else:
            logits = bags.logits(table @ (weights[:, 1] - weights[:, 0]), sizes)
            others = _last_of_each(owner, rng.random(len(owner)))
            learnt, share = np.concatenate((_last_of_each(owner, logits), others[target[owner[others]] == 0])), np.ones(len(owner))
        step_size = RATE * (1 - epoch / EPOCHS)
        learnt = rng.permutation(learnt)
        for k in range(0, len(learnt), BATCH):
            part = learnt[k : k + BATCH]
            rows, place = bags.expand(part)
            weight = (1.0 / sizes[part])[place]
            mean = np.stack([np.bincount(place, table[rows, d] * weight, minlength=len(part)) for d in range(DIMENSIONS)], axis=1) * GAIN
            scores = mean @ weights + bias
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = e / e.sum(axis=1, keepdims=True)
            error[np.arange(len(part)), target[owner[part]]] -= 1
            error *= (share[part] / share[part].sum())[:, None]
            step_weights, step_bias, back = mean.T @ error, error.sum(axis=0), (error @ weights.T) * GAIN
            live = shared[rows]
            touched, at = np.unique(rows[live], return_inverse=True)
            step = np.stack([np.bincount(at, back[place[live], d] * weight[live], minlength=len(touched)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            seen_table[touched] += step**2
            table[touched] -= step_size * step / np.sqrt(seen_table[touched])
            seen_weights += step_weights**2
            weights -= 0.3 * step_size * step_weights / np.sqrt(seen_weights)
            seen_bias += step_bias**2
            bias -= 0.3 * step_size * step_bias / np.sqrt(seen_bias)
    model = Model((GAIN * (table @ (weights[:, 1] - weights[:, 0]))).astype(np.float64), float(bias[1] - bias[0]), prior)
    apart = np.setdiff1d(negative, chosen)
    if len(apart):
        model.bias -= min(0.0, float(np.quantile(model.logits([texts[k] for k in apart.tolist()]), 1 - WRONG)))
    return model


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """A model from the labelled rows; ids, sources and languages are not looked at."""
    ship_package(docs.sparkSession)
    named = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    chosen = sampled(named, "__id", max_train)
    small = F.broadcast if max_train <= BROADCAST_ROWS else lambda frame: frame

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(small(chosen), "__id")
    size = rows.agg(F.sum(F.length("__text"))).first()[0] or 0
    if size > MAX_CHARACTERS:
        rows = rows.where(F.pmod(F.xxhash64(F.col("__id"), F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * MAX_CHARACTERS / size))

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([condensed(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words, batch.column(2)], names=["id", "words", "label"])

    named = rows.select(F.col("__id").cast("string").alias("id"), "__text", F.col("__label").alias("label"))
    found = named.mapInArrow(condense, "id string, words array<string>, label int").toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["label"], r["words"]))
    return fit([r["words"] for r in found], np.array([r["label"] for r in found]))


def toxicity(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column, 0 to 1."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()), dtype=float)

    return run(text.cast("string"))
