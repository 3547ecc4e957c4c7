"""Order-preserving packing of documents into windows of tokens.

Every input partition is one stream: its documents, in order, each followed by
the end id. A dynamic programme chooses the cuts of the stream. A window may
start and end at a document end, at a sentence end, or, where a sentence has more
tokens than a window, at a forced cut. Its cost is

    padding(window) + penalty(cut at its end) + window_cost

with padding 0 for a power of two from ``LEAST_EXACT``, or of any power at a stream's
end, and ``window - length`` otherwise, and with a penalty of 0 at a document end. Apart from those lengths the
cost is ``f(i) + b(i)`` plus terms that depend on j only, so the best start of a
window that ends at j is the minimum of a sliding range, kept in a monotone queue.

Nothing is shuffled: a partition holds only a bounded stretch of its stream, and
the last two windows of a stretch are planned again with the next one.

Edge cases: a null text is an empty one (its single id is the end id); an empty
table gives no rows; repeated rows are packed as often as they occur; columns
other than the id and the text are not read, so their names cannot clash; a null
id stays null.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

WINDOW = 4096
END_ID = 2
SENTENCE_PENALTY = 8.0
FORCED_PENALTY = 64.0
WINDOW_COST = 4.0
#: Windows of a smaller power of two are planned as if they were padded, but at the end of a stream.
LEAST_EXACT = 64
#: Tokens planned together; bounds the memory of a task.
STRETCH = 1 << 20

PIECES = "doc_id long, start long, length long, ids_le binary, doc_tokens long, sequence_id long, offset long"


class _Words(dict):
    """The ids of each word as little-endian bytes, found by the vocabulary's model when first asked for."""

    #: Bytes that stand for themselves in a byte-level vocabulary; the others get the code points from 256 on, in order.
    PRINTED = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))

    def __init__(self, model, ids: int, limit: int) -> None:
        rest = [b for b in range(256) if b not in self.PRINTED]
        self.model, self.limit, self.letters = model, limit, {b: 256 + k for k, b in enumerate(rest)}
        self.spelled = [n.to_bytes(4, "little") for n in range(ids)]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        found = self[word] = b"".join([self.spelled[t.id] for t in self.model.tokenize(spelled)])
        return found


class WordTokenizer:
    """The ids of ``Tokenizer.encode(text, add_special_tokens=False)`` with a cache by word.

    The vocabulary's own splitting rule is applied with a regular expression to
    texts of plain Latin characters, where both agree; each distinct word is
    encoded once. Any other text, and any text that might hold a special token,
    goes through the tokenizer itself.
    """

    #: Characters whose normal form, lower case and class are the same in every Unicode version.
    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-įĲ-ňŊ-ž]*")
    WORDS = re.compile(r"[a-zß-öø-ÿā-ž]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ÿā-ž0-9\s]+")

    def __init__(self, path: str, max_words: int = 200_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = max(self.tokenizer.get_vocab().values(), default=0) + 1
        self.known = _Words(self.tokenizer.model, ids, max_words)

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its token closes a sentence."""
        vocabulary = self.tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, number in vocabulary.items():
            ends[number] = re.fullmatch(r"[.!?]+[\"')\]]*", token.removesuffix("</w>")) is not None
        return ends

    def encode(self, text: str) -> np.ndarray:
        if "<|" in text or self.PLAIN.fullmatch(text) is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.WORDS.findall(text.lower()))), dtype="<u4")


def plan_cuts(bounds: np.ndarray, penalty: np.ndarray, window: int = WINDOW, window_cost: float = WINDOW_COST, least_exact: int = LEAST_EXACT) -> list[int]:
    """Indices into ``bounds`` of the cheapest cuts, first and last included.

    ``bounds`` rises from 0 with steps of at most ``window``.
    """
    at, fee, n = bounds.tolist(), penalty.tolist(), len(bounds)
    exact: dict[int, list[int]] = {}
    size = least_exact
    while size < window:
        start = np.searchsorted(bounds, bounds - size)
        for j in np.flatnonzero((bounds >= size) & (bounds[np.minimum(start, n - 1)] == bounds - size)).tolist():
            exact.setdefault(j, []).append(int(start[j]))
        size *= 2
    cost, back = [0.0] * n, [0] * n
    queue, key, head = [0], [0.0], 0
    for j in range(1, n):
        b = at[j]
        while b - at[queue[head]] > window:
            head += 1
        best, start = key[head] + window - b, queue[head]
        for i in exact.get(j, ()):
            if cost[i] < best:
                best, start = cost[i], i
        cost[j], back[j] = best + fee[j] + window_cost, start
        mine = cost[j] + b
        while len(queue) > head and key[-1] >= mine:
            queue.pop()
            key.pop()
        queue.append(j)
        key.append(mine)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def _bounds(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stretch may be cut and what a cut there costs.

    The end of a stream may also be cut at multiples of ``LEAST_EXACT`` before its end, and
    anywhere in its last ``LEAST_EXACT``, so that its last tokens can go to windows of powers of two.
    """
    places = np.union1d(np.flatnonzero(sentence_ends[ids]) + 1, doc_ends)
    places = np.concatenate(([0], places[places > 0]))
    steps = np.diff(places)
    wide = np.flatnonzero(steps > window)
    forced = [np.arange(places[k] + window, places[k + 1], window) for k in wide]
    fees = np.full(len(places), SENTENCE_PENALTY)
    fees[np.isin(places, doc_ends)] = 0.0
    if last:
        tail = np.concatenate((np.arange(1, LEAST_EXACT), LEAST_EXACT * np.arange(1, 2 * window // LEAST_EXACT)))
        forced.append(np.setdiff1d(len(ids) - tail, places))
    if forced:
        more = np.concatenate(forced)
        more = np.setdiff1d(more[more > 0], places)
        places, fees = np.concatenate((places, more)), np.concatenate((fees, np.full(len(more), FORCED_PENALTY)))
        order = np.argsort(places, kind="stable")
        places, fees = places[order], fees[order]
    return places, fees


def _pack_stream(batches: Iterator[pa.RecordBatch], path: str | Callable[[], str], window: int, end_id: int, stretch: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 32
    tokenizer = WordTokenizer(path() if callable(path) else path)
    ends = tokenizer.sentence_ends()
    ends = np.concatenate((ends, np.zeros(max(0, end_id + 1 - len(ends)), dtype=bool)))
    names, parts, skipped = [], [], []  # of the documents in the buffer: id, tokens, tokens already placed
    held = 0

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal sequence, held
        ids = np.concatenate(parts)
        doc_ends = np.cumsum([len(p) for p in parts])
        places, fees = _bounds(ids, doc_ends, ends, window, last)
        cuts = places[plan_cuts(places, fees, window, least_exact=1 if last else LEAST_EXACT)]
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts
        till = int(cuts[-1])
        points = np.union1d(cuts, doc_ends[doc_ends < till])
        begin, end = points[:-1], points[1:]
        doc = np.searchsorted(doc_ends, begin, side="right")
        own = np.searchsorted(cuts, begin, side="right") - 1
        doc_begin = doc_ends - np.array([len(p) for p in parts])
        done = np.array(skipped, dtype=np.int64)
        whole = np.array([len(p) for p in parts], dtype=np.int64) + done
        data = pa.py_buffer(ids[:till].astype("<u4").tobytes())
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([names[k] for k in doc.tolist()], pa.int64()),
                pa.array(begin - doc_begin[doc] + done[doc], pa.int64()),
                pa.array(end - begin, pa.int64()),
                pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((points * 4).astype(np.int32).tobytes()), data]),
                pa.array(whole[doc], pa.int64()),
                pa.array(sequence + own, pa.int64()),
                pa.array(begin - cuts[own], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_le", "doc_tokens", "sequence_id", "offset"],
        )
        sequence += len(cuts) - 1
        keep = int(np.searchsorted(doc_ends, till, side="right"))
        del names[:keep], parts[:keep], skipped[:keep]
        if parts:
            cut = till - int(doc_begin[keep])
            parts[0], skipped[0] = parts[0][cut:], skipped[0] + cut
        held = sum(map(len, parts))
        return out

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = tokenizer.encode(text or "")
            names.append(name)
            parts.append(np.append(found, np.uint32(end_id)))
            skipped.append(0)
            held += len(found) + 1
            while held >= stretch:
                before = held
                yield flush(last=False)
                if held == before:
                    break
    if parts:
        yield flush(last=True)


def pack(docs: DataFrame, tokenizer_path: str | Callable[[], str], *, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` tokens.

    Returns ``PIECES``: ``ids_le`` holds the piece's ids as little-endian unsigned
    32-bit integers, ``sequence_id`` is unique in the result, ``offset`` is the
    piece's place in its sequence. The order of a partition's documents is kept. A function
    as ``tokenizer_path`` is called on the executors.
    """
    ship_package(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(lambda batches: _pack_stream(batches, tokenizer_path, window, end_id, stretch), PIECES)


def padding(lengths: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per sequence: its tokens and its padding; a power of two needs none."""
    per = lengths.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    return per.withColumn("padding", F.when(F.bit_count("tokens") == 1, F.lit(0)).otherwise(F.lit(window) - F.col("tokens")))
