"""Exact top-k by inner product over a bit-sliced index.

The components of integer vectors are stored by bit: for each block of rows, each
attribute and each binary digit of (component - the attribute's least), one bitmap
over the block's rows. A query's scores for a whole block come from bitmap arithmetic
alone: every set bit of a weight adds an attribute's slices (complemented for a
negative weight), shifted to their place, by carry-save adders, until one bitmap is
left per digit of the sum. The best rows are then chosen from the most significant
slice downward; rows still tied at the boundary are resolved by id, and the chosen
rows' scores are computed exactly.

All rows meet all queries: rows in blocks of at most about ``BLOCK_ROWS``, whose bitmaps
are built once, and queries streaming past every block, each meeting yielding k rows a
query. Components of ``LARGEST`` or more stay out of the bitmaps: their vectors are
scored in whole numbers of any size.

Edge cases: vectors that are null or hold a null or non-finite component take no part,
nor do rows with a null id; scores beyond 64 bits count as the largest or smallest
number of 64 bits; an empty vector scores 0, and vectors are compared with those of the
same length only; ties go to the smaller id; repeated ids count as rows, a query is
asked once and its own id is no candidate; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .blocks import matrix, meet
from .common import cut_lineage

#: Rows of a block at most, and at least where there are more tasks than blocks.
BLOCK_ROWS, LEAST_ROWS = 1 << 16, 1 << 14
LARGEST = float(1 << 24)
HITS = "query_id long, vec_id long, score long"


class SlicedBlock:
    """The bitmaps of a block of rows, sorted by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.int64)
        count = len(ids)
        words = -(-count // 64)
        self.every = self._pack(np.ones(count, dtype=bool), words)
        self.least = self.rows.min(axis=0) if count else np.zeros(rows.shape[1], dtype=np.int64)
        spread = (self.rows - self.least).astype(np.uint64)
        self.digits = [int(m).bit_length() for m in spread.max(axis=0)]
        slices, self.begin = [], np.cumsum([0, *self.digits])
        for a, digits in enumerate(self.digits):
            slices += [self._pack((spread[:, a] >> np.uint64(b)) & np.uint64(1) == 1, words) for b in range(digits)]
        self.slices = np.array(slices, dtype=np.uint64).reshape(len(slices), words)

    @staticmethod
    def _pack(bits: np.ndarray, words: int) -> np.ndarray:
        out = np.zeros(words * 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """The bitmaps of all rows' scores less a constant, least significant first."""
        places: dict[int, list[tuple[int, bool]]] = {}
        for a, weight in enumerate(query.tolist()):
            size = abs(weight)
            for c in range(size.bit_length()):
                if size >> c & 1:
                    for b in range(self.digits[a]):
                        places.setdefault(b + c, []).append((int(self.begin[a]) + b, weight < 0))
        out, carried, at = [], np.zeros((0, len(self.every)), dtype=np.uint64), 0
        while places or len(carried):
            new = places.pop(at, [])
            taken = self.slices[[s for s, _ in new]] if new else carried[:0]
            turned = [k for k, (_, flip) in enumerate(new) if flip]
            taken[turned] ^= self.every
            table, carries = np.concatenate((carried, taken)), []
            while len(table) > 2:
                t = len(table) // 3
                a, b, c = table[:t], table[t : 2 * t], table[2 * t : 3 * t]
                half = a ^ b
                carries.append((a & b) | (half & c))
                table = np.concatenate((half ^ c, table[3 * t :]))
            if len(table) == 2:
                carries.append((table[0] & table[1])[None])
                table = (table[0] ^ table[1])[None]
            out.append(table[0] if len(table) else np.zeros_like(self.every))
            carried = np.concatenate(carries) if carries else carried[:0]
            at += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Ids and scores of the k best rows other than the query's own, ties to the smaller id."""
        even = self.every.copy()
        own = slice(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, side="right"))
        for row in range(own.start, own.stop):
            even[row >> 6] &= ~np.uint64(1 << (row & 63))
        sure, count = np.zeros_like(even), 0
        for digit in reversed(self.sums(query)):
            more = even & digit
            size = int(np.bitwise_count(more).sum())
            if count + size > k:
                even = more
            else:
                sure |= more
                count += size
                even &= ~digit
                if count == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if count < k:
            rows = np.concatenate((rows, np.flatnonzero(np.unpackbits(even.view(np.uint8), bitorder="little"))[: k - count]))
        return list(zip(self.ids[rows].tolist(), (self.rows[rows] @ query).tolist(), strict=True))


class Block:
    """A block's rows: bitmaps of those of small components, and the others as whole numbers."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        small = (np.abs(rows) < LARGEST).all(axis=1)
        self.sliced = SlicedBlock(ids[small], rows[small]) if small.any() else None
        self.ids, self.large = ids[~small], whole(rows[~small])

    def top(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Ids and scores of the k best rows other than the query's own, ties to the smaller id."""
        if self.sliced is None:
            found = []
        elif (np.abs(query) < LARGEST).all():
            found = self.sliced.top(query_id, query.astype(np.int64), k)
        else:
            found = [*zip(self.sliced.ids.tolist(), self.sliced.rows.astype(object) @ whole(query), strict=True)]
        if len(self.ids):
            found += zip(self.ids.tolist(), self.large @ whole(query), strict=True)
        return sorted(((n, int(s)) for n, s in found if n != query_id), key=lambda h: (-h[1], h[0]))[:k]


def whole(x: np.ndarray) -> np.ndarray:
    """Integral floats as whole numbers of any size."""
    return np.array([int(c) for c in x.ravel().tolist()], dtype=object).reshape(x.shape)


def quantised(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: floor(scale * component) as a double, of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    good = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good)

    def floor(c: Column) -> Column:  # floor() gives longs; from 2^53 on a double is whole
        y = F.greatest(F.least(c * scale, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max))
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, floor).alias("v"))


def search(vectors: DataFrame, asks: Column, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each row for which ``asks`` holds.

    ``asks`` is a condition on ``vec_id``.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = cut_lineage(quantised(vectors, scale, id_col, vector_col)).withColumn("width", F.size("v"))
    count, tasks = rows.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-count // BLOCK_ROWS), min(tasks, -(-count // LEAST_ROWS)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    right = rows.where(asks).dropDuplicates(["vec_id"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def build(members: pa.Table) -> Block:
        members = members.combine_chunks().to_batches()[0]
        return Block(members.column("vec_id").to_numpy(), matrix(members.column("v"), int(members.column("width")[0].as_py())))

    def ask(block: Block, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = queries.column("vec_id").to_pylist()
        found = [(q, n, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, v in zip(ids, matrix(queries.column("v"), int(queries.column("width")[0].as_py())), strict=True) for n, s in block.top(q, v, k)]
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    hits = meet(left, right, ["block", "width"], blocks, build, ask, HITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
