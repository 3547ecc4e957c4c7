"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted by k-means on at most
about ``MAX_TRAIN`` vectors, chosen by a hash of the id. Every vector is indexed: its
nearest centroid's list, its residual's codes, and the vector itself for reranking.
A query probes its nearest lists. Members' distances are first taken from asymmetric
tables (the query stays exact, the members are codes): with c a list's centroid and r a
member's coded residual, the squared distance from q is |q - c|^2 + |r|^2 + 2 c r - 2 q r,
of which the middle is stored with the member and q r is looked up in one table a query.
The best ``RERANK`` different vectors of a group of lists are then measured exactly, in
double precision. How many lists are probed is measured on the sample: so many that
``TARGET`` of the true neighbours of some of its vectors, found there by brute force,
lie in probed lists.

Lists are dealt to groups of about ``GROUP_ROWS`` members; a longer list is split over
several. A group's members are built once and the queries that probe one of its lists
stream past, so a task holds a group and a batch, whatever share of all vectors or
queries one list has. Vectors are compared with those of as many components only. Each
number of components that ``LEAST_INDEXED`` vectors have, and the most frequent one, gets
its own index; the rest are compared exactly, in blocks.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part, nor do rows with a null id; equal vectors are ranked by id; of repeated
ids each row is a candidate and the query itself, by id, is none; with few candidates
all are returned; an empty table gives no rows. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .blocks import matrix, meet
from .common import cut_lineage
from .language import sampled

MAX_TRAIN = 20_000
MOST_LISTS = 4096
PARTS = 16
CODES = 256
RERANK = 1024
#: The share of the sample's true neighbours whose lists are to be probed, and the sample's queries it is measured on.
TARGET = 0.97
CALIBRATION = 300
#: Members of a group of lists at most, and at least where there are more tasks than groups.
GROUP_ROWS, LEAST_ROWS = 20_000, 5_000
LEAST_INDEXED = 5_000
#: Rows compared with all centroids at once.
ROWS_AT_ONCE = 512
HITS = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dimensions
    books: np.ndarray  # parts x codes x width
    width: int
    dimensions: int
    probes: int = 1

    def _split(self, residuals: np.ndarray) -> np.ndarray:
        parts, width = len(self.books), self.width
        full = np.zeros((len(residuals), parts * width))
        full[:, : self.dimensions] = residuals
        return full.reshape(len(residuals), parts, width)

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return _nearest(vectors, self.centroids)

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        split = self._split(vectors - self.centroids[lists])
        return np.stack([_nearest(split[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def constants(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """|r|^2 + 2 c r of members."""
        out = np.zeros(len(codes))
        centres = self._split(self.centroids)
        for p, book in enumerate(self.books):
            out += (book**2).sum(axis=1)[codes[:, p]] + 2 * (centres[:, p] @ book.T)[lists, codes[:, p]]
        return out

    def table(self, query: np.ndarray) -> np.ndarray:
        """Inner products of the query's parts with all codes."""
        return np.einsum("pcw,pw->pc", self.books, self._split(query[None])[0])


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None]


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    parts = [np.argmin(_distances(rows[k : k + ROWS_AT_ONCE], centres), axis=1) for k in range(0, len(rows), ROWS_AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(rows, axis=0)
    centres = distinct[np.sort(rng.choice(len(distinct), min(k, len(distinct)), replace=False))].copy()
    for _ in range(rounds):
        near = _nearest(rows, centres)
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, rows[:, d], minlength=len(centres)) for d in range(rows.shape[1])], axis=1)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


def _probes(train: np.ndarray, centroids: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """How many of the nearest lists hold ``TARGET`` of the k true neighbours within the sample."""
    lists = _nearest(train, centroids)
    deep = []
    for row in np.sort(rng.choice(len(train), min(len(train), CALIBRATION), replace=False)).tolist():
        near = ((train - train[row]) ** 2).sum(axis=1)
        near[row] = np.inf
        best = np.argsort(near, kind="stable")[: min(k, len(train) - 1)]
        place = np.argsort(np.argsort(_distances(train[row][None], centroids)[0], kind="stable"))
        deep += place[lists[best]].tolist()
    return int(np.quantile(deep, TARGET, method="higher")) + 1 if deep else len(centroids)


def fit(vectors: DataFrame, count: int, k: int, *, id_col: str, vector_col: str, max_train: int = MAX_TRAIN, seed: int = 3) -> Quantiser | None:
    """Centroids and codebooks; None without a usable vector."""
    rows = sampled(vectors, id_col, max_train).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).toPandas()
    if rows.empty:
        return None
    train = np.stack(rows.sort_values("id", kind="stable")["v"].to_numpy()).astype(np.float64)
    dimensions = train.shape[1]
    rng = np.random.default_rng(seed)
    centroids = _k_means(train, int(np.clip(round(np.sqrt(count)), 1, MOST_LISTS)), rng)
    width = -(-dimensions // min(PARTS, dimensions))
    parts = -(-dimensions // width)
    quantiser = Quantiser(centroids, np.zeros((parts, 1, width)), width, dimensions)
    split = quantiser._split(train - centroids[quantiser.nearest(train)])[:: max(1, len(train) // 8000)]
    books = [_k_means(split[:, p], CODES, rng, rounds=5) for p in range(parts)]
    most = max(map(len, books))
    quantiser.probes = _probes(train, centroids, k, rng)
    quantiser.books = np.stack([np.concatenate((b, np.repeat(b[:1], most - len(b), axis=0))) for b in books])
    return quantiser


@dataclass
class Group:
    """Members of some lists: different vectors, and for each the ids that have it, smallest first."""

    ids: np.ndarray
    begins: np.ndarray
    rows: np.ndarray
    lists: np.ndarray
    places: np.ndarray
    constants: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray | None, codes: np.ndarray | None, quantiser: Quantiser | None) -> Group:
        _, first, same = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, same))
        begins = np.append(np.searchsorted(same[order], np.arange(len(first))), len(ids))
        if quantiser is None:
            return cls(ids[order], begins, rows[first], np.zeros(0), np.zeros(0), np.zeros(0))
        places = codes[first].astype(np.int64) + np.arange(codes.shape[1]) * quantiser.books.shape[1]
        return cls(ids[order], begins, rows[first], lists[first], places, quantiser.constants(codes[first], lists[first]))

    def exact(self, query_id: int, query: np.ndarray, chosen: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k nearest of the chosen vectors, without the query itself."""
        far = np.sqrt(((self.rows[chosen] - query) ** 2).sum(axis=1))
        near = np.argsort(far, kind="stable")[: k + 1]
        near = np.flatnonzero(far <= far[near[-1]]) if len(near) else near
        hits: list[tuple[float, int]] = []
        # copies of a vector beyond its k + 1 smallest ids cannot be among the k nearest
        for u, d in zip(chosen[near].tolist(), far[near].tolist(), strict=True):
            hits += [(d, n) for n in self.ids[self.begins[u] : min(self.begins[u + 1], self.begins[u] + k + 1)].tolist()]
        return [(n, d) for d, n in sorted(h for h in hits if h[1] != query_id)[:k]]

    def probe(self, query_id: int, query: np.ndarray, lists: np.ndarray, quantiser: Quantiser, k: int) -> list[tuple[int, float]]:
        """The k nearest that the members' codes find in the given lists."""
        away = np.full(len(quantiser.centroids), np.inf)
        away[lists] = ((quantiser.centroids[lists] - query) ** 2).sum(axis=1)
        inside = np.flatnonzero(np.isfinite(away[self.lists]))
        near = away[self.lists[inside]] + self.constants[inside] - 2 * quantiser.table(query).ravel()[self.places[inside]].sum(axis=1)
        if len(near) > RERANK:
            inside = np.sort(inside[np.argpartition(near, RERANK)[:RERANK]])
        return self.exact(query_id, query, inside, k)


def _dealt(sizes: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list the first of the groups that it is dealt to, and over how many it is split; about as many members a group."""
    groups = max(1, -(-int(sizes.sum()) // GROUP_ROWS), min(tasks, -(-int(sizes.sum()) // LEAST_ROWS)))
    most = -(-int(sizes.sum()) // groups)
    splits = np.maximum(1, -(-sizes // most))
    first, load, at = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for n in range(len(sizes)):
        if splits[n] > 1 or load + sizes[n] > most:
            at, load = at + (load > 0), 0
        first[n] = at
        load += sizes[n]
        if splits[n] > 1:
            at, load = at + int(splits[n]), 0
    return first, splits


def _hits(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    query, vec, score = zip(*found, strict=True) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def _search_index(good: DataFrame, count: int, k: int, least_probes: int) -> DataFrame:
    """Hits of the queries among ``vec_id, embedding, asks`` of one number of components, by the index."""
    spark = good.sparkSession
    quantiser = fit(good, count, k, id_col="vec_id", vector_col="embedding")
    shared, dimensions = spark.sparkContext.broadcast(quantiser), quantiser.dimensions

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1), dimensions)
            lists = shared.value.nearest(rows)
            codes = shared.value.encode(rows, lists)
            yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["list", "vec_id", "codes", "embedding"])

    index = cut_lineage(good.select("vec_id", "embedding").mapInArrow(encode, "list int, vec_id long, codes binary, embedding array<double>"))
    sizes = np.zeros(len(quantiser.centroids), dtype=np.int64)
    for r in index.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    first, splits = _dealt(sizes, spark.sparkContext.defaultParallelism)
    groups = int((first + splits).max())
    plan = spark.sparkContext.broadcast((sizes, first, splits, max(least_probes, quantiser.probes)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, first, splits, probes = plan.value
        for batch in batches:
            at, asked, place = [], [], []
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = matrix(batch.column(1).slice(begin, ROWS_AT_ONCE), dimensions)
                for row, lists in enumerate(np.argsort(_distances(rows, shared.value.centroids), axis=1, kind="stable")):
                    enough = int(np.searchsorted(np.cumsum(sizes[lists]), k + 1)) + 1
                    chosen = lists[: max(probes, enough)]
                    chosen = chosen[sizes[chosen] > 0].astype(np.int32)
                    of = np.repeat(first[chosen], splits[chosen]) + np.concatenate([np.arange(n) for n in splits[chosen]])
                    chosen = np.repeat(chosen, splits[chosen])
                    for group in np.unique(of).tolist():
                        at.append(group)
                        asked.append(chosen[of == group].tobytes())
                        place.append(begin + row)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0).take(pa.array(place, pa.int64())), pa.array(asked, pa.binary()), batch.column(1).take(pa.array(place, pa.int64()))], names=["group", "vec_id", "codes", "embedding"])

    salts = F.broadcast(spark.createDataFrame([(n, int(first[n]), int(splits[n])) for n in range(len(sizes))], "list int, first int, splits int"))  # at most MOST_LISTS rows
    members = index.join(salts, "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("splits"))).cast("int").alias("group"), "vec_id", F.concat(F.unhex(F.lpad(F.hex("list"), 8, "0")), "codes").alias("codes"), "embedding")
    asking = good.where("asks").dropDuplicates(["vec_id"]).select("vec_id", "embedding").mapInArrow(probe, "group int, vec_id long, codes binary, embedding array<double>")

    def build(members: pa.Table) -> Group:
        batch = members.combine_chunks().to_batches()[0]
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
        lists = np.ascontiguousarray(codes[:, :4]).view(">i4").ravel().astype(np.int64)
        return Group.of(batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"), dimensions), lists, codes[:, 4:], shared.value)

    def ask(group: Group, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = zip(queries.column("vec_id").to_pylist(), matrix(queries.column("embedding"), dimensions), queries.column("codes").to_pylist(), strict=True)
        yield _hits([(q, n, d) for q, v, lists in rows for n, d in group.probe(q, v, np.frombuffer(lists, dtype=np.int32), shared.value, k)])

    return meet(members, asking, ["group"], groups, build, ask, HITS)


def _search_exact(good: DataFrame, counts: dict[int, int], k: int) -> DataFrame:
    """Hits of the queries among ``vec_id, embedding, asks``, each with all vectors of as many components."""
    rows = good.withColumn("width", F.size("embedding"))
    blocks = max(1, max(-(-n // GROUP_ROWS) for n in counts.values()))
    members = rows.select("width", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")
    asking = rows.where("asks").dropDuplicates(["vec_id"]).select("width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "embedding")

    def build(members: pa.Table) -> Group:
        batch = members.combine_chunks().to_batches()[0]
        return Group.of(batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"), batch.column("width")[0].as_py()), None, None, None)

    def ask(group: Group, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        every = np.arange(len(group.rows))
        yield _hits([(q, n, d) for q, v in zip(queries.column("vec_id").to_pylist(), matrix(queries.column("embedding"), queries.column("width")[0].as_py()), strict=True) for n, d in group.exact(q, v, every, k)])

    return meet(members, asking, ["width", "block"], blocks, build, ask, HITS)


def search(vectors: DataFrame, queries: Column, *, k: int = 10, least_probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row of ``vectors`` for which ``queries`` holds."""
    spark = vectors.sparkSession
    ship_package(spark)
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    good = named.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("embedding", F.col("embedding").cast("array<double>"))
    counts = {r["width"]: r["count"] for r in good.groupBy(F.size("embedding").alias("width")).count().collect()}  # numbers of components
    most = max(counts, key=lambda w: (counts[w], -w), default=None)
    few = {w: n for w, n in counts.items() if n < LEAST_INDEXED and w != most}
    parts = [_search_index(good.where(F.size("embedding") == w), n, k, least_probes) for w, n in sorted(counts.items()) if w not in few]
    if few or not parts:
        rest = good.where(~F.size("embedding").isin([w for w in counts if w not in few]))
        parts.append(_search_exact(rest, few or {0: 0}, k))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
