"""Connected components by randomised contraction.

Each round, every node points at the node of its neighbourhood that comes first
(itself included), and the edges are rewritten to the nodes pointed at. First is, by
turns, the smallest node and the one with the smallest hash of that round: with the
hash, the nodes with edges shrink in expectation by a constant factor, whatever the shape
of the graph, so a chain of a million links takes about as many rounds as a star.
Before a round, tasks of at most ``HELD`` edges each replace them by a spanning forest
of stars; that shortens long chains without a shuffle, and a graph that fits one task
is done. The pointers of the rounds are composed from the last to the first. Minima are
combined before the shuffle and the rewriting is by sorted joins, which adaptive
execution splits where one node has a large share of all edges; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import cut_lineage, shuffled


#: Edges that a task holds at once.
HELD = 200_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every ``HELD`` edges, a star for each of their components."""
    parent: dict = {}
    count, kind = 0, None

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def flush() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in parent]
        kept = [(a, b) if a < b else (b, a) for a, b in pairs if a != b]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in kept], kind), pa.array([b for _, b in kept], kind)], names=["u", "v"])

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        count += batch.num_rows
        if count >= HELD:
            yield flush()
            parent.clear()
            count = 0
    if parent:
        yield flush()


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, root`` for every node of an edge that joins two nodes; equal roots mean connected.

    Edges with a null end and loops are ignored; repeated and reversed edges count once.
    Without edges the result has no rows. A root is one of the component's nodes.
    """
    ship_package(edges.sparkSession)
    a, b = F.col(left), F.col(right)
    now = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    now = cut_lineage(now)
    rounds: list[DataFrame] = []
    while count := now.count():
        now = cut_lineage(now.coalesce(-(-count // HELD)).mapInArrow(_stars, now.schema))
        if count <= HELD:
            rounds.append(now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(now.select("u", "u").distinct()))
            break
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(now.select(F.col("v"), F.col("u")))
        if len(rounds) % 2:
            seed = F.lit(len(rounds))
            first = ends.groupBy("node").agg(F.min_by("other", F.xxhash64("other", seed)).alias("other"))
            other = F.when(F.xxhash64("node", seed) <= F.xxhash64("other", seed), F.col("node")).otherwise(F.col("other"))
        else:  # stars around their smallest node, as partitions leave them, are done at once
            first = ends.groupBy("node").agg(F.min("other").alias("other"))
            other = F.least("node", "other")
        pointers = cut_lineage(first.select("node", other.alias("root")))
        rounds.append(pointers)
        of_u = pointers.select(F.col("node").alias("u"), F.col("root").alias("new_u"))
        of_v = pointers.select(F.col("node").alias("v"), F.col("root").alias("new_v"))
        moved = now.join(shuffled(of_u), "u").join(shuffled(of_v), "v")
        moved = moved.select(F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v")).where("u <> v").distinct()
        now = cut_lineage(moved)

    def compose(later: DataFrame, earlier: DataFrame) -> DataFrame:
        onward = later.select(F.col("node").alias("__root"), F.col("root").alias("__onward"))
        return earlier.join(shuffled(onward), F.col("root") == F.col("__root"), "left").select("node", F.coalesce("__onward", "root").alias("root"))

    if not rounds:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return reduce(compose, reversed(rounds))
