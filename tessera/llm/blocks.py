"""Queries that stream past blocks of rows.

Rows and queries are sent to the same tasks and sorted so that a block's rows come before
the queries that ask it. A task holds one block and one batch of queries at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array column whose rows all have ``width`` elements."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def meet(rows: DataFrame, queries: DataFrame, keys: list[str], tasks: int, build: Callable[[pa.Table], Any], ask: Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``ask`` finds for each batch of ``queries`` in what ``build`` makes of the block of ``rows`` with the same keys.

    Both frames have the keys (integers) and otherwise equal columns. Blocks without rows are not asked.
    """
    names = [c for c in rows.columns if c not in keys]
    both = [frame.select(*keys, F.lit(kind).alias("__kind"), *names) for kind, frame in enumerate((rows, queries))]
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns[: width + 1]]
            begins = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *begins], [*begins, batch.num_rows], strict=True):
                key = tuple(int(c[a]) for c in columns[:width])
                if key != last:
                    held, block, last = [], None, key
                part = batch.slice(a, b - a)
                if not columns[width][a]:
                    held.append(part)
                    continue
                if held and block is None:
                    block, held = build(pa.Table.from_batches(held)), []
                if block is not None:
                    yield from ask(block, part)

    dealt = both[0].unionAll(both[1]).repartition(tasks, *keys).sortWithinPartitions(*keys, "__kind")
    return dealt.mapInArrow(run, schema)
