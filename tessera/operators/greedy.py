"""Operators whose results depend on an order of single steps, run group by group with Arrow."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_masked(data: Column, find: str, put: str, most: int | None = None) -> Column:
    """Bytes with each hit of a pattern, from the left and without overlap, overwritten; ``??`` fits any byte, or leaves it."""
    mask = [None if p == "??" else int(p, 16) for p in find.split()]
    new = [None if p == "??" else int(p, 16) for p in put.split()]

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        def one(value):
            if value is None:
                return None
            out, at, done = bytearray(value), 0, 0
            while at + len(mask) <= len(out) and (most is None or done < most):
                if all(m is None or out[at + k] == m for k, m in enumerate(mask)):
                    for k, b in enumerate(new):
                        if b is not None and at + k < len(out):
                            out[at + k] = b
                    at, done = at + len(mask), done + 1
                else:
                    at += 1
            return bytes(out)

        return values.map(one)

    return run(data)


def suppress_overlaps(spans: DataFrame, key: str, share: float = 0.5, stretch: int = 64) -> DataFrame:
    """Spans (key, begin, end, score) kept from the best score down, unless ``share`` of one is covered by a kept span.

    A key is one image's or text's candidates and stays in one task. Kept spans are looked
    up by the stretches that they touch. Spans of no length are kept; ties go to the
    smaller begin, then end; rows with a null begin or end are left out.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        touched: dict[int, list[tuple[int, int]]] = {}
        best = []
        rows = rows.dropna(subset=["begin", "end"]).sort_values(["score", "begin", "end"], ascending=[False, True, True], kind="stable")
        for k, (a, b) in enumerate(zip(rows["begin"], rows["end"], strict=True)):
            places = range(int(a // stretch), int(b // stretch) + 1)
            near = {span for place in places for span in touched.get(place, ())}
            if b <= a or all(min(b, d) - max(a, c) < share * (b - a) for c, d in near):
                for place in places:
                    touched.setdefault(place, []).append((a, b))
                best.append(k)
        return rows.iloc[best]

    return spans.groupBy(key).applyInPandas(run, spans.schema)


def seed_clusters(sets: DataFrame, key: str, name: str, items: str, least: float = 0.5) -> DataFrame:
    """Greedy clusters (key, name, seed): a set joins the first seed it overlaps by Jaccard, in order of name, or becomes one.

    A key's sets stay in one task; only seeds that share an item are compared. A null set
    counts as empty, and empty sets are alone.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        seeds: list[tuple[object, int]] = []
        holding: dict[object, list[int]] = {}
        found = []
        rows = rows.sort_values(name, kind="stable")
        for n, own in zip(rows[name], (set(() if x is None else x) for x in rows[items]), strict=True):
            shared = Counter(s for item in own for s in holding.get(item, ()))
            near = [s for s, both in shared.items() if both >= least * (len(own) + seeds[s][1] - both)]
            if near:
                found.append(seeds[min(near)][0])
                continue
            for item in own:
                holding.setdefault(item, []).append(len(seeds))
            seeds.append((n, len(own)))
            found.append(n)
        return pd.DataFrame({key: rows[key], name: rows[name], "seed": found})

    kinds = dict(sets.dtypes)
    return sets.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {name} {kinds[name]}, seed {kinds[name]}")
