"""Maps found without a definition, consensus of matching changes, and algorithms matched by description."""

from __future__ import annotations

import math
import re
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .images import axes_of

#: The widest gap between two axes, the widths of cells, and the least number of cells.
WIDEST_GAP, WIDTHS, LEAST_CELLS = 256, (1, 2, 4), 5
#: Weights of ``evidence``: what ``fit_evidence`` finds on 60 made images (tests/planted.py, seed 1).
KNOWN_WEIGHTS = (-16.642, 2.483, 3.286, -1.364, 10.231, 7.013, 0.542, -2.747)
SEEN_WEIGHTS = (6.008, -11.779, -6.625, -18.166, 1.226, -20.964)
#: Pairs of axes, and cells of candidates, that are judged at once; what the odds of many at once may differ from those of one.
PAIRS, CELLS_AT_ONCE, ROUNDING = 20_000, 500_000, 1e-6
#: Kept maps are looked up by the stretches of this many bytes that they touch.
STRETCH = 1024


def known_evidence(columns: int, rows: int, width: int, axis_width: int, axis_score: float) -> tuple[float, ...]:
    """What is known of a candidate before its cells are read."""
    return (1.0, math.log2(columns), math.log2(rows), float(rows == 1), axis_score / 100, float(width == axis_width), float(width == 1), float(width == 4))


def seen_evidence(values: np.ndarray) -> tuple[float, ...]:
    """What the cells (rows, columns) show against a map, each from 0 to 1.

    Mean bends along rows and columns, within the cells' range and as a share of twice the
    mean steps; equal neighbours; flatness.
    """
    span = float(values.max() - values.min())
    if span == 0:
        return (0.0, 0.0, 0.0, 0.0, 1.0, 1.0)
    steps, out = (values[:, 1:] - values[:, :-1], values[1:] - values[:-1]), []
    for step, bend in zip(steps, (steps[0][:, 1:] - steps[0][:, :-1], steps[1][1:] - steps[1][:-1]), strict=True):
        bends = float(np.abs(bend).sum()) / bend.size if bend.size else 0.0
        mean = float(np.abs(step).sum()) / step.size if step.size else 0.0
        out += [min(1.0, bends / span), min(1.0, bends / (2 * mean)) if mean else 0.0]
    return (*out, 1.0 - np.count_nonzero(steps[0]) / steps[0].size if steps[0].size else 0.0, 0.0)


def fit_evidence(known: list, seen: list, labels: list, ridge: float = 1.0, rounds: int = 60) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Weights by logistic regression (Newton's method, with a ridge); both labels weigh the same."""
    x, y = np.hstack([np.array(known, dtype=float), np.array(seen, dtype=float)]), np.array(labels, dtype=float)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (chance - y)) + ridge * w
        w -= np.linalg.solve((x * (share * chance * (1 - chance))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    w = np.round(w, 3).tolist()
    return tuple(w[: len(known[0])]), tuple(w[len(known[0]) :])


def _blocks(data: bytes, big_endian_axes: bool):
    """Arrays of ``candidates``, some ``PAIRS`` pairs of axes at once."""
    for axis_width, big in ((1, False), (2, False), *(((2, True),) if big_endian_axes else ())):
        axes = axes_of(data, axis_width, big)
        starts, counts = (np.array([a[k] for a in axes], dtype=np.int64) for k in (0, 1))
        scores = np.array([a[3] for a in axes], dtype=np.float64)
        ends = starts + counts * axis_width
        follow = np.searchsorted(starts, ends)
        pairs = 1 + np.searchsorted(starts, ends + WIDEST_GAP, side="right") - follow
        total, low = np.cumsum(pairs), 0
        while low < len(axes):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(low, high), pairs[low:high])
            k = np.arange(len(i)) - np.repeat(np.cumsum(pairs[low:high]) - pairs[low:high], pairs[low:high])
            alone, j = k == 0, np.where(k == 0, i, follow[i] + k - 1)
            m, score = np.where(alone, 1, counts[j]), np.where(alone, scores[i], (scores[i] + scores[j]) / 2)
            enough = counts[i] * m >= LEAST_CELLS
            start, end, n, m, score = (np.repeat(c[enough], 2 * len(WIDTHS)) for c in (starts[i], ends[j], counts[i], m, score))
            width = np.tile(np.repeat(WIDTHS, 2), np.count_nonzero(enough))
            at = np.where(np.arange(len(end)) % 2 == 0, end, start - n * m * width)
            inside = (at >= 0) & (at <= len(data) - n * m * width)
            yield (*(c[inside] for c in (at, n, m, width)), big, axis_width, score[inside])
            low = high


def candidates(data: bytes, big_endian_axes: bool = False):
    """``offset, columns, rows, width, big_endian, axis_width, axis_score``: cells right behind or right before one axis, or two of a kind within ``WIDEST_GAP`` bytes."""
    for at, n, m, width, big, axis_width, axis_score in _blocks(data, big_endian_axes):
        yield from ((*c, big, axis_width, s) for *c, s in zip(at.tolist(), n.tolist(), m.tolist(), width.tolist(), axis_score.tolist()))


def _seen_odds(decoded: np.ndarray, at: np.ndarray, n: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """What ``seen_evidence`` adds to the odds of many candidates; ``decoded`` has the number at each offset. Sums are of whole numbers."""
    size = n * m
    begin = np.cumsum(size) - size
    pos = np.arange(size.sum()) - np.repeat(begin, size)
    v = decoded[np.repeat(at, size) + pos * width].astype(np.int64)
    span = np.maximum.reduceat(v, begin) - np.minimum.reduceat(v, begin)
    columns, here = np.repeat(n, size), np.arange(len(v))
    column, left = pos % columns, np.repeat(size, size) - pos
    odds, last = np.zeros(len(at)), len(v) - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        for apart, one, two, steps, bends, (of_bends, of_share) in ((1, column < columns - 1, column < columns - 2, m * (n - 1), m * (n - 2), SEEN_WEIGHTS[:2]), (columns, left > columns, left > 2 * columns, (m - 1) * n, (m - 2) * n, SEEN_WEIGHTS[2:4])):
            step = np.where(one, v[np.minimum(here + apart, last)] - v, 0)
            bend = np.where(two, step[np.minimum(here + apart, last)] - step, 0)
            mean = np.where(steps > 0, np.add.reduceat(np.abs(step), begin) / steps, 0.0)
            bent = np.where(bends > 0, np.add.reduceat(np.abs(bend), begin) / bends, 0.0)
            odds += of_bends * np.minimum(1.0, bent / span) + np.where(mean > 0, of_share * np.minimum(1.0, bent / (2 * mean)), 0.0)
            if apart is not columns:
                equal = 1.0 - np.add.reduceat((step != 0).astype(np.int64), begin) / steps
        return np.where(span > 0, odds + SEEN_WEIGHTS[4] * equal, SEEN_WEIGHTS[4] + SEEN_WEIGHTS[5])


def _best_seen() -> float:
    """The most that cells can add to the odds: a share of bends is at least half of the same bends within the range, as no mean step is wider than it."""
    pair = lambda bends, share: max(0.0, share, bends + share / 2, bends + share)
    return pair(*SEEN_WEIGHTS[:2]) + pair(*SEEN_WEIGHTS[2:4]) + sum(max(0.0, w) for w in SEEN_WEIGHTS[4:])


def _promising(data: bytes, big_endian_axes: bool, wanted: float):
    """The ``candidates`` whose odds, worked out many at once, are ``wanted`` or within ``ROUNDING`` of it."""
    raw = np.frombuffer(data, np.uint8)
    decoded: dict[tuple[int, bool], np.ndarray] = {}
    # what is known must reach this much, with the best that the cells could show
    enough = wanted - _best_seen() - ROUNDING
    for at, n, m, width, big, axis_width, axis_score in _blocks(data, big_endian_axes):
        known = (1.0, np.log2(n), np.log2(m), m == 1, axis_score / 100, width == axis_width, width == 1, width == 4)
        odds = sum(w * e for w, e in zip(KNOWN_WEIGHTS, known, strict=True))
        for w in WIDTHS:
            chosen = np.flatnonzero((width == w) & (odds >= enough))
            if len(chosen) and (w, big) not in decoded:
                cells = np.zeros(len(raw) - w + 1, dtype=np.uint32)
                for k in range(w):
                    cells |= raw[k : k + len(cells)].astype(np.uint32) << np.uint32(8 * (w - 1 - k if big else k))
                decoded[w, big] = cells
            ends = np.cumsum(n[chosen] * m[chosen])
            low = 0
            while low < len(chosen):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS_AT_ONCE, side="right")))
                c = chosen[low:high]
                c = c[odds[c] + _seen_odds(decoded[w, big], at[c], n[c], m[c], w) >= wanted - ROUNDING]
                yield from ((*k, w, big, axis_width, s) for *k, s in zip(at[c].tolist(), n[c].tolist(), m[c].tolist(), axis_score[c].tolist()))
                low = high


def maps_of(data: bytes, big_endian_axes: bool = False, least: float = 95.0) -> list[tuple[int, int, int, int, bool, float]]:
    """``offset, columns, rows, width, big_endian, score`` of likely maps, best first.

    The score is the chance, in percent, that a logistic model of the evidence gives. Cells
    are read only where they could lift the score to ``least``. A candidate goes if half of it lies in a better one; ties by offset.
    """
    wanted = math.log(least / (100 - least))
    kinds = {(w, b): np.dtype(f"{'>' if b else '<'}u{w}") for w in WIDTHS for b in (False, True)}
    found: dict[tuple, float] = {}
    for at, n, m, width, big, axis_width, axis_score in _promising(data, big_endian_axes, wanted):
        values = np.frombuffer(data, kinds[width, big], n * m, at).astype(np.float64).reshape(m, n)
        odds = sum(map(mul, KNOWN_WEIGHTS, known_evidence(n, m, width, axis_width, axis_score)))
        odds += sum(map(mul, SEEN_WEIGHTS, seen_evidence(values)))
        if odds >= wanted:
            key = (at, n, m, width, big)
            found[key] = max(found.get(key, 0.0), 100 / (1 + math.exp(-odds)))
    kept: list = []
    touched: dict[int, list[tuple[int, int]]] = {}
    for key, score in sorted(found.items(), key=lambda c: (-c[1], c[0])):
        begin, size = key[0], key[1] * key[2] * key[3]
        stretches = range(begin // STRETCH, (begin + size - 1) // STRETCH + 1)
        near = {span for k in stretches for span in touched.get(k, ())}
        if all(2 * (min(b, begin + size) - max(a, begin)) < size for a, b in near):
            kept.append((*key, score))
            for k in stretches:
                touched.setdefault(k, []).append((begin, begin + size))
    return kept


def likely_maps(data: Column, big_endian_axes: bool = False) -> Column:
    """Array of ``maps_of`` for a binary column; null for null."""

    @F.pandas_udf("array<struct<offset: int, columns: int, rows: int, width: int, big_endian: boolean, score: double>>")
    def run(images: pd.Series) -> pd.Series:
        names = ("offset", "columns", "rows", "width", "big_endian", "score")
        return pd.Series([None if x is None else [dict(zip(names, m)) for m in maps_of(x, big_endian_axes)] for x in images], dtype=object)

    ship_package(SparkSession.active())
    return run(data)


def gated_consensus(voices: DataFrame, baseline: DataFrame, keys: list[str], gap: int = 16, least: float = 0.9) -> DataFrame:
    """Mean and population deviation of the changes at each address, by the voices whose originals fit the baseline.

    ``voices``: keys, voice, address, before, after, of changed cells alone. ``baseline``:
    keys, address, value. Addresses at most ``gap`` apart make a region (its first
    address); a voice counts in a region if at least ``least`` of its originals there
    equal the baseline. The regions come from distinct addresses, one image's at a time.
    """
    order = Window.partitionBy(*keys).orderBy("address")
    starts = F.when(F.col("address") - F.lag("address").over(order) <= gap, F.lit(None)).otherwise(F.col("address"))
    regions = voices.select(*keys, "address").distinct().withColumn("start", starts).withColumn("region", F.last("start", ignorenulls=True).over(order)).drop("start")
    placed = voices.join(regions, [*keys, "address"]).join(baseline, [*keys, "address"], "left")
    fit = placed.groupBy(*keys, "region", "voice").agg(F.avg(F.when(F.col("value").isNotNull(), (F.col("before") == F.col("value")).cast("double"))).alias("fit")).where(F.col("fit") >= least).drop("fit")
    delta = F.col("after") - F.col("before")
    return placed.join(fit, [*keys, "region", "voice"]).groupBy(*keys, "region", "address").agg(F.count("*").alias("voices"), F.avg(delta).alias("mean"), F.stddev_pop(delta).alias("deviation"))


# fixed values: families with the points for naming one in both texts, brands, and the points of the general algorithm
FAMILY_POINTS = {"EDC17": 50, "EDC16": 50, "EDC15": 50, "MED17": 80, "MEDVC17": 100, "MED9": 40, "MED7": 40, "ME7": 40, "ME9": 40, "ME2": 40, "SIMOS": 40, "PCR": 30, "PPD": 30, "SID": 30, "MSS": 30, "MSV": 30, "MSD": 30, "MS41": 35, "MS45": 35, "BMS": 30, "TC1797": 40, "TC1793": 80, "TC179": 70, "TC176": 70, "MPC55": 35}
BRANDS = ("BOSCH", "SIEMENS", "DELPHI", "DENSO", "MARELLI", "MOTOROLA", "CONTINENTAL", "VISTEON", "LUCAS", "SAGEM", "VALEO")
GENERAL_NUMBER, GENERAL_POINTS, GENERAL_FOR = 94, 200, ("MED17", "EDC17", "TC179", "TC176", "TC172", "MEDVC17")


def algorithm_score(description: Column, number: Column, wanted: str) -> Column:
    """Points of an algorithm for a control unit's type: its text, words, family and brand; null for an empty description."""
    q = wanted.upper().strip()
    has = lambda part: F.contains(F.upper(description), F.lit(part))
    terms = [F.when(has(q), 100).otherwise(0)]
    terms += [F.when(has(w), 3 * len(w)).otherwise(0) for w in re.split(r"[\s./,_-]+", q) if len(w) >= 2]
    terms += [F.when(has(k), points).otherwise(0) for k, points in FAMILY_POINTS.items() if k in q]
    terms += [F.when(has(b), 0).otherwise(-20) for b in BRANDS if b in q]
    if any(k in q for k in GENERAL_FOR):
        terms.append(F.when(number == GENERAL_NUMBER, GENERAL_POINTS).otherwise(0))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when((description != "") & F.lit(q != ""), total)
