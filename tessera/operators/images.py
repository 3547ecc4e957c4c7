"""Operators over whole images, one row an image: sketches, byte alignment, structure, axes, block checksums.

Each takes a binary column, whose rows are as large as their files, and runs with
Arrow, an image at a time; nothing is gathered over rows. A null image gives null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

# Fixed values of the sketch.
SHINGLE = 64
BUCKETS = 128
BASE = 31
MODULUS = (1 << 63) - 25


def _times_small(h: np.ndarray, c: int) -> np.ndarray:
    """h * c modulo 2^63 - 25 for c < 2^22: 2^63 is 25 there, so the overflow of the upper half folds back."""
    high, low = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    high = high * np.uint64(c)
    total = (high >> np.uint64(31)) * np.uint64(25) + ((high & np.uint64(0x7FFFFFFF)) << np.uint64(32)) + low * np.uint64(c)
    return np.where(total >= MODULUS, total - np.uint64(MODULUS), total)


def _times(h: np.ndarray, c: int) -> np.ndarray:
    """h * c modulo 2^63 - 25, by 21-bit limbs of c from the top."""
    found = np.zeros_like(h)
    for limb in (c >> 42, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF):
        if c >= 1 << 21:
            found = _times_small(found, 1 << 21)
        if limb:
            found = found + _times_small(h, limb)
            found = np.where(found >= MODULUS, found - np.uint64(MODULUS), found)
    return found


def sketch_of(data: bytes) -> tuple[int, dict[int, int]]:
    """Bytes between the padding at both ends, and the least mixed hash of each bucket.

    A window's hash is built by doubling: that of 2n bytes is the first half's times
    31^n plus the second's. Windows of one repeated padding byte are left out.
    """
    raw = np.frombuffer(data.strip(b"\x00\xff"), np.uint8)
    if len(raw) < SHINGLE:
        return len(raw), {}
    h, n = raw.astype(np.uint64), 1
    while n < SHINGLE:
        h = _times(h[:-n], pow(BASE, n, MODULUS)) + h[n:]
        h = np.where(h >= MODULUS, h - np.uint64(MODULUS), h)
        n *= 2
    steps = np.concatenate(([0], np.cumsum(raw[1:] != raw[:-1])))
    flat = (steps[SHINGLE - 1 :] == steps[: len(h)]) & ((raw[: len(h)] == 0) | (raw[: len(h)] == 255))
    with np.errstate(over="ignore"):  # the 64-bit finaliser wraps round
        f = h[~flat] + np.uint64(0x9E3779B97F4A7C15)
        f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    f = np.maximum(f ^ (f >> np.uint64(31)), np.uint64(1))
    if not len(f):
        return len(raw), {}
    f = np.sort(f)  # so the first of a bucket is its least
    buckets, first = np.unique(f & np.uint64(BUCKETS - 1), return_index=True)
    return len(raw), {int(b): int(f[k]) for b, k in zip(buckets, first)}


def sketch(data: Column) -> Column:
    """``scanned, postings`` (bucket, hash) of an image; a hash is an unsigned number as a signed long."""

    @F.pandas_udf("scanned long, postings array<struct<bucket: int, hash: long>>")
    def run(images: pd.Series) -> pd.DataFrame:
        found = [sketch_of(x) if x is not None else (None, None) for x in images]
        rows = [None if s is None else [{"bucket": b, "hash": v - (1 << 64) if v >> 63 else v} for b, v in s.items()] for _, s in found]
        return pd.DataFrame({"scanned": pd.array([n for n, _ in found], "Int64"), "postings": rows})

    ship_package(SparkSession.active())
    return run(data)


def postings(images: DataFrame, key: str, data: str) -> DataFrame:
    """The index of images: ``key, bucket, hash``, one row a bucket that isn't empty."""
    return images.select(key, F.inline(sketch(F.col(data))["postings"]))


def similar(index: DataFrame, needles: DataFrame, key: str, least: int = 4) -> DataFrame:
    """Images sharing at least ``least`` bucket minima with a needle: ``needle, key, shared, percent``.

    Both sides are indexes as ``postings`` gives. A join on bucket and hash, counted
    before it is shuffled again. A minimum that a third of the images share is one
    key of the join, which adaptive execution splits.
    """
    wanted = needles.select(F.col(key).alias("needle"), "bucket", "hash")
    size = wanted.groupBy("needle").agg(F.count("*").alias("size"))
    met = index.join(wanted, ["bucket", "hash"]).groupBy("needle", key).agg(F.count("*").alias("shared")).where((F.col("shared") >= least) & (F.col("needle") != F.col(key)))
    return met.join(size, "needle").select("needle", key, "shared", (F.col("shared") * 100.0 / F.col("size")).alias("percent"))


def aligned_bytes(a: bytes, b: bytes, anchors: int = 8, width: int = 24, hits: int = 4, grid: int = 65536, exact: int = 4) -> tuple[int, int]:
    """Equal bytes and length of the smaller image where it fits best inside the larger.

    Places come from anchors of the smaller one found in the larger, and from a grid;
    every 64th byte ranks them, and the best few are compared in full.
    """
    big, small = (a, b) if len(a) >= len(b) else (b, a)
    room = len(big) - len(small)
    if not small:
        return 0, 0
    places = set(range(0, room + 1, grid))
    for k in range(anchors if len(small) >= width else 0):
        start = k * (len(small) - width) // (anchors - 1)
        anchor, at = small[start : start + width], -1
        for _ in range(hits if len(set(anchor)) > 1 else 0):
            at = big.find(anchor, at + 1)
            if at < 0:
                break
            if 0 <= at - start <= room:
                places.add(at - start)
    x, y = np.frombuffer(big, np.uint8), np.frombuffer(small, np.uint8)
    ranked = sorted(places, key=lambda p: (-np.count_nonzero(x[p : p + len(y) : 64] == y[::64]), p))
    return max(int(np.count_nonzero(x[p : p + len(y)] == y)) for p in ranked[:exact]), len(small)


def byte_match(a: Column, b: Column) -> Column:
    """Percentage of the smaller image's bytes found in the larger at the best place; null if one is empty or null."""

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        found = [aligned_bytes(x, y) if x and y else (0, 0) for x, y in zip(left, right)]
        return pd.Series([100.0 * n / of if of else None for n, of in found], dtype="float64")

    ship_package(SparkSession.active())
    return run(a, b)


def _cells(data: bytes, width: int, big: bool) -> np.ndarray:
    return np.frombuffer(data[: len(data) // width * width], f"{'>' if big else '<'}u{width}").astype(np.float64)


def _roughness(values: np.ndarray) -> float:
    total = np.abs(values).sum()
    return float("inf") if len(values) < 3 or total < 1e-9 else float(np.abs(np.diff(values, 2)).sum() / total)


def structure_of(data: bytes) -> tuple[int, bool, int, int, str]:
    """Cell width, byte order, rows, columns and class of a changed region.

    The smoothest decoding wins, and then of the shapes no longer than four to one the
    one whose rows differ least. Regions of up to 4 bytes have fixed decodings.
    """
    n = len(data)
    fixed = {0: 1, 1: 1, 2: 2, 3: 1, 4: 4}.get(n)
    choices = [(w, big) for w in (1, 2, 4) for big in (False, True) if n % w == 0 and not (w == 1 and big)]
    width, big = (fixed, False) if fixed else min(choices, key=lambda c: _roughness(_cells(data, *c)))
    values = _cells(data, width, big)
    m, shape = len(values), (1, len(values))
    if m > 16:
        shapes = [(r, m // r) for r in range(2, m // 2 + 1) if m % r == 0 and r <= 4 * (m // r) and m // r <= 4 * r]
        shape = min(shapes, key=lambda s: np.abs(np.diff(values.reshape(s), axis=0)).mean(), default=shape)
    kind = "scalar" if m <= 2 else "curve" if m <= 16 else "small map" if m <= 256 else "large map"
    return width, big, *shape, kind


def structure(data: Column) -> Column:
    """``width, big_endian, rows, columns, kind`` of a region's bytes."""

    @F.pandas_udf("width int, big_endian boolean, rows int, columns int, kind string")
    def run(regions: pd.Series) -> pd.DataFrame:
        rows = [structure_of(x) if x is not None else (None,) * 5 for x in regions]
        return pd.DataFrame(rows, columns=["width", "big_endian", "rows", "columns", "kind"]).astype({"width": "Int32", "rows": "Int32", "columns": "Int32"})

    ship_package(SparkSession.active())
    return run(data)


def axes_of(data: bytes, width: int = 1, big: bool = True, signed: bool = False, least: int = 5, most: int = 96) -> list[tuple[int, int, bool, float]]:
    """``offset, count, ascending, score`` of monotone runs, from the left; a run long enough is skipped whole.

    Run lengths are known for every offset beforehand: the next break of each phase.
    """
    n = len(data) - width + 1
    if n < 1:
        return []
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    order = range(width) if big else range(width - 1, -1, -1)
    value = np.zeros(n, np.int64)
    for k in order:
        value = value * 256 + raw[k : k + n]
    if signed:
        value = np.where(value >= 1 << (8 * width - 1), value - (1 << (8 * width)), value)
    count, up = np.ones(n, np.int64), np.zeros(n, bool)
    for phase in range(min(width, n)):
        v = value[phase::width]
        step = np.diff(v)
        at = np.arange(len(v))

        def ends(breaks):  # the last cell of the run from each cell
            last = np.where(np.append(breaks, True), at, len(v))
            return np.minimum.accumulate(last[::-1])[::-1]

        rising, falling = ends(step < 0), ends(step > 0)
        first = np.append(step, 0)
        length = np.where(first > 0, rising, np.where(first < 0, falling, at)) - at + 1
        count[phase::width], up[phase::width] = np.minimum(length, most), first > 0
    starts, found, k = np.flatnonzero(count >= least), [], 0
    span = {1: 3, 2: 10, 4: 50}[width]
    while k < len(starts):
        off = int(starts[k])
        m = int(count[off])
        run = value[off : off + m * width : width]
        reach, moves = abs(int(run[-1] - run[0])), int(np.count_nonzero(np.diff(run)))
        if reach >= span and moves * 5 >= (m - 1) * 4:
            score = 55.0 + min(30, m) + (10 if 5 < reach < 10**7 else 0) + (5 if moves == m - 1 else 0)
            found.append((off, m, bool(up[off]), min(100.0, score)))
        k = int(np.searchsorted(starts, off + m * width))
    return found


def axes(data: Column, width: int = 1, big: bool = True, signed: bool = False) -> Column:
    """Array of ``offset, count, ascending, score``, as ``axes_of``."""

    @F.pandas_udf("array<struct<offset: int, count: int, ascending: boolean, score: double>>")
    def run(images: pd.Series) -> pd.Series:
        names = ("offset", "count", "ascending", "score")
        return pd.Series([None if x is None else [dict(zip(names, a)) for a in axes_of(x, width, big, signed)] for x in images], dtype=object)

    ship_package(SparkSession.active())
    return run(data)


# Fixed values of the block checksums: marks of headers and trailers, and the places of blocks without headers.
HEADER_MARK = bytes.fromhex("FECADEFAFEAFFECA")
TRAILER_MARK = bytes.fromhex("EFBEADDE")
LEAST_SIZE = 0x80000
PARTITIONS = ((0x020000, 0x1FFF00), (0x200000, 0x3FFF00))


def blocks_of(data: bytes, least_size: int = LEAST_SIZE) -> list[tuple[int, int, int, bool]]:
    """``type, start, end, valid`` of an image's blocks: by their headers, else at the usual places.

    A block's CRC-32 covers its bytes to 17 before the trailer and lies 16 before it.
    """
    word = lambda at: int.from_bytes(data[at : at + 4], "little")
    places = []
    if len(data) < least_size:
        return []
    at = data.find(HEADER_MARK, 64)
    while at >= 0:
        if at % 32 == 0:
            places.append((word(at - 64) & 0xFF, word(at - 8) & 0x7FFFFFFF, word(at - 52) & 0x7FFFFFFF))
        at = data.find(HEADER_MARK, at + 1)
    check = lambda start, trailer: 16 <= trailer and start < trailer and data[trailer : trailer + 4] == TRAILER_MARK
    places = [p for p in places if check(*p[1:])] or [(0x40, *p) for p in PARTITIONS if check(*p)]
    return [(kind, start, end - 17, word(end - 16) == zlib.crc32(data[start : end - 16])) for kind, start, end in places]


def block_status(data: Column, least_size: int = LEAST_SIZE) -> Column:
    """``status, blocks, mismatched``: ``invalid`` below the least size, ``mismatch``, or ``ok``, also without any block."""

    @F.pandas_udf("status string, blocks int, mismatched int")
    def run(images: pd.Series) -> pd.DataFrame:
        rows = []
        for x in images:
            found = blocks_of(x, least_size) if x is not None else []
            bad = sum(not b[3] for b in found)
            rows.append((None, None, None) if x is None else ("invalid" if len(x) < least_size else "mismatch" if bad else "ok", len(found), bad))
        return pd.DataFrame(rows, columns=["status", "blocks", "mismatched"]).astype({"blocks": "Int32", "mismatched": "Int32"})

    ship_package(SparkSession.active())
    return run(data)
