"""Likely maps, gated consensus and algorithm matches on planted cases."""

import math
import random
import struct
from operator import mul

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import detection


def test_planted_map(spark):
    rng = random.Random(5)
    noise = bytes(rng.randrange(256) for _ in range(300))
    x, y = [200 + 113 * k for k in range(16)], [500 + 391 * k for k in range(12)]
    plane = [1000 + 90 * r + 30 * c for r in range(12) for c in range(16)]
    noise += b"\xff\xff"
    image = noise + struct.pack("<16H", *x) + b"\xff\x00\xff" + struct.pack("<12H", *y) + struct.pack("<192H", *plane) + noise
    at = 302 + 32 + 3 + 24
    best = [m for m in detection.maps_of(image) if m[1:4] == (16, 12, 2)]
    assert [m[0] for m in best] == [at] and not best[0][4]
    before = noise + struct.pack("<192H", *plane) + struct.pack("<16H", *x) + struct.pack("<12H", *y) + b"\x00\x00" + noise
    assert any(m[:4] == (302, 16, 12, 2) for m in detection.maps_of(before))
    assert detection.maps_of(b"") == detection.maps_of(bytes(500)) == []
    frame = spark.createDataFrame([(bytearray(image),), (None,), (bytearray(),)], "b binary")
    assert [r.m and len(r.m) for r in frame.select(detection.likely_maps(F.col("b")).alias("m")).collect()] == [len(detection.maps_of(image)), None, []]


def test_made_images():
    from planted import images

    found = right = wanted = 0
    for data, maps in images(2, 12):
        got = {m[:4] for m in detection.maps_of(data)}
        found, right, wanted = found + len(got), right + len(got & set(maps)), wanted + len(maps)
    assert right >= 0.55 * wanted and right >= 0.35 * found


def test_the_weights_are_fitted():
    from planted import images

    known, seen, labels = [], [], []
    for data, maps in images(1, 3):
        for at, n, m, width, big, axis_width, score in detection.candidates(data):
            values = np.frombuffer(data, f"<u{width}", n * m, at).astype(float).reshape(m, n)
            known.append(detection.known_evidence(n, m, width, axis_width, score))
            seen.append(detection.seen_evidence(values))
            labels.append((at, n, m, width) in maps)
    a, b = detection.fit_evidence(known, seen, labels)
    odds = lambda w, v: np.array(known) @ w + np.array(seen) @ v
    assert np.corrcoef(odds(a, b), odds(detection.KNOWN_WEIGHTS, detection.SEEN_WEIGHTS))[0, 1] > 0.8


def test_no_map_lies_half_in_a_better_one():
    rng = random.Random(6)
    image = b"".join(bytes(sorted(rng.randrange(256) for _ in range(rng.randrange(5, 30)))) for _ in range(60))
    kept = detection.maps_of(image)
    assert len(kept) > 5 and [m[5] for m in kept] == sorted((m[5] for m in kept), reverse=True)
    for i, (b, n, m, w, *_) in enumerate(kept):
        size = n * m * w
        assert all(2 * (min(b + size, o[0] + o[1] * o[2] * o[3]) - max(b, o[0])) < size for o in kept[:i])


def test_gated_consensus(spark):
    rows = [("g", "a", 1, 10, 12), ("g", "a", 2, 20, 25), ("g", "b", 1, 10, 14), ("g", "b", 2, 99, 1), ("g", "c", 40, 7, 9), ("g", "d", 60, 1, 2)]
    voices = spark.createDataFrame(rows, "k string, voice string, address long, before long, after long")
    baseline = spark.createDataFrame([("g", 1, 10), ("g", 2, 20), ("g", 40, 7)], "k string, address long, value long")
    found = {(r.region, r.address): (r.voices, r.mean) for r in detection.gated_consensus(voices, baseline, ["k"]).collect()}
    assert found == {(1, 1): (1, 2.0), (1, 2): (1, 5.0), (40, 40): (1, 2.0)}
    assert detection.gated_consensus(voices.limit(0), baseline, ["k"]).count() == 0


def test_algorithm_score(spark):
    rows = [(1, "Bosch ME7.5 sum"), (94, "All brands"), (3, ""), (4, None), (5, "other")]
    frame = spark.createDataFrame(rows, "n int, text string")
    score = lambda wanted: [r.s for r in frame.select(detection.algorithm_score(F.col("text"), F.col("n"), wanted).alias("s")).collect()]
    assert score("Bosch ME7.5") == [100 + 15 + 9 + 40, -20, None, None, -20]
    assert score("MED17") == [0, 200, None, None, 0] and score(" ") == [None] * 5


def test_candidates_at_once(monkeypatch):
    """Judged many at once, in blocks of any size, the maps are those of each candidate's own evidence, which few need."""
    from planted import images

    image = next(iter(images(7, 1)))[0]
    wanted = math.log(95 / 5)

    def odds(at, n, m, width, big, axis_width, score):
        values = np.frombuffer(image, f"{'>' if big else '<'}u{width}", n * m, at).astype(float).reshape(m, n)
        return sum(map(mul, detection.KNOWN_WEIGHTS + detection.SEEN_WEIGHTS, detection.known_evidence(n, m, width, axis_width, score) + detection.seen_evidence(values)))

    every = [(c, odds(*c)) for c in detection.candidates(image)]
    likely = sorted(c for c, o in every if o >= wanted)
    read, whole = [], detection.maps_of(image)
    monkeypatch.setattr(detection, "seen_evidence", lambda values, own=detection.seen_evidence: read.append(1) or own(values))
    monkeypatch.setattr(detection, "PAIRS", 3)
    monkeypatch.setattr(detection, "CELLS_AT_ONCE", 40)
    assert detection.maps_of(image) == whole and likely
    assert sorted(detection._promising(image, False, wanted)) == likely
    assert len(read) == len(likely) < len(every) / 10
