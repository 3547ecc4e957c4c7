"""Folders, families, loads, intervals and greedy steps on small cases: nulls, ties, repeated rows, empty tables."""

import random

from pyspark.sql import functions as F

from tessera.operators import greedy, search, sequences


def test_folders_and_trees(spark):
    folders = spark.createDataFrame([("A/x",), ("B/x",), ("B/y",), ("y",), (None,)], "path string")
    wanted = spark.createDataFrame([("x",), ("a/X",), ("Y",), ("z",), (None,), ("x",)], "wanted string")
    got = sorted(map(tuple, search.resolve_folder(folders, wanted).collect()), key=repr)
    assert got == sorted([("x", None, "ambiguous"), ("a/X", "A/x", "found"), ("Y", "y", "found"), ("z", None, "missing"), (None, None, "missing"), ("x", None, "ambiguous")], key=repr)
    nodes = spark.createDataFrame([("a/b_c/d", True), ("a/b_c/e", None), ("a/f", True), (None, True)], "path string, on boolean")
    assert {tuple(r) for r in search.tree_filter(nodes, "bc", F.col("on")).collect()} == {("a", False), ("a/b_c", False), ("a/b_c/d", True)}
    assert search.tree_filter(nodes.limit(0), "bc").count() == 0


def test_family(spark):
    rows = [("xME7 y",), ("ME7x",), ("ME7 EDC",), ("",), (None,), ("EDC.ME7",)]
    found = search.family(F.col("t"), [("ME7", "me", 70), ("EDC", "edc", 90), ("ED", "never", 99), ("EDC.", "late", 90)], F.lit("unknown"))
    got = [tuple(r.f) for r in spark.createDataFrame(rows, "t string").select(found.alias("f")).collect()]
    assert got == [("me", False), ("unknown", False), ("edc", True), ("unknown", False), ("unknown", False), ("edc", True)]


def test_loaded(spark):
    rows = [(1, 10.0, 99.0), (1, 8.5, None), (1, 8.4, None), (1, None, None), (2, None, 95.0), (2, None, 94.0), (3, None, None)]
    frame = spark.createDataFrame(rows, "g int, l double, t double").select("g", "l", "t", sequences.loaded(F.col("l"), F.col("t"), ["g"]).alias("on"))
    assert [(r.g, r.on) for r in frame.orderBy("g", F.desc_nulls_last("l"), F.desc("t")).collect()] == [(1, True), (1, True), (1, False), (1, False), (2, True), (2, False), (3, True)]


def test_intervals_of_every_length(spark):
    rng = random.Random(2)
    spans = [(k, a, a + rng.choice([0, 1, 7, 8, 64, 65, 1000, 100_000])) for k, a in enumerate(rng.randrange(-5000, 5000) for _ in range(150))] + [(900, 5, 4), (901, None, 4), (902, 1, None), (3, 0, 0), (3, 0, 0)]
    points = [rng.randrange(-6000, 20000) for _ in range(300)] + [None, 0, 0]
    frame = spark.createDataFrame([(p,) for p in points], "at long")
    table = spark.createDataFrame(spans, "id long, a long, b long")
    holds = lambda p, a, b: None not in (p, a, b) and a <= p <= b
    want = sorted((p, k) for p in points for k, a, b in spans if holds(p, a, b))
    assert sorted((r.at, r.id) for r in sequences.in_intervals(frame, "at", table, "a", "b").collect()) == want
    out = sorted((p for p in points if not any(holds(p, a, b) for _, a, b in spans)), key=repr)
    assert sorted((r.at for r in sequences.outside_intervals(frame, "at", table, "a", "b").collect()), key=repr) == out
    assert sequences.in_intervals(frame, "at", table.limit(0), "a", "b").count() == 0
    assert sequences.outside_intervals(frame, "at", table.limit(0), "a", "b").count() == len(points)


def test_newest_wins_by_painting(spark):
    rng = random.Random(3)
    spans = [(g, a, a + rng.randrange(0, 30), s) for s, (g, a) in enumerate((rng.choice("ab"), rng.randrange(100)) for _ in range(80))]
    painted = {}
    for g, a, b, s in spans:
        painted.update({(g, k): s for k in range(a, b)})
    got = sequences.newest_wins(spark.createDataFrame([*spans, ("a", None, 5, 99)], "g string, begin long, end long, seq long"), "g").collect()
    assert {(r.g, k): r.seq for r in got for k in range(r.begin, r.end)} == painted
    assert sum(r.end - r.begin for r in got) == len(painted)


def test_greedy_steps_beside_plain_loops(spark):
    rng = random.Random(4)
    spans = [("k", a, a + rng.choice([0, 3, 40, 500]), float(rng.randrange(9))) for a in (rng.randrange(600) for _ in range(120))]
    kept = []
    for _, a, b, s in sorted(spans, key=lambda x: (-x[3], x[1], x[2])):
        if b <= a or all(min(b, d) - max(a, c) < 0.5 * (b - a) for c, d in kept):
            kept.append((a, b))
    got = greedy.suppress_overlaps(spark.createDataFrame(spans, "k string, begin long, end long, score double"), "k").collect()
    assert sorted((r.begin, r.end) for r in got) == sorted(kept)
    sets = [("k", f"{n:03d}", [rng.randrange(8) for _ in range(rng.randrange(5))]) for n in range(80)] + [("k", "999", None)]
    seeds, want = [], {}
    for _, n, x in sorted(sets, key=lambda r: r[1]):
        own = set(x or ())
        want[n] = next((s for s, o in seeds if own | o and len(own & o) >= 0.5 * len(own | o)), n)
        if want[n] == n:
            seeds.append((n, own))
    got = greedy.seed_clusters(spark.createDataFrame(sets, "k string, n string, x array<int>"), "k", "n", "x").collect()
    assert {r.n: r.seed for r in got} == want
