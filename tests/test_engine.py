import math
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import codec, units
from tessera.functions.formula import formula
from tessera.operators import greedy, search, sequences, sinks
from tessera.sources import images, logs
from tessera.streaming import live


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def data(raw):
    return F.unhex(F.lit(raw.hex()))


def test_golden_reads(spark):
    cases = [(b"\xa5", 1, False, 0xA5), (b"\x34\x12", 2, False, 0x1234), (b"\xab\xcd", 2, True, 0xABCD), (b"\xef\xbe\xad\xde", 4, False, 0xDEADBEEF), (b"\xca\xfe\xba\xbe", 4, True, 0xCAFEBABE), (b"\xff" * 8, 8, False, 2**64 - 1)]
    for raw, width, big, want in cases:
        assert one(spark, codec.read_unsigned(data(raw), 0, width, big)) == want
    for value in (3.14, -2.5, 0.0, 1e-42, math.inf):
        assert one(spark, codec.read_float(data(struct.pack("<f", value)), 0)) == pytest.approx(struct.unpack("<f", struct.pack("<f", value))[0])
        assert one(spark, codec.read_float(data(struct.pack(">d", value)), 0, 8, True)) == pytest.approx(value)
    assert one(spark, codec.read_signed(data(b"\xfe\xff"), 0, 2)) == -2
    assert one(spark, codec.or_sentinel(codec.read_unsigned(data(b"\x01"), 5, 1))) == codec.SENTINEL
    assert tuple(one(spark, codec.encode(F.lit(300.0), 1, False))) == (255, "Clamped") and tuple(one(spark, codec.encode(F.lit(-2.5), 1, True))) == (-3, "Ok")
    assert one(spark, codec.encode(F.lit(math.nan), 1, False)).status == "NonFinite"
    assert codec.precision_of(0.01) == 2 and codec.precision_of(1, "%6.3f") == 3


def test_golden_regions(spark):
    cases = [([10], 16, [(10, 10)]), ([10, 20], 16, [(10, 20)]), ([10, 80], 16, [(10, 10), (80, 80)]), (list(range(16)), 1, [(0, 15)]), ([0, 2, 4], 1, [(0, 0), (2, 2), (4, 4)]), (list(range(5, 20, 2)), 16, [(5, 19)]), ([], 16, [])]
    for places, gap, want in cases:
        frame = spark.createDataFrame([("a", p) for p in places], "k string, p int")
        assert sorted((r["first"], r["last"]) for r in sequences.islands(frame, ["k"], "p", gap).collect()) == want


def test_consensus_tags(spark):
    rows = [("u", 16.0)] * 20 + [("s", 15.5)] * 8 + [("s", 16.5)] * 8 + [("m", 1.0)] * 5 + [("m", 9.0)] * 5 + [("h", 16.0)]
    got = {r.a: r.tag for r in search.consensus(spark.createDataFrame(rows, "a string, d double"), "a", "d", 20).collect()}
    assert got == {"u": "Unanimous", "s": "StrongConsensus", "m": "Majority", "h": "Heretic"}


def test_formula(spark):
    assert one(spark, formula("-(v + 2) * max(r, c) / 4", v=F.lit(6), r=F.lit(1), c=F.lit(3))) == -6
    assert one(spark, formula("v / r", v=F.lit(1), r=F.lit(0))) is None
    for bad in ("__import__('os')", "v.x", "v +", "eval(v)", "x"):
        with pytest.raises(ValueError):
            formula(bad, v=F.lit(1))


def test_masked_bytes(spark):
    assert list(one(spark, search.find_masked(data(b"abacaba"), "61 ?? 61"))) == [0, 2, 4]
    frame = spark.createDataFrame([(bytearray(b"\x11\x22\x33\x44"),), (None,)], "b binary")
    got = [r.x and bytes(r.x) for r in frame.select(greedy.replace_masked(F.col("b"), "?? 22", "AA ??").alias("x")).collect()]
    assert got == [b"\xaa\x22\x33\x44", None]


def test_greedy(spark):
    spans = spark.createDataFrame([(1, 0, 10, 5.0), (1, 4, 12, 4.0), (1, 8, 30, 3.0)], "k int, begin long, end long, score double")
    assert sorted((r.begin, r.end) for r in greedy.suppress_overlaps(spans, "k").collect()) == [(0, 10), (8, 30)]
    new = spark.createDataFrame([(1, 0, 10, 1), (1, 3, 5, 2), (1, 9, 12, 3)], "k int, begin long, end long, seq long")
    assert sorted(tuple(r)[1:] for r in sequences.newest_wins(new, "k").collect()) == [(0, 3, 1), (3, 5, 2), (5, 9, 1), (9, 12, 3)]
    sets = spark.createDataFrame([(1, "a", [1, 2, 3]), (1, "b", [2, 3]), (1, "c", [9])], "k int, n string, s array<int>")
    assert sorted((r.n, r.seed) for r in greedy.seed_clusters(sets, "k", "n", "s").collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_images(spark, tmp_path):
    (tmp_path / "a.hex").write_text(":020000040001F9\n:03001000010203E7\n:01001100AA44\n:01002000FFE0\n:00000001FF\n:0100300001CE\n")
    (tmp_path / "b.s19").write_text("S0030000FC\nS1051000010200\nS20500200009D1\nS9030000FC\n")
    found = images.files(spark, str(tmp_path))
    got = images.intel_hex(found.where("format = 'hex'"))
    assert sorted((r.address, r.byte) for r in got.collect()) == [(0x10010, 1), (0x10011, 0xAA), (0x10012, 3), (0x10020, 255)]
    image = images.assemble(got).first()
    assert image.base_address == 0x10010 and bytes(image.bytes) == b"\x01\xaa\x03" + b"\xff" * 14
    lines = sinks.intel_hex_lines(got)
    again = lines.orderBy("line_no").groupBy("image_id").agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n"), "UTF-8").alias("content"))
    assert sorted(map(tuple, images.intel_hex(again).collect())) == sorted(map(tuple, got.collect()))
    assert sorted((r.address, r.byte) for r in images.s_records(found.where("format = 'srec'")).collect()) == [(0x1000, 1), (0x1001, 2), (0x2000, 9)]


def test_logs(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes("﻿timestamp;Boost (mbar);\"A;B (°C)\"\n0;1000;20\n10;;x\n".encode())
    (tmp_path / "two.csv").write_bytes("Time,RPM\nt,speed\ns,1/min\n0.5,900\n1.0,950\n".encode("latin-1"))
    got = sorted((r.time_ms, r.channel, r.unit, r.value) for r in logs.samples(spark, str(tmp_path / "*.csv")).collect())
    assert got == sorted([(0.0, "Boost", "mbar", 1000.0), (0.0, "A;B", "°C", 20.0), (10.0, "Boost", "mbar", 0.0), (10.0, "A;B", "°C", 0.0), (500.0, "RPM", "1/min", 900.0), (1000.0, "RPM", "1/min", 950.0)])
    (tmp_path / "maps.txt").write_text("Address;Name;Size\n0x10;A;4\n$20;A;8\n0x10;B;2\n0x30;A;1\n")
    got = sorted((r.address, r.name, r.size) for r in logs.map_list(spark, str(tmp_path / "maps.txt")).collect())
    assert got == [(16, "B", 2), (32, "A", 8), (48, "A [$30]", 1)]
    assert tuple(one(spark, units.normal_unit(F.lit(" mbar ")))) == ("bar", 0.001) and tuple(one(spark, units.cylinder(F.lit("Knock Cylinder 3")))) == ("Knock", 3)


def test_live(spark, tmp_path):
    rows = [(1, 1000 * k, float(v)) for k, v in enumerate([5, 20, 30, 40, 10, 50, 60, 61, 3])]
    for k in (0, 1):
        spark.createDataFrame(rows[5 * k : 5 * k + 5], "log_id long, t long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("log_id long, t long, value double").option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = live.live_pulls(stream, 15.0, 5.0, 1000).writeStream.format("memory").queryName("pulls").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.begin_at, r.end_at, r.n) for r in spark.table("pulls").collect()) == [(1000, 3000, 3), (5000, 7000, 3)]


def test_sketches_and_map_similarity(spark):
    import random

    rng = random.Random(6)
    base = list(range(4000))
    sets = {"a": base, "b": base[:3600] + list(range(9000, 9400)), "c": rng.sample(range(20_000, 90_000), 4000)}
    items = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "k string, item long")
    sizes = items.groupBy("k").agg(F.count("*").alias("size"))
    got = {(r.a, r.b): (r.jaccard, r.containment) for r in search.sketch_similarity(search.sketch(items, "k", "item"), sizes, "k").collect()}
    assert set(got) == {("a", "b")} and got["a", "b"][0] == pytest.approx(3600 / 4400, abs=0.15) and got["a", "b"][1] <= 1
    from tessera.operators import arrays

    rows = [(n, [math.sin(k / (5 + n % 3)) + 0.01 * n for k in range(64)]) for n in range(6)]
    cells = arrays.cells_of(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 8)
    best = arrays.similar_to(arrays.fingerprint(cells), F.col("array_id") == 0, 0.5, 3).collect()
    assert best[0].array_id == 3 and best[0].score > 0.9 and 0 not in {r.array_id for r in best}
    plane = {(r.row, r.col): r.value for r in arrays.smooth_plane(cells.where("array_id = 0"), 2).collect()}
    now = {(k // 8, k % 8): x for k, x in enumerate(rows[0][1])}
    for _ in range(2):
        near = lambda r, c: [((a, b), 2 if (a, b) == (r, c) else 1) for a in (r - 1, r, r + 1) for b in (c - 1, c, c + 1) if (a, b) in now]
        now = {p: sum(now[q] * w for q, w in near(*p)) / sum(w for _, w in near(*p)) for p in now}
    assert plane == pytest.approx(now)


def test_channels(spark):
    from tessera.functions import channels

    cases = [(["Engine speed", "nmot"], "Autotuner"), (["EnginRPM"], "PorscheSdi21"), (["nmot_w", "nmot"], "BoschMercME"), (["nmot"], "BmwMssS55"), (["n", "gear"], "PorscheOldSdi"), (["n"], "Unknown"), (["Block001[x]"], "MercedesMeBlock"), ([], "Unknown"), (None, None)]
    frame = spark.createDataFrame(cases, "names array<string>, want string").select("want", channels.family(F.col("names")).alias("got"))
    assert all(r.got == r.want for r in frame.collect())
    cases = [("rl_msg", "BmwMedc17", ("RelativeLoad", None)), ("Ignition withdrawal timing Cylinder 4", "Autotuner", ("KnockRetardCyl", 4)), ("wkrmv[0]", "BoschMercME", ("KnockRetardCyl", 1)), ("nmot", "BoschMercME", ("Unknown", None)), ("nmot", "Unknown", ("EngineRpm", None)), ("Time", "Unknown", ("Time", None))]
    for name, family, want in cases:
        assert tuple(one(spark, channels.signal(F.lit(name), F.lit(family)))) == want, name
    for text, want in {"°C": ("°C", 1.0), "deg  C": ("°C", 1.0), "MPa": ("bar", 10.0), "µs": ("µs", 1.0), "x": ("x", 1.0), "": ("", 1.0)}.items():
        assert tuple(one(spark, units.normal_unit(F.lit(text)))) == want
    for text, want in {"Knock Array [2]": ("Knock", 3), "k[0]": ("k", 1), "ZW_Zyl4": ("ZW_", 4), "plain": ("plain", None)}.items():
        assert tuple(one(spark, units.cylinder(F.lit(text)))) == want
