"""Edits, packs and twins on small cases beside plain Python; nulls, ties, repeated rows, empty tables."""

import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions.formula import linear_form
from tessera.operators import edits, packs, sinks, twins
from tessera.sources import images


def cells(spark, rows):
    return spark.createDataFrame(rows, "array_id long, pos int, raw long, extra string")


ROWS = [(1, 0, 10, "a"), (1, 1, 20, "a"), (1, 2, None, "b"), (1, 3, 32767, "c"), (2, 0, -5, None), (2, 0, -5, None)]


def got(frame):
    return sorted(((r.array_id, r.pos, r.raw) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("mode, x, f", [("set", 7, lambda v: 7), ("add", 100, lambda v: v + 100), ("scale", -2.5, lambda v: v * -2.5), ("percent", 50, lambda v: v * 1.5), ("zero", 0, lambda v: 0), ("least", 15, lambda v: max(v, 15)), ("most", 15, lambda v: min(v, 15))])
def test_modes(spark, mode, x, f):
    hold = lambda v: int(min(32767, max(-32768, abs(v) // 1 + (abs(v) % 1 >= 0.5)) if v >= 0 else max(-32768, -(abs(v) // 1 + (abs(v) % 1 >= 0.5)))))
    done = edits.edit(cells(spark, ROWS), mode, x, F.col("pos") < 2)
    want = [(a, p, hold(f(r)) if p < 2 and r is not None else r) for a, p, r, _ in ROWS]
    assert got(done) == sorted(want, key=repr) and done.columns == ["array_id", "pos", "raw", "extra"]
    assert got(edits.edit(cells(spark, ROWS), mode, x, F.lit(None).cast("boolean"))) == sorted([r[:3] for r in ROWS], key=repr)
    assert edits.edit(cells(spark, []), mode, x).count() == 0


def test_not_finite_leaves_cells(spark):
    frame = cells(spark, ROWS)
    assert got(edits.edit(frame, "scale", F.lit(float("nan")))) == got(edits.edit(frame, "add", F.lit(None).cast("double"))) == got(frame)
    assert got(edits.edit(frame, "add", 1, scaling=(0.0, 5.0))) == got(frame)


def test_line_of_one_cell_stays(spark):
    assert got(edits.line(cells(spark, ROWS), F.col("pos") == 1)) == got(cells(spark, ROWS))
    rows = [(1, k, v, "") for k, v in enumerate([0, 9, 9, 9, 8])]
    assert [r for *_, r in got(edits.line(cells(spark, rows)))] == [0, 2, 4, 6, 8]


def test_batch_is_all_or_nothing(spark):
    frame = cells(spark, ROWS)
    steps = lambda rows: spark.createDataFrame(rows, "array_id long, mode string, argument double")
    assert got(edits.batch(frame, steps([(1, "add", 1.0)])))[0] == (1, 0, 11)
    for bad in [(9, "add", 1.0), (2, "melt", 1.0), (2, None, 1.0), (2, "add", None), (2, "add", float("inf"))]:
        assert got(edits.batch(frame, steps([(1, "add", 1.0), bad]))) == got(frame)
    assert got(edits.batch(frame, steps([]))) == got(frame)


def test_import_changes(spark):
    original, version = bytes(range(40)), bytes(range(40)).replace(b"\x05\x06", b"\x50\xff")
    rows = [(1, b"\xee" + original + b"\xdd", original, version), (2, original, original, version), (3, b"ab", original, version), (4, original, original, version[:-1]), (5, None, original, version), (6, b"", b"", b""), (7, bytes(41), original, version)]
    frame = spark.createDataFrame(rows, "image_id int, current binary, original binary, version binary")
    run = lambda mode: {r.image_id: r.changed and bytes(r.changed) for r in edits.import_changes(frame, mode).collect()}
    one = run("absolute")
    assert one[1] == b"\xee" + version + b"\xdd" and one[2] == version and one[3] is one[4] is one[5] is one[6] is None
    assert one[7] == bytes(5) + b"\x50\xff" + bytes(34)
    assert run("relative")[7] == bytes(5) + b"\x4b\xf9" + bytes(34)
    percent = run("percent")
    assert percent[2][5:7] == bytes([5 * 80 // 5 % 256, 6 * 255 // 6 % 256]) and percent[7] == bytes(41)
    assert run("all original")[7] == original + b"\x00" and run("all version")[1] == b"\xee" + version + b"\xdd"


def test_histories(spark):
    import random

    rng = random.Random(1)
    log, want = [], {}
    for image in range(30):
        done, undone, held = [], [], 0
        for seq in range(rng.choice([0, 5, 40, 500])):
            action = rng.choice(["edit", "edit", "undo", "redo", "other", None])
            log.append((image, seq, action, seq % 3))
            if action == "edit":
                done, undone, held = [*done, seq], [], min(200, held + 1)
            elif action == "undo" and held:
                undone, done, held = [*undone, done[-1]], done[:-1], held - 1
            elif action == "redo" and undone:
                done, undone, held = [*done, undone[-1]], undone[:-1], held + 1
        want[image] = done
    frame = spark.createDataFrame(log, "image_id int, seq long, action string, off int")
    live = {}
    for r in edits.live_edits(frame).collect():
        live.setdefault(r.image_id, []).append(r.seq)
    assert {k: sorted(v) for k, v in live.items()} == {k: v for k, v in want.items() if v}
    assert edits.live_edits(frame.limit(0)).count() == 0


def test_packs_round_trip(spark):
    rows = [("p", "a", 2, 1, 2, True, 16, b"\x01\x02\x03\x04"), ("p", "b", 1, 1, 1, False, 0, b"\x7f"), ("p", "c", 1, 2, 2, True, 0, None), ("q", 'x";', 1, 1, 4, False, 8, b"\xff\xfe\xfd\xfc")]
    frame = spark.createDataFrame(rows, "pack_id string, name string, cols int, rows int, width int, big_endian boolean, address long, data binary")
    back = packs.from_json(packs.to_json(frame))
    key = lambda r: (r.pack_id, r.name, r.cols, r.rows, r.width, r.big_endian, r.address, r.data and bytes(r.data))
    assert sorted(map(key, back.collect()), key=repr) == sorted(rows, key=repr)
    odd = spark.createDataFrame([("x", None), ("x", "{"), ("x", '{"format":"other","maps":[{"name":"a"}]}')], "pack_id string, json string")
    assert packs.from_json(odd).count() == 0
    project = spark.createDataFrame([("a", 2, 1, 100), ("a", 9, 9, 200), ("b", 3, 1, 50)], "name string, cols int, rows int, address long")
    done = {r.name: (r.status, r.address, r.written and bytes(r.written)) for r in packs.apply(frame, project, 120).collect()}
    assert done == {"a": ("applied", 100, b"\x02\x01\x04\x03"), "b": ("mismatch", 50, None), "c": ("definition", None, None), 'x";': ("applied", 8, b"\xff\xfe\xfd\xfc")}
    assert {r.line for r in packs.to_csv(frame).collect()} == {"0x00000010;a;4", "0x00000000;b;1", "0x00000000;c;4", '0x00000008;x" ;4'}


def test_s_records_round_trip(spark):
    rows = [("i", a, a * 7 % 256) for a in [*range(3, 40), *range(70000, 70017)]]
    lines = sinks.s_record_lines(spark.createDataFrame(rows, "image_id string, address long, byte int"))
    text = [r.line for r in lines.orderBy("line_no").collect()]
    assert text[0] == "S0030000FC" and text[-1] == "S70500000000FA"
    for line in text:
        assert sum(bytes.fromhex(line[2:])) % 256 == 255
    files = spark.createDataFrame([("i", "\n".join(text).encode())], "image_id string, content binary")
    assert sorted((r.image_id, r.address, r.byte) for r in images.s_records(files).collect()) == rows


def test_twins(spark):
    ident = lambda b: f"{((zlib.crc32(b) ^ 0xFFFFFFFF) >> 8) & 0xFFFFFF:06x}"
    data = bytes(range(200))
    rows = [(1, ident(data), "zz", "2: 10-1F, 30-2F, 40-FFF", "0f0f", "ffff"), (2, "no", ident(data[0x10:0x20]), None, "0f0e", "0000"), (3, "no", ident(data[0x40:]), "", "0f0f", "ffff"), (4, "no", "no", "", "0f0e", "0000"), (5, "no", "no", "", "f0f0", "0000"), (6, None, None, None, None, "ffef"), (7, "no", "no", "", "0f0f", "fff"), (8, "no", "no", "", "0f0f", "1234")]
    catalog = spark.createDataFrame(rows, "entry_id long, id_project string, id_data string, regions string, chunk0 string, chunk1 string")
    image = spark.createDataFrame([(data,)], "data binary")
    found = [(r.entry_id, r.kind, round(r.distance, 4)) for r in twins.twins(image, catalog).orderBy("place").collect()]
    assert found == [(1, "project", 0.0), (2, "data", 0.0), (3, "data", 0.0), (4, "near", 0.0625), (6, "near", 0.0625)]
    assert twins.twins(image, catalog.limit(0)).count() == 0 == twins.twins(image.limit(0), catalog).count()


def test_linear_form():
    for text, want in {"X": (1, 0), "2*(x-3)/4+1": (0.5, -0.5), "-X": (-1, 0), "X*05": (5, 0), "3": (0, 3), "(X+1)*(2)": (2, 2), "X*X": None, "1/X": None, "X/0": None, "X+": None, "Y": None, "f(X)": None, "": None, None: None}.items():
        assert linear_form(text) == want, text
