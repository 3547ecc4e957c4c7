"""Whole-image operators, linking and definitions, against plain loops and small files."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import images, linking
from tessera.sources import definitions


def plain_sketch(data):
    data = data.strip(b"\x00\xff")
    least = {}
    for i in range(len(data) - images.SHINGLE + 1):
        window = data[i : i + images.SHINGLE]
        if len(set(window)) == 1 and window[0] in (0, 255):
            continue
        h = 0
        for b in window:
            h = (h * images.BASE + b) % images.MODULUS
        x = (h + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        x = max(x ^ x >> 31, 1)
        k = x % images.BUCKETS
        least[k] = min(least.get(k, x), x)
    return len(data), least


@pytest.mark.parametrize("size", [0, 10, 64, 65, 900])
def test_sketch(size):
    rng = random.Random(size)
    body = bytes(rng.randrange(256) for _ in range(size))
    for data in (body, b"\xff" * 70 + body + b"\x00" * 99, body + b"\xff" * 200 + body, b"\xff" * 300):
        assert images.sketch_of(data) == plain_sketch(data)


def test_sketch_index(spark):
    rng = random.Random(1)
    body = bytes(rng.randrange(256) for _ in range(4000))
    other = bytes(rng.randrange(256) for _ in range(4000))
    frame = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(body[:3600] + other[:400])), (3, bytearray(other)), (4, None), (5, bytearray())], "id long, data binary")
    index = images.postings(frame, "id", "data")
    found = {(r.needle, r.id): r.percent for r in images.similar(index, index.where("id = 1"), "id").collect()}
    assert list(found) == [(1, 2)] and 60 < found[1, 2] < 100


def test_byte_alignment(spark):
    rng = random.Random(2)
    big = bytes(rng.randrange(256) for _ in range(9000))
    part = bytearray(big[3333:5333])
    part[5] ^= 1
    assert images.aligned_bytes(big, bytes(part)) == (1999, 2000) == images.aligned_bytes(bytes(part), big)
    assert images.aligned_bytes(big, b"") == (0, 0) and images.aligned_bytes(b"abc", b"abd") == (2, 3)
    frame = spark.createDataFrame([(bytearray(big), part), (bytearray(big), None), (bytearray(), bytearray())], "a binary, b binary")
    assert [r.x for r in frame.select(images.byte_match(F.col("a"), F.col("b")).alias("x")).collect()] == [99.95, None, None]


def test_structure(spark):
    plane = [1000 + 40 * r + c for r in range(8) for c in range(10)]
    assert images.structure_of(struct.pack(">80H", *plane))[:2] == (2, True)
    assert images.structure_of(struct.pack("<80H", *plane))[:2] == (2, False)
    assert images.structure_of(b"ab")[0] == 2 and images.structure_of(b"")[4] == "scalar" and images.structure_of(bytes(range(10)))[4] == "curve"
    step = [100 if (k // 10) % 2 else k for k in range(80)]
    width, _, rows, columns, kind = images.structure_of(bytes(step))
    assert width * rows * columns == 80 and kind == "small map"
    frame = spark.createDataFrame([(bytearray(bytes(step)),), (None,)], "b binary")
    assert [r.s.kind for r in frame.select(images.structure(F.col("b")).alias("s")).collect()] == ["small map", None]


def plain_axes(data, width, big, signed, least=5, most=96):
    read = lambda at: int.from_bytes(data[at : at + width], "big" if big else "little", signed=signed)
    at, found = 0, []
    while at + width * least <= len(data):
        a, b = read(at), read(at + width)
        n = 2 if a != b else 1
        while n > 1 and n < most and at + (n + 1) * width <= len(data) and (read(at + n * width) - read(at + (n - 1) * width)) * (b - a) >= 0:
            n += 1
        if n < least:
            at += 1
            continue
        run = [read(at + k * width) for k in range(n)]
        moves = sum(x != y for x, y in zip(run, run[1:]))
        if max(run) - min(run) >= {1: 3, 2: 10, 4: 50}[width] and moves * 5 >= (n - 1) * 4:
            found.append((at, n, b > a))
        at += n * width
    return found


def test_axes(spark):
    rng = random.Random(3)
    for width in (1, 2, 4):
        for big in (True, False):
            for signed in (True, False):
                pieces = []
                for _ in range(20):
                    pieces.append(bytes(rng.randrange(256) for _ in range(rng.randrange(30))))
                    run = sorted(rng.randrange(120 ** width) for _ in range(rng.randrange(4, 120)))
                    pieces.append(b"".join(v.to_bytes(width, "big" if big else "little") for v in (run if rng.random() < 0.5 else run[::-1])))
                data = b"".join(pieces)
                assert [a[:3] for a in images.axes_of(data, width, big, signed)] == plain_axes(data, width, big, signed)
    assert images.axes_of(b"") == images.axes_of(b"abc", 4) == [] and images.axes_of(bytes(range(10, 60, 10))) == [(0, 5, True, 75.0)]
    frame = spark.createDataFrame([(bytearray(range(10, 60, 10)),), (None,)], "b binary")
    assert [None if r.a is None else r.a[0].score for r in frame.select(images.axes(F.col("b")).alias("a")).collect()] == [75.0, None]


def test_block_checksums(spark):
    image = bytearray(b"\x5a" * 4096)
    struct.pack_into("<I", image, 0x200 - 64, 0x99000040)
    struct.pack_into("<I", image, 0x200 - 52, 0x80000C00)
    struct.pack_into("<I", image, 0x200 - 8, 0x80000400)
    image[0x200:0x208] = images.HEADER_MARK
    image[0xC00:0xC04] = images.TRAILER_MARK
    struct.pack_into("<I", image, 0xBF0, zlib.crc32(bytes(image[0x400 : 0xC00 - 16])))
    assert images.blocks_of(bytes(image), 1024) == [(0x40, 0x400, 0xBEF, True)]
    broken = bytearray(image)
    broken[0x500] ^= 1
    frame = spark.createDataFrame([(image,), (broken,), (bytearray(2000),), (bytearray(9),), (None,)], "b binary")
    assert [tuple(r.s) for r in frame.select(images.block_status(F.col("b"), 1024).alias("s")).collect()] == [("ok", 1, 0), ("mismatch", 1, 1), ("ok", 0, 0), ("invalid", 0, 0), (None, None, None)]


def test_linking(spark):
    rng = random.Random(4)
    source = bytes(rng.randrange(256) for _ in range(4000))
    head = bytes([0, 8])
    source = source[:1000] + head + source[1002:]
    target = bytearray(source[:600] + b"\x11" * 100 + source[600:])
    target[1118:1182] = bytes(64)  # new cells behind an equal axis
    target[1700:1800] = bytes(100)
    maps = [("same", 100, 0, 40), ("moved", 800, 0, 90), ("by axis", 1000, 18, 64), ("between", 1600, 0, 90), ("last", 3800, 0, 64), ("short", 50, 0, 1)]
    rows = [("s", n, a, o, size, a + 2 if o else None, 16 if o else None, 8 if o else None) for n, a, o, size in maps]
    m = spark.createDataFrame(rows, "source_id string, name string, address long, data_offset long, length long, axis_address long, axis_length long, columns int")
    pairs = spark.createDataFrame([("p", "s", bytearray(source), target), ("none", "s", bytearray(source), bytearray(b"\x01" * 2000))], "pair_id string, source_id string, source binary, target binary")
    found = {(r.pair_id, r.name): (r.linked, r.status, r.confidence) for r in linking.link(pairs, m).collect()}
    assert found["p", "same"] == (100, "exact", 100) and found["p", "moved"] == (900, "exact", 95) and found["p", "last"] == (3900, "exact", 95)
    assert found["p", "by axis"] == (1100, "fuzzy", 75) and found["p", "between"] == (1700, "fuzzy", 60) and found["p", "short"] == (50, "fuzzy", 50)
    assert found["none", "same"] == (100, "fuzzy", 40) and found["none", "last"] == (None, "not found", 0)


A2L = """/begin PROJECT p ""
/begin MOD_COMMON "" BYTE_ORDER MSB_LAST /end MOD_COMMON
/begin RECORD_LAYOUT KF NO_AXIS_PTS_X 1 UBYTE NO_AXIS_PTS_Y 2 UBYTE AXIS_PTS_X 3 UWORD INDEX_INCR DIRECT AXIS_PTS_Y 4 UWORD INDEX_INCR DIRECT FNC_VALUES 5 SWORD COLUMN_DIR DIRECT /end RECORD_LAYOUT
/begin RECORD_LAYOUT SST NO_AXIS_PTS_X 1 UWORD AXIS_PTS_X 2 UBYTE INDEX_INCR DIRECT /end RECORD_LAYOUT
/begin COMPU_METHOD lin "" LINEAR "%6.2" "rpm" COEFFS_LINEAR 0.25 -10 /end COMPU_METHOD
/begin COMPU_METHOD rat "" RAT_FUNC "%6.2" "%" COEFFS 0 2 0 0 0 1 /end COMPU_METHOD
/begin AXIS_PTS shared "" 0x8000200 n SST 1 lin 12 0 100 /end AXIS_PTS
/begin CHARACTERISTIC KFZW "a plane" MAP 0x8000100 KF 0 rat 0 100
  /begin AXIS_DESCR STD_AXIS n lin 8 0 1 /end AXIS_DESCR
  /begin AXIS_DESCR STD_AXIS m NO_COMPU_METHOD 4 0 1 /end AXIS_DESCR
/end CHARACTERISTIC
/begin CHARACTERISTIC KL "" CURVE 0x8000050 OTHER_BYTE 0 lin 0 100
  /begin AXIS_DESCR COM_AXIS n NO_COMPU_METHOD 12 0 1 AXIS_PTS_REF shared /end AXIS_DESCR
/end CHARACTERISTIC
/begin CHARACTERISTIC W "" VALUE 0x8000010 OTHER 0 NO_COMPU_METHOD 0 1 /end CHARACTERISTIC
/begin CHARACTERISTIC T "" ASCII 0x8000010 OTHER 0 NO_COMPU_METHOD 0 1 NUMBER 8 /end CHARACTERISTIC
/begin GROUP top "" ROOT /begin SUB_GROUP low /end SUB_GROUP /end GROUP
/begin GROUP low "" /begin REF_CHARACTERISTIC KFZW KL /end REF_CHARACTERISTIC /begin SUB_GROUP low /end SUB_GROUP /end GROUP
/end PROJECT"""


def test_a2l(spark):
    files = spark.createDataFrame([("f", A2L), ("empty", ""), ("bare", A2L.split("/begin GROUP")[0])], "file_id string, text string")
    rows = definitions.a2l_maps(files, 0x8000000).collect()
    found = {r.name: r for r in rows if r.file_id == "f"}
    assert [r.name for r in rows if r.file_id == "f"] == ["W", "KL", "KFZW"] and {r.file_id for r in rows} == {"f", "bare"}
    plane, line, value = found["KFZW"], found["KL"], found["W"]
    assert (plane.address, plane.columns, plane.rows, plane.width, plane.signed, plane.column_major, plane.data_offset, plane.length) == (0x100, 8, 4, 2, True, True, 26, 64)
    assert (plane.x_address, plane.x_bytes, plane.y_address, plane.y_points) == (0x102, 2, 0x112, 4) and plane.kind == "rational" and plane.rational[1] == 2 and (plane.x_a, plane.x_b) == (0.25, -10)
    assert (line.width, line.x_address, line.x_points, line.x_bytes, line.unit, line.x_unit, line.folder) == (1, 0x202, 12, 1, "rpm", "rpm", "top/low") and plane.folder == "top/low"
    assert (value.columns, value.width, value.length, value.folder, value.a) == (1, 2, 2, None, None)
    assert {r.name: r.folder for r in rows if r.file_id == "bare"} == {"W": "VALUE", "KL": "CURVE", "KFZW": "MAP"}


XDF = """<XDFFORMAT version="1.60"><XDFHEADER><BASEOFFSET offset="256" subtract="0"/><DEFAULTS signed="0" lsbfirst="1"/><CATEGORY index="0x0" name="Fuel"/><CATEGORY index="0x1" name="Spark"/></XDFHEADER>
<XDFTABLE uniqueid="0x1"><title>Plane</title><CATEGORYMEM index="0" category="2"/>
<XDFAXIS id="x"><EMBEDDEDDATA mmedaddress="0x300" mmedelementsizebits="8" mmedcolcount="6"/><units>rpm</units><MATH equation="X*40"/></XDFAXIS>
<XDFAXIS id="y"><units>-</units></XDFAXIS>
<XDFAXIS id="z"><EMBEDDEDDATA mmedaddress="0x400" mmedelementsizebits="16" mmedrowcount="4" mmedcolcount="6"/><MATH equation="X*0.5-20"/></XDFAXIS></XDFTABLE>
<XDFTABLE uniqueid="0x3"><title>Nowhere</title></XDFTABLE>
<XDFCONSTANT uniqueid="0x2"><title> One </title><EMBEDDEDDATA mmedaddress="0x10" mmedelementsizebits="32"/><units>s</units><MATH equation="(x+1)*2"/></XDFCONSTANT></XDFFORMAT>"""


def test_xdf(spark):
    files = spark.createDataFrame([("f", XDF), ("empty", "")], "file_id string, text string")
    plane, one = definitions.xdf_maps(files).orderBy("no").collect()
    assert (plane.name, plane.type, plane.address, plane.columns, plane.rows, plane.width, plane.a, plane.b, plane.folder, plane.big_endian) == ("Plane", "MAP", 0x300, 6, 4, 2, 0.5, -20.0, "Spark", False)
    assert (plane.x_address, plane.x_points, plane.x_scale.a, plane.x_unit) == (0x300, 6, 40.0, "rpm")
    assert (one.name, one.type, one.address, one.width, one.a, one.b, one.unit) == ("One", "VALUE", 0x10, 4, 2.0, 2.0, "s")
    equations = {"X": (1, 0), "x/4": (0.25, 0), "3*X": (3, 0), "X-5": (1, -5), "X*2+1e1": (2, 10), "X/0": None, "X*X": None, "": None}
    for text, want in equations.items():
        got = spark.range(1).select(definitions.linear_equation(F.lit(text)).alias("e")).first().e
        assert (got and tuple(got)) == want, text
