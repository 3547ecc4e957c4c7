"""Queries beside their SQL on small tables of odd rows."""

import re

import duckdb
import verify
from tessera.operators import search
from tessera.plans import registry
from tessera.sources import images


def compared(spark, folder, name, table, sql):
    """The query on a table made by SQL equals its own SQL there; its rows."""
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet'")
    con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, str(folder))
    mine = verify.rows_of(frame.columns, rows := frame.collect())
    result = con.execute(registry.ORACLES[name])
    assert mine == verify.rows_of([d[0] for d in result.description], result.fetchall())
    return rows


def test_peak_of_several_channels(spark, tmp_path):
    """Of equal peaks the first one's channel counts, in time and then by event."""
    values = "(3, 30, 1, 'late', 9.0), (2, 20, 1, 'second', 9.0), (1, 20, 1, 'first', 9.0), (0, 10, 1, 'low', 1.0), (4, 0, 2, 'none', NULL), (5, 1, 3, NULL, 5.0), (6, 2, 3, 'named', 5.0)"
    rows = compared(spark, tmp_path, "A15_pull_statistics", "events", f"SELECT id::BIGINT AS event_id, make_timestamp(s * 1000000) AS ts, u::BIGINT AS user_id, c AS event_type, v::DOUBLE AS value FROM (VALUES {values}) t(id, s, u, c, v)")
    assert {r.log_id: r.channel_at_peak for r in rows} == {1: "first", 2: None, 3: "named"}


def test_long_codes(spark, tmp_path):
    """A number of more than five hexadecimal digits keeps them all."""
    rows = compared(spark, tmp_path, "S12_trouble_codes", "part", "SELECT k::BIGINT AS p_partkey, 'red ring' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, 7 AS p_size FROM (VALUES (7), (1048575), (1048576), (4294967296)) t(k)")
    assert {r.code for r in rows} == {"00007", "FFFFF", "100000", "100000000"}


def test_assembled_without_a_join(spark):
    """Gaps, missing bytes and images without an id; nothing is joined, so nothing can be broadcast."""
    rows = [(1, 5, 7), (1, 3, 1), (1, 9, None), (None, 2, 4), (2, 0, 255), (3, None, 1)]
    found = images.assemble(spark.createDataFrame(rows, "image_id long, address long, byte int"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.image_id: (r.base_address, bytes(r.bytes)) for r in found.collect()} == {1: (3, b"\x01\xff\x07\xff\xff\xff\xff"), None: (2, b"\x04"), 2: (0, b"\xff")}


def test_overlap_of_many_keys(spark, monkeypatch):
    """In blocks of any size the pairs are those of all sets, also of nulls and names."""
    rows = [(k, k * i % 7 + k % 3) for k in range(-9, 40) for i in range(5)] * 2 + [(None, 1), (3, None), (4, None)]
    for kind, name in (("long", lambda k: k), ("string", lambda k: k if k is None else f"k{k}")):
        sets = {}
        for k, i in rows:
            sets.setdefault(name(k), set()).add(i)
        least, own = 0.4, {k: s - {None} for k, s in sets.items() if k is not None}
        wanted = {(a, b): len(own[a] & own[b]) / (len(sets[a]) + len(sets[b]) - len(own[a] & own[b])) for a in own for b in own if a < b and own[a] & own[b]}
        frame = spark.createDataFrame([(name(k), i) for k, i in rows], f"k {kind}, i int")
        for size in (7, 500):
            monkeypatch.setattr(search, "KEYS_A_BLOCK", size, raising=False)
            found = search.overlap_pairs(frame, "k", "i", least)
            assert not re.search(r"hashpartitioning\(a#\d+L?, b#", found._jdf.queryExecution().executedPlan().toString())  # no pair is shuffled to be counted
            assert {(r.a, r.b): r.jaccard for r in found.collect()} == {p: j for p, j in wanted.items() if j >= least}
    assert search.overlap_pairs(frame.where("false"), "k", "i", least).count() == 0
