from tessera.sources import sidecars


def files(spark, *texts):
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file_id string, text string")


def test_trouble_codes(spark):
    text = "2 DTC entries.\r\n\r\n123456    Boost too low\r\nP0299    Underboost\r\n00101000    stored\r\n    warning lamp\r\n\r\n\r\n77\r\nP1\r\n"
    rows = sidecars.trouble_codes(files(spark, text, "", None)).orderBy("no").collect()
    assert [tuple(r)[2:] for r in rows] == [("123456", "Boost too low", "P0299", "Underboost", "00101000", ["stored", "warning lamp"]), ("77", None, "P1", None, None, [])]


def test_identification_and_profile(spark):
    text = "[10:11:12] : WVW123\n[10:11:12] F190: a:b\nF190: c\nnothing\n: later"
    rows = {r.file_id: r for r in sidecars.identification(files(spark, text, "", None, "k: v")).collect()}
    assert rows["0"].vin == "WVW123" and rows["0"].fields == {"F190": "c"} and rows["3"].vin is None and rows["3"].fields == {"k": "v"} and set(rows) == {"0", "3"}
    assert [r.channel for r in sidecars.profile(files(spark, "nmot;1;2\n\n ps_w \n", None)).orderBy("no").collect()] == ["nmot", "ps_w"]
