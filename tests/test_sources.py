import datetime

import pytest
from pyspark.sql import functions as F

from timeloom import schema
from timeloom.sources import store, texts
from timeloom.streaming import sessions

SCRIPT = """﻿[Script Info]
Title: x
[V4+ Styles]
Style: Default
[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
Dialogue: 0,0:00:01.50,0:00:02.50,*Default,,0,0,0,,{\\i1}hi{\\i0}, there\\Nyou
Dialogue: 0,0:01:30.00,0:01:35.00,OPjp,,0,0,0,,la\\hla
Dialogue: 0,0:01:36.00,0:01:40.00,opcn,,0,0,0,,lo
Dialogue: 0,0:21:00.00,0:21:05.00,edcn,,0,0,0,,end
Dialogue: 0,0:02:00.00,0:02:00.00,Default,,0,0,0,,zero
Comment: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,no
Dialogue: 0,1:00:00.00,1:00:01.00,title,,0,0,0,,Sign
"""
CUE = """PERFORMER "Band"
TITLE "Album"
FILE "a b.flac" WAVE
  TRACK 01 AUDIO
    TITLE "One"
    INDEX 01 00:00:00
  TRACK 02 AUDIO
    TITLE "Two"
    PERFORMER "Guest"
    INDEX 00 03:58:37
    INDEX 01 04:00:00
  TRACK 03 AUDIO
    INDEX 01 08:10:15
"""
LRC = "[ti:x]\n[offset:500]\n[00:10.00][00:20.50]twice <00:10.50>sung\n[00:12.00]\n[01:00.00]last\n"


def files(spark, text):
    return spark.createDataFrame([("f", text)], "path string, text string")


def test_scripts(spark):
    lines = texts.classified(texts.read_script(files(spark, SCRIPT)))
    got = [(r["start"], r["end"], r["kind"], r["part"], r["text"]) for r in lines.orderBy("n").collect()]
    assert got == [
        (1.5, 2.5, "dialogue", None, "hi, there\nyou"), (90.0, 95.0, "lyrics", "op", "la la"), (96.0, 100.0, "lyrics", "op", "lo"), (1260.0, 1265.0, "lyrics", "ed", "end"), (3600.0, 3601.0, "other", None, "Sign"),
    ]
    assert sorted(tuple(r) for r in texts.parts(lines, "path").collect()) == [("f", "ed", 1258.0, 1267.0), ("f", "op", 88.0, 102.0)]


def test_cue_and_lyrics(spark):
    got = [tuple(r) for r in texts.read_cue(files(spark, CUE)).orderBy("number").collect()]
    assert got == [("f", "a b.flac", 1, "One", "Band", 0.0, pytest.approx(238 + 37 / 75)), ("f", "a b.flac", 2, "Two", "Guest", 240.0, pytest.approx(490.2)), ("f", "a b.flac", 3, None, "Band", pytest.approx(490.2), None)]
    got = [tuple(r)[1:] for r in texts.read_lyrics(files(spark, LRC)).orderBy("start").collect()]
    assert got == [(9.5, 11.5, "twice sung"), (20.0, 30.0, "twice sung"), (59.5, 64.5, "last")]


def test_clocks_and_srt(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(texts.srt_clock(F.lit(3661.5))) == "01:01:01,500" and one(texts.script_clock(F.lit(61.257))) == "0:01:01.26"
    assert one(texts.clock_seconds(F.lit("1:02:03.5"))) == 3723.5 and one(texts.clock_seconds(F.lit("x"))) is None
    r = one(texts.time_range(F.lit("1:00-75")))
    assert (r["start"], r["end"]) == (60.0, 75.0)
    assert one(texts.script_escaped(F.lit("a{b}\\\n"))) == "a(b)\\\\\\N"
    lines = spark.createDataFrame([("s", 1.0, 2.0, "b"), ("s", 0.0, 1.0, "a")], "song string, start double, end double, text string")
    assert texts.srt(lines, "song").first()["value"] == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb\n"
    assert [tuple(r)[1:3] for r in texts.clipped(lines, 0.9, 5.0).collect()] == [(pytest.approx(0.1), pytest.approx(1.1))]


def test_store(spark, tmp_path):
    lib = store.Library(spark, str(tmp_path))
    assert lib.read("clusters").count() == 0
    lib.replace("clusters", spark.createDataFrame([(1, "a"), (2, None)], schema.TABLES["clusters"]))
    lib.upsert("clusters", spark.createDataFrame([(2, "b"), (3, None)], schema.TABLES["clusters"]))
    assert sorted(tuple(r) for r in lib.read("clusters").fillna("-").collect()) == [(1, "a"), (2, "b"), (3, "-")]
    assert lib.problems().count() == 0
    bad = store.parsed(spark.createDataFrame([('{"a": 1}',), ("{",)], "value string"), "a int")
    assert sorted((r["a"] or 0, r["problem"]) for r in bad.collect()) == [(0, "{"), (1, None)]
    assert store.documents(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"] == '{"a":1}'


def test_streams(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [("u", base + datetime.timedelta(seconds=s), 1.0) for s in (0, 10, 20, 200, 210)] + [("v", base + datetime.timedelta(seconds=5000), 2.0)]
    spark.createDataFrame(rows, "k string, t timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp, value double").parquet(str(tmp_path / "in"))
    found = {}
    for name, df in (("sessions", sessions.session_counts(stream, "k", "t", "60 seconds", "0 seconds")), ("windows", sessions.windowed(stream, "t", "1 minute", "0 seconds", "k")), ("capped", sessions.capped(stream, "k", "t", 60.0, 15.0, "0 seconds"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        found[name] = spark.table(name).collect()
    assert sorted(r["n"] for r in found["sessions"] if r["k"] == "u") == [2, 3]
    assert sorted((r["n"], r["total"]) for r in found["windows"] if r["k"] == "u") == [(2, 2.0), (3, 3.0)]
    assert [r["n"] for r in sorted(found["capped"], key=lambda r: r["start"]) if r["k"] == "u"][:2] == [2, 1]
