import difflib

import pytest
from pyspark.sql import functions as F

from cuemill.functions import text as t
from cuemill.sinks import exports
from cuemill.sources import subtitles


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("title, key", [("Amélie  (2001)", "amelie 2001"), ("WALL·E", "walle"), ("  ", ""), (None, None), ("Ærø—Øl!", "rl")])
def test_title(spark, title, key):
    assert t.fold_title(title) == key
    assert one(spark, t.normalize_title(F.col("a").cast("string")), a=title) == key


def test_words_and_pace(spark):
    assert one(spark, t.spoken_words(F.col("a")), a="I'm 21, OK?") == "i'm two one ok"
    assert one(spark, t.estimated_seconds(F.col("a")), a="") == 0.35
    assert one(spark, t.estimated_seconds(F.col("a")), a="one, two three.") == pytest.approx(3 / 3.39 + 0.06 + 0.08)
    assert one(spark, t.names_in(F.col("a")), a="The doctor saw Renée and Anna-Lena. You know Anna-Lena?") == ["Renée", "Anna-Lena"]
    assert one(spark, t.emotion(F.col("a")), a="I love it, thank you") == "happy" and one(spark, t.emotion(F.col("a")), a="the box") == "calm"
    assert one(spark, t.replace_terms(F.col("a"), {"mill": "$1", "old mill": "x"}), a="The OLD mill, a mill, miller") == "The x, a $1, miller"


def test_clock(spark):
    for ms, text in ((0, "00:00:00,000"), (3_723_004, "01:02:03,004"), (359_999_999, "99:59:59,999")):
        assert one(spark, t.clock(F.col("a").cast("bigint")), a=ms) == text and one(spark, t.clock_ms(F.col("a")), a=text) == ms
    assert one(spark, t.clock_ms(F.col("a")), a="1:2:3") is None
    assert one(spark, exports.timecode(F.col("a").cast("bigint")), a=3_600_500) == "01:00:00:12"


def test_python_functions(spark):
    pairs = [("abc def", "abd def x"), ("", ""), (None, "a"), ("x" * 300, "x" * 299 + "y")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(t.sequence_ratio("a", "b").alias("r"), t.word_distance("a", "b").alias("d"), t.comparable("a").alias("c")).collect()
    assert [r.r for r in got] == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [r.d for r in got] == [2, 0, None, 1]
    js = spark.createDataFrame([('think {"a": [1, 2]} so',), ("[broken {\"b\":1}",), ("none",), (None,)], "a string")
    assert [r.x for r in js.select(t.first_json("a").alias("x")).collect()] == ['{"a":[1,2]}', '{"b":1}', None, None]


SRT = """﻿1
00:00:01,000 --> 00:00:02,500 X1:10
<i>Hello</i> {\\an8}there &amp; you

2
00:00:03.000 --> 00:00:04,000
- ANNA: Who?
- [door] BOB: Me.

00:00:05,000 --> 00:00:06,000
[music]

4
00:00:07,000 --> 00:00:08,000
two
lines
"""


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT.replace("\n", "\r\n"), encoding="utf-8")
    cards = subtitles.srt_cards(subtitles.read_files(spark, str(tmp_path))).orderBy("start_ms", "card_rank").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.speaker_hint, r.simultaneous, r.card_rank) for r in cards] == [
        (1000, 2500, "Hello there & you", None, False, 0), (3000, 4000, "Who?", "Anna", True, 0), (3000, 4000, "Me.", "Bob", True, 1), (7000, 8000, "two lines", None, False, 0),
    ]
    assert cards[2].notes == ["door"]
    sub = spark.createDataFrame([("f", "{24}{48}one|two\nno frame\n{72}{96}{y:i}three"), ("g", "plain")], "file string, content string")
    assert [(r.start_ms, r.end_ms, r.text) for r in subtitles.microdvd_cards(sub, 24.0).orderBy("start_ms").collect()] == [(1000, 2000, "one two"), (3000, 4000, "three")]
    assert [r.x for r in sub.select(subtitles.is_microdvd(F.col("content")).alias("x")).collect()] == [True, False]
    rates = spark.createDataFrame([("24000/1001",), ("25",), ("0/0",), ("x",), (None,)], "r string")
    assert [round(r.x, 3) for r in rates.select(subtitles.frames_per_second(F.col("r")).alias("x")).collect()] == [23.976, 25.0, 23.976, 23.976, 23.976]
    files = spark.createDataFrame([("A.sub",), ("a.IDX",), ("b.sub",)], "n string")
    assert [r.stem for r in subtitles.pair_by_stem(files, "n", [".sub", ".idx"]).collect()] == ["a"]


def test_srt_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([("j", 1000, 2000, "One."), ("j", 2500, 3000, "Two."), ("k", 5, 10, "Three.")], "job string, s long, e long, t string")
    exports.write_srt(cues, str(tmp_path / "out"), "job", "s", "e", "t")
    back = subtitles.srt_cards(subtitles.read_files(spark, str(tmp_path / "out" / "job=j"))).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in back] == [(1000, 2000, "One."), (2500, 3000, "Two.")]
