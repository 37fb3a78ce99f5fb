import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuemill.functions import names, replies
from cuemill.operators import gates, rules
from cuemill.sources import records

NAMES = {
    "f1-Waterboys.2001.Japanese.EnglishSubtitles.mkv": ("Waterboys", 2001, "movie", None, None), "The.Last.of.Us.S01E03.2160p.WEB-DL.DDP5.1.H.265-NTb.mkv": ("The Last of Us", None, "tv", 1, 3), "The Last of Us - 1x04 - Please Hold to My Hand.mkv": ("The Last of Us", None, "tv", 1, 4),
    "1917.1080p.BluRay.mkv": ("1917", None, "movie", None, None), "2001.A.Space.Odyssey.1968.2160p.mkv": ("2001 A Space Odyssey", 1968, "movie", None, None), "Waterboys (2001) Remux.mkv": ("Waterboys", 2001, "movie", None, None), "": ("Untitled Media", None, "movie", None, None), "x" * 5000: ("X" + "x" * 4999, None, "movie", None, None),
}


@pytest.mark.parametrize("name", NAMES)
def test_names(name):
    got = names.read_name(name)
    want = NAMES[name]
    assert (got[0].title() if not name else got[0], *got[2:6]) == want


def test_ids_and_ranges(spark):
    rows = [("Slow.Horses.S04E01-E02.{tmdb=95480}.mkv",), ("Dark.S01E01.{tvmaze=178}.mkv",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "n string").select(names.parse_name(F.col("n")).alias("p")).collect()]
    assert (got[0].tmdb_id, got[0].season, got[0].episode, got[0].episode_end) == (95480, 4, 1, 2) and got[1].tvmaze_id == 178 and got[2].title is None
    assert names.title_case("McDonald as a spy but not NASA") == "McDonald as a Spy but Not NASA"
    same = spark.createDataFrame([("McDonald as a spy but not NASA",)], "t string").select(names.display_title(F.col("t")).alias("x")).first().x
    assert same == "McDonald as a Spy but Not NASA"
    files = spark.createDataFrame([("movie.mkv", "Waterboys (2001)", "x"), ("movie.mkv", "Downloads", "x"), ("S01E02.mkv", "Season 1", "Dark (2017)"), ("Other.Film.1999.mkv", "Waterboys (2001)", "x")], "f string, d string, u string")
    assert [r.p.title for r in files.select(names.folder_or_file(F.col("f"), F.col("d"), F.col("u")).alias("p")).collect()] == ["Waterboys", "Movie", "Dark", "Other Film"]


def test_records(spark):
    nfo = ["<movie><title>Old House</title><year>1999</year><uniqueid type='imdb'>tt1234567</uniqueid></movie>", "<!DOCTYPE x><movie/>", "<tvshow><title>Ep</title><showtitle>Show</showtitle><tvdbid>77</tvdbid></tvshow>", "no xml", "", None]
    got = [records.read_nfo(t) for t in nfo]
    assert got[0] == ("movie", "Old House", 1999, "tt1234567", None, None) and got[2] == ("tv", "Show", None, None, None, "77") and all(g[0] is None for g in (got[1], *got[3:]))
    assert spark.createDataFrame([(t,) for t in nfo], "t string").select(records.parse_nfo("t").alias("p")).where("p.title is not null").count() == 2
    files = spark.createDataFrame([("e", "# c\nA=1\nA=2\nB = \"x y\" \n=3\n1C=4\nno line\nD=a=b"), ("f", "")], "file string, content string")
    assert {(r.key, r.value) for r in records.env_entries(files).collect()} == {("A", "1"), ("B", "x y"), ("D", "a=b")}
    assert {(r.term, r.said) for r in records.glossary_entries(spark.createDataFrame([("g", "Oberkrug = OH-ber-kroog\nx =\n = y\nOberkrug = ober")], "file string, content string")).collect()} == {("Oberkrug", "ober")}
    one, two = (spark.createDataFrame([(x,) for x in xs], "file string") for xs in (["Film.mkv"], ["A.mkv", "b.mkv"]))
    subs = spark.createDataFrame([("a.srt",), ("B.en.srt",), ("B.srt",)], "file string")
    assert records.with_sidecar(one, subs).count() == 3 and {(r.source, r.sidecar) for r in records.with_sidecar(two, subs).collect()} == {("A.mkv", "a.srt"), ("b.mkv", "B.srt")}
    kinds = spark.createDataFrame([("a.SRT", ""), ("a.sub", "{1}{2}x"), ("a.sub", "x"), ("a.ass", "")], "n string, c string")
    assert [r.x for r in kinds.select(records.reader_of(F.col("n"), F.col("c")).alias("x")).collect()] == ["srt", "microdvd", "convert", "convert"]
    probe = '{"streams": [{"index": 1, "codec_type": "audio", "codec_name": "aac", "channels": 2, "tags": {"language": "ENG"}, "disposition": {"default": 1}}]}'
    streams = records.probed_streams(spark.createDataFrame([("f", probe), ("g", "broken")], "file string, probe string")).collect()
    assert [(r["file"], r["index"], r.language, r.is_default) for r in streams] == [("f", 1, "eng", True)]


def test_folders(spark, tmp_path):
    for line, time in ((3, 10), (3, 20), (4, 5)):
        (tmp_path / "t" / str(line) / str(time)).mkdir(parents=True)
        (tmp_path / "t" / str(line) / str(time) / "a.wav").write_bytes(b"x")
    assert sorted((r.line_no, r.taken_at) for r in records.takes(spark, str(tmp_path / "t")).collect()) == [(3, 10), (3, 20), (4, 5)]
    (tmp_path / "m.json").write_text('[{"id": 1, "text": "a"}, {"id": 2}]')
    assert sorted((r.id, r.text) for r in records.read_manifest(spark, str(tmp_path / "m.json"), "id int, text string").collect()) == [(1, "a"), (2, None)]
    for n in (3, 2):
        records.replace_table(spark.range(n), str(tmp_path / "out"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == n and not (tmp_path / "out.tmp").exists()


def test_replies(spark):
    df = spark.createDataFrame([('{"natural": "He said "no" twice", "compact": "b\\n c"}',), ('{"natural": ""}',), (None,)], "t string")
    assert [r.x for r in df.select(replies.scraped_field(F.col("t"), "natural").alias("x")).collect()] == ['He said "no" twice', None, None]
    assert df.select(replies.scraped_field(F.col("t"), "compact").alias("x")).first().x in ("b c", "b\\n c")
    w = spark.range(1).select(replies.wordings({"literal": F.lit("z"), "natural": F.lit(" a  b "), "compact": F.lit("a b"), "fuller": F.lit("Null")}).alias("w")).first().w
    assert w == ["a b", "z"]
    s = spark.createDataFrame([(80.0, 0.9, 70.0), (0.0, 0.0, 0.0), (None, 1.0, 1.0)], "a double, n double, r double").select(replies.judged_scores({"adequacy": F.col("a"), "names": F.col("n"), "register": F.col("r")}).alias("s")).collect()
    assert [(round(r.s.adequacy, 3), r.s.reported) for r in s] == [(0.8, True), (0.0, False), (0.0, False)]
    assert [r.x for r in spark.createDataFrame([(3661.5,), (0.5,), (None,)], "s double").select(replies.clock_text(F.col("s")).alias("x")).collect()] == ["1:01:02", "0:00:00", None]


def test_line_rules_fail_closed(spark):
    """A line of which nothing was measured misses all of it; a good one passes."""
    keys = [*gates.LINE_MEASURES, *gates.TAKE_MEASURES, "verdict_available", "verdict_passed", "overlapping", "overlap_kept", "mouth_visible", "active_seconds", "voice_similarity", "voice_reliable", "fallback_engine", "full_clone", "leakage", "made", "seconds", "contour_similarity", "pause_delta", "pitch_delta", "peak", "active_ratio"]
    flags = {"timing_pass", "verdict_available", "verdict_passed", "overlapping", "overlap_kept", "mouth_visible", "voice_reliable", "fallback_engine", "full_clone", "made"}
    good = {k: 0.9 for k in keys} | {"stretch_percent": 5.5, "padding_ms": 0.0, "truncated_ms": 0.0, "wer": 0.0, "cer": 0.0, "leakage": 0.0, "pause_delta": 0.0, "pitch_delta": 0.0} | {k: k not in ("overlapping", "mouth_visible", "fallback_engine") for k in flags}
    frame = spark.createDataFrame(pd.DataFrame([good]), ", ".join(f"{k} {'boolean' if k in flags else 'double'}" for k in good))
    row = lambda **x: frame.select(*[F.lit(x[k]).cast("boolean" if k in flags else "double").alias(k) if k in x else F.col(k) for k in good])
    told = lambda df: df.select(rules.reasons(gates.line_rules({k: F.col(k) for k in keys})).alias("r")).first().r
    assert told(frame) == []
    assert told(row(mouth_visible=True)) == ["stretched"] and told(row(pitch_delta=3.6, seconds=0.5)) == [] and told(row(voice_similarity=0.5, voice_reliable=False)) == []
    nothing = told(row(**dict.fromkeys(keys)))
    assert nothing[:14] == [f"missing {k}" for k in gates.LINE_MEASURES + gates.TAKE_MEASURES] and nothing[14] == "verdict missing" and nothing[-1] == "not made" and "timing failed" not in nothing


def test_gates(spark):
    df = spark.createDataFrame([("it is late", "it is late!", 0.9, 0.9, 0.0, 0.8), ("it is late", "the boat left", 0.9, 0.9, 0.0, 0.8), ("it is late", "the boat left", 0.4, 0.9, 0.0, 0.8), ("", None, 0.9, 0.9, 0.0, None)], "a string, b string, c double, w double, n double, k double")
    got = [r.d for r in df.select(gates.disputed(*[F.col(c) for c in "abcwnk"]).alias("d")).collect()]
    assert [(d.disputed, d.confidence) for d in got] == [(False, 0.8), (True, 0.5), (False, 0.8), (False, None)]
    rows = spark.createDataFrame([("g", i, z) for i, z in enumerate([5, 5, 5, 50, 1, 1, 1])], "g string, i int, z int")
    assert [r.batch_no for r in gates.running_batches(rows, "g", ["i"], "z", 3, 20).orderBy("i").collect()] == [0, 0, 0, 1, 2, 2, 2]
    history = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, at int, v string")
    assert [(r.k, r.v) for r in gates.as_of(history, ["k"], "at", F.lit(6), ["v"]).collect()] == [("a", "y")]
    assert [(r.k, r.at) for r in gates.cached(history, ["k"], "v", F.lit("x"), "at").collect()] == [("a", 1)]


def test_signals(spark):
    import numpy as np

    from cuemill.operators import signals

    a, b = [0.1, 0.9, 0.4, 0.2], [0.2, 0.8, 0.5, 0.1]
    df = spark.createDataFrame([(a, b, [0.5] * 4, [])], "a array<double>, b array<double>, f array<double>, e array<double>")
    col = lambda c: df.select(c.alias("x")).first().x
    assert np.isclose(col(signals.contour_similarity(F.col("a"), F.col("b"))), np.corrcoef(a, b)[0, 1]) and np.isclose(col(signals.contour_similarity(F.col("a"), F.col("f"))), 1 - np.abs(np.array(a) - 0.5).mean())
    assert col(signals.contour_similarity(F.col("a"), F.col("e"))) is None and col(signals.rms(F.col("e"))) is None
    assert np.allclose(col(signals.crossfade(F.col("f"), F.col("f"))), 0.5) and np.isclose(col(signals.leakage(F.col("a"), F.col("a"))), 1.0)
    fit = col(signals.fit(F.lit(2.2), F.lit(2.0), 0.05))
    assert np.isclose(fit.tempo, 1.05) and np.isclose(fit.truncated_ms, (2.2 / 1.05 - 2) * 1000) and not fit.ok
    lines = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, -3.0])], "at int, s array<double>")
    assert [round(r.value, 3) for r in signals.mixed(lines, "at", "s").orderBy("frame").collect()] == [0.327, 0.653, -0.98]
    loops = signals.rounds(spark.createDataFrame([(9.0,), (1.0,), (100.0,), (None,)], "v double"), "v", lambda v: v > 3, lambda v: v / 2)
    assert [(r.v, r.attempts) for r in loops.collect()] == [(2.25, 2), (1.0, 0), (12.5, 3), (None, 0)]
    v = np.array([[1.0, 0], [0.99, 0.1], [1.0, 0.02], [0, 1.0], [0, 0]])
    assert signals.one_identity([(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "z")], v)[:4] != [0, 0, 0, 1]
    got = signals.one_identity([(0, "a"), (1, "a"), (1, "b"), (2, "z")], v[[0, 2, 3, 4]])
    assert got[0] == got[1] != got[2] and got[3] == max(got)


def test_agreed_windows(spark):
    row = "g string, i int, t string, a double"
    p = spark.createDataFrame([("a", 1, "it is", 0.8), ("a", 2, "late", 0.8), ("b", 1, "boat", 0.8), ("c", 1, "same", 0.8), ("d", 1, "x", None)], row)
    h = spark.createDataFrame([("a", 1, "it is late", 0.76), ("b", 1, "house", 0.79), ("c", 1, "else", 0.84), ("e", 1, "y", 1.0)], row)
    got = {(r.g, r.i): (r.side, round(r.agreement, 3), round(r.confidence, 4)) for r in gates.agreed_windows(p, h, ["g"], "t", "a", ["i"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", 1): "higher", ("b", 1): "primary", ("c", 1): "higher"}
    assert got["a", 1][1:] == (1.0, round(0.46 * 0.76 + 0.34 + 0.184, 4)) and got["b", 1][1] < 0.72
