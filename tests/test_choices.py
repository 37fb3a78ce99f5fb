import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.functions import names
from cuemill.operators import choices

FILES = {
    "Show.Name.S02E05.1080p.mkv": (2, 5, None), "show 3x12 (2005).avi": (3, 12, 2005), "Season 1 Episode 4.mp4": (1, 4, None), "1917.1080p.mkv": (None, None, None), "Blade.Runner.2049.2017.mkv": (None, None, 2017),
    "Film (1999).web.mp4.mkv": (None, None, 1999), "": (None, None, None), "12345.mkv": (None, None, None),
}


def test_file_names(spark):
    s, e = names.season_episode(F.col("n"))
    df = spark.createDataFrame([(f,) for f in FILES], "n string")
    assert {r.n: (r.s, r.e, r.y) for r in df.select("n", s.alias("s"), e.alias("e"), names.media_year(F.col("n")).alias("y")).collect()} == FILES


@pytest.mark.parametrize("text, want", [("THE.lord_of THE rings", "The Lord of the RINGS"), ("a day in NASA", "A Day in NASA"), ("", "")])
def test_display(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(names.display_title(F.col("t")).alias("x")).first().x
    assert got.casefold() == want.casefold() and got[:1] == want[:1]


def test_identity(spark):
    df = spark.createDataFrame([("tt1", 5, None, None), ("tt1", None, None, 7), ("tt1", None, 3, None), (None, None, None, None)], "imdb string, tmdb int, tvdb int, tvmaze int")
    got = [r.x for r in df.select(names.external_id(F.col("imdb"), F.col("tmdb"), F.col("tvdb"), F.col("tvmaze")).alias("x")).collect()]
    assert got == ["tmdb:5", "tvmaze:7", "imdb:tt1", None]


def test_audio_choice(spark):
    rows = [("f", 0, False, 6.0, True), ("f", 1, False, 2.0, False), ("f", 2, True, 2.0, False), ("g", 0, False, 2.0, False), ("g", 1, False, 2.0, False)]
    df = spark.createDataFrame(rows, "f string, o int, d boolean, c double, r boolean")
    assert sorted(tuple(r) for r in choices.choose_audio(df, "f", "o", F.col("d"), F.col("c"), F.col("r")).collect()) == [("f", 2, False), ("g", 0, True)]


def test_correlation_and_parts(spark):
    a, b = [1.0, 2.0, 4.0, 3.0], [2.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([(a, b), (a, [1.0] * 4)], "a array<double>, b array<double>")
    got = [r.x for r in df.select(choices.correlation(F.col("a"), F.col("b")).alias("x")).collect()]
    assert np.isclose(got[0], np.corrcoef(a, b)[0, 1]) and got[1] is None
    parts = spark.range(1).select(choices.weighted_parts([(F.lit(1.0), 0.4), (F.lit(None).cast("double"), 0.2), (F.lit(0.0), 0.4)]).alias("x"), choices.weighted_parts([(F.lit(None).cast("double"), 0.2)]).alias("y")).first()
    assert np.isclose(parts.x, 0.5) and parts.y is None


def test_first_text(spark):
    df = spark.createDataFrame([(None, "  ", "c"), ("a", "b", None), (None, None, "")], "x string, y string, z string")
    assert [r.t for r in df.select(choices.first_text(F.col("x"), F.col("y"), F.col("z")).alias("t")).collect()] == ["c", "a", None]
