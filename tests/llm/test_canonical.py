from hypothesis import given, settings
from hypothesis import strategies as st

from cuemill.llm import canonical
from pyspark.sql import functions as F

ENTRIES = [
    (1, "the velvet pilgrim", 1984, "movie", 5.0), (2, "the velvet pilgrim", 2004, "movie", 9.0), (3, "the velvet pilgrim 2", 1988, "movie", 1.0), (4, "quarry of oberkrug", 1955, "tv", 3.0),
    (5, "oberkrug of quarry", 1955, "movie", 3.0), (6, "the salt harvest", 1999, "movie", 1.0), (6, "przystan belgratz", 1999, "movie", 1.0), (7, "a butcher in belgratz", None, None, None),
]
CASES = {
    ("the velvet pilgrim", 1984, "movie"): 1, ("the velvet pilgrim", 2003, None): 2, ("the velvet pilgrim", None, None): 2, ("the velvet pilgrim", 1960, "movie"): 0, ("the velvt pligrim part 2", 1988, "movie"): 3,
    ("the velvet pilgrim ii", None, None): 3, ("the velvet pilgrim 3", 1990, None): 0, ("quarryof oberkurg", None, None): 4, ("oberkrug of quarry", None, None): 5, ("salt harvest the", 1999, None): 6,
    ("przystan belgra", None, None): 6, ("a butcher in be1gratz extended cut", 1950, "tv"): 7, ("velvet bagpipes", None, None): 0, ("", 1999, None): 0, ("x" * 3000, None, None): 0,
}


def test_matches(spark):
    typed = spark.createDataFrame([*CASES], "title string, year int, kind string")
    entries = spark.createDataFrame(ENTRIES, "entry_id long, key string, year int, kind string, rank double")
    got = {(r.title, r.year, r.kind): r.entry_id for r in canonical.match_titles(typed, entries, content_share=0.5).collect()}
    assert {k: got.get(k, 0) for k in CASES} == CASES
    assert canonical.match_titles(typed.limit(0), entries).count() == 0
    assert canonical.match_titles(typed, entries.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance(a, b):
    d = canonical.osa(a, b)
    assert d == canonical.osa(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert canonical.osa("belgratz", "beelgrazt") == 2 and canonical.osa("the", "teh") == 1


def test_neighbourhoods_meet(spark):
    words = spark.createDataFrame([("beekeeper",), ("the",), ("magician",)], "word string")
    tokens = spark.createDataFrame([("bekeeepr",), ("mgaiciian",), ("teh",), ("themagician",), ("magic",), ("zzz",)], "token string")
    got = {(r.token, r.word, r.kind) for r in canonical.repairs(tokens, words).collect()}
    assert {("mgaiciian", "magician", "edit"), ("teh", "the", "edit"), ("themagician", "the", "split"), ("themagician", "magician", "split"), ("magic", "magician", "prefix")} <= got
    assert not any(t == "zzz" for t, _, _ in got)
    assert words.where(F.col("word") == "x").count() == 0


def test_long_words_are_joined_exactly(spark):
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(n)) for n in (23, 24, 25, 26, 27, 30, 49, 60, 90, 200)]

    def edit(w, kinds):
        for k in kinds:
            i = rng.randrange(1, len(w) - 2)
            w = w[:i] + w[i + 1 :] if k == "cut" else w[:i] + "x" + w[i:] if k == "add" else w[:i] + "y" + w[i + 1 :] if k == "put" else w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        return w

    typed = {edit(w, rng.choices(["cut", "add", "put", "swap"], k=rng.randint(0, 3))) for w in words for _ in range(12)}
    got = {(r.token, r.word) for r in canonical.repairs(spark.createDataFrame([(t,) for t in typed], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).where("kind = 'edit'").collect()}
    assert got == {(t, w) for t in typed for w in words if canonical.osa(t, w) <= 2}


def test_entries_of_frequent_words(spark):
    """Every word is in most entries: the rarest of each still finds it."""
    entries = spark.createDataFrame([(i, k, None, None, None) for i, k in enumerate(["old house", "old river", "house river", "old house river"] * 2)], "entry_id long, key string, year int, kind string, rank double")
    typed = spark.createDataFrame([("old houze", None, None), ("house river", None, None)], "title string, year int, kind string")
    assert {r.title: r.entry_id for r in canonical.match_titles(typed, entries).collect()} == {"old houze": 0, "house river": 2}
