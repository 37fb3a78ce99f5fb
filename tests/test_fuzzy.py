import difflib
import math
import random

from cuemill.operators.choices import Catalogue
from cuemill.plans.choice_queries import fuzzy_candidates

ENTRIES = [(1, "Hidden Fountain", "Verborgener Brunnen", 1999, "movie", 5.0), (2, "The Copper Magician", None, 2004, "movie", 3.0), (3, "Crooked Lantern", "La Linterna", None, "series", None)]


def _write(spark, at, names, entries):
    spark.createDataFrame(names, "name_id long, normalized_title string, media_year int, media_type string").write.parquet(f"{at}/media_names.parquet")
    spark.createDataFrame(entries, "catalogue_id long, title string, original_title string, media_year int, media_type string, popularity double").write.parquet(f"{at}/catalogue.parquet")


def test_names_without_a_shared_word(spark, tmp_path):
    names = [(10, "hiddenfountain", 1999, "movie"), (11, "the coper maagician", None, "movie"), (12, "verborgener brunnen", 1999, "movie"), (13, "crrooked lanternn", 2001, "series"), (14, "xyz", None, None), (15, "", None, None)]
    _write(spark, tmp_path / "a", names, ENTRIES)
    got = {r.name_id: r for r in fuzzy_candidates(spark, str(tmp_path / "a")).collect()}
    assert {k: r.catalogue_id for k, r in got.items() if k != 14} == {10: 1, 11: 2, 12: 1, 13: 3} and not got[14].accepted
    assert got[12].score == 980 and got[12].accepted and got[10].accepted
    _write(spark, tmp_path / "b", names, [])
    assert [(r.catalogue_id, r.accepted) for r in fuzzy_candidates(spark, str(tmp_path / "b")).collect()] == [(None, False)] * 5


def test_best_against_all():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    title = lambda: " ".join(word() for _ in range(rng.randint(1, 3)))
    entries = [(i, [title() for _ in range(rng.randint(0, 2))], rng.choice([None, 2000, 2001, 2004]), rng.choice("mt"), float(rng.randint(0, 3))) for i in range(80)]
    catalogue = Catalogue(entries)
    for _ in range(200):
        q, year, kind = title(), rng.choice([None, 2000, 2003]), rng.choice(["m", "t", None])
        scores = []
        for i, names, y, k, pop in entries:
            jac = lambda n: len(set(q.split()) & set(n.split())) / len(set(q.split()) | set(n.split()))  # noqa: B023, E731
            s = max([max(difflib.SequenceMatcher(None, q, n).ratio(), jac(n)) for n in names], default=0.0)
            d = None if year is None or y is None else abs(year - y)
            b = (0.04 if year is None else 0.0 if d is None else {0: 0.19, 1: 0.07}.get(d, -min(0.2, 0.04 * d))) + (0.0 if kind is None else 0.07 if kind == k else -0.11)
            scores.append((-math.floor(max(0.0, min(1.0, 0.72 * s + b)) * 1000 + 0.5), -pop, i))
        scores.sort()
        assert catalogue.best(q, [(year, kind)]) == [(scores[0][2], -scores[0][0], scores[1][0] - scores[0][0])]
