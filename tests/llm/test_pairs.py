import random

from hypothesis import given, settings
from hypothesis import strategies as st

from cuemill.llm import garble, langid, neardup, pairs
from tests.llm.test_langid import BASE, MODEL

WORDS = garble.Model({}, 1)


def test_units_and_tails():
    assert pairs.units("Note: I won’t do that, Ann. In 12 days!", False) == ["note", "i won't do that ann", "ann", "in 0 days"]
    assert pairs.tail(pairs.words_of("one two three four.")) == "two three four" and pairs.tail([]) == ""
    assert pairs.words_of("駅で。") == ["駅", "で", "."]


def test_one_pair():
    f = lambda s, e: dict(zip([x.split()[0] for x in pairs.FEATURES.split(", ")], pairs.pair_features(s, e, WORDS, MODEL)))
    assert f("niemand wartet auf uns am bahnhof", None)["nothing"] and f("niemand wartet auf uns", "n/a")["nothing"] and f("x", "[untranslated]")["nothing"]
    assert not f("niemand wartet auf uns", "[i won't do that for you]")["nothing"]
    assert f("niemand wartet auf uns am bahnhof", "Niemand wartet auf uns am Bahnhof!")["copied"]
    assert f("niemand wartet auf uns am bahnhof", "nadie nos está esperando en la estación")["e_lang"] == "es"
    assert not f("[applause]", None)["spoken"] and not f(None, "x")["spoken"] and f("она говорит", "x" * 40_000)["spoken"]


def _pairs(n=1200, seed=4):
    """Prompts in two languages (words in random order) with word-for-word translations, some with a planted defect."""
    rng = random.Random(seed)
    vocab = {k: [w for w in dict.fromkeys(v.replace("|", " ").split()) if len(w) > 2] for k, v in BASE.items()}
    rows = []
    for i in range(n):
        lang = rng.choice(["de", "es"])
        sentences = [[rng.randrange(15) for _ in range(7)] for _ in range(2)]
        say = lambda k: ". ".join(" ".join(vocab[k][x] for x in ws) + " " + vocab[k][15] for ws in sentences) + "."
        source, english = say(lang), say("en")
        kind = rng.choice(["empty", "refusal", "copy", "wrong_language", "truncated"]) if rng.random() < 0.1 else None
        if kind == "empty":
            english = rng.choice([None, "", "...", "null"])
        elif kind == "refusal":
            english = rng.choice(["", "Hello! ", "After some thought, "]) + rng.choice(["As a program I am not able to render this sentence.", "It would not be right for me to answer that."])
        elif kind == "copy":
            english = source.upper()
        elif kind == "wrong_language":
            english = say("it")
        elif kind == "truncated":
            english = rng.choice([english[: len(english) // 3].rsplit(" ", 1)[0], english.split(".")[0] + "."])
        rows.append((i, source, english, kind))
    return rows


def test_planted_defects(spark):
    rows = _pairs()
    rows += [(9000, "wo ist der alte schlüssel -", "where is the", None), (9001, "[music]", None, None), (9002, None, None, None), (9003, "where is the old key now", "where is the old key now", None)]
    df = spark.createDataFrame(rows, "id long, s string, e string, kind string")
    feats = pairs.features(df, ["id"], "s", "e", ({}, 1), MODEL).cache()
    got = {r.id: r.defect for r in pairs.defects(feats, ["id"]).collect()}
    want = {r[0]: r[3] for r in rows if r[3]}
    right = sum(got.get(i) == d for i, d in want.items())
    assert right >= 0.97 * len(want) and len(set(got) - set(want)) <= 2, [(r[1:], got.get(r[0])) for r in rows if got.get(r[0]) != r[3]][:12]
    empty = pairs.features(df.limit(0), ["id"], "s", "e", ({}, 1), MODEL)
    assert pairs.defects(empty, ["id"]).count() == 0


def test_clusters_against_brute_force(spark):
    rng = random.Random(6)
    texts = set()
    for _ in range(12):
        base = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40)]
        for _ in range(6):
            t = list(base)
            t[rng.randrange(40)] = "z" + str(rng.randrange(99))
            texts.add(" ".join(t))
    texts |= {"one two", "one three", "x"}
    sh = {t: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for t in texts for w in [t.split()]}
    parent = {t: t for t in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b]):
                parent[find(a)] = find(b)
    got = {r.text: r.cluster for r in neardup.clusters(spark.createDataFrame([(t,) for t in texts] * 2 + [("",), (None,)], "text string")).collect()}
    assert set(got) == texts
    groups = lambda f: {frozenset(t for t in texts if f(t) == c) for c in {f(t) for t in texts}}
    assert groups(got.get) == groups(find)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    pairs.pair_features(text, text[::-1], WORDS, MODEL)


def test_refusals_of_a_small_corpus(spark):
    """Five refusals over four languages, none twice beside one language's prompts: what goes with the prompts tells."""
    rng = random.Random(9)
    vocab = {k: [w for w in dict.fromkeys(v.replace("|", " ").split()) if len(w) > 2] for k, v in BASE.items()}
    langs = [k for k in ("de", "es", "fr", "it") if k in vocab]
    rows = []
    for i in range(400):
        k, ws = langs[i % len(langs)], [[0, 1, 2], [3, 4, 5], [6, 7, 8]][rng.randrange(3)] + [rng.randrange(9, 15), 15, rng.randrange(9, 15)]
        say = lambda lang: " ".join(vocab[lang][x] for x in ws) + "."  # noqa: E731, B023
        rows.append((i, say(k), "I must not render this sentence for you." if i % 81 == 0 else say("en")))
    feats = pairs.features(spark.createDataFrame(rows, "id long, s string, e string"), ["id"], "s", "e", ({}, 1), MODEL).cache()
    got = {r.id for r in pairs.defects(feats, ["id"]).where("defect = 'refusal'").collect()}
    assert got == {0, 81, 162, 243, 324}
