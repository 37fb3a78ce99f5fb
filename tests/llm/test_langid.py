import random

from cuemill.llm import langid as l
from pyspark.sql import functions as F

BASE = {
    "en": "i told you not to touch the box|we have to leave before the storm|nobody is waiting for us at the station|she says that you are lying|where is the old key now", "de": "ich habe dir gesagt du sollst das nicht anfassen|wir müssen vor dem sturm gehen|niemand wartet auf uns am bahnhof|sie sagt dass du lügst|wo ist der alte schlüssel jetzt",
    "fr": "je t'avais dit de ne pas toucher la boîte|nous devons partir avant la tempête|personne ne nous attend à la gare|elle dit que tu mens|où est la vieille clé maintenant", "es": "te dije que no tocaras la caja|tenemos que irnos antes de la tormenta|nadie nos está esperando en la estación|ella dice que mientes|dónde está la llave vieja ahora",
    "it": "ti avevo detto di non toccare la scatola|dobbiamo andarcene prima della tempesta|nessuno ci sta aspettando alla stazione|lei dice che menti|dov'è la vecchia chiave adesso", "pt": "eu disse para você não tocar a caixa|nós temos que ir embora antes da tempestade|ninguém está nos esperando na estação|ela diz que você mente|onde está a chave velha agora",
    "ru": "я же говорил тебе не трогать ящик|мы должны уйти до бури|никто не ждёт нас на вокзале|она говорит что ты лжёшь|где теперь старый ключ", "ja": "箱に触るなと言っただろう|嵐の前にここを出なければならない|駅で誰も私たちを待っていない|彼女は君が嘘をついていると言う|古い鍵は今どこだ",
}


def _lines(n, wrong, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(l.LANGS)
        text = ". ".join(rng.sample(BASE[lang].split("|"), 2))
        out.append((text, rng.choice(l.LANGS) if rng.random() < wrong else lang, lang))
    return out


TRAIN = _lines(3000, 0.08)
MODEL = l.fit([t for t, _, _ in TRAIN], [y for _, y, _ in TRAIN])


def test_held_out_accuracy_despite_wrong_labels():
    test = _lines(400, 0, seed=9)
    right = sum([s[0] for s in MODEL.stretches(t)] == [lang] for t, _, lang in test)
    assert right >= 396
    assert sum([s[0] for s in MODEL.stretches(t, "ja" if lang != "ja" else "en")] == [lang] for t, _, lang in test) >= 396


def test_mixed():
    got = MODEL.stretches("nobody is waiting for us at the station. niemand wartet auf uns am bahnhof; 駅で誰も私たちを待っていない")
    assert [s[0] for s in got] == ["en", "de", "ja"] and all(0.4 <= s[1] <= 1 for s in got)
    assert got[0][2] == 0 and got[0][3] == 39


def test_edges():
    for text in (None, "", "…", "12 34", "♪"):
        assert MODEL.stretches(text) == []
    assert [s[0] for s in MODEL.stretches("nobody is waiting " * 3000)] == ["en"]
    assert l.fit([], []).stretches("x") == []


def test_labels(spark):
    df = spark.createDataFrame([("German",), ("deu",), (" ES ",), ("pt-BR",), ("und",), ("",), (None,), ("Klingon",), ("日本語",)], "x string")
    assert [r.c for r in df.select(l.label_code(F.col("x")).alias("c")).collect()] == ["de", "de", "es", "pt", None, None, None, "other", "ja"]


def test_rows(spark):
    rows = [(1, "she says that you are lying", "de", "z"), (1, "she says that you are lying", "de", "z"), (2, None, None, "z"), (3, "", "en", "z"), (4, "она говорит что ты лжёшь", None, "z")]
    df = spark.createDataFrame(rows, "id long, t string, label string, segments string")
    got = sorted((r.id, [s.lang for s in r.segments]) for r in l.identify(df, ["id"], "t", "label", MODEL).collect())
    assert got == [(1, ["en"]), (1, ["en"]), (2, []), (3, []), (4, ["ru"])]
    assert l.identify(df.limit(0), ["id"], "t", "label", MODEL).count() == 0
    assert l.sample(df, "t", "label", 1) == (["she says that you are lying"], ["de"])


def test_sample_holds_every_language(spark):
    from cuemill.llm import langid

    assert langid.quotas({"en": 1000, "de": 5, "ja": 40}, 90) == {"de": 5, "ja": 40, "en": 45} and langid.quotas({}, 9) == {}
    rows = [(f"line {i}", "en") for i in range(3000)] + [(f"zeile {i}", "de") for i in range(9)] + [("x", None), ("", "en")]
    texts, labels = langid.sample(spark.createDataFrame(rows, "t string, l string"), "t", "l", 100)
    assert len(texts) == 100 and labels.count("de") == 9 and set(texts) <= {r[0] for r in rows}
