import random
from collections import Counter
import re

import pytest

from cuemill.llm import garble as g

TEXTS = [
    "Está bien, dame el álbum y vete a casa mañana.", "Je n’ai rien dit, c’était là derrière l’église.", "Wir müssen vor Sonnenaufgang gehen, bevor Zoë zurückkommt.", "Мы должны уйти до рассвета, а я ничего не сказал.",
    "“I won’t do that, Tomás — don’t ask me again…”", "Não se esqueça de que você comprou o rádio.", "Il dottore dice che è più freddo qui.", "手紙を持って行け、そうすれば安全だ。", "NON LO FARÒ, ZOË, PERCHÉ?",
]
COUNTS = Counter(w for t in TEXTS for w in re.findall(r"[^\W\d_]+", t.lower()))
MODEL = g.Model({w: 50 * n for w, n in COUNTS.items()}, 50 * sum(COUNTS.values()))


def misread(text, true, read):
    table = {b: c for c, b in g.byte_of(read).items()}
    return "".join(table[b] for b in text.encode(true))


@pytest.mark.parametrize("text", TEXTS)
def test_clean_stays(text):
    assert g.restore(text, MODEL) == (False, text, True)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp437", "cp850", "cp1251", "mac_roman"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_read_wrongly(text, read):
    assert g.restore(misread(text, "utf-8", read), MODEL) == (True, text, True)


def test_twice_legacy_parts_and_lost_bytes():
    twice = misread(misread(TEXTS[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert g.restore(twice, MODEL) == (True, TEXTS[0], True)
    assert g.restore(misread(TEXTS[3], "cp1251", "cp1252"), MODEL) == (True, TEXTS[3], True)
    assert g.restore(misread(TEXTS[7], "cp932", "cp1252"), MODEL) == (True, TEXTS[7], True)
    assert g.restore(misread(TEXTS[7], "euc_jp", "latin-1"), MODEL) == (True, TEXTS[7], True)
    part = TEXTS[0][:20] + misread(TEXTS[0][20:], "utf-8", "cp437")
    assert g.restore(part, MODEL) == (True, TEXTS[0], True)
    lost = TEXTS[2].encode("cp1252").decode("utf-8", "replace")
    assert g.restore(lost, MODEL) == (True, TEXTS[2], True)


def test_edges():
    for text in (None, "", "plain ascii?", "\xa0", "♪", "…", "НАС»"):
        assert g.restore(text, MODEL)[0] is False
    assert g.restore("�" * 5000, MODEL)[0] is True
    assert g.restore(("é" + "a" * 50) * 2000, MODEL)[0] is False


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 20)] + [(1000, misread(TEXTS[1], "utf-8", "cp1252"), "x"), (1000, misread(TEXTS[1], "utf-8", "cp1252"), "x"), (1001, None, "x"), (1002, "", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, t string, restored string")
    trained = g.train(df, "t")
    assert trained[0]["tomás"] == 20
    got = g.find_garbled(df, ["id"], "t", trained).collect()
    assert [(r.id, r.restored, r.whole) for r in got] == [(1000, TEXTS[1], True)] * 2
    assert g.find_garbled(df.limit(0), ["id"], "t", g.train(df.limit(0), "t")).count() == 0


def test_lattice_and_search():
    model = g.Model({w: 50 * n for w, n in COUNTS.items()}, 50 * sum(COUNTS.values()), pairs={"dottore è": 9, "tomás —": 4, "jusqu'à": 3})
    # Each byte of these is lost where cp1252 has no character for it; the lattice keeps all that fit.
    assert g._utf8("Ã�", "cp1252") in g._MEMBERS and g._MEMBERS[g._utf8("Ã�", "cp1252")] == ("Á", "Í", "Ï", "Ð", "Ý")
    for text, damaged in [
        (TEXTS[4], TEXTS[4].encode("cp1252").decode("utf-8", "replace")),
        ("“Está bien.”", "�Est� bien.�"), ("Il dottore è più freddo", "Il dottore � pi� freddo"), ("jusqu'à là", "jusqu'� l�"),
        (TEXTS[3], TEXTS[3].encode("utf-8").decode("cp1251", "replace")), (TEXTS[7], TEXTS[7].encode("utf-8").decode("cp1252", "replace")),
    ]:
        got = g.restore(damaged, model)
        assert got[0] and (got[1] == text or damaged[0] not in "�" and sum(a == b for a, b in zip(got[1], text)) >= 0.8 * len(text)), (damaged, got)
    assert g.restore("a\U00100000b", model)[0] is False
    assert g.restore("�" * 9 + " x", model) == (True, "�" * 9 + " x", False)


def test_planted_damage_is_restored():
    """Share of lines that come back exactly, over every line and every wrong table, lost bytes included."""
    right = n = 0
    for text in TEXTS:
        for read in ("cp1252", "cp437", "cp850", "cp1251", "mac_roman", "cp1250"):
            damaged = text.encode("utf-8").decode(read, "replace")
            n += 1
            right += g.restore(damaged, MODEL)[1] == text
    assert right >= 0.9 * n, (right, n)
