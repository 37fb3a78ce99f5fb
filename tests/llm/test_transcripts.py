import pytest

from cuemill.llm import transcripts as t

LINES = [
    ("00:00:17,588 --> 00:00:19,488 Voice 2: Hello there.", (17588, [("voice 2", "Hello there.", True)])),
    ("Wilhelmina Kroventz — Está bien, si esperamos más. [Musik]", (None, [("wilhelmina kroventz", "Está bien, si esperamos más.", True)])),
    ("(00:01:12.149) ...", (72149, [("", "", False)])),
    ("<i>Eh Hablaremos de eso esta [Musik] mañana.</i>", (None, [("", "Hablaremos de eso esta mañana.", True)])),
    ("- <v Wilhelmina> Ella duerme em... desde que.\n- [Dagny Yarnolt] Nadie.", (None, [("wilhelmina", "Ella duerme desde que.", True), ("dagny yarnolt", "Nadie.", True)])),
    ("[crosstalk] Te dije que no.", (None, [("", "Te dije que no.", True)])),
    ("[music swells] (coughs)", (None, [("", "", False)])),
    ("♪ Um... I'm sorry.", (None, [("", "I'm sorry.", True)])),
    ("first half\nsecond half", (None, [("", "first half second half", True)])),
    (None, (None, [])),
    ("", (None, [])),
]


@pytest.mark.parametrize("source, want", LINES)
def test_line(source, want):
    assert t.read_line(source) == want


def test_long_line():
    at, parts = t.read_line("word " * 50_000)
    assert at is None and parts[0][2]


@pytest.mark.parametrize("label, key", [("VOICE #1", "voice 1"), ("voice 02", "voice 2"), ("Uncertain voice", ""), ("?", ""), (None, ""), ("  Dagny  Yarnolt ", "dagny yarnolt"), ("Yarnolt, Dagny", "dagny yarnolt"), ("YARNOLT (V.O.)", "yarnolt"), ("Dr. Yarnolt:", "yarnolt"), ("W. Kroventz", "w kroventz")])
def test_label(label, key):
    assert t.label_key(label) == key


def test_clusters():
    counts = {("dagny yarnolt", 2): 3, ("dagny yarnotl", None): 1, ("d yarnolt", None): 1, ("dagny", None): 2, ("yarnolt", None): 1, ("wilhelmina kroventz", 1): 1, ("wilhelmina k", None): 1, ("voice 7", None): 1, ("adela yarnolt", 3): 1}
    got = t.cluster_labels(counts)
    assert got["dagny yarnotl"] == got["d yarnolt"] == got["dagny"] == 2 and got["wilhelmina k"] == 1 and got["voice 7"] == 7
    assert got["yarnolt"] == 2  # two of that name: the one that speaks more


def _brute(parts, named):
    by, out = {}, set()
    for p in sorted((p for p in parts if p.words and p.start_ms is not None), key=lambda p: (p.start_ms, p.line_id, p.part)):
        who = p.speaker_no or named.get((p.job_id, p.label)) or 0
        last = by.get(p.job_id)
        start = last[1] if last and last[0] == who else p.start_ms
        by[p.job_id] = (who, start)
        if who:
            out.add((p.line_id, who, start))
    return out


def test_turns_across_slices(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, i * 2.0]), rng.choice([0, 1, 1, 1, 2]), rng.choice([None, "Ann Bell", "Voice 3"]), f"[00:{i * 2 // 60 % 60:02d}:{i * 2 % 60:02d}] word", 1) for i in range(1500)]
    rows += rows[:50] + [(9000, "a", None, 1, None, "no time", 1), (9001, "a", 5.0, None, None, "nobody", 1), (9002, "a", 5.0, 1, None, None, 1), (None, "a", 5.0, 1, None, "x", 1)]
    df = spark.createDataFrame(rows, "line_id long, job_id string, start_s double, speaker_id int, speaker_name string, source string, part int")
    parts = t.line_parts(df).cache()
    named = {(r.c_job, r.c_label): r.c_no for r in t.speakers(parts).collect()}
    got = {(r.line_id, r.speaker_id, r.turn_start_ms) for r in t.turns(parts).collect()}
    assert got == _brute(parts.collect(), named)
    assert t.turns(t.line_parts(df.limit(0))).count() == 0
