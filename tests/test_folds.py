import random

from cuemill.operators import folds
from cuemill.plans import vector_queries as v


def test_whole_recordings(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for job in range(3):
        at = 0
        for i in range(900):
            at += rng.choice([50, 300, 600, 620, 621, 900, 4300, 4301, 6000]) if rng.random() < 0.7 else 0
            rows.append((f"j{job}", i, at, at + rng.randint(100, 2500), 1 + (i % 7 == 0), rng.choice(["a.", "b"])))
            at = rows[-1][3] if rng.random() < 0.9 else at
    df = spark.createDataFrame(rows, "job_id string, cue_id long, l_start long, l_end long, speaker_id long, source string").cache()
    monkeypatch.setattr(v, "cues", lambda spark, sf_dir, *more: df)
    assert max(r[3] for r in rows) > 1_200_000
    got = sorted((r.job_id, r.start_ms, r.end_ms) for r in v.listening_windows(spark, "").collect())
    want = sorted((j, a, b) for j in ("j0", "j1", "j2") for a, b in folds.merge_padded(sorted((r[2], r[3]) for r in rows if r[0] == j), 650, 3_000, 180_000))
    assert got == want
    got = sorted((r.job_id, r.speaker_id, r.start_ms, r.end_ms, r.rows) for r in v.gap_duration_sessions(spark, "").collect())
    want = []
    for j in ("j0", "j1", "j2"):
        for s in (1, 2):
            mine = sorted((r[2], r[3], r[5] == "a.") for r in rows if r[0] == j and r[4] == s)
            groups: dict = {}
            for row, n in zip(mine, folds.gap_duration_groups(mine, 620, 10_000, 700)):
                groups.setdefault(n, []).append(row)
            want += [(j, s, min(r[0] for r in g), max(r[1] for r in g), len(g)) for g in groups.values()]
    assert got == sorted(want)
