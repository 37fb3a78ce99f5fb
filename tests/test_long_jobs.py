"""Jobs that hold a large share of all rows: work in proportion to the rows, results as by the rule read literally."""

import random
from bisect import bisect_left

from cuemill.operators import folds, gates
from cuemill.plans import interval_queries, vector_queries


def test_windows_of_a_long_job(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(job, i, (s := rng.randint(-50, 30 * n)), s + rng.randint(1, 3000)) for job, n in (("long", 5000), ("short", 40), ("one", 1)) for i in range(n)]
    rows += [("edge", i, s, s + 10) for i, s in enumerate([0, 0, 20, 21, 41, 42, 599_980, 600_000, 600_001])] + [("same", i, 7, 8) for i in range(3)]
    df = spark.createDataFrame(rows, "job_id string, cue_id long, l_start long, l_end long")
    monkeypatch.setattr(interval_queries, "cues", lambda spark, sf_dir, *more: df)
    query = interval_queries.allocate_windows(spark, "")
    starts: dict = {}
    for job, _, s, _ in sorted(rows):
        starts.setdefault(job, []).append(s)
    starts = {job: sorted(x) for job, x in starts.items()}
    want = []
    for job, i, s, e in rows:
        k = bisect_left(starts[job], s + 21)
        following = starts[job][k] if k < len(starts[job]) else None
        end = s + 620 if e + 1200 - s < 550 else e + 1200
        want.append((job, i, s, end if following is None else min(end, max(e, following - 30)), following))
    assert sorted(map(tuple, query.collect()), key=repr) == sorted(want, key=repr)
    # A frame that reaches to the end of its job is read anew for each row.
    assert "unboundedfollowing$" not in query._jdf.queryExecution().executedPlan().toString().lower()


def test_batches_of_a_long_job(spark):
    rng = random.Random(5)
    rows = [(job, i, rng.choice([None, *range(1, 120)]) if job == "gaps" else rng.randint(1, 500)) for job, n in (("long", 25_000), ("short", 40), ("gaps", 300), (None, 9)) for i in range(n)]
    query = gates.running_batches(spark.createDataFrame(rng.sample(rows, len(rows)), "g string, i long, z int").repartition(5), "g", ["i"], "z", 6, 400)
    want, last = [], ""
    for g, i, z in rows:
        if g != last:
            last, no, n, t = g, 0, 0, 0
        # What isn't known to exceed goes into the batch.
        if n == 6 or (n and None not in (t, z) and t + z > 400):
            no, n, t = no + 1, 0, 0
        n, t = n + 1, None if None in (t, z) else t + z
        want.append((g, i, z, no))
    assert query.columns == ["g", "i", "z", "batch_no"] and dict(query.dtypes)["batch_no"] == "bigint"
    assert sorted(map(tuple, query.collect()), key=repr) == sorted(want, key=repr)
    # An array that a fold makes longer by one is copied for each row.
    assert "aggregate(" not in query._jdf.queryExecution().optimizedPlan().toString().lower()


def test_sessions_of_many_parts(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for job, n, pauses in (("long", 4000, [0, 300, 620, 621, 5000]), ("sparse", 600, [30_000, 30_001, 40_000]), ("short", 5, [100])):
        at = 0
        for i in range(n):
            at += rng.choice(pauses) - (900 if rng.random() < 0.2 else 0)
            rows.append((job, i, at, at + rng.randint(1, 2500), rng.randint(-1, 2), rng.choice(["a.", "b", None])))
            at = rows[-1][3]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "job_id string, cue_id long, l_start long, l_end long, speaker_id int, source string").repartition(5)
    monkeypatch.setattr(vector_queries, "cues", lambda spark, sf_dir, *more: df)
    query = vector_queries.gap_duration_sessions(spark, "")
    want = []
    for job, speaker in {(r[0], r[4]) for r in rows if r[4] > 0}:
        parts: dict = {}
        part, latest = 0, None
        for s, e, stop in sorted((r[2], r[3], r[5] == "a.") for r in rows if (r[0], r[4]) == (job, speaker)):
            part += latest is not None and s - latest > 30_000
            latest = e if latest is None else max(latest, e)
            parts.setdefault(part, []).append((s, e, stop))
        for part, mine in parts.items():
            groups: dict = {}
            for row, no in zip(mine, folds.gap_duration_groups(mine, 620, 10_000, 700)):
                groups.setdefault(no, []).append(row)
            want += [(job, speaker, part, no, min(r[0] for r in g), max(r[1] for r in g), len(g)) for no, g in groups.items()]
    assert query.dtypes == [("job_id", "string"), ("speaker_id", "int"), ("part", "bigint"), ("group_no", "bigint"), ("start_ms", "bigint"), ("end_ms", "bigint"), ("rows", "bigint")]
    assert sorted(map(tuple, query.collect())) == sorted(want)
    # A call of Python for each part costs more than the part.
    assert "flatmapgroups" not in query._jdf.queryExecution().optimizedPlan().toString().lower()
