import numpy as np
from pyspark.sql import functions as F

from cuemill.operators import folds, ranking, rules, store, vectors
from cuemill.streaming import windows


def test_rules_fail_closed_and_keep_zero(spark):
    names = ["transcription", "alignment", "speaker", "duration_s", "stretch_percent", "word_similarity", "wer", "cer"]
    df = spark.createDataFrame([(0.9, 0.9, 0.9, 2.0, 0.0, 0.9, 0.0, 0.0, True, False), (None, 0.9, 0.9, 2.0, None, 0.0, 0.5, 0.5, None, None), (0.55, 0.55, 0.5, 2.0, 8.0, 0.72, 0.4, 0.35, False, True)], ", ".join(f"{n} double" for n in names) + ", verdict boolean, overlapping boolean")
    got = [r.r for r in df.select(rules.reasons(rules.inspect_rules({c: F.col(c) for c in df.columns})).alias("r")).collect()]
    assert got[0] == []
    assert got[1] == ["missing transcription", "verdict missing", "heavy stretch", "words differ", "transcription uncertain"]
    assert got[2] == ["verdict failed", "overlapping speech", "noticeable stretch"]


def test_take_until_passes_the_budget_once(spark):
    df = spark.createDataFrame([("g", i, 40) for i in range(10)], "g string, i long, ms long")
    got = ranking.take_until(df, ["g"], [F.col("i")], "ms", 100, 80).collect()
    assert sorted(r.i for r in got) == [0, 1, 2]
    assert [r.i for r in ranking.top_then_restore(df, [F.desc("i")], 3, ["i"]).collect()] == [7, 8, 9]


def test_folds():
    rows = [(0, 500, False), (600, 1000, True), (1010, 1200, False), (2000, 2100, False), (2150, 14_000, False), (14_010, 14_020, False)]
    assert folds.gap_duration_groups(rows, 620, 10_000, 700) == [1, 1, 2, 3, 3, 4]
    assert folds.merge_padded([(1000, 2000), (3000, 4000), (300_000, 301_000)], 650, 3000, 180_000) == [(350, 4650), (299_350, 301_650)]


def test_upsert_split_merge(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, v string")
    change = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, "z", False), (4, "w", None), (1 + 8, None, True)], "k long, v string, o boolean")
    assert sorted((r.k, r.v) for r in store.upsert(base, change, "k", ["v"], "o").collect()) == [(1, "x"), (2, "y"), (3, "c"), (4, "w"), (9, None)]
    cues = spark.createDataFrame([("j", 1, 0, 1000, "a"), ("j", 2, 1000, 1200, "b"), ("j", 3, 1300, 5000, "c")], "job string, id long, s long, e long, t string")
    cut = store.split_row(cues, "job", "id", "s", "e", F.when(F.col("id") == 3, F.lit(2000).cast("long")).when(F.col("id") == 1, F.lit(50).cast("long")))
    assert [(r.id, r.s, r.e) for r in cut.orderBy("id").collect()] == [(1, 0, 1000), (2, 1000, 1200), (3, 1300, 2000), (4, 2000, 5000)]
    joined = store.merge_with_next(cues, "job", "id", "s", "e", "t", F.col("id") == 2)
    assert [(r.id, r.s, r.e, r.t) for r in joined.orderBy("id").collect()] == [(1, 0, 1000, "a"), (2, 1000, 5000, "b c")]


def test_clusters():
    a = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.05, 1], [-1, 0]])
    assert vectors.agglomerate(a, 0.24).tolist() == [0, 0, 2, 2, 4]
    got, count = vectors.online_prototypes(a)
    assert got.tolist() == [0, 0, 1, 1, 2] and count.tolist() == [2, 2, 1]
    assert vectors.agglomerate(a[:0], 0.2).tolist() == []


def test_cosines_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3), [float(x) for x in rng.normal(size=5)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, l int, v array<float>")
    cents = vectors.centroids(df, "l", "v")
    c = {r.l: np.array(r.centroid) for r in cents.collect()}
    for l in range(3):
        m = np.mean([np.array(v, np.float32).astype(float) for _, k, v in rows if k == l], axis=0)
        assert np.allclose(c[l], m / np.linalg.norm(m))
    for r in vectors.against_all(df, cents, "id", "l", "v").collect():
        v = np.array(rows[r.id][2], np.float32).astype(float)
        assert np.isclose(r.own, v @ c[r.l]) and np.isclose(r.other, max(v @ c[k] for k in c if k != r.l)) and r.nearest == max(c, key=lambda k: v @ c[k])


def test_streaming_sessions_and_repeats(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 10), (1, 60), (1, 60), (1, 10_000), (2, 30), (9, 90_000)], "u long, s long").select("u", F.timestamp_seconds("s").alias("at")).write.parquet(src)
    stream = spark.readStream.schema("u long, at timestamp").parquet(src)
    windows.drain(windows.sessions(stream, "u", "at", "5 minutes", "1 second"), out, str(tmp_path / "cp"))
    got = sorted((r.u, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1), (1, 3), (2, 1)]  # the last session still waits
    windows.drain(windows.once(stream, ["u", "at"], "at", "1 hour"), out + "2", str(tmp_path / "cp2"))
    assert spark.read.parquet(out + "2").count() == 5


def test_blocks_of_centroids(spark, monkeypatch):
    from cuemill.operators import vectors

    rng = np.random.default_rng(3)
    rows = [(i, f"l{i % 7}" if i % 11 else None, [float(x) for x in rng.normal(size=5)]) for i in range(80)] + [(900, "l1", None), (901, "zz", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, l string, v array<double>")
    cents = vectors.centroids(df.where("size(v) = 5 and l is not null"), "l", "v").cache()
    read = lambda: {r.id: (r.l, *[None if x is None else round(x, 9) for x in (r.own, r.other)], r.nearest) for r in vectors.against_all(df, cents, "id", "l", "v").collect()}
    one = read()
    monkeypatch.setattr(vectors, "BLOCK_LABELS", 2)
    assert read() == one and len(one) == 82 and one[900] == ("l1", None, None, None)
    m = {r.l: np.array(r.centroid) for r in cents.collect()}
    for i, l, v in rows[:80]:
        sims = {k: float(np.array(v) @ c) for k, c in m.items()}
        assert one[i][3] == max(sims, key=lambda k: (sims[k], k)) and (one[i][1] is None) == (l is None)
        assert np.isclose(one[i][2], max(x for k, x in sims.items() if k != l))
