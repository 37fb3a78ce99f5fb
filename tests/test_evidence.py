import numpy as np
from pyspark.sql import functions as F

from cuemill.operators import evidence as ev


def test_fold_and_distance(spark):
    df = spark.createDataFrame([(100.0, 205.0), (400.0, 190.0), (200.0, 210.0)], "v double, m double")
    assert [r.x for r in df.select(ev.fold_octave(F.col("v"), F.col("m")).alias("x")).collect()] == [200.0, 200.0, 200.0]
    d = spark.createDataFrame([(200.0, 100.0, 1000.0, 2000.0, 1.0, 10.0), (0.0, 100.0, None, 2000.0, 1.0, 1.0)], "p double, q double, a double, b double, l double, k double")
    got = [r.x for r in d.select(ev.voice_distance(*[F.col(c) for c in d.columns]).alias("x")).collect()]
    assert np.allclose(got, [12 + 2 + 2.4, 0])


def test_incoherent(spark):
    rows = [("a", i, 100.0) for i in range(5)] + [("a", 9, 148.0), ("b", 20, 100.0), ("b", 21, 900.0), ("c", 30, 100.0), ("c", 31, 102.0), ("c", 32, 205.0), ("a", 40, None)]
    df = spark.createDataFrame(rows, "g string, i long, hz double")
    assert ev.incoherent(df, "g", "i", "hz").collect() == []
    assert [(r.g, r.i) for r in ev.incoherent(df, "g", "i", "hz", spread=5.0).collect()] == [("a", 9)]


def test_verdicts(spark):
    rows = [(True, False, 0.8, 0.9, "passed"), (True, False, 0.7, 0.9, "failed"), (True, False, None, None, "passed"), (True, None, 0.9, 0.9, "failed"), (None, False, 0.9, 0.9, "unsure")]
    df = spark.createDataFrame(rows, "e boolean, c boolean, a double, n double, want string")
    assert all(r.x == r.want for r in df.select(ev.assemble_verdict(F.col("e"), F.col("c"), F.col("a"), F.col("n")).alias("x"), "want").collect())


def test_selections():
    assert ev.diverse([(100, 1000), (103, 1100), (103, 1300), (120, 1000), (101, 1001)], 3) == [0, 2, 3]
    v = np.array([[1, 0], [0.9, 0.1], [0, 1], [1, 1]])
    vectors, counts = ev.consolidate(v, np.array([2, 6, 3, 1]))
    assert counts.tolist() == [8, 3] and np.allclose(np.linalg.norm(vectors, axis=1), 1)


def test_sides(spark):
    p = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "g string, s double")
    h = spark.createDataFrame([("a", 0.54), ("b", 0.51), ("d", 0.1)], "g string, s double")
    assert sorted(tuple(r) for r in ev.pick_side(p, h, ["g"], "s").collect()) == [("a", "higher"), ("b", "primary"), ("c", "primary"), ("d", "higher")]
