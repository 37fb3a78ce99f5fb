from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuemill.operators import overlap
from cuemill.operators.intervals import interval_gaps, interval_periods, to_ms


def brute(rows, least):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    gaps, periods = set(), set()
    for k, xs in by.items():
        xs.sort()
        start, end = xs[0]
        for s, e in xs[1:]:
            if s - end >= least:
                gaps.add((k, end, s))
                periods.add((k, start, end))
                start, end = s, e
            end = max(end, e)
        periods.add((k, start, end))
    return gaps, periods


def check(spark, rows, least, width):
    df = spark.createDataFrame(rows, "who string, s long, e long").withColumn("gap_start_ms", F.lit("clash")).withColumn("_s", F.lit(1))
    gaps, periods = brute(rows, least)
    got = interval_gaps(df, ["who"], F.col("s"), F.col("e"), least, width)
    assert sorted((r.who or "", r.gap_start_ms, r.gap_end_ms) for r in got.collect()) == sorted((k or "", a, b) for k, a, b in gaps)
    got = interval_periods(df, ["who"], F.col("s"), F.col("e"), least, width)
    assert sorted((r.who or "", r.period_start_ms, r.period_end_ms) for r in got.collect()) == sorted((k or "", a, b) for k, a, b in periods)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 400)), st.one_of(st.none(), st.integers(-50, 450))), max_size=60), st.sampled_from([1, 7]), st.sampled_from([20, 1000]))
def test_gaps_and_periods_against_brute_force(spark, rows, least, width):
    check(spark, rows, least, width)


def test_edges(spark):
    check(spark, [("a", 0, 10), ("a", 10, 20), ("a", 60, 61), ("a", 60, 61), ("a", 5, 5), ("a", 9, 3)], 40, 25)
    check(spark, [("a", 0, 10_000)] + [("a", i, i + 1) for i in range(0, 9000, 7)] + [("a", 10_050, 10_060)], 40, 100)
    df = spark.createDataFrame([(1.0005,), (float("nan"),), (None,), (float("inf"),), (-2.5,)], "x double")
    assert [r.m for r in df.select(to_ms(F.col("x")).alias("m")).collect()] == [1001, None, None, None, -2500]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.integers(-2, 90)), max_size=25), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.integers(-2, 90)), max_size=25), st.sampled_from([0, 5]))
def test_overlap_join_against_brute_force(spark, left, right, more):
    a = spark.createDataFrame([(i, k, s, s + n) for i, (k, s, n) in enumerate(left)], "l long, k string, l_start long, l_end long")
    b = spark.createDataFrame([(i, k, s, s + n) for i, (k, s, n) in enumerate(right)], "r long, k string, r_start long, r_end long")
    got = sorted((r.l, r.r, r.overlap_ms) for r in overlap.overlap_pairs(a, b, ["k"], more, 16).collect())
    want = sorted((i, j, min(s + n, t + m) - max(s, t)) for i, (k, s, n) in enumerate(left) for j, (q, t, m) in enumerate(right) if k == q and n > 0 and m > 0 and min(s + n, t + m) - max(s, t) > more)
    assert got == want
    points = a.select("l", "k", F.col("l_start").alias("p_at"))
    near = sorted((r.l, r.r, r.distance_ms) for r in overlap.point_pairs(points, b, ["k"], 10, 16).collect())
    far = lambda p, t, m: max(t - p, p - t - m, 0)
    assert near == sorted((i, j, far(s, t, m)) for i, (k, s, n) in enumerate(left) for j, (q, t, m) in enumerate(right) if k == q and m > 0 and far(s, t, m) <= 10)
