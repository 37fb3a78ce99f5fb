from collections import Counter

from cuemill.llm import mixing


def _frames(spark, docs, targets):
    return (
        spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"),
        spark.createDataFrame(targets, "source string, target_share double, max_repeats int"),
    )


def test_budgets_and_repeats(spark):
    docs = [(i, "big", 10) for i in range(1000)] + [(5000 + i, "small", 7) for i in range(10)] + [(7000, "big", 0), (7001, None, 5), (7002, "unlisted", 5)]
    sized, want = _frames(spark, docs, [("big", 0.5, 1), ("small", 0.1, 3), ("none", 0.4, 2)])
    mixed = mixing.mix(sized, want, buckets=16).collect()
    uses = Counter(r.doc_id for r in mixed)
    big = [r for r in mixed if r.source == "big"]
    assert len(big) == (1000 * 10 + 70) // 2 // 10 and max(uses[r.doc_id] for r in big) == 1
    assert Counter(uses[r.doc_id] for r in mixed if r.source == "small") == {3: 30}
    assert {r.source for r in mixed} == {"big", "small"}
    report = {r.source: r for r in mixing.shares(sized, want, buckets=16).collect()}
    assert report["none"].taken_tokens == 0 and report["small"].taken_tokens == 210 and report["small"].epochs == 3
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5


def test_cut_is_a_prefix_in_key_order(spark):
    docs = [(i, "s", 1 + i % 13) for i in range(3000)]
    sized, want = _frames(spark, docs, [("s", 1.0, 3)])
    total = sum(x[2] for x in docs)
    mixed = mixing.mix(sized, want, total=total * 3 // 2, buckets=64).collect()
    uses = Counter(r.doc_id for r in mixed)
    assert set(uses.values()) == {1, 2} and len(uses) == 3000
    rest = total * 3 // 2 - total
    took = sum(x[2] for x in docs if uses[x[0]] == 2)
    assert rest - 13 < took <= rest
    again = Counter(r.doc_id for r in mixing.mix(sized, want, total=total * 3 // 2, buckets=7).collect())
    assert again == uses  # the order doesn't depend on the number of ranges


def test_empty(spark):
    sized, want = _frames(spark, [], [("s", 1.0, None), (None, 0.5, 1)])
    assert mixing.mix(sized, want).count() == 0
    assert [(r.source, r.taken_tokens) for r in mixing.shares(sized, want).collect()] == [("s", 0)]
    sized, want = _frames(spark, [(1, "s", 3)], [])
    assert mixing.mix(sized, want).count() == 0
