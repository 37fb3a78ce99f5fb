import random

from pyspark.sql import functions as F

from cuemill.llm import nearest


def _run(spark, tmp_path, left, right, outer=False):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    to = lambda rows, cols: spark.createDataFrame(rows, cols).withColumn("at", F.timestamp_millis("ms")).drop("ms")
    to(left, "ent string, lid long, ms long, sighting string").write.parquet(a)
    to(right, "ent string, rid long, ms long").write.parquet(b)
    ls = spark.readStream.schema(spark.read.parquet(a).schema).parquet(a)
    rs = spark.readStream.schema(spark.read.parquet(b).schema).parquet(b)
    got = nearest.replay(ls, rs, ["ent"], ["lid"], "rid", 750, outer)
    return sorted((r.lid, r.rid, r.distance_us) for r in got.collect())


def test_against_brute_force_with_ties_repeats_and_edges(spark, tmp_path):
    rng = random.Random(3)
    left = [("e", i, rng.randrange(0, 60_000), "x") for i in range(150)] + [("f", 1000 + i, i * 1500, "x") for i in range(20)]
    right = [("e", i, rng.randrange(0, 60_000)) for i in range(60)] + [("f", 500 + i, i * 1500 + 750) for i in range(19)] + [("g", 900, 5)]
    left += left[:10]
    right += right[:10]
    want = {}
    for ent, lid, ms, _ in left:
        near = [(abs(ms - m), rid) for e, rid, m in right if e == ent and abs(ms - m) <= 750]
        want[lid] = (lid, min(near)[1], min(near)[0] * 1000) if near else (lid, None, None)
    assert _run(spark, tmp_path / "o", left, right, outer=True) == sorted(want.values(), key=lambda r: r[0])
    assert _run(spark, tmp_path / "i", left, right) == sorted((r for r in want.values() if r[1] is not None), key=lambda r: r[0])


def test_empty(spark, tmp_path):
    assert _run(spark, tmp_path, [], []) == []


def test_watermark_emits_before_the_end(spark, tmp_path):
    """Over two batches, the first batch's left rows are answered as soon as the second has moved the watermark."""
    a, b, out = (str(tmp_path / x) for x in ("a", "b", "out"))
    for base, ids in ((0, 1), (600_000, 2)):
        df = spark.createDataFrame([("e", ids, base + 100)], "ent string, lid long, ms long").withColumn("at", F.timestamp_millis("ms")).drop("ms")
        df.coalesce(1).write.mode("append").parquet(a)
        df.withColumnRenamed("lid", "rid").coalesce(1).write.mode("append").parquet(b)
    read = lambda p: spark.readStream.schema(spark.read.parquet(p).schema).option("maxFilesPerTrigger", 1).parquet(p)
    joined = nearest.nearest_in_time(read(a), read(b), ["ent"], ["lid"], "rid", 750)
    run = joined.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    run.awaitTermination()
    assert [(r.lid, r.rid) for r in spark.read.schema(joined.schema).parquet(out).collect()] == [(1, 1)]
