"""Clusters of near-duplicate texts by verified MinHash.

Only distinct texts take part. Shingles are runs of five words (a shorter text is one shingle). 256 minima in 32
bands of eight propose candidates. In every bucket each text is compared with the bucket's smallest id; links of
verified similarity are joined to components by passing on the smallest id, each round written to the shared folder.
Similarity isn't transitive, so where a text of a bucket is unlike its smallest id, the texts of that bucket are
then joined exactly: texts alike share one of their rarest shingles (prefix filter). What is in one component
already needs no comparison, so a bucket never costs all its pairs, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.session import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 8
#: Texts with a shingle in common are joined in parts of about so many.
SALT = 2048


def shingles(words: Column) -> Column:
    """Hashes of the runs of WORDS words of an array of words; one of all of them where there are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - WORDS + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, WORDS), " ")))
    return F.array_distinct(runs)


def _bands() -> tuple[Column, Column]:
    """Hashes of the bands of a column `minima`, and the minima of a column `sh`."""
    seq = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    minima = F.transform(seq(BANDS * ROWS), lambda i: F.array_min(F.transform("sh", lambda x: F.xxhash64(x, i))))
    return F.transform(seq(BANDS), lambda b: F.xxhash64(b, F.slice(F.col("minima"), b * ROWS + 1, ROWS))), minima


def alike(pairs: DataFrame, sh: DataFrame) -> DataFrame:
    """a, b: those of the pairs that are of at least SIMILARITY. sh: id, sh."""
    proven = pairs.select("a", "b").distinct().join(sh.withColumnsRenamed({"id": "a"}), "a").join(sh.withColumnsRenamed({"id": "b", "sh": "sh2"}), "b")
    both = F.size(F.array_intersect("sh", "sh2"))
    return proven.where(both >= SIMILARITY * (F.size("sh") + F.size("sh2") - both)).select("a", "b")


def links(sh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of at least SIMILARITY of a text and the smallest id of a bucket; and the ids of buckets with other pairs. sh: id, sh (written)."""
    bands, minima = _bands()
    every = materialize(sh.select("id", minima.alias("minima")).select("id", F.explode(bands).alias("bucket")), "buckets")
    lead = every.groupBy("bucket").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "b")
    pairs = materialize(every.join(lead, "bucket").where("id <> b").select("bucket", F.col("id").alias("a"), "b"), "pairs")
    found = materialize(alike(pairs, sh), "links")
    open_ = pairs.join(found, ["a", "b"], "left_anti").select("bucket").distinct()
    return found, materialize(every.join(open_, "bucket", "left_semi").select("id").distinct(), "open")


def across(sh: DataFrame, label: DataFrame) -> DataFrame:
    """a, b: all pairs of at least SIMILARITY whose clusters differ, of the texts in sh (id, sh). label: id, cluster; without a label a text is its own."""
    texts = materialize(sh.join(label, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"), "sh"), "labelled")
    every = texts.select("id", "cluster", F.explode("sh").alias("shingle"))
    ordered = every.join(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle").groupBy("id", "cluster").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("o"))
    # Texts alike have SIMILARITY of either's shingles in common, so one of the first of each in any order of all.
    needed = F.ceil(SIMILARITY * F.size("o") - 1e-9).cast("int")
    rare = materialize(ordered.select("id", "cluster", F.size("o").alias("size"), F.explode(F.slice("o", F.lit(1), F.size("o") - needed + 1)).alias("p")).select("id", "cluster", "size", "p.shingle"), "rare")
    by_cluster = rare.groupBy("shingle", "cluster").agg(F.count(F.lit(1)).alias("c"))
    # One of each pair is outside the shingle's main cluster; a shingle of one cluster has none.
    mixed = by_cluster.groupBy("shingle").agg(F.sum("c").alias("n"), F.max(F.struct("c", "cluster"))["cluster"].alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = materialize(mixed.select("shingle", "main", F.ceil(F.col("n") / SALT).alias("parts")), "mixed")
    here = rare.join(mixed, "shingle")
    side = lambda x, salt: here.select("shingle", salt.alias("salt"), "main", F.col("id").alias(x), F.col("cluster").alias(f"c{x}"), F.col("size").alias(f"n{x}"))
    one = side("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).where("ca <> main").drop("main")
    other = side("b", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("main")
    near = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9
    pairs = one.join(other, ["shingle", "salt"]).where((F.col("ca") != F.col("cb")) & near)
    return alike(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts.select("id", "sh"))


def components(edges: DataFrame) -> DataFrame:
    """id, cluster: the smallest id each id of the edges is connected with."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("cluster"))
    label = materialize(label, "labels")
    while True:
        # The smallest label around, and its own label: two steps at once.
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
        best = label.join(near, "id").select("id", F.least("cluster", "near").alias("best"), "cluster")
        jump = label.select(F.col("id").alias("best"), F.col("cluster").alias("further"))
        new = materialize(best.join(jump, "best", "left").select("id", F.least("best", F.coalesce("further", "best")).alias("cluster"), (F.least("best", F.coalesce("further", "best")) < F.col("cluster")).alias("moved")), "labels")
        label = new.select("id", "cluster")
        if new.where("moved").isEmpty():
            return label


def clusters(texts: DataFrame) -> DataFrame:
    """text, cluster for each distinct text (texts: text STRING, words separated by blanks); a text unlike any other is its own.

    Empty texts and nulls are left out. The cluster is the smallest hash of its texts.
    """
    distinct = materialize(texts.where("text <> ''").select("text").distinct().withColumn("id", F.xxhash64("text")), "texts")
    sh = materialize(distinct.select("id", shingles(F.split("text", " ")).alias("sh")), "shingles")
    found, open_ = links(sh)
    got = components(found)
    if not open_.isEmpty():
        known = F.coalesce("cluster", "id")
        own = lambda x: got.select(F.col("id").alias(x), F.col("cluster").alias(f"c{x}"))
        more = materialize(across(sh.join(open_, "id", "left_semi"), got), "across")
        if not more.isEmpty():
            more = more.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            wider = components(more).withColumnsRenamed({"id": "old", "cluster": "wider"})
            got = distinct.select("id").join(got, "id", "left").select("id", known.alias("old")).join(wider, "old", "left").select("id", F.coalesce("wider", "old").alias("cluster"))
    return distinct.join(got, "id", "left").select("text", F.coalesce("cluster", "id").alias("cluster"))
