"""Mixing sources to target shares of the total size.

Every document gets a random but repeatable key (a hash of its id and a seed). Within a source documents are
ordered by that key, and a document's place is the prefix sum of sizes up to it. The sums are made in two
levels: the key's leading bits name one of `buckets` ranges, the ranges' sums are added up per source, and
within a range a running sum starts from what lies before it. So no task holds a source, however large.
A source's budget is its share of the total; whole passes are taken first, then the documents up to the place
where the budget is used up. A document that would cross it stays out, so a budget is never exceeded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the key per source. The table of range sums has at most this many rows a source.
BUCKETS = 4096


def _plan(sized: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """_source, _share, _cap, _docs, _tokens, _budget, _passes, _rest: one row per wanted source."""
    want = (
        targets.where("source is not null and target_share > 0 and not isnan(target_share)")
        .groupBy(F.col("source").alias("_source"))
        .agg(F.max("target_share").alias("_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).cast("bigint").alias("_cap"))
    )
    have = sized.groupBy(F.col("_src").alias("_s")).agg(F.count(F.lit(1)).alias("_docs"), F.sum("_n").alias("_tokens"))
    joined = want.join(have, F.col("_source") == F.col("_s"), "left").select(
        "_source", "_share", "_cap", F.coalesce("_docs", F.lit(0)).alias("_docs"), F.coalesce("_tokens", F.lit(0)).alias("_tokens")
    )
    whole = Window.partitionBy()
    size = F.lit(total).cast("bigint") if total is not None else F.sum("_tokens").over(whole)
    return (
        joined.withColumn("_budget", F.floor(size * F.col("_share") / F.sum("_share").over(whole)).cast("bigint"))
        .withColumn("_passes", F.when(F.col("_tokens") > 0, F.least("_cap", F.floor(F.col("_budget") / F.col("_tokens")))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("_rest", F.when((F.col("_passes") < F.col("_cap")) & (F.col("_tokens") > 0), F.col("_budget") - F.col("_passes") * F.col("_tokens")).otherwise(F.lit(0)).cast("bigint"))
    )


def mix(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, epoch (from 1), n_tokens: the mixture, one row for each use of a document.

    sized: doc_id, source, n_tokens, one row a document; it is read several times, so hand over a written table.
    targets: source, target_share, max_repeats. total: wanted size in tokens; by default the size of one pass
    over all wanted sources. Shares are taken relative to their sum. A source that can't reach its budget within
    max_repeats gives all it has; nothing else is raised for it. Documents without tokens, with a null source or
    a source not listed, are not used. A null max_repeats is 1. Repeated document rows count as given.
    """
    docs = sized.where("n_tokens > 0 and source is not null").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("n_tokens").cast("bigint").alias("_n"), F.xxhash64(F.lit(seed), "doc_id").alias("_key")
    )
    plan = _plan(docs, targets, total)
    docs = docs.withColumn("_b", F.floor((F.col("_key").cast("double") + 2.0**63) / 2.0**64 * buckets).cast("int"))
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = docs.groupBy("_src", "_b").agg(F.sum("_n").alias("_sum")).select(F.col("_src").alias("_s2"), F.col("_b").alias("_b2"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    run = Window.partitionBy("_src", "_b").orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("_run", F.sum("_n").over(run)).join(sums, (F.col("_src") == F.col("_s2")) & (F.col("_b") == F.col("_b2")))
    cut = placed.join(F.broadcast(plan), F.col("_src") == F.col("_source"))  # a row for each listed source
    copies = F.col("_passes") + F.when(F.col("_before") + F.col("_run") <= F.col("_rest"), 1).otherwise(0)
    return (
        cut.withColumn("_copies", copies)
        .where("_copies > 0")
        .select(F.col("_id").alias("doc_id"), F.col("_src").alias("source"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("epoch"), F.col("_n").alias("n_tokens"))
    )


def shares(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """One row per listed source: what it has, its budget, what the mixture took, and the share reached (null where nothing was taken)."""
    docs = sized.where("n_tokens > 0 and source is not null").select(F.col("source").alias("_src"), F.col("n_tokens").cast("bigint").alias("_n"))
    took = mix(sized, targets, total, seed, buckets).groupBy(F.col("source").alias("_t")).agg(F.sum("n_tokens").alias("_took"), F.count(F.lit(1)).alias("_uses"), F.max("epoch").alias("_epochs"))
    joined = _plan(docs, targets, total).join(took, F.col("_source") == F.col("_t"), "left")
    taken = F.coalesce("_took", F.lit(0))
    return joined.select(
        F.col("_source").alias("source"),
        F.col("_share").alias("target_share"),
        F.col("_docs").cast("bigint").alias("docs"),
        F.col("_tokens").cast("bigint").alias("available_tokens"),
        F.col("_budget").alias("budget_tokens"),
        taken.cast("bigint").alias("taken_tokens"),
        F.coalesce("_uses", F.lit(0)).cast("bigint").alias("uses"),
        F.coalesce("_epochs", F.lit(0)).cast("bigint").alias("epochs"),
        F.round(F.try_divide(taken, F.sum(taken).over(Window.partitionBy())), 6).alias("actual_share"),
    )
