"""Joins of intervals and of points to intervals.

An overlap is no equality, so plain predicates would compare everything with everything. Here time is cut into
buckets: each interval is put into every bucket it touches, equal keys and buckets are joined, the exact
predicate is checked, and a pair is kept only in the bucket in which its overlap begins, so it comes out once.
A hot key is spread over its buckets. Choose bucket_ms near the usual length of the longer side.
All times are BIGINT milliseconds; intervals are half open and rows without a positive length pair with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_MS = 10_000


def _spread(df: DataFrame, start: str, end: str, bucket_ms: int, name: str) -> DataFrame:
    first, last = F.floor(F.col(start) / bucket_ms), F.floor((F.col(end) - 1) / bucket_ms)
    return df.where(F.col(end) > F.col(start)).withColumn(name, F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], more_than_ms: int = 0, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """All pairs of equal keys that overlap by more than more_than_ms: columns of both sides and overlap_ms.

    left has l_start and l_end, right r_start and r_end; other column names of the two sides must differ, the keys
    are named alike. Null keys and times pair with nothing.
    """
    a = _spread(left, "l_start", "l_end", bucket_ms, "_bucket")
    b = _spread(right, "r_start", "r_end", bucket_ms, "_bucket")
    both = a.join(b, [*keys, "_bucket"])
    begins = F.greatest("l_start", "r_start")
    amount = F.least("l_end", "r_end") - begins
    return both.withColumn("overlap_ms", amount).where((F.col("overlap_ms") > more_than_ms) & (F.floor(begins / bucket_ms) == F.col("_bucket"))).drop("_bucket")


def point_pairs(points: DataFrame, intervals: DataFrame, keys: list[str], within_ms: int, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Points (p_at) with all intervals (r_start, r_end) of equal keys at most within_ms away; distance_ms, 0 inside."""
    a = points.withColumn("_bucket", F.floor(F.col("p_at") / bucket_ms))
    wide = intervals.withColumn("_ws", F.col("r_start") - within_ms).withColumn("_we", F.col("r_end") + within_ms + 1)
    b = _spread(wide, "_ws", "_we", bucket_ms, "_bucket").where("r_end > r_start")
    far = F.greatest(F.col("r_start") - F.col("p_at"), F.col("p_at") - F.col("r_end"), F.lit(0))
    return a.join(b, [*keys, "_bucket"]).withColumn("distance_ms", far).where(F.col("distance_ms") <= within_ms).drop("_bucket", "_ws", "_we")


def first_by(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group; Spark filters row numbers before it shuffles."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rn = 1").drop("_rn")


def milli(x: Column) -> Column:
    """A number as whole thousandths, half upwards."""
    return F.floor(x * 1000 + 0.5).cast("bigint")


def first_seen_numbers(turns: DataFrame, keys: list[str], label: str, start: str, end: str) -> DataFrame:
    """keys, label, number: labels numbered from 1 by their first turn (start, then end, then name)."""
    first = turns.groupBy(*keys, label).agg(F.min(F.struct(start, end)).alias("_first"))
    return first.select(*keys, label, F.row_number().over(Window.partitionBy(*keys).orderBy("_first", label)).cast("bigint").alias("number"))


def vote_speakers(cues: DataFrame, turns: DataFrame, key: str = "job_id", cue: str = "cue_id", least_share: float = 0.3, side_ms: int = 80) -> DataFrame:
    """Speaker of each cue by overlap with labelled turns: number 0 where nothing covers at least least_share of it.

    All labels of a job are ranked (most overlap first, then first seen); column card_rank (0 for the first) picks a
    place for cards that are shown at once. overlapping: more than one label overlaps by more than side_ms.
    """
    numbers = first_seen_numbers(turns, [key], "speaker", "r_start", "r_end")
    pairs = overlap_pairs(cues.select(key, cue, "l_start", "l_end"), turns.select(key, "speaker", "r_start", "r_end"), [key])
    votes = pairs.groupBy(key, cue, "speaker").agg(F.sum("overlap_ms").alias("ms"), F.max("overlap_ms").alias("most"))
    beside = votes.where(F.col("most") > side_ms).groupBy(key, cue).agg((F.count(F.lit(1)) > 1).alias("overlapping"))
    # Cards shown first need the best label alone; for later ranks all labels of the job are padded in.
    padded = cues.where("card_rank > 0").select(key, cue).join(numbers.select(key, "speaker"), key).select(key, cue, "speaker", F.lit(0).cast("bigint").alias("ms"))
    all_votes = votes.select(key, cue, "speaker", "ms").unionByName(padded).groupBy(key, cue, "speaker").agg(F.max("ms").alias("ms")).join(numbers, [key, "speaker"])
    order = Window.partitionBy(key, cue).orderBy(F.desc("ms"), "number")
    ranked = all_votes.withColumn("rank", F.row_number().over(order) - 1).withColumn("last", F.count(F.lit(1)).over(Window.partitionBy(key, cue)) - 1)
    base = cues.select(key, cue, "card_rank", F.greatest(F.col("l_end") - F.col("l_start"), F.lit(50)).alias("length"))
    picked = base.join(ranked, [key, cue]).where(F.col("rank") == F.least("card_rank", "last")).select(key, cue, "number", "ms")
    joined = base.join(picked, [key, cue], "left").join(beside, [key, cue], "left")
    share = F.coalesce(F.col("ms"), F.lit(0)) / F.col("length")
    sure = F.col("ms").isNotNull() & (share >= least_share)
    over = F.coalesce("overlapping", F.lit(False))
    confidence = F.when(sure, F.least(F.lit(0.95), 0.45 + 0.5 * share) * F.when(over, F.lit(0.62)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    return joined.select(
        key, cue, F.when(sure, F.col("number")).otherwise(F.lit(0)).cast("bigint").alias("speaker_no"), F.coalesce("ms", F.lit(0)).cast("bigint").alias("overlap_ms"), over.alias("overlapping"),
        milli(confidence).alias("confidence_milli"), F.when(~sure, "uncertain").when(confidence >= 0.62, "confident").otherwise("tentative").alias("verdict"),
    )


def clip_and_shift(df: DataFrame, start: str, end: str, low: int, high: int) -> DataFrame:
    """Intervals cut to [low, high) and moved so that low is 0; what is left empty goes."""
    s, e = F.greatest(F.col(start), F.lit(low)), F.least(F.col(end), F.lit(high))
    return df.withColumn("_s", s).withColumn("_e", e).where("_e > _s").withColumn(start, F.col("_s") - low).withColumn(end, F.col("_e") - low).drop("_s", "_e")


def split_long(df: DataFrame, start: str, end: str, piece_ms: int, least_ms: int) -> DataFrame:
    """Intervals cut into pieces of at most piece_ms; pieces shorter than least_ms go."""
    pieces = F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(piece_ms).cast("bigint")))
    cut = df.where(F.col(end) > F.col(start)).withColumn("_p", pieces).withColumn(end, F.least(F.col(end), F.col("_p") + piece_ms)).withColumn(start, F.col("_p")).drop("_p")
    return cut.where(F.col(end) - F.col(start) >= least_ms)
