"""Periods and gaps of overlapping, nested and broken intervals.

The method is rank pairing: of one entity's intervals, starts and ends are sorted independently; a gap lies
behind rank k exactly where the start of rank k+1 exceeds the end of rank k, and the boundaries left over give
the continuous periods. To keep any entity from filling one task, an entity's time axis is cut into slices by
the interval's start. Starts are made distinct within a slice before sorting (the longest interval of each
start stands for all), so a slice holds at most `slice_ms` rows, however many intervals an entity has. What
reaches over from earlier slices is one number per slice: the latest end seen so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice in milliseconds; also the bound on the starts that one group can hold.
SLICE_MS = 600_000


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds of a number of seconds; null for null, NaN and infinite."""
    x = seconds.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(9e12)), F.round(x * 1000).cast("bigint"))


def _islands(df: DataFrame, keys: list[str], start: Column, end: Column, slice_ms: int) -> DataFrame:
    """keys, _s ARRAY, _e ARRAY, _carry: per slice the sorted starts and ends, and the latest end of earlier slices."""
    clean = (
        df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], start.alias("_start"), end.alias("_end"))
        .where("_start is not null and _end is not null and _end > _start")
        .withColumn("_slice", F.floor(F.col("_start") / slice_ms))
    )
    ks = [f"_k{i}" for i in range(len(keys))]
    distinct = clean.groupBy(*ks, "_slice", "_start").agg(F.max("_end").alias("_end"))
    slices = distinct.groupBy(*ks, "_slice").agg(
        F.sort_array(F.collect_list("_start")).alias("_s"), F.sort_array(F.collect_list("_end")).alias("_e")
    )
    # Local gaps first, so that only boundaries go on: rank k+1's start against rank k's end.
    size = F.size("_s")
    cut = F.filter(F.sequence(F.lit(1), size - 1), lambda k: F.element_at("_s", k + 1) > F.element_at("_e", k))
    cut = F.when(size > 1, cut).otherwise(F.array().cast("array<int>"))
    local = slices.withColumn("_cut", cut).select(
        *ks,
        "_slice",
        F.concat(F.slice("_s", 1, 1), F.transform("_cut", lambda k: F.element_at("_s", k + 1))).alias("_s"),
        F.concat(F.transform("_cut", lambda k: F.element_at("_e", k)), F.slice("_e", -1, 1)).alias("_e"),
    )
    reach = distinct.groupBy(*ks, "_slice").agg(F.max("_end").alias("_max"))
    before = Window.partitionBy(*ks).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = reach.select(*[F.col(k).alias(f"c{k}") for k in ks], F.col("_slice").alias("_cs"), F.max("_max").over(before).alias("_carry"))
    on = [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in ks] + [F.col("_slice") == F.col("_cs")]
    return local.join(carry, on).select(*ks, "_slice", "_s", "_e", "_carry")


def _edges(df: DataFrame, keys: list[str], start: Column, end: Column, min_gap_ms: int, slice_ms: int) -> DataFrame:
    """keys, _gs, _ge: one row per slice island, the time before it (null: it's the entity's first) and its start."""
    ks = [f"_k{i}" for i in range(len(keys))]
    isl = _islands(df, keys, start, end, slice_ms)
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("_s")),
        lambda i: F.struct(
            F.greatest("_carry", F.when(i > 1, F.element_at("_e", F.greatest(i - 1, F.lit(1))))).alias("gs"),
            F.element_at("_s", i).alias("ge"),
        ),
    )
    return isl.select(*ks, F.inline(pairs).alias("_gs", "_ge")).where(
        F.col("_gs").isNull() | ((F.col("_ge") > F.col("_gs")) & (F.col("_ge") - F.col("_gs") >= min_gap_ms))
    )


def interval_gaps(
    df: DataFrame, keys: list[str], start: Column, end: Column, min_gap_ms: int = 1, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Gaps between neighbouring continuous periods of each entity: keys, gap_start_ms, gap_end_ms.

    start and end are BIGINT columns (see to_ms); an interval covers [start, end). Pauses shorter than
    min_gap_ms are no gaps. Rows with a null boundary, or whose end isn't after the start, count for nothing.
    A null in a key is a value like any other. Repeated rows change nothing; an empty table gives no rows.
    Further columns of df are ignored, whatever they are called.
    """
    got = _edges(df, keys, start, end, min_gap_ms, slice_ms).where("_gs is not null")
    return got.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_gs").alias("gap_start_ms"), F.col("_ge").alias("gap_end_ms"))


def interval_periods(
    df: DataFrame, keys: list[str], start: Column, end: Column, min_gap_ms: int = 1, slice_ms: int = SLICE_MS
) -> DataFrame:
    """Continuous periods of each entity: keys, period_start_ms, period_end_ms, period_no (from 1). Cases as interval_gaps."""
    ks = [f"_k{i}" for i in range(len(keys))]
    edges = _edges(df, keys, start, end, min_gap_ms, slice_ms)
    clean = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], start.alias("_start"), end.alias("_end"))
    last = clean.where("_start is not null and _end is not null and _end > _start").groupBy(*ks).agg(F.max("_end").alias("_last"))
    last = last.select(*[F.col(k).alias(f"c{k}") for k in ks], "_last")
    # Edges are numbered and paired within slices; one row a slice carries the number before it and the first edge behind it.
    packed = edges.select(*ks, F.floor(F.col("_ge") / slice_ms).alias("_slice"), F.struct("_ge", "_gs").alias("_x")).groupBy(*ks, "_slice").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    w = Window.partitionBy(*ks).orderBy("_slice")
    slices = packed.withColumn("_behind", F.lead(F.element_at("_xs", 1)["_gs"]).over(w)).withColumn("_before", F.coalesce(F.sum(F.size("_xs")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = slices.select(*ks, "_behind", "_before", "_xs", F.posexplode("_xs").alias("_i", "_x"))
    stepped = each.select(*ks, F.col("_x._ge").alias("_ge"), F.coalesce(F.get("_xs", F.col("_i") + 1)["_gs"], "_behind").alias("_next"), (F.col("_before") + F.col("_i") + 1).cast("bigint").alias("_no"))
    joined = stepped.join(last, [F.col(k).eqNullSafe(F.col(f"c{k}")) for k in ks])
    return joined.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_ge").alias("period_start_ms"),
        F.coalesce("_next", "_last").alias("period_end_ms"),
        F.col("_no").alias("period_no"),
    )
