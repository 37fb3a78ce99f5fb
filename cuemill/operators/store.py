"""Versioned tables without an update in place: every change is a row more, the latest wins on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The latest version of each key; order decides, so it should be unique within a key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, changes: DataFrame, key: str, columns: list[str], overwrite: str) -> DataFrame:
    """base with changes: a known key takes a change's value where `overwrite` is true or its own is null; new keys are added."""
    b = base.select(F.col(key).alias("_bk"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    m = changes.select(F.col(key).alias("_ck"), F.col(overwrite).alias("_over"), *[F.col(c).alias(f"_c_{c}") for c in columns])
    both = b.join(m, F.col("_bk") == F.col("_ck"), "full_outer")
    over = F.coalesce("_over", F.lit(False))
    pick = [F.when(over, F.coalesce(f"_c_{c}", f"_b_{c}")).otherwise(F.coalesce(f"_b_{c}", f"_c_{c}")).alias(c) for c in columns]
    return both.select(F.coalesce("_bk", "_ck").alias(key), *pick)


#: What a control does to a job of a state (fixed values): (control, state) to state.
TRANSITIONS = {("pause", "processing"): "paused", ("resume", "paused"): "processing", ("cancel", "queued"): "cancelled", ("cancel", "processing"): "cancelled", ("cancel", "paused"): "cancelled", ("retry", "failed"): "queued"}


def apply_control(status: Column, control: Column) -> Column:
    """The state after a control; what isn't allowed leaves it."""
    out = status
    for (c, s), to in TRANSITIONS.items():
        out = F.when((control == c) & (status == s), F.lit(to)).otherwise(out)
    return out


def recover(status: Column) -> Column:
    """State of a job after a restart: what ran is queued again."""
    return F.when(status == "processing", F.lit("queued")).otherwise(status)


def split_row(df: DataFrame, group: str, row_id: str, start: str, end: str, at: Column, margin: int = 80) -> DataFrame:
    """Rows whose `at` lies inside them by margin on both sides are cut in two there, and all are numbered anew by time."""
    inside = at.isNotNull() & (at > F.col(start) + margin) & (at < F.col(end) - margin)
    halves = F.when(inside, F.array(F.struct(F.col(start).alias("s"), at.alias("e")), F.struct(at.alias("s"), F.col(end).alias("e")))).otherwise(F.array(F.struct(F.col(start).alias("s"), F.col(end).alias("e"))))
    cut = df.withColumn("_h", F.explode(halves)).withColumn(start, F.col("_h.s")).withColumn(end, F.col("_h.e")).drop("_h")
    return cut.withColumn(row_id, F.row_number().over(Window.partitionBy(group).orderBy(start, end, row_id)).cast("bigint"))


def merge_with_next(df: DataFrame, group: str, row_id: str, start: str, end: str, text: str, when: Column) -> DataFrame:
    """Rows for which `when` holds are joined with the row after them (which must not be one itself), then numbered anew."""
    w = Window.partitionBy(group).orderBy(start, row_id)
    marked = df.withColumn("_m", F.coalesce(when, F.lit(False))).withColumn("_eaten", F.coalesce(F.lag("_m").over(w), F.lit(False)) & ~F.col("_m"))
    joined = marked.withColumn("_ne", F.lead(end).over(w)).withColumn("_nt", F.lead(text).over(w)).withColumn("_free", F.coalesce(F.lead("_eaten").over(w), F.lit(False)))
    take = F.col("_m") & F.col("_free")
    out = joined.where("not _eaten").withColumn(end, F.when(take, F.greatest(end, "_ne")).otherwise(F.col(end))).withColumn(text, F.when(take, F.concat_ws(" ", text, "_nt")).otherwise(F.col(text)))
    out = out.drop("_m", "_eaten", "_ne", "_nt", "_free")
    return out.withColumn(row_id, F.row_number().over(Window.partitionBy(group).orderBy(start, row_id)).cast("bigint"))
