"""Views of the test tables that several queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators.intervals import to_ms
from cuemill.session import table


def cues(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Timed cues once each: job_id, cue_id, l_start, l_end (milliseconds) and further columns."""
    c = table(spark, sf_dir, "cues").where("job_id is not null and cue_id is not null")
    return c.select("job_id", "cue_id", to_ms(F.col("start_s")).alias("l_start"), to_ms(F.col("end_s")).alias("l_end"), *more).where("l_end > l_start").distinct()


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid speaker turns once each: job_id, speaker, r_start, r_end (milliseconds)."""
    t = table(spark, sf_dir, "speaker_turns").where("job_id is not null")
    return t.select("job_id", F.upper(F.trim("speaker")).alias("speaker"), to_ms(F.col("start_s")).alias("r_start"), to_ms(F.col("end_s")).alias("r_end")).where("speaker <> '' and r_end > r_start").distinct()


MS = "cast(round({0} * 1000) as bigint)"
CUES = """c as (select distinct job_id, cue_id, cast(round(start_s * 1000) as bigint) as l_start, cast(round(end_s * 1000) as bigint) as l_end{more} from cues
  where job_id is not null and cue_id is not null and not isnan(start_s) and not isnan(end_s) and cast(round(end_s * 1000) as bigint) > cast(round(start_s * 1000) as bigint))"""
TURNS = """t as (select distinct job_id, upper(trim(speaker)) as speaker, cast(round(start_s * 1000) as bigint) as r_start, cast(round(end_s * 1000) as bigint) as r_end from speaker_turns
  where job_id is not null and trim(speaker) <> '' and not isnan(start_s) and not isnan(end_s) and cast(round(end_s * 1000) as bigint) > cast(round(start_s * 1000) as bigint))"""


def sql_cues(*more: str) -> str:
    return CUES.format(more="".join(f", {m}" for m in more))
