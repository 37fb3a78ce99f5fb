"""Problem 1: continuous periods of each speaker in each job, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.operators.intervals import interval_gaps, interval_periods, to_ms
from cuemill.session import table

#: Pauses shorter than this are no gaps.
MIN_GAP_MS = 40


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    speaker = F.upper(F.regexp_replace("speaker", r"^[\s ]+|[\s ]+$", ""))
    return table(spark, sf_dir, "speaker_turns").select("job_id", speaker.alias("speaker"), "start_s", "end_s").where("speaker <> ''")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_gaps(_turns(spark, sf_dir), ["job_id", "speaker"], to_ms(F.col("start_s")), to_ms(F.col("end_s")), MIN_GAP_MS)


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_periods(_turns(spark, sf_dir), ["job_id", "speaker"], to_ms(F.col("start_s")), to_ms(F.col("end_s")), MIN_GAP_MS)


QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods}

_TURNS = """with t as (
  select distinct job_id, upper(trim(speaker)) as speaker, cast(round(start_s * 1000) as bigint) as s, cast(round(end_s * 1000) as bigint) as e
  from speaker_turns where trim(speaker) <> '' and end_s > start_s and not isnan(start_s) and not isnan(end_s)),
w as (select *, max(e) over (partition by job_id, speaker order by s, e rows between unbounded preceding and 1 preceding) as pe from t)"""

SQL = {
    "p1_found": f"{_TURNS} select distinct job_id, speaker, pe as gap_start_ms, s as gap_end_ms from w where s - pe >= {MIN_GAP_MS}",
    "p1_periods": f"""{_TURNS}, g as (
  select *, sum(case when pe is null or s - pe >= {MIN_GAP_MS} then 1 else 0 end)
    over (partition by job_id, speaker order by s, e rows between unbounded preceding and current row) as no from w)
select job_id, speaker, min(s) as period_start_ms, max(e) as period_end_ms, cast(no as bigint) as period_no from g group by job_id, speaker, no""",
}
