"""Problem 4: the face sighting nearest in time to each cue of the same speaker and job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import nearest
from cuemill.session import table

TOLERANCE_MS = 750
_GOOD = "{0} is not null and not isnan({0}) and abs({0}) < 1e9"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As a pattern, since a stream's path may be a file only where it is one.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = _stream(spark, sf_dir, "cues").where(f"{_GOOD.format('start_s')} and {_GOOD.format('end_s')} and end_s > start_s and speaker_id > 0 and job_id is not null and cue_id is not null")
    # Times have whole milliseconds, so the middle of a cue has whole 500 microseconds.
    middle = (F.round(F.col("start_s") * 1000).cast("bigint") + F.round(F.col("end_s") * 1000).cast("bigint")) * 500
    cues = cues.select("job_id", "speaker_id", "cue_id", F.timestamp_micros(middle).alias("at"))
    seen = _stream(spark, sf_dir, "face_sightings").where(f"{_GOOD.format('at_s')} and speaker_id > 0 and job_id is not null and sighting_id is not null")
    seen = seen.select("job_id", "speaker_id", "sighting_id", F.timestamp_millis(F.round(F.col("at_s") * 1000).cast("bigint")).alias("at"))
    got = nearest.replay(cues, seen, ["job_id", "speaker_id"], ["cue_id"], "sighting_id", TOLERANCE_MS)
    return got.select("job_id", "cue_id", "sighting_id")


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": """with c as (
  select distinct job_id, speaker_id, cue_id, cast(round(start_s * 1000) as bigint) + cast(round(end_s * 1000) as bigint) as m2
  from cues where end_s > start_s and not isnan(start_s) and not isnan(end_s) and speaker_id > 0 and job_id is not null),
f as (select distinct job_id, speaker_id, sighting_id, 2 * cast(round(at_s * 1000) as bigint) as a2
  from face_sightings where at_s is not null and not isnan(at_s) and speaker_id > 0),
j as (select c.job_id, c.cue_id, f.sighting_id, row_number() over (partition by c.job_id, c.cue_id order by abs(a2 - m2), sighting_id) as rn
  from c join f on c.job_id = f.job_id and c.speaker_id = f.speaker_id and a2 between m2 - 1500 and m2 + 1500)
select job_id, cue_id, sighting_id from j where rn = 1"""
}
