"""Problem 6: cue fields read in a wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import garble
from cuemill.session import table


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, cue_id, field_name, text: both fields of every cue, repeats of a cue once."""
    cues = table(spark, sf_dir, "cues").select("job_id", "cue_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("source", "english")])).alias("f"))
    return cues.select("job_id", "cue_id", "f.*")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, cue_id, field_name, restored, whole: garbled fields and their text as far as it can be had back."""
    every = fields(spark, sf_dir)
    return garble.find_garbled(every, ["job_id", "cue_id", "field_name"], "text", garble.train(every, "text")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_restored(spark, sf_dir).select("job_id", "cue_id", "field_name").distinct()


QUERIES = {"p6_found": p6_found, "p6_restored": p6_restored}
SQL: dict = {}
