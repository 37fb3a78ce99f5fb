"""Problem 7: clean speaker turns of handed-in transcript lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import transcripts
from cuemill.session import materialize, table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.turns(materialize(transcripts.line_parts(table(spark, sf_dir, "transcript_lines")), "parts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("line_id", "speaker_id", "turn_start_ms").distinct()


def p7_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, speaker_id, turn_start_ms, lines, text: the turns themselves, their lines in the order of speech."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("start_ms", "line_id", "part", "text"))), lambda r: r["text"])
    return _turns(spark, sf_dir).groupBy("job_id", "speaker_id", "turn_start_ms").agg(F.count(F.lit(1)).alias("lines"), F.array_join(said, " ").alias("text"))


QUERIES = {"p7_found": p7_found, "p7_turns": p7_turns}
SQL: dict = {}
