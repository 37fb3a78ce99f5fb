"""Problem 8: ids of every document by a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import bpe
from cuemill.session import table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id"])


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose ids don't decode to their text; none are expected."""
    got = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), "text", ["doc_id", "text"]).withColumnRenamed("text", "original"), "ids", ["doc_id", "original"])
    return got.where(~F.coalesce("original", F.lit("")).eqNullSafe(F.col("text"))).select("doc_id")


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {"p8_round_trip": "select doc_id from documents where false"}
