"""Problem 9: documents of several sources mixed to target shares of the size in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm import bpe, mixing
from cuemill.session import materialize, table


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source is not null")
    return materialize(bpe.count_tokens(docs, "text", ["doc_id", "source"]), "sizes")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict = {}
