"""Problem 10: documents that hold template residue, filler, error messages or script notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuemill.llm import residue
from cuemill.session import table


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and kind of the first evidence found."""
    docs = table(spark, sf_dir, "documents")
    return residue.find_residue(docs, "doc_id", "text", "source", residue.common_words(docs, "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_kinds(spark, sf_dir).select("doc_id").distinct()


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source of the documents that hold none: what is left for use. Empty and null texts stay."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(p10_found(spark, sf_dir), "doc_id", "left_anti")


QUERIES = {"p10_found": p10_found, "p10_kinds": p10_kinds, "p10_clean": p10_clean}
SQL: dict = {}
