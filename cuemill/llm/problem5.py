"""Problem 5: typed names of works mapped to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.text import normalize_title
from cuemill.llm import canonical
from cuemill.session import materialize, table


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "catalogue").select("catalogue_id", F.explode(F.array_distinct(F.array("title", "original_title"))).alias("name"), "media_year", "media_type", "popularity")
    return c.where("name is not null").select(F.col("catalogue_id").alias("entry_id"), normalize_title("name").alias("key"), F.col("media_year").alias("year"), F.col("media_type").alias("kind"), F.col("popularity").alias("rank"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = table(spark, sf_dir, "media_names").select("name_id", F.coalesce(F.when(F.trim("normalized_title") != "", F.lower("normalized_title")), F.lit("")).alias("title"), F.col("media_year").alias("year"), F.col("media_type").alias("kind")).distinct()
    typed = materialize(names.select("title", "year", "kind").distinct(), "typed")
    entries = materialize(_entries(spark, sf_dir), "entries")
    return names, canonical.match_titles(typed, entries)


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name_id, title, year, catalogue_id (0: none meant) and score."""
    names, best = _scored(spark, sf_dir)
    b = best.select(F.col("title").alias("b_title"), F.col("year").alias("b_year"), F.col("kind").alias("b_kind"), "entry_id", "score")
    joined = names.join(b, (F.col("title") == F.col("b_title")) & F.col("year").eqNullSafe(F.col("b_year")) & F.col("kind").eqNullSafe(F.col("b_kind")), "left")
    return joined.select("name_id", "title", "year", F.coalesce("entry_id", F.lit(0)).cast("bigint").alias("catalogue_id"), "score")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("name_id", "catalogue_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_matches": p5_matches}
SQL: dict = {}
