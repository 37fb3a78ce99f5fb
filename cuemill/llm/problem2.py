"""Problem 2: language of each cue's spoken line, and of each stretch of a mixed one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import garble, langid, transcripts
from cuemill.session import table


def spoken(text: str | None) -> str:
    """A line without annotations."""
    return transcripts._NOTE.sub(" ", text) if text else ""


def preparer(spark: SparkSession, trained: garble.Trained):
    """Makes, in a worker, the function that restores a garbled line and drops its annotations."""
    shared = spark.sparkContext.broadcast(trained)  # at most 1 / garble.MODEL_SHARE words
    key = garble.new_key()

    def make():
        model = garble.model_of(key, shared.value)
        return lambda text: spoken(garble.restore(text, model)[1])

    return make


def cue_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, cue_id, label, segments of each distinct cue line."""
    cues = table(spark, sf_dir, "cues").where("source is not null").select("job_id", "cue_id", "source", langid.label_code(F.col("source_language")).alias("label"))
    lines = cues.select("source")
    make = preparer(spark, garble.train(lines, "source"))
    texts, labels = langid.sample(cues, "source", "label")
    prepare = make()
    model = langid.fit([prepare(t) for t in texts], labels)
    return langid.identify(cues, ["job_id", "cue_id", "label"], "source", "label", model, make)


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, cue_id, segment_no, lang, confidence, first, end: every stretch of every cue."""
    got = cue_languages(spark, sf_dir).select("job_id", "cue_id", F.posexplode("segments").alias("segment_no", "s"))
    return got.select("job_id", "cue_id", "segment_no", "s.*").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cue_languages(spark, sf_dir).withColumn("langs", F.array_distinct(F.transform("segments", lambda s: s["lang"])))
    odd = got.where((F.size("langs") > 1) | ((F.size("langs") == 1) & ~F.col("label").eqNullSafe(F.element_at("langs", 1))))
    return odd.select("job_id", "cue_id", F.explode("langs").alias("lang")).distinct()


QUERIES = {"p2_found": p2_found, "p2_segments": p2_segments}
SQL: dict = {}
