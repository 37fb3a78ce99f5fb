"""Problem 3: broken pairs of a spoken line and its translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import garble, langid, pairs
from cuemill.llm.problem2 import preparer
from cuemill.session import materialize, table


def p3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is measured of each distinct pair on its own."""
    cues = table(spark, sf_dir, "cues").where("coalesce(status, '') <> 'pending' and source is not null")
    cues = cues.groupBy("job_id", "cue_id").agg(F.min(F.struct("source", "english", langid.label_code(F.col("source_language")).alias("label"))).alias("r")).select("job_id", "cue_id", "r.*")
    texts = cues.select(F.explode(F.array("source", "english")).alias("text"))
    trained = garble.train(texts, "text")
    prepare = preparer(spark, trained)()
    sample, labels = langid.sample(cues, "source", "label")
    model = langid.fit([prepare(t) for t in sample], labels)
    return pairs.features(cues, ["job_id", "cue_id"], "source", "english", trained, model)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(materialize(p3_features(spark, sf_dir), "pairs"), ["job_id", "cue_id"])


def p3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit: the sentences that were taken for templates of refusal."""
    return pairs.templates(materialize(p3_features(spark, sf_dir), "pairs"))


QUERIES = {"p3_found": p3_found, "p3_templates": p3_templates}
SQL: dict = {}
