"""Windows, selections, aggregates and rules over cues, sightings, jobs and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.operators import rules
from cuemill.operators.overlap import first_by, milli
from cuemill.operators.ranking import batch_numbers, take_until, top_then_restore
from cuemill.plans.tables import cues, sql_cues
from cuemill.session import table

_ORDER = ["l_start", "cue_id"]
_M = "cast(floor(({0}) * 1000 + 0.5) as bigint)"


def _num(name: str) -> F.Column:
    return F.when(~F.isnan(name), F.col(name))


def _confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed cues with their confidences, NaN as null."""
    c = cues(spark, sf_dir, "speaker_id", "source", "english", "source_language", "status", "transcription_confidence", "alignment_confidence", "speaker_confidence")
    return c.select("job_id", "cue_id", "l_start", "l_end", "speaker_id", "source", "english", "source_language", "status", *[_num(f"{x}_confidence").alias(y) for x, y in (("transcription", "tc"), ("alignment", "ac"), ("speaker", "sc"))])


_CONF = "x as (select job_id, cue_id, l_start, l_end, speaker_id, source, english, source_language, status, case when not isnan(transcription_confidence) then transcription_confidence end as tc, case when not isnan(alignment_confidence) then alignment_confidence end as ac, case when not isnan(speaker_confidence) then speaker_confidence end as sc from c)"
_WITH = f"with {sql_cues('speaker_id', 'source', 'english', 'source_language', 'status', 'transcription_confidence', 'alignment_confidence', 'speaker_confidence')}, {_CONF}"


def neighbour_context(spark, sf_dir):
    w = Window.partitionBy("job_id").orderBy(*_ORDER)
    return cues(spark, sf_dir, "english").select("job_id", "cue_id", F.lag("english", 1, "<start>").over(w).alias("before"), "english", F.lead("english", 1, "<end>").over(w).alias("after"))


def scene_context(spark, sf_dir):
    w = Window.partitionBy("job_id").orderBy(*_ORDER).rowsBetween(-3, 3)
    return cues(spark, sf_dir, "english").select("job_id", "cue_id", F.array_join(F.collect_list(F.coalesce("english", F.lit("-"))).over(w), " | ").alias("scene"))


def fixed_batches(spark, sf_dir):
    return batch_numbers(cues(spark, sf_dir), ["job_id"], _ORDER, 12).groupBy("job_id", "batch_no").agg(F.count(F.lit(1)).alias("cues"), F.min("l_start").alias("start_ms"), F.max("l_end").alias("end_ms"))


def decile_contour(spark, sf_dir):
    """Ten equal slices of each user's events by time, their mean value relative to the loudest slice."""
    e = table(spark, sf_dir, "events").withColumn("slice", F.ntile(10).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    level = e.groupBy("user_id", "slice").agg(F.avg(F.round(F.col("value") * 100).cast("bigint")).alias("level"))
    return level.select("user_id", F.col("slice").cast("bigint").alias("slice"), milli(F.col("level") / F.greatest(F.max("level").over(Window.partitionBy("user_id")), F.lit(1e-9))).alias("level_milli"))


def frame_energies(spark, sf_dir):
    """Tumbling frames of an hour and sliding ones of two hours every hour, over all events."""
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    hour = 3_600_000_000
    frames = e.select(F.explode(F.array(F.struct(F.lit("tumbling").alias("kind"), F.floor(F.col("us") / hour).alias("frame")), F.struct(F.lit("sliding").alias("kind"), F.floor(F.col("us") / hour).alias("frame")), F.struct(F.lit("sliding").alias("kind"), (F.floor(F.col("us") / hour) - 1).alias("frame")))).alias("f"), "value")
    return frames.groupBy("f.kind", "f.frame").agg(F.count(F.lit(1)).alias("events"), milli(F.sqrt(F.avg(F.pow(F.round(F.col("value") * 100), F.lit(2)).cast("bigint"))) / 100).alias("rms_milli"))


def activity_runs(spark, sf_dir):
    """Runs of a user's louder events with pauses of at most six hours."""
    e = table(spark, sf_dir, "events").where("value >= 20").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = e.withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(w) > 6 * 3_600_000_000).cast("bigint"), F.lit(1))).withColumn("run_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "run_no").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("events"))


def chunk_plan(spark, sf_dir):
    """Chunks of 240 s with 12 s overlap over each job; the core of a chunk leaves half the overlap to its neighbour."""
    j = table(spark, sf_dir, "jobs").where("job_id is not null and duration_s > 0 and not isnan(duration_s)").groupBy("job_id").agg(F.max(F.round(F.col("duration_s") * 1000).cast("bigint")).alias("ms"))
    c = j.select("job_id", "ms", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("ms") - 12_000 - 1, F.lit(0)), F.lit(228_000).cast("bigint"))).alias("chunk_no", "start_ms"))
    end = F.least(F.col("start_ms") + 240_000, F.col("ms"))
    return c.select("job_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "start_ms", end.alias("end_ms"), F.when(F.col("start_ms") == 0, 0).otherwise(F.col("start_ms") + 6_000).alias("core_start_ms"), F.when(end == F.col("ms"), F.col("ms")).otherwise(end - 6_000).alias("core_end_ms"))


def margin_confidence(spark, sf_dir):
    """The likeliest face of each speaker in each job, and how far it is ahead of the next one."""
    s = table(spark, sf_dir, "face_sightings").where("speaker_id > 0 and active_face_id is not null and job_id is not null and active_speaker_confidence is not null and not isnan(active_speaker_confidence)").select("sighting_id", "job_id", "speaker_id", "active_face_id", "active_speaker_confidence").distinct()
    score = s.groupBy("job_id", "speaker_id", "active_face_id").agg(F.sum(F.round(F.col("active_speaker_confidence") * 1000).cast("bigint")).alias("score"))
    w = Window.partitionBy("job_id", "speaker_id").orderBy(F.desc("score"), "active_face_id")
    ranked = score.withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0))).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return ranked.select("job_id", "speaker_id", F.col("active_face_id").alias("face_id"), "score", (F.col("score") - F.col("next")).alias("margin"))


def budgeted_topk_restore_order(spark, sf_dir):
    """The 200 riskiest foreign lines, in the order of speech."""
    x = _confident(spark, sf_dir).where("tc is not null and ac is not null and length(trim(source)) > 0 and l_end - l_start >= 350 and lower(coalesce(source_language, '')) not in ('en', 'eng', 'english')")
    risk = milli(1 - F.col("tc") + F.greatest(F.lit(0.0), F.lit(0.85) - F.col("ac")))
    return top_then_restore(x.select("job_id", "cue_id", risk.alias("risk_milli")), [F.desc("risk_milli"), F.col("job_id"), F.col("cue_id")], 200, ["job_id", "cue_id"])


def newest_first_limit(spark, sf_dir):
    j = table(spark, sf_dir, "jobs").where("job_id is not null")
    return first_by(j, ["job_id"], [F.desc("updated_at"), "status"]).select("job_id", "status", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us")).orderBy(F.desc("created_us"), "job_id").limit(20)


def ranked_catalogue(spark, sf_dir):
    w = Window.partitionBy("media_type").orderBy(F.desc("popularity"), "catalogue_id")
    return table(spark, sf_dir, "catalogue").withColumn("rank", F.row_number().over(w)).where("rank <= 12").select("media_type", F.col("rank").cast("bigint").alias("rank"), "catalogue_id", "title")


def greedy_duration_budget(spark, sf_dir):
    """The longest cues of each job, 600 ms or more, until 80 are taken or 300 s are full; in the order of time."""
    c = cues(spark, sf_dir).withColumn("ms", F.col("l_end") - F.col("l_start")).where("ms >= 600")
    return take_until(c, ["job_id"], [F.desc("ms"), F.desc("l_start"), F.desc("l_end"), F.desc("cue_id")], "ms", 300_000, 80).select("job_id", "cue_id", "ms", "taken_before")


def reference_bank(spark, sf_dir):
    """Lines to take a speaker's voice from: sure and not too short, best first, until eight seconds are full."""
    x = _confident(spark, sf_dir).where("speaker_id > 0 and sc >= 0.62 and l_end - l_start >= 650 and tc >= 0.30").withColumn("ms", F.col("l_end") - F.col("l_start"))
    x = x.withColumn("score_milli", milli(0.82 * F.col("tc") + 0.18 * F.least(F.col("ms"), F.lit(6000)) / 6000))
    return take_until(x, ["job_id", "speaker_id"], [F.desc("score_milli"), F.desc("cue_id")], "ms", 8_000, 1_000_000).select("job_id", "speaker_id", "cue_id", "score_milli", "taken_before")


def identities_by_observations(spark, sf_dir):
    return table(spark, sf_dir, "face_sightings").where("active_face_id is not null").groupBy("active_face_id").agg(F.countDistinct("sighting_id").alias("observations")).where("observations >= 2")


def fidelity_summary(spark, sf_dir):
    x = _confident(spark, sf_dir)
    mid = lambda c: milli(F.expr(f"percentile({c}, 0.5)"))
    return x.groupBy("job_id").agg(F.count(F.lit(1)).alias("cues"), mid("tc").alias("tc_median"), mid("ac").alias("ac_median"), mid("sc").alias("sc_median"), F.count_if(F.col("sc") < 0.5).alias("unsure"), F.count_if(F.col("english").isNull()).alias("untranslated"))


def qc_summary(spark, sf_dir):
    x = _confident(spark, sf_dir)
    flagged = (F.coalesce("tc", F.lit(0.0)) < 0.55) | (F.coalesce("ac", F.lit(0.0)) < 0.55) | (F.coalesce("sc", F.lit(0.0)) < 0.5)
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("cues"), F.count_if(flagged).alias("flagged"), F.count_if(~flagged).alias("passed"))


def _anchors(spark, sf_dir):
    s = table(spark, sf_dir, "face_sightings").where("speaker_id > 0 and active_face_id is not null and job_id is not null and active_speaker_confidence >= 0.70 and not isnan(active_speaker_confidence)").select("sighting_id", "job_id", "speaker_id", "active_face_id", F.round(F.col("active_speaker_confidence") * 1000).cast("bigint").alias("w")).distinct()
    votes = s.groupBy("job_id", "active_face_id", "speaker_id").agg(F.sum("w").alias("w"))
    total = votes.groupBy("job_id", "active_face_id").agg(F.sum("w").alias("total"), F.max(F.struct("w", -F.col("speaker_id"))).alias("top"))
    return total.select("job_id", "active_face_id", (-F.col("top.col2")).cast("bigint").alias("speaker_id"), F.col("top.w").alias("votes"), "total").where(F.col("votes") * 10 >= F.col("total") * 6)


def weighted_vote_anchor(spark, sf_dir):
    """The speaker a face belongs to: at least 60 % of its confident sightings' weight."""
    return _anchors(spark, sf_dir)


def reassign_by_anchor(spark, sf_dir):
    """Sightings whose face is anchored to another speaker than the one told."""
    s = table(spark, sf_dir, "face_sightings").where("job_id is not null and active_speaker_confidence >= 0.72 and not isnan(active_speaker_confidence)").select("sighting_id", "job_id", "speaker_id", "active_face_id").distinct()
    a = _anchors(spark, sf_dir).select("job_id", "active_face_id", F.col("speaker_id").alias("anchored"))
    return s.join(a, ["job_id", "active_face_id"]).where("not (coalesce(speaker_id, 0) <=> anchored)").select("sighting_id", F.coalesce("speaker_id", F.lit(0)).cast("bigint").alias("told"), "anchored")


def create_identities(spark, sf_dir):
    """Faces without an anchor that are seen three times or more: new speakers, numbered after the known ones of the job."""
    s = table(spark, sf_dir, "face_sightings").where("job_id is not null and active_face_id is not null").select("sighting_id", "job_id", "speaker_id", "active_face_id").distinct()
    faces = s.groupBy("job_id", "active_face_id").agg(F.count(F.lit(1)).alias("seen"), F.min("sighting_id").alias("first"))
    faces = faces.where("seen >= 3").join(_anchors(spark, sf_dir).select("job_id", "active_face_id"), ["job_id", "active_face_id"], "left_anti")
    known = s.groupBy("job_id").agg(F.max(F.coalesce("speaker_id", F.lit(0))).alias("known"))
    w = Window.partitionBy("job_id").orderBy("first")
    return faces.join(known, "job_id").select("job_id", "active_face_id", (F.col("known") + F.row_number().over(w)).cast("bigint").alias("new_speaker_id"), milli(F.least(F.lit(0.86), 0.62 + 0.08 * F.col("seen"))).alias("confidence_milli"))


def weighted_confidence(spark, sf_dir):
    """Mean log confidence of a job weighted by length (50 ms at least), and its confidence."""
    # Whole millionths are summed, so the order of the rows doesn't show in the result.
    x = _confident(spark, sf_dir).where("tc > 0").withColumn("w", F.greatest(F.col("l_end") - F.col("l_start"), F.lit(50)))
    millionths = F.floor(F.log("tc") * 1_000_000 + 0.5).cast("bigint")
    g = x.groupBy("job_id").agg((F.sum(millionths * F.col("w")) / (F.sum("w") * 1_000_000)).alias("m"), F.sum(F.least(F.lit(1000), milli(F.col("tc")))).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("job_id", milli(F.exp(F.least(F.lit(0.0), F.col("m")))).alias("confidence_milli"), F.expr("(2 * s + n) div (2 * n)").alias("plain_milli"))


def hydrate_confidence(spark, sf_dir):
    """Alignment confidence, or where it is missing the mean of the other two that are told."""
    others = F.filter(F.array("tc", "sc"), lambda v: v.isNotNull())
    mean = F.when(F.size(others) > 0, F.aggregate(others, F.lit(0.0), lambda a, v: a + v) / F.size(others))
    return _confident(spark, sf_dir).select("job_id", "cue_id", milli(F.coalesce("ac", mean)).alias("alignment_milli"))


def eta_median_factor(spark, sf_dir):
    """Median of processing time by programme time over the 50 newest finished jobs of each kind."""
    j = table(spark, sf_dir, "jobs").where("job_id is not null and status = 'done' and duration_s > 0 and not isnan(duration_s)").select("job_id", F.coalesce("media_kind", F.lit("-")).alias("media_kind"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("c"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("u"), F.round(F.col("duration_s") * 1000).cast("bigint").alias("ms")).distinct()
    j = j.withColumn("factor", (F.col("u") - F.col("c")) / (F.col("ms") * 1000)).where("factor between 0.2 and 2000")
    w = Window.partitionBy("media_kind").orderBy(F.desc("u"), "job_id", "c", "ms")
    return j.withColumn("rn", F.row_number().over(w)).where("rn <= 50").groupBy("media_kind").agg(F.count(F.lit(1)).alias("jobs"), milli(F.expr("percentile(factor, 0.5)")).alias("factor_milli"))


def project_grouping(spark, sf_dir):
    """Jobs by kind: how many, how many done, and the newest one."""
    j = table(spark, sf_dir, "jobs").where("job_id is not null").select("job_id", "status", "media_kind", F.unix_micros(F.col("created_at").cast("timestamp")).alias("c")).distinct()
    return j.groupBy("media_kind").agg(F.countDistinct("job_id").alias("jobs"), F.countDistinct(F.when(F.col("status") == "done", F.col("job_id"))).alias("done"), F.max(F.struct("c", "job_id"))["job_id"].alias("newest"))


def level_statistics(spark, sf_dir):
    """Count, mean, population deviation, peak and linear percentiles of prices by return flag."""
    p = lambda q: F.expr(f"percentile(l_extendedprice, {q})")
    cents = lambda x: F.floor(x * 100 + 0.5).cast("bigint")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), cents(F.avg("l_extendedprice")).alias("mean"), cents(F.stddev_pop("l_extendedprice")).alias("deviation"), cents(F.max(F.abs("l_extendedprice"))).alias("peak"), cents(p(0.2)).alias("p20"), cents(p(0.7)).alias("p70"), cents(p(0.9)).alias("p90"))


def distinct_voices(spark, sf_dir):
    return _confident(spark, sf_dir).groupBy("job_id").agg(F.countDistinct(F.when(F.col("sc") >= 0.62, F.col("speaker_id"))).alias("sure_voices"), F.countDistinct("speaker_id").alias("voices"), F.countDistinct("source_language").alias("labels"))


def resume_completed(spark, sf_dir):
    """What is left to do: cues not finished, of jobs that have finished ones; and how many are."""
    x = _confident(spark, sf_dir)
    begun = x.where("status in ('done', 'voiced')").select("job_id").distinct()
    return x.where("status not in ('done', 'voiced')").join(begun, "job_id", "left_semi").select("job_id", "cue_id", "status")


def low_windows(spark, sf_dir):
    """Minutes of a job that need a second pass: no cue in them, or one below .82 in alignment."""
    x = _confident(spark, sf_dir).withColumn("minute", F.floor(F.col("l_start") / 60_000))
    span = x.groupBy("job_id").agg(F.max("minute").alias("m")).select("job_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "m")).alias("minute"))
    got = x.groupBy("job_id", "minute").agg(F.min(F.coalesce("ac", F.lit(0.0))).alias("low"), F.count(F.lit(1)).alias("cues"))
    return span.join(got, ["job_id", "minute"], "left").where("low is null or low < 0.82").select("job_id", "minute", F.coalesce("cues", F.lit(0)).alias("cues"))


def _measures() -> dict:
    r = F.length("english") / F.greatest(F.length("source"), F.lit(1))
    return {
        "transcription": F.col("tc"), "alignment": F.col("ac"), "speaker": F.col("sc"), "duration_s": (F.col("l_end") - F.col("l_start")) / 1000,
        "verdict": F.when(F.col("english").isNotNull(), F.col("status") != "review"), "overlapping": F.col("speaker_id") == 0, "stretch_percent": F.abs(r - 1) * 20,
        "word_similarity": F.col("tc"), "wer": 1 - F.col("tc"), "cer": 1 - F.col("ac"),
    }


def rule_reasons(spark, sf_dir):
    """Reasons for a review of each cue, in the order of the rules; measures that the table lacks are stood in for."""
    got = _confident(spark, sf_dir).withColumn("r", rules.reasons(rules.inspect_rules(_measures())))
    return got.select("job_id", "cue_id", F.array_join("r", "; ").alias("reasons"), (F.size("r") > 0).alias("needs_review"))


def delivery_failures(spark, sf_dir):
    """Delivery rules over order lines standing in for measured files."""
    m = {"lufs": -F.col("l_quantity"), "target_lufs": F.lit(-24.0), "peak": -F.col("l_tax") * 20, "target_peak": F.lit(-1.0), "range": F.col("l_discount") * 10, "source_range": F.lit(0.4), "duration_ms": F.col("l_partkey"), "source_duration_ms": F.col("l_suppkey")}
    got = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(rules.reasons(rules.delivery_rules(m)), "; ").alias("failures"))
    return got.groupBy("failures").agg(F.count(F.lit(1)).alias("files"))


def take_acceptance(spark, sf_dir):
    """Each cue against the next of its speaker as another take of it: whether it would replace it."""
    x = _confident(spark, sf_dir).where("speaker_id > 0 and tc is not null and ac is not null and sc is not null")
    w = Window.partitionBy("job_id", "speaker_id").orderBy(*_ORDER)
    x = x.select("job_id", "cue_id", "tc", "ac", "sc", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("tc", "ac", "sc")]).where("n_tc is not null")
    side = lambda p: {"words": F.col(f"{p}tc"), "similarity": F.col(f"{p}sc"), "performance": F.col(f"{p}ac"), "timing": F.lit(1.0)}
    return x.select("job_id", "cue_id", rules.accept_retake(side("n_"), side("")).alias("retake"), rules.accept_fallback(side("n_"), side("")).alias("fallback"))


def candidate_choice(spark, sf_dir):
    """The wording of least cost for each part: its offers stand in for candidates; the first of equals wins."""
    l = table(spark, sf_dir, "lineitem")
    c = {"adequacy": 1 - F.col("l_discount"), "rhythm": 1 - F.col("l_tax"), "ratio": F.col("l_quantity") / 25, "terms": F.lit(0.9), "register": F.lit(0.8), "missing_names": (F.col("l_linenumber") == 7).cast("int")}
    cost = milli(rules.candidate_score(c, F.col("l_returnflag") == "R"))
    best = l.select("l_partkey", F.struct(cost.alias("cost_milli"), "l_orderkey", "l_linenumber").alias("s")).groupBy("l_partkey").agg(F.min("s").alias("s"))
    return best.select("l_partkey", "s.*")


QUERIES = {
    f.__name__: f
    for f in [
        neighbour_context, scene_context, fixed_batches, decile_contour, frame_energies, activity_runs, chunk_plan, margin_confidence, budgeted_topk_restore_order, newest_first_limit, ranked_catalogue, greedy_duration_budget,
        reference_bank, identities_by_observations, fidelity_summary, qc_summary, weighted_vote_anchor, reassign_by_anchor, create_identities, weighted_confidence, hydrate_confidence, eta_median_factor, project_grouping,
        level_statistics, distinct_voices, resume_completed, low_windows, rule_reasons, delivery_failures, take_acceptance, candidate_choice,
    ]
}

_WC = f"with {sql_cues('english')}"
_D = "cast({0} as double)"
_ANCHOR = """s as (select distinct sighting_id, job_id, speaker_id, active_face_id, cast(round(active_speaker_confidence * 1000) as bigint) as w from face_sightings
  where speaker_id > 0 and active_face_id is not null and job_id is not null and active_speaker_confidence >= 0.70 and not isnan(active_speaker_confidence)),
v as (select job_id, active_face_id, speaker_id, sum(w) as w from s group by 1, 2, 3),
r as (select *, sum(w) over (partition by job_id, active_face_id) as total, row_number() over (partition by job_id, active_face_id order by w desc, speaker_id) as rn from v),
anchors as (select job_id, active_face_id, cast(speaker_id as bigint) as speaker_id, cast(w as bigint) as votes, cast(total as bigint) as total from r where rn = 1 and w * 10 >= total * 6)"""
_Z = lambda e, d: f"case when ({e}) is null or isnan(({e})) then cast({d} as double) else ({e}) end"
_STRETCH = "abs(length(english) / greatest(length(source), 1) - 1) * 20"
_REASONS = [
    ("missing transcription", "tc is null"), ("missing alignment", "ac is null"), ("missing speaker", "sc is null"), ("missing duration_s", "false"), ("verdict missing", "english is null or status is null"), ("verdict failed", "english is not null and status = 'review'"),
    ("overlapping speech", "speaker_id = 0"), ("heavy stretch", f"coalesce({_STRETCH}, 999) > 8"), ("noticeable stretch", f"coalesce({_STRETCH}, 999) > 5 and coalesce({_STRETCH}, 999) <= 8"),
    ("words differ", "coalesce(tc, 0) < 0.72 or (coalesce(1 - tc, 1) > 0.4 and coalesce(1 - ac, 1) > 0.35)"), ("speaker uncertain", "coalesce(sc, 0) < 0.5"), ("transcription uncertain", "coalesce(tc, 0) < 0.55"), ("alignment uncertain", "coalesce(ac, 0) < 0.55"),
]
_LIST = "array_to_string(list_filter([{0}], lambda z: z is not null), '; ')"
_SCORE = "0.35 * {p}ac + 0.35 * {p}sc + 0.30 * {p}tc"
_BACK = "0.4 * {p}tc + 0.25 * {p}sc + 0.25 * {p}ac + 0.1 * 1.0"
SQL = {
    "neighbour_context": f"{_WC} select job_id, cue_id, lag(english, 1, '<start>') over w as before, english, lead(english, 1, '<end>') over w as after from c window w as (partition by job_id order by l_start, cue_id)",
    "scene_context": f"{_WC} select job_id, cue_id, array_to_string(list(coalesce(english, '-')) over (partition by job_id order by l_start, cue_id rows between 3 preceding and 3 following), ' | ') as scene from c",
    "fixed_batches": f"with {sql_cues()}, b as (select *, (row_number() over (partition by job_id order by l_start, cue_id) - 1) // 12 as batch_no from c) select job_id, cast(batch_no as bigint) as batch_no, count(*) as cues, min(l_start) as start_ms, max(l_end) as end_ms from b group by job_id, batch_no",
    "decile_contour": f"with e as (select user_id, value, ntile(10) over (partition by user_id order by ts, event_id) as slice from events), l as (select user_id, slice, avg(cast(round(value * 100) as bigint)) as level from e group by 1, 2) select user_id, cast(slice as bigint) as slice, {_M.format('level / greatest(max(level) over (partition by user_id), cast(1e-9 as double))')} as level_milli from l",
    "frame_energies": f"""with e as (select epoch_us(ts) as us, value from events), f as (select 'tumbling' as kind, us // 3600000000 as frame, value from e union all select 'sliding', us // 3600000000, value from e union all select 'sliding', us // 3600000000 - 1, value from e)
select kind, cast(frame as bigint) as frame, count(*) as events, {_M.format('sqrt(avg(cast(pow(round(value * 100), 2) as bigint))) / 100')} as rms_milli from f group by kind, frame""",
    "activity_runs": """with e as (select user_id, event_id, epoch_us(ts) as us from events where value >= 20), m as (select *, case when lag(us) over w is null or us - lag(us) over w > 21600000000 then 1 else 0 end as new from e window w as (partition by user_id order by us, event_id)),
r as (select *, sum(new) over (partition by user_id order by us, event_id rows between unbounded preceding and current row) as run_no from m) select user_id, cast(run_no as bigint) as run_no, min(us) as first_us, max(us) as last_us, count(*) as events from r group by user_id, run_no""",
    "chunk_plan": """with j as (select job_id, max(cast(round(duration_s * 1000) as bigint)) as ms from jobs where job_id is not null and duration_s > 0 and not isnan(duration_s) group by 1),
p as (select job_id, ms, unnest(generate_series(0, greatest(ms - 12001, 0), 228000)) as start_ms from j)
select job_id, cast(start_ms // 228000 as bigint) as chunk_no, start_ms, least(start_ms + 240000, ms) as end_ms, case when start_ms = 0 then 0 else start_ms + 6000 end as core_start_ms, case when start_ms + 240000 >= ms then ms else start_ms + 234000 end as core_end_ms from p""",
    "margin_confidence": """with s as (select distinct sighting_id, job_id, speaker_id, active_face_id, active_speaker_confidence from face_sightings where speaker_id > 0 and active_face_id is not null and job_id is not null and not isnan(active_speaker_confidence)),
g as (select job_id, speaker_id, active_face_id, sum(cast(round(active_speaker_confidence * 1000) as bigint)) as score from s group by 1, 2, 3),
r as (select *, coalesce(lead(score) over w, 0) as nx, row_number() over w as rn from g window w as (partition by job_id, speaker_id order by score desc, active_face_id)) select job_id, speaker_id, active_face_id as face_id, cast(score as bigint) as score, cast(score - nx as bigint) as margin from r where rn = 1""",
    "budgeted_topk_restore_order": f"""{_WITH}, k as (select job_id, cue_id, {_M.format("1 - tc + greatest(cast(0 as double), cast(0.85 as double) - ac)")} as risk_milli from x where tc is not null and ac is not null and length(trim(source)) > 0 and l_end - l_start >= 350 and lower(coalesce(source_language, '')) not in ('en', 'eng', 'english'))
select * from k order by risk_milli desc, job_id, cue_id limit 200""",
    "newest_first_limit": "with r as (select job_id, status, epoch_us(created_at) as created_us, row_number() over (partition by job_id order by updated_at desc, status) as rn from jobs where job_id is not null) select job_id, status, created_us from r where rn = 1 order by created_us desc, job_id limit 20",
    "ranked_catalogue": "with r as (select media_type, row_number() over (partition by media_type order by popularity desc, catalogue_id) as rank, catalogue_id, title from catalogue) select * from r where rank <= 12",
    "greedy_duration_budget": f"""with {sql_cues()}, d as (select *, l_end - l_start as ms from c where l_end - l_start >= 600), w as (select *, coalesce(sum(ms) over (partition by job_id order by ms desc, l_start desc, l_end desc, cue_id desc rows between unbounded preceding and 1 preceding), 0) as tb, row_number() over (partition by job_id order by ms desc, l_start desc, l_end desc, cue_id desc) as rn from d)
select job_id, cue_id, ms, cast(tb as bigint) as taken_before from w where tb < 300000 and rn <= 80""",
    "reference_bank": f"""{_WITH}, e as (select *, l_end - l_start as ms, {_M.format("cast(0.82 as double) * tc + cast(0.18 as double) * least(l_end - l_start, 6000) / 6000")} as score_milli from x where speaker_id > 0 and sc >= 0.62 and l_end - l_start >= 650 and tc >= 0.30),
w as (select *, coalesce(sum(ms) over (partition by job_id, speaker_id order by score_milli desc, cue_id desc rows between unbounded preceding and 1 preceding), 0) as tb from e) select job_id, speaker_id, cue_id, score_milli, cast(tb as bigint) as taken_before from w where tb < 8000""",
    "identities_by_observations": "select active_face_id, count(distinct sighting_id) as observations from face_sightings where active_face_id is not null group by 1 having count(distinct sighting_id) >= 2",
    "fidelity_summary": f"{_WITH} select job_id, count(*) as cues, {_M.format('median(tc)')} as tc_median, {_M.format('median(ac)')} as ac_median, {_M.format('median(sc)')} as sc_median, count(*) filter (where sc < 0.5) as unsure, count(*) filter (where english is null) as untranslated from x group by job_id",
    "qc_summary": f"{_WITH}, f as (select status, coalesce(tc, 0) < 0.55 or coalesce(ac, 0) < 0.55 or coalesce(sc, 0) < 0.5 as fl from x) select status, count(*) as cues, count(*) filter (where fl) as flagged, count(*) filter (where not fl) as passed from f group by status",
    "weighted_vote_anchor": f"with {_ANCHOR} select * from anchors",
    "reassign_by_anchor": f"with {_ANCHOR}, q as (select distinct sighting_id, job_id, speaker_id, active_face_id from face_sightings where job_id is not null and active_speaker_confidence >= 0.72 and not isnan(active_speaker_confidence)) select q.sighting_id, cast(coalesce(q.speaker_id, 0) as bigint) as told, a.speaker_id as anchored from q join anchors a on q.job_id = a.job_id and q.active_face_id = a.active_face_id where coalesce(q.speaker_id, 0) <> a.speaker_id",
    "create_identities": f"""with {_ANCHOR}, q as (select distinct sighting_id, job_id, speaker_id, active_face_id from face_sightings where job_id is not null and active_face_id is not null),
f as (select job_id, active_face_id, count(*) as seen, min(sighting_id) as first from q group by 1, 2 having count(*) >= 3), n as (select f.* from f left join anchors a on f.job_id = a.job_id and f.active_face_id = a.active_face_id where a.job_id is null),
k as (select job_id, max(coalesce(speaker_id, 0)) as known from q group by 1)
select n.job_id, active_face_id, cast(known + row_number() over (partition by n.job_id order by first) as bigint) as new_speaker_id, {_M.format("least(cast(0.86 as double), cast(0.62 as double) + cast(0.08 as double) * seen)")} as confidence_milli from n join k on n.job_id = k.job_id""",
    "weighted_confidence": f"{_WITH}, w as (select job_id, tc, greatest(l_end - l_start, 50) as w, cast(floor(ln(tc) * 1000000 + 0.5) as bigint) as m from x where tc > 0) select job_id, {_M.format('exp(least(cast(0 as double), sum(m * w) / (sum(w) * 1000000)))')} as confidence_milli, cast((2 * sum(least(1000, {_M.format('tc')})) + count(*)) // (2 * count(*)) as bigint) as plain_milli from w group by job_id",
    "hydrate_confidence": f"{_WITH} select job_id, cue_id, {_M.format('coalesce(ac, case when tc is not null and sc is not null then (tc + sc) / 2 else coalesce(tc, sc) end)')} as alignment_milli from x",
    "eta_median_factor": f"""with j as (select distinct job_id, coalesce(media_kind, '-') as media_kind, epoch_us(created_at) as c, epoch_us(updated_at) as u, cast(round(duration_s * 1000) as bigint) as ms from jobs where job_id is not null and status = 'done' and duration_s > 0 and not isnan(duration_s)),
f as (select *, cast(u - c as double) / (ms * 1000) as factor from j), r as (select *, row_number() over (partition by media_kind order by u desc, job_id, c, ms) as rn from f where factor between 0.2 and 2000) select media_kind, count(*) as jobs, {_M.format('median(factor)')} as factor_milli from r where rn <= 50 group by media_kind""",
    "project_grouping": "with j as (select distinct job_id, status, media_kind, epoch_us(created_at) as c from jobs where job_id is not null) select media_kind, count(distinct job_id) as jobs, count(distinct case when status = 'done' then job_id end) as done, max({'c': c, 'j': job_id}).j as newest from j group by media_kind",
    "level_statistics": "select l_returnflag, count(*) as n, " + ", ".join(f"cast(floor({e} * 100 + 0.5) as bigint) as {a}" for e, a in (("avg(l_extendedprice)", "mean"), ("stddev_pop(l_extendedprice)", "deviation"), ("max(abs(l_extendedprice))", "peak"), ("quantile_cont(l_extendedprice, 0.2)", "p20"), ("quantile_cont(l_extendedprice, 0.7)", "p70"), ("quantile_cont(l_extendedprice, 0.9)", "p90"))) + " from lineitem group by l_returnflag",
    "distinct_voices": f"{_WITH} select job_id, count(distinct case when sc >= 0.62 then speaker_id end) as sure_voices, count(distinct speaker_id) as voices, count(distinct source_language) as labels from x group by job_id",
    "resume_completed": f"{_WITH} select job_id, cue_id, status from x where status not in ('done', 'voiced') and job_id in (select job_id from x where status in ('done', 'voiced'))",
    "low_windows": f"""{_WITH}, m as (select job_id, l_start // 60000 as minute, min(coalesce(ac, 0)) as low, count(*) as cues from x group by 1, 2), s as (select job_id, unnest(generate_series(0, max(minute))) as minute from m group by job_id)
select s.job_id, cast(s.minute as bigint) as minute, coalesce(cues, 0) as cues from s left join m on s.job_id = m.job_id and s.minute = m.minute where low is null or low < 0.82""",
    "rule_reasons": f"{_WITH}, y as (select job_id, cue_id, {_LIST.format(', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in _REASONS))} as reasons from x) select job_id, cue_id, reasons, reasons <> '' as needs_review from y",
    "delivery_failures": "with y as (select " + _LIST.format("case when abs(-l_quantity + 24) > 1.5 then 'loudness off target' end, case when -l_tax * 20 > -cast(1 as double) + cast(0.2 as double) then 'peak too high' end, case when abs(l_discount * 10 - cast(0.4 as double)) > 0.75 then 'range changed' end, case when abs(l_partkey - l_suppkey) > 250 then 'length changed' end") + " as failures from lineitem) select failures, count(*) as files from y group by failures",
    "take_acceptance": f"""{_WITH}, y as (select job_id, cue_id, tc, ac, sc, lead(tc) over w as n_tc, lead(ac) over w as n_ac, lead(sc) over w as n_sc from x where speaker_id > 0 and tc is not null and ac is not null and sc is not null window w as (partition by job_id, speaker_id order by l_start, cue_id)),
z as (select job_id, cue_id, tc, sc, ac, n_tc, n_sc, n_ac from y where n_tc is not null)
select job_id, cue_id, n_tc >= greatest(cast(0.72 as double), tc - 0.04) and n_sc >= sc - 0.03 and {_SCORE.format(p='n_')} > {_SCORE.format(p='')} + 0.03 as retake, {_BACK.format(p='n_')} > {_BACK.format(p='')} + 0.025 and n_ac >= ac - 0.02 as fallback from z""".replace("0.35", "cast(0.35 as double)").replace("0.30 ", "cast(0.30 as double) "),
    "candidate_choice": f"""with y as (select l_partkey, l_orderkey, l_linenumber, {_M.format("case when l_returnflag = 'R' then 0.53 else 0.58 end * (1 - (1 - l_discount)) + case when l_returnflag = 'R' then 0.15 else 0.10 end * (1 - (1 - l_tax)) + 0.18 * least(cast(1.5 as double), greatest(cast(0 as double), abs(l_quantity / 25 - 1) - cast(0.10 as double)) * 3) + cast(0.10 as double) * (1 - cast(0.9 as double)) + cast(0.04 as double) * (1 - cast(0.8 as double)) + 1.5 * case when l_linenumber = 7 then 1 else 0 end")} as cost_milli from lineitem)
select l_partkey, min({{'c': cost_milli, 'o': l_orderkey, 'l': l_linenumber}}).c as cost_milli, min({{'c': cost_milli, 'o': l_orderkey, 'l': l_linenumber}}).o as l_orderkey, min({{'c': cost_milli, 'o': l_orderkey, 'l': l_linenumber}}).l as l_linenumber from y group by l_partkey""",
}
