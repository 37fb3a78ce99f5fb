"""Complete rule sets, gates, replies of models, names and records over the test tables; measures the tables lack are stood in for by the expressions in _STAND."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions import names, replies
from cuemill.functions.text import estimated_seconds, normalize_title
from cuemill.operators import gates, rules
from cuemill.operators.overlap import milli
from cuemill.plans.cue_queries import _LIST, _M, _WITH, _confident
from cuemill.plans.tables import cues, sql_cues
from cuemill.session import table

#: Measures of a line in terms of what the tables hold; the same text for both engines.
_STAND = {
    "speaker_confidence": "sc", "reference_quality": "ac", "timing_confidence": "tc", "transcription_confidence": "tc", "adaptation_confidence": "sc", "alignment_confidence": "ac",
    "stretch_percent": "(ac - 0.6e0) * 30", "timing_pass": "case when cue_id % 5 = 0 then null else cue_id % 7 <> 0 end", "padding_ms": "case when cue_id % 11 <> 0 then (l_end - l_start) / 10e0 end", "truncated_ms": "case when cue_id % 13 <> 0 then (l_end - l_start) / 60e0 end",
    "word_similarity": "tc", "wer": "1 - tc", "cer": "1 - ac", "backtranscription": "english", "verdict_available": "status is not null", "verdict_passed": "status <> 'review'", "overlapping": "speaker_id = 0", "overlap_kept": "cue_id % 2 = 0", "mouth_visible": "cue_id % 3 = 0",
    "active_seconds": "(l_end - l_start) / 1500e0", "voice_similarity": "case when cue_id % 17 <> 0 then sc end", "voice_reliable": "l_end - l_start >= 2000", "fallback_engine": "cue_id % 19 = 0", "full_clone": "cue_id % 2 = 1", "leakage": "1 - ac", "made": "english is not null",
    "seconds": "(l_end - l_start) / 1000e0", "contour_similarity": "ac - 0.5e0", "pause_delta": "1 - tc", "pitch_delta": "(1 - sc) * 8", "peak": "0.9e0 + tc / 10", "active_ratio": "ac - 0.4e0", "performance": "ac", "has_source_performance": "source is not null", "attempts": "cue_id % 4",
}
_MEASURED = ", ".join(f"{v} as {k}" for k, v in _STAND.items())


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, F.Column]]:
    x = _confident(spark, sf_dir)
    return x.select("job_id", "cue_id", *[F.expr(v).alias(f"m_{k}") for k, v in _STAND.items()]), {k: F.col(f"m_{k}") for k in _STAND}


def review_reasons(spark, sf_dir):
    """All reasons for a review of each cue, in order."""
    x, m = _measured(spark, sf_dir)
    r = rules.reasons(gates.line_rules(m))
    return x.select("job_id", "cue_id", F.array_join(r, "; ").alias("reasons"), F.size(r).cast("bigint").alias("n"))


def review_summary(spark, sf_dir):
    """Cues of each job, those flagged and those passed."""
    r = review_reasons(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("cues"), F.count_if(F.col("n") > 0).alias("flagged"))
    return r.select("*", (F.col("cues") - F.col("flagged")).alias("passed"))


def media_failures(spark, sf_dir):
    """All failures of finished files; order lines stand in for measured files."""
    even = lambda c, n: F.col(c) % n != 0
    m = {
        "source_has_video": F.lit(True), "video_tracks": (F.col("l_linenumber") % 7).cast("int"), "duration_error_ms": F.abs(F.col("l_partkey") - F.col("l_suppkey") * 20).cast("double"), "original_audio": even("l_partkey", 3), "original_subtitles": even("l_partkey", 5), "streams": even("l_suppkey", 4),
        "chapters": even("l_suppkey", 6), "metadata": F.col("l_returnflag") != "R", "english_lossless": F.col("l_linestatus") == "F", "english_default": F.col("l_returnflag") == "A", "lufs": F.when(F.col("l_linenumber") != 3, -F.col("l_quantity")), "peak": F.when(F.col("l_tax") > 0, -F.col("l_tax") * 20),
        "peak_target": F.lit(-1.0), "lufs_target": F.lit(-24.0), "dialogue_target": F.when(F.col("l_discount") > 0.05, F.lit(-27.0)), "dialogue_lufs": F.when(F.col("l_discount") < 0.09, -27 + F.col("l_discount") * 10),
    }
    got = table(spark, sf_dir, "lineitem").select(F.array_join(rules.reasons(gates.file_rules(m)), "; ").alias("failures"))
    return got.groupBy("failures").agg(F.count(F.lit(1)).alias("files"))


def take_failures(spark, sf_dir):
    """Timing, words, performance, fallback: which of them would have a cue's take made again."""
    x, m = _measured(spark, sf_dir)
    return x.select("job_id", "cue_id", F.array_join(gates.failed_takes(m), ",").alias("why")).where("why <> ''")


def second_reading_disputes(spark, sf_dir):
    """A cue's line against the line before it of the same voice as another reading of it; matching blocks in Python."""
    w = Window.partitionBy("job_id", "speaker_id").orderBy("l_start", "cue_id")
    x = _confident(spark, sf_dir).where("speaker_id > 0 and source is not null").withColumn("second", F.lag("source").over(w))
    d = gates.disputed(F.col("source"), F.col("second"), F.col("tc"), F.col("ac"), 1 - F.col("sc"), F.col("tc"))
    return x.select("job_id", "cue_id", d.alias("d")).where("d.disputed").select("job_id", "cue_id", milli(F.col("d.agreement")).alias("agreement_milli"), milli(F.col("d.confidence")).alias("confidence_milli"))


def judged_verdicts(spark, sf_dir):
    """Verdicts from findings and scores, with what a translation was judged against."""
    x = _confident(spark, sf_dir)
    s = replies.judged_scores({"adequacy": F.col("tc") * 130, "names": F.col("ac") + 0.2, "register": F.col("sc")})
    ref = gates.reference_reading(F.col("english"), F.col("source"), F.col("tc"), F.col("ac"), 1 - F.col("sc"), F.col("cue_id") % 2 == 0)
    v = gates.verdict(F.col("tc").isNotNull() & ref["complete"], F.col("status") == "review", s)
    return x.select("job_id", "cue_id", v["passed"].alias("passed"), v["basis"].alias("basis"), ref["basis"].alias("reference"), s["reported"].alias("reported"))


def semantic_scores(spark, sf_dir):
    x = _confident(spark, sf_dir)
    s = replies.judged_scores({"adequacy": F.col("tc") * 100, "names": F.col("ac"), "register": F.when(F.col("cue_id") % 9 != 0, F.lit(0.0))})
    return x.select("job_id", "cue_id", milli(s["adequacy"]).alias("adequacy_milli"), milli(s["names"]).alias("names_milli"), s["reported"].alias("reported"))


def revised_lines(spark, sf_dir):
    """Lines prepared for another translation: what a supplied text sets, and all dependents taken back."""
    x = _confident(spark, sf_dir)
    caption = F.col("english").rlike(r"(?i)(?:\d|[$£€¥]|\byen\b|\btickets?\b|\badmission\b|\s[-–—]\s)") & (F.size(F.split(F.trim("source"), r"\s+")) <= 2)
    supplied = F.when(F.col("english").rlike(r"(?U)\S") & ~F.coalesce(caption, F.lit(False)), F.col("english"))
    text = F.coalesce(supplied, "source", F.lit(""))
    return x.select("job_id", "cue_id", supplied.isNotNull().alias("was_supplied"), text.alias("english"), text.alias("literal_translation"), text.alias("adapted_dialogue"), *[F.lit(None).cast("string").alias(c) for c in gates.DEPENDENTS], F.lit(False).alias("force_adaptation"))


def directional_rewrites(spark, sf_dir):
    """Order lines as wordings of an order: the best of those that go the way that is needed."""
    l = table(spark, sf_dir, "lineitem").withColumn("kept", F.col("l_returnflag") != "N")
    return gates.directional(l, "l_orderkey", "l_linenumber", F.col("l_quantity"), F.lit(25.0), F.lit(20.0), F.col("l_linestatus") == "F", 1 - F.col("l_discount"), 1 - F.col("l_tax"), F.col("kept"))


def offered_wordings(spark, sf_dir):
    """Wordings in their fixed order; columns stand in for a reply's fields."""
    x = cues(spark, sf_dir, "source", "english", "speaker_name")
    w = replies.wordings({"natural": F.col("english"), "compact": F.col("source"), "fuller": F.lit("TRUE"), "same_meaning": F.col("english"), "literal": F.col("speaker_name")})
    return x.select("job_id", "cue_id", F.array_join(replies.judged_list(F.lit("as it is"), w), "|").alias("offers"))


def scraped_fields(spark, sf_dir):
    """The translation out of an object that its own quotes break."""
    x = cues(spark, sf_dir, "english").where("english is not null")
    broken = F.concat(F.lit('{"english": "She said "go". '), F.col("english"), F.lit('", "note": "x"}'))
    return x.select("job_id", "cue_id", replies.scraped_field(broken, "english").alias("found"), replies.scraped_field(broken, "note").alias("note"))


def duration_factors(spark, sf_dir):
    """How much faster or slower a line would be spoken, within its natural bounds."""
    x = cues(spark, sf_dir, "english").where("english is not null")
    f = replies.bounded(estimated_seconds(F.col("english")) * 1000 / (F.col("l_end") - F.col("l_start")), 0.86, 1.16, 1.0)
    return x.select("job_id", "cue_id", milli(f).alias("factor_milli"))


def job_options(spark, sf_dir):
    """Options of jobs put right: words of a list, numbers within bounds, a range that ends after it starts."""
    j = table(spark, sf_dir, "jobs").where("job_id is not null")
    kind, run = replies.one_of(F.col("media_kind"), ["movie", "tv"], "auto"), replies.one_of(F.col("control"), ["pause", "cancel"], "run")
    batch, threads = replies.bounded(F.col("progress"), 1, 8, 4.0), replies.bounded(F.col("duration_s"), 1, 12, 4.0)
    return j.select("job_id", kind.alias("kind"), run.alias("run"), batch.cast("int").alias("batch"), threads.cast("int").alias("threads")).distinct()


def public_jobs(spark, sf_dir):
    """Jobs as they are shown: the latest row, without what is private, length as a clock, language as a code."""
    w = Window.partitionBy("job_id").orderBy(F.desc("updated_at"), "status", "stage", "filename")
    j = table(spark, sf_dir, "jobs").where("job_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return j.select("job_id", "filename", "status", replies.clock_text(F.when(~F.isnan("duration_s"), F.col("duration_s"))).alias("length"), replies.language_code(F.col("source_language")).alias("code"), replies.target_code(F.initcap("source_language")).alias("target"))


def sidecar_choice(spark, sf_dir):
    """Of the names of a job's files the best subtitles to try first: full before signs, English first, by kind of text, by name."""
    s = table(spark, sf_dir, "media_names").where("source is not null and job_id is not null").select("job_id", F.concat("source", F.element_at(F.array(*map(F.lit, [".srt", ".sub", ".en.ass", ".forced.srt", ".full.vtt"])), (F.col("name_id") % 5 + 1).cast("int"))).alias("name")).distinct()
    low = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    unwanted, full = low.rlike("forced|signs|songs|commentary|director|trivia"), low.rlike("full|complete|dialogue")
    english = low.rlike(r"(^|[._ -])eng?($|[._ -])|english")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in {".srt": 0, ".vtt": 1, ".ass": 2, ".ssa": 3, ".sub": 4}.items() for x in kv])[F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))], F.lit(8))
    return s.groupBy("job_id").agg(F.min(F.struct(unwanted.alias("a"), (~full).alias("b"), (~english).alias("c"), kind.alias("d"), F.lower("name").alias("e"), F.col("name"))).alias("m")).select("job_id", F.col("m.name").alias("name"), F.col("m.d").alias("priority"))


def effects_stream(spark, sf_dir):
    """The first line of each job that tells of effects: a stream is picked by markers in its title."""
    t = table(spark, sf_dir, "transcript_lines").where("job_id is not null and source is not null")
    hit = F.lower("source").rlike("music & effects|music and effects|m&e|dme|clean effects|music|door")
    return t.where(hit).groupBy("job_id").agg(F.min("line_id").alias("line_id"))


def prompt_lines(spark, sf_dir):
    """Lines of a scene as a model sees them; a line that differs from the translation is a contested reading."""
    w = Window.partitionBy("job_id").orderBy("l_start", "cue_id")
    x = cues(spark, sf_dir, "source", "english", "speaker_name").where("source is not null")
    return x.select("job_id", "cue_id", replies.scene_line(F.row_number().over(w), F.col("speaker_name"), F.col("source"), F.when(F.col("cue_id") % 4 == 0, F.col("english")), F.col("english")).alias("line"))


def stored_or_parsed(spark, sf_dir):
    """A stored identity is used where all of it is there, else the name is read again."""
    n = table(spark, sf_dir, "media_names").where("source is not null").select("name_id", "source", "title", "normalized_title", "media_year", "media_type", "parse_confidence").distinct()
    whole = F.col("title").isNotNull() & F.col("normalized_title").isNotNull() & F.col("media_year").isNotNull() & F.col("media_type").isNotNull() & F.col("parse_confidence").isNotNull()
    p = names.parse_name(F.col("source"))
    return n.withColumn("p", p).select("name_id", whole.alias("stored"), F.when(whole, F.col("title")).otherwise(F.col("p.title")).alias("title"), F.when(whole, F.col("media_type")).otherwise(F.col("p.media_type")).alias("kind"), F.when(whole, F.col("media_year")).otherwise(F.col("p.media_year")).alias("year"))


def parsed_media_names(spark, sf_dir):
    """All that a file's name tells."""
    n = table(spark, sf_dir, "media_names").where("source is not null").select("name_id", "source").distinct()
    return n.withColumn("p", names.parse_name(F.col("source"))).select("name_id", "p.*")


def folder_names(spark, sf_dir):
    """Files in folders named after their title and kind: which of the two names them."""
    n = table(spark, sf_dir, "media_names").where("source is not null").select("name_id", "source", "title", "media_year").distinct()
    file = F.when(F.col("name_id") % 3 == 0, F.lit("movie.mkv")).otherwise(F.col("source"))
    folder = F.when(F.col("name_id") % 5 == 0, F.lit("Season 1")).when(F.col("name_id") % 5 == 1, F.lit("Movies")).otherwise(F.concat_ws(" ", "title", F.concat(F.lit("("), F.col("media_year").cast("string"), F.lit(")"))))
    return n.withColumn("p", names.folder_or_file(file, folder, F.concat_ws(" ", F.lit("The"), "title"))).select("name_id", "p.*")


def applied_candidate(spark, sf_dir):
    """Names with the catalogue entry of the same title and kind: what is told locally wins, the entry fills the rest."""
    n = table(spark, sf_dir, "media_names").where("normalized_title <> ''").select("name_id", "title", "normalized_title", "media_year", "media_type").distinct()
    w = Window.partitionBy("k", "kind").orderBy("catalogue_id")
    c = table(spark, sf_dir, "catalogue").select("catalogue_id", normalize_title("title").alias("k"), F.col("title").alias("c_title"), F.col("media_year").alias("c_year"), F.col("media_type").alias("kind")).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    got = n.join(c, (F.col("normalized_title") == F.col("k")) & (F.col("media_type") == F.col("kind")))
    return got.select("name_id", F.coalesce("title", "c_title").alias("title"), F.coalesce("media_year", "c_year").alias("year"), F.col("catalogue_id").alias("external_id"))


def alignment_of_groups(spark, sf_dir):
    """How far each voice's lines of a job read like well aligned words."""
    x = cues(spark, sf_dir, "speaker_id").where("speaker_id > 0")
    got = gates.alignment_confidence(x, ["job_id", "speaker_id"], "l_start", "l_end", ["l_start", "cue_id"], 0.9)
    return got.select("job_id", "speaker_id", milli(F.col("alignment")).alias("alignment_milli"), milli(F.col("transcription")).alias("transcription_milli"))


def prompt_batches(spark, sf_dir):
    """Batches of lines for a model: six at most, and so many characters."""
    x = cues(spark, sf_dir, "english").where("english is not null").select("job_id", "l_start", "cue_id", F.length("english").alias("chars"))
    return gates.running_batches(x, "job_id", ["l_start", "cue_id"], "chars", 6, 400).groupBy("job_id", "batch_no").agg(F.count(F.lit(1)).alias("lines"), F.sum("chars").cast("bigint").alias("chars"), F.min("l_start").alias("start_ms"))


def edited_lines(spark, sf_dir):
    """Cues after edits; those with the state `edited` stand in for the edits."""
    x = _edit_base(spark, sf_dir)
    e = x.where("status = 'edited'").select("job_id", "cue_id", F.when(F.col("cue_id") % 2 == 0, F.concat(F.lit(" "), "source")).alias("new_source"), F.when(F.col("cue_id") % 3 == 0, F.concat("english", F.lit(" "))).alias("new_english"), F.when(F.col("cue_id") % 5 == 0, F.lit(7)).alias("new_speaker_id"), F.when(F.col("cue_id") % 7 == 0, F.concat(F.lit("N"), (F.col("cue_id") % 10).cast("string"))).alias("new_name"))
    got = gates.apply_edits(x, e, ["job_id", "cue_id"], ["job_id", "speaker_id"])
    return got.select("job_id", "cue_id", "source", "english", F.col("speaker_id").cast("bigint").alias("speaker_id"), "speaker_name", "status", F.col("adaptation_confidence").isNotNull().alias("still_adapted"))


def _edit_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("job_id", "cue_id").orderBy("l_start", "l_end", "speaker_id", "speaker_name", "source", "english", "status")
    x = cues(spark, sf_dir, "speaker_id", "speaker_name", "source", "english", "status", "transcription_confidence", "speaker_confidence").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return x.select("job_id", "cue_id", "speaker_id", "speaker_name", "source", "english", "status", "speaker_confidence", F.col("transcription_confidence").alias("adaptation_confidence"))


def cached_artefacts(spark, sf_dir):
    """The newest artefact of each user of the kind that is expected; events stand in."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return gates.cached(e, ["user_id"], "event_type", F.lit("purchase"), "ts").select("user_id", "event_id")


def takes_as_of(spark, sf_dir):
    """The take that was current in the middle of the month; events stand in for takes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return gates.as_of(e, ["user_id"], "ts", F.lit("2024-01-15").cast("timestamp_ntz"), ["event_id"]).select("user_id", "event_id", "event_type")


def visual_reassignment(spark, sf_dir):
    """Cues given to the voice their active face belongs to: anchors weigh sight by hearing; only doubtful or clearly less certain voices change."""
    x = _seen(spark, sf_dir)
    vote = x.where("face is not null and vis >= 0.70 and sc >= 0.75 and speaker_id is not null")
    w = vote.groupBy("job_id", "face", "speaker_id").agg(F.sum(F.floor(F.col("vis") * F.col("sc") * 1_000_000 + 0.5).cast("bigint")).alias("w"))
    top = w.groupBy("job_id", "face").agg(F.sum("w").alias("total"), F.max(F.struct("w", -F.col("speaker_id"))).alias("m")).where("m.w * 10 >= total * 6 and total > 0")
    anchors = top.select("job_id", "face", (-F.col("m.col2")).alias("anchor"), (F.col("m.w") / F.col("total")).alias("share"))
    moved = x.join(anchors, ["job_id", "face"]).where("vis >= 0.72 and (coalesce(sc, 0e0) < 0.62 or vis > coalesce(sc, 0e0) + 0.15e0)")
    return moved.select("job_id", "cue_id", F.col("anchor").cast("bigint").alias("speaker_id"), milli(0.6 * F.col("vis") + 0.4 * F.col("share")).alias("confidence_milli"))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with the surest sighting of their voice within the same ten seconds: face, vis, mouth."""
    s = table(spark, sf_dir, "face_sightings").where("job_id is not null and speaker_id > 0 and active_face_id is not null and at_s is not null and not isnan(at_s) and active_speaker_confidence is not null and not isnan(active_speaker_confidence)")
    s = s.groupBy("job_id", "speaker_id", F.floor(F.col("at_s") / 10).alias("slot")).agg(F.max(F.struct("active_speaker_confidence", "active_face_id", F.coalesce("mouth_visible", F.lit(False)).alias("mouth"))).alias("m"))
    x = _confident(spark, sf_dir).withColumn("slot", F.floor(F.floor(F.col("l_start") / 1000) / 10))
    return x.join(s, ["job_id", "speaker_id", "slot"], "left").select("job_id", "cue_id", "l_start", "l_end", "speaker_id", "sc", F.col("m.active_face_id").alias("face"), F.col("m.active_speaker_confidence").alias("vis"), F.coalesce("m.mouth", F.lit(False)).alias("mouth"))


QUERIES = {
    f.__name__: f
    for f in [
        review_reasons, review_summary, media_failures, take_failures, second_reading_disputes, judged_verdicts, semantic_scores, revised_lines, directional_rewrites, offered_wordings, scraped_fields, duration_factors, job_options, public_jobs,
        sidecar_choice, effects_stream, prompt_lines, stored_or_parsed, parsed_media_names, folder_names, applied_candidate, alignment_of_groups, prompt_batches, edited_lines, cached_artefacts, takes_as_of, visual_reassignment,
    ]
}

_D = "cast({0} as double)"
_LINE = [
    *[(f"missing {k}", f"{k} is null") for k in gates.LINE_MEASURES + gates.TAKE_MEASURES],
    ("verdict missing", "not coalesce(verdict_available, false)"), ("verdict failed", "verdict_available and not coalesce(verdict_passed, false)"), ("overlap kept", "overlapping and overlap_kept"), ("overlap unresolved", "overlapping and not overlap_kept"),
    ("stretched", "abs(coalesce(stretch_percent, 999)) > case when mouth_visible then 5 else 8 end"), ("timing failed", "timing_pass = false"), ("dead air", "coalesce(padding_ms, 0) > 160"), ("cut off", "coalesce(truncated_ms, 0) > 40"),
    ("words differ", f"coalesce(word_similarity, 0) < {_D.format(.72)} or (coalesce(wer, 1) > {_D.format(.4)} and coalesce(cer, 1) > {_D.format(.35)})"), ("speaker uncertain", "coalesce(speaker_confidence, 0) < 0.5"), ("reference weak", f"coalesce(reference_quality, 0) < {_D.format(.3)}"),
    ("timing uncertain", "coalesce(timing_confidence, 0) < 0.5"), ("transcription uncertain", f"coalesce(transcription_confidence, 0) < {_D.format(.55)}"), ("adaptation uncertain", f"coalesce(adaptation_confidence, 0) < {_D.format(.45)}"),
    ("voice not compared", f"active_seconds >= {_D.format(.8)} and voice_similarity is null"), ("voice differs", f"coalesce(voice_similarity, 0) < {_D.format(.55)} and voice_reliable"), ("reduced cloning", "fallback_engine and not full_clone"), ("alignment uncertain", f"coalesce(alignment_confidence, 0) < {_D.format(.55)}"),
    ("original audible", f"coalesce(leakage, 0) > {_D.format(.28)}"), ("not made", "not made"), ("emphasis differs", f"made and seconds >= 1 and contour_similarity < {_D.format(.15)}"), ("pauses differ", f"made and seconds >= {_D.format(1.2)} and pause_delta > {_D.format(.48)}"),
    ("pitch differs", "made and seconds >= 1 and pitch_delta > 3.5"), ("clipped", f"made and peak >= {_D.format(.995)}"), ("silent", f"made and coalesce(active_ratio, 0) < {_D.format(.08)}"),
]
_FILE = [
    ("no video", "l_linenumber % 7 < 1"), ("length off", "abs(l_partkey - l_suppkey * 20) > 250"), ("original_audio lost", "l_partkey % 3 = 0"), ("original_subtitles lost", "l_partkey % 5 = 0"), ("streams lost", "l_suppkey % 4 = 0"), ("chapters lost", "l_suppkey % 6 = 0"), ("metadata lost", "l_returnflag = 'R'"),
    ("no lossless English", "l_linestatus <> 'F'"), ("English not default", "l_returnflag <> 'A'"), ("loudness not measured", "l_linenumber = 3 or l_tax <= 0"), ("peak too high", f"l_linenumber <> 3 and l_tax > 0 and -l_tax * 20 > -1.0 + {_D.format(.2)}"),
    ("loudness off target", "l_linenumber <> 3 and l_tax > 0 and abs(-l_quantity + 24) > 1.5"), ("dialogue off target", f"l_discount > {_D.format(.05)} and (l_discount >= {_D.format(.09)} or abs(-27 + l_discount * 10 + 27) > 0.75)"),
]
_CASES = lambda pairs: _LIST.format(", ".join(f"case when {c} then '{n}' end" for n, c in pairs))
_MW = f"{_WITH}, m as (select job_id, cue_id, {_MEASURED} from x)"
_REASONED = f"{_MW}, r as (select job_id, cue_id, {_CASES(_LINE)} as reasons, cast({' + '.join(f'case when {c} then 1 else 0 end' for _, c in _LINE)} as bigint) as n from m)"
_FAILS = {
    "timing": "not coalesce(timing_pass, false) or coalesce(padding_ms, 0) > 160 or coalesce(truncated_ms, 0) > 40", "words": f"coalesce(word_similarity, 0) < {_D.format(.58)}",
    "performance": f"seconds >= 1 and has_source_performance and (coalesce(performance, 1) < {_D.format(.55)} or coalesce(pitch_delta, 0) > 3.5)",
    "fallback": f"(coalesce(word_similarity, 0) < {_D.format(.8)} and attempts >= 2) or (coalesce(voice_similarity, 0) < {_D.format(.55)} and active_seconds >= {_D.format(.8)}) or (coalesce(performance, 1) < {_D.format(.45)} and seconds >= 1)",
}
_RELIABLE = f"coalesce(coalesce(tc, 0) >= {_D.format(.55)} and coalesce(ac, 0) >= {_D.format(.85)} and coalesce(1 - sc, 0) < 0.25 and trim(english) <> '', false)"
_SCORED = f"z as (select *, case when tc * 130 > 1 then tc * 130 / 100 else tc * 130 end as a, case when ac + {_D.format(.2)} > 1 then (ac + {_D.format(.2)}) / 100 else ac + {_D.format(.2)} end as b, sc as c, {_RELIABLE} as rel from x), s as (select *, coalesce(a is not null and b is not null and c is not null and (a > 0 or b > 0 or c > 0), false) as reported from z)"
_SEEN = f"""{_WITH}, q as (select job_id, speaker_id, cast(floor(at_s / 10) as bigint) as slot, max({{'v': active_speaker_confidence, 'f': active_face_id, 'm': coalesce(mouth_visible, false)}}) as m from face_sightings
  where job_id is not null and speaker_id > 0 and active_face_id is not null and at_s is not null and not isnan(at_s) and active_speaker_confidence is not null and not isnan(active_speaker_confidence) group by 1, 2, 3),
v as (select x.job_id, x.cue_id, x.speaker_id, x.sc, q.m.f as face, q.m.v as vis from x left join q on q.job_id = x.job_id and q.speaker_id = x.speaker_id and q.slot = x.l_start // 1000 // 10)"""
_ONE = "row_number() over (partition by job_id, cue_id order by l_start, l_end, speaker_id nulls first, speaker_name nulls first, source nulls first, english nulls first, status nulls first) as rn"
SQL = {
    "review_reasons": f"{_REASONED} select * from r",
    "review_summary": f"{_REASONED}, g as (select job_id, count(*) as cues, count(*) filter (where n > 0) as flagged from r group by 1) select *, cues - flagged as passed from g",
    "media_failures": f"with y as (select {_CASES(_FILE)} as failures from lineitem) select failures, count(*) as files from y group by 1",
    "take_failures": f"{_MW}, y as (select job_id, cue_id, concat_ws(',', {', '.join(f'case when {c} then {chr(39)}{n}{chr(39)} end' for n, c in _FAILS.items())}) as why from m) select * from y where why <> ''",
    "judged_verdicts": f"""{_WITH}, {_SCORED} select job_id, cue_id, case when reported then tc is not null and (rel or cue_id % 2 = 0) and not coalesce(status = 'review', false) and round(a, 3) >= {_D.format(.78)} and round(b, 3) >= {_D.format(.85)} else tc is not null and (rel or cue_id % 2 = 0) and not coalesce(status = 'review', false) end as passed,
case when reported then 'findings and scores' else 'findings' end as basis, case when rel then 'second reading' else 'blind translation' end as reference, reported from s""",
    "semantic_scores": f"{_WITH}, z as (select job_id, cue_id, case when tc * 100 > 1 then tc * 100 / 100 else tc * 100 end as a, case when ac > 1 then ac / 100 else ac end as b, cue_id % 9 <> 0 as c from x) select job_id, cue_id, {_M.format('coalesce(a, 0)')} as adequacy_milli, {_M.format('coalesce(b, 0)')} as names_milli, coalesce(a is not null and b is not null and c and (a > 0 or b > 0), false) as reported from z",
    "revised_lines": f"{_WITH}, y as (select job_id, cue_id, source, case when regexp_matches(english, '[^\\s\\x{{a0}}\\x{{3000}}]') and not coalesce(regexp_matches(english, '(?i)([0-9]|[$£€¥]|\\byen\\b|\\btickets?\\b|\\badmission\\b|\\s[-–—]\\s)') and len(regexp_split_to_array(trim(source), '\\s+')) <= 2, false) then english end as s from x) select job_id, cue_id, s is not null as was_supplied, coalesce(s, source, '') as english, coalesce(s, source, '') as literal_translation, coalesce(s, source, '') as adapted_dialogue, "
    + ", ".join(f"cast(null as varchar) as {c}" for c in gates.DEPENDENTS) + ", false as force_adaptation from y",
    "directional_rewrites": f"""with y as (select l_orderkey, l_linenumber, {_M.format(f"{_D.format(.65)} * (1 - l_discount) + {_D.format(.2)} * (1 - l_tax) + {_D.format(.15)} * (1 - least(cast(1 as double), abs(l_quantity - 20) / 20))")} as score from lineitem where case when l_linestatus = 'F' then l_quantity < 22.5 else l_quantity > 27 end and l_returnflag <> 'N'),
r as (select *, row_number() over (partition by l_orderkey order by score desc, l_linenumber desc) as rn from y) select l_orderkey, l_linenumber, score from r where rn = 1""",
    "duration_factors": f"with {sql_cues('english')} select job_id, cue_id, {_M.format(f'least({_D.format(1.16)}, greatest({_D.format(.86)}, greatest({_D.format(.35)}, len(regexp_extract_all(english, $$[A-Za-z0-9_' + chr(39) + f']+$$)) / {_D.format(3.39)} + {_D.format(.06)} * (length(english) - length(replace(english, $$,$$, $$$$))) + {_D.format(.08)} * (length(english) - length(replace(english, $$.$$, $$$$)))) * 1000 / (l_end - l_start)))')} as factor_milli from c where english is not null",
    "job_options": "select distinct job_id, case when lower(trim(media_kind)) in ('movie', 'tv') then lower(trim(media_kind)) else 'auto' end as kind, case when lower(trim(control)) in ('pause', 'cancel') then lower(trim(control)) else 'run' end as run, cast(trunc(least(8, greatest(1, case when progress is null or isnan(progress) then 4 else progress end))) as integer) as batch, cast(trunc(least(12, greatest(1, case when duration_s is null or isnan(duration_s) then 4 else duration_s end))) as integer) as threads from jobs where job_id is not null",
    "public_jobs": """with r as (select *, row_number() over (partition by job_id order by updated_at desc nulls last, status nulls first, stage nulls first, filename nulls first) as rn from jobs where job_id is not null), d as (select *, cast(round_even(case when not isnan(duration_s) then duration_s end, 0) as bigint) as s from r where rn = 1)
select job_id, filename, status, cast(s // 3600 as varchar) || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') as length,
case lower(source_language) """ + " ".join(f"when '{k}' then '{v}' when '{v}' then '{v}'" for k, v in replies.LANGUAGE_CODES.items()) + """ end as code, case lower(source_language) when 'english' then 'EN' when 'chinese' then 'ZH' when 'japanese' then 'JA' when 'spanish' then 'ES' when 'arabic' then 'AR' else 'EN' end as target from d""",
    "sidecar_choice": r"""with s as (select distinct job_id, source || ['.srt', '.sub', '.en.ass', '.forced.srt', '.full.vtt'][cast(name_id % 5 + 1 as integer)] as name from media_names where source is not null and job_id is not null), l as (select *, lower(regexp_replace(name, '\.[^.]*$', '')) as low, lower(regexp_extract(name, '(\.[^.]*)$', 1)) as ext from s),
k as (select job_id, name, low, case ext when '.srt' then 0 when '.vtt' then 1 when '.ass' then 2 when '.ssa' then 3 when '.sub' then 4 else 8 end as priority from l),
r as (select *, row_number() over (partition by job_id order by regexp_matches(low, 'forced|signs|songs|commentary|director|trivia'), not regexp_matches(low, 'full|complete|dialogue'), not regexp_matches(low, '(^|[._ -])eng?($|[._ -])|english'), priority, lower(name), name) as rn from k) select job_id, name, priority from r where rn = 1""",
    "effects_stream": "select job_id, min(line_id) as line_id from transcript_lines where job_id is not null and (contains(lower(source), 'm&e') or contains(lower(source), 'music') or contains(lower(source), 'door') or contains(lower(source), 'dme') or contains(lower(source), 'clean effects')) group by 1",
    "prompt_lines": f"with {sql_cues('source', 'english', 'speaker_name')} select job_id, cue_id, concat_ws(' ', cast(row_number() over (partition by job_id order by l_start, cue_id) as varchar) || '.', coalesce(speaker_name, 'Unknown') || ':', case when cue_id % 4 = 0 and english <> source then '[readings: ' || source || ' / ' || english || ']' else source end, '=> ' || english) as line from c where source is not null",
    "applied_candidate": """with n as (select distinct name_id, title, normalized_title, media_year, media_type from media_names where normalized_title <> ''), k as (select catalogue_id, title as c_title, media_year as c_year, media_type as kind, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) as k from catalogue),
c as (select *, row_number() over (partition by k, kind order by catalogue_id) as rn from k) select name_id, coalesce(title, c_title) as title, coalesce(n.media_year, c_year) as year, catalogue_id as external_id from n join c on normalized_title = k and n.media_type = c.kind and rn = 1""",
    "alignment_of_groups": f"""with {sql_cues('speaker_id')}, d as (select job_id, speaker_id, l_end - l_start as d, greatest(0, l_start - lag(l_end) over (partition by job_id, speaker_id order by l_start, cue_id)) as g, lag(l_end) over (partition by job_id, speaker_id order by l_start, cue_id) is not null as has from c where speaker_id > 0),
g as (select job_id, speaker_id, avg(case when d between 25 and 1800 then 1.0e0 else 0 end) as share, coalesce(sum(case when has and g > 1200 then 1.0e0 else 0 end) / nullif(sum(case when has then 1 else 0 end), 0), 0) as gaps from d group by 1, 2), a as (select *, 0.5e0 * 0.9e0 + 0.32e0 * share + 0.18e0 * (1 - gaps) as a from g)
select job_id, speaker_id, {_M.format('a')} as alignment_milli, {_M.format('0.55e0 + 0.35e0 * a')} as transcription_milli from a""",
    "edited_lines": f"""with {sql_cues('speaker_id', 'speaker_name', 'source', 'english', 'status', 'transcription_confidence', 'speaker_confidence')}, o as (select *, {_ONE} from c), x as (select * from o where rn = 1), e as (select *, case when status = 'edited' and cue_id % 2 = 0 then trim(source) end as ns, case when status = 'edited' and cue_id % 3 = 0 then trim(english) end as ne, case when status = 'edited' and cue_id % 5 = 0 then 7 end as ni, case when status = 'edited' and cue_id % 7 = 0 then 'N' || cast(cue_id % 10 as varchar) end as nn from x),
n as (select job_id, speaker_id, min(nn) as nn from e where nn is not null group by 1, 2) select e.job_id, cue_id, coalesce(ns, source) as source, coalesce(ne, english) as english, cast(coalesce(ni, e.speaker_id) as bigint) as speaker_id, coalesce(n.nn, speaker_name) as speaker_name, case when status = 'edited' then 'edited' else status end as status, ns is null and ne is null and transcription_confidence is not null as still_adapted from e left join n on e.job_id = n.job_id and e.speaker_id = n.speaker_id""",
    "cached_artefacts": "with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id) as rn from events where event_type = 'purchase') select user_id, event_id from r where rn = 1",
    "takes_as_of": "with r as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where ts <= timestamp '2024-01-15') select user_id, event_id, event_type from r where rn = 1",
    "visual_reassignment": f"""{_SEEN}, w as (select job_id, face, speaker_id, sum(cast(floor(vis * sc * 1000000 + 0.5) as bigint)) as w from v where face is not null and vis >= 0.70 and sc >= 0.75 and speaker_id is not null group by 1, 2, 3),
t as (select job_id, face, speaker_id, w, sum(w) over (partition by job_id, face) as total, row_number() over (partition by job_id, face order by w desc, speaker_id) as rn from w), a as (select * from t where rn = 1 and w * 10 >= total * 6 and total > 0)
select v.job_id, v.cue_id, cast(a.speaker_id as bigint) as speaker_id, {_M.format('0.6e0 * vis + 0.4e0 * (cast(w as double) / total)')} as confidence_milli from v join a on v.job_id = a.job_id and v.face = a.face where vis >= 0.72 and (coalesce(sc, 0) < 0.62 or vis > coalesce(sc, 0) + 0.15e0)""",
}
