"""Complete rule sets of lines and files, gates over evidence, and what an edit takes back.

Every site has its own value for what is missing (see rules.or_else): here it stands in the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cuemill.functions.text import comparable, sequence_ratio
from cuemill.operators.rules import missing, or_else

#: Measures that every line and every take must have, in the order in which they are told (fixed values).
LINE_MEASURES = ["speaker_confidence", "reference_quality", "timing_confidence", "transcription_confidence", "adaptation_confidence", "alignment_confidence"]
TAKE_MEASURES = ["stretch_percent", "timing_pass", "padding_ms", "truncated_ms", "word_similarity", "wer", "cer", "backtranscription"]
#: What was made of a line's old text (fixed values).
DEPENDENTS = [
    "faithful_translation", "translation_model", "translation_candidates", "candidate_semantic_scores", "adaptation_confidence", "adaptation_attempts", "adaptation_model", "adaptation_scoring", "translation_qc", "translation_qc_feedback",
    "force_translation_correction", "asr_second_opinion", "translation_correction_attempts",
]


def _yes(x: Column) -> Column:
    return F.coalesce(x.cast("boolean"), F.lit(False))


def line_rules(m: dict[str, Column]) -> list[tuple[str, Column]]:
    """Why a dubbed line needs a review: 14 measures that must be there, the verdict on its translation, and the limits of each measure, in order."""
    gone = lambda k: missing(m[k]) if k not in ("timing_pass", "backtranscription") else m[k].isNull()
    low = lambda k, least: or_else(m[k], 0.0) < least
    made, seconds = _yes(m["made"]), or_else(m["seconds"], 0.0)
    limit = F.when(_yes(m["mouth_visible"]), 5.0).otherwise(8.0)
    return [
        *[(f"missing {k}", gone(k)) for k in LINE_MEASURES + TAKE_MEASURES],
        ("verdict missing", ~_yes(m["verdict_available"])), ("verdict failed", _yes(m["verdict_available"]) & ~_yes(m["verdict_passed"])),
        ("overlap kept", _yes(m["overlapping"]) & _yes(m["overlap_kept"])), ("overlap unresolved", _yes(m["overlapping"]) & ~_yes(m["overlap_kept"])),
        ("stretched", F.abs(or_else(m["stretch_percent"], 999.0)) > limit), ("timing failed", ~F.coalesce(m["timing_pass"], F.lit(True))),
        ("dead air", or_else(m["padding_ms"], 0.0) > 160), ("cut off", or_else(m["truncated_ms"], 0.0) > 40),
        ("words differ", low("word_similarity", 0.72) | ((or_else(m["wer"], 1.0) > 0.4) & (or_else(m["cer"], 1.0) > 0.35))),
        ("speaker uncertain", low("speaker_confidence", 0.5)), ("reference weak", low("reference_quality", 0.30)), ("timing uncertain", low("timing_confidence", 0.5)),
        ("transcription uncertain", low("transcription_confidence", 0.55)), ("adaptation uncertain", low("adaptation_confidence", 0.45)),
        ("voice not compared", (or_else(m["active_seconds"], 0.0) >= 0.8) & missing(m["voice_similarity"])), ("voice differs", low("voice_similarity", 0.55) & _yes(m["voice_reliable"])),
        ("reduced cloning", _yes(m["fallback_engine"]) & ~_yes(m["full_clone"])), ("alignment uncertain", low("alignment_confidence", 0.55)),
        ("original audible", or_else(m["leakage"], 0.0) > 0.28), ("not made", ~made),
        ("emphasis differs", made & (seconds >= 1.0) & (or_else(m["contour_similarity"], 1.0) < 0.15)), ("pauses differ", made & (seconds >= 1.2) & (or_else(m["pause_delta"], 0.0) > 0.48)),
        ("pitch differs", made & (seconds >= 1.0) & (or_else(m["pitch_delta"], 0.0) > 3.5)), ("clipped", made & (or_else(m["peak"], 0.0) >= 0.995)), ("silent", made & (or_else(m["active_ratio"], 0.0) < 0.08)),
    ]


def file_rules(m: dict[str, Column]) -> list[tuple[str, Column]]:
    """Why a finished file fails: its tracks, length, what must be preserved, and loudness against its targets."""
    inf = F.lit(float("inf"))
    kept = [f"{k} lost" for k in ("original_audio", "original_subtitles", "streams", "chapters", "metadata")]
    lufs, peak = m["lufs"].cast("double"), m["peak"].cast("double")
    told = lufs.isNotNull() & peak.isNotNull()
    finite = told & ~F.isnan(lufs) & ~F.isnan(peak) & (F.abs(lufs) < inf) & (F.abs(peak) < inf)
    return [
        ("no video", _yes(m["source_has_video"]) & (F.coalesce(m["video_tracks"], F.lit(0)) < 1)), ("length off", or_else(m["duration_error_ms"], float("inf")) > 250),
        *[(name, ~_yes(m[name.removesuffix(" lost")])) for name in kept],
        ("no lossless English", ~_yes(m["english_lossless"])), ("English not default", ~_yes(m["english_default"])),
        ("loudness not measured", ~told), ("loudness invalid", told & ~finite), ("peak too high", finite & (peak > m["peak_target"] + 0.2)), ("loudness off target", finite & (F.abs(lufs - m["lufs_target"]) > 1.5)),
        ("dialogue off target", m["dialogue_target"].isNotNull() & (F.coalesce(F.abs(m["dialogue_lufs"] - m["dialogue_target"]), inf) > 0.75)),
    ]


def failed_takes(m: dict[str, Column]) -> Column:
    """ARRAY<STRING> of timing, words, performance and fallback: why a take is made again, each with its own value for what is missing."""
    timing = ~_yes(m["timing_pass"]) | (or_else(m["padding_ms"], 0.0) > 160) | (or_else(m["truncated_ms"], 0.0) > 40)
    words = or_else(m["word_similarity"], 0.0) < 0.58
    long = or_else(m["seconds"], 0.0) >= 1.0
    performed = long & _yes(m["has_source_performance"]) & ((or_else(m["performance"], 1.0) < 0.55) | (or_else(m["pitch_delta"], 0.0) > 3.5))
    fallback = ((or_else(m["word_similarity"], 0.0) < 0.8) & (F.coalesce(m["attempts"], F.lit(0)) >= 2)) | ((or_else(m["voice_similarity"], 0.0) < 0.55) & (or_else(m["active_seconds"], 0.0) >= 0.8)) | ((or_else(m["performance"], 1.0) < 0.45) & long)
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in (("timing", timing), ("words", words), ("performance", performed), ("fallback", fallback))]), lambda x: x.isNotNull())


def disputed(primary: Column, second: Column, confidence: Column, word_confidence: Column, no_speech: Column, known: Column) -> Column:
    """struct(agreement, disputed, confidence): a usable second reading that says something else bounds the confidence of the first; a true 0 of no_speech counts."""
    a, b = comparable(primary), comparable(second)
    agreement = F.when((F.length(a) > 0) & (F.length(b) > 0), sequence_ratio(a, b)).otherwise(F.lit(0.0))
    usable = (or_else(confidence, 0.0) >= 0.5) & (or_else(word_confidence, 0.0) >= 0.7) & (or_else(no_speech, 1.0) < 0.35)
    against = second.isNotNull() & usable & (agreement < 0.995)
    return F.struct(agreement.alias("agreement"), against.alias("disputed"), F.when(against, F.least(or_else(known, 1.0), F.when(agreement < 0.5, 0.5).otherwise(0.7))).otherwise(known.cast("double")).alias("confidence"))


def reference_reading(second: Column, blind: Column, confidence: Column, word_confidence: Column, no_speech: Column, blind_complete: Column) -> Column:
    """struct(text, basis, complete): what a translation is judged against: a reliable second reading's English, else a blind translation."""
    reliable = (or_else(confidence, 0.0) >= 0.55) & (or_else(word_confidence, 0.0) >= 0.85) & (or_else(no_speech, 0.0) < 0.25) & F.coalesce(F.trim(second) != "", F.lit(False))
    return F.struct(F.when(reliable, second).otherwise(F.coalesce(blind, F.lit(""))).alias("text"), F.when(reliable, "second reading").otherwise("blind translation").alias("basis"), (reliable | _yes(blind_complete)).alias("complete"))


def verdict(evidence: Column, contradiction: Column, scores: Column) -> Column:
    """struct(passed, basis) from findings and replies.judged_scores."""
    findings = _yes(evidence) & ~_yes(contradiction)
    return F.struct(F.when(scores["reported"], findings & (F.round(scores["adequacy"], 3) >= 0.78) & (F.round(scores["names"], 3) >= 0.85)).otherwise(findings).alias("passed"), F.when(scores["reported"], "findings and scores").otherwise("findings").alias("basis"))


def directional(offers: DataFrame, group: str, order: str, pace: Column, faithful: Column, target: Column, too_long: Column, adequacy: Column, terms: Column, names_kept: Column) -> DataFrame:
    """group, order, score: of wordings that go the way that is needed (under .90 of the faithful pace, or over 1.08) and keep meaning, terms and names, the best."""
    right_way = F.when(too_long, pace < faithful * 0.90).otherwise(pace > faithful * 1.08)
    fit = 1 - F.least(F.lit(1.0), F.abs(pace - target) / target)
    score = 0.65 * adequacy + 0.2 * terms + 0.15 * fit
    good = offers.where(right_way & (adequacy >= 0.65) & (terms >= 0.65) & names_kept)
    return good.select(group, order, F.floor(score * 1000 + 0.5).cast("bigint").alias("score")).groupBy(group).agg(F.max(F.struct("score", order)).alias("m")).select(group, f"m.{order}", "m.score")


def alignment_confidence(words: DataFrame, group: list[str], start: str, end: str, order: list[str], validity: float = 1.0) -> DataFrame:
    """group, alignment, transcription: half for validity, .32 for words of a plausible length, .18 for few long gaps (over 1.2 s)."""
    w = Window.partitionBy(*group).orderBy(*order)
    rows = words.select(*group, (F.col(end) - F.col(start)).alias("_d"), F.when(F.lag(end).over(w).isNotNull(), F.greatest(F.lit(0), F.col(start) - F.lag(end).over(w))).alias("_g"))
    share = F.avg(F.col("_d").between(25, 1800).cast("double"))
    gaps = F.coalesce(F.count_if(F.col("_g") > 1200) / F.nullif(F.count("_g"), F.lit(0)), F.lit(0.0))
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * validity + 0.32 * share + 0.18 * (1 - F.least(F.lit(1.0), gaps))))
    return rows.groupBy(*group).agg(a.alias("alignment")).withColumn("transcription", 0.55 + 0.35 * F.col("alignment"))


def agreed_windows(primary: DataFrame, higher: DataFrame, group: list[str], text: str, alignment: str, order: list[str]) -> DataFrame:
    """Rows (group, order, side, agreement, confidence) of one whole side of each window that both have read.

    The higher model's side is taken if it is aligned better by .03, or no worse than by .05 where both agree to .72;
    agreement is that of the texts' letters and digits in order. Windows of one side alone are left out: they stay as they are.
    """
    packed = lambda df, p: df.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("t")))), lambda r: r["t"]), "").alias(f"{p}_t"), F.avg(F.coalesce(alignment, F.lit(0.0))).alias(f"{p}_a"))
    both = packed(primary, "p").join(packed(higher, "h"), group).withColumn("agreement", F.coalesce(sequence_ratio(comparable("p_t"), comparable("h_t")), F.lit(0.0)))
    take = (F.col("h_a") >= F.col("p_a") + 0.03) | ((F.col("agreement") >= 0.72) & (F.col("h_a") >= F.col("p_a") - 0.05))
    chosen = both.select(*group, "agreement", F.when(take, "higher").otherwise("primary").alias("side"))
    rows = primary.select(*group, *order, F.col(alignment).alias("_a"), F.lit("primary").alias("side")).unionByName(higher.select(*group, *order, F.col(alignment).alias("_a"), F.lit("higher").alias("side")))
    return rows.join(chosen, [*group, "side"]).select(*group, *order, "side", "agreement", F.least(F.lit(1.0), 0.46 * F.coalesce("_a", F.lit(0.0)) + 0.34 * F.col("agreement") + 0.20 * 0.92).alias("confidence"))


def running_batches(rows: DataFrame, group: str, order: list[str], size: str, items: int, total: int) -> DataFrame:
    """rows with batch_no: a new batch where one has `items` rows or would exceed `total`; the fold carries two numbers over the rows as they come in order, so a group may be of any length."""
    others = [c for c in rows.columns if c not in (group, size, *order)]

    def numbered(batches):
        import pyarrow as pa

        last, no, n, t = object(), 0, 0, 0
        for b in batches:
            out = []
            for g, z in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if g != last and not (g != g and last != last):  # NaN is one group
                    last, no, n, t = g, 0, 0, 0
                known = t is not None and z is not None
                if n and (n >= items or (known and t + z > total)):
                    no, n, t = no + 1, 1, z
                else:
                    n, t = n + 1, t + z if known else None
                out.append(no)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "batch_no"])

    placed = rows.select(group, *order, *others, size).repartition(group).sortWithinPartitions(group, *order, size, *others)
    return placed.mapInArrow(numbered, StructType([*placed.schema.fields, StructField("batch_no", LongType())]))


def apply_edits(lines: DataFrame, edits: DataFrame, key: list[str], group: list[str]) -> DataFrame:
    """lines (key, group, source, english, speaker_name, dependents...) after edits (key, new_source, new_english, new_speaker_id, new_name; null: not edited).

    A new source takes back what was made of it, a new English line what judged it; a name goes to every line of the
    voice in its group, the smallest of several. At most one edit a key.
    """
    taken = lines.join(edits, key, "left")
    names = edits.where("new_name is not null").join(lines.select(*key, *[c for c in group if c not in key]), key).groupBy(*group).agg(F.min(F.trim("new_name")).alias("_name"))
    out = taken.join(names, group, "left")
    edited = F.coalesce(F.col("new_source"), F.col("new_english"), F.col("new_name")).isNotNull() | F.col("new_speaker_id").isNotNull()
    return out.withColumns({
        "adaptation_confidence": F.when(F.col("new_source").isNull() & F.col("new_english").isNull(), F.col("adaptation_confidence")),
        "source": F.coalesce(F.trim("new_source"), "source"), "english": F.coalesce(F.trim("new_english"), "english"), "speaker_name": F.coalesce("_name", "speaker_name"),
        "speaker_confidence": F.when(F.col("new_speaker_id").isNotNull(), 1.0).otherwise(F.col("speaker_confidence")), "speaker_id": F.coalesce("new_speaker_id", "speaker_id"), "status": F.when(edited, "edited").otherwise(F.col("status")),
    }).drop("new_source", "new_english", "new_name", "new_speaker_id", "_name")


def cached(entries: DataFrame, key: list[str], version: str, expected: Column, at: str) -> DataFrame:
    """The newest entry of each key whose version is the one expected; others are as if they weren't there."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), *[F.col(c) for c in entries.columns if c not in key and c != at])
    return entries.where(F.col(version) == expected).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def as_of(history: DataFrame, key: list[str], at: str, moment: Column, tie: list[str]) -> DataFrame:
    """The state of each key at a moment: its last version by then; keys without one are left out."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), *[F.desc(t) for t in tie])
    return history.where(F.col(at) <= moment).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
