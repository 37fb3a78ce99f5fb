"""Text functions, edit distances, exports and parsing over cues, documents, jobs and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import text as t
from cuemill.operators.overlap import milli
from cuemill.plans.tables import cues, sql_cues
from cuemill.session import table
from cuemill.sinks import exports

TERMS = {"compass": "kum-pass", "old factory": "mill", "factory": "works"}
_M = "cast(floor(({0}) * 1000 + 0.5) as bigint)"


def digit_word_normalise(spark, sf_dir):
    return cues(spark, sf_dir, "english").where("english is not null").select("job_id", "cue_id", t.spoken_words(F.col("english")).alias("words"))


def char_error_rate(spark, sf_dir):
    """Letters of a translation that differ from the line it translates, blanks aside, by the line's length."""
    c = cues(spark, sf_dir, "source", "english").where("source is not null and english is not null")
    a, b = F.replace(F.lower("source"), F.lit(" "), F.lit("")), F.replace(F.lower("english"), F.lit(" "), F.lit(""))
    return c.select("job_id", "cue_id", F.levenshtein(a, b).cast("bigint").alias("distance"), milli(F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1))).alias("cer_milli"))


def token_error_rate(spark, sf_dir):
    """As char_error_rate over words; also the ratio of matching blocks. Python both."""
    c = cues(spark, sf_dir, "source", "english").where("source is not null and english is not null")
    a, b = F.lower("source"), F.lower("english")
    return c.select("job_id", "cue_id", t.word_distance(a, b).alias("distance"), milli(t.sequence_ratio(a, b)).alias("ratio_milli"))


def comparable_transcript(spark, sf_dir):
    return cues(spark, sf_dir, "source").where("source is not null").select("job_id", "cue_id", t.comparable("source").alias("key"))


def token_jaccard_match(spark, sf_dir):
    """Shared share of the words of a title and an original title."""
    w = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    c = table(spark, sf_dir, "catalogue")
    return c.select("catalogue_id", milli(F.size(F.array_intersect(w("title"), w("original_title"))) / F.size(F.array_union(w("title"), w("original_title")))).alias("jaccard_milli"))


def pace_and_word_budget(spark, sf_dir):
    c = cues(spark, sf_dir, "english").where("english is not null")
    seconds = (F.col("l_end") - F.col("l_start")) / 1000
    low, ideal, high = t.word_budget(seconds)
    est = t.estimated_seconds(F.col("english"))
    return c.select("job_id", "cue_id", milli(est).alias("estimate_ms"), low.alias("fewest"), ideal.alias("usual"), high.alias("most"), milli(est / seconds).alias("ratio_milli"), (est / seconds > 1.06).alias("hard"))


def glossary_substitution(spark, sf_dir):
    return cues(spark, sf_dir, "english").where("english is not null").select("job_id", "cue_id", t.replace_terms(F.col("english"), TERMS).alias("spoken"))


def protected_names(spark, sf_dir):
    return cues(spark, sf_dir, "english").where("english is not null").select("job_id", "cue_id", F.array_join(F.array_sort(t.names_in(F.col("english"))), " ").alias("names"))


def heuristic_emotion(spark, sf_dir):
    return cues(spark, sf_dir, "english").select("job_id", "cue_id", t.emotion(F.col("english")).alias("emotion"))


def response_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", t.response_tokens(F.length("text"), 1.2, 200, 4000).alias("tokens"))


def register_correction(spark, sf_dir):
    """Pitch shift of order lines standing in for takes."""
    got = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.register_shift(F.col("l_quantity") * 10, F.col("l_quantity") * 10 + F.col("l_linenumber") * 8 - 20, F.col("l_quantity") / 10).alias("s"))
    return got.where("s is not null").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("takes"), milli(F.max("s")).alias("most_milli"), milli(F.min("s")).alias("least_milli"))


def clean_subtitle_text(spark, sf_dir):
    """Lines of subtitle dumps without codes, and how many are left of each document."""
    d = table(spark, sf_dir, "documents").where("source = 'subtitle_dump' and text is not null")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).select("doc_id", t.clean_card(F.col("l")).alias("l")).where("l <> ''")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("l")).alias("letters"))


def looks_english(spark, sf_dir):
    """Jobs whose first 80 translated cues are mostly ASCII and hold common English words."""
    from pyspark.sql import Window

    c = cues(spark, sf_dir, "english").where("english is not null").withColumn("rn", F.row_number().over(Window.partitionBy("job_id").orderBy("l_start", "cue_id"))).where("rn <= 80")
    common = F.size(F.regexp_extract_all(F.lower("english"), F.lit(r"\b(the|you|and|that|is|to|of|it|in|we|not)\b"), F.lit(1)))
    ascii_ = F.length(F.regexp_replace("english", r"[^\x00-\x7f]", ""))
    g = c.groupBy("job_id").agg(F.sum(ascii_).alias("a"), F.sum(F.length("english")).alias("n"), F.sum(common).alias("hits"), F.sum(t.count_words(F.col("english"))).alias("words"))
    return g.select("job_id", ((F.col("a") > 0.93 * F.col("n")) & (F.col("hits") >= F.greatest(F.lit(2), F.floor(F.col("words") / 35)))).alias("english"))


def title_display_order(spark, sf_dir):
    """Normalised titles of the catalogue beside each other: keys `type:title:year`."""
    c = table(spark, sf_dir, "catalogue")
    return c.select("catalogue_id", F.concat_ws(":", F.coalesce("media_type", F.lit("")), t.normalize_title("title"), F.coalesce(F.col("media_year").cast("string"), F.lit(""))).alias("lookup_key"))


def document_projection(spark, sf_dir):
    """Fields out of JSON payloads, bad payloads as null."""
    e = table(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


def tolerant_json(spark, sf_dir):
    """The first JSON value in texts that wrap one in prose. Python."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Here you are: "), "props", F.lit(" and [that")).alias("reply"))
    return e.select("event_id", t.first_json("reply").alias("json"))


def content_signature(spark, sf_dir):
    """Hash of a version, the length and three blocks of each text."""
    d = table(spark, sf_dir, "documents").where("text is not null and length(text) > 0")
    block = lambda at: F.substring(F.col("text"), at, F.lit(64))
    mid = F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return d.select("doc_id", F.sha2(F.concat_ws("|", F.lit("v1"), F.length("text").cast("string"), block(F.lit(1)), block(mid), block(F.greatest(F.lit(1), F.length("text") - 63))), 256).alias("signature"))


def subtitle_export(spark, sf_dir):
    return exports.srt_blocks(cues(spark, sf_dir, "english").where("english is not null"), "job_id", "l_start", "l_end", "english")


def edit_list_export(spark, sf_dir):
    return exports.edit_list(cues(spark, sf_dir).select("job_id", "l_start", "l_end").distinct(), "job_id", "l_start", "l_end")


def cue_sheet_export(spark, sf_dir):
    c = cues(spark, sf_dir, "speaker_id", "english", "status")
    return c.select("job_id", "cue_id", t.clock(F.col("l_start"), ".").alias("starts"), t.clock(F.col("l_end"), ".").alias("ends"), F.when(F.col("speaker_id") > 0, F.concat(F.lit("Voice "), F.col("speaker_id").cast("string"))).otherwise("Uncertain voice").alias("voice"), F.coalesce("english", F.lit("")).alias("line"), "status")


QUERIES = {
    f.__name__: f
    for f in [
        digit_word_normalise, char_error_rate, token_error_rate, comparable_transcript, token_jaccard_match, pace_and_word_budget, glossary_substitution, protected_names, heuristic_emotion, response_budget, register_correction,
        clean_subtitle_text, looks_english, title_display_order, document_projection, tolerant_json, content_signature, subtitle_export, edit_list_export, cue_sheet_export,
    ]
}

_E = f"with {sql_cues('english')}"


def _digits(x: str) -> str:
    for d, w in enumerate(t.DIGITS):
        x = f"replace({x}, '{d}', ' {w} ')"
    return x


_WORDS = "len(regexp_extract_all(english, '[A-Za-z0-9_'']+'))"
_COUNT = "(length(english) - length(replace(english, '{0}', '')))"
_EST = f"greatest(cast(0.35 as double), {_WORDS} / cast(3.39 as double) + cast(0.06 as double) * {_COUNT.format(',')} + cast(0.08 as double) * {_COUNT.format('.')})"
_SEC = "((l_end - l_start) / 1000)"
_IDEAL = f"({_SEC} * cast(3.39 as double))"


def _hits(words: list[str]) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "least(cast(1 as double), (" + " + ".join(f"((length(lower(english)) - length(replace(lower(english), '{q}', ''))) // {len(w)})" for q, w in zip(quoted, words)) + ") * cast(0.45 as double))"


_SCORES = ", ".join(_hits(t.EMOTION_WORDS[e]) for e in t.EMOTIONS[:-1])
_CLOCK = "lpad(cast({0} // 3600000 as varchar), 2, '0') || ':' || lpad(cast({0} // 60000 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} // 1000 % 60 as varchar), 2, '0') || '{1}' || lpad(cast({0} % 1000 as varchar), 3, '0')"
_FR = "({0} * 24 // 1000)"
_TC = "lpad(cast({0} // 86400 as varchar), 2, '0') || ':' || lpad(cast({0} // 1440 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} // 24 % 60 as varchar), 2, '0') || ':' || lpad(cast({0} % 24 as varchar), 2, '0')"
_TIMES = _TC.format(_FR.format("l_start")) + " || ' ' || " + _TC.format(_FR.format("l_end"))
SQL = {
    "digit_word_normalise": f"{_E} select job_id, cue_id, array_to_string(regexp_extract_all({_digits('lower(english)')}, '[a-z'']+'), ' ') as words from c where english is not null",
    "token_jaccard_match": f"with w as (select catalogue_id, list_distinct(string_split(lower(title), ' ')) as a, list_distinct(string_split(lower(original_title), ' ')) as b from catalogue) select catalogue_id, {_M.format('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} as jaccard_milli from w",
    "pace_and_word_budget": f"{_E} select job_id, cue_id, {_M.format(_EST)} as estimate_ms, cast(greatest(1, floor({_IDEAL} * cast(0.9 as double))) as bigint) as fewest, cast(greatest(1, floor({_IDEAL} + 0.5)) as bigint) as usual, cast(greatest(1, ceil({_IDEAL} * cast(1.1 as double))) as bigint) as most, {_M.format(f'{_EST} / {_SEC}')} as ratio_milli, {_EST} / {_SEC} > cast(1.06 as double) as hard from c where english is not null",
    "glossary_substitution": f"{_E} select job_id, cue_id, regexp_replace(regexp_replace(regexp_replace(english, '\\bold factory\\b', 'mill', 'gi'), '\\bcompass\\b', 'kum-pass', 'gi'), '\\bfactory\\b', 'works', 'gi') as spoken from c where english is not null",
    "protected_names": f"{_E} select job_id, cue_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(english, '(?:^|[^\\pL''-])(\\p{{Lu}}[\\pL''-]+)', 1), lambda x: not list_contains({t.NO_NAMES!r}, x)))), ' ') as names from c where english is not null",
    "heuristic_emotion": f"{_E}, s as (select job_id, cue_id, english, [{_SCORES}] as s from c) select job_id, cue_id, case when english is null then null when list_max(s) = 0 then 'calm' else {t.EMOTIONS!r}[list_position(s, list_max(s))] end as emotion from s",
    "response_budget": "select doc_id, cast(greatest(200, least(4000, floor(length(text) / cast(3.2 as double) * cast(1.2 as double)) + 120)) as bigint) as tokens from documents where text is not null",
    "register_correction": f"with r as (select l_linenumber, l_quantity * 10 as a, l_quantity * 10 + l_linenumber * 8 - 20 as b, l_quantity / 10 as sec from lineitem), s as (select l_linenumber, 12 * log2(a / b) as s from r where a > 0 and b > 0 and sec >= 1.0) select l_linenumber, count(*) as takes, {_M.format('max(s)')} as most_milli, {_M.format('min(s)')} as least_milli from s where abs(s) between 0.6 and 3.0 group by l_linenumber",
    "looks_english": f"""{_E}, r as (select *, row_number() over (partition by job_id order by l_start, cue_id) as rn from c where english is not null),
g as (select job_id, sum(length(regexp_replace(english, '[^\\x00-\\x7f]', '', 'g'))) as a, sum(length(english)) as n, sum(len(regexp_extract_all(lower(english), '\\b(the|you|and|that|is|to|of|it|in|we|not)\\b'))) as hits, sum({_WORDS}) as words from r where rn <= 80 group by 1)
select job_id, a > cast(0.93 as double) * n and hits >= greatest(2, floor(words / 35)) as english from g""",
    "document_projection": "select event_type, count(*) as events, count(json_extract(props, '$.k')) as with_k, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as sum_k from events group by event_type",
    "content_signature": "select doc_id, sha256(concat_ws('|', 'v1', cast(length(text) as varchar), substring(text, 1, 64), substring(text, greatest(1, length(text) // 2), 64), substring(text, greatest(1, length(text) - 63), 64))) as signature from documents where text is not null and length(text) > 0",
    "subtitle_export": f"{_E}, n as (select *, row_number() over (partition by job_id order by l_start, l_end, english) as no from c where english is not null) select job_id, cast(no as bigint) as no, cast(no as varchar) || chr(10) || {_CLOCK.format('l_start', ',')} || ' --> ' || {_CLOCK.format('l_end', ',')} || chr(10) || english || chr(10) as block from n",
    "edit_list_export": f"with {sql_cues()}, d as (select distinct job_id, l_start, l_end from c), n as (select *, row_number() over (partition by job_id order by l_start, l_end) as no from d) select job_id, cast(no as bigint) as no, lpad(cast(no as varchar), 3, '0') || '  AX       AA    C         ' || {_TIMES} || '  ' || {_TIMES} as event from n",
    "cue_sheet_export": f"with {sql_cues('speaker_id', 'english', 'status')} select job_id, cue_id, {_CLOCK.format('l_start', '.')} as starts, {_CLOCK.format('l_end', '.')} as ends, case when speaker_id > 0 then 'Voice ' || cast(speaker_id as varchar) else 'Uncertain voice' end as voice, coalesce(english, '') as line, status from c",
}
# char_error_rate has no SQL: DuckDB counts bytes, not letters. It is tested against a brute-force version.
