"""Choices, selections for another pass, names of files and titles, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions import names
from cuemill.functions.text import normalize_title
from cuemill.operators import choices, store
from cuemill.operators.overlap import milli
from cuemill.plans.cue_queries import _M, _WITH, _confident
from cuemill.plans.tables import cues, sql_cues
from cuemill.session import table


def choose_audio(spark, sf_dir):
    """Order lines stand in for the streams of a file."""
    return choices.choose_audio(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "A", F.col("l_quantity") / 10, F.col("l_linestatus") == "F")


def choose_embedded(spark, sf_dir):
    """The first usable subtitle stream: wanted before others, full before signs, default first, then by index."""
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 5")
    return choices.choose_text(l, "l_orderkey", [F.col("l_returnflag") != "N", F.col("l_discount") > 0.05, F.col("l_linestatus") != "O", F.col("l_linenumber")])


def stream_listing(spark, sf_dir):
    """Streams of each file with their running number and a readable name."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    return table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", (F.row_number().over(w) - 1).cast("bigint").alias("ordinal"), F.lower("l_returnflag").alias("language"), F.concat(F.lit("Audio track "), F.row_number().over(w).cast("string")).alias("title"))


def media_duration(spark, sf_dir):
    """The greatest duration told in a job's texts that reads as a number, 0 for none."""
    told = F.array(F.try_to_number(F.regexp_extract("filename", r"(\d+)", 1), F.lit("999999999")).cast("double"), F.when(~F.isnan("duration_s"), F.col("duration_s")), F.lit(0.0))
    return table(spark, sf_dir, "jobs").where("job_id is not null").groupBy("job_id").agg(milli(F.max(F.array_max(told))).alias("ms"))


def parsed_season_episode(spark, sf_dir):
    s, e = names.season_episode(F.col("source"))
    return table(spark, sf_dir, "media_names").where("source is not null").select("name_id", s.alias("season"), e.alias("episode")).distinct()


def parsed_year(spark, sf_dir):
    return table(spark, sf_dir, "media_names").where("source is not null").select("name_id", names.media_year(F.col("source")).alias("media_year")).distinct()


def display_titles(spark, sf_dir):
    return table(spark, sf_dir, "media_names").where("title is not null").select("name_id", names.display_title(F.col("title")).alias("display")).distinct()


def cue_search(spark, sf_dir):
    """Cues that mention the lighthouse in any text, as far as the first page of 500."""
    c = cues(spark, sf_dir, "source", "english", "speaker_name", "status")
    hit = F.lower(F.concat_ws(" ", "english", "source", "speaker_name")).contains("lighthouse")
    return c.where(hit).select("job_id", "cue_id", "status").orderBy("job_id", "cue_id").limit(500)


def translation_selector(spark, sf_dir):
    """What is to be translated, what may be kept, what is there already."""
    foreign = ~F.lower(F.coalesce("source_language", F.lit(""))).isin("", "english")
    has = F.coalesce(F.col("english").rlike(r"(?U)\S"), F.lit(False))
    return _confident(spark, sf_dir).select("job_id", "cue_id", F.when(~foreign, "keep").when(~has, "translate").when(F.col("status") == "review", "again").otherwise("done").alias("action"))


def translation_fallback(spark, sf_dir):
    """The translation, else the line itself, else its speaker's name."""
    c = cues(spark, sf_dir, "source", "english", "speaker_name")
    return c.select("job_id", "cue_id", choices.first_text(F.col("english"), F.col("source"), F.col("speaker_name")).alias("line"))


def verdict_attach(spark, sf_dir):
    """Cues with the verdict of the latest pass over their job; without one it is failed."""
    j = store.latest(table(spark, sf_dir, "jobs").where("job_id is not null"), ["job_id"], [F.desc("updated_at"), "status"]).select("job_id", F.when(F.col("status") == "done", "passed").alias("verdict"))
    return choices.with_default(cues(spark, sf_dir).select("job_id", "cue_id"), j, ["job_id"], "verdict", F.lit("failed"))


def failure_selectors(spark, sf_dir):
    """Why a cue would be made again: timing, words, voice; each with its own default for what is missing."""
    x = _confident(spark, sf_dir).withColumn("ms", F.col("l_end") - F.col("l_start"))
    why = F.filter(F.array(F.when(F.col("ms") < 700, F.lit("timing")), F.when(F.coalesce("tc", F.lit(0.0)) < 0.58, F.lit("words")), F.when((F.col("ms") >= 1000) & (F.coalesce("ac", F.lit(1.0)) < 0.55), F.lit("performance")), F.when((F.coalesce("sc", F.lit(0.0)) < 0.55) & (F.col("ms") >= 800), F.lit("voice"))), lambda v: v.isNotNull())
    return x.select("job_id", "cue_id", F.array_join(why, ",").alias("why")).where("why <> ''")


def dispute_candidates(spark, sf_dir):
    """Doubtful lines in another language with a translation: a second opinion is worth its price."""
    return _confident(spark, sf_dir).where("english is not null and coalesce(tc, 0.0) < 0.93 and status = 'review' and lower(coalesce(source_language, '')) not in ('en', 'eng', 'english')").select("job_id", "cue_id")


def invalidate_dependents(spark, sf_dir):
    """Cues after an edit of their job's review lines: what was made of the old text is taken back."""
    x = _confident(spark, sf_dir)
    stale = F.col("status") == "review"
    return x.select("job_id", "cue_id", F.when(~F.coalesce(stale, F.lit(False)), F.col("english")).alias("english"), F.when(~F.coalesce(stale, F.lit(False)), milli(F.col("ac"))).alias("alignment_milli"), F.when(stale, "pending").otherwise(F.col("status")).alias("status"))


def progress_backfill(spark, sf_dir):
    """Cues up to the last voiced one of a job count as voiced."""
    x = _confident(spark, sf_dir)
    last = F.max(F.when(F.col("status").isin("voiced", "done"), F.col("cue_id"))).over(Window.partitionBy("job_id"))
    return x.select("job_id", "cue_id", F.coalesce(F.col("cue_id") <= last, F.lit(False)).alias("voiced"))


def running_tail(spark, sf_dir):
    """The last five states of each job's cues in the order of time."""
    tail = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("l_start", "cue_id", F.coalesce("status", F.lit("-")).alias("s"))))), 1, 5)
    return cues(spark, sf_dir, "status").groupBy("job_id").agg(tail.alias("t")).select("job_id", F.array_join(F.transform("t", lambda x: x["s"]), " ").alias("tail"))


def quality_report(spark, sf_dir):
    """Result of each job: failed without any translation, for review where a cue is flagged, else passed."""
    x = _confident(spark, sf_dir)
    g = x.groupBy("job_id").agg(F.count(F.lit(1)).alias("cues"), F.count("english").alias("translated"), F.count_if(F.coalesce("sc", F.lit(0.0)) < 0.5).alias("flagged"))
    return g.select("job_id", "cues", "flagged", F.when(F.col("translated") == 0, "failed").when(F.col("flagged") > 0, "needs_review").otherwise("passed").alias("result"))


def join_units(spark, sf_dir):
    """A line behind the one before it, without a blank where the language has none."""
    w = Window.partitionBy("job_id").orderBy("l_start", "cue_id")
    c = cues(spark, sf_dir, "source", "source_language").withColumn("before", F.lag("source").over(w))
    tight = F.lower(F.coalesce("source_language", F.lit(""))).isin("ja", "jpn", "japanese")
    return c.select("job_id", "cue_id", F.when(tight, F.concat_ws("", "before", "source")).otherwise(F.concat_ws(" ", "before", "source")).alias("joined"))


def performance_similarity(spark, sf_dir):
    """How alike two neighbouring vectors run, as contours of ten values, and how close their ends are."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    w = Window.partitionBy("label").orderBy("vec_id")
    ten = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    p = e.select("vec_id", ten.alias("a"), F.lead(ten).over(w).alias("b")).where("b is not null")
    r = choices.correlation(F.col("a"), F.col("b"))
    end = F.abs(F.element_at("a", 10) - F.element_at("b", 10))
    return p.select("vec_id", milli(r).alias("corr_milli"), milli(choices.weighted_parts([((r + 1) / 2, 0.4), (F.greatest(F.lit(0.0), 1 - end), 0.2)])).alias("similarity_milli"))


def compatible_key(spark, sf_dir):
    """Names with exactly one catalogue entry of the same kind and title and no other year."""
    n = table(spark, sf_dir, "media_names").where("normalized_title <> ''").select("name_id", "normalized_title", "media_year", "media_type").distinct()
    c = table(spark, sf_dir, "catalogue").select("catalogue_id", normalize_title("title").alias("t"), F.col("media_year").alias("y"), F.col("media_type").alias("k"))
    pairs = n.join(c, (F.col("normalized_title") == F.col("t")) & (F.col("media_type") == F.col("k"))).where("media_year is null or y is null or media_year = y")
    return choices.unambiguous(pairs, "name_id", "catalogue_id")


def fuzzy_candidates(spark, sf_dir):
    """The best catalogue entry of each name by title or original title: matching blocks, shared words, year, kind. Python.

    Every entry is a candidate of every name; the catalogue is a fixed list. A name without any entry stays, unmatched.
    """
    n = table(spark, sf_dir, "media_names").where("normalized_title <> ''").select("name_id", F.col("normalized_title").alias("q"), F.coalesce("media_year", F.lit(-1)).alias("qy"), F.coalesce("media_type", F.lit("")).alias("qk")).distinct()
    c = table(spark, sf_dir, "catalogue").select("catalogue_id", normalize_title("title").alias("t"), normalize_title("original_title").alias("o"), "media_year", "media_type", "popularity").distinct()
    entries = [(r.catalogue_id, sorted({x for x in (r.t, r.o) if x}), r.media_year, r.media_type, r.popularity) for r in c.collect()]
    best = choices.best_entries(n.select("q", "qy", "qk").distinct(), entries)
    w = Window.partitionBy("name_id").orderBy(F.desc("score"), F.desc("margin"), "catalogue_id")
    ranked = n.join(best, ["q", "qy", "qk"]).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return ranked.select("name_id", "catalogue_id", "score", "margin", (F.col("catalogue_id").isNotNull() & (F.col("score") >= 780) & (F.col("margin") >= 70)).alias("accepted"))


QUERIES = {
    f.__name__: f
    for f in [
        choose_audio, choose_embedded, stream_listing, media_duration, parsed_season_episode, parsed_year, display_titles, cue_search, translation_selector, translation_fallback, verdict_attach, failure_selectors,
        dispute_candidates, invalidate_dependents, progress_backfill, running_tail, quality_report, join_units, performance_similarity, compatible_key, fuzzy_candidates,
    ]
}

SQL = {
    "choose_audio": """with s as (select l_orderkey, l_linenumber, 3 * case when l_returnflag = 'A' then cast(1 as double) else 0 end + least(cast(2 as double), l_quantity / 10 / 3) - 12 * case when l_linestatus = 'F' then cast(1 as double) else 0 end as sc from lineitem),
r as (select *, lead(sc) over w as nx, row_number() over w as rn from s window w as (partition by l_orderkey order by sc desc, l_linenumber)) select l_orderkey, l_linenumber, coalesce(sc - nx < 1.0, false) as ambiguous from r where rn = 1""",
    "choose_embedded": """with r as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_returnflag <> 'N', l_discount > 0.05, l_linestatus <> 'O', l_linenumber) as rn from lineitem where l_quantity > 5) select l_orderkey, l_linenumber as index from r where rn = 1""",
    "stream_listing": "select l_orderkey, row_number() over w - 1 as ordinal, lower(l_returnflag) as language, 'Audio track ' || cast(row_number() over w as varchar) as title from lineitem where l_returnflag <> 'N' window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag)",
    "media_duration": f"select job_id, {_M.format('max(greatest(coalesce(try_cast(regexp_extract(filename, $$([0-9]+)$$, 1) as double), 0), case when not isnan(duration_s) then duration_s else 0 end, 0))')} as ms from jobs where job_id is not null group by job_id",
    "parsed_season_episode": "select distinct name_id, season, episode from media_names where source is not null",
    "parsed_year": "select distinct name_id, media_year from media_names where source is not null",
    "display_titles": r"""select distinct name_id, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(title, '[._]+(\S)', ' \1', 'g'), '\s+'), lambda w: w <> ''), lambda w, i: case when w = upper(w) and w <> lower(w) and length(w) <= 5 then w
when i > 1 and lower(w) in ("""
    + ", ".join(f"'{x}'" for x in names.SMALL_WORDS) + """) then lower(w) else upper(w[1:1]) || w[2:] end), ' ') as display from media_names where title is not null""",
    "cue_search": f"with {sql_cues('source', 'english', 'speaker_name', 'status')} select job_id, cue_id, status from c where contains(lower(concat_ws(' ', english, source, speaker_name)), 'lighthouse') order by job_id, cue_id limit 500",
    "translation_selector": f"{_WITH} select job_id, cue_id, case when lower(coalesce(source_language, '')) in ('', 'english') then 'keep' when english is null or not regexp_matches(english, '[^\\s\\x{{a0}}\\x{{3000}}]') then 'translate' when status = 'review' then 'again' else 'done' end as action from x",
    "translation_fallback": f"with {sql_cues('source', 'english', 'speaker_name')} select job_id, cue_id, coalesce(" + ", ".join(f"case when regexp_matches({x}, '[^\\s\\x{{a0}}\\x{{3000}}]') then {x} end" for x in ('english', 'source', 'speaker_name')) + ") as line from c",
    "verdict_attach": f"with {sql_cues()}, j as (select job_id, status, row_number() over (partition by job_id order by updated_at desc, status) as rn from jobs where job_id is not null) select c.job_id, c.cue_id, coalesce(case when j.status = 'done' then 'passed' end, 'failed') as verdict from c left join (select * from j where rn = 1) j on c.job_id = j.job_id",
    "failure_selectors": f"{_WITH}, y as (select job_id, cue_id, concat_ws(',', case when l_end - l_start < 700 then 'timing' end, case when coalesce(tc, 0) < 0.58 then 'words' end, case when l_end - l_start >= 1000 and coalesce(ac, 1) < 0.55 then 'performance' end, case when coalesce(sc, 0) < 0.55 and l_end - l_start >= 800 then 'voice' end) as why from x) select * from y where why <> ''",
    "dispute_candidates": f"{_WITH} select job_id, cue_id from x where english is not null and coalesce(tc, 0) < 0.93 and status = 'review' and lower(coalesce(source_language, '')) not in ('en', 'eng', 'english')",
    "invalidate_dependents": f"{_WITH} select job_id, cue_id, case when not coalesce(status = 'review', false) then english end as english, case when not coalesce(status = 'review', false) then {_M.format('ac')} end as alignment_milli, case when status = 'review' then 'pending' else status end as status from x",
    "progress_backfill": f"{_WITH} select job_id, cue_id, coalesce(cue_id <= max(case when status in ('voiced', 'done') then cue_id end) over (partition by job_id), false) as voiced from x",
    "running_tail": f"with {sql_cues('status')} select job_id, array_to_string(list(coalesce(status, '-') order by l_start desc, cue_id desc, coalesce(status, '-') desc)[1:5], ' ') as tail from c group by job_id",
    "quality_report": f"{_WITH}, g as (select job_id, count(*) as cues, count(english) as translated, count(*) filter (where coalesce(sc, 0) < 0.5) as flagged from x group by 1) select job_id, cues, flagged, case when translated = 0 then 'failed' when flagged > 0 then 'needs_review' else 'passed' end as result from g",
    "join_units": f"with {sql_cues('source', 'source_language')}, b as (select *, lag(source) over (partition by job_id order by l_start, cue_id) as before from c) select job_id, cue_id, case when lower(coalesce(source_language, '')) in ('ja', 'jpn', 'japanese') then concat_ws('', before, source) else concat_ws(' ', before, source) end as joined from b",
    "performance_similarity": f"""with e as (select vec_id, cast(embedding[1:10] as double[]) as a, lead(cast(embedding[1:10] as double[])) over (partition by label order by vec_id) as b from embeddings where label is not null),
r as (select vec_id, abs(a[10] - b[10]) as d, (select corr(x, y) from (select unnest(a) as x, unnest(b) as y)) as r from e where b is not null) select vec_id, {_M.format('r')} as corr_milli, {_M.format('((r + 1) / 2 * cast(0.4 as double) + greatest(cast(0 as double), 1 - d) * cast(0.2 as double)) / (cast(0.4 as double) + cast(0.2 as double))')} as similarity_milli from r""",
    "compatible_key": """with n as (select distinct name_id, normalized_title, media_year, media_type from media_names where normalized_title <> ''),
c as (select catalogue_id, trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) as t, media_year as y, media_type as k from catalogue),
p as (select name_id, catalogue_id from n join c on n.normalized_title = c.t and n.media_type = c.k where n.media_year is null or y is null or n.media_year = y) select name_id, min(catalogue_id) as catalogue_id from p group by name_id having count(distinct catalogue_id) = 1""",
}
