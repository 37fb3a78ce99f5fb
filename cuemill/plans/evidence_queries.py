"""Evidence gates, selections and parsers that need no more than one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.operators import evidence as ev
from cuemill.operators.overlap import milli
from cuemill.plans.cue_queries import _M, _WITH, _confident
from cuemill.plans.tables import cues, sql_cues
from cuemill.session import table


def rhythm_scores(spark, sf_dir):
    c = cues(spark, sf_dir, "english").where("english is not null")
    pauses = F.size(F.regexp_extract_all("english", F.lit("([,;:—…])"), F.lit(1))) + (F.length("english") - F.length(F.replace("english", F.lit("..."), F.lit("")))) / 3
    return c.select("job_id", "cue_id", milli(ev.rhythm(pauses, F.lit(1))).alias("rhythm_milli"))


def nearest_variant(spark, sf_dir):
    """For each event the voice variant of its user that is nearest: value as pitch, the key as brightness.

    A user's variants are the first four views, the first of them canonical. Null stands for the canonical one: without
    a pitch, without other variants, where the canonical one is less than 1.5 further away, or where it has no pitch and
    the nearest is more than 4 away.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.try_variant_get(F.try_parse_json("props"), "$.k", "double").alias("k"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("rn", F.row_number().over(w)).where("rn <= 4")
    v = v.select("user_id", "rn", F.col("event_id").alias("variant"), F.col("value").alias("v"), F.try_variant_get(F.try_parse_json("props"), "$.k", "double").alias("vk"))
    none = F.lit(0.0)
    d = milli(ev.voice_distance(F.col("value"), F.col("v"), F.col("k"), F.col("vk"), none, none))
    pairs = e.join(v, "user_id").where("value > 0").withColumn("d", d)
    g = pairs.groupBy("event_id").agg(F.min(F.when(F.col("rn") > 1, F.struct("d", "rn", "variant"))).alias("m"), F.min(F.when((F.col("rn") == 1) & (F.col("v") > 0), F.col("d"))).alias("own"))
    taken = F.when(F.col("own").isNull(), F.col("m.d") <= 4000).otherwise(F.col("m.d") <= F.col("own") - 1500)
    got = g.where("m is not null").select("event_id", F.when(taken, F.col("m.variant")).alias("variant_id"), F.when(taken, F.col("m.d")).alias("distance_milli"))
    return e.select("event_id").join(got, "event_id", "left")


def incoherent_lines(spark, sf_dir):
    return ev.incoherent(table(spark, sf_dir, "events").where("value >= 1"), "user_id", "event_id", "value")


def verdict_assembly(spark, sf_dir):
    x = _confident(spark, sf_dir)
    v = ev.assemble_verdict(F.col("tc").isNotNull() & F.col("english").isNotNull(), F.col("status") == "review", F.col("tc") + 0.2, F.col("ac"))
    return x.select("job_id", "cue_id", v.alias("verdict"))


def dialogue_source_gate(spark, sf_dir):
    """Order lines as levels of stems."""
    l = table(spark, sf_dir, "lineitem")
    return l.where(ev.source_gate(F.col("l_tax") / 100, [F.col("l_discount") / 10, F.col("l_quantity") / 10_000])).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("lines"))


def reference_metrics(spark, sf_dir):
    x = _confident(spark, sf_dir).where("tc is not null and ac is not null and sc is not null")
    q = ev.reference_quality(F.col("tc"), F.col("ac"), F.lit(0.8), F.col("sc"), F.lit(0.9), F.col("cue_id") % 7 == 0, F.col("speaker_id") == 0)
    return x.select("job_id", "cue_id", milli(q).alias("quality_milli"))


def merged_windows(spark, sf_dir):
    """Each minute of a job from first readings or from edited ones, as a whole."""
    x = _confident(spark, sf_dir).where("tc is not null").withColumn("minute", F.floor(F.col("l_start") / 60_000)).withColumn("t", milli(F.col("tc")))
    return ev.pick_side(x.where("status = 'done'"), x.where("status in ('edited', 'voiced')"), ["job_id", "minute"], "t", 30)


def diverse_references(spark, sf_dir):
    x = _confident(spark, sf_dir).where("speaker_id > 0 and tc >= 0.48 and l_end - l_start >= 2000").withColumn("score", milli(F.col("tc"))).withColumn("p", F.col("l_start") / 1000).withColumn("b", F.col("l_end") / 10).withColumn("who", F.concat_ws("/", "job_id", "speaker_id"))
    return ev.diverse_references(x, "who", "cue_id", "score", "p", "b")


def face_shortlist(spark, sf_dir):
    """The first 25 lines of each job whose speaker's mouth was seen in that minute."""
    s = table(spark, sf_dir, "face_sightings").where("mouth_visible and speaker_id > 0 and job_id is not null and at_s is not null and not isnan(at_s)").select("job_id", "speaker_id", F.floor(F.col("at_s") / 60).alias("minute")).distinct()
    c = cues(spark, sf_dir, "speaker_id").withColumn("minute", F.floor(F.floor(F.col("l_start") / 1000) / 60))
    w = Window.partitionBy("job_id").orderBy("l_start", "cue_id")
    return c.join(s, ["job_id", "speaker_id", "minute"], "left_semi").withColumn("rn", F.row_number().over(w)).where("rn <= 25").select("job_id", "cue_id", F.col("rn").cast("bigint").alias("place"))


def second_opinion_candidates(spark, sf_dir):
    """Lines that were read but never translated."""
    return _confident(spark, sf_dir).where(F.col("source").rlike(r"(?U)\S") & ~F.coalesce(F.col("english").rlike(r"(?U)\S"), F.lit(False))).select("job_id", "cue_id")


def provenance_signature(spark, sf_dir):
    """A hash of what a line was made from; it changes with any of them."""
    c = cues(spark, sf_dir, "speaker_id", "english")
    return c.select("job_id", "cue_id", F.sha2(F.concat_ws("|", F.lit("v3"), F.coalesce("english", F.lit("")), F.coalesce(F.col("speaker_id").cast("string"), F.lit("")), (F.col("l_end") - F.col("l_start")).cast("string")), 256).alias("signature"))


def display_captions(spark, sf_dir):
    """Lines that look like a sign: a few words, no sentence mark, all in capitals or a single word."""
    c = cues(spark, sf_dir, "english").where("english is not null")
    words = F.size(F.regexp_extract_all("english", F.lit(r"([A-Za-z']+)"), F.lit(1)))
    bare = F.regexp_replace("english", r"[^A-Za-z]", "")
    return c.where(words.between(1, 6) & ~F.col("english").rlike(r"[.!?…,;:]") & ((bare == F.upper(bare)) | (words == 1))).select("job_id", "cue_id")


def mirrored_takes(spark, sf_dir):
    """Translations, missing ones filled from an equal line elsewhere in the job."""
    c = cues(spark, sf_dir, "source", "english")
    base = c.where("english is not null and source is not null").groupBy("job_id", "source").agg(F.min("english").alias("base")).select(F.col("job_id").alias("bj"), F.col("source").alias("bs"), "base")
    return c.join(base, (F.col("job_id") == F.col("bj")) & (F.col("source") == F.col("bs")), "left").select("job_id", "cue_id", F.coalesce("english", "base").alias("english"))


def english_is_default(spark, sf_dir):
    """Orders whose first line is of the wanted kind and the only one marked."""
    l = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_returnflag") == "A").withColumn("e", F.col("l_linestatus") == "O")
    g = l.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", ~F.col("e"), ~F.col("d"))).alias("f"), F.count_if("d").alias("n"))
    return g.select("l_orderkey", (~F.col("f.col2") & ~F.col("f.col3") & (F.col("n") == 1)).alias("ok"))


QUERIES = {
    f.__name__: f
    for f in [
        rhythm_scores, nearest_variant, incoherent_lines, verdict_assembly, dialogue_source_gate, reference_metrics, merged_windows, diverse_references, face_shortlist, second_opinion_candidates, provenance_signature,
        display_captions, mirrored_takes, english_is_default,
    ]
}

_FOLD = "case when abs(log2(value / m)) <= abs(log2(value * 2 / m)) and abs(log2(value / m)) <= abs(log2(value / 2 / m)) then value when abs(log2(value * 2 / m)) <= abs(log2(value / 2 / m)) then value * 2 else value / 2 end"
SQL = {
    "rhythm_scores": f"with {sql_cues('english')} select job_id, cue_id, {_M.format('greatest(cast(0 as double), 1 - abs(len(regexp_extract_all(english, $$[,;:—…]$$)) + (length(english) - length(replace(english, $$...$$, $$$$))) / 3 - 1) / 4)')} as rhythm_milli from c where english is not null",
    "nearest_variant": f"""with e as (select event_id, user_id, value, cast(json_extract(props, '$.k') as double) as k from events), r as (select user_id, event_id as variant, value as v, cast(json_extract(props, '$.k') as double) as vk, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type = 'view'),
p as (select e.event_id, rn, variant, v, {_M.format("case when v > 0 then abs(12 * log2(value / v)) else 0 end + case when k > 0 and vk > 0 then 2 * abs(log2(k / vk)) else 0 end")} as d from e join r on e.user_id = r.user_id and rn <= 4 where value > 0),
o as (select event_id, min(d) as own from p where rn = 1 and v > 0 group by 1), b as (select *, row_number() over (partition by event_id order by d, rn) as best from p where rn > 1),
t as (select b.event_id, variant, d from b left join o on b.event_id = o.event_id where best = 1 and case when own is null then d <= 4000 else d <= own - 1500 end)
select e.event_id, variant as variant_id, d as distance_milli from e left join t on e.event_id = t.event_id""",
    "incoherent_lines": f"""with g as (select * from events where value >= 1), m as (select user_id, median(value) as m from g group by 1 having count(*) >= 3), f as (select g.user_id, event_id, {_FOLD} as f from g join m on g.user_id = m.user_id),
s as (select user_id, 12 * log2(max(f) / min(f)) as s, median(f) as fm from f group by 1) select f.user_id, event_id from f join s on f.user_id = s.user_id where s > 8 and abs(12 * log2(f / fm)) > 4""",
    "verdict_assembly": f"{_WITH} select job_id, cue_id, case when not (tc is not null and english is not null) then 'unsure' when coalesce(status = 'review', true) then 'failed' when ac is null or (tc + cast(0.2 as double) >= 0.78 and ac >= 0.85) then 'passed' else 'failed' end as verdict from x",
    "dialogue_source_gate": "with l as (select l_linenumber, l_tax / 100 as p, greatest(l_tax / 100, l_discount / 10, l_quantity / 10000) as s from lineitem) select l_linenumber, count(*) as lines from l where s >= 0.0002 and p < greatest(cast(0.0002 as double), cast(0.08 as double) * s) group by 1",
    "reference_metrics": f"{_WITH} select job_id, cue_id, {_M.format('(cast(0.32 as double) * tc + cast(0.24 as double) * ac + cast(0.22 as double) * cast(0.8 as double) + cast(0.22 as double) * sc) * cast(0.9 as double) * case when cue_id % 7 = 0 then 0.5 else 1 end * case when speaker_id = 0 then cast(0.2 as double) else 1 end')} as quality_milli from x where tc is not null and ac is not null and sc is not null",
    "merged_windows": f"""{_WITH}, y as (select job_id, l_start // 60000 as minute, status, {_M.format('tc')} as t from x where tc is not null), p as (select job_id, minute, avg(t) as p from y where status = 'done' group by 1, 2), h as (select job_id, minute, avg(t) as h from y where status in ('edited', 'voiced') group by 1, 2)
select coalesce(p.job_id, h.job_id) as job_id, cast(coalesce(p.minute, h.minute) as bigint) as minute, case when p is null then 'higher' when h is null then 'primary' when h >= p + 30 then 'higher' else 'primary' end as side from p full join h on p.job_id = h.job_id and p.minute = h.minute""".replace("when p is null", "when p.p is null").replace("when h is null", "when h.h is null").replace("when h >= p + 30", "when h.h >= p.p + 30"),
    "face_shortlist": f"""with {sql_cues('speaker_id')}, s as (select distinct job_id, speaker_id, cast(floor(at_s / 60) as bigint) as minute from face_sightings where mouth_visible and speaker_id > 0 and job_id is not null and at_s is not null and not isnan(at_s)),
r as (select c.job_id, c.cue_id, row_number() over (partition by c.job_id order by l_start, cue_id) as place from c where exists (select 1 from s where s.job_id = c.job_id and s.speaker_id = c.speaker_id and s.minute = c.l_start // 1000 // 60)) select * from r where place <= 25""",
    "second_opinion_candidates": f"{_WITH} select job_id, cue_id from x where regexp_matches(source, '[^\\s\\x{{a0}}\\x{{3000}}]') and not coalesce(regexp_matches(english, '[^\\s\\x{{a0}}\\x{{3000}}]'), false)",
    "provenance_signature": f"with {sql_cues('speaker_id', 'english')} select job_id, cue_id, sha256(concat_ws('|', 'v3', coalesce(english, ''), coalesce(cast(speaker_id as varchar), ''), cast(l_end - l_start as varchar))) as signature from c",
    "display_captions": f"with {sql_cues('english')}, w as (select *, len(regexp_extract_all(english, '[A-Za-z'']+')) as n, regexp_replace(english, '[^A-Za-z]', '', 'g') as bare from c where english is not null) select job_id, cue_id from w where n between 1 and 6 and not regexp_matches(english, '[.!?…,;:]') and (bare = upper(bare) or n = 1)",
    "mirrored_takes": f"with {sql_cues('source', 'english')}, b as (select job_id, source, min(english) as base from c where english is not null and source is not null group by 1, 2) select c.job_id, c.cue_id, coalesce(c.english, base) as english from c left join b on c.job_id = b.job_id and c.source = b.source",
    "english_is_default": "with g as (select l_orderkey, min({'n': l_linenumber, 'e': l_linestatus <> 'O', 'd': l_returnflag <> 'A'}) as f, count(*) filter (where l_returnflag = 'A') as n from lineitem group by 1) select l_orderkey, not f.e and not f.d and n = 1 as ok from g",
}
