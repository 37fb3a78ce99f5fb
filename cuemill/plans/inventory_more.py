"""Signals, voices, exports and merging of rows over the test tables; vectors stand in for frames and contours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuemill.functions import text as t
from cuemill.functions.text import normalize_title
from cuemill.operators import gates, signals
from cuemill.operators.overlap import milli, overlap_pairs
from cuemill.plans.cue_queries import _M, _WITH, _confident
from cuemill.plans.inventory_queries import _REASONED, _SEEN, _seen, review_reasons
from cuemill.plans.tables import TURNS, cues, sql_cues, turns
from cuemill.session import table


def _pairs(spark, sf_dir):
    """Each vector beside the next one of its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    return e.withColumn("b", F.lead("a").over(w)).where("b is not null")


def created_visual_voices(spark, sf_dir):
    """Voices made for faces without an anchor that were clearly seen speaking in two lines or more, and their confidence; numbered by first line."""
    x = _seen(spark, sf_dir)
    vote = x.where("face is not null and vis >= 0.70 and sc >= 0.75 and speaker_id is not null")
    w = vote.groupBy("job_id", "face", "speaker_id").agg(F.sum(F.floor(F.col("vis") * F.col("sc") * 1_000_000 + 0.5).cast("bigint")).alias("w"))
    anchored = w.groupBy("job_id", "face").agg(F.sum("w").alias("total"), F.max("w").alias("top")).where("top * 10 >= total * 6 and total > 0").select("job_id", "face")
    free = x.where("mouth and vis >= 0.82 and (coalesce(sc, 0e0) < 0.62 or vis > coalesce(sc, 0e0) + 0.18e0)").join(anchored, ["job_id", "face"], "left_anti")
    lines = free.groupBy("job_id", "face").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_end") - F.col("l_start")).alias("ms"), F.min(F.struct("l_start", "cue_id")).alias("first")).where("n >= 2 and ms >= 650")
    known = x.groupBy("job_id").agg(F.max(F.coalesce("speaker_id", F.lit(0))).alias("known"))
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("first", "face"))
    return lines.join(known, "job_id").select("job_id", "face", (F.col("known") + number).cast("bigint").alias("new_speaker_id"), milli(F.least(F.lit(0.86), 0.62 + 0.08 * F.col("n"))).alias("confidence_milli"))


def face_margins(spark, sf_dir):
    """The face that most likely speaks for each voice of a job, and how sure that is: motion (its 70th percentile), how often it is seen, its size (stood in for by its number) and its lead over the next one."""
    s = table(spark, sf_dir, "face_sightings").where("speaker_id > 0 and active_face_id is not null and job_id is not null and active_speaker_confidence > 0 and not isnan(active_speaker_confidence)").select("sighting_id", "job_id", "speaker_id", F.col("active_face_id").alias("face_id"), "active_speaker_confidence", F.coalesce("mouth_visible", F.lit(False)).cast("int").alias("seen")).distinct()
    g = s.groupBy("job_id", "speaker_id", "face_id").agg(F.expr("percentile(active_speaker_confidence, 0.7)").alias("motion"), F.avg("seen").alias("visible"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("area", 0.0008 * (1 + F.col("face_id") % 5)).withColumn("score", 0.05 * F.col("motion") * F.least(F.lit(1.0), F.col("visible") / 0.55) * F.least(F.lit(1.0), F.col("area") / 0.003))
    w = Window.partitionBy("job_id", "speaker_id").orderBy(F.desc("score"), "face_id")
    all_ = Window.partitionBy("job_id", "speaker_id")
    r = g.withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(0.0))).withColumn("single", F.col("n") / F.sum("n").over(all_)).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    up = lambda x, full: F.least(F.lit(1.0), x / full)
    sure = up(F.col("score"), 0.035) * up(F.col("score") - F.col("next"), 0.012) * up(F.col("visible"), 0.55) * up(F.col("single"), 0.60)
    return r.select("job_id", "speaker_id", "face_id", milli(sure).alias("confidence_milli"), (milli(sure) >= 560).alias("active"), ((milli(sure) >= 560) & (F.col("visible") >= 0.55) & (F.col("area") >= 0.0012)).alias("mouth_visible"))


def verification_budget(spark, sf_dir):
    """The 150 foreign lines whose reading can be trusted least, without an opinion yet, in the order of speech; a line no larger model was asked about counts as riskier."""
    x = _confident(spark, sf_dir).where("length(trim(source)) > 0 and l_end - l_start >= 350 and lower(coalesce(source_language, '')) not in ('', 'en', 'eng', 'english') and cue_id % 10 <> 0")
    risk = milli(1 - F.coalesce("tc", F.lit(0.0)) + F.when(F.col("cue_id") % 3 == 0, 0.35).otherwise(0.0) + F.greatest(F.lit(0.0), F.lit(0.85) - F.coalesce("ac", F.lit(0.0))))
    return x.select("job_id", "cue_id", risk.alias("risk_milli")).orderBy(F.desc("risk_milli"), "job_id", "cue_id").limit(150).orderBy("job_id", "cue_id")


def performance_parts(spark, sf_dir):
    """How alike two neighbouring vectors perform: contour of ten values, pauses and pitch from further values."""
    p = _pairs(spark, sf_dir).withColumn("x", F.slice("a", 1, 10)).withColumn("y", F.slice("b", 1, 10))
    at = lambda c, i: F.element_at(c, i)
    s = signals.performance_similarity(signals.contour_similarity(F.col("x"), F.col("y")), F.abs(at("a", 11)), F.abs(at("b", 11)), at("a", 12) * 1000, at("b", 12) * 1000)
    return p.select("vec_id", milli(s).alias("similarity_milli"))


def voice_similarities(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    s = signals.voice_similarity(F.col("a"), F.col("b"), F.col("vec_id") % 4)
    return p.select("vec_id", milli(s["similarity"]).alias("similarity_milli"), s["reliable"].alias("reliable"))


def dialogue_leakage(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", milli(signals.leakage(F.col("a"), F.col("b"))).alias("leakage_milli"))


def crossfaded(spark, sf_dir):
    """Energy of the crossfade of each vector into the next one."""
    c = signals.crossfade(F.col("a"), F.col("b"))
    return _pairs(spark, sf_dir).select("vec_id", milli(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)).alias("energy_milli"))


def mixed_timeline(spark, sf_dir):
    """Vectors laid on one timeline, 16 frames apart, and added up; whole thousandths are summed."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 16).alias("at"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000 + 0.5)).alias("s"))
    return signals.mixed(e, "at", "s", peak=980.0).select("frame", F.floor(F.col("value") + 0.5).cast("bigint").alias("milli"))


def fitted_takes(spark, sf_dir):
    """Takes brought to their windows; the pace of the text stands in for the length of a take."""
    x = cues(spark, sf_dir, "english").where("english is not null")
    f = signals.fit(t.estimated_seconds(F.col("english")), (F.col("l_end") - F.col("l_start")) / 1000)
    return x.select("job_id", "cue_id", milli(f["tempo"]).alias("tempo_milli"), F.floor(f["padding_ms"] + 0.5).cast("bigint").alias("padding_ms"), F.floor(f["truncated_ms"] + 0.5).cast("bigint").alias("truncated_ms"), f["ok"].alias("ok"))


def corrected_lines(spark, sf_dir):
    """Lines shortened by a tenth, three times at most, until they fit."""
    x = cues(spark, sf_dir, "english").where("english is not null").select("job_id", "cue_id", (F.col("l_end") - F.col("l_start")).alias("ms"), F.floor(t.estimated_seconds(F.col("english")) * 1000 + 0.5).cast("bigint").alias("need"))
    got = signals.rounds(x, "need", lambda v: v > F.col("ms"), lambda v: F.floor(v * 9 / 10).cast("bigint"))
    return got.select("job_id", "cue_id", F.col("attempts").cast("bigint").alias("attempts"), "need", (F.col("need") <= F.col("ms")).alias("fits"))


def joined_identities(spark, sf_dir):
    """Voices of chunks brought together: vectors by four recordings of ten chunks. Python."""
    e = table(spark, sf_dir, "embeddings").where("label is not null").withColumn("recording", F.col("vec_id") % 4).withColumn("chunk", F.floor(F.col("vec_id") / 4) % 10)
    first = e.groupBy("recording", "chunk", "label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return signals.across_chunks(first, "recording", "chunk", "label", "embedding")


def emotion_dispatch(spark, sf_dir):
    """Label of each line by the mode of its job: the source's own, none, a model's (stood in for by its confidences), or by words."""
    x = _confident(spark, sf_dir)
    v = F.array(F.coalesce("tc", F.lit(0.0)), F.coalesce("ac", F.lit(0.0)), F.coalesce("sc", F.lit(0.0)))
    model = F.element_at(F.array(*map(F.lit, t.EMOTIONS[:3])), F.array_position(v, F.array_max(v)).cast("int"))
    label = F.when(F.col("cue_id") % 4 == 0, "source performance").when(F.col("cue_id") % 4 == 1, "calm").when(F.col("cue_id") % 4 == 2, model).otherwise(F.coalesce(t.emotion(F.col("english")), F.lit("calm")))
    return x.select("job_id", "cue_id", label.alias("label"))


def sheet_lines(spark, sf_dir):
    """Ten columns of a cue sheet as one CSV line each, numbered by speech."""
    w = Window.partitionBy("job_id").orderBy("l_start", "cue_id")
    r = review_reasons(spark, sf_dir).withColumnRenamed("cue_id", "rc").withColumnRenamed("job_id", "rj")
    c = cues(spark, sf_dir, "speaker_id", "source", "english")
    x = c.join(r.distinct(), (F.col("job_id") == F.col("rj")) & (F.col("cue_id") == F.col("rc"))).withColumn("no", F.row_number().over(w))
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    speaker = F.when(F.coalesce("speaker_id", F.lit(0)) == 0, "Uncertain voice").otherwise(F.concat(F.lit("Voice "), F.col("speaker_id").cast("string")))
    fields = [F.col("no").cast("string"), F.col("l_start").cast("string"), F.col("l_end").cast("string"), quoted(speaker), quoted(F.col("source")), quoted(F.col("english")), quoted(F.col("english")), t.emotion(F.coalesce("english", F.lit(""))), (F.col("n") > 0).cast("string"), quoted(F.col("reasons"))]
    return x.select("job_id", "cue_id", F.concat_ws(",", *fields).alias("line"))


def flagged_report(spark, sf_dir):
    """What a report shows of each job: its result and its flagged lines."""
    r = review_reasons(spark, sf_dir)
    g = r.groupBy("job_id").agg(F.count(F.lit(1)).alias("cues"), F.sort_array(F.collect_list(F.when(F.col("n") > 5, F.struct("cue_id", "n")))).alias("f"))
    return g.select("job_id", "cues", F.size("f").cast("bigint").alias("flagged"), F.when(F.size("f") > 0, "needs_review").otherwise("passed").alias("result"), F.array_join(F.transform("f", lambda x: F.concat_ws(":", x["cue_id"].cast("string"), x["n"].cast("string"))), " ").alias("lines"))


def resolved_projects(spark, sf_dir):
    """Names brought together to projects: by the key of kind, title and year, or by the catalogue entry of that title and kind, whose project takes in the others; what is missing is filled, the first told stays."""
    n = table(spark, sf_dir, "media_names").where("normalized_title <> '' and media_type is not null").select("name_id", "title", "normalized_title", "media_year", "media_type").distinct()
    key = F.concat_ws(":", "media_type", "normalized_title", F.coalesce(F.col("media_year").cast("string"), F.lit("")))
    c = table(spark, sf_dir, "catalogue").groupBy(normalize_title("title").alias("k"), F.col("media_type").alias("kind")).agg(F.min("catalogue_id").alias("external"))
    x = n.withColumn("key", key).join(c, (F.col("normalized_title") == F.col("k")) & (F.col("media_type") == F.col("kind")), "left").withColumn("group", F.coalesce(F.concat(F.lit("x:"), F.col("external").cast("string")), F.col("key")))
    g = x.groupBy("group").agg(F.min_by("key", "name_id").alias("lookup_key"), F.count(F.lit(1)).alias("names"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("name_id"))).alias("title"), F.min_by("media_year", F.when(F.col("media_year").isNotNull(), F.col("name_id"))).alias("year"), F.max("external").alias("external"))
    return g.select(F.concat(F.lit("p"), F.substring(F.sha2("lookup_key", 256), 1, 15)).alias("project_id"), "lookup_key", "names", "title", "year", "external")


def realigned_context(spark, sf_dir):
    """Cues moved into a wider context, given to the voice that speaks longest there, and moved back; their state is taken back."""
    shift = 1500
    c = cues(spark, sf_dir).select("job_id", "cue_id", (F.col("l_start") + shift).alias("l_start"), (F.col("l_end") + shift).alias("l_end"))
    v = overlap_pairs(c, turns(spark, sf_dir), ["job_id"]).groupBy("job_id", "cue_id", "l_start", "l_end", "speaker").agg(F.sum("overlap_ms").alias("ms"))
    top = v.groupBy("job_id", "cue_id", "l_start", "l_end").agg(F.max("ms").alias("ms")).join(v, ["job_id", "cue_id", "l_start", "l_end", "ms"]).groupBy("job_id", "cue_id", "l_start", "l_end").agg(F.min("speaker").alias("speaker"))
    back = c.join(top, ["job_id", "cue_id", "l_start", "l_end"], "left")
    return back.select("job_id", "cue_id", (F.col("l_start") - shift).alias("start_ms"), (F.col("l_end") - shift).alias("end_ms"), "speaker", F.lit("waiting").alias("status"))


def zipped_results(spark, sf_dir):
    """Lines of a job with the results numbered like them: places are made keys before the join."""
    w = Window.partitionBy("job_id").orderBy("l_start", "cue_id", "l_end")
    c = cues(spark, sf_dir).withColumn("no", F.row_number().over(w))
    ends = c.select("job_id", "no", F.col("l_end").alias("result"))
    return c.select("job_id", "cue_id", "no").join(ends, ["job_id", "no"], "left").select("job_id", "cue_id", F.col("no").cast("bigint").alias("no"), "result")


def agreed_windows(spark, sf_dir):
    """Minutes of a job read twice (first readings, and edited ones as those of a higher model): one side of each, and its lines' confidence. Matching blocks in Python."""
    x = _confident(spark, sf_dir).withColumn("minute", F.floor(F.col("l_start") / 60_000))
    got = gates.agreed_windows(x.where("status = 'done'"), x.where("status in ('edited', 'voiced')"), ["job_id", "minute"], "source", "ac", ["l_start", "cue_id"])
    return got.select("job_id", "minute", "cue_id", "side", milli(F.col("agreement")).alias("agreement_milli"), milli(F.col("confidence")).alias("confidence_milli"))


def document_fields(spark, sf_dir):
    """Fields of stored documents, nested ones among them, out of their JSON."""
    j = table(spark, sf_dir, "jobs").where("job_id is not null").select(F.to_json(F.struct("job_id", "filename", "status", "stage", "media_kind", F.struct("source_language", "control").alias("options"))).alias("d")).distinct()
    get = lambda p: F.get_json_object("d", p)
    return j.select(get("$.job_id").alias("job_id"), get("$.filename").alias("filename"), get("$.status").alias("status"), get("$.stage").alias("stage"), get("$.media_kind").alias("media_kind"), get("$.options.source_language").alias("source_language"), get("$.options.control").alias("control"))


QUERIES = {
    f.__name__: f
    for f in [
        created_visual_voices, face_margins, verification_budget, performance_parts, voice_similarities, dialogue_leakage, crossfaded, mixed_timeline, fitted_takes, corrected_lines, joined_identities, emotion_dispatch, sheet_lines, flagged_report, resolved_projects,
        realigned_context, zipped_results, agreed_windows, document_fields,
    ]
}

_P = "e as (select vec_id, label, cast(embedding as double[]) as a from embeddings where label is not null), p as (select *, lead(a) over (partition by label order by vec_id) as b from e), q as (select vec_id, a, b from p where b is not null)"
_L = "i as (select vec_id, unnest(a) as x, unnest(b) as y, unnest(range(len(a))) as k, len(a) as n from q)"
_PACE = "greatest(cast(0.35 as double), len(regexp_extract_all(english, '[A-Za-z0-9_'']+')) / cast(3.39 as double) + cast(0.06 as double) * (length(english) - length(replace(english, ',', ''))) + cast(0.08 as double) * (length(english) - length(replace(english, '.', ''))))"
_Q = "'\"' || replace(coalesce({0}, ''), '\"', '\"\"') || '\"'"
SQL = {
    "created_visual_voices": f"""{_SEEN.replace("x.sc, q.m.f", "x.sc, x.l_start, x.l_end, coalesce(q.m.m, false) as mouth, q.m.f")}, w as (select job_id, face, speaker_id, sum(cast(floor(vis * sc * 1000000 + 0.5) as bigint)) as w from v where face is not null and vis >= 0.70 and sc >= 0.75 and speaker_id is not null group by 1, 2, 3),
a as (select job_id, face from w group by 1, 2 having max(w) * 10 >= sum(w) * 6 and sum(w) > 0), f as (select * from v where mouth and vis >= 0.82 and (coalesce(sc, 0) < 0.62 or vis > coalesce(sc, 0) + 0.18e0) and not exists (select 1 from a where a.job_id = v.job_id and a.face = v.face)),
g as (select job_id, face, count(*) as n, sum(l_end - l_start) as ms, min({{'s': l_start, 'c': cue_id}}) as first from f group by 1, 2 having count(*) >= 2 and sum(l_end - l_start) >= 650), k as (select job_id, max(coalesce(speaker_id, 0)) as known from x group by 1)
select g.job_id, face, cast(known + row_number() over (partition by g.job_id order by first, face) as bigint) as new_speaker_id, {_M.format('least(0.86e0, 0.62e0 + 0.08e0 * n)')} as confidence_milli from g join k on g.job_id = k.job_id""",
    "face_margins": f"""with s as (select distinct sighting_id, job_id, speaker_id, active_face_id as face_id, active_speaker_confidence as c, case when coalesce(mouth_visible, false) then 1 else 0 end as seen from face_sightings where speaker_id > 0 and active_face_id is not null and job_id is not null and active_speaker_confidence > 0 and not isnan(active_speaker_confidence)),
g as (select job_id, speaker_id, face_id, quantile_cont(c, 0.7) as motion, avg(seen) as visible, count(*) as n, 0.0008e0 * (1 + face_id % 5) as area from s group by 1, 2, 3), z as (select *, 0.05e0 * motion * least(1e0, visible / 0.55e0) * least(1e0, area / 0.003e0) as score from g),
r as (select *, coalesce(lead(score) over (partition by job_id, speaker_id order by score desc, face_id), 0) as nx, n / sum(n) over (partition by job_id, speaker_id) as single, row_number() over (partition by job_id, speaker_id order by score desc, face_id) as rn from z),
k as (select *, {_M.format('least(1e0, score / 0.035e0) * least(1e0, (score - nx) / 0.012e0) * least(1e0, visible / 0.55e0) * least(1e0, single / 0.6e0)')} as m from r where rn = 1) select job_id, speaker_id, face_id, m as confidence_milli, m >= 560 as active, m >= 560 and visible >= 0.55e0 and area >= 0.0012e0 as mouth_visible from k""",
    "verification_budget": f"{_WITH}, r as (select job_id, cue_id, {_M.format('1 - coalesce(tc, 0) + case when cue_id % 3 = 0 then 0.35e0 else 0 end + greatest(0e0, 0.85e0 - coalesce(ac, 0))')} as risk_milli from x where length(trim(source)) > 0 and l_end - l_start >= 350 and lower(coalesce(source_language, '')) not in ('', 'en', 'eng', 'english') and cue_id % 10 <> 0) select * from r order by risk_milli desc, job_id, cue_id limit 150",
    "performance_parts": f"""with {_P}, {_L}, c as (select vec_id, corr(x, y) as r, stddev_pop(x) as sx, stddev_pop(y) as sy, avg(abs(x - y)) as m from i where k < 10 group by 1),
z as (select q.vec_id, greatest(-1e0, least(1e0, case when sx > 0.03 and sy > 0.03 then r else 1 - m end)) as s, abs(abs(a[11]) - abs(b[11])) as pd, case when a[12] > 0 and b[12] > 0 then abs(12 * log2(b[12] / a[12])) end as off from q join c on q.vec_id = c.vec_id)
select vec_id, {_M.format('((s + 1) / 2 * 0.4e0 + greatest(0e0, 1 - pd / 0.55e0) * 0.2e0 + coalesce(greatest(0e0, 1 - off / 6) * 0.4e0, 0)) / (0.4e0 + 0.2e0 + case when off is null then 0 else 0.4e0 end)')} as similarity_milli from z""",
    "voice_similarities": f"with {_P}, {_L}, d as (select vec_id, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) as s from i group by 1) select vec_id, {_M.format('s')} as similarity_milli, vec_id % 4 >= 2 as reliable from d",
    "dialogue_leakage": f"with {_P}, {_L}, d as (select vec_id, abs(corr(x, y)) * least(1e0, sqrt(avg(y * y)) / greatest(sqrt(avg(x * x)), 1e-9)) as s from i group by 1) select vec_id, {_M.format('s')} as leakage_milli from d",
    "crossfaded": f"with {_P}, {_L}, d as (select vec_id, sum(pow(x * pow(cos(pi() / 2 * k / (n - 1)), 2) + y * pow(sin(pi() / 2 * k / (n - 1)), 2), 2)) as s from i group by 1) select vec_id, {_M.format('s')} as energy_milli from d",
    "mixed_timeline": "with i as (select vec_id * 16 + unnest(range(len(embedding))) as frame, floor(cast(unnest(embedding) as double) * 1000 + 0.5) as x from embeddings), s as (select frame, sum(x) as x from i group by 1), m as (select max(abs(x)) as top from s) select frame, cast(floor(x * least(1e0, 980e0 / greatest(top, 1e-9)) + 0.5) as bigint) as milli from s, m",
    "fitted_takes": f"""with {sql_cues('english')}, y as (select job_id, cue_id, {_PACE} as made, (l_end - l_start) / 1000e0 as want from c where english is not null), z as (select *, least(1.08e0, greatest(0.92e0, made / want)) as tempo from y), v as (select *, greatest(0e0, want - made / tempo) * 1000 as pad, greatest(0e0, made / tempo - want) * 1000 as cut from z)
select job_id, cue_id, {_M.format('tempo')} as tempo_milli, cast(floor(pad + 0.5) as bigint) as padding_ms, cast(floor(cut + 0.5) as bigint) as truncated_ms, pad <= 160 and cut <= 40 as ok from v""",
    "corrected_lines": f"""with {sql_cues('english')}, y as (select job_id, cue_id, l_end - l_start as ms, cast(floor({_PACE} * 1000 + 0.5) as bigint) as n0 from c where english is not null), a as (select *, case when n0 > ms then n0 * 9 // 10 else n0 end as n1 from y), b as (select *, case when n1 > ms then n1 * 9 // 10 else n1 end as n2 from a), d as (select *, case when n2 > ms then n2 * 9 // 10 else n2 end as n3 from b)
select job_id, cue_id, cast(case when n0 > ms then 1 else 0 end + case when n1 > ms then 1 else 0 end + case when n2 > ms then 1 else 0 end as bigint) as attempts, cast(n3 as bigint) as need, n3 <= ms as fits from d""",
    "flagged_report": f"{_REASONED}, g as (select job_id, count(*) as cues, count(*) filter (where n > 5) as flagged, coalesce(string_agg(cast(cue_id as varchar) || ':' || cast(n as varchar), ' ' order by cue_id, n) filter (where n > 5), '') as lines from r group by 1) select job_id, cues, flagged, case when flagged > 0 then 'needs_review' else 'passed' end as result, lines from g",
    "resolved_projects": r"""with n as (select distinct name_id, title, normalized_title, media_year, media_type from media_names where normalized_title <> '' and media_type is not null), c as (select trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')) as k, media_type as kind, min(catalogue_id) as external from catalogue group by 1, 2),
x as (select n.*, media_type || ':' || normalized_title || ':' || coalesce(cast(media_year as varchar), '') as key, external from n left join c on normalized_title = k and media_type = kind), y as (select *, coalesce('x:' || cast(external as varchar), key) as grp from x),
g as (select grp, arg_min(key, name_id) as lookup_key, count(*) as names, arg_min(title, name_id) filter (where title is not null) as title, arg_min(media_year, name_id) filter (where media_year is not null) as year, max(external) as external from y group by 1) select 'p' || sha256(lookup_key)[1:15] as project_id, lookup_key, names, title, year, external from g""",
    "realigned_context": f"""with {sql_cues()}, {TURNS}, m as (select job_id, cue_id, l_start, l_end, l_start + 1500 as s, l_end + 1500 as e from c), o as (select m.job_id, m.cue_id, m.l_start, m.l_end, speaker, sum(least(e, r_end) - greatest(s, r_start)) as ms from m join t on m.job_id = t.job_id and r_start < e and s < r_end group by 1, 2, 3, 4, 5),
r as (select *, row_number() over (partition by job_id, cue_id, l_start, l_end order by ms desc, speaker) as rn from o) select m.job_id, m.cue_id, m.l_start as start_ms, m.l_end as end_ms, speaker, 'waiting' as status from m left join r on m.job_id = r.job_id and m.cue_id = r.cue_id and m.l_start = r.l_start and m.l_end = r.l_end and rn = 1""",
    "zipped_results": f"with {sql_cues()} select job_id, cue_id, row_number() over (partition by job_id order by l_start, cue_id, l_end) as no, l_end as result from c",
    "document_fields": "select distinct job_id, filename, status, stage, media_kind, source_language, control from jobs where job_id is not null",
}
