"""Interval joins, voting, nearest assignment and window allocation over cues and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.operators import overlap as o
from cuemill.operators.intervals import to_ms
from cuemill.plans.tables import MS, TURNS, cues, sql_cues, turns
from cuemill.session import table


def speaker_vote_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.vote_speakers(cues(spark, sf_dir).withColumn("card_rank", F.lit(0)), turns(spark, sf_dir))


def simultaneous_card_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As speaker_vote_by_overlap, each odd cue taken for the second of two cards shown at once."""
    return o.vote_speakers(cues(spark, sf_dir).withColumn("card_rank", (F.col("cue_id") % 2).cast("int")), turns(spark, sf_dir))


def first_seen_speaker_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.first_seen_numbers(turns(spark, sf_dir), ["job_id"], "speaker", "r_start", "r_end")


def nearest_interval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sighting with the cue nearest in time (0 inside it), at most 550 ms away; of equals the smaller cue_id."""
    seen = table(spark, sf_dir, "face_sightings").where("job_id is not null").select("job_id", "sighting_id", to_ms(F.col("at_s")).alias("p_at")).where("p_at is not null").distinct()
    c = cues(spark, sf_dir).withColumnsRenamed({"l_start": "r_start", "l_end": "r_end"})
    best = o.point_pairs(seen, c, ["job_id"], 550).groupBy("sighting_id").agg(F.min(F.struct("distance_ms", "cue_id", "job_id")).alias("b"))
    return best.select("sighting_id", "b.job_id", "b.cue_id", "b.distance_ms")


def overlap_evidence_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cues with the labels of the turns that overlap them by more than 50 ms, in the order of the turns."""
    c = cues(spark, sf_dir)
    got = o.overlap_pairs(c, turns(spark, sf_dir), ["job_id"], 50).groupBy("job_id", "cue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r_start", "r_end", "speaker"))), lambda x: x["speaker"]), " ").alias("evidence"))
    return c.join(got, ["job_id", "cue_id"], "left").select("job_id", "cue_id", "evidence")


def max_overlap_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn with the greatest (overlap, label) of each cue that any turn overlaps."""
    got = o.overlap_pairs(cues(spark, sf_dir), turns(spark, sf_dir), ["job_id"]).groupBy("job_id", "cue_id").agg(F.max(F.struct("overlap_ms", "speaker")).alias("m"))
    return got.select("job_id", "cue_id", "m.overlap_ms", "m.speaker")


def self_overlap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that another cue of the job overlaps by more than 80 ms; their speaker confidence is capped at .45."""
    c = cues(spark, sf_dir, "speaker_confidence")
    other = c.select("job_id", F.col("cue_id").alias("other_id"), F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end"))
    hit = o.overlap_pairs(c.select("job_id", "cue_id", "l_start", "l_end"), other, ["job_id"], 80).where("cue_id <> other_id").select("job_id", "cue_id").distinct().withColumn("hit", F.lit(True))
    flag = F.coalesce("hit", F.lit(False))
    sure = F.coalesce(F.nanvl("speaker_confidence", F.lit(None).cast("double")), F.lit(0.0))
    return c.join(hit, ["job_id", "cue_id"], "left").select("job_id", "cue_id", flag.alias("overlapping"), o.milli(F.when(flag, F.least(sure, F.lit(0.45))).otherwise(sure)).alias("confidence_milli"))


def uncovered_intervals_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues that no turn overlaps by more than 50 ms."""
    c = cues(spark, sf_dir)
    return c.join(o.overlap_pairs(c, turns(spark, sf_dir), ["job_id"], 50).select("job_id", "cue_id"), ["job_id", "cue_id"], "left_anti").select("job_id", "cue_id", "l_start", "l_end")


def reconcile_with_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues widened to the turns found in them (by half a second at most), and what only the turns have, appended."""
    c = cues(spark, sf_dir)
    got = o.overlap_pairs(c, turns(spark, sf_dir), ["job_id"], 40).groupBy("job_id", "cue_id").agg(F.min("r_start").alias("first"), F.max("r_end").alias("last"), F.count(F.lit(1)).alias("hits"))
    kept = c.join(got, ["job_id", "cue_id"], "left").select(
        "job_id", F.col("cue_id"), F.when(F.col("first").isNull(), F.col("l_start")).otherwise(F.greatest(F.col("l_start") - 500, "first")).alias("start_ms"), F.when(F.col("last").isNull(), F.col("l_end")).otherwise(F.least(F.col("l_end") + 500, "last")).alias("end_ms"), F.coalesce("hits", F.lit(0)).alias("hits")
    )
    t = turns(spark, sf_dir)
    covered = o.overlap_pairs(t.withColumnsRenamed({"r_start": "l_start", "r_end": "l_end"}), c.select("job_id", F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end")), ["job_id"], 50)
    extra = t.join(covered.select("job_id", "speaker", F.col("l_start").alias("r_start"), F.col("l_end").alias("r_end")), ["job_id", "speaker", "r_start", "r_end"], "left_anti")
    return kept.unionByName(extra.groupBy("job_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).agg(F.lit(0).cast("bigint").alias("hits")).withColumn("cue_id", F.lit(0).cast("bigint")))


def clip_and_shift_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.clip_and_shift(cues(spark, sf_dir), "l_start", "l_end", 30_000, 90_000).select("job_id", "cue_id", F.col("l_start").alias("start_ms"), F.col("l_end").alias("end_ms"))


def split_long_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = o.split_long(turns(spark, sf_dir), "r_start", "r_end", 1_000, 200)
    return got.select("job_id", "speaker", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).distinct()


def allocate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each cue may be spoken: to its end and a little more, but not into the next line.

    The next line is the earliest that starts more than 20 ms later. The extension is 1200 ms; a window shorter than
    550 ms is made 620 ms long; it ends 30 ms before the next line, but never before the cue itself.
    """
    c = cues(spark, sf_dir)
    # Latest first: a frame that only grows is summed up once, one that shrinks is read anew for each row.
    w = Window.partitionBy("job_id").orderBy(F.desc("l_start")).rangeBetween(Window.unboundedPreceding, -21)
    following = c.withColumn("next_ms", F.min("l_start").over(w))
    wanted = F.col("l_end") + 1200
    wanted = F.when(wanted - F.col("l_start") < 550, F.col("l_start") + 620).otherwise(wanted)
    end = F.when(F.col("next_ms").isNull(), wanted).otherwise(F.least(wanted, F.greatest("l_end", F.col("next_ms") - 30)))
    return following.select("job_id", "cue_id", F.col("l_start").alias("start_ms"), end.alias("window_end_ms"), "next_ms")


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of cues of one speaker with pauses of at most 620 ms between them."""
    c = cues(spark, sf_dir, "speaker_id").where("speaker_id > 0")
    w = Window.partitionBy("job_id", "speaker_id").orderBy("l_start", "l_end", "cue_id")
    seen = F.max("l_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = c.withColumn("new", F.coalesce((F.col("l_start") - seen > 620).cast("bigint"), F.lit(1)))
    runs = marked.withColumn("session_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("job_id", "speaker_id", "session_no").agg(F.min("l_start").alias("start_ms"), F.max("l_end").alias("end_ms"), F.count(F.lit(1)).alias("cues"))


def speech_between_silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complement of silences of 240 ms or more between the cues of a job, 250 ms wider on both sides."""
    c = cues(spark, sf_dir)
    w = Window.partitionBy("job_id").orderBy("l_start", "l_end", "cue_id")
    seen = F.max("l_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = c.withColumn("new", F.coalesce((F.col("l_start") - seen >= 240).cast("bigint"), F.lit(1)))
    runs = marked.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("job_id", "no").agg(F.greatest(F.min("l_start") - 250, F.lit(0)).alias("start_ms"), (F.max("l_end") + 250).alias("end_ms"))


QUERIES = {
    f.__name__: f
    for f in [
        speaker_vote_by_overlap, simultaneous_card_vote, first_seen_speaker_numbers, nearest_interval_assign, overlap_evidence_attach, max_overlap_attach, self_overlap_flag, uncovered_intervals_anti,
        reconcile_with_turns, clip_and_shift_range, split_long_intervals, allocate_windows, gap_sessions, speech_between_silences,
    ]
}

_PAIRS = "p as (select c.job_id, c.cue_id, l_start, l_end, speaker, r_start, r_end, least(l_end, r_end) - greatest(l_start, r_start) as ov from c join t on c.job_id = t.job_id and l_start < r_end and r_start < l_end)"
_MILLI = "cast(floor(({0}) * 1000 + 0.5) as bigint)"


def _vote(rank: str) -> str:
    return f"""with {sql_cues()}, {TURNS}, {_PAIRS},
num as (select job_id, speaker, row_number() over (partition by job_id order by fs, fe, speaker) as number from
  (select job_id, speaker, min(r_start) as fs, min_by(r_end, r_start * 1000000000 + r_end) as fe from t group by 1, 2)),
v as (select job_id, cue_id, speaker, sum(ov) as ms, max(ov) as most from p group by 1, 2, 3),
side as (select job_id, cue_id, count(*) > 1 as overlapping from v where most > 80 group by 1, 2),
allv as (select c.job_id, c.cue_id, num.speaker, num.number, coalesce(v.ms, 0) as ms from c join num on c.job_id = num.job_id
  left join v on v.job_id = c.job_id and v.cue_id = c.cue_id and v.speaker = num.speaker where v.ms is not null or {rank} > 0),
r as (select *, row_number() over (partition by job_id, cue_id order by ms desc, number) - 1 as rk, count(*) over (partition by job_id, cue_id) - 1 as lst from allv),
k as (select * from r where rk = least({rank}, lst)),
f as (select c.job_id, c.cue_id, k.number, k.ms, coalesce(overlapping, false) as overlapping, coalesce(k.ms, 0) / greatest(l_end - l_start, 50) as share, k.ms is not null and coalesce(k.ms, 0) / greatest(l_end - l_start, 50) >= 0.3 as sure
  from c left join k on c.job_id = k.job_id and c.cue_id = k.cue_id left join side on c.job_id = side.job_id and c.cue_id = side.cue_id),
g as (select *, case when sure then least(cast(0.95 as double), cast(0.45 as double) + cast(0.5 as double) * share) * case when overlapping then cast(0.62 as double) else cast(1 as double) end else cast(0 as double) end as conf from f)
select job_id, cue_id, cast(case when sure then number else 0 end as bigint) as speaker_no, cast(coalesce(ms, 0) as bigint) as overlap_ms, overlapping,
  {_MILLI.format('conf')} as confidence_milli, case when not sure then 'uncertain' when conf >= 0.62 then 'confident' else 'tentative' end as verdict from g"""


SQL = {
    "speaker_vote_by_overlap": _vote("0"),
    "simultaneous_card_vote": _vote("(cue_id % 2)").replace("or (cue_id % 2) > 0", "or (c.cue_id % 2) > 0"),
    "first_seen_speaker_numbers": f"with {TURNS} select job_id, speaker, cast(row_number() over (partition by job_id order by f.s, f.e, speaker) as bigint) as number from (select job_id, speaker, min({{'s': r_start, 'e': r_end}}) as f from t group by 1, 2)",
    "nearest_interval_assign": f"""with {sql_cues()}, s as (select distinct job_id, sighting_id, {MS.format('at_s')} as p_at from face_sightings where at_s is not null and not isnan(at_s)),
d as (select sighting_id, s.job_id, cue_id, greatest(l_start - p_at, p_at - l_end, 0) as distance_ms from s join c on s.job_id = c.job_id where greatest(l_start - p_at, p_at - l_end, 0) <= 550),
r as (select *, row_number() over (partition by sighting_id order by distance_ms, cue_id, job_id) as rn from d) select sighting_id, job_id, cue_id, distance_ms from r where rn = 1""",
    "overlap_evidence_attach": f"""with {sql_cues()}, {TURNS}, {_PAIRS} select c.job_id, c.cue_id, e.evidence from c left join
(select job_id, cue_id, string_agg(speaker, ' ' order by r_start, r_end, speaker) as evidence from p where ov > 50 group by 1, 2) e on c.job_id = e.job_id and c.cue_id = e.cue_id""",
    "max_overlap_attach": f"""with {sql_cues()}, {TURNS}, {_PAIRS}, r as (select *, row_number() over (partition by job_id, cue_id order by ov desc, speaker desc) as rn from p) select job_id, cue_id, ov as overlap_ms, speaker from r where rn = 1""",
    "self_overlap_flag": f"""with {sql_cues('speaker_confidence')}, h as (select distinct a.job_id, a.cue_id from c a join c b on a.job_id = b.job_id and a.cue_id <> b.cue_id and least(a.l_end, b.l_end) - greatest(a.l_start, b.l_start) > 80),
f as (select c.job_id, c.cue_id, h.cue_id is not null as overlapping, case when speaker_confidence is null or isnan(speaker_confidence) then cast(0 as double) else speaker_confidence end as sc from c left join h on c.job_id = h.job_id and c.cue_id = h.cue_id)
select job_id, cue_id, overlapping, {_MILLI.format("case when overlapping then least(sc, cast(0.45 as double)) else sc end")} as confidence_milli from f""",
    "uncovered_intervals_anti": f"with {sql_cues()}, {TURNS}, {_PAIRS} select job_id, cue_id, l_start, l_end from c where not exists (select 1 from p where p.job_id = c.job_id and p.cue_id = c.cue_id and ov > 50)",
    "reconcile_with_turns": f"""with {sql_cues()}, {TURNS}, {_PAIRS}, g as (select job_id, cue_id, min(r_start) as f, max(r_end) as l, count(*) as hits from p where ov > 40 group by 1, 2)
select c.job_id, c.cue_id, coalesce(case when f is not null then greatest(l_start - 500, f) end, l_start) as start_ms, coalesce(case when l is not null then least(l_end + 500, l) end, l_end) as end_ms, coalesce(hits, 0) as hits from c left join g on c.job_id = g.job_id and c.cue_id = g.cue_id
union all select distinct job_id, cast(0 as bigint), r_start, r_end, cast(0 as bigint) from t where not exists (select 1 from p where p.job_id = t.job_id and p.speaker = t.speaker and p.r_start = t.r_start and p.r_end = t.r_end and ov > 50)""",
    "clip_and_shift_range": f"with {sql_cues()} select job_id, cue_id, greatest(l_start, 30000) - 30000 as start_ms, least(l_end, 90000) - 30000 as end_ms from c where least(l_end, 90000) > greatest(l_start, 30000)",
    "split_long_intervals": f"""with {TURNS}, x as (select *, unnest(generate_series(r_start, r_end - 1, 1000)) as p from t)
select distinct job_id, speaker, p as start_ms, least(r_end, p + 1000) as end_ms from x where least(r_end, p + 1000) - p >= 200""",
    "allocate_windows": f"""with {sql_cues()}, n as (select a.job_id, a.cue_id, a.l_start, a.l_end, (select min(b.l_start) from c b where b.job_id = a.job_id and b.l_start > a.l_start + 20) as next_ms from c a),
w as (select *, case when l_end + 1200 - l_start < 550 then l_start + 620 else l_end + 1200 end as want from n)
select job_id, cue_id, l_start as start_ms, case when next_ms is null then want else least(want, greatest(l_end, next_ms - 30)) end as window_end_ms, next_ms from w""",
    "gap_sessions": f"""with {sql_cues('speaker_id')}, m as (select *, max(l_end) over (partition by job_id, speaker_id order by l_start, l_end, cue_id rows between unbounded preceding and 1 preceding) as seen from c where speaker_id > 0),
r as (select *, sum(case when seen is null or l_start - seen > 620 then 1 else 0 end) over (partition by job_id, speaker_id order by l_start, l_end, cue_id rows between unbounded preceding and current row) as session_no from m)
select job_id, speaker_id, cast(session_no as bigint) as session_no, min(l_start) as start_ms, max(l_end) as end_ms, count(*) as cues from r group by 1, 2, 3""",
    "speech_between_silences": f"""with {sql_cues()}, m as (select *, max(l_end) over (partition by job_id order by l_start, l_end, cue_id rows between unbounded preceding and 1 preceding) as seen from c),
r as (select *, sum(case when seen is null or l_start - seen >= 240 then 1 else 0 end) over (partition by job_id order by l_start, l_end, cue_id rows between unbounded preceding and current row) as no from m)
select job_id, cast(no as bigint) as no, greatest(min(l_start) - 250, 0) as start_ms, max(l_end) + 250 as end_ms from r group by 1, no""",
}
