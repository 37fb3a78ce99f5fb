"""Voice vectors, folds, versioned tables and set operations; and Spark-native relational work over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.operators import folds, store, vectors
from cuemill.operators.overlap import milli
from cuemill.plans.tables import cues, sql_cues
from cuemill.session import shared_dir, table
from cuemill.streaming import windows

_M = "cast(floor(({0}) * 1000 + 0.5) as bigint)"


def centroids(spark, sf_dir):
    c = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x"), "n").select("label", F.col("pos").cast("bigint").alias("pos"), milli(F.col("x")).alias("x_milli"), "n")


def _sims(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return vectors.against_all(e, vectors.centroids(e, "label", "embedding"), "vec_id", "label", "embedding")


def own_vs_other_similarity(spark, sf_dir):
    return _sims(spark, sf_dir).select("vec_id", "label", milli(F.col("own")).alias("own_milli"), milli(F.col("other")).alias("other_milli"), "nearest")


def outlier_flag(spark, sf_dir):
    """Vectors unlike their own label: below .40, or another label is nearer by more than .05."""
    s = _sims(spark, sf_dir)
    return s.select("vec_id", ((F.col("own") < 0.40) | (F.col("other") > F.col("own") + 0.05)).alias("outlier"), milli(F.greatest(F.lit(0.35), F.least(F.lit(0.95), 0.60 + 0.35 * (F.col("own") - F.col("other"))))).alias("confidence_milli"))


def agglomerative_clusters(spark, sf_dir):
    return vectors.cluster_groups(table(spark, sf_dir, "embeddings").where("label is not null"), "label", "vec_id", "embedding", 0.8, 0.9)


def gap_duration_sessions(spark, sf_dir):
    """Cues of a speaker grouped by pauses, length and sentence ends; folded in parts between pauses that end a group anyway."""
    c = cues(spark, sf_dir, "speaker_id", "source").where("speaker_id > 0").withColumn("stop", F.coalesce(F.col("source").rlike("[.!?。！？]\\s*$"), F.lit(False)))
    # Any pause over 620 ends a group; cutting at long ones only keeps the parts from being tiny.
    return folds.group_by_gap_and_duration(folds.parts(c, ["job_id", "speaker_id"], "l_start", "l_end", 30_000), ["job_id", "speaker_id", "part"], "l_start", "l_end", "stop")


def listening_windows(spark, sf_dir):
    """Windows around cues; folded in parts between pauses that end a window anyway."""
    # Hints widened by 650 at both ends are merged while less than 3000 apart.
    return folds.merge_windows(folds.parts(cues(spark, sf_dir), ["job_id"], "l_start", "l_end", 3_000 + 2 * 650), ["job_id", "part"], "l_start", "l_end")


def upsert_latest_wins(spark, sf_dir):
    """Customers with the latest order's priority as a change: large orders overwrite, others fill gaps."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"))
    o = store.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    change = o.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("segment"), (F.col("o_totalprice") > 200_000).alias("over"))
    return store.upsert(c, change, "c_custkey", ["segment"], "over")


def job_state_after_control(spark, sf_dir):
    j = store.latest(table(spark, sf_dir, "jobs").where("job_id is not null"), ["job_id"], [F.desc("updated_at"), "status"])
    return j.select("job_id", store.apply_control(F.col("status"), F.col("control")).alias("status_after"), store.recover(F.col("status")).alias("status_restarted"))


def split_and_renumber(spark, sf_dir):
    """Cues over three seconds cut in the middle, all numbered anew."""
    c = cues(spark, sf_dir)
    at = F.when(F.col("l_end") - F.col("l_start") > 3000, F.floor((F.col("l_start") + F.col("l_end")) / 2))
    return store.split_row(c, "job_id", "cue_id", "l_start", "l_end", at).select("job_id", "cue_id", "l_start", "l_end")


def merge_short_with_next(spark, sf_dir):
    """Cues under a second joined with the next one, all numbered anew."""
    c = cues(spark, sf_dir, "english")
    return store.merge_with_next(c, "job_id", "cue_id", "l_start", "l_end", "english", F.col("l_end") - F.col("l_start") < 1000).select("job_id", "cue_id", "l_start", "l_end", "english")


def multiset_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")))


def sequence_equality(spark, sf_dir):
    """Jobs whose cues come in the order of their numbers."""
    c = cues(spark, sf_dir).groupBy("job_id").agg(F.sort_array(F.collect_list("cue_id")).alias("a"), F.sort_array(F.collect_list(F.struct("l_start", "cue_id"))).alias("b"))
    return c.select("job_id", (F.col("a") == F.transform("b", lambda x: x["cue_id"])).alias("in_order"))


def metadata_difference(spark, sf_dir):
    """Fields in which the versions of a job differ."""
    j = table(spark, sf_dir, "jobs").where("job_id is not null").select("job_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("-")).alias("v")) for c in ("filename", "status", "control", "stage", "media_kind", "source_language")])).alias("x"))
    return j.groupBy("job_id", "x.field").agg(F.countDistinct("x.v").alias("values")).where("values > 1")


def visual_evidence_lookup(spark, sf_dir):
    """Cues with the number and best confidence of their speaker's sightings in the job; none is zero."""
    s = table(spark, sf_dir, "face_sightings").where("job_id is not null and speaker_id > 0").select("sighting_id", "job_id", "speaker_id", F.when(~F.isnan("active_speaker_confidence"), F.col("active_speaker_confidence")).alias("c")).distinct()
    g = s.groupBy("job_id", "speaker_id").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("best"))
    return cues(spark, sf_dir, "speaker_id").join(g, ["job_id", "speaker_id"], "left").select("job_id", "cue_id", F.coalesce("n", F.lit(0)).alias("sightings"), milli(F.coalesce("best", F.lit(0.0))).alias("best_milli"))


def jobs_with_cues(spark, sf_dir):
    c = table(spark, sf_dir, "cues").where("job_id is not null").groupBy("job_id").agg(F.countDistinct("cue_id").alias("cues"))
    j = table(spark, sf_dir, "jobs").where("job_id is not null").select("job_id").distinct()
    return j.join(c, "job_id", "left").select("job_id", F.coalesce("cues", F.lit(0)).alias("cues"))


def streamed_sessions(spark, sf_dir):
    """Sessions of events by user with a pause of an hour, by the streaming form; a marker row closes the replay, so none is left open."""
    import uuid

    base = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex[:12]}"
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    timed = windows.closed(raw.where("user_id is not null and ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("at")), "at", f"{base}/end")
    s = windows.sessions(timed, "user_id", "at", "1 hour", "10 minutes")
    windows.drain(s, f"{base}/out", f"{base}/state")
    return spark.read.schema(s.schema).parquet(f"{base}/out").where("user_id is not null").select("user_id", F.unix_micros("first").alias("first_us"), "n")


# What follows has no counterpart in the reference: relational work of Spark itself over the star schema.


def star_revenue_by_region(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    l = t("lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("bigint").alias("cents"))
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    o = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name", "y").agg(F.sum("cents").alias("cents"))


def cube_by_flag_and_status(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("gid"))


def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def top_orders_per_customer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


def last_view_before_purchase(spark, sf_dir):
    """As-of join by a union and the last view carried on."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("view_id", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "view_id")


QUERIES = {
    f.__name__: f
    for f in [
        centroids, own_vs_other_similarity, outlier_flag, agglomerative_clusters, gap_duration_sessions, listening_windows, upsert_latest_wins, job_state_after_control, split_and_renumber, merge_short_with_next, multiset_difference,
        sequence_equality, metadata_difference, visual_evidence_lookup, jobs_with_cues, streamed_sessions, star_revenue_by_region, cube_by_flag_and_status, customers_without_orders, top_orders_per_customer, last_view_before_purchase,
    ]
}

_CENT = """m as (select label, pos, avg(x) as m, count(*) as n from (select label, unnest(generate_series(1, len(embedding))) as pos, cast(unnest(embedding) as double) as x from embeddings where label is not null) group by 1, 2),
nn as (select label, sqrt(sum(m * m)) as norm from m group by 1), cen as (select m.label, pos, m / greatest(norm, 1e-12) as x, n from m join nn on m.label = nn.label)"""
_SIM = f"""with {_CENT}, vec as (select label, list(x order by pos) as c from cen group by 1),
s as (select vec_id, e.label, v.label as l, list_dot_product(cast(embedding as double[]), c) as s from embeddings e, vec v where e.label is not null),
g as (select vec_id, label, max(case when l = label then s end) as own, max(case when l <> label then s end) as other, arg_max(l, s) as nearest from s group by 1, 2)"""
SQL = {
    "streamed_sessions": """with o as (select user_id, epoch_us(ts) as u, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as p from events where user_id is not null and ts is not null), s as (select *, sum(case when p is null or u - p >= 3600000000 then 1 else 0 end) over (partition by user_id order by u rows unbounded preceding) as no from o)
select user_id, min(u) as first_us, count(*) as n from s group by user_id, no""",
    "centroids": f"with {_CENT} select label, cast(pos - 1 as bigint) as pos, {_M.format('x')} as x_milli, n from cen",
    "own_vs_other_similarity": f"{_SIM} select vec_id, label, {_M.format('own')} as own_milli, {_M.format('other')} as other_milli, nearest from g",
    "outlier_flag": f"{_SIM} select vec_id, own < 0.40 or other > own + 0.05 as outlier, {_M.format('greatest(cast(0.35 as double), least(cast(0.95 as double), cast(0.60 as double) + cast(0.35 as double) * (own - other)))')} as confidence_milli from g",
    "upsert_latest_wins": """with o as (select o_custkey, o_orderpriority, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders)
select coalesce(c_custkey, o_custkey) as c_custkey, case when coalesce(o_totalprice > 200000, false) then coalesce(o_orderpriority, seg) else coalesce(seg, o_orderpriority) end as segment
from (select c_custkey, case when c_acctbal > 0 then c_mktsegment end as seg from customer) c full join (select * from o where rn = 1) o on c.c_custkey = o.o_custkey""",
    "job_state_after_control": """with j as (select job_id, status, control, row_number() over (partition by job_id order by updated_at desc, status) as rn from jobs where job_id is not null)
select job_id, case when control = 'pause' and status = 'processing' then 'paused' when control = 'resume' and status = 'paused' then 'processing' when control = 'cancel' and status in ('queued', 'processing', 'paused') then 'cancelled' when control = 'retry' and status = 'failed' then 'queued' else status end as status_after,
case when status = 'processing' then 'queued' else status end as status_restarted from j where rn = 1""",
    "split_and_renumber": f"""with {sql_cues()}, h as (select job_id, cue_id, l_start, (l_start + l_end) // 2 as l_end from c where l_end - l_start > 3000 union all select job_id, cue_id, (l_start + l_end) // 2, l_end from c where l_end - l_start > 3000 union all select job_id, cue_id, l_start, l_end from c where l_end - l_start <= 3000)
select job_id, cast(row_number() over (partition by job_id order by l_start, l_end, cue_id) as bigint) as cue_id, l_start, l_end from h""",
    "merge_short_with_next": f"""with {sql_cues('english')}, m as (select *, l_end - l_start < 1000 as m from c), e as (select *, coalesce(lag(m) over w, false) and not m as eaten, lead(l_end) over w as ne, lead(english) over w as nt from m window w as (partition by job_id order by l_start, cue_id)),
f as (select *, coalesce(lead(eaten) over (partition by job_id order by l_start, cue_id), false) as free from e)
select job_id, cast(row_number() over (partition by job_id order by l_start, cue_id) as bigint) as cue_id, l_start, case when m and free then greatest(l_end, ne) else l_end end as l_end, case when m and free then concat_ws(' ', english, nt) else english end as english from f where not eaten""",
    "multiset_difference": "select c_nationkey as nationkey from customer except all select s_nationkey from supplier",
    "sequence_equality": f"with {sql_cues()} select job_id, list(cue_id order by cue_id) = list(cue_id order by l_start, cue_id) as in_order from c group by job_id",
    "metadata_difference": " union all ".join(f"select job_id, '{c}' as field, count(distinct coalesce(cast({c} as varchar), '-')) as values from jobs where job_id is not null group by job_id having count(distinct coalesce(cast({c} as varchar), '-')) > 1" for c in ("filename", "status", "control", "stage", "media_kind", "source_language")),
    "visual_evidence_lookup": f"""with {sql_cues('speaker_id')}, s as (select distinct sighting_id, job_id, speaker_id, case when not isnan(active_speaker_confidence) then active_speaker_confidence end as cf from face_sightings where job_id is not null and speaker_id > 0), g as (select job_id, speaker_id, count(*) as n, max(cf) as best from s group by 1, 2)
select c.job_id, cue_id, coalesce(n, 0) as sightings, {_M.format('coalesce(best, cast(0 as double))')} as best_milli from c left join g on c.job_id = g.job_id and c.speaker_id = g.speaker_id""",
    "jobs_with_cues": "with c as (select job_id, count(distinct cue_id) as cues from cues where job_id is not null group by 1) select j.job_id, coalesce(cues, 0) as cues from (select distinct job_id from jobs where job_id is not null) j left join c on j.job_id = c.job_id",
    "star_revenue_by_region": "select r_name, cast(year(o_orderdate) as integer) as y, cast(sum(cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)) as bigint) as cents from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2",
    "cube_by_flag_and_status": "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag, l_linestatus) as bigint) as gid from lineitem group by cube (l_returnflag, l_linestatus)",
    "customers_without_orders": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "top_orders_per_customer": "with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) select * from r where rank <= 3",
    "last_view_before_purchase": "with e as (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as view_id from events where event_type in ('view', 'purchase')) select event_id, view_id from e where event_type = 'purchase'",
}
