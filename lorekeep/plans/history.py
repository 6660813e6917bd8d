"""Queries over histories: sessions, versions, temporal joins, lifecycle, change events and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import scoring
from lorekeep.operators import cdc, evalkit, lifecycle, sessions, temporal
from lorekeep.plans.registry import query
from lorekeep.session import table
from lorekeep.sources.store import CURRENT_SQL, FACTS_SQL, MEMORIES_SQL, NOW_SQL, OUTCOMES_SQL, facts, memories, now, outcomes

GAP = 6 * 3600
RUNS = f"""{OUTCOMES_SQL}, g as (select *, coalesce((epoch_us(created_at) - epoch_us(lag(created_at) over s)) > {GAP} * 1000000::bigint or lag(outcome) over s in ('verified', 'failed', 'blocked'), false)::int as brk
    from outcomes window s as (partition by session_id order by created_at, turn_id)),
  i as (select *, sum(brk) over (partition by session_id order by created_at, turn_id rows unbounded preceding) as island from g),
  b as (select *, (row_number() over (partition by session_id, island order by created_at, turn_id) - 1) // 20 as block from i),
  runs as (select *, dense_rank() over (partition by session_id order by island, block) as run from b)"""


def _runs(spark, sf_dir):
    return sessions.task_runs(outcomes(spark, sf_dir), gap_s=GAP)


@query("w4_task_runs", f"with {RUNS} select turn_id, session_id, run::bigint as run from runs")
def _(spark, sf_dir):
    return _runs(spark, sf_dir).select("turn_id", "session_id", "run")


EPISODES = f"""{RUNS}, eps as (select session_id, run, min(created_at) as started, max(created_at) as ended, count(*) as n_turns, sum(cost) as cost,
  arg_max(outcome, turn_id) as outcome, arg_max(feedback, turn_id) filter (where true) as feedback, array_to_string(list_sort(list_distinct(list(skill))), ',') as skills from runs group by session_id, run)"""


@query("g16_episodes", f"with {EPISODES} select session_id, run::bigint as run, started, ended, n_turns, round(cost, 4) as cost, outcome, skills from eps")
def _(spark, sf_dir):
    eps = sessions.episodes(_runs(spark, sf_dir))
    return eps.select(
        "session_id", "run", "started", "ended", "n_turns", F.round("cost", 4).alias("cost"), "outcome",
        F.array_join(F.array_sort("skills"), ",").alias("skills"),
    )


@query(
    "w5_transcript_windows",
    f"""with {EPISODES} select session_id, run::bigint as run, greatest(started - interval 1 hour, coalesce(lag(ended) over (partition by session_id order by started, run), started - interval 1 hour)) as window_start
    from (select *, max(run) over (partition by session_id) as last from eps) where run < last or outcome in ('verified', 'failed', 'blocked')""",
)
def _(spark, sf_dir):
    eps = sessions.closed_only(sessions.episodes(_runs(spark, sf_dir)))
    return sessions.transcript_windows(eps).select("session_id", "run", "window_start")


@query(
    "w8_turn_pairs",
    """with p as (select *, coalesce(sum((role = 'assistant' and trim(text) <> '')::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as pair from conversations),
    g as (select conv_id, pair::bigint as pair, string_agg(text, chr(10) || chr(10) order by turn) filter (where role = 'user') as user_text, coalesce(max(text) filter (where role = 'assistant'), '') as assistant_text
      from p where role in ('user', 'assistant') and trim(text) <> '' group by conv_id, pair) select * from g where user_text <> ''""",
)
def _(spark, sf_dir):
    return sessions.pair_turns(table(spark, sf_dir, "conversations"))


@query(
    "w6_budget_prefix",
    """with m as (select conv_id, turn, sum(least(length(text), 2000)) over (partition by conv_id order by turn rows unbounded preceding)::bigint as used from conversations) select * from m where used <= 1200""",
)
def _(spark, sf_dir):
    size = F.least(F.length("text"), F.lit(2000))
    return sessions.budget_prefix(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], size, 1200).select("conv_id", "turn", "used")


@query(
    "w15_abandoned_sessions",
    f"with {OUTCOMES_SQL} select session_id, max(created_at) as newest from outcomes group by session_id having newest < timestamp '2024-02-05' - interval 7 day",
)
def _(spark, sf_dir):
    return sessions.abandoned(outcomes(spark, sf_dir), F.lit("2024-02-05").cast("timestamp"))


@query(
    "w9_gold_patterns",
    f"""with {OUTCOMES_SQL}, f as (select *, max((outcome = 'failed')::int) over (partition by session_id order by created_at, turn_id rows unbounded preceding) as fb from outcomes)
    select session_id, sum((outcome = 'verified' and fb = 1)::int) >= 2 as gold from f group by session_id""",
)
def _(spark, sf_dir):
    return sessions.is_gold(outcomes(spark, sf_dir), "session_id", ["created_at", "turn_id"], F.col("outcome") == "failed", F.col("outcome") == "verified")


@query(
    "j15_forward_asof",
    f"""with {OUTCOMES_SQL}, v as (select turn_id as view_id, session_id, created_at as seen_at from outcomes where skill = 'view'),
    o as (select session_id, created_at, turn_id, outcome from outcomes where outcome <> 'open'),
    m as (select view_id, created_at, turn_id, outcome, row_number() over (partition by view_id order by created_at, turn_id) as nth from v join o using (session_id)
      where created_at >= seen_at and epoch_us(created_at) - epoch_us(seen_at) <= 21600000000)
    select v.view_id, m.turn_id, m.outcome from v left join m on v.view_id = m.view_id and nth = 1""",
)
def _(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    views = rows.where("skill = 'view'").select(F.col("turn_id").alias("view_id"), "session_id", F.col("created_at").alias("seen_at"))
    ends = rows.where("outcome <> 'open'").select("session_id", "created_at", "turn_id", "outcome")
    return temporal.forward_asof(views, ends, ["session_id"], "seen_at", "created_at", "view_id", 6 * 3600).select("view_id", "turn_id", "outcome")


@query(
    "j14_nearest_within",
    f"""with {OUTCOMES_SQL}, v as (select turn_id as log_id, session_id, created_at as logged_at from outcomes where skill = 'click'),
    o as (select session_id, created_at, turn_id from outcomes where skill = 'view'),
    m as (select log_id, turn_id, row_number() over (partition by log_id order by created_at, turn_id) as nth from v join o using (session_id) where abs(epoch_us(created_at) - epoch_us(logged_at)) <= 3600000000)
    select v.log_id, m.turn_id from v left join m on v.log_id = m.log_id and nth = 1""",
)
def _(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    log = rows.where("skill = 'click'").select(F.col("turn_id").alias("log_id"), "session_id", F.col("created_at").alias("logged_at"))
    said = rows.where("skill = 'view'").select("session_id", "created_at", "turn_id")
    return temporal.nearest_within(log, said, ["session_id"], "logged_at", "created_at", "log_id", 3600).select("log_id", "turn_id")


@query(
    "j27_range_slices",
    f"""with {EPISODES} select e.session_id, e.run::bigint as run, count(*) as n_messages from eps e join outcomes o on o.session_id = e.session_id and o.created_at between e.started and e.ended group by 1, 2""",
)
def _(spark, sf_dir):
    spans = sessions.episodes(_runs(spark, sf_dir)).select("session_id", "run", F.col("started").alias("start"), F.col("ended").alias("end"))
    hit = temporal.range_slice(outcomes(spark, sf_dir), spans, "session_id", "created_at")
    return hit.groupBy("session_id", "run").agg(F.count(F.lit(1)).alias("n_messages"))


@query(
    "g9_v26_credits",
    f"""with {OUTCOMES_SQL} select session_id, count(*) filter (where outcome = 'verified' and feedback is distinct from 'thumbs_down' or feedback = 'positive' and outcome not in ('failed', 'blocked')) as helpful,
    count(*) filter (where feedback = 'thumbs_down' or outcome in ('failed', 'blocked')) as harmful from outcomes group by session_id""",
)
def _(spark, sf_dir):
    credit = scoring.credit(F.col("outcome"), F.col("feedback"))
    rows = outcomes(spark, sf_dir).withColumn("credit", credit)
    return rows.groupBy("session_id").agg(
        F.count_if(F.col("credit") == "helpful").alias("helpful"), F.count_if(F.col("credit") == "harmful").alias("harmful")
    )


@query(
    "k10_w12_fact_intervals",
    f"with {FACTS_SQL} select fact_id, lead(valid_from) over w as valid_until, lead(fact_id) over w as superseded_by from facts window w as (partition by subject, predicate order by valid_from, fact_id)",
)
def _(spark, sf_dir):
    return temporal.fact_intervals(facts(spark, sf_dir)).select("fact_id", "valid_until", "superseded_by")


@query(
    "w12_current_facts",
    f"with {FACTS_SQL} select subject, predicate, object, fact_id from facts qualify row_number() over (partition by subject, predicate order by valid_from desc, fact_id desc) = 1",
)
def _(spark, sf_dir):
    return temporal.current_facts(facts(spark, sf_dir)).select("subject", "predicate", "object", "fact_id")


@query(
    "k11_end_fact",
    f"""with {FACTS_SQL}, s as (select *, lead(valid_from) over (partition by subject, predicate order by valid_from, fact_id) as vu from facts)
    select fact_id, case when vu is null and predicate = 'status' then {NOW_SQL} else vu end as valid_until from s""",
)
def _(spark, sf_dir):
    spans = temporal.fact_intervals(facts(spark, sf_dir))
    ends = spans.where("predicate = 'status'").select("subject", "predicate").distinct().withColumn("end_at", now())
    return temporal.end_facts(spans, ends).select("fact_id", "valid_until")


@query(
    "j24_v12_fact_conflicts",
    f"""with {FACTS_SQL} select a.fact_id as older, b.fact_id as newer from facts a join facts b on a.subject = b.subject and a.predicate = b.predicate and a.object <> b.object
    and (a.valid_from, a.fact_id) < (b.valid_from, b.fact_id)""",
)
def _(spark, sf_dir):
    a = facts(spark, sf_dir).select("subject", "predicate", F.struct("valid_from", "fact_id").alias("x"), F.col("object").alias("xo"))
    b = facts(spark, sf_dir).select("subject", "predicate", F.struct("valid_from", "fact_id").alias("y"), F.col("object").alias("yo"))
    both = a.join(b, ["subject", "predicate"]).where("xo <> yo and x < y")
    return both.select(F.col("x.fact_id").alias("older"), F.col("y.fact_id").alias("newer"))


VERSIONED = f"""{MEMORIES_SQL}, base as (select id, uid, content, 1::bigint as version, valid_from, valid_to, null::bigint as supersedes, null::bigint as superseded_by from memories)"""


def _versioned(spark, sf_dir):
    null = F.lit(None).cast("long")
    return memories(spark, sf_dir).select(
        "id", "uid", "content", F.lit(1).cast("long").alias("version"), "valid_from", "valid_to",
        null.alias("supersedes"), null.alias("superseded_by"),
    )


@query(
    "k6_successors",
    f"""with {VERSIONED}, c as (select id, id + 1000000000 as new_id from base where id % 10 = 3)
    select b.id, version, case when new_id is not null and valid_to is null then {NOW_SQL} else valid_to end as valid_to, supersedes, case when new_id is not null and valid_to is null then new_id end as superseded_by from base b left join c using (id)
    union all select new_id, version + 1, null, b.id, null from base b join c using (id) where valid_to is null""",
)
def _(spark, sf_dir):
    rows = _versioned(spark, sf_dir)
    changes = rows.where("id % 10 = 3").select("id", (F.col("id") + 1000000000).alias("new_id"), F.upper("content").alias("new_content"))
    return temporal.successors(rows, changes, now()).select("id", "version", "valid_to", "supersedes", "superseded_by")


@query(
    "j11_w11_chain_heads",
    """with recursive l as (select doc_id as id, case when doc_id % 8 <> 7 and doc_id + 1 <= (select max(doc_id) from documents) then doc_id + 1 end as next_id from documents),
    walk(id, head, next_id) as (select id, id, next_id from l union all select w.id, l.id, l.next_id from walk w join l on w.next_id = l.id)
    select id, head from walk where next_id is null""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    after = F.lead("id").over(Window.partitionBy(F.floor(F.col("id") / 8)).orderBy("id"))
    return temporal.chain_heads(docs.withColumn("next_id", after))


@query(
    "k13_expire_due",
    f"""with {MEMORIES_SQL} select id, case when ttl_at <= {NOW_SQL} and valid_to is null and status = 'active' then 'expired' else status end as status,
    case when ttl_at <= {NOW_SQL} and valid_to is null and status = 'active' then {NOW_SQL} else valid_to end as valid_to from memories""",
)
def _(spark, sf_dir):
    return lifecycle.expire_due(memories(spark, sf_dir), now()).select("id", "status", "valid_to")


@query(
    "k19_soft_forget",
    f"with {MEMORIES_SQL} select id, case when id % 50 = 1 then 'tombstone' else status end as status, case when id % 50 = 1 then coalesce(valid_to, {NOW_SQL}) else valid_to end as valid_to from memories",
)
def _(spark, sf_dir):
    rows = memories(spark, sf_dir)
    return lifecycle.forget(rows, rows.where("id % 50 = 1").select("id"), now()).select("id", "status", "valid_to")


@query("k18_hard_purge", "select doc_id, text is not null as has_text from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def _(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    left = lifecycle.purge({"documents": (table(spark, sf_dir, "documents"), "doc_id")}, bad)["documents"]
    return left.select("doc_id", F.col("text").isNotNull().alias("has_text"))


@query("o8_event_page", "select event_id, ts from events where (ts, event_id) > (timestamp '2024-01-10', 5) order by ts, event_id limit 100")
def _(spark, sf_dir):
    return cdc.page(table(spark, sf_dir, "events"), ("2024-01-10 00:00:00", 5), 100).select("event_id", "ts")


@query(
    "v37_last_writer_wins",
    """with e as (select cast(user_id as varchar) as uid, ts as recorded_at, event_id as origin, event_type as op from events) select uid, op, origin from e qualify row_number() over (partition by uid order by recorded_at desc, origin desc) = 1""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("ts").alias("recorded_at"), F.col("event_id").alias("origin"), F.col("event_type").alias("op"))
    return cdc.last_writer_wins(e.where("origin % 2 = 0"), e.where("origin % 2 = 1")).select("uid", "op", "origin")


@query("t12_applied_once", "select user_id, min(event_id) as event_id from events where user_id not in (select user_id from events where event_type = 'signup' and event_id < 300) group by user_id")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("uid", F.col("user_id"))
    return cdc.applied_once(e, e.where("event_type = 'signup' and event_id < 300")).select("user_id", "event_id")


@query("t13_compacted", f"select event_id from events where event_id % 3 <> 0 or ts >= {NOW_SQL} - interval 45 day")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("synced_at", F.when(F.col("event_id") % 3 == 0, F.col("ts")))
    return lifecycle.compacted(e, now(), 45).select("event_id")


@query("s15_k_remapped_ids", "select o_orderkey, case when c_custkey is not null then c_custkey + 1000000 end as o_custkey from orders left join customer on o_custkey = c_custkey and c_acctbal > 0")
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 1000000).alias("new_id"))
    return cdc.remapped(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, ["o_custkey"])


WILSON = "({p} + 3.8414588206941236 / (2 * {n}) {sign} 1.959963984540054 * sqrt({p} * (1 - {p}) / {n} + 3.8414588206941236 / (4 * {n} * {n}))) / (1 + 3.8414588206941236 / {n})"
_LOW = WILSON.format(p="(sw::double / nw)", n="nw::double", sign="-")
_HIGH = WILSON.format(p="(so::double / no_)", n="no_::double", sign="+")


@query(
    "g18_v20_v21_v22_contrasts",
    f"""with {OUTCOMES_SQL}, c as (select skill, count(*) filter (where cost > 10) as nw, count(*) filter (where cost > 10 and feedback = 'positive' or cost > 10 and outcome = 'verified') as sw,
    count(*) filter (where cost <= 10) as no_, count(*) filter (where cost <= 10 and (feedback = 'positive' or outcome = 'verified')) as so from outcomes group by skill)
    select skill, nw as n_with, sw as s_with, no_ as n_without, so as s_without, round(greatest(0.0, {_LOW}) - least(1.0, {_HIGH}), 6) as bound from c""",
)
def _(spark, sf_dir):
    ok = F.coalesce((F.col("feedback") == "positive") | (F.col("outcome") == "verified"), F.lit(False))
    out = evalkit.contrast(outcomes(spark, sf_dir), ["skill"], F.col("cost") > 10, ok)
    return out.withColumn("bound", F.round("bound", 6))


@query("g24_percentiles", f"with {OUTCOMES_SQL} select skill, quantile_disc(cost, 0.95) as value from outcomes group by skill")
def _(spark, sf_dir):
    return evalkit.percentile(outcomes(spark, sf_dir), ["skill"], "cost", 0.95)
