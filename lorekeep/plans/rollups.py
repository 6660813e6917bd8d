"""Aggregations, joins, set operations and near-duplicate rules as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import scoring, text
from lorekeep.operators.ranking import numbered
from lorekeep.operators import predicates
from lorekeep.plans.registry import query
from lorekeep.session import table
from lorekeep.sources.store import CURRENT_SQL, FACTS_SQL, MEMORIES_SQL, NOW_SQL, OUTCOMES_SQL, facts, memories, now, outcomes

M = f"with {MEMORIES_SQL}"
O = f"with {OUTCOMES_SQL}"  # noqa: E741


@query("g1_g2_status", f"{M} select kind, count(*) as n, count(*) filter (where {CURRENT_SQL}) as n_current, count(*) filter (where pinned) as n_pinned from memories group by kind")
def _(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(predicates.current_truth(now())).alias("n_current"), F.count_if("pinned").alias("n_pinned")
    )


@query("g3_group_channels", f"{M} select lang as channel, count(distinct coalesce(scope_user, source)) as n_people from memories group by lang having n_people >= 2")
def _(spark, sf_dir):
    people = memories(spark, sf_dir).groupBy(F.col("lang").alias("channel"))
    return people.agg(F.countDistinct(F.coalesce("scope_user", "source")).alias("n_people")).where("n_people >= 2")


@query("g4_principals", f"{M} select source, min(trust_tier) as trust, max(id) as newest, max(lang) as lang from memories group by source order by newest desc limit 20")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).groupBy("source").agg(F.min("trust_tier").alias("trust"), F.max("id").alias("newest"), F.max("lang").alias("lang"))
    return rows.orderBy(F.desc("newest")).limit(20)


@query("g5_g6_budgets", f"{O} select cast(created_at as date) as day, round(sum(cost), 4) as spent, sum(case when cost > 10 then 0 else turn_id % 100 end)::bigint as unpriced from outcomes group by 1")
def _(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy(F.to_date("created_at").alias("day")).agg(
        F.round(F.sum("cost"), 4).alias("spent"), F.sum(F.when(F.col("cost") > 10, 0).otherwise(F.col("turn_id") % 100)).alias("unpriced")
    )


@query("g7_g8_latest", f"{O} select session_id, coalesce(max(created_at) filter (where outcome = 'failed'), min(created_at)) as grace_start, max(created_at) as newest from outcomes group by session_id")
def _(spark, sf_dir):
    at = F.col("created_at")
    return outcomes(spark, sf_dir).groupBy("session_id").agg(
        F.coalesce(F.max(F.when(F.col("outcome") == "failed", at)), F.min(at)).alias("grace_start"), F.max(at).alias("newest")
    )


@query("g10_best_fact_score", f"with {FACTS_SQL} select subject, max(confidence) as best from facts group by subject")
def _(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("subject").agg(F.max("confidence").alias("best"))


@query("g12_w2_global_band", f"{M} select id, round(case when max(surprise) over () - min(surprise) over () < 1e-12 then 1.0 else 0.2 + 0.8 * (surprise - min(surprise) over ()) / (max(surprise) over () - min(surprise) over ()) end, 6) as band from memories")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir)
    ends = rows.agg(F.min("surprise").alias("lo"), F.max("surprise").alias("hi"))  # one row
    band = F.when(F.col("hi") - F.col("lo") < 1e-12, F.lit(1.0)).otherwise(F.lit(0.2) + (F.col("surprise") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 0.8)
    return rows.join(F.broadcast(ends)).select("id", F.round(band, 6).alias("band"))


@query("g13_f30_batch_context", f"""{M} select source, count(distinct scope_user) as n_users, max(case trust_tier when 'owner' then 0 when 'agent' then 1 when 'known_user' then 2 when 'tool' then 3 else 4 end)::int as worst from memories group by source""")
def _(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("source").agg(
        F.countDistinct("scope_user").alias("n_users"), F.max(scoring.trust_rank(F.col("trust_tier"))).alias("worst")
    )


@query("g14_pattern_importance", f"{M} select source, round(least(1.0, avg(coalesce(case when id % 3 <> 0 then surprise end, 0.5)) + 0.2), 6) as importance from memories group by source")
def _(spark, sf_dir):
    own = F.coalesce(F.when(F.col("id") % 3 != 0, F.col("surprise")), F.lit(0.5))
    return memories(spark, sf_dir).groupBy("source").agg(F.round(F.least(F.lit(1.0), F.avg(own) + 0.2), 6).alias("importance"))


@query("g17_w14_trend", f"""{O}, r as (select *, row_number() over (partition by session_id order by created_at, turn_id) as nth, count(*) over (partition by session_id) as n from outcomes),
  h as (select session_id, avg((outcome = 'verified')::int) filter (where nth <= n // 2) as a, avg((outcome = 'verified')::int) filter (where nth > n // 2) as b from r group by session_id)
  select session_id, case when coalesce(b, 0) - coalesce(a, 0) > 0.02 then 'up' when coalesce(b, 0) - coalesce(a, 0) < -0.02 then 'down' else 'flat' end as trend from h""")
def _(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy("created_at", "turn_id")
    rows = outcomes(spark, sf_dir).withColumn("nth", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session_id")))
    ok, early = (F.col("outcome") == "verified").cast("int"), F.col("nth") <= F.floor(F.col("n") / 2)
    halves = rows.groupBy("session_id").agg(F.avg(F.when(early, ok)).alias("a"), F.avg(F.when(~early, ok)).alias("b"))
    change = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    return halves.select("session_id", F.when(change > 0.02, "up").when(change < -0.02, "down").otherwise("flat").alias("trend"))


@query("g19_g22_tallies", f"{O} select skill, count(*) as n, count(*) filter (where outcome = 'failed') as errors, count(distinct session_id) as sessions from outcomes group by skill")
def _(spark, sf_dir):
    return outcomes(spark, sf_dir).groupBy("skill").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "failed").alias("errors"), F.countDistinct("session_id").alias("sessions")
    )


@query("g25_topics", "select distinct tag from (select unnest([lang, source]) as tag from documents) order by tag")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("tag")).distinct()


@query("g26_k12_mentions", "select l_partkey as entity, count(distinct l_orderkey) as mentions from lineitem group by 1")
def _(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("memory")).distinct()
    return seen.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))


@query("j4_facts_left_memories", f"with {FACTS_SQL}, {MEMORIES_SQL} select fact_id, uid from facts left join memories on fact_id = id where id is null or {CURRENT_SQL.replace('valid_to', 'memories.valid_to')}")
def _(spark, sf_dir):
    f = facts(spark, sf_dir).select("fact_id", "subject")
    both = f.join(memories(spark, sf_dir), f.fact_id == F.col("id"), "left")
    return both.where(F.col("id").isNull() | predicates.current_truth(now())).select("fact_id", "uid")


@query("j6_missing_vectors", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def _(spark, sf_dir):
    have = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(have, "doc_id", "left_anti")


@query("j9_existence", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def _(spark, sf_dir):
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(some, "c_custkey", "left_semi")


@query("j10_parent_uid", f"{M} select a.id, b.uid as supersedes_uid from memories a left join memories b on b.id = a.id - 1 and a.id % 10 = 4")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir)
    parent = rows.select((F.col("id") + 1).alias("id"), F.col("uid").alias("supersedes_uid"))
    return rows.select("id").join(parent, "id", "left").select("id", F.when(F.col("id") % 10 == 4, F.col("supersedes_uid")).alias("supersedes_uid"))


@query("j16_resolved_log", f"{O} select a.turn_id, b.outcome from outcomes a join outcomes b on a.session_id = b.session_id and b.turn_id = a.turn_id + 1")
def _(spark, sf_dir):
    rows = outcomes(spark, sf_dir)
    after = rows.select("session_id", (F.col("turn_id") - 1).alias("turn_id"), "outcome")
    return rows.select("session_id", "turn_id").join(after, ["session_id", "turn_id"]).select("turn_id", "outcome")


@query("j23_all_members", "select l_orderkey from lineitem group by 1 having bool_and(l_partkey in (select p_partkey from part where p_size > 3))")
def _(spark, sf_dir):
    ok = table(spark, sf_dir, "part").where("p_size > 3").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("ok"))
    rows = table(spark, sf_dir, "lineitem").join(ok, "l_partkey", "left")
    return rows.groupBy("l_orderkey").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("every")).where("every").select("l_orderkey")


@query("j28_identities", "select o_orderkey, coalesce(n_name, 'unknown') as nation from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def _(spark, sf_dir):
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    who = who.select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = table(spark, sf_dir, "orders").join(who, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("j30_unique_prefix", f"{M}, p as (select id as pid, substr(uid, 1, 13) as prefix from memories where id % 50 = 0) select pid, min(uid) as uid from p join memories on starts_with(uid, prefix) group by pid having count(*) = 1")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir)
    wanted = rows.where("id % 50 = 0").select(F.col("id").alias("pid"), F.substring("uid", 1, 13).alias("prefix"))
    cut = rows.select("uid", F.substring("uid", 1, 13).alias("prefix"))  # prefixes of one length join by equality
    return wanted.join(cut, "prefix").groupBy("pid").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n")).where("n = 1").select("pid", "uid")


@query("o11_top_decile", f"{M}, r as (select id, surprise, row_number() over (order by surprise desc, id)::int as nth from memories where surprise > 0) select id, nth from r where nth <= greatest(1, (select count(*) from r) // 10)")
def _(spark, sf_dir):
    rows = numbered(memories(spark, sf_dir).where("surprise > 0").select("id", "surprise"), F.desc("surprise"), "id")
    cut = F.broadcast(rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("cut")))  # one row
    return rows.join(cut, F.col("nth") <= F.col("cut")).select("id", F.col("nth").cast("int").alias("nth"))


@query("o13_guidance", f"""{M}, g as (select *, row_number() over (partition by kind order by helpful desc, id) as nth from memories where {CURRENT_SQL} and kind in ('strategy', 'case', 'profile'))
  select id, kind from g where nth <= case kind when 'strategy' then 3 else 2 end""")
def _(spark, sf_dir):
    order = Window.partitionBy("kind").orderBy(F.desc("helpful"), "id")
    rows = memories(spark, sf_dir).where(predicates.current_truth(now()) & F.col("kind").isin("strategy", "case", "profile"))
    limit = F.when(F.col("kind") == "strategy", 3).otherwise(2)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("id", "kind")


@query("u3_jaccard", r"""with t as (select doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from documents)
  select a.doc_id as a, b.doc_id as b, round(len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) as jaccard from t a join t b on a.doc_id + 100 = b.doc_id""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("w"))
    other = rows.select((F.col("doc_id") - 100).alias("a"), F.col("doc_id").alias("b"), F.col("w").alias("v"))
    both = other.join(rows.select(F.col("doc_id").alias("a"), "w"), "a")
    return both.select("a", "b", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("u5_first_wins", f"{M} select id, min(case when kind = 'fact' then 0 else 1 end)::int as origin from memories where kind = 'fact' or pinned group by id")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir)
    both = rows.where("kind = 'fact'").select("id", F.lit(0).alias("origin")).unionByName(rows.where("pinned").select("id", F.lit(1).alias("origin")))
    return both.groupBy("id").agg(F.min("origin").alias("origin"))


@query("u8_cross_profile", "select source as profile, doc_id % 100 as uid, count(*) as n from documents group by 1, 2")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("profile"), (F.col("doc_id") % 100).alias("uid"))
    return rows.groupBy("profile", "uid").agg(F.count(F.lit(1)).alias("n"))


@query("v1_exact_dedup", r"select sha256(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))) as content_hash, min(doc_id) as first_id, count(*) as copies from documents group by 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))


@query("v3_information_contest", r"""with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as n from documents)
  select a.doc_id, b.n + 10 * len(list_filter(b.w, lambda x: not list_contains(a.w, x))) > a.n + 10 * len(list_filter(a.w, lambda x: not list_contains(b.w, x))) as new_wins from t a join t b on a.doc_id + 200 = b.doc_id""")
def _(spark, sf_dir):
    words = text.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(words).alias("w"), F.size(words).alias("n"))
    new = rows.select((F.col("doc_id") - 200).alias("doc_id"), F.col("w").alias("v"), F.col("n").alias("m"))
    both = rows.join(new, "doc_id")
    score = lambda n, a, b: F.col(n) + F.size(F.array_except(a, b)) * 10
    return both.select("doc_id", (score("m", "v", "w") > score("n", "w", "v")).alias("new_wins"))


@query("w13_resume_window", "select doc_id from documents where doc_id > 100 order by doc_id limit 50")
def _(spark, sf_dir):
    from lorekeep.operators.lifecycle import resume_window

    return resume_window(table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id")), 100, 50).select("doc_id")


@query("w16_newest_pending", f"{O} select session_id, turn_id from outcomes where outcome = 'open' qualify row_number() over (partition by session_id order by created_at desc) = 1")
def _(spark, sf_dir):
    from lorekeep.operators.lifecycle import newest_first

    rows = newest_first(outcomes(spark, sf_dir).where("outcome = 'open'"), "session_id", "created_at")
    return rows.where("is_newest").select("session_id", "turn_id")


@query("w17_stride_sample", f"{O}, r as (select turn_id, row_number() over (partition by skill order by turn_id) as nth, count(*) over (partition by skill) as n from outcomes) select turn_id from r where (nth - 1) % greatest(1, n // 50) = 0 and (nth - 1) // greatest(1, n // 50) < 50")
def _(spark, sf_dir):
    order = Window.partitionBy("skill").orderBy("turn_id")
    rows = outcomes(spark, sf_dir).withColumn("nth", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("skill")))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 50))
    return rows.where((F.col("nth") % step == 0) & (F.floor(F.col("nth") / step) < 50)).select("turn_id")


@query("m2_review_queue", f"{M} select 'quarantined' as source, id from memories where status = 'quarantined' order by id desc limit 50")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).where("status = 'quarantined'").orderBy(F.desc("id")).limit(50)
    return rows.select(F.lit("quarantined").alias("source"), "id")


@query("m9_health_checks", f"""{M} select count(*) filter (where status = 'tombstone' and valid_to is null) as open_tombstones, count(*) filter (where status = 'active' and ttl_at <= {NOW_SQL} and valid_to is null) as overdue,
  count(*) filter (where status = 'quarantined' and pinned) as pinned_quarantine from memories""")
def _(spark, sf_dir):
    status = F.col("status")
    return memories(spark, sf_dir).agg(
        F.count_if((status == "tombstone") & F.col("valid_to").isNull()).alias("open_tombstones"),
        F.count_if((status == "active") & (F.col("ttl_at") <= now()) & F.col("valid_to").isNull()).alias("overdue"),
        F.count_if((status == "quarantined") & F.col("pinned")).alias("pinned_quarantine"),
    )


@query("k9_edge_insert_or_ignore", "select distinct l_orderkey as src, l_partkey as dst from lineitem where l_linenumber = 1 and l_partkey not in (select p_partkey from part where p_size < 3)")
def _(spark, sf_dir):
    new = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    have = table(spark, sf_dir, "part").where("p_size < 3").select(F.col("p_partkey").alias("dst"))
    return new.join(have, "dst", "left_anti").select("src", "dst")
