"""Queries of queues, watermarks, staged runs, chains, skills and the smaller reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import cdc, chains, learning, predicates, queues, skills, vectors
from lorekeep.plans.registry import query
from lorekeep.session import scratch, table
from lorekeep.sources import readers
from lorekeep.sources.store import CURRENT_SQL, FACTS_SQL, MEMORIES_SQL, facts, memories, now

M = f"with {MEMORIES_SQL}"


@query("t1_t2_claims", "select event_id as id from events where event_type <> 'view' and (event_id % 3 <> 0 or ts + interval 10 minute < timestamp '2024-01-10') order by event_id limit 500")
def _(spark, sf_dir):
    """The next 500 open rows of a queue; rows divisible by 3 are claimed at their time."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "view").alias("done"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("claimed_at"))
    return queues.claimed(rows, F.lit("2024-01-10").cast("timestamp"), 500).select("id")


BATCH_SQL = "b as (select user_id as session, event_id as id, case event_type when 'signup' then 'session_end_marker' when 'click' then 'memory_write' else 'turn' end as kind, user_id % 2 = 0 or event_id % 2 = 0 as read from events)"


@query(
    "t3_u10_promotions",
    f"""with {BATCH_SQL}, w as (select session, bool_or(kind = 'turn' and not read) as waits from b group by session)
    select id, case when kind = 'session_end_marker' then not waits else kind = 'memory_write' or read end as promote from b join w using (session)""",
)
def _(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "session_end_marker").when(F.col("event_type") == "click", "memory_write").otherwise("turn")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), kind.alias("kind"))
    read = rows.where("session % 2 = 0 or id % 2 = 0").select("id")
    return queues.partitioned(rows, read).select("id", "promote")


@query("t7_watermarks", """with e as (select user_id as key, ts as started, ts + interval 1 hour as ended, event_type <> 'error' as resolved from events)
  select key, greatest(coalesce(min(started) filter (where not resolved) - interval 1 millisecond, max(ended)), timestamp '2024-01-02') as watermark from e group by key""")
def _(spark, sf_dir):
    return queues.watermarks(_episodes(spark, sf_dir), F.lit("2024-01-02").cast("timestamp"))


def _episodes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), F.col("ts").alias("started"), (F.col("ts") + F.expr("interval 1 hour")).alias("ended"), (F.col("event_type") != "error").alias("resolved")
    )


@query("t8_grace_watermarks", """with e as (select user_id as key, ts as started, ts + interval 1 hour as ended, event_type <> 'error' and not ts + interval 48 hour < timestamp '2024-01-20' as resolved, event_type = 'error' and ts + interval 48 hour >= timestamp '2024-01-20' as blocks from events)
  select key, greatest(coalesce(min(started) filter (where blocks) - interval 1 millisecond, max(ended)), timestamp '2024-01-02') as watermark from e group by key""")
def _(spark, sf_dir):
    at = lambda t: F.lit(t).cast("timestamp")
    return queues.watermarks(_episodes(spark, sf_dir), at("2024-01-02"), at("2024-01-20"))


@query("t9_session_watermarks", "select user_id as session, max(ts) as watermark from events group by 1 having bool_or(event_type = 'signup') or max(ts) + interval 7 day < timestamp '2024-02-06'")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), (F.col("event_type") == "signup").alias("ended"))
    return queues.session_watermarks(rows, F.lit("2024-02-06").cast("timestamp"))


@query("t14_bounded_signals", """with s as (select event_id, row_number() over (partition by event_type, date_trunc('day', ts) order by event_id) as nth from events) select event_id, nth <= 40 as kept, case when nth <= 40 then ((nth - 1) // 16)::int end as batch from s""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    return queues.bounded(rows, ["event_type", "day"], "event_id", 40, 16).select("event_id", "kept", "batch")


@query("t15_drained_once", "select count(distinct user_id || event_type) as n_first, min(event_id) as first_id, 0::bigint as n_again from events where event_id % 3 <> 0")
def _(spark, sf_dir):
    """A drain applies each open signal once; what it applied is no longer open to the next drain."""
    rows = table(spark, sf_dir, "events").where("event_id % 3 <> 0").select("event_id", F.concat(F.col("user_id").cast("string"), F.col("event_type")).alias("uid"))
    first = cdc.applied_once(rows, rows.where("false"))
    again = cdc.applied_once(rows, first)
    counts = first.agg(F.count(F.lit(1)).alias("n_first"), F.min("event_id").alias("first_id"))
    return counts.join(F.broadcast(again.agg(F.count(F.lit(1)).alias("n_again"))))  # one row each


PARENT = "case when doc_id = 0 then null when doc_id % 97 = 0 then doc_id + 1 when doc_id % 97 = 1 then doc_id - 1 else doc_id // 2 end"


@query("j13_bounded_chains", f"""with recursive p as (select doc_id as id, {PARENT} as parent from documents), a as (select id, 1 as hop, parent as ancestor, [id, parent] as seen from p where parent is not null and parent <> id
  union all select a.id, hop + 1, p.parent, list_append(seen, p.parent) from a join p on p.id = a.ancestor where hop < 10 and p.parent is not null and not list_contains(seen, p.parent)) select id, hop, ancestor from a""")
def _(spark, sf_dir):
    return chains.ancestors(_parents(spark, sf_dir))


def _parents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(PARENT.replace("doc_id // 2", "doc_id div 2")).alias("parent"))


@query("j12_roots", f"""with recursive p as (select doc_id as id, case when {PARENT} in (select doc_id from documents) then {PARENT} end as parent from documents), a as (select id, id as top from p where parent is null union all select p.id, a.top from a join p on p.parent = a.id) select id, top as root from a""")
def _(spark, sf_dir):
    return chains.roots(_parents(spark, sf_dir))


@query("p19_visible_kinds", f"{M} select id from memories where {CURRENT_SQL} and kind in ('fact', 'preference', 'decision', 'insight') and (scope_user is null or scope_user = 'u1')")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).where(predicates.current_truth(now()) & F.col("kind").isin("fact", "preference", "decision", "insight"))
    return rows.where(F.col("scope_user").isNull() | (F.col("scope_user") == "u1")).select("id")


@query("p20_chain_in_scope", f"""with recursive {MEMORIES_SQL}, p as (select doc_id as id, {PARENT} as parent from documents), a as (select id, 1 as hop, parent as ancestor, [id, parent] as seen from p where parent is not null and parent <> id
  union all select a.id, hop + 1, p.parent, list_append(seen, p.parent) from a join p on p.id = a.ancestor where hop < 3 and p.parent is not null and not list_contains(seen, p.parent))
  select a.id, hop, ancestor from a join memories m on m.id = ancestor where scope_user is null or scope_user = 'u2'""")
def _(spark, sf_dir):
    """Nodes of a chain that a principal may see: scope only, as closed rows are part of a history."""
    seen = memories(spark, sf_dir).where("scope_user is null or scope_user = 'u2'").select(F.col("id").alias("ancestor"))
    return chains.ancestors(_parents(spark, sf_dir), 3).join(seen, "ancestor", "left_semi")


@query("p23_live_legs", "select 'fts' as leg, (select count(*) > 0 from documents) as live union all select 'vec', (select count(*) > 0 from embeddings) union all select 'graph', (select count(*) > 0 from lineitem) union all select 'facts', (select count(*) > 0 from orders) union all select 'none', false")
def _(spark, sf_dir):
    legs = {"fts": "documents", "vec": "embeddings", "graph": "lineitem", "facts": "orders"}
    live = [(leg, not table(spark, sf_dir, name).isEmpty()) for leg, name in legs.items()]
    live.append(("none", not table(spark, sf_dir, "orders").where("false").isEmpty()))
    return spark.createDataFrame(live, "leg string, live boolean")


@query("j2_neighbour_rows", f"""{M}, k as (select a.vec_id as query, b.vec_id as doc, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id)::int as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0 qualify rank <= 24)
  select query, doc, rank, uid from k join memories on id = doc where {CURRENT_SQL} and kind in ('fact', 'decision')""")
def _(spark, sf_dir):
    """The neighbours' rows that pass the filters; ranks stay those of the search."""
    v = table(spark, sf_dir, "embeddings")
    near = vectors.nearest(v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), 24)
    own = memories(spark, sf_dir).where(predicates.current_truth(now()) & F.col("kind").isin("fact", "decision")).select(F.col("id").alias("doc"), "uid")
    return near.join(own, "doc").select("query", "doc", "rank", "uid")


@query("j3_facts_of_memories", f"""with {MEMORIES_SQL}, {FACTS_SQL}, cur as (select * from facts qualify row_number() over (partition by subject, predicate order by valid_from desc, fact_id desc) = 1)
  select fact_id, uid, subject, object from cur join memories on id = fact_id where {CURRENT_SQL.replace('valid_to', 'memories.valid_to').replace('status', 'memories.status')}""")
def _(spark, sf_dir):
    from lorekeep.operators.temporal import current_facts

    own = memories(spark, sf_dir).where(predicates.current_truth(now())).select(F.col("id").alias("fact_id"), "uid")
    return current_facts(facts(spark, sf_dir)).join(own, "fact_id").select("fact_id", "uid", "subject", "object")


@query("j7_j8_open_feeds", f"""{M} select id, id not in (select doc_id from labels where doc_id is not null) as unconsolidated, id not in (select o_orderkey from orders) as unindexed from memories where {CURRENT_SQL}""")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).where(predicates.current_truth(now())).select("id")
    mark = lambda name, key, flag: table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(True).alias(flag)).distinct()
    both = rows.join(mark("labels", "doc_id", "a"), "id", "left").join(mark("orders", "o_orderkey", "b"), "id", "left")
    return both.select("id", F.col("a").isNull().alias("unconsolidated"), F.col("b").isNull().alias("unindexed"))


@query("j26_edges_from_refs", "with t as (select doc_id, [source, lang] as refs from documents) select doc_id as src, p.n_name as dst, 'derived_from' as edge_type from t join (select 'src' || n_nationkey as n_name from nation) p on list_contains(refs, p.n_name)")
def _(spark, sf_dir):
    """Edges to the named rows that a list of references holds; references explode, so both sides meet by equality."""
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), F.explode(F.array_distinct(F.array("source", "lang"))).alias("dst"))
    named = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("dst"))
    return refs.join(named, "dst").select("src", "dst", F.lit("derived_from").alias("edge_type"))


@query("k2_end_markers", "select user_id as session_id, 'session_end_marker' as kind, max(ts) as at_ from events group by 1 having bool_or(event_type = 'signup')")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("at_"), F.max((F.col("event_type") == "signup").cast("int")).alias("ended"))
    return rows.where("ended = 1").select("session_id", F.lit("session_end_marker").alias("kind"), "at_")


@query("s18_sample", "with c as (select 0 as part, text as content from documents where length(text) >= 80 union all select 1, text from conversations where length(text) >= 200) select part::int as part, content from c order by part, md5('42' || content), content limit 300")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("text").alias("content"))
    return readers.sample_sources(own, table(spark, sf_dir, "conversations").select(F.col("text").alias("content")), 300)


CARD = "concat('IDENTITY: ', c_name, chr(10), chr(10), '  ATTRIBUTE: ', c_mktsegment, chr(10), case when c_custkey % 2 = 0 then 'free text' else 'NOTE: x' end)"


@query("v31_peer_cards", "select c_custkey, 'IDENTITY: ' || c_name || chr(10) || 'ATTRIBUTE: ' || c_mktsegment as card, c_name || chr(10) || 'plain' as free from customer")
def _(spark, sf_dir):
    free = F.concat(F.col("c_name"), F.lit("\n \nplain"))
    join = lambda c: F.array_join(learning.peer_card_lines(c), "\n")
    return table(spark, sf_dir, "customer").select("c_custkey", join(F.expr(CARD)).alias("card"), join(free).alias("free"))


@query("m6_provenance", f"""with recursive {MEMORIES_SQL}, {FACTS_SQL}, p as (select doc_id as id, {PARENT} as parent from documents), a as (select id, 1 as hop, parent as ancestor, [id, parent] as seen from p where parent is not null and parent <> id
  union all select a.id, hop + 1, p.parent, list_append(seen, p.parent) from a join p on p.id = a.ancestor where hop < 10 and p.parent is not null and not list_contains(seen, p.parent))
  select m.id, m.uid, kind, status, coalesce(n_chain, 0)::bigint as n_chain, coalesce(n_facts, 0)::bigint as n_facts, coalesce(n_injected, 0)::bigint as n_injected from memories m left join (select id, count(*) as n_chain from a group by id) using (id)
  left join (select fact_id as id, count(*) as n_facts from facts group by 1) using (id) left join (select user_id as id, count(*) as n_injected from events group by 1) using (id)""")
def _(spark, sf_dir):
    """The envelope of each memory with its chain, its facts and where it was injected."""
    count = lambda rows, key, name: rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(name))
    rows = memories(spark, sf_dir).select("id", "uid", "kind", "status")
    for part in (count(chains.ancestors(_parents(spark, sf_dir)), "id", "n_chain"), count(facts(spark, sf_dir), "fact_id", "n_facts"), count(table(spark, sf_dir, "events"), "user_id", "n_injected")):
        rows = rows.join(part, "id", "left")
    return rows.na.fill(0, ["n_chain", "n_facts", "n_injected"])


@query("m17_promoted_skills", r"select distinct substr(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 40) as name, 'promoted' as status from part where p_size % 3 <> 0")
def _(spark, sf_dir):
    """Skills forged from proposals with steps; their files are written first, their status follows."""
    steps = F.when(F.col("p_size") % 3 != 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    made = skills.forged(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("description"), steps.alias("steps")))
    return skills.promoted(spark, made, scratch(spark))


@query("m18_usage_records", "select event_type as name, count(*) as uses, count(*) filter (where value > 50) as failures, max(ts) as last_used from events group by 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit(1).alias("uses"), (F.col("value") > 50).cast("int").alias("failures"), F.col("ts").alias("last_used"), "event_id")
    half = lambda odd: rows.where(F.col("event_id") % 2 == odd).drop("event_id")
    return skills.merged_usage(half(0), half(1))


CONFIG = {"mode": "auto", "lane1_tokens": 400, "sync": False, "share": 0.5}


@query("k20_remembered", r"""with h as (select distinct trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')) as t from documents), c as (select distinct sha256(trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g'))) as h from conversations)
  select h as content_hash from c where h not in (select sha256(t) from h)""")
def _(spark, sf_dir):
    from lorekeep.operators.capture import remembered

    null = F.lit(None).cast("string")
    have = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), null.alias("scope_user"))
    new = table(spark, sf_dir, "conversations").select(F.col("text").alias("content"), null.alias("scope_user"))
    return remembered(have, new).select("content_hash")


_SLOPE = " + ".join(f"w[{i}] * x[{i}]" for i in range(1, 5))


@query(
    "v23_leg_weight_fit",
    f"""with recursive o as (select case when event_type in ('click', 'view') then 'fts' else 'vec' end as leg, event_id % 10 + 1 as rank, coalesce(value < 2 and not value > 50, false)::int as y, count(*)::double as n from events group by all),
    s as (select sum(n) as total, sum(n * rank) / sum(n) as m from o), d as (select sqrt(sum(n * (rank - m) * (rank - m)) / max(total)) as sd from o, s),
    t as materialized (select [(leg = 'fts')::int::double, (leg = 'vec')::int::double, (rank - m) / case when sd > 0 then sd else 1 end, 1.0] as x, y, n / total as share from o, s, d),
    g as (select 0 as i, [0.0, 0.0, 0.0, 0.0]::double[] as w union all
      select any_value(i) + 1, [any_value(w[1]) - 0.5 * (sum(x[1] * (1 / (1 + exp(-greatest(-35, least(35, {_SLOPE})))) - y) * share) + 0.001 * any_value(w[1]))]
        || [any_value(w[2]) - 0.5 * (sum(x[2] * (1 / (1 + exp(-greatest(-35, least(35, {_SLOPE})))) - y) * share) + 0.001 * any_value(w[2]))]
        || [any_value(w[3]) - 0.5 * (sum(x[3] * (1 / (1 + exp(-greatest(-35, least(35, {_SLOPE})))) - y) * share) + 0.001 * any_value(w[3]))]
        || [any_value(w[4]) - 0.5 * sum(x[4] * (1 / (1 + exp(-greatest(-35, least(35, {_SLOPE})))) - y) * share)]
      from g, t where i < 800 group by i),
    f as (select exp(w[1]) as a, exp(w[2]) as b from g where i = 800)
    select 'fts' as leg, round(least({learning.LEG_BAND[1]}, greatest({learning.LEG_BAND[0]}, a / ((a + b) / 2))), 4)::double as weight from f union all select 'vec', round(least({learning.LEG_BAND[1]}, greatest({learning.LEG_BAND[0]}, b / ((a + b) / 2))), 4)::double from f""",
)
def _(spark, sf_dir):
    from lorekeep.sources.store import outcomes

    rows = outcomes(spark, sf_dir).select(
        F.when(F.col("skill").isin("click", "view"), "fts").otherwise("vec").alias("leg"),
        (F.col("turn_id") % 10 + 1).alias("rank"),
        (F.coalesce(F.col("feedback") == "positive", F.lit(False))).cast("int").alias("helpful"),
    )
    found = learning.fit_leg_weights(rows, ("fts", "vec"), least=100) or {}
    return spark.createDataFrame([(k, round(v, 4)) for k, v in sorted(found.items())], "leg string, weight double")
