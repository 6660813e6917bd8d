"""Queries of the learning operators and the wider retrieval surfaces."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import scoring, text
from lorekeep.operators import clusters, fusion, learning, predicates, vectors
from lorekeep.plans.registry import query
from lorekeep.plans.retrieval import HYBRID, LEGS, _docs, _fused, _queries, hybrid
from lorekeep.session import table
from lorekeep.sources.store import CURRENT_SQL, MEMORIES_SQL, NOW_SQL, OUTCOMES_SQL, memories, now, outcomes

M = f"with {MEMORIES_SQL}"
_NEG = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in learning.NEGATION) + "]"
_SKIP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in (*learning.NEGATION, *learning.STOPWORDS)) + "]"


@query(
    "v11_polarity_conflicts",
    f"""with t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z'']+')) as w from documents)
    select a.doc_id, len(list_filter(list_intersect(a.w, b.w), lambda x: length(x) >= 4 and not list_contains({_SKIP}, x))) >= 2 and list_has_any(a.w, {_NEG}) <> list_has_any(b.w, {_NEG}) as conflict
    from t a join t b on a.doc_id + 1 = b.doc_id""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return rows.join(after, "doc_id").select("doc_id", learning.polarity_conflict(F.col("text"), F.col("other")).alias("conflict"))


@query(
    "v36_copied_words",
    """with s as (select item_id, list_filter(list_distinct(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(regexp_replace(w, '^[.,:;!?"''()\\[\\]]+|[.,:;!?"''()\\[\\]]+$', '', 'g')))), lambda w: length(w) >= 7) as w from benchmark)
    select a.item_id, case when len(a.w) = 0 then false else len(list_intersect(a.w, b.w))::double / len(a.w) > 0.05 end as copied from s a join s b on a.item_id + 1 = b.item_id""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("source"))
    return rows.join(after, "item_id").select("item_id", learning.copied_words(F.col("text"), F.col("source"), 0.05).alias("copied"))


VECTORS = "v as (select vec_id as id, label as scope, embedding::double[] as e from embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), F.col("embedding").alias("v"))


@query(
    "v2_j21_merge_candidates",
    f"""with {VECTORS}, s as (select a.id as new_id, b.id as old_id, list_cosine_similarity(a.e, b.e) as sim from v a join v b on a.scope is not distinct from b.scope and a.id <> b.id and a.id % 20 = 0)
    select new_id, old_id, round(sim, 6) as sim from s where sim >= 0.2 qualify row_number() over (partition by new_id order by sim desc, old_id) = 1""",
)
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return learning.merge_candidates(v.where("id % 20 = 0"), v, 0.2).withColumn("sim", F.round("sim", 6))


@query(
    "v2_j21_all_merge_candidates",
    f"""with {VECTORS}, s as (select a.id as new_id, b.id as old_id, list_cosine_similarity(a.e, b.e) as sim from v a join v b on a.scope is not distinct from b.scope and a.id <> b.id)
    select new_id, old_id, round(sim, 6) as sim from s where sim >= 0.2 qualify row_number() over (partition by new_id order by sim desc, old_id) = 1""",
)
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return learning.merge_candidates(v, v, 0.2).withColumn("sim", F.round("sim", 6))


@query(
    "v27_contrast_partners",
    f"""with {VECTORS}, p as (select *, id % 3 = 0 as ok from v), s as (select a.id, b.id as partner, list_cosine_similarity(a.e, b.e) as sim from p a join p b on a.scope = b.scope and a.ok <> b.ok where a.id % 20 = 0)
    select id, partner, round(sim, 6) as sim from s where sim >= 0.1 qualify row_number() over (partition by id order by sim desc, partner) = 1""",
)
def _(spark, sf_dir):
    pool = _vectors(spark, sf_dir).withColumn("ok", F.col("id") % 3 == 0)
    return learning.contrast_partners(pool.where("id % 20 = 0"), pool, 0.1).withColumn("sim", F.round("sim", 6))


def clusters_sql(threshold: float, k: int = 8, wanted: str = "true") -> str:
    """CTEs of the clusters of ``v`` (id, scope, e, won, barred): one pass over the seeds by recursion; ``picked`` (seed, members)."""
    return f"""sims as materialized (select a.id as seed, b.id as m, a.scope, list_cosine_similarity(a.e, b.e) as sim from v a join v b on a.scope is not distinct from b.scope and a.id <> b.id),
  near as (select seed, m, row_number() over (partition by seed order by sim desc, m) as nth from sims qualify nth <= {k} and sim >= {threshold}),
  alike as (select seed as a, m as b from sims where sim >= {threshold}),
  codes as (select x.seed, x.nth, x.m, list_concat([x.nth, 0], coalesce(list(y.nth) filter (where al.a is not null), [])) as code
    from near x left join near y on y.seed = x.seed and y.nth < x.nth left join alike al on al.a = x.m and al.b = y.m group by x.seed, x.nth, x.m),
  seeds as materialized (select v.id as seed, row_number() over (order by v.id) as pos, barred, list_concat([v.id], coalesce(list(m order by c.nth) filter (where m is not null), [])) as ms,
    coalesce(list(code order by c.nth) filter (where m is not null), []) as codes from v left join codes c on c.seed = v.id group by v.id, barred),
  walk(pos, taken, seed, members) as (
    select 0::bigint, []::bigint[], null::bigint, []::bigint[]
    union all
    select pos, case when fits then list_concat(taken, got) else taken end, seed, case when fits then got else [] end from (
      select *, len(got) >= 3 and {wanted} as fits from (
        select s.pos, w.taken, s.seed, case when s.barred or list_contains(w.taken, s.seed) then [] else list_transform(list_reduce(list_filter(s.codes, lambda x: not list_contains(w.taken, s.ms[x[1] + 1])),
          lambda a, x: case when list_has_all(x[2:], a) then list_append(a, x[1]) else a end, [0::bigint]), lambda i: s.ms[i + 1]) end as got
        from walk w join seeds s on s.pos = w.pos + 1))),
  picked as (select seed, members from walk where len(members) > 0)"""


@query(
    "v5_v6_w10_seed_clusters",
    f"with recursive v as (select vec_id as id, label as scope, embedding::double[] as e, false as won, false as barred from embeddings), {clusters_sql(0.2)} select v.scope, seed, unnest(members) as member from picked join v on v.id = seed",
)
def _(spark, sf_dir):
    """Greedy exclusive clusters of each scope, in the order of their seeds, over the eight nearest rows of each."""
    return clusters.greedy_clusters(_vectors(spark, sf_dir), 0.2)


@query("v32_probes", f"""{M} select * from (select 'tombstone_open' as probe, count(*) filter (where status = 'tombstone' and valid_to is null) as failures from memories
  union all select 'superseded_open', count(*) filter (where status = 'summarized' and valid_to is null) from memories union all select 'quarantine_pinned', count(*) filter (where status = 'quarantined' and pinned) from memories)""")
def _(spark, sf_dir):
    return learning.probes(memories(spark, sf_dir))


@query("v7_o11_surprising", f"""{M}, r as (select source as scope, id, row_number() over (partition by source order by surprise desc, id) as nth, count(*) over (partition by source) as n from memories)
  select scope, id from r where nth <= greatest(1, n // 10) and nth <= 5""")
def _(spark, sf_dir):
    return learning.surprising(memories(spark, sf_dir).withColumn("scope", F.col("source"))).select("scope", "id")


@query("v33_v34_harm_verdicts", f"""with {OUTCOMES_SQL}, c as (select session_id, count(*) filter (where outcome = 'verified') as helped, count(*) filter (where outcome in ('failed', 'blocked')) as hurt from outcomes group by session_id),
  w as (select *, helped + hurt as n, case when helped + hurt > 0 then hurt::double / (helped + hurt) end as p from c),
  l as (select session_id, helped, hurt, n, case when n > 0 then greatest(0.0, (p + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)) else 0.0 end as low from w)
  select session_id, n >= 5 and hurt > helped and low >= 0.2 as harmful from l""")
def _(spark, sf_dir):
    rows = outcomes(spark, sf_dir).groupBy("session_id").agg(
        F.count_if(F.col("outcome") == "verified").alias("helped"), F.count_if(F.col("outcome").isin("failed", "blocked")).alias("hurt")
    )
    n = F.col("helped") + F.col("hurt")
    low = scoring.wilson_bounds(F.col("hurt"), n)[0]
    return rows.select("session_id", ((n >= 5) & (F.col("hurt") > F.col("helped")) & (low >= 0.2)).alias("harmful"))


@query("r23_blend", f"""with {HYBRID}, asked as (select distinct query from q), strong as (select 'm:' || doc as key, row_number() over (order by helpful desc, valid_from desc, doc) as rank from docs qualify rank <= 20),
  fresh as (select 'm:' || doc as key, row_number() over (order by valid_from desc, doc) as rank from docs where valid_from >= {NOW_SQL} - interval 45 day qualify rank <= 20)
  select query, key, round(sum(1.0 / (60 + rank)), 8)::double as score from (select query, key, rank from hits where key like 'm:%' union all select query, key, rank from asked, strong union all select query, key, rank from asked, fresh) group by all""")
def _(spark, sf_dir):
    """The semantic hits of each query blended with the most reinforced and the newest memories."""
    docs = _docs(spark, sf_dir).withColumn("key", F.concat(F.lit("m:"), F.col("doc").cast("string")))
    asked = _queries(spark, sf_dir).select("query").distinct()

    def leg(rows, name, *order):
        """Twenty rows, cut before they are ranked and handed to every query of the stated set."""
        best = rows.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        return asked.join(F.broadcast(best.select("key", F.lit(name).alias("leg"), "rank")))

    found = hybrid(spark, sf_dir).where(F.col("key").startswith("m:")).select("query", "key", F.lit("fts").alias("leg"), "rank")
    strong = leg(docs, "vec", F.desc("helpful"), F.desc("valid_from"), "doc")
    fresh = leg(docs.where(predicates.recent(45, now())), "graph", F.desc("valid_from"), "doc")
    return fusion.rrf([found, strong, fresh]).select("query", "key", F.round("score", 8).alias("score"))


@query("r24_federated", f"""with {LEGS}, p as (select query, key, coalesce(lang, '-') as profile, row_number() over (partition by query, coalesce(lang, '-') order by round(score, 8) desc, key) as rank from fused join docs on key = 'm:' || doc)
  select query, profile, key, round(case when profile = 'en' then 1.0 else 0.85 end / (60 + rank), 8)::double as score from p""")
def _(spark, sf_dir):
    """Memories of each language as a store of its own; the local one is English, linked ones weigh less."""
    own = _docs(spark, sf_dir).select(F.concat(F.lit("m:"), F.col("doc").cast("string")).alias("key"), F.coalesce("lang", F.lit("-")).alias("profile"))
    rows = _fused(spark, sf_dir).join(own, "key")
    order = Window.partitionBy("query", "profile").orderBy(F.desc(F.round("score", 8)), "key")
    weight = F.when(F.col("profile") == "en", 1.0).otherwise(0.85)
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.select("query", "profile", "key", F.round(weight / (F.lit(60.0) + F.col("rank")), 8).alias("score"))


@query("r36_index_lines", f"{M} select id, concat_ws(' | ', uid, coalesce(kind, '-'), substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 60)) as line from memories where {CURRENT_SQL}")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).where(predicates.current_truth(now()))
    return rows.select("id", F.concat_ws(" | ", "uid", F.coalesce("kind", F.lit("-")), text.clip(F.col("content"), 60)).alias("line"))


@query("r27_cache_lookup", r"""with t as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from benchmark), a as (select * from t where item_id % 20 = 0)
  select a.item_id, max(len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) >= 0.9 as cached from a join t b on a.item_id <> b.item_id group by a.item_id""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("w"))
    asked = rows.where("item_id % 20 = 0").select(F.col("item_id").alias("q"), F.col("w").alias("qw"))
    # cached queries that share no token can't be alike, so they meet by token
    a, b = asked.select("q", "qw", F.explode("qw").alias("t")), rows.select("item_id", "w", F.explode("w").alias("t"))
    near = a.join(b, "t").where("q <> item_id").groupBy("q", "item_id").agg(F.first("qw").alias("qw"), F.first("w").alias("w"))
    best = near.groupBy("q").agg(F.max(text.jaccard(F.col("qw"), F.col("w"))).alias("s"))
    return asked.join(best, "q", "left").select(F.col("q").alias("item_id"), (F.coalesce("s", F.lit(0.0)) >= 0.9).alias("cached"))


@query("k16_s14_archive_recovery", "select user_id, max(event_id) as event_id from events group by user_id")
def _(spark, sf_dir):
    from lorekeep.operators.lifecycle import recover

    return recover(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id")


@query("k8_cascade", f"with closed as (select c_custkey from customer where c_acctbal < 0) select o_orderkey, case when o_custkey in (select c_custkey from closed) then {NOW_SQL} end as valid_until from orders")
def _(spark, sf_dir):
    from lorekeep.operators.lifecycle import cascade

    closed = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("timestamp").alias("valid_until"))
    return cascade(closed, orders, "o_custkey", now(), "valid_until").select("o_orderkey", "valid_until")


@query("s17_topic_views", "select unnest([lang, source]) as topic, count(*) as n from documents group by 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("j22_similar_pairs", f"with {VECTORS} select a.id as a, b.id as b, round(list_cosine_similarity(a.e, b.e), 6) as sim from v a join v b on a.id < b.id where list_cosine_similarity(a.e, b.e) >= 0.4")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    return vectors.similar_pairs(rows, 0.4).withColumn("sim", F.round("sim", 6))


@query(
    "v6_skill_clusters",
    f"""with recursive w as (select vec_id as id, embedding::double[] as e from embeddings where vec_id % 25 = 1),
    v as (select vec_id as id, label as scope, embedding::double[] as e, vec_id % 3 = 0 as won, exists (select 1 from w where w.id <> vec_id and list_cosine_similarity(w.e, embedding::double[]) >= 0.6) as barred from embeddings),
    {clusters_sql(0.15, 12, "len(list_filter(got, lambda i: i % 3 = 0)) >= 2")}
    select seed, len(list_filter(members, lambda i: i % 3 = 0)) as n_success, len(list_filter(members, lambda i: i % 11 = 0)) > 0 as is_gold, len(members) as n from picked""",
)
def _(spark, sf_dir):
    """Clusters that can become a skill: three members, two of them successes, and no skill as near to the seed; every 25th row is a skill."""
    rows = _vectors(spark, sf_dir).withColumns({"success": F.col("id") % 3 == 0, "gold": F.col("id") % 11 == 0})
    skills = rows.where("id % 25 = 1").select(F.col("id").alias("doc"), "v")
    covered = vectors.nearest(skills, rows.select(F.col("id").alias("query"), F.col("v").alias("q")), 1).where("sim >= 0.6").select(F.col("query").alias("id"))
    found = clusters.greedy_clusters(rows, 0.15, neighbours=12, successes=2, barred=covered)
    own = rows.select(F.col("id").alias("member"), "success", "gold")
    return found.join(own.hint("merge"), "member").groupBy("seed").agg(F.count_if("success").alias("n_success"), F.max("gold").alias("is_gold"), F.count(F.lit(1)).alias("n"))
