"""Queries of injected models, the retrieval log, probes, drafts, patterns and guidance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import scoring, text
from lorekeep.operators import clusters, encoders, gateway, graph, injections, patterns, predicates, vectors
from lorekeep.plans.insight import _vectors, clusters_sql
from lorekeep.plans.registry import query
from lorekeep.plans.retrieval import CURRENT, ENTITY, FIELDS, QUERIES, TOK, _docs, _index, _queries, bm25_sql
from lorekeep.session import scratch, stored, table
from lorekeep.sources.store import CURRENT_SQL, MEMORIES_SQL, memories, now


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


_CHAIN = ", ".join(f"sha256(unhex({'sha256(token)' if i == 1 else f'h{i - 1}'})) as h{i}" for i in range(1, 9))


@query(
    "r37_hashed_vectors",
    rf"""with w as (select item_id, unnest(case when len(t) = 0 then ['∅'] else t end) as token from (select item_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+') as t from benchmark)),
    n as (select item_id, token, count(*) as n from w group by all), h as (select token, concat(h1, h2, h3, h4, h5, h6, h7, h8) as h from (select token, {_CHAIN} from (select distinct token from w))),
    b as (select token, i::int as i, ('0x' || substr(h, 2 * i::int + 1, 2))::int as b from h, range(256) r(i)),
    u as (select item_id, i, sum(n * (2 * b - 255))::bigint as u from n join b using (token) group by item_id, i)
    select item_id as id, i, u / sqrt(sum(u * u) over (partition by item_id)::double) as x from u""",
)
def _(spark, sf_dir):
    """The vectors of the model of a store without one, number by number."""
    return encoders.embedded(_items(spark, sf_dir), encoders.hash_model()).select("id", F.posexplode("v").alias("i", "x"))


@query("k28_backfill_runs", "select 1 as run, count(*) filter (where item_id % 3 = 0) as written from benchmark union all select 2, count(*) filter (where item_id % 3 <> 0) from benchmark union all select 3, 0 from (values (1)) union all select 4, count(*) from benchmark")
def _(spark, sf_dir):
    """A table of vectors filled in two runs, a third that finds nothing to do, and one with another model."""
    rows, path = _items(spark, sf_dir), scratch(spark)
    first, other = encoders.VectorTable(spark, path, encoders.hash_model(32)), encoders.VectorTable(spark, path, encoders.hash_model(16))
    runs = [first.backfill(rows.where("id % 3 = 0")), first.backfill(rows), first.backfill(rows), other.backfill(rows)]
    return spark.createDataFrame(list(enumerate(runs, 1)), "run int, written long")


#: A question is searched for by its first three different words; of the five best memories the smallest uid is cited.
ASK_SQL = rf"""{CURRENT}, words as (select item_id as query, text, unnest({TOK.format('text')}) as term, generate_subscripts({TOK.format('text')}, 1) as at_ from benchmark where item_id % 20 = 0),
  q as (select query, term from (select query, term, min(at_) as at_ from words group by all) qualify row_number() over (partition by query order by at_) <= 3), {bm25_sql('bm25', 'docs', 'doc', FIELDS)},
  hits as (select query, 'D' || lpad(doc::varchar, 7, '0') as uid from bm25 qualify row_number() over (partition by query order by round(score, 6) desc, doc) <= 5),
  lines as (select query, min(uid) as first, string_agg(uid, chr(10) order by uid) as found from hits group by query)"""


def _ask(spark, sf_dir):
    def search(terms):
        uid = F.concat(F.lit("D"), F.lpad(F.col("doc").cast("string"), 7, "0"))
        return _index(spark, sf_dir).search(terms, 5).select("query", uid.alias("uid"), uid.alias("line"))

    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query"), "text")
    return gateway.asked(items, gateway.scripted(), search)


@query("r31_asked_in_rounds", f"with {ASK_SQL} select item_id as query, first is not null as answered, case when first is not null then 'See ' || first end as answer, coalesce(first, '') as citations from benchmark left join lines on query = item_id where item_id % 20 = 0")
def _(spark, sf_dir):
    """Questions put to a scripted model in rounds of calls and searches; a uid that was not found is not cited."""
    answers, _ = _ask(spark, sf_dir)
    return answers.withColumn("citations", F.array_join("citations", ","))


@query(
    "k33_ledger",
    f"""with {ASK_SQL}, p as (select 'round 1' as tier, to_json({{'round': 1, 'of': 3, 'question': text, 'found': ''}})::varchar as prompt from benchmark where item_id % 20 = 0
      union all select 'round 2', to_json({{'round': 2, 'of': 3, 'question': text, 'found': coalesce(found, '')}})::varchar from benchmark left join lines on query = item_id where item_id % 20 = 0)
    select tier, 'answered' as status, count(*) as n, count(*) as attempts, sum(greatest(1, length(prompt) // 4))::bigint as tokens_in from p group by tier""",
)
def _(spark, sf_dir):
    """What the calls of those rounds cost, by round."""
    return gateway.spent(_ask(spark, sf_dir)[1]).select("tier", "status", "n", "attempts", "tokens_in")


LOG_SQL = "log as (select user_id::varchar as session, ts, event_id as id, case event_type when 'view' then 'inject' when 'purchase' then 'turn' else 'blank' end as kind, event_id % 50 as memory from events)"
LOGGED = "2024-01-20"


def _log(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "inject").when(F.col("event_type") == "purchase", "turn").otherwise("blank")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 50).alias("memory"))


@query(
    "k25_k26_stamped_log",
    f"""with {LOG_SQL}, i as (select *, lead(ts) over (partition by session order by ts, id) as next_ts, lead(id) over (partition by session order by ts, id) as next_id from log where kind = 'inject'),
    m as (select i.id, min((t.ts, t.id)) as turn from i left join log t on t.session = i.session and t.kind = 'turn' and (t.ts, t.id) > (i.ts, i.id) and t.ts <= i.ts + interval 48 hour group by i.id)
    select i.session, i.id, i.memory, not (next_id is not null and next_ts <= least(i.ts + interval 48 hour, timestamp '{LOGGED}') and (t.id is null or (next_ts, next_id) < (t.ts, t.id))) as injected, t.id as turn,
      case when t.id is not null then 'stamped' when i.ts + interval 48 hour < timestamp '{LOGGED}' then 'expired' else 'pending' end as state
    from i join m using (id) left join log t on t.kind = 'turn' and (t.ts, t.id) = m.turn and t.session = i.session""",
)
def _(spark, sf_dir):
    """Injections with the turn that each landed in, those that another one replaced, and those whose wait is over."""
    return injections.stamped(_log(spark, sf_dir), F.lit(LOGGED).cast("timestamp")).drop("at")


@query("k25_recalls", f"with {LOG_SQL} select memory, count(*) as recalls, max(ts)::varchar as last_recalled_at from log where kind = 'inject' group by memory")
def _(spark, sf_dir):
    out = injections.recalls(_log(spark, sf_dir))
    exact = F.regexp_replace(F.date_format("last_recalled_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return out.withColumn("last_recalled_at", F.when(F.date_format("last_recalled_at", "SSSSSS") == "000000", F.date_format("last_recalled_at", "yyyy-MM-dd HH:mm:ss")).otherwise(exact))


PROBED = "id % 20 = 0 and (pinned or helpful >= 2)"


@query(
    "v32_self_retrieval",
    f"""with {CURRENT}, q as (select id as query, unnest(list_distinct({TOK.format('summary')})) as term from memories where {CURRENT_SQL} and {PROBED}), {bm25_sql('bm25', 'docs', 'doc', FIELDS)},
    best as (select query, doc from bm25 qualify row_number() over (partition by query order by round(score, 6) desc, doc) <= 5)
    select id, exists (select 1 from best where query = id and doc = id) as passed from memories where {CURRENT_SQL} and {PROBED} and len({TOK.format('summary')}) > 0""",
)
def _(spark, sf_dir):
    """Whether valued memories are among the five best for the words of their own summaries, all of them searched at once."""
    rows = memories(spark, sf_dir).where(predicates.current_truth(now())).where(PROBED)
    asked = rows.select(F.col("id").alias("query"), F.explode(F.array_distinct(text.tokens(F.col("summary")))).alias("term"))
    found = _index(spark, sf_dir).recalled(asked, 5).select(F.col("query").alias("id"), F.lit(True).alias("passed"))
    probes = asked.select(F.col("query").alias("id")).distinct()
    return probes.join(found, "id", "left").select("id", F.coalesce("passed", F.lit(False)).alias("passed"))


DRAFT = {"replay": 0.2, "least": 3, "rate": 0.6, "bound": 0.2}


@query(
    "v33_draft_gates",
    f"""with recursive v as (select vec_id as id, label as scope, embedding::double[] as e, vec_id % 3 <> 0 as won, false as barred from embeddings), {clusters_sql(0.2)},
    m as (select seed, unnest(members) as member from picked), j as (select m.seed, member, a.won, list_cosine_similarity(a.e, b.e) as sim from m join v a on a.id = member join v b on b.id = m.seed),
    c as (select seed, count(*) as n, count(*) filter (where won) as k, count(*) filter (where member <> seed and sim >= {DRAFT['replay']}) as again from j group by seed), p as (select *, k / n::double as r from c)
    select seed, n, again * 2 > n - 1 as replays, n >= {DRAFT['least']} and r >= {DRAFT['rate']} and (r + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(r * (1 - r) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n) >= {DRAFT['bound']} as proven from p""",
)
def _(spark, sf_dir):
    """The gates of a skill's draft: most other members are like its seed, and enough of them succeeded."""
    rows = _vectors(spark, sf_dir)
    found = clusters.greedy_clusters(rows, 0.2)
    own = rows.select(F.col("id").alias("member"), F.col("v").alias("mv"), (F.col("id") % 3 != 0).alias("won"))
    seeds = rows.select(F.col("id").alias("seed"), F.col("v").alias("sv"))
    near = (F.col("member") != F.col("seed")) & (vectors.cosine(F.col("mv"), F.col("sv")) >= DRAFT["replay"])
    sums = found.join(own.hint("merge"), "member").join(seeds.hint("merge"), "seed").groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count_if("won").alias("k"), F.count_if(near).alias("again"))
    n, k = F.col("n"), F.col("k")
    proven = (n >= DRAFT["least"]) & (k / n >= DRAFT["rate"]) & (scoring.wilson_bounds(k, n)[0] >= DRAFT["bound"])
    return sums.select("seed", "n", (F.col("again") * 2 > n - 1).alias("replays"), proven.alias("proven"))


@query(
    "v9_patterns_and_edges",
    f"""with recursive v as (select vec_id as id, label as scope, embedding::double[] as e, false as won, false as barred from embeddings), {clusters_sql(0.2)},
    w as (select vec_id as id, ['owner', 'agent', 'known_user', 'tool', 'untrusted'][1 + vec_id % 5] as tier, vec_id % 5 as rank, (vec_id % 10)::double / 10 as importance from embeddings),
    m as (select seed, unnest(members) as member from picked), j as (select m.*, w.* from m join w on w.id = member)
    select 'patterns' as kind, 'P' || seed as name, count(*) as n, least(1.0, round(avg(importance) + 0.05 * count(*), 9))::double as x, arg_max(tier, rank) as tier from j group by seed
    union all select 'edges', 'P' || seed, member, 0.9, 'derived_from' from j union all select 'members', member::varchar, 0, round(importance * 0.7, 9), '' from j""",
)
def _(spark, sf_dir):
    """Patterns, their edges and the fading of their members, read from tables whose batch was stopped halfway once and sent again."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    tier = F.element_at(F.array(*[F.lit(t) for t in scoring.TRUST_ORDER]), (F.col("id") % 5 + 1).cast("int"))
    rows = ids.select("id", tier.alias("trust_tier"), ((F.col("id") % 10).cast("double") / 10).alias("importance"))
    plan, path = patterns.planned(clusters.greedy_clusters(_vectors(spark, sf_dir), 0.2), rows), scratch(spark)
    try:
        patterns.written(plan, path, 1, fail_after="edges")
    except RuntimeError:
        patterns.written(plan, path, 1)
    out = patterns.read(spark, path, "patterns").select(F.lit("patterns").alias("kind"), F.col("uid").alias("name"), "n", F.col("importance").alias("x"), F.col("trust_tier").alias("tier"))
    edges = patterns.read(spark, path, "edges").select(F.lit("edges"), "src", "dst", "confidence", "edge_type")
    faded = patterns.read(spark, path, "members").select(F.lit("members"), F.col("id").cast("string"), F.lit(0).cast("long"), "importance", F.lit(""))
    return out.union(edges).union(faded)


GUIDE = {"strategy": 0.1, "case": 0.15, "profile": 0.1}


@query(
    "r25_guidance",
    f"""with {CURRENT}, own as (select doc, kind, helpful, harmful, outcome, trust_tier, e from docs join (select id, trust_tier from memories) t on t.id = doc join (select vec_id, embedding::double[] as e from embeddings) on vec_id = doc),
    knn as (select q.vec_id as query, own.*, list_cosine_similarity(q.embedding::double[], own.e) as sim from embeddings q join own on own.doc <> q.vec_id where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by sim desc, doc) <= 16),
    w as (select *, helpful + harmful as n, case when helpful + harmful > 0 then helpful::double / (helpful + harmful) else 0 end as p from knn),
    s as (select *, case when n > 0 then greatest(0.0, (p + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)) else 0.0 end as low from w),
    g as (select query, doc, kind, case when kind = 'strategy' and sim >= {GUIDE['strategy']} and not (n >= 5 and harmful > helpful) then sim * (0.5 + 0.5 * low)
      when kind = 'case' and sim >= {GUIDE['case']} and query % 40 = 0 then sim * case when outcome = 'failed' then 1.15 else 1.0 end when kind = 'profile' and sim >= {GUIDE['profile']} and trust_tier = 'owner' then sim end as score from s)
    select query, doc, kind, round(score, 6) as score from g where score is not null qualify row_number() over (partition by query, kind order by round(score, 6) desc, doc) <= case kind when 'strategy' then 3 else 2 end""",
)
def _(spark, sf_dir):
    """Strategies, cases and peer cards among a query's sixteen nearest memories; cases for task-like queries (here every second), cards of owners only."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    docs = _docs(spark, sf_dir).select("doc", "kind", "helpful", "harmful", "outcome", "trust_tier")
    asked = rows.where("doc % 20 = 0").select(F.col("doc").alias("query"), F.col("v").alias("q"))
    near = vectors.nearest(rows.join(docs.select("doc"), "doc", "left_semi"), asked, 16).join(docs, "doc")
    sim, n = F.col("sim"), F.col("helpful") + F.col("harmful")
    low = scoring.wilson_bounds(F.col("helpful"), n)[0]
    kind = F.col("kind")
    strategy = F.when((kind == "strategy") & (sim >= GUIDE["strategy"]) & ~((n >= 5) & (F.col("harmful") > F.col("helpful"))), sim * (0.5 + 0.5 * low))
    case = F.when((kind == "case") & (sim >= GUIDE["case"]) & (F.col("query") % 40 == 0), sim * F.when(F.col("outcome") == "failed", 1.15).otherwise(1.0))
    card = F.when((kind == "profile") & (sim >= GUIDE["profile"]) & (F.col("trust_tier") == "owner"), sim)
    scored = near.withColumn("score", F.round(F.coalesce(strategy, case, card), 6)).where("score is not null")
    nth = F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= F.when(kind == "strategy", 3).otherwise(2)).select("query", "doc", "kind", "score")


@query(
    "r34_deep_recall",
    f"""with {CURRENT}, {QUERIES}, {bm25_sql('bm25', 'docs', 'doc', FIELDS)}, top3 as materialized (select query, doc from bm25 qualify row_number() over (partition by query order by round(score, 6) desc, doc) <= 3),
    mentions as materialized (select distinct doc as memory, unnest(regexp_extract_all(content, '{ENTITY}')) as entity from docs),
    near as (select t.query, o.memory as doc, count(distinct o.entity) as shared from top3 t join mentions m on m.memory = t.doc join mentions o on o.entity = m.entity where (t.query, o.memory) not in (select (query, doc) from top3) group by all)
    select query, doc, content, false as neighbour from top3 join docs using (doc) union all select query, doc, null, true from near qualify row_number() over (partition by query order by shared desc, doc) <= 6""",
)
def _(spark, sf_dir):
    """The whole texts of each query's three best memories, and six more that share most entities with them."""
    docs, named = _docs(spark, sf_dir).select("doc", "content"), F.regexp_extract_all("content", F.lit(ENTITY), F.lit(0))
    best = stored(_index(spark, sf_dir).search(_queries(spark, sf_dir), 3).select("query", "doc"))
    top = stored(docs.join(F.broadcast(best), "doc"))  # three rows of each stated query
    lists = docs.select(F.col("doc").alias("memory"), F.array_distinct(named).alias("entities"))
    near = graph.most_shared(lists, top.select("query", F.explode(named).alias("entity")), best.withColumnRenamed("doc", "memory"), 6)
    near = near.select("query", F.col("memory").alias("doc"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("neighbour"))
    return top.select("query", "doc", "content", F.lit(False).alias("neighbour")).unionByName(near)


@query(
    "v10_contradiction_pairs",
    f"""with {MEMORIES_SQL}, r as (select id, scope_user as scope, sha256(content) as h, embedding::double[] as e from memories join embeddings on vec_id = id where {CURRENT_SQL}),
    k as (select a.id as a, b.id as b, a.h as ha, b.h as hb, list_cosine_similarity(a.e, b.e) as sim from r a join r b on a.id <> b.id and a.scope is not distinct from b.scope qualify row_number() over (partition by a.id order by sim desc, b.id) <= 6)
    select least(a, b) as a, greatest(a, b) as b, round(max(sim), 6) as sim from k where sim >= 0.2 and ha <> hb group by 1, 2""",
)
def _(spark, sf_dir):
    """Pairs of near neighbours of one owner that say different things; each pair once."""
    own = memories(spark, sf_dir).where(predicates.current_truth(now())).select("id", F.col("scope_user").alias("scope"), F.sha2("content", 256).alias("h"))
    rows = own.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    near = vectors.nearest(rows.select(F.col("id").alias("doc"), "v", "scope"), rows.select(F.col("id").alias("query"), F.col("v").alias("q"), "scope"), 6, key="scope")
    said = near.join(own.select(F.col("id").alias("query"), F.col("h").alias("hq")), "query").join(own.select(F.col("id").alias("doc"), F.col("h").alias("hd")), "doc").where("hq <> hd")
    return vectors.neighbour_pairs(said, 0.2).withColumn("sim", F.round("sim", 6))
