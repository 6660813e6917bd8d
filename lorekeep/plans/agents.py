"""Queries of caches, context blocks, answers, due checks, proposals and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import due, evalkit, fts, fusion, grams, predicates, proposals, recall
from lorekeep.plans.functions import NORMAL_SQL
from lorekeep.plans.registry import query
from lorekeep.plans.retrieval import CURRENT, FIELDS, TOK, _docs, _index, bm25_sql
from lorekeep.session import stored, table
from lorekeep.sources.indexes import built
from lorekeep.sources.store import CURRENT_SQL, FACTS_SQL, MEMORIES_SQL, NOW_SQL, facts, memories, now

ASKED = "case item_id % 4 when 0 then text when 1 then concat(' ', upper(text), '  ') when 2 then concat(text, ' extra') else concat(reverse(text), ' q') end"


@query(
    "r27_cache_tiers",
    rf"""with c as (select item_id as entry, text, {NORMAL_SQL.format('text')} as norm, embedding::double[] as v from benchmark join embeddings on vec_id = item_id),
    a as (select 1000000 + item_id as query, {ASKED} as text, {NORMAL_SQL.format(ASKED)} as norm, embedding::double[] as v from benchmark join embeddings on vec_id = item_id),
    w as (select entry, norm, v, text, list_distinct(regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+')) as u from c), b as (select *, list_distinct(regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+')) as u from a),
    x as (select b.query, w.entry, b.norm = w.norm as same, b.text = w.text as raw, len(list_intersect(b.u, w.u))::double / (len(b.u) + len(w.u) - len(list_intersect(b.u, w.u))) as j, list_cosine_similarity(b.v, w.v) as s from b, w),
    t as (select query, entry, case when same and raw then 1 when same then 2 when j >= 0.9 then 3 when s >= 0.93 then 4 end as tier, case when same then 0 when j >= 0.9 then -j else -s end as worse from x)
    select query, max(entry) filter (where nth = 1 and tier is not null) as entry, max(case tier when 1 then 'exact' when 2 then 'normalised' when 3 then 'jaccard' when 4 then 'semantic' end) filter (where nth = 1) as tier
    from (select *, row_number() over (partition by query order by tier nulls last, worse, entry) as nth from t) group by query""",
)
def _(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    rows = table(spark, sf_dir, "benchmark").join(v, "item_id")
    asked = rows.select((F.col("item_id") + 1000000).alias("query"), F.expr(ASKED).alias("text"), "v")
    return recall.cache_tier(asked, rows.select(F.col("item_id").alias("entry"), "text", "v")).select("query", "entry", "tier")


def _section(rows, keep, limit, clip, *order):
    from pyspark.sql import Window

    best = rows.where(keep).withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy(*order))).where(F.col("nth") <= limit)
    return best.select("block", "nth", F.concat(F.lit("- "), text.clip(F.col("content"), clip)).alias("line"))


def _section_sql(name, keep, limit, clip, order):
    return rf"{name} as (select source as block, row_number() over (partition by source order by {order}) as nth, '- ' || substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, {clip}) as line from cur where {keep} qualify nth <= {limit})"


def _fit_sql(name, lines, left, header, share=None):
    given = f"floor(left_ * {share})" if share else "left_"
    head = max(1, len(header) // 4)
    return rf"""{name} as (select * from (select l.block, l.nth, l.line, {head} + sum(greatest(1, length(line) // 4)) over w as used, sum(len(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> ''))) over w as words, {given}::bigint as budget
      from {lines} l join {left} using (block) window w as (partition by l.block order by l.nth)) where used <= budget and words <= floor(budget * 0.75) and {head} < budget),
    {name}_left as (select block, left_ - coalesce(max(used), 0) as left_ from {left} left join {name} using (block) group by block, left_)"""


@query(
    "r28_context_sections",
    f"""with {MEMORIES_SQL}, cur as (select * from memories where {CURRENT_SQL}), {_section_sql('identity', "kind = 'profile'", 8, 200, 'pinned desc, valid_from desc, id')}, {_section_sql('peer', "kind = 'preference'", 1, 400, 'valid_from desc, id')},
    {_section_sql('summary', "kind is null or kind not in ('strategy', 'case', 'profile', 'preference')", 12, 200, 'valid_from desc, id')}, {_section_sql('recent', "kind = 'case'", 20, 160, 'surprise desc, id')},
    b0 as (select distinct source as block, 420 as left_ from cur), {_fit_sql('f0', 'identity', 'b0', '## Identity')}, {_fit_sql('f1', 'peer', 'f0_left', '## About')}, {_fit_sql('f2', 'summary', 'f1_left', '## Summary', 0.4)}, {_fit_sql('f3', 'recent', 'f2_left', '## Recent')}
    select block, 0 as section, nth, line, used::bigint as used from f0 union all select block, 1, nth, line, used::bigint from f1 union all select block, 2, nth, line, used::bigint from f2 union all select block, 3, nth, line, used::bigint from f3""",
)
def _(spark, sf_dir):
    """A context of 420 tokens for each source: identity, peer card, summary and recent lines."""
    cur = memories(spark, sf_dir).where(predicates.current_truth(now())).withColumn("block", F.col("source"))
    kind, new = F.col("kind"), (F.desc("valid_from"), "id")
    identity = _section(cur, kind == "profile", 8, 200, F.desc("pinned"), *new)
    peer = _section(cur, kind == "preference", 1, 400, *new)
    summary = _section(cur, kind.isNull() | ~kind.isin("strategy", "case", "profile", "preference"), 12, 200, *new)
    recent = _section(cur, kind == "case", 20, 160, F.desc("surprise"), "id")
    budgets = cur.select("block", F.lit(420).alias("tokens")).distinct()
    out = recall.context_block(identity, peer, summary, recent, budgets)
    return out.withColumn("used", F.col("used").cast("long"))


@query(
    "r29_recalled_blocks",
    rf"""with h as (select conv_id as query, turn as rank, role = 'user' as is_episode, '[c' || conv_id || ']' as prefix, trim(regexp_replace(text, '\s+', ' ', 'g')) as body from conversations),
    k as (select *, row_number() over (partition by query, is_episode order by rank) as of_kind from h), l as (select query, rank, rtrim(prefix || ' ' || case when is_episode then substr(body, 1, 200) else body end) as line from k where not is_episode or of_kind = 1),
    u as (select *, 4 + sum(greatest(1, length(line) // 4)) over (partition by query order by rank) as used from l) select query, rank, line, used::bigint as used from u where used <= 120""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("query"), F.col("turn").alias("rank"), (F.col("role") == "user").alias("is_episode"),
        F.concat(F.lit("[c"), F.col("conv_id").cast("string"), F.lit("]")).alias("prefix"), F.col("text").alias("body"),
    )
    return recall.recalled_block(rows, 120).withColumn("used", F.col("used").cast("long"))


SAID = "case query % 3 when 0 then concat('It is ', query) when 1 then 'There is no record of that' else '' end"


@query(
    "r31_j25_answers",
    """with g as (select distinct conv_id as query, 'C' || turn as uid from conversations), k as (select query, list_sort(list(uid)) as known from g group by query),
    a as (select query, known, case query % 3 when 0 then 'It is ' || query when 1 then 'There is no record of that' else '' end as said, case when query % 2 = 0 then list_filter(['C1', 'C0'], lambda c: list_contains(known, c)) else [] end as kept from k)
    select query, query % 3 = 0 as answered, case when query % 3 = 0 then said end as answer, array_to_string(case when query % 3 <> 2 and len(kept) = 0 then known else kept end, ',') as citations from a""",
)
def _(spark, sf_dir):
    """Answers of a stub model: citations are kept only if their evidence was gathered, markers of doubt abstain."""
    gathered = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query"), F.concat(F.lit("C"), F.col("turn").cast("string")).alias("uid"))
    cited = F.when(F.col("query") % 2 == 0, F.array(F.lit(" c1"), F.lit("C0"), F.lit("C1"), F.lit("MADE-UP")))
    answers = gathered.select("query").distinct().select("query", F.expr(SAID).alias("said"), cited.alias("cited"))
    return recall.finalised(answers, gathered).withColumn("citations", F.array_join("citations", ","))


@query(
    "r31_dual_prefetch",
    rf"""{'with ' + MEMORIES_SQL}, m as (select id, epistemic, source, row_number() over (partition by source, epistemic = 'observation' order by helpful desc, valid_from desc, id) as nth from memories where {CURRENT_SQL}) select source, id, epistemic from m where nth <= 6""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    cur = memories(spark, sf_dir).where(predicates.current_truth(now()))
    own = Window.partitionBy("source", F.col("epistemic") == "observation").orderBy(F.desc("helpful"), F.desc("valid_from"), "id")
    return cur.withColumn("nth", F.row_number().over(own)).where("nth <= 6").select("source", "id", "epistemic")


DATED = f"{CURRENT}, q as (select item_id as query, unnest(list_distinct({TOK.format('text')})) as term from benchmark where item_id % 20 = 0), dated as (select * from docs where valid_from >= timestamp '2024-01-10' and valid_from < timestamp '2024-01-21'), {bm25_sql('found', 'dated', 'doc', FIELDS)}"


@query("r32_date_range_search", f"with {DATED} select query, doc, round(score, 6) as score from found qualify row_number() over (partition by query order by round(score, 6) desc, doc) <= 10")
def _(spark, sf_dir):
    """Keyword search in the memories that are valid from a day of a range."""
    from lorekeep.plans.retrieval import _queries

    at = F.col("valid_from")
    docs = _docs(spark, sf_dir).where((at >= F.lit("2024-01-10").cast("timestamp")) & (at < F.lit("2024-01-21").cast("timestamp")))
    found = fts.bm25(docs, _queries(spark, sf_dir), id_col="doc", fields=FIELDS)
    return fts.top_k(found.withColumn("score", F.round("score", 6)), 10).select("query", "doc", "score")


@query("t17_due", "select user_id as name, max(ts) filter (where event_type = 'purchase') is null or max(ts) filter (where event_type = 'purchase') + interval 6 hour < timestamp '2024-01-15' as due from events group by 1")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("finished_at"))
    return due.due(rows, F.lit("2024-01-15").cast("timestamp"))


@query(
    "v8_specific_lessons",
    r"""with p as (select doc_id as id, trim(substr(text, 1, 700)) || case doc_id % 11 when 0 then ' made the commit' when 1 then ' ci was red' else '' end as content, doc_id % 2 = 0 as actionable, lang as entity from documents),
    k as (select * from p where content <> '' and len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) <= 140 and actionable
      and not regexp_matches(content, '(?i)\b(?:created|made|pushed|amended|rebased|squashed)\s+(?:the\s+)?commit\b|\b(?:branch|deployment|pull request|pr\s*#?[0-9]+|ci)\b.{0,100}\b(?:is|was|are|were|waiting|blocked|open|closed|passed|failed|green|red)\b'))
    select k.id, k.entity, 'U' || k.id as cite from k join documents d on d.doc_id = k.id where k.id % 3 <> 0 and (k.entity in ('en', 'de') or contains(lower(d.text), lower(k.entity)))""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 11 == 0, " made the commit").when(F.col("doc_id") % 11 == 1, " ci was red").otherwise("")
    uid = F.concat(F.lit("U"), F.col("doc_id").cast("string"))
    cites = F.when(F.col("doc_id") % 3 != 0, F.array(uid, F.lit("U-none"))).otherwise(F.array(F.lit("U-none")))
    made = docs.select(F.col("doc_id").alias("id"), F.concat(F.trim(F.substring("text", 1, 700)), tail).alias("content"), (F.col("doc_id") % 2 == 0).alias("actionable"), cites.alias("cites"), F.col("lang").alias("entity"))
    members = docs.select(F.col("doc_id").alias("id"), uid.alias("uid"), F.col("text").alias("content"))
    known = spark.createDataFrame([("EN",), ("De",)], "entity string")
    return proposals.specific(made, members, known).select("id", "entity", F.element_at("cites", 1).alias("cite"))


@query(
    "v30_triples",
    f"""with {FACTS_SQL}, cur as (select * from facts qualify row_number() over (partition by subject, predicate order by valid_from desc, fact_id desc) = 1),
    p as (select 'n' || c_custkey as uid, 'c' || c_custkey as subject, case when c_custkey % 9 = 0 then '' else 'status' end as predicate, case c_custkey % 3 when 0 then 'O' when 1 then 'F' else 'P' end as object from customer where c_custkey % 4 <> 0)
    select uid, p.subject, p.predicate, p.object, case when c.object <> p.object then c.object end as prior from p left join cur c on c.subject = p.subject and c.predicate = p.predicate where p.predicate <> ''""",
)
def _(spark, sf_dir):
    from lorekeep.operators.temporal import current_facts

    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" n"), n.cast("string")).alias("uid"), F.concat(F.lit("c"), n.cast("string")).alias("subject"), F.when(n % 9 == 0, " ").otherwise("status").alias("predicate"),
        F.when(n % 3 == 0, "O").when(n % 3 == 1, "F").otherwise("P").alias("object"), "c_custkey",
    )
    notes = rows.where(n % 4 != 0).select(F.trim("uid").alias("uid"))
    return proposals.triples(rows.drop("c_custkey"), notes, current_facts(facts(spark, sf_dir)))


@query(
    "v14_fact_updates",
    f"""with {FACTS_SQL}, cur as (select * from facts qualify row_number() over (partition by subject, predicate order by valid_from desc, fact_id desc) = 1)
    select c_custkey as id, fact_id, object as old_object, 'F' as new_object from customer join cur on subject = 'c' || c_custkey and predicate = 'status' where lower(object) <> 'f'""",
)
def _(spark, sf_dir):
    from lorekeep.operators.temporal import current_facts

    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" C"), F.col("c_custkey").cast("string")).alias("subject"), F.lit("STATUS").alias("predicate"), F.lit("F").alias("object"))
    return proposals.fact_updates(said, current_facts(facts(spark, sf_dir)))


@query(
    "v12_knowledge_updates",
    f"""with {FACTS_SQL}, p as (select a.fact_id as a, a.object as ao, a.valid_from as af, b.fact_id as b, b.object as bo, b.valid_from as bf from facts a join facts b on a.subject = b.subject and a.predicate = b.predicate and a.fact_id < b.fact_id and a.object <> b.object)
    select case when af > bf then a else b end as winner, case when af > bf then b else a end as loser, case when af > bf then ao else bo end as object from p""",
)
def _(spark, sf_dir):
    own = facts(spark, sf_dir)
    side = lambda x: own.select("subject", "predicate", F.col("fact_id").alias(x), F.col("object").alias(f"{x}_object"), F.col("valid_from").alias(f"{x}_from"))
    return proposals.knowledge_updates(side("a").join(side("b"), ["subject", "predicate"]).where("a < b"))


@query(
    "v13_applied_verdicts",
    f"""{'with ' + MEMORIES_SQL}, v as (select id as newer, id + 1 as older, case id % 3 when 0 then 'A' when 1 then 'b' end as winner from memories where id % 5 = 0 and id + 1 in (select id from memories)),
    c as (select case when lower(winner) = 'a' then older else newer end as id, min(case when lower(winner) = 'a' then newer else older end) as by_ from v where winner is not null group by 1), f as (select distinct unnest([newer, older]) as id from v where winner is null)
    select m.id, case when c.id is not null then {NOW_SQL} else valid_to end as valid_to, by_ as invalidated_by, f.id is not null as needs_review from memories m left join c on c.id = m.id left join f on f.id = m.id""",
)
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).select("id", "valid_to")
    older = rows.select((F.col("id") - 1).alias("newer"), F.col("id").alias("older"))
    winner = F.when(F.col("newer") % 3 == 0, "A").when(F.col("newer") % 3 == 1, "b")
    verdicts = older.where("newer >= 0 and newer % 5 = 0").select("newer", "older", F.lit(True).alias("contradicts"), winner.alias("winner"))
    return proposals.applied_verdicts(rows, verdicts, now())[0].select("id", "valid_to", "invalidated_by", "needs_review")


@query(
    "v28_novel_items",
    """with e as (select vec_id as id, 't' || (vec_id % 40) as title, embedding::double[] as v from embeddings), n as (select a.id, b.id as near, list_cosine_similarity(a.v, b.v) as s from e a join e b on a.id <> b.id and b.id % 3 = 0 where a.id % 3 <> 0),
    k as (select id, near from n where s >= 0.4 qualify row_number() over (partition by id order by s desc, near) = 1), t as (select title, min(id) as same from e where id % 3 = 0 group by title)
    select e.id, coalesce(near, same) as duplicate_of from e left join k using (id) left join t using (title) where e.id % 3 <> 0""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), (F.col("vec_id") % 40).cast("string")).alias("title"), F.col("embedding").alias("v"))
    return proposals.novel(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), 0.4)


@query("v29_written_cases", "select event_id as id, event_type || chr(10) || 'Plan: step ' || user_id as content, 'case' as kind, ['case', event_type] as tags, 240.0::double as half_life_days from events where event_id % 6 <> 0")
def _(spark, sf_dir):
    plan = F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("step "), F.col("user_id").cast("string"))).otherwise("  ")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("summary"), plan.alias("plan"), F.col("event_type").alias("verdict"))
    return proposals.written_cases(rows)


#: Gold of a query: current memories that hold the first forty characters of its text.
EVAL_SQL = f"""{CURRENT}, q as (select item_id as query, unnest(list_distinct({TOK.format('text')})) as term from benchmark), {bm25_sql('words', 'docs', 'doc', {'content': 1.0})}, {bm25_sql('fields', 'docs', 'doc', FIELDS)},
  gold as materialized (select item_id as query, doc as key from benchmark join docs on contains(content, substr(text, 1, 40))), n_gold as (select query, count(*) as n from gold group by query),
  results as (select 'words' as config, query, doc as key, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from words qualify rank <= 5 union all select 'fields', query, doc, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from fields qualify rank <= 5),
  scores as (select config, query, coalesce(hits, 0) / least(5, n)::double as p_at_k, coalesce(1.0 / first_, 0)::double as rr from (select * from n_gold, (values ('words'), ('fields')) c(config)) left join (select config, query, count(*) as hits, min(rank) as first_ from results join gold using (query, key) group by all) using (config, query))"""


def _evaluated(spark, sf_dir):
    """Precision and reciprocal rank of two configurations against gold that the texts themselves give."""
    items = table(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("query"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    gold = _gold(spark, sf_dir, items)
    out = {}
    for name, fields in (("words", {"content": 1.0}), ("fields", FIELDS)):
        found = _index(spark, sf_dir, name, fields).search(asked, 5)
        out[name] = evalkit.per_query(found.withColumnRenamed("doc", "key"), gold, 5)
    return out


def _gold(spark, sf_dir, items):
    """query and key of the current memories that hold the first forty characters of an item, found by their grams and then compared."""
    rows = _docs(spark, sf_dir).select("doc", F.col("content").alias("text"))
    index = built(spark, "grams", [rows], lambda path: grams.GramIndex(spark, path).create(rows))
    starts = items.select(F.col("item_id").alias("query"), F.substring("text", 1, 40).alias("start"), F.lower(F.substring("text", 1, 40)).alias("string"))
    hits = starts.join(index.find(rows, starts.select("string").distinct()), "string").join(rows, "doc")
    return stored(hits.where(F.contains("text", F.col("start"))).select("query", F.col("doc").alias("key")))


@query("g20_v35_m14_evaluation", f"with {EVAL_SQL} select config, round(avg(p_at_k), 6)::double as p_at_k, round(avg(rr), 6)::double as mrr, count(*) as n, null::varchar as skipped from scores group by config union all select 'late interaction', null, null, 0, 'no reranker for this tier'")
def _(spark, sf_dir):
    scores, out = _evaluated(spark, sf_dir), None
    for name, rows in scores.items():
        part = evalkit.summary(rows).select(F.lit(name).alias("config"), F.round("p_at_k", 6).alias("p_at_k"), F.round("mrr", 6).alias("mrr"), "n", F.lit(None).cast("string").alias("skipped"))
        out = part if out is None else out.unionByName(part)
    none = spark.createDataFrame([("late interaction", None, None, 0, "no reranker for this tier")], out.schema)
    return out.unionByName(none)


@query("g20_v38_measured_delta", f"with {EVAL_SQL}, b as (select a.query, a.rr as x, b.rr as y from scores a join scores b using (query) where a.config = 'words' and b.config = 'fields') select count(*) filter (where y > x) as win, count(*) filter (where y < x) as loss, count(*) filter (where y = x) as tie, case when count(*) >= 30 then round(avg(y) - avg(x), 6)::double end as mrr_delta from b")
def _(spark, sf_dir):
    scores = _evaluated(spark, sf_dir)
    return evalkit.measured(scores["words"], scores["fields"]).withColumn("mrr_delta", F.round("mrr_delta", 6))


@query(
    "g21_rubric",
    f"""with r as (select conv_id, turn, lower(text) as t, case turn % 3 when 0 then ['the'] when 1 then ['e', 'zzz'] else ['a', 'e'] end as keys, turn % 5 = 0 as should from (select conv_id, turn, concat(text, case when turn % 10 = 0 then ' unknown' else '' end) as text from conversations)),
    j as (select *, contains(t, 'unknown') as quiet from r where not regexp_matches(t, 'no record|insufficient|not enough|unable to|no evidence|no information|don''t|dont know|cannot determine')) select round(avg(case when not should then (not quiet and len(list_filter(keys, lambda k: contains(t, k))) = len(keys))::int end), 6)::double as pass_rate, round(avg(case when should then quiet::int end), 6)::double as abstain_rate, count(*) as n from j""",
)
def _(spark, sf_dir):
    said = F.concat("text", F.when(F.col("turn") % 10 == 0, " unknown").otherwise(""))
    keys = F.when(F.col("turn") % 3 == 0, F.array(F.lit("the"))).when(F.col("turn") % 3 == 1, F.array(F.lit("e"), F.lit("zzz"))).otherwise(F.array(F.lit("a"), F.lit("e")))
    rows = table(spark, sf_dir, "conversations").select(said.alias("answer"), keys.alias("keywords"), (F.col("turn") % 5 == 0).alias("should_abstain"))
    plain = rows.where(~F.lower("answer").rlike("no record|insufficient|not enough|unable to|no evidence|no information|don't|dont know|cannot determine"))
    return evalkit.rubric(plain)


@query("m11_coverage", "select count(distinct conv_id) as n_sessions, count(distinct conv_id) filter (where turn >= 2) as n_covered, round(count(distinct conv_id) filter (where turn >= 2) / count(distinct conv_id)::double, 6) as ratio from conversations")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max((F.col("turn") >= 2).cast("int")).alias("covered"))
    both = rows.agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("covered").cast("long").alias("n_covered"))
    return both.withColumn("ratio", F.round(F.col("n_covered") / F.col("n_sessions"), 6))


@query("r17_max_sim", "with v as (select vec_id, [embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]]::double[][] as p from embeddings) select a.vec_id as query, b.vec_id as doc, round(list_sum(list_transform(a.p, lambda x: list_max(list_transform(b.p, lambda y: list_inner_product(x, y))))), 6) as score from v a join v b on b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    """Late interaction of each vector's four parts with those of the next one."""
    parts = F.array(*[F.slice("embedding", 1 + 16 * i, 16) for i in range(4)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("p"))
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("doc"), F.col("p").alias("d"))
    both = rows.join(after, "vec_id")
    return both.select(F.col("vec_id").alias("query"), "doc", F.round(fusion.max_sim(F.col("p"), F.col("d")), 6).alias("score"))
