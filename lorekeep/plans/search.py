"""The whole search: filters, intent, four legs and episodes, fusion, late interaction, modulation and diversity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import scoring, text
from lorekeep.operators import fts, fusion, late, predicates
from lorekeep.operators.vectors import nearest
from lorekeep.plans.functions import INTENT_SQL, _questions
from lorekeep.plans.registry import query
from lorekeep.plans.retrieval import (
    K, LEG, LEGS, MMR_SQL, TOK, WEIGHTS, _best, _docs, _facts_leg, _graph_leg, _index, _keyed, _mention_rows, _queries, _turn_index, _turns,
)
from lorekeep.session import stored, table
from lorekeep.sources.store import CURRENT_SQL, NOW_SQL, memories, now

SINCE = "2024-01-05"
_ALLOWED = f"""allowed as (select id as doc from memories where {CURRENT_SQL} and (kind is null or kind <> 'profile') and (scope_project is null or scope_project = 'p1') and valid_from >= timestamp '{SINCE}')"""


def _filtered_legs() -> str:
    """The legs' CTEs with the filters: before the ranks of words, after those of the other legs, which fetch three times as many."""
    sql = LEGS[: LEGS.index("  fused as materialized")].rstrip().rstrip(",")
    sql = sql.replace("fts as (select query, doc, row_number()", f"{_ALLOWED},\n  fts as (select query, doc, row_number()", 1).replace("from bm25 qualify", "from bm25 join allowed using (doc) qualify", 1)
    for leg in ("vec", "grph", "fct"):
        a = sql.index(f"\n  {leg} as (")
        depth, b = 0, sql.index("(", a)
        for b in range(sql.index("(", a), len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            if not depth:
                break
        kept = f"\n  {leg} as materialized (select query, doc, row_number() over (partition by query order by rank) as rank from {leg}_all join allowed using (doc)),"
        sql = sql[:a] + f"\n  {leg}_all as materialized (" + sql[sql.index("(", a) + 1 : b + 1] + "," + kept + sql[b + 2 :]
    return sql


_FTS, _VEC = (f"case intent {' '.join(f"when '{k}' then {v[i]}" for k, v in {'temporal': (1.5, 0.6), 'factual': (1.2, 1.0), 'entity': (1.0, 1.1), 'preference': (0.8, 0.9), 'procedural': (0.9, 1.3)}.items())} else 1.0 end" for i in (0, 1))
_BYTES = "list_transform(range(0, 8), lambda i: (('0x' || substr(sha256({}), 2 * i + 1, 2))::int - 128)::double)"

CHAIN = rf"""{INTENT_SQL}, {_filtered_legs()},
  weighted as (select query, key, leg, rank, w * case leg when 'fts' then {_FTS} when 'vec' then {_VEC} else 1.0 end as w from every join intents on item_id = query),
  fused as materialized (select query, key, sum(w / (60 + rank))::double as score from weighted group by query, key),
  spread as (select *, min(score) over (partition by query) as lo, max(score) over (partition by query) as hi from fused),
  base as materialized (select query, key, case when hi - lo < 1e-12 then 1.0 else 0.2 + 0.8 * (score - lo) / (hi - lo) end as score from spread),
  texts as materialized (select 'm:' || doc as key, content as said from docs union all select 'e:' || conv_id, concat_ws(chr(10), user_text, assistant_text) from turns),
  best as materialized (select query, key from base qualify row_number() over (partition by query order by score desc, key) <= 32),
  dt as materialized (select key, term, {_BYTES.format('term')} as v from (select distinct key, unnest({TOK.format("coalesce(said, '')")}) as term from texts where key in (select key from best))),
  qt as materialized (select query, term, {_BYTES.format('term')} as v from q),
  sims as (select query, key, sum(s) as fresh from (select b.query, b.key, qt.term, max(list_inner_product(qt.v, dt.v)) as s from best b join qt using (query) join dt on dt.key = b.key group by all) group by all),
  fresh as (select base.*, case when best.key is not null then coalesce(fresh, 0) end as fresh from base left join best using (query, key) left join sims using (query, key)),
  band as (select *, min(fresh) over (partition by query) as lo, max(fresh) over (partition by query) as hi, count(fresh) over (partition by query) as n from fresh),
  rr as materialized (select query, key, case when n < 2 or hi - lo < 1e-12 then score when fresh is not null then 0.2 + 0.8 * (fresh - lo) / (hi - lo) else score * 0.1 end as base from band),
  hits as materialized (select *, row_number() over (partition by query order by score desc, key) as rank from (
    select query, key, round((base * case when half_life_days > 0 then greatest(0.3, pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 86400e6) / half_life_days)) else 1.0 end
      * case when outcome = 'failed' then 1.5 else 1.0 end * case when kind = 'warning' then 1.2 else 1.0 end
      * least(2.0, greatest(0.2, 1.0 + 0.1 * least(helpful, 5) - 0.15 * least(harmful, 5))) * case when pinned then 1.3 else 1.0 end)::double, 6) as score from rr join docs on key = 'm:' || doc
    union all select query, key, round((base * 0.6)::double, 6) from rr where key like 'e:%' qualify row_number() over (partition by query order by base desc, key) <= 3))"""


def _chain_sql() -> str:
    body = MMR_SQL[MMR_SQL.index("nth as materialized") :].replace("select *, row_number() over (partition by query order by score desc, key) as place", "select query, key, score, list_distinct(regexp_split_to_array(coalesce(said, ''), '\\s+')) as words, rank as place")
    body = body.replace("from own)", "from hits join texts using (key))", 1)
    body = body.replace(
        "from picked p join nth h on h.query = p.query and not list_contains(p.keys, h.key))", f"from picked p join nth h on h.query = p.query and not list_contains(p.keys, h.key) where len(p.keys) < {K})"
    )
    return "with recursive " + CHAIN[len("with ") :] + ", " + body


def _allowed(spark, sf_dir):
    """doc of the current memories that the search may find: no profiles, of no project or p1, and from a day on."""
    rows = memories(spark, sf_dir).where(predicates.current_truth(now()))
    rows = rows.where((F.col("kind").isNull() | (F.col("kind") != "profile")) & (F.col("scope_project").isNull() | (F.col("scope_project") == "p1")))
    return rows.where(F.col("valid_from") >= F.lit(SINCE).cast("timestamp")).select(F.col("id").alias("doc"))


def _filtered(leg, allowed):
    kept = leg.select("query", "doc", "rank").join(allowed, "doc", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank")))


def _weights(spark, sf_dir):
    """query and the factor of each leg by the intent of its text."""
    legs = [scoring.by_key(F.col("intent"), {k: v[i] for k, v in text.INTENT_LEGS.items()}, 1.0).alias(n) for i, n in enumerate(("by_fts", "by_vec"))]
    asked = stored(_questions(spark, sf_dir).where("item_id % 20 = 0").select(F.col("item_id").alias("query"), text.intent(F.col("text")).alias("intent")))
    return asked.select("query", *legs)


@query("r22_full_search", f"{_chain_sql().rsplit('select query, key, position::bigint', 1)[0]} select query, key, position::bigint as position from whole where position <= {K} union all select query, key, place::bigint from nth where n < 3")
def full_search(spark, sf_dir):
    """What a search of the store returns: legs under filters, weights by intent, reciprocal ranks, late interaction over the best 32, lifecycle, episodes capped in fused order, and a diverse choice."""
    asked, docs, allowed = _queries(spark, sf_dir), _docs(spark, sf_dir), _allowed(spark, sf_dir)
    words = _index(spark, sf_dir).search(asked, LEG, among=allowed)
    episodes = _turn_index(spark, sf_dir).search(asked, LEG)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    own = rows.withColumnsRenamed({"doc": "query", "v": "q"}).join(asked.select("query").distinct(), "query", "left_semi")
    near = _filtered(nearest(rows.join(docs.select("doc"), "doc", "left_semi"), own, LEG), allowed)
    seeds = words.select("query", F.col("doc").alias("node")).union(near.select("query", "doc")).distinct()
    linked = _filtered(fts.top_k(_graph_leg(_mention_rows(spark, sf_dir), seeds), LEG), allowed)
    told = _filtered(_best(_facts_leg(spark, sf_dir, docs)), allowed)
    every = _keyed(words, "m", "fts")
    for part in (_keyed(episodes, "e", "fts"), _keyed(near, "m", "vec"), _keyed(linked, "m", "graph"), _keyed(told, "m", "facts")):
        every = every.unionByName(part)
    base = scoring.by_key(F.col("leg"), WEIGHTS, 1.0)
    factor = F.when(F.col("leg") == "fts", F.col("by_fts")).when(F.col("leg") == "vec", F.col("by_vec")).otherwise(1.0)
    fused = every.join(_weights(spark, sf_dir), "query").groupBy("query", "key").agg(F.sum(base * factor / (F.lit(60.0) + F.col("rank"))).alias("score"))
    fused = stored(fusion.banded(fused))
    said = docs.select(F.concat(F.lit("m:"), F.col("doc").cast("string")).alias("key"), F.col("content").alias("text"))
    turns = _turns(spark, sf_dir).select(F.concat(F.lit("e:"), F.col("conv_id").cast("string")).alias("key"), F.concat_ws("\n", "user_text", "assistant_text").alias("text"))
    texts = stored(said.unionByName(turns).join(fused.select("key").distinct(), "key", "left_semi"))
    terms = asked.groupBy("query").agg(F.array_sort(F.collect_set("term")).alias("asked"))
    again = late.reranked(fused, texts.select("key", text.tokens(F.coalesce("text", F.lit(""))).alias("said")), terms)
    lived = docs.withColumn("key", F.concat(F.lit("m:"), F.col("doc").cast("string")))
    kept = again.join(lived, "key").withColumn("score", scoring.modulated(F.col("score"), now())).select("query", "key", "score")
    talks = fusion.capped(again.where(F.col("key").startswith("e:")).withColumn("kind", F.lit("episode")), "kind", 3)
    hits = kept.unionByName(talks.select("query", "key", (F.col("score") * fusion.EPISODE_FACTOR).alias("score"))).withColumn("score", F.round("score", 6))
    hits = hits.join(texts, "key").select("query", "key", "score", F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("words"))
    return fusion.mmr(hits, K).where(F.col("position") <= K)
