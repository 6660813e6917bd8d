"""Retrieval queries: keyword, vector, graph and fact legs, their fusion, and the flagship search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions import scoring, text
from lorekeep.operators import ann, fts, fusion, graph, grams, predicates, sessions, vectors
from lorekeep.operators.inverted import InvertedIndex
from lorekeep.operators.ranking import numbered
from lorekeep.plans import registry
from lorekeep.plans.registry import query
from lorekeep.session import scratch, stored, table
from lorekeep.sources.indexes import built
from lorekeep.sources.store import CURRENT_SQL, FACTS_SQL, MEMORIES_SQL, NOW_SQL, facts, memories, now

K = 10
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

CURRENT = f"{MEMORIES_SQL}, docs as (select id as doc, uid, content, summary, symbols, tags, lang, kind, pinned, valid_from, half_life_days, helpful, harmful, outcome from memories where {CURRENT_SQL})"
#: Queries: every benchmark item whose id is divisible by 20, all its words.
QUERIES = rf"q as (select item_id as query, unnest(list_distinct({TOK.format('text')})) as term from benchmark where item_id % 20 = 0)"
#: Weights of the fields of memories and of episodes.
FIELDS = {"content": 1.0, "summary": 2.0, "symbols": 3.0, "tags": 2.0}
EPISODE_FIELDS = {"user_text": 1.0, "assistant_text": 0.8, "symbols": 3.0}


def bm25_sql(name: str, rows: str, key: str, fields: dict[str, float]) -> str:
    """CTEs that score ``rows`` (``key`` and the fields) for the queries ``q``, the last one called ``name``."""
    split = ", ".join(f"{TOK.format(f"coalesce({f}, '')")} as {f}" for f in fields)
    length = " + ".join(f"{w} * len({f})" for f, w in fields.items())
    each = " union all ".join(f"select doc, {length} as dl, unnest({f}) as term, {w} as w from {name}_split" for f, w in fields.items())
    return f"""{name}_split as materialized (select {key} as doc, {split} from {rows}), {name}_own as materialized ({each}),
  {name}_tf as materialized (select doc, dl::double as dl, term, sum(w)::double as tf from {name}_own where term in (select term from q) group by all),
  {name}_df as materialized (select term, count(*) as df from {name}_tf group by term), {name}_stats as (select count(*) as n, avg(({length})::double) as m from {name}_split),
  {name} as materialized (select query, doc, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) as score
    from {name}_tf join {name}_df using (term) join q using (term), {name}_stats group by query, doc)"""


BM25 = f"{CURRENT}, {QUERIES}, {bm25_sql('bm25', 'docs', 'doc', FIELDS)}"


def _docs(spark, sf_dir):
    return memories(spark, sf_dir).where(predicates.current_truth(now())).withColumnRenamed("id", "doc")


def _queries(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").where(F.col("item_id") % 20 == 0)
    words = F.array_distinct(text.tokens(F.col("text")))
    return items.select(F.col("item_id").alias("query"), F.explode(words).alias("term"))


def _index(spark, sf_dir, name="fields", fields=FIELDS):
    """The stored index of the current memories over some fields, built by the first search of the data."""
    docs = _docs(spark, sf_dir)
    return built(spark, f"memories {name}", [docs], lambda path: InvertedIndex(spark, path, "doc", fields).create(docs))


def _turn_index(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return built(spark, "turns", [turns], lambda path: InvertedIndex(spark, path, "conv_id", EPISODE_FIELDS).create(turns))


@registry.flagship
@query(
    "r3_bm25_top_k",
    f"""with {BM25}, ranked as (select query, doc, round(score, 6) as score, row_number() over (partition by query order by round(score, 6) desc, doc)::int as rank from bm25)
    select query, doc, score, rank from ranked where rank <= {K}""",
)
def bm25_top_k(spark, sf_dir):
    """The best current documents for each text query, over weighted fields, from the stored index."""
    return _index(spark, sf_dir).search(_queries(spark, sf_dir), K).select("query", "doc", "score", "rank")


SUBSTRINGS = f"""{CURRENT}, {QUERIES}, held as (select query, doc, count(*) as hits from docs, q where contains(lower(content), term) group by all),
  sized as (select query, count(*) as n from q group by query)"""


@query("r5_substring_leg", f"with {SUBSTRINGS} select query, doc, round(hits / n::double, 9) as score from held join sized using (query)")
def _(spark, sf_dir):
    """The share of each query's words that a memory holds as substrings, by the stored index of grams."""
    rows = _docs(spark, sf_dir).select("doc", F.col("content").alias("text"))
    index = built(spark, "grams", [rows], lambda path: grams.GramIndex(spark, path).create(rows))
    return grams.matches(index, rows, _queries(spark, sf_dir)).withColumn("score", F.round("score", 9))


#: Strings with characters that a pattern would take for more than they are, and short ones.
ODD_STRINGS = "['li%', '_b', 'cense', 'ent', 'zzzz', '\\', 'schaft', 'a']"


@query(
    "p12_j26_literal_substrings",
    f"with {CURRENT}, s as (select distinct unnest(list_concat({ODD_STRINGS}, (select list(lower(p_name)) from part where p_partkey % 50 = 0))) as string) select string, doc from docs, s where contains(lower(content), string)",
)
def _(spark, sf_dir):
    """Literal substrings: what a pattern escapes is looked for as it stands."""
    rows = _docs(spark, sf_dir).select("doc", F.col("content").alias("text"))
    index = built(spark, "grams", [rows], lambda path: grams.GramIndex(spark, path).create(rows))
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("li%", "_b", "cense", "ent", "zzzz", "\\", "schaft", "a")])).alias("string"))
    named = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.lower("p_name").alias("string"))
    return index.find(rows, fixed.unionByName(named).distinct())


VEC = """v as (select vec_id, embedding::double[] as e, label from embeddings), knn as (
  select q.vec_id as query, d.vec_id as doc, list_cosine_similarity(q.e, d.e) as sim from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0)"""


def _knn(spark, sf_dir, k, step=20):
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return vectors.nearest(rows.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), queries, k)


@query(
    "r6_knn",
    f"with {VEC}, r as (select query, doc, round(sim, 6) as sim, row_number() over (partition by query order by sim desc, doc)::int as rank from knn) select * from r where rank <= {K}",
)
def _(spark, sf_dir):
    return _knn(spark, sf_dir, K).select("query", "doc", F.round("sim", 6).alias("sim"), "rank")


@query(
    "r7_r8_quantised_cosine",
    """with b as (select vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::double * 127, 0)))::double) as b from embeddings)
    select vec_id, round(list_cosine_similarity(b, (select b from b order by vec_id limit 1)), 6) as sim from b""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantised(F.col("embedding")).alias("b"))
    first = rows.orderBy("vec_id").limit(1).select(F.col("b").alias("first"))
    return rows.join(F.broadcast(first)).select("vec_id", F.round(vectors.cosine(F.col("b"), F.col("first")), 6).alias("sim"))


@query(
    "r7_r8_quantised_knn",
    f"""with b as (select vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::double * 127, 0)))::double) as b from embeddings),
    s as (select q.vec_id as query, d.vec_id as doc, list_cosine_similarity(q.b, d.b) as sim from b q join b d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0),
    r as (select query, doc, round(sim, 6) as sim, row_number() over (partition by query order by sim desc, doc)::int as rank from s) select * from r where rank <= {K}""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantised(F.col("embedding")).alias("b"))
    queries = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), F.col("b").alias("q"))
    found = vectors.nearest(rows.select(F.col("vec_id").alias("doc"), F.col("b").alias("v")), queries, K)
    return found.select("query", "doc", F.round("sim", 6).alias("sim"), "rank")


@query(
    "v10_neighbour_pairs",
    f"""with {VEC}, r as (select query, doc, sim, row_number() over (partition by query order by sim desc, doc) as rank from knn)
    select least(query, doc) as a, greatest(query, doc) as b, round(max(sim), 6) as sim from r where rank <= 6 and sim >= 0.2 group by 1, 2""",
)
def _(spark, sf_dir):
    return vectors.neighbour_pairs(_knn(spark, sf_dir, 6), 0.2).withColumn("sim", F.round("sim", 6))


@query(
    "g15_v7_density_outliers",
    f"""with {VEC}, r as (select query, sim, row_number() over (partition by query order by sim desc, doc) as rank from knn), d as (select query, round(avg(sim), 6) as density from r where rank <= 8 group by query)
    select query, density, row_number() over (order by density, query)::int as nth from d qualify nth <= greatest(1, (select count(*) from d) // 10)""",
)
def _(spark, sf_dir):
    return _outliers(vectors.density(_knn(spark, sf_dir, 8)))


def _outliers(density):
    """The lowest tenth by density, numbered over ranges: it grows with the table, so it is no single task."""
    rows = numbered(density.withColumn("density", F.round("density", 6)), "density", "query")
    cut = F.broadcast(rows.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 10)).alias("cut")))  # one row
    return rows.join(cut, F.col("nth") <= F.col("cut")).select("query", "density", F.col("nth").cast("int").alias("nth"))


#: Every vector is a query: pair joins and statistics over all rows.
VEC_ALL = VEC.replace(" where q.vec_id % 20 = 0", "")


@query(
    "v10_all_neighbour_pairs",
    f"""with {VEC_ALL}, r as (select query, doc, sim, row_number() over (partition by query order by sim desc, doc) as rank from knn)
    select least(query, doc) as a, greatest(query, doc) as b, round(max(sim), 6) as sim from r where rank <= 6 and sim >= 0.2 group by 1, 2""",
)
def _(spark, sf_dir):
    return vectors.neighbour_pairs(_knn(spark, sf_dir, 6, step=1), 0.2).withColumn("sim", F.round("sim", 6))


@query(
    "g15_v7_all_density_outliers",
    f"""with {VEC_ALL}, r as (select query, sim, row_number() over (partition by query order by sim desc, doc) as rank from knn), d as (select query, round(avg(sim), 6) as density from r where rank <= 8 group by query)
    select query, density, row_number() over (order by density, query)::int as nth from d qualify nth <= greatest(1, (select count(*) from d) // 10)""",
)
def _(spark, sf_dir):
    return _outliers(vectors.density(_knn(spark, sf_dir, 8, step=1)))


def pagerank_sql(rounds: int = graph.ROUNDS, damping: float = graph.DAMPING) -> str:
    """CTEs of a personal PageRank over ``g`` (query, entity, memory) from ``seeds`` (query, node): ``ppr``."""
    steps = f"""deg as materialized (select *, count(*) over (partition by query, entity) - 1 as d from g),
  nodes as materialized (select n.query, n.node, case when s.node is not null then 1.0 / s.n else 0.0 end::double as start, coalesce(o.out, 0)::double as out
    from (select query, memory as node from g union select query, node from seeds) n
    left join (select *, count(*) over (partition by query) as n from seeds) s on n.query = s.query and n.node = s.node
    left join (select query, memory, sum(d) as out from deg group by query, memory) o on n.query = o.query and n.node = o.memory),
  p0 as materialized (select query, node, start as share from nodes)"""
    for i in range(rounds):
        steps += f""",
  f{i} as materialized (select query, memory, greatest(sum(flow) over (partition by query, entity) - flow, 0) as own, d from
    (select deg.query, entity, memory, d, case when out > 0 then share / out else 0 end as flow from deg join p{i} p on p.query = deg.query and p.node = memory join nodes n on n.query = deg.query and n.node = memory)),
  p{i + 1} as materialized (select n.query, n.node, {1 - damping} * start + {damping} * coalesce(s, 0) as share from nodes n
    left join (select query, memory, sum(own) as s from f{i} where d > 0 group by query, memory) x on x.query = n.query and x.memory = n.node)"""
    return steps + f""",
  ppr as (select p.query, p.node, round(share, 9) as score from p{rounds} p join nodes n on n.query = p.query and n.node = p.node where start = 0 and share > 0)"""


MENTIONS = "mentions as (select l_partkey as entity, l_orderkey as memory from lineitem)"


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("memory"))


@query(
    "j17_co_mentions",
    f"""with {MENTIONS}, k as (select entity, memory from (select distinct entity, memory from mentions) qualify row_number() over (partition by entity order by memory) <= 60)
    select a.memory as a, b.memory as b, count(*)::double as weight from k a join k b on a.entity = b.entity and a.memory < b.memory group by 1, 2""",
)
def _(spark, sf_dir):
    return graph.co_mentions(_mentions(spark, sf_dir))


@query(
    "j18_j19_j20_neighbours",
    f"""with {MENTIONS}, s as (select distinct memory from mentions where memory % 97 = 0), e as (select distinct entity from mentions where memory in (select memory from s))
    select memory, count(distinct entity) as shared from mentions where entity in (select entity from e) and memory not in (select memory from s) group by memory order by shared desc, memory limit 50""",
)
def _(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    return graph.co_mentioned(m, m.where("memory % 97 = 0").select(F.col("memory").alias("node")).distinct(), 50)


def edge_pagerank_sql(rounds: int = graph.ROUNDS, damping: float = graph.DAMPING) -> str:
    """CTEs of a personal PageRank over ``g`` (query, entity, memory) and ``edges`` (query, a, b, w) from ``seeds`` (query, node): ``ppr``."""
    steps = f"""deg as materialized (select *, count(*) over (partition by query, entity) - 1 as d from g),
  paired as materialized (select query, a, b, sum(w) as w from (select query, a, b, w from edges where a <> b union all select query, b, a, w from edges where a <> b) group by all),
  outs as (select query, node, sum(o) as out from (select query, memory as node, d::double as o from deg union all select query, a, w from paired) group by all having sum(o) > 0),
  inn as (select o.*, s.node is not null as is_seed from outs o left join seeds s on s.query = o.query and s.node = o.node),
  nodes as materialized (select *, case when count(*) filter (where is_seed) over (partition by query) = 0 then 1.0 / count(*) over (partition by query)
    when is_seed then 1.0 / count(*) filter (where is_seed) over (partition by query) else 0.0 end::double as start from inn),
  p0 as materialized (select query, node, start as share from nodes)"""
    for i in range(rounds):
        steps += f""",
  w{i} as materialized (select n.query, n.node, share / out as flow from p{i} p join nodes n using (query, node)),
  e{i} as (select d.query, entity, memory, flow, sum(flow) over (partition by d.query, entity) - flow as got from deg d join w{i} f on f.query = d.query and f.node = memory where d > 0),
  i{i} as (select query, node, sum(x) as x from (select query, memory as node, got as x from e{i} union all select b.query, b.b, b.w * flow from paired b join w{i} f on f.query = b.query and f.node = b.a) group by all),
  p{i + 1} as materialized (select n.query, n.node, {1 - damping} * start + {damping} * coalesce(x, 0) as share from nodes n left join i{i} using (query, node))"""
    return steps + f""",
  ppr as (select query, node, round(share, 9) as score from p{rounds} join nodes n using (query, node) where not is_seed and share > 0)"""


#: Live edges between an order and the customer's order before it; those of finished orders are closed.
EDGES_SQL = """chain as (select o_orderkey as b, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as a, 1.0::double - (o_orderkey % 5)::double / 10 as w, o_orderstatus <> 'F' as live from orders),
    edges as materialized (select x.query, c.a, c.b, c.w from chain c join (select distinct query, memory from g) x on x.memory = c.a join (select distinct query, memory from g) y on y.memory = c.b and y.query = x.query where live)"""


def _live_edges(spark, sf_dir):
    """a, b and weight: orders of one customer that follow each other, by confidence; edges of finished orders are closed."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("b"), before.alias("a"), (F.lit(1.0) - (F.col("o_orderkey") % 5) / 10).alias("weight"), "o_orderstatus")
    return rows.where("o_orderstatus <> 'F' and a is not null").select("a", "b", "weight")


@query(
    "r9_pagerank_leg",
    f"""with g as materialized (select distinct l_suppkey as query, l_partkey as entity, l_orderkey as memory from lineitem),
    seeds as materialized (select query, memory as node from (select distinct query, memory from g) qualify row_number() over (partition by query order by memory) <= 5),
    {EDGES_SQL}, {edge_pagerank_sql()}
    select query, node, score from ppr where score > 0""",
)
def _(spark, sf_dir):
    """For each supplier, all its orders linked by shared parts and by live edges; its smallest orders are the seeds."""
    sold = stored(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("memory")).distinct())
    own = sold.select("query", "memory").distinct()
    nth = F.row_number().over(Window.partitionBy("query").orderBy("memory"))
    seeds = own.withColumn("nth", nth).where("nth <= 5").select("query", F.col("memory").alias("node"))
    edges = _live_edges(spark, sf_dir).join(own.withColumnRenamed("memory", "a"), "a")
    edges = edges.join(own.withColumnRenamed("memory", "b"), ["query", "b"]).select("query", "a", "b", "weight")
    ranked = graph.personal_pagerank(sold, edges, seeds)
    return ranked.withColumn("score", F.round("score", 9)).where("score > 0")


INT8 = "int8 as materialized (select vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::double * 127, 0)))::double) as b from embeddings)"


def _int8_index(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    return built(spark, "int8", [rows], lambda path: ann.Int8Index(spark, path).create(rows))


@query(
    "r6_o2_int8_neighbours",
    f"""with {CURRENT}, {INT8}, k as (select q.vec_id as query, d.vec_id as doc, (list_inner_product(q.b, q.b) + list_inner_product(d.b, d.b) - 2 * list_inner_product(q.b, d.b))::bigint as dist
      from int8 q join int8 d on q.vec_id <> d.vec_id where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by dist, d.vec_id) <= {3 * K})
    select query, doc, dist, row_number() over (partition by query order by dist, doc)::int as rank from k where doc in (select doc from docs) qualify rank <= {K}""",
)
def _(spark, sf_dir):
    """Three times as many int8 neighbours as are asked for, by whole L2 distances, of which the current memories stay."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    near = _int8_index(spark, sf_dir).nearest(asked, 3 * K).select("query", "doc", "dist")
    kept = near.join(_docs(spark, sf_dir).select("doc"), "doc", "left_semi")
    order = Window.partitionBy("query").orderBy("dist", "doc")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select("query", "doc", "dist", "rank")


@query(
    "r10_facts_leg",
    f"""with {FACTS_SQL}, cur as (select * from facts qualify row_number() over (partition by subject, predicate order by valid_from desc, fact_id desc) = 1)
    select subject as key, round(max(confidence * greatest(0.3, pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 86400e6) / 90))), 6) as score
    from cur where contains(lower(object), 'urgent') or contains(lower(subject), 'c1') group by subject""",
)
def _(spark, sf_dir):
    from lorekeep.operators.temporal import current_facts

    cur = current_facts(facts(spark, sf_dir))
    hit = predicates.contains_text("object", "urgent") | predicates.contains_text("subject", "c1")
    fresh = F.greatest(F.lit(0.3), F.pow(F.lit(0.5), scoring.age_days(F.col("valid_from"), now()) / 90))
    return cur.where(hit).groupBy(F.col("subject").alias("key")).agg(F.round(F.max(F.col("confidence") * fresh), 6).alias("score"))


ENTITY = "[A-Z][a-z]{6,}"
LEG, SEEDS = 30, 30
WEIGHTS = {"vec": 0.8, "graph": 0.6, "facts": 0.5}


TURNS_SQL = """turns as (select conv_id, concat('c', conv_id) as symbols, string_agg(text, ' ' order by turn) filter (where role = 'user') as user_text,
  string_agg(text, ' ' order by turn) filter (where role = 'assistant') as assistant_text from conversations group by conv_id)"""

LEGS = f"""{BM25}, {TURNS_SQL}, {bm25_sql('ebm25', 'turns', 'conv_id', EPISODE_FIELDS)},
  fts as (select query, doc, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from bm25 qualify rank <= {LEG}),
  efts as (select query, doc, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from ebm25 qualify rank <= {LEG}),
  vec as (select a.vec_id as query, b.vec_id as doc, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.embedding::double[], b.embedding::double[]) desc, b.vec_id) as rank
    from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id in (select query from q) and b.vec_id in (select doc from docs) qualify rank <= {LEG}),
  seeds as materialized (select distinct query, doc as node from (select * from fts union all select * from vec) where rank <= {SEEDS}),
  mentions as materialized (select entity, doc as memory from (select distinct doc, unnest(regexp_extract_all(content, '{ENTITY}')) as entity from docs) qualify row_number() over (partition by entity order by doc) <= {graph.PER_ENTITY}),
  g as materialized (select distinct x.query, m.entity, m.memory from (select distinct query, entity from seeds join mentions on memory = node) x join mentions m on m.entity = x.entity),
  {pagerank_sql()},
  grph as (select query, node as doc, row_number() over (partition by query order by score desc, node) as rank from ppr qualify rank <= {LEG}),
  {FACTS_SQL}, cur as (select * from facts qualify row_number() over (partition by subject, predicate order by valid_from desc, fact_id desc) = 1),
  fct as (select query, doc, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from (
    select query, fact_id as doc, max(confidence * greatest(0.3, pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(cur.valid_from)) / 86400e6) / 90))) as score
    from cur join docs on doc = fact_id join q on contains(lower(object), term) or contains(lower(subject), term) group by all) qualify rank <= {LEG}),
  every as (select query, 'm:' || doc as key, 'fts' as leg, rank, 1.0 as w from fts union all select query, 'e:' || doc, 'fts', rank, 1.0 from efts union all select query, 'm:' || doc, 'vec', rank, {WEIGHTS['vec']} from vec
    union all select query, 'm:' || doc, 'graph', rank, {WEIGHTS['graph']} from grph union all select query, 'm:' || doc, 'facts', rank, {WEIGHTS['facts']} from fct),
  fused as materialized (select query, key, sum(w / (60 + rank))::double as score, concat_ws('+', max(case leg when 'fts' then 'fts' end), max(case leg when 'vec' then 'vec' end), max(case leg when 'graph' then 'graph' end), max(case leg when 'facts' then 'facts' end)) as via
    from every group by query, key)"""


def _turns(spark, sf_dir):
    said = lambda role: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"]), " "
    )
    both = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said("user").alias("user_text"), said("assistant").alias("assistant_text"))
    return both.withColumn("symbols", F.concat(F.lit("c"), F.col("conv_id").cast("string")))


def _keyed(rows, mark, name):
    """A leg of ranked rows (query, doc, rank)."""
    return rows.select("query", F.concat(F.lit(f"{mark}:"), F.col("doc").cast("string")).alias("key"), F.lit(name).alias("leg"), "rank")


def _best(scored):
    return fts.top_k(scored.withColumn("score", F.round("score", 6)), LEG)


def _facts_leg(spark, sf_dir, docs):
    """Current facts whose subject or object holds a word of the query, for the memory each is an index of."""
    from lorekeep.operators.temporal import current_facts

    fresh = F.greatest(F.lit(0.3), F.pow(F.lit(0.5), scoring.age_days(F.col("valid_from"), now()) / 90))
    own = current_facts(facts(spark, sf_dir)).withColumn("strength", F.col("confidence") * fresh)
    own = own.join(docs.select(F.col("doc").alias("fact_id")), "fact_id").select(F.col("fact_id").alias("doc"), "strength", F.concat_ws("\n", "subject", "object").alias("text"))
    hit = grams.held(own.select("doc", "text"), _queries(spark, sf_dir))
    return hit.join(own.select("doc", "strength"), "doc").groupBy("query", "doc").agg(F.max("strength").alias("score"))


def _mention_rows(spark, sf_dir):
    """memory and entity of the current memories, stored by the first search of the data."""
    docs = _docs(spark, sf_dir)
    named = F.array_distinct(F.regexp_extract_all("content", F.lit(ENTITY), F.lit(0)))
    return built(spark, "mentions", [docs], lambda _: stored(graph.first_mentions(docs.select(F.col("doc").alias("memory"), F.explode(named).alias("entity")))))


def _graph_leg(mentions, seeds):
    """PageRank from the memories of the other legs, over the entities that they and their neighbours mention."""
    reached = seeds.join(mentions, seeds.node == mentions.memory).select("query", "entity").distinct()
    ranked = graph.mention_pagerank(reached.join(mentions, "entity"), seeds)
    return ranked.select("query", F.col("node").alias("doc"), F.round("score", 9).alias("score"))


def _legs(spark, sf_dir):
    """The ranked legs of memories (fts, vec, graph, facts) and of episodes (fts)."""
    docs, asked = _docs(spark, sf_dir), _queries(spark, sf_dir).select("query").distinct()
    words = _index(spark, sf_dir).search(_queries(spark, sf_dir), LEG)
    episodes = _turn_index(spark, sf_dir).search(_queries(spark, sf_dir), LEG)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    current = rows.join(docs.select("doc"), "doc", "left_semi")
    near = vectors.nearest(current, rows.withColumnsRenamed({"doc": "query", "v": "q"}).join(asked, "query", "left_semi"), LEG)
    seeds = words.select("query", F.col("doc").alias("node")).union(near.select("query", "doc")).distinct()
    linked, told = fts.top_k(_graph_leg(_mention_rows(spark, sf_dir), seeds), LEG), _best(_facts_leg(spark, sf_dir, docs))
    return [_keyed(words, "m", "fts"), _keyed(episodes, "e", "fts"), _keyed(near, "m", "vec"), _keyed(linked, "m", "graph"), _keyed(told, "m", "facts")]


def _fused(spark, sf_dir):
    return fusion.rrf(_legs(spark, sf_dir), WEIGHTS)


def _memory_rows(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("key", F.concat(F.lit("m:"), F.col("doc").cast("string")))


@query("r11_u1_u2_rrf", f"with {LEGS} select query, key, round(score, 8) as score, via from fused")
def _(spark, sf_dir):
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 8))


HYBRID = f"""{LEGS}, band as (select *, min(score) over (partition by query) as lo, max(score) over (partition by query) as hi from fused),
    b as (select query, key, via, case when hi - lo < 1e-12 then 1.0 else 0.2 + 0.8 * (score - lo) / (hi - lo) end as base from band),
    m as (select query, key, via, false as episode, round((base * case when half_life_days > 0 then greatest(0.3, pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 86400e6) / half_life_days)) else 1.0 end
      * case when outcome = 'failed' then 1.5 else 1.0 end * case when kind = 'warning' then 1.2 else 1.0 end
      * least(2.0, greatest(0.2, 1.0 + 0.1 * least(helpful, 5) - 0.15 * least(harmful, 5))) * case when pinned then 1.3 else 1.0 end)::double, 6) as score from b join docs on key = 'm:' || doc
      union all select query, key, via, true, round((base * 0.6)::double, 6) from b where key like 'e:%' qualify row_number() over (partition by query order by base desc, key) <= 3),
    hits as materialized (select query, key, via, score, row_number() over (partition by query order by score desc, key)::int as rank from m qualify rank <= {K})"""


@query("r22_hybrid_search", f"with {HYBRID} select query, key, via, score, rank from hits")
def hybrid(spark, sf_dir):
    """Four legs over memories and one over episodes, weighted reciprocal ranks, bands, lifecycle modulation of
    memories, a factor and a cap for episodes, and the final top k."""
    rows = fusion.banded(_fused(spark, sf_dir))
    own = rows.join(_memory_rows(spark, sf_dir), "key").withColumn("score", scoring.modulated(F.col("score"), now())).select("query", "key", "via", "score")
    said = rows.where(F.col("key").startswith("e:")).withColumn("kind", F.lit("episode"))
    said = fusion.capped(said, "kind", 3).withColumn("score", F.col("score") * fusion.EPISODE_FACTOR).select("query", "key", "via", "score")
    best = fts.top_k(own.unionByName(said).withColumn("score", F.round("score", 6)), K, tie="key")
    return best.select("query", "key", "via", "score", "rank")


#: Greedy choice by recursion: each step takes, of the hits not yet taken, the one of the greatest gain.
MMR_SQL = rf"""with recursive {HYBRID}, own as materialized (select query, key, score, rank, list_distinct(regexp_split_to_array(content, '\s+')) as words from hits join docs on key = 'm:' || doc),
  nth as materialized (select *, row_number() over (partition by query order by score desc, key) as place, count(*) over (partition by query) as n from own),
  alike as materialized (select a.query, a.key as a, b.key as b, len(list_intersect(a.words, b.words))::double / greatest(1, len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) as s from nth a join nth b using (query)),
  picked as (select distinct query, 0 as step, []::varchar[] as keys from nth where n >= 3
    union all select query, step, list_append(keys, key) from (
      select p.query, p.step + 1 as step, p.keys, h.key, row_number() over (partition by p.query order by 0.7 * h.score - (1 - 0.7) * coalesce((select max(s) from alike where alike.query = h.query and a = h.key and list_contains(p.keys, b)), 0) desc, h.place) as best
      from picked p join nth h on h.query = p.query and not list_contains(p.keys, h.key)) where best = 1),
  whole as (select query, unnest(keys) as key, generate_subscripts(keys, 1) as position from picked qualify row_number() over (partition by query, step order by step) >= 1 and step = max(step) over (partition by query))
select query, key, position::bigint as position from whole union all select query, key, place::bigint from nth where n < 3"""


@query("r21_mmr", MMR_SQL)
def _(spark, sf_dir):
    hits = hybrid(spark, sf_dir).join(_memory_rows(spark, sf_dir).select("key", "content"), "key")
    return fusion.mmr(hits.select("query", "key", "score", F.array_distinct(F.split("content", r"\s+")).alias("words")), K)


@query(
    "r17_r18_rerank",
    f"""with {LEGS}, words as (select query, list_distinct(list(term)) as terms from q group by query),
    s as (select f.query, key, score, row_number() over (partition by f.query order by score desc, key) as nth, len(list_intersect(terms, {TOK.format('content')}))::double as hits
      from (select query, key, round(score, 8) as score from fused) f join words using (query) join docs on key = 'm:' || doc),
    b as (select *, min(case when nth <= 5 then hits end) over (partition by query) as lo, max(case when nth <= 5 then hits end) over (partition by query) as hi, max(nth) over (partition by query) as n from s)
    select query, key, round(case when n < 2 then score when nth > 5 then score * 0.1 when hi - lo < 1e-12 then 1.0 else 0.2 + 0.8 * (hits - lo) / (hi - lo) end, 6)::double as score from b""",
)
def _(spark, sf_dir):
    words = _queries(spark, sf_dir).groupBy("query").agg(F.collect_set("term").alias("terms"))
    rows = _fused(spark, sf_dir).withColumn("score", F.round("score", 8)).join(F.broadcast(words), "query")  # one row a query
    rows = rows.join(_memory_rows(spark, sf_dir).select("key", "content"), "key")
    again = fusion.rerank(rows, fusion.stub_rerank(F.col("terms"), text.tokens(F.col("content"))), top=5)
    return again.select("query", "key", F.round("score", 6).alias("score"))


@query(
    "o16_reserved_slots",
    f"""with {LEGS}, r as (select query, key, round(score, 8) as score, ends_with(key, '7') as linked from fused),
    n as (select *, row_number() over (partition by query order by score desc, key) as rank, row_number() over (partition by query, linked order by score desc, key) as nth from r),
    w as (select *, max((linked and rank <= 5)::int) over (partition by query) as has, least(sum(linked::int) over (partition by query), 1) as n_linked from n)
    select query, key, linked from w where case when has = 1 or n_linked = 0 then rank <= 5 when linked then nth <= n_linked else nth <= 5 - n_linked end""",
)
def _(spark, sf_dir):
    rows = _fused(spark, sf_dir).withColumn("score", F.round("score", 8))
    return fusion.reserve_slots(rows, 5, F.endswith(F.col("key"), F.lit("7"))).select("query", "key", "linked")


@query(
    "o3_o4_o5_sections",
    f"""{'with ' + CURRENT}, s as (select 'warnings' as section, doc, harmful as a, valid_from from docs where kind = 'warning' union all select 'pinned', doc, helpful, valid_from from docs where pinned),
    r as (select section, doc, row_number() over (partition by section order by a desc, valid_from desc, doc)::int as nth from s) select section, doc, nth from r where nth <= 8""",
)
def _(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    part = lambda name, keep, by: docs.where(keep).select(F.lit(name).alias("section"), "doc", F.col(by).alias("a"), "valid_from")
    rows = part("warnings", F.col("kind") == "warning", "harmful").unionByName(part("pinned", F.col("pinned"), "helpful"))
    order = Window.partitionBy("section").orderBy(F.desc("a"), F.desc("valid_from"), "doc")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth <= 8").select("section", "doc", "nth")


@query(
    "w7_r28_token_budget",
    f"""with {BM25}, r as (select query, doc, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from bm25 qualify rank <= {K}),
    u as (select query, doc, rank, sum(greatest(1, length(content) // 4)) over (partition by query order by rank) as used from r join docs using (doc)) select query, doc, used::bigint as used from u where used <= 3000""",
)
def _(spark, sf_dir):
    best = bm25_top_k(spark, sf_dir).join(_docs(spark, sf_dir).select("doc", "content"), "doc")
    kept = sessions.budget_prefix(best, ["query"], ["rank"], text.approx_tokens(F.col("content")), 3000)
    return kept.select("query", "doc", F.col("used").cast("long").alias("used"))


#: What an index holds after its changes: it begins with some memories in old words, gets the new ones of some ids and ids that it had not, and loses others.
OLD = "case when id % 7 = 0 then concat('alte fassung ', reverse(content)) else content end"
UPKEEP = f"{CURRENT.replace(', docs as (', ', docs as (select * from (', 1)} where doc % 13 <> 0)"


def _kept_up(spark, sf_dir):
    """An index created over old texts and then changed in three batches; each batch is sent twice."""
    rows = memories(spark, sf_dir).where(predicates.current_truth(now()))
    old = rows.where("id % 10 <> 3").withColumn("content", F.expr(OLD))
    index = InvertedIndex(spark, scratch(spark), "id", FIELDS).create(old)
    for _ in range(2):
        index.upsert(rows.where("id % 7 = 0"), 1)
        index.upsert(rows.where("id % 10 = 3"), 2)
        index.delete(rows.where("id % 13 = 0").select("id"), 3)
    return index, rows


@query(
    "r1_r3_index_upkeep",
    f"""with {UPKEEP}, {QUERIES}, {bm25_sql('bm25', 'docs', 'doc', FIELDS)}, ranked as (select query, doc, round(score, 6) as score, row_number() over (partition by query order by round(score, 6) desc, doc)::int as rank from bm25)
    select compacted, query, doc, score, rank from ranked, (values (false), (true)) c(compacted) where rank <= {K}""",
)
def _(spark, sf_dir):
    """Searches of an index after inserts, updates and deletes, before and after what stands is written as one segment."""
    index, _ = _kept_up(spark, sf_dir)
    before = index.search(_queries(spark, sf_dir), K)
    index.compact(4)
    after = index.search(_queries(spark, sf_dir), K)
    return before.withColumn("compacted", F.lit(False)).unionByName(after.withColumn("compacted", F.lit(True))).select("compacted", "query", "doc", "score", "rank")


@query("j1_postings", f"with {CURRENT}, {QUERIES}, {bm25_sql('bm25', 'docs', 'doc', FIELDS)} select doc, term, round(tf, 6) as tf, round(dl, 6) as dl from bm25_tf")
def _(spark, sf_dir):
    """The postings of the terms of the stated queries, met with their documents' lengths."""
    rows = _index(spark, sf_dir).standing(_queries(spark, sf_dir))
    each = rows.select("term", "block", F.explode(F.arrays_zip("places", "tf", "dl")).alias("e"))
    width = _index(spark, sf_dir).width
    return each.select((F.col("block") * width + F.col("e.places")).alias("doc"), "term", F.round("e.tf", 6).alias("tf"), F.round("e.dl", 6).alias("dl"))


LENGTH_SQL = " + ".join(f"{w} * len({TOK.format(f"coalesce({f}, '')")})" for f, w in FIELDS.items())


@query(
    "m9_index_drift",
    f"""with {CURRENT}, was as (select doc, {LENGTH_SQL.replace('coalesce(content', "coalesce((case when doc % 7 = 0 then concat('alte fassung ', reverse(content)) else content end)")} as dl from docs where doc % 10 <> 3),
    is_ as (select doc, {LENGTH_SQL} as dl from docs where doc % 17 <> 5)
    select coalesce(was.doc, is_.doc) as doc, case when was.doc is null then 'missing' when is_.doc is null then 'left' else 'stale' end as drift from was full join is_ on was.doc = is_.doc where was.dl is distinct from is_.dl""",
)
def _(spark, sf_dir):
    """What a health check of the index finds: documents it lacks, has too many of, or has in other words."""
    rows = memories(spark, sf_dir).where(predicates.current_truth(now()))
    index = InvertedIndex(spark, scratch(spark), "id", FIELDS).create(rows.where("id % 10 <> 3").withColumn("content", F.expr(OLD)))
    return index.drift(rows.where("id % 17 <> 5"))
