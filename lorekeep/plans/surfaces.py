"""Queries of capture, guarded edits, episode search and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import capture, predicates, sessions
from lorekeep.plans.registry import query
from lorekeep.plans.retrieval import EPISODE_FIELDS, QUERIES, TURNS_SQL, _queries, _turn_index, bm25_sql
from lorekeep.session import table
from lorekeep.sources import readers
from lorekeep.sources.store import MEMORIES_SQL, OUTCOMES_SQL, memories, outcomes

M = f"with {MEMORIES_SQL}"
O = f"with {OUTCOMES_SQL}"  # noqa: E741


@query(
    "r4_r33_episode_search",
    f"""with {TURNS_SQL}, {QUERIES}, {bm25_sql('found', 'turns', 'conv_id', EPISODE_FIELDS)}
    select query, doc, round(score, 6) as score from found qualify row_number() over (partition by query order by round(score, 6) desc, doc) <= 5""",
)
def _(spark, sf_dir):
    return _turn_index(spark, sf_dir).search(_queries(spark, sf_dir), 5).select("query", "doc", "score")


@query(
    "k1_captured_turns",
    """with p as (select *, coalesce(sum((role = 'assistant' and trim(text) <> '')::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as pair from conversations),
    g as (select conv_id, pair::bigint as pair, string_agg(text, chr(10) || chr(10) order by turn) filter (where role = 'user') as u, coalesce(max(text) filter (where role = 'assistant'), '') as a
      from p where role in ('user', 'assistant') and trim(text) <> '' group by conv_id, pair) select conv_id, pair, length(u)::bigint as n_user, length(a)::bigint as n_assistant from g where u <> ''""",
)
def _(spark, sf_dir):
    rows = capture.captured_turns(sessions.pair_turns(table(spark, sf_dir, "conversations")))
    return rows.select("conv_id", "pair", F.length("user_text").cast("long").alias("n_user"), F.length("assistant_text").cast("long").alias("n_assistant"))


@query(
    "k3_pre_compress",
    """with r as (select conv_id, turn, row_number() over w as nth, sum(length(text)) over (w rows unbounded preceding) as used from conversations window w as (partition by conv_id order by turn desc)) select conv_id, turn from r where nth <= 3 and used <= 900""",
)
def _(spark, sf_dir):
    return capture.pre_compress(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3, 900).select("conv_id", "turn")


@query("k21_k22_stamped", f"{M} select id, case when toxic = 1 then 'failed' when toxic = 0 then 'success' else outcome end as outcome from memories left join labels on id = doc_id")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "failed").otherwise("success").alias("value"))
    return capture.stamped(memories(spark, sf_dir), labels, "outcome").select("id", "outcome")


@query("k23_may_correct", f"{M} select id, trust_tier in ('known_user', 'tool', 'untrusted') and not pinned as may from memories")
def _(spark, sf_dir):
    return memories(spark, sf_dir).select("id", capture.may_correct("known_user").alias("may"))


@query("k24_edited_tags", "select doc_id, array_to_string(list_filter([lang, case when source = 'src1' then 'first' else source end], lambda t: t <> 'de'), ',') as tags from documents")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    return capture.edited_tags(rows, {"src1": "first"}, ["de"]).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("k27_upserted", "select c_custkey, case when c_custkey in (select distinct o_custkey from orders where o_orderstatus = 'P') then 0.0 else c_acctbal end as c_acctbal from customer")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    some = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return capture.upserted(rows, rows.join(some, "c_custkey", "left_semi").withColumn("c_acctbal", F.lit(0.0)), ["c_custkey"])


@query("m1_identities", "select c_mktsegment as platform, c_nationkey as \"user\", min(c_custkey) as principal from customer group by 1, 2")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("platform"), F.col("c_nationkey").alias("user"), F.col("c_custkey").alias("principal"), F.lit(False).alias("is_owner")
    )
    first = rows.groupBy("platform", "user").agg(F.min("principal").alias("principal"), F.first("is_owner").alias("is_owner"))
    return capture.merged_identities(first, rows).select("platform", "user", "principal")


@query("m3_decided", f"{M} select id, case when status = 'quarantined' and toxic is not null then case when toxic = 0 then 'active' else 'tombstone' end else status end as status from memories left join labels on id = doc_id")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 0).alias("approve"))
    return capture.decided(memories(spark, sf_dir), labels).select("id", "status")


@query("p21_lifecycle_state", f"{M} select id, case when ttl_at is not null then 'temporary' else 'durable' end as retention from memories")
def _(spark, sf_dir):
    return memories(spark, sf_dir).select("id", predicates.lifecycle_state().alias("retention"))


@query("s16_hardened", f"{M} select id, case when trust_tier in ('owner', 'agent') then 'known_user' else trust_tier end as trust_tier from memories")
def _(spark, sf_dir):
    return readers.hardened(memories(spark, sf_dir)).select("id", "trust_tier")


@query(
    "t6_gap_sessions",
    f"""{O}, g as (select *, coalesce(epoch_us(created_at) - epoch_us(lag(created_at) over s) >= 7200000000, true)::int as brk from outcomes window s as (partition by session_id order by created_at)),
    i as (select *, sum(brk) over (partition by session_id order by created_at rows unbounded preceding) as n from g) select session_id, min(created_at) as start, max(created_at) + interval 2 hour as "end", count(*) as n_turns from i group by session_id, n""",
)
def _(spark, sf_dir):
    from lorekeep.streaming.sessions import gap_sessions

    return gap_sessions(outcomes(spark, sf_dir))


@query("t4_stale_sessions", f"{O} select session_id from outcomes group by session_id having max(created_at) < timestamp '2024-01-30 18:00:00' and count(*) filter (where outcome = 'blocked' and created_at > timestamp '2024-01-29') = 0")
def _(spark, sf_dir):
    cut, day = (F.lit(t).cast("timestamp") for t in ("2024-01-30 18:00:00", "2024-01-29"))
    rows = outcomes(spark, sf_dir).groupBy("session_id").agg(
        F.max("created_at").alias("newest"), F.count_if((F.col("outcome") == "blocked") & (F.col("created_at") > day)).alias("ended")
    )
    return rows.where((F.col("newest") < cut) & (F.col("ended") == 0)).select("session_id")


@query("f8_entities", r"select p_partkey, substr(trim(regexp_replace(replace(lower(nfc_normalize(p_name)), 'ß', 'ss'), '\s+', ' ', 'g')), 1, 120) as entity from part")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_entity(F.col("p_name")).alias("entity"))


@query("f20_tags", "select event_id, list_filter([trim(x) for x in string_split(event_type || ', ' || user_id, ',')], lambda t: t <> '')[1] as tag from events")
def _(spark, sf_dir):
    tags = text.tag_list(F.concat_ws(", ", "event_type", F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(tags, 1).alias("tag"))
