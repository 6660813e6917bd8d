"""Queries over single rows: predicates, text functions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions import scoring, text
from lorekeep.operators import predicates
from lorekeep.plans.registry import query
from lorekeep.session import table
from lorekeep.sources.store import CURRENT_SQL, FACTS_SQL, MEMORIES_SQL, NOW_SQL, OUTCOMES_SQL, facts, memories, now, outcomes

WITH = f"with {MEMORIES_SQL} "


@query("p1_current_truth", f"{WITH} select id, uid, kind from memories where {CURRENT_SQL}")
def _(spark, sf_dir):
    return memories(spark, sf_dir).where(predicates.current_truth(now())).select("id", "uid", "kind")


@query(
    "p2_as_of_facts",
    f"""with {FACTS_SQL}, spans as (select *, lead(valid_from) over (partition by subject, predicate order by valid_from, fact_id) as valid_until from facts)
    select fact_id, subject, predicate, object, valid_from from spans
    where valid_from <= timestamp '1997-01-01' and (valid_until is null or valid_until > timestamp '1997-01-01')""",
)
def _(spark, sf_dir):
    from lorekeep.operators.temporal import fact_intervals

    spans = fact_intervals(facts(spark, sf_dir))
    at = F.lit("1997-01-01").cast("timestamp")
    return spans.where(predicates.as_of(at)).select("fact_id", "subject", "predicate", "object", "valid_from")


@query(
    "p3_p5_p6_p7_scoped",
    f"""{WITH} select id, kind, scope_user from memories where (scope_user is null or scope_user = 'u1') and kind is distinct from 'peer_card'
    and (kind is null or kind not in ('case', 'warning')) and (scope_project is null or scope_project = 'p1') and epistemic in ('observation', 'belief')""",
)
def _(spark, sf_dir):
    keep = predicates.memory_rls("u1", "agent") & predicates.kinds(exclude=["case", "warning"])
    keep = keep & predicates.project("p1") & predicates.epistemic(["observation", "belief"])
    return memories(spark, sf_dir).where(keep).select("id", "kind", "scope_user")


@query(
    "p4_episode_rls",
    """select conv_id, turn from (select *, concat('u', cast(conv_id % 5 as varchar)) as principal_id,
    case when conv_id % 4 = 0 then 'untrusted' else 'agent' end as trust_tier, concat('a', cast(turn % 3 as varchar)) as source_author from conversations)
    where trust_tier <> 'untrusted' and (principal_id = 'u2' or source_author = 'a1')""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("u"), F.col("conv_id") % 5).alias("principal_id"),
        F.when(F.col("conv_id") % 4 == 0, "untrusted").otherwise("agent").alias("trust_tier"),
        F.concat(F.lit("a"), F.col("turn") % 3).alias("source_author"),
    )
    return rows.where(predicates.episode_rls("u2", "a1", "agent")).select("conv_id", "turn")


@query(
    "p8_p10_date_windows",
    f"""{WITH} select id, valid_from, valid_from >= {NOW_SQL} - interval 45 day as is_recent from memories
    where date_trunc('second', valid_from) >= timestamp '2024-01-05' and date_trunc('second', valid_from) < timestamp '2024-01-21'""",
)
def _(spark, sf_dir):
    keep = predicates.date_window("2024-01-05", "2024-01-20")
    return memories(spark, sf_dir).where(keep).select("id", "valid_from", predicates.recent(45, now()).alias("is_recent"))


@query("p9_prefix_window", f"{WITH} select id from memories where substr(cast(valid_from as varchar), 1, 10) between '2024-01-03' and '2024-01-09'")
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).withColumn("at", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss"))
    return rows.where(predicates.prefix_window("2024-01-03", "2024-01-09", "at")).select("id")


@query(
    "p11_uid_prefix",
    f"{WITH}, found as (select id, uid from memories where starts_with(uid, 'M00000000') order by uid limit 5) select id, uid, (select count(*) from found) > 1 as ambiguous from found",
)
def _(spark, sf_dir):
    return predicates.resolve_uid(memories(spark, sf_dir), "M00000000").select("id", "uid", "ambiguous")


@query("p12_like_literal", "select doc_id from documents where contains(lower(text), '%%%')")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(predicates.contains_text("text", "%%%")).select("doc_id")


@query("p14_row_cursor", "select event_id, ts from events where (ts, event_id) > (timestamp '2024-01-15 12:00:00', 0)")
def _(spark, sf_dir):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").where(F.struct("ts", "event_id") > F.struct(at, F.lit(0).cast("long"))).select("event_id", "ts")


@query(
    "p16_p17_sync_rows",
    f"{WITH} select uid, md5(content) as body, kind from memories where status in ('active', 'tombstone') and scope_user is null and scope_project is null and trust_tier <> 'untrusted'",
)
def _(spark, sf_dir):
    return memories(spark, sf_dir).where(predicates.syncable()).select("uid", F.md5("content").alias("body"), "kind")


VALUE_SQL = f"""case when pinned then 1.0 else least(1.0, greatest(0.0,
  0.15 * least(1.0, ln(1 + greatest(verifications, 0)) / ln(11))
  + 0.15 * case when scope_user is null then 0.0 when recalls > 0 then 1.0 else 0.4 end
  + 0.25 * case when helpful > 0 or harmful > 0 then 1.0 / (1.0 + exp((harmful - helpful)::double)) else 0.0 end
  + 0.20 * (0.5 * least(1.0, ln(1 + recalls) / ln(21)) + 0.5 * case when last_recalled_at is null then 0.0
      else pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(last_recalled_at)) / 86400e6) / 90) end)
  + 0.15 * case when half_life_days > 0 then exp(-pow(greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 86400e6) / (half_life_days / ln(2)),
      case kind {' '.join(f"when '{k}' then {v}" for k, v in scoring.DECAY_SHAPES.items())} else 1.0 end))
      else exp(-greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 86400e6) / 365) end
  + 0.10 * least(1.0, greatest(0.0, surprise)))) end"""


@query("v16_value_score", f"{WITH} select id, round(({VALUE_SQL})::double, 6) as value from memories")
def _(spark, sf_dir):
    return memories(spark, sf_dir).select("id", F.round(scoring.value_score(now()), 6).alias("value"))


@query(
    "p18_v19_demotable",
    f"""{WITH}, aged as (select *, ({VALUE_SQL})::double as value, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 86400e6) as age from memories where {CURRENT_SQL})
    select id from aged where not pinned and outcome is null and recalls <= 0 and value < 0.3
    and case when half_life_days > 0 then age > 2 * half_life_days else age > 180 end""",
)
def _(spark, sf_dir):
    rows = memories(spark, sf_dir).where(predicates.current_truth(now()))
    age = scoring.age_days(F.col("valid_from"), now())
    return rows.where(predicates.demotable(scoring.value_score(now()), age, 0.3)).select("id")


@query(
    "r19_modulated",
    f"""{WITH} select id, round(1.0 * case when half_life_days > 0 then greatest(0.3, pow(0.5, greatest(0.0, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 86400e6) / half_life_days)) else 1.0 end
    * case when outcome = 'failed' then 1.5 else 1.0 end * case when kind = 'warning' then 1.2 else 1.0 end
    * least(2.0, greatest(0.2, 1.0 + 0.1 * least(helpful, 5) - 0.15 * least(harmful, 5))) * case when pinned then 1.3 else 1.0 end, 6)::double as score from memories""",
)
def _(spark, sf_dir):
    return memories(spark, sf_dir).select("id", F.round(scoring.modulated(F.lit(1.0), now()), 6).alias("score"))


@query(
    "v18_weibull_hours",
    f"""{WITH}, a as (select id, kind, (epoch_us({NOW_SQL}) - epoch_us(valid_from)) / 3600e6 as h from memories)
    select id, round(case when h <= 0 then 1.0 else exp(-pow(h / case kind {' '.join(f"when '{k}' then {v[1]}" for k, v in scoring.WEIBULL_HOURS.items())} else 168.0 end,
    case kind {' '.join(f"when '{k}' then {v[0]}" for k, v in scoring.WEIBULL_HOURS.items())} else 1.0 end)) end::double, 6) as survival from a""",
)
def _(spark, sf_dir):
    hours = (F.unix_micros(now()) - F.unix_micros("valid_from")) / F.lit(3600e6)
    return memories(spark, sf_dir).select("id", F.round(scoring.weibull_hours(hours, F.col("kind")), 6).alias("survival"))


@query(
    "v24_v25_credit_and_verdict",
    f"""with {OUTCOMES_SQL} select turn_id, case when feedback = 'thumbs_down' or outcome in ('failed', 'blocked') then 'harmful'
    when outcome = 'verified' or feedback = 'positive' then 'helpful' else 'neutral' end as credit,
    case when feedback = 'thumbs_down' then 'failure' when feedback = 'positive' then 'success' when outcome in ('failed', 'blocked') then 'failure'
    when outcome = 'verified' then 'success' else 'unknown' end as verdict from outcomes""",
)
def _(spark, sf_dir):
    both = F.col("outcome"), F.col("feedback")
    return outcomes(spark, sf_dir).select("turn_id", scoring.credit(*both).alias("credit"), scoring.verdict(*both).alias("verdict"))


@query("r1_tokens", r"select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::int as n_tokens from documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"))


_HTML_SYMBOLS = " ".join(
    f"|| list_filter(regexp_extract_all(html, '{p}', 1), lambda s: length(s) >= {n} and lower(s) not in ({', '.join(repr(w) for w in text.PROSE)}))"
    for p, n in text.SYMBOLS[1:]
)


@query(
    "f9_code_symbols",
    f"""select page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, '{text.SYMBOLS[0][0]}', 1),
    lambda s: regexp_replace(s, '\\([^)]*\\)', '', 'g')), lambda s: length(s) >= 2) {_HTML_SYMBOLS}))[1:64], ' ') as symbols from pages""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.code_symbols(F.col("html")), " ").alias("symbols"))




@query(
    "f22_cursor_round_trip",
    "select event_id, base64(encode(concat_ws('|', cast(epoch_us(ts) as varchar), cast(event_id as varchar)))) as cursor, cast(event_id as varchar) as back from events",
)
def _(spark, sf_dir):
    made = table(spark, sf_dir, "events").withColumn("cursor", text.cursor(F.unix_micros("ts"), F.col("event_id")))
    return made.select("event_id", "cursor", text.read_cursor(F.col("cursor"))["event_id"].alias("back"))


@query(
    "p22_why_not",
    rf"""{WITH} select id, array_to_string(list_filter([case when valid_to is not null then 'superseded' end, case when status <> 'active' then 'status:' || status end,
    case when not live then 'not live' end, case when ttl_at <= {NOW_SQL} then 'expired' end,
    case when not list_has_any(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+'), ['idiot', 'license']) then 'no shared term' end], lambda r: r is not null), '; ') as reasons from memories""",
)
def _(spark, sf_dir):
    reasons = predicates.why_not(now(), F.array(F.lit("idiot"), F.lit("license")))
    return memories(spark, sf_dir).select("id", F.array_join(reasons, "; ").alias("reasons"))
