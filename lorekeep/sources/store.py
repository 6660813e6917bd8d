"""The memory store's tables, and views that cast the driver's tables into them.

``MEMORY_COLUMNS`` derives a versioned memory envelope from ``documents`` by expressions that Spark SQL
and the oracle both run; only the spelling of a timestamp from epoch seconds differs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import table

#: The processing time of all registered queries: results must not depend on the clock.
NOW = "2024-03-01 00:00:00"

MEMORY_COLUMNS = {
    "id": "doc_id",
    "uid": "concat('M', lpad(cast(doc_id as varchar(20)), 12, '0'))",
    "content": "text",
    "summary": "substr(text, 1, 80)",
    "symbols": "source",
    "tags": "lang",
    "lang": "lang",
    "source": "source",
    "kind": "case doc_id % 9 when 1 then 'fact' when 2 then 'decision' when 3 then 'preference' when 4 then 'warning' when 5 then 'insight' when 6 then 'profile' when 7 then 'strategy' when 8 then 'case' end",
    "epistemic": "case doc_id % 3 when 0 then 'observation' when 1 then 'inference' else 'belief' end",
    "status": "case when doc_id % 23 = 0 then 'tombstone' when doc_id % 19 = 0 then 'summarized' when doc_id % 29 = 0 then 'quarantined' else 'active' end",
    "live": "doc_id % 31 <> 0",
    "trust_tier": "case doc_id % 5 when 0 then 'owner' when 1 then 'agent' when 2 then 'known_user' when 3 then 'tool' else 'untrusted' end",
    "scope_user": "case when doc_id % 7 = 0 then concat('u', cast(doc_id % 3 as varchar(20))) end",
    "scope_project": "case when doc_id % 11 = 0 then 'p1' when doc_id % 13 = 0 then 'p2' end",
    "valid_from": "{ts}(1704067200 + (doc_id * 7919) % 2592000)",
    "valid_to": "case when doc_id % 17 = 0 then {ts}(1704067200 + (doc_id * 7919) % 2592000 + 864000) end",
    "ttl_at": "case when doc_id % 37 = 0 then {ts}(1704067200 + (doc_id * 104729) % 8640000) end",
    "pinned": "doc_id % 41 = 0",
    "half_life_days": "case when doc_id % 4 <> 0 then cast(7 + doc_id % 60 as double) end",
    "helpful": "doc_id % 6",
    "harmful": "doc_id % 4",
    "recalls": "case when doc_id % 2 = 0 then doc_id % 10 else 0 end",
    "verifications": "doc_id % 5",
    "outcome": "case doc_id % 12 when 0 then 'failed' when 1 then 'success' end",
    "surprise": "cast(doc_id % 100 as double) / 100",
    "last_recalled_at": "case when doc_id % 2 = 0 then {ts}(1706745600 + (doc_id * 31) % 1728000) end",
}


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as memory rows."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(*[F.expr(e.replace("{ts}", "timestamp_seconds")).alias(n) for n, e in MEMORY_COLUMNS.items()])


_DUCK = {n: e.replace("{ts}", "seconds_to_timestamp") for n, e in MEMORY_COLUMNS.items()}
MEMORIES_SQL = "memories as (select " + ", ".join(f"{e} as {n}" for n, e in _DUCK.items()) + " from documents)"
MEMORIES_SQL = re.sub(r"seconds_to_timestamp\(((?:[^()]|\([^()]*\))*)\)", r"make_timestamp(1000000 * (\1))", MEMORIES_SQL)

NOW_SQL = f"timestamp '{NOW}'"
CURRENT_SQL = f"valid_to is null and status = 'active' and live and (ttl_at is null or ttl_at > {NOW_SQL})"


def now():
    return F.lit(NOW).cast("timestamp")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a turn outcome log: errors are failures, purchases verified, signups blocked."""
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "verified")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_id").alias("turn_id"),
        F.col("ts").alias("created_at"),
        outcome.when(F.col("event_type") == "signup", "blocked").otherwise("open").alias("outcome"),
        F.when(F.col("value") > 50, "thumbs_down").when(F.col("value") < 2, "positive").alias("feedback"),
        F.col("event_type").alias("skill"),
        F.col("value").alias("cost"),
    )


OUTCOMES_SQL = """outcomes as (select concat('s', cast(user_id as varchar)) as session_id, event_id as turn_id, ts as created_at,
  case event_type when 'error' then 'failed' when 'purchase' then 'verified' when 'signup' then 'blocked' else 'open' end as outcome,
  case when value > 50 then 'thumbs_down' when value < 2 then 'positive' end as feedback, event_type as skill, value as cost from events)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as subject-predicate-object facts: a customer's status at a date, one order a fact."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fact_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"),
        F.when(F.col("o_orderkey") % 2 == 0, "status").otherwise("priority").alias("predicate"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("object"),
        (F.lit(1.0) - (F.col("o_orderkey") % 5) / 10).alias("confidence"),
        F.col("o_orderdate").alias("valid_from"),
    )


FACTS_SQL = """facts as (select o_orderkey as fact_id, concat('c', cast(o_custkey as varchar)) as subject,
  case when o_orderkey % 2 = 0 then 'status' else 'priority' end as predicate,
  case when o_orderkey % 2 = 0 then o_orderstatus else o_orderpriority end as object,
  1.0::double - (o_orderkey % 5)::double / 10 as confidence, o_orderdate as valid_from from orders)"""
