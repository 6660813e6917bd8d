"""Versions, intervals and temporal joins.

Versioned tables are append-only: a change gives new rows and closed copies of old ones, which the caller
writes as the next snapshot. Point-in-time reads are filters (see ``predicates.as_of``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fact_intervals(facts: DataFrame, close_at: Column | None = None) -> DataFrame:
    """``valid_until`` and ``superseded_by`` of every fact: the next fact of its subject and predicate.

    ``close_at`` closes at a processing time instead of at the successor's start."""
    order = Window.partitionBy("subject", "predicate").orderBy("valid_from", "fact_id")
    successor = F.lead("fact_id").over(order)
    until = F.lead("valid_from").over(order)
    if close_at is not None:
        until = F.when(successor.isNotNull(), close_at)
    return facts.withColumn("valid_until", until).withColumn("superseded_by", successor)


def current_facts(facts: DataFrame) -> DataFrame:
    """The single current row of each subject and predicate, by a map-side maximum."""
    row = F.struct("valid_from", "fact_id", *[c for c in facts.columns if c not in ("valid_from", "fact_id", "subject", "predicate")])
    best = facts.groupBy("subject", "predicate").agg(F.max(row).alias("r"))
    return best.select("subject", "predicate", "r.*")


def end_facts(facts: DataFrame, ends: DataFrame) -> DataFrame:
    """Close the open facts named by (subject, predicate, end_at), without replacement."""
    joined = facts.join(ends, ["subject", "predicate"], "left")
    closes = F.col("valid_until").isNull() & F.col("end_at").isNotNull()
    return joined.withColumn("valid_until", F.when(closes, F.col("end_at")).otherwise(F.col("valid_until"))).drop("end_at")


def successors(rows: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The next snapshot after ``changes`` (id, new_id, new_content): each changed open row is closed and
    followed by a version that copies its envelope; other rows are unchanged."""
    joined = rows.join(changes, "id", "left")
    changed = F.col("new_id").isNotNull() & F.col("valid_to").isNull()
    closed = joined.withColumns(
        {
            "valid_to": F.when(changed, now).otherwise(F.col("valid_to")),
            "superseded_by": F.when(changed, F.col("new_id")).otherwise(F.col("superseded_by")),
        }
    )
    new = joined.where(changed).select(
        *[
            {
                "id": F.col("new_id"), "content": F.col("new_content"), "version": F.col("version") + 1,
                "valid_from": now, "valid_to": F.lit(None).cast("timestamp"), "supersedes": F.col("id"),
                "superseded_by": F.lit(None).cast("long"),
            }.get(c, F.col(c)).alias(c)
            for c in rows.columns
        ]
    )
    return closed.select(*rows.columns).unionByName(new)


def chain_heads(links: DataFrame, max_hops: int = 64) -> DataFrame:
    """``id`` and ``head``, the last version of each row's chain, by pointer doubling.

    ``links`` has (id, next_id), one successor at most for each id. Each round doubles the hops, so a chain
    of n versions takes log n joins; rows on a cycle point at themselves (``head`` null)."""
    pointer = links.select("id", F.coalesce("next_id", "id").alias("head"))
    hops = 1
    while hops < max_hops:
        ahead = pointer.select(F.col("id").alias("head"), F.col("head").alias("further"))
        pointer = pointer.join(ahead, "head", "left").select("id", F.coalesce("further", "head").alias("head"))
        hops *= 2
    ends = links.where(F.col("next_id").isNull()).select(F.col("id").alias("head"), F.lit(True).alias("is_end"))
    return pointer.join(ends, "head", "left").select("id", F.when(F.col("is_end"), F.col("head")).alias("head"))


def forward_asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, left_id: str, within_s: int) -> DataFrame:
    """Each left row with the first right row of its keys at or after it, within ``within_s`` seconds.

    Times are cut into buckets as wide as the tolerance and a left row is matched with its own and the next
    bucket, so the join is on equality of keys and bucket and holds no key's whole history at once. The first
    match is a map-side minimum. Left rows without a match keep nulls."""
    width = F.lit(within_s)
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    near = left.withColumn("bucket", F.explode(F.array(bucket(F.col(left_at)), bucket(F.col(left_at)) + 1)))
    far = right.withColumn("bucket", bucket(F.col(right_at)))
    extra = [c for c in right.columns if c not in keys]
    hit = near.join(far, [*keys, "bucket"]).where(
        (F.col(right_at) >= F.col(left_at)) & (F.unix_micros(right_at) - F.unix_micros(left_at) <= F.lit(within_s * 1_000_000))
    )
    first = hit.groupBy(left_id).agg(F.min(F.struct(right_at, *[c for c in extra if c != right_at])).alias("m"))
    return left.join(first, left_id, "left").select(*[left[c] for c in left.columns], "m.*")


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, left_id: str, within_s: int) -> DataFrame:
    """Like ``forward_asof`` but for the first right row within ``within_s`` seconds on either side."""
    width = F.lit(within_s)
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    b = bucket(F.col(left_at))
    near = left.withColumn("bucket", F.explode(F.array(b - 1, b, b + 1)))
    far = right.withColumn("bucket", bucket(F.col(right_at)))
    extra = [c for c in right.columns if c not in keys]
    hit = near.join(far, [*keys, "bucket"]).where(F.abs(F.unix_micros(right_at) - F.unix_micros(left_at)) <= F.lit(within_s * 1_000_000))
    first = hit.groupBy(left_id).agg(F.min(F.struct(right_at, *[c for c in extra if c != right_at])).alias("m"))
    return left.join(first, left_id, "left").select(*[left[c] for c in left.columns], "m.*")


def range_slice(rows: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Rows inside the spans (key, start, end, span_id) of their key, both ends included."""
    return rows.join(spans, key).where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end")))
