"""Row predicates: current truth, points in time, row-level security, filters and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_truth(now: Column) -> Column:
    """Open, active, live and not past its time to live."""
    return (
        F.col("valid_to").isNull()
        & (F.col("status") == "active")
        & F.col("live")
        & (F.col("ttl_at").isNull() | (F.col("ttl_at") > now))
    )


def as_of(at: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Valid in the half-open interval around ``at``."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at))


def memory_rls(principal: str | None, trust: str) -> Column:
    """Owners see all; others rows without a user or with theirs, and never peer cards."""
    if trust == "owner":
        return F.lit(True)
    own = F.col("scope_user").isNull() | F.col("scope_user").eqNullSafe(F.lit(principal)) if principal else F.col("scope_user").isNull()
    return own & ~F.col("kind").eqNullSafe("peer_card")


def episode_rls(principal: str | None, author: str | None, trust: str) -> Column:
    """Never untrusted rows; others than owners need a matching principal or author, else see nothing."""
    trusted = F.col("trust_tier") != "untrusted"
    if trust == "owner":
        return trusted
    match = F.lit(False)
    for column, value in (("principal_id", principal), ("source_author", author)):
        if value is not None:
            match = match | F.col(column).eqNullSafe(value)
    return trusted & match


def kinds(include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Included kinds only; excluded ones not, but rows without a kind survive an exclusion."""
    keep = F.col("kind").isin(include) if include else F.lit(True)
    return keep & (F.col("kind").isNull() | ~F.col("kind").isin(exclude)) if exclude else keep


def project(name: str | None) -> Column:
    return F.col("scope_project").isNull() | (F.col("scope_project") == name) if name else F.lit(True)


def epistemic(allowed: list[str] | None) -> Column:
    return F.col("epistemic").isin(allowed) if allowed else F.lit(True)


def date_window(start: str | None, end: str | None, column: str = "valid_from") -> Column:
    """At second granularity, before ranking; a bare end date includes its whole day."""
    at = F.date_trunc("second", column)
    keep = F.lit(True)
    if start:
        keep = keep & (at >= F.lit(start).cast("timestamp"))
    if end and len(end) == 10:
        keep = keep & (at < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    elif end:
        keep = keep & (at <= F.lit(end).cast("timestamp"))
    return keep


def prefix_window(start: str | None, end: str | None, column: str) -> Column:
    """Inclusive on the text of a timestamp, as long as the bound is written."""
    keep = F.lit(True)
    if start:
        keep = keep & (F.substring(column, 1, len(start)) >= start)
    if end:
        keep = keep & (F.substring(column, 1, len(end)) <= end)
    return keep


def recent(days: int, now: Column, column: str = "valid_from") -> Column:
    return F.col(column) >= now - F.expr(f"interval {days} days") if days > 0 else F.lit(True)


def resolve_uid(rows: DataFrame, prefix: str, candidates: int = 5) -> DataFrame:
    """Rows whose uid starts with ``prefix`` (6 characters at least), with ``ambiguous``: more than one.

    At most ``candidates`` rows come back, in order of uid."""
    if len(prefix) < 6:
        raise ValueError("a uid prefix has at least 6 characters")
    found = rows.where(F.col("uid").startswith(prefix)).orderBy("uid").limit(candidates)
    return found.withColumn("ambiguous", F.lit(found.limit(2).count() > 1))


def contains_text(column: str, token: str) -> Column:
    """Substring test, taken literally, in any case."""
    return F.contains(F.lower(column), F.lit(token.lower()))


def after_cursor(columns: list[str], values: list) -> Column:
    """Row-value comparison with a cursor."""
    return F.struct(*columns) > F.struct(*[F.lit(v) for v in values])


def syncable() -> Column:
    """What may leave the store: active or tombstoned rows without a user or project, trusted enough."""
    return (
        F.col("status").isin("active", "tombstone")
        & F.col("scope_user").isNull()
        & F.col("scope_project").isNull()
        & (F.col("trust_tier") != "untrusted")
    )


def demotable(score: Column, now_age: Column, below: float = 0.15) -> Column:
    """Low value and stale and unproven and untouched."""
    stale = F.when(F.col("half_life_days") > 0, now_age > F.col("half_life_days") * 2).otherwise(now_age > 180)
    return ~F.col("pinned") & F.col("outcome").isNull() & (F.col("recalls") <= 0) & (score < below) & stale


def lifecycle_state() -> Column:
    """The retention of a row: temporary where it has a time to live."""
    return F.when(F.col("ttl_at").isNotNull(), "temporary").otherwise("durable")


def why_not(now: Column, tokens: Column) -> Column:
    """The reasons, in order, why a row is no answer to a query; empty if it may be one."""
    own = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    reasons = F.array(
        F.when(F.col("valid_to").isNotNull(), "superseded"),
        F.when(F.col("status") != "active", F.concat(F.lit("status:"), "status")),
        F.when(~F.col("live"), "not live"),
        F.when(F.col("ttl_at") <= now, "expired"),
        F.when(~F.arrays_overlap(own, tokens), "no shared term"),
    )
    return F.filter(reasons, lambda r: r.isNotNull())
