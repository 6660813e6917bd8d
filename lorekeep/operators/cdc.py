"""Change events: logs, paging, last-writer-wins merges and deduplicated application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPS = ("create", "supersede", "tombstone", "purge")


def page(events: DataFrame, cursor: tuple | None, limit: int) -> DataFrame:
    """The next events in order of (ts, event_id) after a cursor."""
    rows = events
    if cursor is not None:
        rows = rows.where(F.struct("ts", "event_id") > F.struct(F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1]).cast("long")))
    return rows.orderBy("ts", "event_id").limit(limit)


def last_writer_wins(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row for each uid: the later ``recorded_at`` wins, equal times go to the greater origin.

    Both sides meet in one aggregation with a map-side maximum, so no join is needed."""
    columns = [c for c in local.columns if c not in ("uid", "recorded_at", "origin")]
    row = F.struct("recorded_at", "origin", *columns)
    return local.unionByName(remote).groupBy("uid").agg(F.max(row).alias("r")).select("uid", "r.*")


def applied_once(events: DataFrame, seen: DataFrame) -> DataFrame:
    """Events whose uid hasn't been applied before, one for each uid (the first by id)."""
    fresh = events.join(seen.select("uid").distinct(), "uid", "left_anti")
    first = F.min_by(F.struct(*[c for c in fresh.columns if c != "uid"]), F.struct("event_id"))  # added up before it is shuffled
    return fresh.groupBy("uid").agg(first.alias("r")).select("uid", "r.*").select(*fresh.columns)


def remapped(rows: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """Replace foreign surrogate ids by new ones in each named column; unknown ids become null."""
    out = rows
    for c in columns:
        out = out.join(ids.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}")), c, "left")
        out = out.withColumn(c, F.col(f"new_{c}")).drop(f"new_{c}")
    return out.select(*rows.columns)


def fingerprint(rows: DataFrame, order: str, text: str) -> DataFrame:
    """One digest of all texts in order: each text is hashed where it lies, so that the one row that meets holds 64 characters
    for each, of a bounded set such as evaluation queries."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.sha2(F.col(text), 256).alias("h"))))
    return rows.agg(F.sha2(F.array_join(F.transform(each, lambda e: e["h"]), ""), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))
