"""Lifecycle of rows: expiry, forgetting, demotion, archives and purges. Each gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expire_due(rows: DataFrame, now: Column) -> DataFrame:
    """Rows past their time to live are closed as expired; running it again changes nothing."""
    due = (F.col("ttl_at") <= now) & F.col("valid_to").isNull() & (F.col("status") == "active")
    due = F.coalesce(due, F.lit(False))
    return rows.withColumns(
        {"status": F.when(due, "expired").otherwise(F.col("status")), "valid_to": F.when(due, now).otherwise(F.col("valid_to"))}
    )


def forget(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Soft forget: named rows become closed tombstones."""
    named = rows.join(ids.select("id", F.lit(True).alias("named")), "id", "left")
    hit = F.coalesce("named", F.lit(False))
    return named.withColumns(
        {
            "status": F.when(hit, "tombstone").otherwise(F.col("status")),
            "valid_to": F.when(hit, F.coalesce("valid_to", now)).otherwise(F.col("valid_to")),
        }
    ).select(*rows.columns)


def purge(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Hard forget: rows of the named ids leave every table, given with its id column."""
    return {
        name: df.join(ids.select(F.col("id").alias(column)), column, "left_anti") for name, (df, column) in tables.items()
    }


def cascade(closed: DataFrame, derived: DataFrame, column: str, now: Column, end: str) -> DataFrame:
    """Close open derived rows (facts, edges, snapshots) of closed memories."""
    hit = derived.join(closed.select(F.col("id").alias(column), F.lit(True).alias("hit")), column, "left")
    over = F.coalesce("hit", F.lit(False)) & F.col(end).isNull()
    return hit.withColumn(end, F.when(over, now).otherwise(F.col(end))).select(*derived.columns)


def demote(rows: DataFrame, eligible: Column, cap: int, score: str = "value") -> DataFrame:
    """Move the ``cap`` eligible rows of least value one tier down: active, summarized, tombstone."""
    order = F.col(score), F.col("id")
    chosen = rows.where(eligible & F.col("status").isin("active", "summarized")).orderBy(*order).limit(cap)
    named = rows.join(chosen.select("id", F.lit(True).alias("chosen")), "id", "left")
    down = F.when(F.col("status") == "active", "summarized").otherwise("tombstone")
    return named.withColumn("status", F.when(F.col("chosen"), down).otherwise(F.col("status"))).drop("chosen")


def archive(rows: DataFrame, path: str, at: str) -> None:
    """Append rows to a compressed JSON archive with a folder for each month."""
    rows.withColumn("yyyymm", F.date_format(at, "yyyyMM")).write.partitionBy("yyyymm").mode("append").json(path, compression="gzip")


def recover(archived: DataFrame, key: str, order: str) -> DataFrame:
    """The last archived version of each key."""
    row = F.struct(order, *[c for c in archived.columns if c not in (key, order)])
    return archived.groupBy(key).agg(F.max(row).alias("r")).select(key, "r.*")


def compacted(events: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Events that are unsynced or younger than ``days``."""
    return events.where(F.col("synced_at").isNull() | (F.col("ts") >= now - F.expr(f"interval {days} days")))


def resume_window(rows: DataFrame, cursor: int, size: int) -> DataFrame:
    """The next ``size`` rows by id after a rotating cursor; a short batch means that the next starts over."""
    return rows.where(F.col("id") > cursor).orderBy("id").limit(size)


def newest_first(rows: DataFrame, key: str, at: str) -> DataFrame:
    """``is_newest`` marks each key's newest row; older pending ones are demoted by it."""
    order = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("is_newest", F.row_number().over(order) == 1)
