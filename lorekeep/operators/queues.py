"""Queues as tables: claims, partial promotion, bounded telemetry, and watermarks of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE_SECONDS, CAPACITY, BATCH, GRACE_HOURS = 600, 2048, 256, 48


def claimed(queue: DataFrame, now: Column, limit: int, stale_s: int = STALE_SECONDS) -> DataFrame:
    """The oldest ``limit`` open rows (id, done, claimed_at) that nobody holds, or whose claim is stale."""
    free = F.col("claimed_at").isNull() | (F.unix_micros("claimed_at") + F.lit(int(stale_s * 1e6)) < F.unix_micros(now))
    return queue.where(~F.col("done") & free).orderBy("id").limit(limit)


def partitioned(batch: DataFrame, consumed: DataFrame) -> DataFrame:
    """A batch (session, id, kind) with ``promote``: rows that were read (``consumed``: id) and rows without content are
    promoted, others wait for the next sweep; a session's end marker waits with them."""
    read = batch.join(consumed.select("id", F.lit(True).alias("read")), "id", "left")
    marker = F.col("kind") == "session_end_marker"
    own = (F.col("kind") == "memory_write") | F.coalesce("read", F.lit(False))
    waits = F.max(F.when(~marker, ~own)).over(Window.partitionBy("session"))
    return read.withColumn("promote", F.when(marker, ~F.coalesce(waits, F.lit(False))).otherwise(own)).drop("read")


def bounded(signals: DataFrame, per: list[str], order: str, capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """Signals with ``kept`` and ``batch``: of what arrives between two drains (``per``) a queue holds the first
    ``capacity``, which are written in batches, and drops the rest."""
    nth = F.row_number().over(Window.partitionBy(*per).orderBy(order))
    rows = signals.withColumn("nth", nth)
    kept = F.col("nth") <= capacity
    return rows.select(*signals.columns, kept.alias("kept"), F.when(kept, ((F.col("nth") - 1) / batch).cast("int")).alias("batch"))


def watermarks(episodes: DataFrame, current: Column, now: Column | None = None, grace_h: float = GRACE_HOURS) -> DataFrame:
    """key and the next start of its scan, from episodes (key, started, ended, resolved): just before the earliest
    unresolved one, else the latest end, and never back. With ``now`` an unresolved episode blocks for its grace only."""
    fresh = F.lit(True) if now is None else F.unix_micros("started") + F.lit(int(grace_h * 3600e6)) >= F.unix_micros(now)
    blocks = ~F.col("resolved") & fresh
    found = episodes.groupBy("key").agg(F.min(F.when(blocks, F.col("started"))).alias("first"), F.max("ended").alias("last"))
    new = F.coalesce(F.timestamp_micros(F.unix_micros("first") - 1000), "last")
    return found.select("key", F.greatest(new, current).alias("watermark"))


def session_watermarks(messages: DataFrame, now: Column, stale_days: int = 7) -> DataFrame:
    """session and its watermark, the newest message, for sessions that ended or were abandoned; live ones get none."""
    found = messages.groupBy("session").agg(F.max("at").alias("watermark"), F.max(F.col("ended").cast("int")).alias("ended"))
    idle = F.unix_micros("watermark") + F.lit(int(stale_days * 86400e6)) < F.unix_micros(now)
    return found.where((F.col("ended") == 1) | idle).select("session", "watermark")
