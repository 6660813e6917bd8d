"""The retrieval log: what was injected waits for the turn it landed in.

A log has rows (session, at, id, kind, memory): ``inject`` rows, and ``turn`` rows of a session's user turns (``memory`` is null there; a turn
without words is of another kind and stamps nothing). An injection is stamped with the session's next turn by (at, id) within ``GRACE_HOURS``. An
injection that another one follows before that turn was never shown: it is stamped all the same, but no longer counts as injected.
Without a turn it is pending until its grace is over, then expired.

``stamped`` is the batch form. Rows of a session meet by windows of the grace's length, each row in its own and the one before, so a session of any
length is many tasks. ``lorekeep.streaming.injections`` gives the same rows over a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRACE_HOURS = 48


def stamped(log: DataFrame, now: Column, grace_hours: float = GRACE_HOURS) -> DataFrame:
    """session, id, memory, at, injected, turn (the id of the turn, or null) and state (stamped, pending, expired) of each injection."""
    grace = int(grace_hours * 3600e6)
    rows = log.where(F.col("kind").isin("inject", "turn") & F.col("session").isNotNull() & F.col("at").isNotNull() & F.col("id").isNotNull())
    rows = rows.select("session", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "at", "id", "kind", "memory")
    part = F.floor(F.col("us") / grace)
    both = rows.withColumn("part", F.explode(F.array(part, part - 1))).withColumn("own", part == F.col("part"))
    later = Window.partitionBy("session", "part").orderBy("us", "id").rowsBetween(1, Window.unboundedFollowing)
    of = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct("us", "id")), ignorenulls=True).over(later)
    met = both.withColumn("turn_", of("turn")).withColumn("next_", of("inject")).where((F.col("kind") == "inject") & F.col("own"))
    end = F.col("us") + grace
    turn = F.when(F.col("turn_.us") <= end, F.col("turn_"))
    known = F.least(end, F.unix_micros(now))  # what came later has no say any more
    replaced = F.col("next_").isNotNull() & (F.col("next_.us") <= known) & (turn.isNull() | (F.col("next_") < turn))
    state = F.when(turn.isNotNull(), "stamped").when(end < F.unix_micros(now), "expired").otherwise("pending")
    return met.select("session", "id", "memory", "at", (~replaced).alias("injected"), turn["id"].alias("turn"), state.alias("state"))


def recalls(log: DataFrame) -> DataFrame:
    """memory, its number of injections and the last of them."""
    return log.where("kind = 'inject' and memory is not null").groupBy("memory").agg(F.count(F.lit(1)).alias("recalls"), F.max("at").alias("last_recalled_at"))
