"""Chains of rows that point at a parent: ancestors within a bound, and roots however far they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import stored

MAX_HOPS = 10


def ancestors(rows: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """id, hop, ancestor of rows (id, parent), up to ``hops`` steps; a walk ends before a row that it has been at."""
    up = rows.select(F.col("id").alias("ancestor"), F.col("parent").alias("next"))
    at = rows.where("parent is not null and parent <> id").select("id", F.lit(1).alias("hop"), F.col("parent").alias("ancestor"), F.array("id", "parent").alias("seen"))
    out = at
    for hop in range(2, hops + 1):
        more = at.join(up, "ancestor").where(F.col("next").isNotNull() & ~F.array_contains("seen", F.col("next")))
        at = more.select("id", F.lit(hop).alias("hop"), F.col("next").alias("ancestor"), F.concat("seen", F.array("next")).alias("seen"))
        out = out.unionByName(at)
    return out.select("id", "hop", "ancestor")


def roots(rows: DataFrame, rounds: int = 40) -> DataFrame:
    """id and root of rows (id, parent) by pointer doubling: 2**rounds steps are enough for any table. Rows on a cycle, or
    that lead into one, have no root."""
    at = rows.select("id", F.when(F.col("parent") == F.col("id"), F.lit(None)).otherwise(F.col("parent")).alias("up"))
    known = at.select(F.col("id").alias("known"))
    at = at.join(known, F.col("up") == F.col("known"), "left").select("id", F.col("known").alias("up"))  # parents that are no rows end a walk
    open_ = at.where("up is not null").select("id", "up")
    done = at.where("up is null").select("id", F.col("id").alias("root"))
    done, open_, left = stored(done), stored(open_), None
    for _ in range(rounds):
        met = open_.join(done.select(F.col("id").alias("up"), "root"), "up", "left")
        found = stored(met.where("root is not null").select("id", "root"))
        if found.isEmpty():
            break  # only cycles are left
        rest = met.where("root is null").select("id", "up")
        jump = rest.join(open_.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up"))
        done, open_ = stored(done.unionByName(found)), stored(jump)
        if open_.isEmpty():
            break
    return done
