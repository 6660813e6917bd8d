"""Sessions: gaps, task episodes, turn pairing, budgets and the credit of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 7200
MAX_TURNS = 20
TERMINAL = ("verified", "failed", "blocked")


def task_runs(rows: DataFrame, *, gap_s: int = GAP_SECONDS, max_turns: int = MAX_TURNS) -> DataFrame:
    """``run`` (from 1 in each session) of every outcome row: a run ends after a gap, a terminal outcome or
    ``max_turns`` rows. The cap restarts with each other break, so it is a block number inside an island."""
    order = Window.partitionBy("session_id").orderBy("created_at", "turn_id")
    gap = F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(order)) > F.lit(gap_s * 1_000_000)
    breaks = F.coalesce(gap | F.lag("outcome").over(order).isin(*TERMINAL), F.lit(False))
    islands = rows.withColumn("island", F.sum(breaks.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("session_id", "island").orderBy("created_at", "turn_id")
    cut = islands.withColumn("block", F.floor((F.row_number().over(inside) - 1) / max_turns))
    first = F.coalesce(
        (F.lag("island").over(order) != F.col("island")) | (F.lag("block").over(order) != F.col("block")), F.lit(True)
    )
    return cut.withColumn("run", F.sum(first.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("island", "block")


def episodes(runs: DataFrame) -> DataFrame:
    """One row for each run: span, counts, costs, skills in order of first use, and the closing row's outcome."""
    used = F.array_sort(F.collect_list(F.struct("created_at", "turn_id", "skill")))
    return runs.groupBy("session_id", "run").agg(
        F.min("created_at").alias("started"),
        F.max("created_at").alias("ended"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sum("cost").alias("cost"),
        F.array_distinct(F.transform(used, lambda s: s["skill"])).alias("skills"),
        F.max_by("outcome", F.struct("created_at", "turn_id")).alias("outcome"),
        F.max_by("feedback", F.struct("created_at", "turn_id")).alias("feedback"),
    )


def closed_only(episodes: DataFrame) -> DataFrame:
    """Without each session's last run, unless its outcome ended it: that run may still go on."""
    last = F.max("run").over(Window.partitionBy("session_id"))
    rows = episodes.withColumn("last_run", last)
    return rows.where((F.col("run") < F.col("last_run")) | F.col("outcome").isin(*TERMINAL)).drop("last_run")


def transcript_windows(episodes: DataFrame, before_s: int = 3600) -> DataFrame:
    """``window_start``: an hour before the start, but not before the previous episode's end."""
    order = Window.partitionBy("session_id").orderBy("started", "run")
    early = F.col("started") - F.make_dt_interval(secs=F.lit(before_s))
    return episodes.withColumn("window_start", F.greatest(early, F.coalesce(F.lag("ended").over(order), early)))


def budget_prefix(rows: DataFrame, group: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group up to the first that overflows a running budget."""
    running = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(running)).where(F.col("used") <= budget)


def pair_turns(messages: DataFrame, key: str = "conv_id", at: str = "turn") -> DataFrame:
    """Consecutive user messages joined by a blank line, closed by the next assistant message that isn't
    blank; a trailing user message keeps an empty reply."""
    said = F.trim(F.coalesce("text", F.lit("")))
    order = Window.partitionBy(key).orderBy(at)
    closes = ((F.col("role") == "assistant") & (said != "")).cast("int")
    before = F.coalesce(F.sum(closes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = messages.withColumn("pair", before).where(F.col("role").isin("user", "assistant") & (said != ""))
    user = F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct(F.col(at), "text"))))
    pairs = rows.groupBy(key, "pair").agg(
        F.array_join(F.transform(user, lambda u: u["text"]), "\n\n").alias("user_text"),
        F.coalesce(F.max(F.when(F.col("role") == "assistant", F.col("text"))), F.lit("")).alias("assistant_text"),
    )
    return pairs.where(F.col("user_text") != "")


def abandoned(messages: DataFrame, now: Column, days: int = 7, key: str = "session_id", at: str = "created_at") -> DataFrame:
    """Sessions whose newest message is older than ``days``."""
    return messages.groupBy(key).agg(F.max(at).alias("newest")).where(F.col("newest") < now - F.expr(f"interval {days} days"))


def is_gold(runs: DataFrame, group: str, order: list[str], failed: Column, ok: Column) -> DataFrame:
    """Groups with a failure that at least two later successes follow."""
    running = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("failed_before", F.max(failed.cast("int")).over(running))
    later = F.sum((ok & (F.col("failed_before") == 1)).cast("int"))
    return marked.groupBy(group).agg((F.coalesce(later, F.lit(0)) >= 2).alias("gold"))
