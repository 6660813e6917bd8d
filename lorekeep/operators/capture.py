"""Capturing turns and editing memories: appends, guarded updates and small keyed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.scoring import trust_rank
from lorekeep.functions.text import content_hash, instruction_shaped, salience

TASK_CLIP, RESULT_CLIP = 4000, 8000


def captured_turns(pairs: DataFrame) -> DataFrame:
    """Episodes of (user_text, assistant_text) pairs; turns without any text are dropped."""
    said = F.trim(F.concat_ws("", "user_text", "assistant_text"))
    return pairs.where(said != "").withColumn("salience", salience(F.col("user_text"), F.col("assistant_text")))


def delegated(rows: DataFrame) -> DataFrame:
    """Delegations with clipped task and result."""
    return rows.withColumns({"task": F.substring("task", 1, TASK_CLIP), "result": F.substring("result", 1, RESULT_CLIP)})


def pre_compress(messages: DataFrame, key: str, at: str, last: int = 200, chars: int = 400_000) -> DataFrame:
    """The newest ``last`` messages of each session, as many of them as fit into ``chars`` from the newest on."""
    newest = Window.partitionBy(key).orderBy(F.desc(at))
    running = newest.rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= last)
    return rows.withColumn("used", F.sum(F.length("text")).over(running)).where(F.col("used") <= chars).drop("nth", "used")


def remembered(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New (content, scope_user) rows that the store lacks in their scope; instructions are quarantined."""
    have = existing.select(content_hash(F.col("content")).alias("have"), F.col("scope_user").alias("have_scope")).distinct()
    rows = new.withColumn("content_hash", content_hash(F.col("content"))).dropDuplicates(["content_hash", "scope_user"])
    same = (F.col("content_hash") == F.col("have")) & F.col("scope_user").eqNullSafe(F.col("have_scope"))
    fresh = rows.join(have, same, "left_anti")
    return fresh.withColumn("status", F.when(instruction_shaped(F.col("content")), "quarantined").otherwise("active"))


def stamped(rows: DataFrame, stamps: DataFrame, column: str) -> DataFrame:
    """Overwrite one column of the rows that ``stamps`` (id, value) names: outcomes, pins, counters."""
    named = rows.join(stamps.select("id", F.col("value").alias("new_value"), F.lit(True).alias("named")), "id", "left")
    return named.withColumn(column, F.when(F.col("named"), F.col("new_value")).otherwise(F.col(column))).select(*rows.columns)


def may_correct(actor_trust: str) -> Column:
    """Only unpinned rows of no higher trust than the actor's, pinned ones by owners only."""
    from pyspark.sql.functions import lit

    return (trust_rank(F.col("trust_tier")) >= trust_rank(lit(actor_trust))) & (~F.col("pinned") | F.lit(actor_trust == "owner"))


def edited_tags(rows: DataFrame, rename: dict[str, str], remove: list[str]) -> DataFrame:
    """Rename and remove tags; each tag stands once, in order of first use."""
    tags = F.filter("tags", lambda t: ~t.isin(*remove)) if remove else F.col("tags")
    for old, new in rename.items():
        tags = _renamed(tags, old, new)
    return rows.withColumn("tags", F.array_distinct(tags))


def _renamed(tags: Column, old: str, new: str) -> Column:
    return F.transform(tags, lambda t: F.when(t == old, F.lit(new)).otherwise(t))


def upserted(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of the same keys; all others stay."""
    return rows.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merged_identities(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(platform, user, principal, is_owner): a known pair keeps its principal unless an owner says otherwise."""
    both = known.withColumn("rank", F.lit(1)).unionByName(seen.withColumn("rank", F.when(F.col("is_owner"), 0).otherwise(2)))
    best = both.groupBy("platform", "user").agg(F.min(F.struct("rank", "principal", "is_owner")).alias("r"))
    return best.select("platform", "user", "r.principal", "r.is_owner")


def decided(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Review decisions on quarantined rows: approved ones are active, rejected ones tombstones."""
    named = rows.join(decisions.select("id", "approve"), "id", "left")
    waits = (F.col("status") == "quarantined") & F.col("approve").isNotNull()
    status = F.when(waits, F.when(F.col("approve"), "active").otherwise("tombstone")).otherwise(F.col("status"))
    return named.withColumn("status", status).drop("approve")
