"""Gates and writers of what a language model proposes; the model's answers are input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import edged, normalised
from lorekeep.operators.vectors import nearest

MAX_LESSON_WORDS, MAX_FIELD, NOVELTY, EDGE_CONFIDENCE = 140, 300, 0.92, 0.8
# Fixed pattern of operational narration in a lesson.
NARRATION = edged(
    r"(?iu)\b(?:created|made|pushed|amended|rebased|squashed)[\t\n\f\r ]+(?:the[\t\n\f\r ]+)?commit\b"
    r"|\b(?:branch|deployment|pull request|pr[\t\n\f\r ]*#?\d+|ci)\b[^\n]{0,100}\b(?:is|was|are|were|waiting|blocked|open|closed|passed|failed|green|red)\b"
)


def specific(proposals: DataFrame, members: DataFrame, entities: DataFrame) -> DataFrame:
    """The proposals (id, content, actionable, cites, entity) that say something: short, no narration, actionable, with a
    citation of a member (id, uid, content), and an entity that is known (``entities``: entity) or stands in a member.

    The result has the proposal with only its valid ``cites``."""
    words = F.size(F.filter(F.split(F.col("content"), r"[\t\n\f\r ]+"), lambda w: w != ""))
    shaped = proposals.withColumns({"content": F.trim("content"), "entity": F.trim(F.coalesce("entity", F.lit("")))})
    shaped = shaped.where((F.col("content") != "") & (words <= MAX_LESSON_WORDS) & ~F.col("content").rlike(NARRATION) & F.col("actionable") & (F.col("entity") != ""))
    own = members.select("id", "uid", F.lower("content").alias("said"))
    met = shaped.select("id", "entity", "cites").join(own, "id").groupBy("id").agg(
        F.collect_set(F.when(F.array_contains("cites", F.col("uid")), F.col("uid"))).alias("valid"),
        F.max(F.contains("said", F.lower("entity"))).alias("verbatim"),
    )
    known = entities.select(F.lower("entity").alias("canonical")).distinct().withColumn("known", F.lit(True))
    out = shaped.drop("cites").join(met, "id").join(known, F.lower("entity") == F.col("canonical"), "left")
    return out.where((F.size("valid") > 0) & (F.col("verbatim") | F.col("known"))).select("id", "content", "entity", F.array_sort("valid").alias("cites"))


def triples(proposed: DataFrame, notes: DataFrame, current: DataFrame) -> DataFrame:
    """Proposed facts (uid, subject, predicate, object) that are whole, not too long and about a known note (uid), with
    ``prior``: the object of a current fact that they would replace, or null."""
    clean = proposed.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("uid", "subject", "predicate", "object")])
    fields = ("subject", "predicate", "object")
    fine = clean.where(" and ".join(f"length({c}) between 1 and {MAX_FIELD}" for c in fields)).join(notes.select("uid").distinct(), "uid", "left_semi")
    old = current.groupBy("subject", "predicate").agg(F.collect_set("object").alias("objects"))
    other = F.array_min(F.filter("objects", lambda o: o != F.col("object")))
    return fine.join(old, ["subject", "predicate"], "left").select("uid", *fields, other.alias("prior"))


def fact_updates(said: DataFrame, current: DataFrame) -> DataFrame:
    """Items (id, subject, predicate, object) that give a current fact (fact_id, ...) another object, whatever the case of its names."""
    key = lambda c: F.lower(F.trim(c))
    old = current.select("fact_id", key("subject").alias("s"), key("predicate").alias("p"), F.col("object").alias("old_object"))
    new = said.select("id", "object", key("subject").alias("s"), key("predicate").alias("p"))
    met = new.join(old, ["s", "p"]).where(key("object") != key("old_object"))
    return met.select("id", "fact_id", "old_object", F.col("object").alias("new_object"))


def knowledge_updates(pairs: DataFrame) -> DataFrame:
    """Winner and loser of two facts of one subject and predicate with different objects: the later one, of equals the
    greater id, wins. ``pairs`` has (a, a_object, a_from, b, b_object, b_from)."""
    a_wins = F.struct("a_from", "a") > F.struct(F.col("b_from").alias("a_from"), F.col("b").alias("a"))
    pick = lambda x, y: F.when(a_wins, F.col(x)).otherwise(F.col(y))
    return pairs.where("a_object <> b_object").select(
        pick("a", "b").alias("winner"), pick("b", "a").alias("loser"), pick("a_object", "b_object").alias("object")
    )


def applied_verdicts(rows: DataFrame, verdicts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The memories (id, valid_to, ...) after verdicts (newer, older, contradicts, winner: a, b or else), and the edges of
    the conflicts. The loser is closed by the winner; without a winner both need a review."""
    real = verdicts.where("contradicts").withColumn("winner", F.lower(F.coalesce("winner", F.lit("neither"))))
    edges = real.select(F.col("newer").alias("src"), F.col("older").alias("dst"), F.lit("conflicts_with").alias("edge_type"), F.lit(EDGE_CONFIDENCE).alias("confidence")).distinct()
    a, b = F.col("winner") == "a", F.col("winner") == "b"
    closed = real.where(a | b).select(F.when(a, F.col("older")).otherwise(F.col("newer")).alias("id"), F.when(a, F.col("newer")).otherwise(F.col("older")).alias("by"))
    closed = closed.groupBy("id").agg(F.min("by").alias("by"))
    flagged = real.where(~(a | b)).select(F.explode(F.array("newer", "older")).alias("id")).distinct().withColumn("flag", F.lit(True))
    out = rows.join(closed, "id", "left").join(flagged, "id", "left")
    out = out.withColumns({"valid_to": F.when(F.col("by").isNotNull(), now).otherwise(F.col("valid_to")), "needs_review": F.coalesce("flag", F.lit(False))})
    return out.withColumnRenamed("by", "invalidated_by").drop("flag"), edges


def novel(items: DataFrame, existing: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """Items (id, title, v) with ``duplicate_of``: an existing item (id, title, v) that is as near as ``threshold``, else one
    of the same title, else null."""
    near = nearest(existing.select(F.col("id").alias("doc"), "v"), items.select(F.col("id").alias("query"), F.col("v").alias("q")), 1)
    near = near.where(F.col("sim") >= threshold).select(F.col("query").alias("id"), F.col("doc").alias("near"))
    title = existing.groupBy(normalised(F.col("title")).alias("t")).agg(F.min("id").alias("same"), F.count(F.lit(1)).alias("n"))
    out = items.withColumn("t", normalised(F.col("title"))).join(near, "id", "left").join(title, "t", "left")
    return out.select("id", F.coalesce("near", "same").alias("duplicate_of"))


def written_cases(episodes: DataFrame) -> DataFrame:
    """A case memory of each episode (id, summary, plan, verdict): its text, tags and half life; empty plans make none."""
    said = F.concat_ws("\n", F.trim("summary"), F.concat(F.lit("Plan: "), F.trim("plan")))
    rows = episodes.where(F.trim(F.coalesce("plan", F.lit(""))) != "")
    return rows.select("id", said.alias("content"), F.lit("case").alias("kind"), F.array(F.lit("case"), F.col("verdict")).alias("tags"), F.lit(240.0).alias("half_life_days"))
