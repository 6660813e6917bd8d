"""Learning over memories: merges, clusters, contradictions, contrasts and leg-weight fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.vectors import nearest

# Fixed word lists of the polarity test.
NEGATION = (
    "not", "no", "never", "none", "cannot", "can't", "don't", "doesn't", "won't", "isn't", "aren't", "wasn't", "weren't", "didn't",
    "shouldn't", "without", "stop", "stopped", "quit", "dislike", "dislikes", "hate", "hates", "avoid", "avoids", "refuse",
    "refuses", "anymore", "unlike",
)
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "that", "this", "these", "those", "with", "from", "into", "onto", "for",
    "was", "were", "is", "are", "be", "been", "being", "has", "have", "had", "does", "did", "will", "would", "should", "could",
    "very", "just", "about", "their", "there", "here", "when", "what", "which", "while", "because",
)
LEG_BAND = (0.5, 2.0)


def polarity_conflict(a: Column, b: Column) -> Column:
    """At least two shared words of substance, and exactly one side with a negation."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z']+"), F.lit(0)))
    odd = F.array(*[F.lit(w) for w in NEGATION])
    skip = F.array(*[F.lit(w) for w in (*NEGATION, *STOPWORDS)])
    shared = F.filter(F.array_except(F.array_intersect(words(a), words(b)), skip), lambda w: F.length(w) >= 4)
    return (F.size(shared) >= 2) & (F.arrays_overlap(words(a), odd) != F.arrays_overlap(words(b), odd))


def copied_words(question: Column, source: Column, share: float = 0.5) -> Column:
    """More than ``share`` of the question's long words stand in the source."""
    strip = lambda w: F.lower(F.regexp_replace(w, r"^[.,:;!?\"'()\[\]]+|[.,:;!?\"'()\[\]]+$", ""))
    long = lambda t: F.filter(F.array_distinct(F.transform(F.split(t, r"\s+"), strip)), lambda w: F.length(w) >= 7)
    n = F.size(long(question))
    return F.when(n == 0, F.lit(False)).otherwise(F.size(F.array_intersect(long(question), long(source))) / n > share)


def merge_candidates(new: DataFrame, old: DataFrame, threshold: float = 0.95) -> DataFrame:
    """The nearest old row of each new row within its scope, where its cosine reaches the threshold.

    Both have (id, scope, v); rows meet only in their scope (nulls are one scope)."""
    found = nearest(
        old.select(F.col("id").alias("doc"), "v", "scope"), new.select(F.col("id").alias("query"), F.col("v").alias("q"), "scope"), 1, key="scope"
    )
    return found.where(F.col("sim") >= threshold).select(F.col("query").alias("new_id"), F.col("doc").alias("old_id"), "sim")


def contrast_partners(asked: DataFrame, pool: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Each asked row's most similar row of the opposite verdict within its scope: id, partner, sim."""
    side = lambda ok: F.concat_ws(" ", ok.cast("string"), F.col("scope").cast("string"))
    known = F.col("scope").isNotNull()
    found = nearest(
        pool.where(known).select(F.col("id").alias("doc"), "v", side(F.col("ok")).alias("side")),
        asked.where(known).select(F.col("id").alias("query"), F.col("v").alias("q"), side(~F.col("ok")).alias("side")),
        1,
        key="side",
    )
    return found.where(F.col("sim") >= threshold).select(F.col("query").alias("id"), F.col("doc").alias("partner"), "sim")


def fit_leg_weights(rows: DataFrame, legs: tuple[str, ...], *, rounds: int = 800, rate: float = 0.5, l2: float = 1e-3, least: int = 500) -> dict | None:
    """Weights of retrieval legs from credited injections (leg, rank, helpful 0/1): L2 logistic regression on
    leg and standardised rank by full-batch descent; exp(coefficient), scaled to mean 1, kept in a band.

    The rows are first counted by their distinct values, so the fit's size depends on ranks and legs only.
    None without enough rows, either class, or two legs."""
    import numpy as np

    table = rows.groupBy("leg", "rank", "helpful").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n = table["n"].to_numpy(float)
    y = table["helpful"].to_numpy(float)
    if n.sum() < least or n[y == 1].sum() < 10 or n[y == 0].sum() < 10 or table["leg"].nunique() < 2:
        return None
    rank = table["rank"].to_numpy(float)
    mean = np.average(rank, weights=n)
    spread = math.sqrt(np.average((rank - mean) ** 2, weights=n)) or 1.0
    x = np.column_stack([*[(table["leg"] == leg).to_numpy(float) for leg in legs], (rank - mean) / spread, np.ones(len(n))])
    w = np.zeros(x.shape[1])
    decay = np.append(np.full(len(w) - 1, l2), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        w -= rate * (x.T @ ((p - y) * n) / n.sum() + decay * w)
    raw = np.exp(w[: len(legs)])
    raw /= raw.mean()
    return {leg: float(min(LEG_BAND[1], max(LEG_BAND[0], v))) for leg, v in zip(legs, raw)}


#: Fixed kinds of a peer card's lines.
CARD_KINDS = ("IDENTITY:", "ATTRIBUTE:", "RELATIONSHIP:", "INSTRUCTION:")


def peer_card_lines(card: Column, limit: int = 40) -> Column:
    """The typed lines of a card, at most ``limit``; all its lines, if none is typed."""
    lines = F.filter(F.transform(F.split(card, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    typed = F.filter(lines, lambda x: x.rlike("^(" + "|".join(CARD_KINDS) + ")"))
    return F.slice(F.when(F.size(typed) > 0, typed).otherwise(lines), 1, limit)


def probes(memories: DataFrame) -> DataFrame:
    """Health probes of a store as (probe, failures)."""
    status = F.col("status")
    checks = {
        "tombstone_open": (status == "tombstone") & F.col("valid_to").isNull(),
        "superseded_open": (status == "summarized") & F.col("valid_to").isNull(),
        "quarantine_pinned": (status == "quarantined") & F.col("pinned"),
    }
    one = memories.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("probe"), F.col(n).alias("failures")) for n in checks]))
    return one.select(listed.alias("p")).select("p.*")


def surprising(rows: DataFrame, share: int = 10, cap: int = 5) -> DataFrame:
    """The ``cap`` most surprising of a scope's top tenth."""
    order = Window.partitionBy("scope").orderBy(F.desc("surprise"), "id")
    n = F.count(F.lit(1)).over(Window.partitionBy("scope"))
    ranked = rows.withColumn("nth", F.row_number().over(order)).withColumn("n", n)
    return ranked.where((F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("n") / share))) & (F.col("nth") <= cap)).drop("n")
