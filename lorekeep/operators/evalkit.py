"""Retrieval evaluation: precision at k, reciprocal rank, paired wins, contrasts and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.scoring import wilson_bounds


def per_query(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """query, p_at_k (of as many as there are gold keys, at most k) and rr of results (query, key, rank) against gold
    (query, key); queries without a hit count 0."""
    hits = results.where(F.col("rank") <= k).join(gold, ["query", "key"]).groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")
    )
    asked = gold.groupBy("query").agg(F.countDistinct("key").alias("n_gold"))
    return asked.join(hits, "query", "left").select(
        "query",
        (F.coalesce("n", F.lit(0)) / F.least(F.lit(k), F.col("n_gold"))).alias("p_at_k"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("p_at_k").alias("p_at_k"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("n"))


def paired(base: DataFrame, other: DataFrame) -> DataFrame:
    """Queries that the other configuration wins, loses and ties by reciprocal rank."""
    both = base.select("query", F.col("rr").alias("x")).join(other.select("query", F.col("rr").alias("y")), "query")
    return both.agg(
        F.count_if(F.col("y") > F.col("x")).alias("win"),
        F.count_if(F.col("y") < F.col("x")).alias("loss"),
        F.count_if(F.col("y") == F.col("x")).alias("tie"),
    )


def contrast(rows: DataFrame, group: list[str], feature: Column, success: Column) -> DataFrame:
    """Success with and without a feature, and the lower bound of their difference."""
    out = rows.groupBy(*group).agg(
        F.count_if(feature).alias("n_with"),
        F.count_if(feature & success).alias("s_with"),
        F.count_if(~feature).alias("n_without"),
        F.count_if(~feature & success).alias("s_without"),
    )
    low = wilson_bounds(F.col("s_with"), F.col("n_with"))[0]
    high = wilson_bounds(F.col("s_without"), F.col("n_without"))[1]
    return out.withColumn("bound", low - high)


def percentile(rows: DataFrame, group: list[str], column: str, p: float) -> DataFrame:
    """The nearest-rank percentile of a column."""
    return rows.groupBy(*group).agg(F.expr(f"percentile_disc({p}) within group (order by {column})").alias("value"))


def measured(before: DataFrame, after: DataFrame, least: int = 30) -> DataFrame:
    """Wins, losses and ties of a change, and the difference of the mean reciprocal ranks; none with fewer than ``least`` queries."""
    both = before.select("query", F.col("rr").alias("x")).join(after.select("query", F.col("rr").alias("y")), "query")
    return both.agg(
        F.count_if(F.col("y") > F.col("x")).alias("win"),
        F.count_if(F.col("y") < F.col("x")).alias("loss"),
        F.count_if(F.col("y") == F.col("x")).alias("tie"),
        F.when(F.count(F.lit(1)) >= least, F.avg("y") - F.avg("x")).alias("mrr_delta"),
    )


def rubric(answers: DataFrame) -> DataFrame:
    """Shares of answers (answer, keywords, should_abstain) that hold all their keywords and don't abstain, and of those that
    should abstain and do."""
    from lorekeep.functions.text import abstains

    low = F.lower("answer")
    whole = F.forall("keywords", lambda k: F.contains(low, F.lower(k)))
    quiet = abstains(F.col("answer"))
    return answers.agg(
        F.round(F.avg(F.when(~F.col("should_abstain"), (whole & ~quiet).cast("int"))), 6).alias("pass_rate"),
        F.round(F.avg(F.when(F.col("should_abstain"), quiet.cast("int"))), 6).alias("abstain_rate"),
        F.count(F.lit(1)).alias("n"),
    )
