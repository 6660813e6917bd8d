"""Fusing ranked legs: reciprocal ranks, bands, caps, reranking and diversification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
BAND_FLOOR = 0.2
EPISODE_FACTOR = 0.6
LEG_ORDER = ("fts", "vec", "graph", "facts")


def ranked(leg: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """query, key, leg, rank from a leg's (query, key, score)."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    out = leg.select("query", "key", F.lit(name).alias("leg"), F.row_number().over(order).alias("rank"))
    return out.where(F.col("rank") <= limit) if limit else out


def rrf(legs: list[DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """query, key, score = sum of weight / (k + rank), and ``via``: the legs in fixed order.

    Legs of weight 0 are skipped; a key's ranks meet in one aggregation."""
    weights = weights or {}
    every = reduce(DataFrame.unionByName, legs)
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("leg") == name, F.lit(float(w))).otherwise(weight)
    seen = F.collect_set("leg")
    via = F.array_join(F.filter(F.array(*[F.lit(n) for n in LEG_ORDER]), lambda n: F.array_contains(F.col("seen"), n)), "+")
    fused = every.withColumn("w", weight).where("w > 0").groupBy("query", "key").agg(
        F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))).alias("score"), seen.alias("seen")
    )
    return fused.select("query", "key", "score", via.alias("via"))


def banded(rows: DataFrame, score: str = "score", floor: float = BAND_FLOOR) -> DataFrame:
    """``score`` spread over [floor, 1] within each query; all 1 where the scores don't differ."""
    own = Window.partitionBy("query")
    low, high = F.min(score).over(own), F.max(score).over(own)
    spread = F.lit(floor) + (F.col(score) - low) / (high - low) * (1 - floor)
    return rows.withColumn(score, F.when(high - low < 1e-12, F.lit(1.0)).otherwise(spread))


def capped(rows: DataFrame, kind: str, cap: int, score: str = "score", tie: str = "key") -> DataFrame:
    """At most ``cap`` rows of each kind in a query, the best ones."""
    order = Window.partitionBy("query", kind).orderBy(F.desc(score), tie)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= cap).drop("nth")


def reserve_slots(rows: DataFrame, limit: int, linked: Column) -> DataFrame:
    """The ``limit`` best rows of each query; if no linked row is among them, the best max(1, limit // 4)
    linked rows replace the weakest others."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    own = Window.partitionBy("query")
    of_kind = Window.partitionBy("query", "linked").orderBy(F.desc("score"), "key")
    r = rows.withColumn("linked", linked).withColumn("rank", F.row_number().over(order)).withColumn("nth", F.row_number().over(of_kind))
    r = r.withColumn("has", F.max((F.col("linked") & (F.col("rank") <= limit)).cast("int")).over(own))
    r = r.withColumn("n_linked", F.least(F.sum(F.col("linked").cast("int")).over(own), F.lit(max(1, limit // 4))))
    keep = F.when((F.col("has") == 1) | (F.col("n_linked") == 0), F.col("rank") <= limit).otherwise(
        F.when(F.col("linked"), F.col("nth") <= F.col("n_linked")).otherwise(F.col("nth") <= F.lit(limit) - F.col("n_linked"))
    )
    return r.where(keep).drop("rank", "nth", "has", "n_linked")


def max_sim(query_vectors: Column, doc_vectors: Column) -> Column:
    """Late interaction: each query vector's best dot product with a document vector, summed."""
    from lorekeep.operators.vectors import dot

    best = lambda q: F.aggregate(doc_vectors, F.lit(float("-inf")), lambda m, d: F.greatest(m, dot(q, d)))
    return F.aggregate(query_vectors, F.lit(0.0), lambda s, q: s + best(q))


def stub_rerank(query_tokens: Column, doc_tokens: Column) -> Column:
    """The number of shared tokens."""
    return F.size(F.array_intersect(query_tokens, doc_tokens)).cast("double")


def rerank(rows: DataFrame, score: Column, top: int = 32) -> DataFrame:
    """The ``top`` rows of each query by their new score, banded; the others keep a tenth of theirs."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    r = rows.withColumn("nth", F.row_number().over(order)).withColumn("fresh", F.when(F.col("nth") <= top, score))
    own = Window.partitionBy("query")
    low, high = F.min("fresh").over(own), F.max("fresh").over(own)
    band = F.when(high - low < 1e-12, F.lit(1.0)).otherwise(F.lit(BAND_FLOOR) + (F.col("fresh") - low) / (high - low) * (1 - BAND_FLOOR))
    few = F.max("nth").over(own) < 2
    new = F.when(few, F.col("score")).when(F.col("fresh").isNotNull(), band).otherwise(F.col("score") * (BAND_FLOOR * 0.5))
    return r.withColumn("score", new).drop("nth", "fresh")


def mmr(hits: DataFrame, k: int, lambda_: float = 0.7) -> DataFrame:
    """query, key, position: greedy maximal marginal relevance over word overlap, for each query's hits.

    ``hits`` has (query, key, score, words) and holds the few hits of a search. The choice is sequential,
    so each query is one Arrow group; queries run in parallel. Fewer than three hits keep their order, and
    hits that are not picked follow in theirs."""

    def pick(group):
        import pandas as pd

        left = group.sort_values(["score", "key"], ascending=[False, True])
        words = {i: set(w) for i, w in left["words"].items()}
        waiting, out = list(left.index), []
        while waiting and len(out) < k and len(left) >= 3:
            def gain(i):
                alike = max((len(words[i] & words[j]) / max(1, len(words[i] | words[j])) for j in out), default=0.0)
                return lambda_ * left["score"][i] - (1 - lambda_) * alike

            best = max(waiting, key=gain)
            out.append(best)
            waiting.remove(best)
        order = out + waiting
        return pd.DataFrame({"query": left["query"].loc[order], "key": left["key"].loc[order], "position": range(1, len(order) + 1)})

    kinds = dict(hits.dtypes)
    return hits.groupBy("query").applyInPandas(pick, f"query {kinds['query']}, key {kinds['key']}, position long")
