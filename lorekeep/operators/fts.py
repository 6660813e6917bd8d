"""Keyword retrieval: postings, BM25 over weighted fields, and a substring fallback.

Texts are split once into token arrays; of these only tokens that some query asks for leave their row, so
what is shuffled grows with the matches and not with the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens

K1, B = 1.2, 0.75
#: Up to so many distinct terms of queries are looked for inside the token arrays; more meet the tokens in a join.
MAX_TERMS = 10_000


def field_tokens(docs: DataFrame, id_col: str, fields: dict[str, float], *kept: str) -> DataFrame:
    """doc, the tokens of each field, and dl, the number of tokens weighted by field; and the columns ``kept``."""
    split = docs.select(F.col(id_col).alias("doc"), *kept, *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"in_{f}") for f in fields])
    length = sum((F.size(f"in_{f}") * F.lit(float(w)) for f, w in fields.items()), F.lit(0.0))
    return split.withColumn("dl", length)


def term_weights(fields: dict[str, float], wanted: list[str] | None = None) -> Column:
    """Term and field weight of every token, or of the wanted ones, of ``field_tokens``."""
    def of(field: str, weight: float) -> Column:
        own = F.col(f"in_{field}")
        own = own if wanted is None else F.filter(own, lambda t: t.isin(wanted))
        return F.transform(own, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    return F.concat(*[of(f, w) for f, w in fields.items()])


def postings(docs: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """doc, term, tf (weighted over the fields) and dl (weighted length) of every term of every document."""
    each = field_tokens(docs, id_col, fields).select("doc", "dl", F.explode(term_weights(fields)).alias("t"))
    return each.groupBy("doc", "dl", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query, term: the distinct tokens of each query."""
    return queries.select(F.col(id_col).alias("query"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str, fields: dict[str, float]) -> DataFrame:
    """query, doc, score by the published BM25 formula (k1 1.2, b 0.75) of all documents that share a term.

    ``queries`` has (query, term). Only terms of a query survive, before tf is aggregated by document; the
    document frequency is a count over the same few rows."""
    split = field_tokens(docs, id_col, fields)
    wanted = queries.select("term").distinct()
    named = [r.term for r in wanted.limit(MAX_TERMS + 1).collect()]
    few = len(named) <= MAX_TERMS
    each = split.select("doc", "dl", F.explode(term_weights(fields, named if few else None)).alias("t")).select("doc", "dl", "t.term", "t.w")
    each = each if few else each.join(wanted, "term")
    own = each.groupBy("doc", "dl", "term").agg(F.sum("w").alias("tf"))
    frequency = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(split.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("mean_dl")))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + (F.lit(1 - B) + F.col("dl") / F.col("mean_dl") * B) * K1)
    scored = own.join(frequency, "term").join(stats).withColumn("gain", idf * gain)
    return scored.join(queries, "term").groupBy("query", "doc").agg(F.sum("gain").alias("score"))


def substring_match(docs: DataFrame, query_tokens: list[str], *, id_col: str, text_col: str) -> DataFrame:
    """The fallback leg: documents that contain any token, scored by the share of tokens they contain."""
    low = F.lower(text_col)
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in query_tokens), F.lit(0))
    return docs.select(F.col(id_col).alias("doc"), (hits / F.lit(len(query_tokens))).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int, *, by: str = "query", score: str = "score", tie: str = "doc") -> DataFrame:
    """The k best rows of each query with ``rank`` from 1; equal scores go to the smaller id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
