"""Late interaction: each query token's best match among a candidate's tokens, summed, over the few candidates of a search.

The encoder is a callable of the caller's that gives a vector for each token. It is made once in each task, from a factory that
travels with the plan, so a model is loaded where it runs. Candidates are compared by one matrix product each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], "object"]
TOP, FLOOR = 32, 0.2


def hash_encoder(dim: int = 8) -> Callable[[], Encoder]:
    """The encoder of a store without a model: the first ``dim`` bytes of a token's SHA-256, each less 128."""

    def make() -> Encoder:
        import hashlib

        import numpy as np

        return lambda tokens: np.array([list(hashlib.sha256(t.encode()).digest()[:dim]) for t in tokens], dtype=np.float64).reshape(len(tokens), dim) - 128

    return make


def max_sims(pairs: DataFrame, encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """query, key, fresh: the late interaction of each row of ``pairs`` (query, key, asked: tokens, said: tokens); 0 without tokens on either side."""
    make = encoder or hash_encoder()
    kinds = dict(pairs.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = make(), {}
        for batch in batches:
            out = []
            for asked, said in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                asked, said = asked or [], sorted(set(said or []))
                if asked and said:
                    if tuple(asked) not in known:  # a query has many candidates
                        known = {tuple(asked): encode(asked)}
                    out.append(float((known[tuple(asked)] @ encode(said).T).max(axis=1).sum()))
                else:
                    out.append(0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.float64())], ["query", "key", "fresh"])

    return pairs.select("query", "key", "asked", "said").mapInArrow(work, f"query {kinds['query']}, key {kinds['key']}, fresh double")


def reranked(rows: DataFrame, tokens: DataFrame, asked: DataFrame, top: int = TOP, encoder: Callable[[], Encoder] | None = None) -> DataFrame:
    """``rows`` (query, key, score, ...) with the ``top`` best of each query scored anew and spread over [``FLOOR``, 1], the rest below it.

    ``tokens`` has (key, said), ``asked`` (query, asked). A query with fewer than two candidates, or whose candidates the encoder
    does not tell apart, keeps its scores."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    r = rows.withColumn("nth", F.row_number().over(order))
    best = r.where(F.col("nth") <= top).select("query", "key").join(tokens, "key").join(asked, "query")
    r = r.join(max_sims(best, encoder), ["query", "key"], "left")
    own = Window.partitionBy("query")
    low, high, n = F.min("fresh").over(own), F.max("fresh").over(own), F.count("fresh").over(own)
    band = F.lit(FLOOR) + (1 - FLOOR) * (F.col("fresh") - low) / (high - low)
    same = (n < 2) | (high - low < 1e-12)
    new = F.when(same, F.col("score")).when(F.col("fresh").isNotNull(), band).otherwise(F.col("score") * (FLOOR * 0.5))
    return r.withColumn("score", new).drop("nth", "fresh")
