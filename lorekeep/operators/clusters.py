"""Greedy exclusive clusters, the result of one pass over all seeds, in rounds that decide many seeds at once.

In order of their ids, each seed that is not taken gathers, nearest first, those of its neighbours that are free and similar to all
members so far; a cluster that is large enough takes its members, a smaller one takes nothing. What a seed finds depends only on
smaller seeds that share a free neighbour with it. So in each round every row is claimed by the smallest open seed that may take
it, and a seed whose own row and free neighbours are all its own claims is decided at once, with the result that the pass in order
would give. No scope, cluster or row that many have as a neighbour is one task: claims are minima, added up before they are shuffled.
The rounds are the longest chain of seeds that wait for one another; what is left of at most ``FINISH`` rows is decided in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.vectors import nearest
from lorekeep.session import stored


#: Candidates of open seeds that one task decides in order.
FINISH = 100_000


def _met(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the rows: neither goes through the driver, however small a round leaves it."""
    return left.join(right.hint("merge"), on, how)


def _similar(candidates: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """seed, nth, member and ``fits``: which of the seed's earlier candidates (by nth) each candidate is similar to.

    A seed has as many candidates as it has neighbours, a fixed number, so their comparisons stay in its row."""
    v = rows.select(F.col("id").alias("member"), "v")
    group = _met(candidates, v, "member").groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("nth", "member", "v"))).alias("c"))

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for seed, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = np.array([x["v"] for x in c], dtype=np.float64)
                length = np.sqrt(np.einsum("ij,ij->i", m, m))
                sim = (m @ m.T) / np.outer(np.where(length > 0, length, 1), np.where(length > 0, length, 1))
                for i, x in enumerate(c):
                    out.append((seed, x["nth"], x["member"], [c[j]["nth"] for j in range(i) if sim[i, j] >= threshold - 1e-12]))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [batch.column(0).type, pa.int32(), batch.column(0).type, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["seed", "nth", "member", "fits"])

    kind = dict(candidates.dtypes)["seed"]
    return group.mapInArrow(work, f"seed {kind}, nth int, member {kind}, fits array<int>")


def _gathered(c: Column) -> Column:
    """The candidates (nth, member, fits), in order, that are similar to all that were gathered before."""
    taken = lambda out, x: F.forall(out, lambda m: F.array_contains(x["fits"], m["nth"]))
    return F.aggregate(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1), lambda out, x: F.when(taken(out, x), F.concat(out, F.array(x))).otherwise(out))


def _in_order(rows: DataFrame, least: int, successes: int) -> DataFrame:
    """seed, member of a bounded number of candidates (seed, nth, member, fits, won): the pass in order."""
    kind = dict(rows.dtypes)["seed"]

    def work(batches):
        import pyarrow as pa

        own: dict = {}
        for seed, nth, member, fits, won in sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))), key=lambda r: r[:2]):
            own.setdefault(seed, []).append((nth, member, set(fits), won))
        taken, out = set(), []
        for seed, c in own.items():
            members = []
            for nth, member, fits, won in c if seed not in taken else ():
                if member not in taken and all(m[0] in fits for m in members):
                    members.append((nth, member, won))
            if len(members) >= least and sum(m[2] for m in members) >= successes:
                taken.update(m[1] for m in members)
                out += [(seed, m[1]) for m in members]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], named) for k in (0, 1)], ["seed", "member"])

    from pyspark.sql.pandas.types import to_arrow_type

    named = to_arrow_type(rows.schema["seed"].dataType)
    return rows.select("seed", "nth", "member", "fits", "won").repartition(1).mapInArrow(work, f"seed {kind}, member {kind}")


def greedy_clusters(
    rows: DataFrame, threshold: float, *, neighbours: int = 8, least: int = 3, successes: int = 0, barred: DataFrame | None = None
) -> DataFrame:
    """scope, seed, member of the clusters of ``rows`` (id, scope, v; with ``successes`` also success).

    A seed's candidates are its ``neighbours`` nearest rows of its scope (rows without a scope are one scope). ``successes``: how many
    members must be successes. ``barred`` (id): seeds that found no cluster, but may be members of others."""
    known = rows.where("id is not null and v is not null")
    near = nearest(known.select(F.col("id").alias("doc"), "v", "scope"), known.select(F.col("id").alias("query"), F.col("v").alias("q"), "scope"), neighbours, key="scope")
    found = near.where(F.col("sim") >= threshold - 1e-9).select(F.col("query").alias("seed"), F.col("rank").cast("int").alias("nth"), F.col("doc").alias("member"))
    own = known.select(F.col("id").alias("seed"), F.lit(0).alias("nth"), F.col("id").alias("member"))
    flag = F.col("success").cast("int") if successes else F.lit(0)
    flags = known.select(F.col("id").alias("member"), flag.alias("won"))
    open_ = stored(_met(_similar(found.unionByName(own), known, threshold), flags, "member"))
    if barred is not None:
        open_ = stored(_met(open_, barred.select(F.col("id").alias("seed")), "seed", "left_anti"))
    sizes = open_.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("seed")
    open_, clusters = stored(_met(open_, sizes, "seed")), None  # a seed of fewer candidates finds nothing
    while (n_open := open_.count()) > FINISH:
        claims = open_.groupBy("member").agg(F.min("seed").alias("first"))
        met = _met(open_, claims, "member")
        ready = met.groupBy("seed").agg(
            F.min((F.col("first") == F.col("seed")).cast("int")).alias("mine"), F.sort_array(F.collect_list(F.struct("nth", "member", "fits", "won"))).alias("c")
        )
        ready = ready.where("mine = 1").select("seed", _gathered(F.col("c")).alias("m"))
        whole = (F.size("m") >= least) & (F.aggregate("m", F.lit(0), lambda s, x: s + x["won"]) >= successes)
        decided = stored(ready.select("seed", F.when(whole, F.transform("m", lambda x: x["member"])).alias("members")))
        part = decided.where("members is not null").select("seed", F.explode("members").alias("member"))
        clusters = part if clusters is None else clusters.unionByName(part)
        left = _met(_met(open_, decided.select("seed"), "seed", "left_anti"), part.select("member"), "member", "left_anti")
        left = _met(left, part.select(F.col("member").alias("seed")), "seed", "left_anti")  # a member is no seed any more
        # of candidates that are gone the others don't care; a seed that has too few left is decided
        enough = left.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("seed")
        open_ = stored(_met(left, enough, "seed"))
    if n_open:
        last = _in_order(open_, least, successes)
        clusters = last if clusters is None else clusters.unionByName(last)
    scopes = known.select(F.col("id").alias("seed"), "scope")
    none = scopes.select("scope", "seed", F.col("seed").alias("member")).where("false")
    return none if clusters is None else _met(clusters, scopes, "seed").select("scope", "seed", "member")
