"""Graph operators: co-mention edges, neighbours, and personalised PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.session import stored

PER_ENTITY = 60
DAMPING, ROUNDS, SETTLED = 0.5, 25, 1e-15
#: Mentions and edges of a query that is ranked in one group.
GROUPED = 200_000
#: Pairs of memories that one task counts, about.
PAIRS = 1_000_000
#: Up to so many pairs of query and entity are broadcast; more are joined. Memories whose entities one task compares, about.
MAX_NAMED, SHARE = 100_000, 8192


def first_mentions(mentions: DataFrame, per_entity: int = PER_ENTITY) -> DataFrame:
    """entity, memory: each entity with its ``per_entity`` smallest memories, the bound of the retrieval leg."""
    order = Window.partitionBy("entity").orderBy("memory")
    rows = mentions.select("entity", "memory").distinct()
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_entity).drop("nth")


def co_mentions(mentions: DataFrame, per_entity: int = PER_ENTITY, by: Column | None = None) -> DataFrame:
    """a < b, weight: how many entities two memories share; each entity counts its ``per_entity`` smallest
    memories, as the retrieval leg does, which bounds its pairs. ``by`` keeps apart what it names ``query``.

    A memory goes once for each of its entities, with the list of the later ones, to one of as many tasks as there are ``PAIRS`` pairs."""
    spark = mentions.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mentions.count() // PAIRS))
    kept = stored(first_mentions(mentions.where("entity is not null").repartition(tasks, "entity"), per_entity))
    lists = kept.groupBy("entity").agg(F.sort_array(F.collect_list("memory")).alias("all"))
    n = lists.agg(F.sum(F.expr("size(all) * (size(all) - 1) div 2"))).first()[0] or 0
    later = lists.select("entity", "all", F.posexplode("all").alias("at", "a")).select("entity", "a", F.slice("all", F.col("at") + 2, F.size("all")).alias("after"))
    later = later.where(F.size("after") > 0).select("a", "after", *([] if by is None else ["entity"]))
    pairs = later.repartition(max(1, -(-n // PAIRS)), "a").withColumn("b", F.explode("after"))
    keys = ["a", "b"] if by is None else [by.alias("query"), "a", "b"]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def restricted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    one = edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    return one.join(nodes.select(F.col("node").alias("b")), "b", "left_semi")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes one edge away from a seed at either end, seeds left out."""
    s = seeds.select(F.col("node").alias("s"))
    there = edges.join(s, edges.a == s.s, "left_semi").select(F.col("b").alias("node"))
    back = edges.join(s, edges.b == s.s, "left_semi").select(F.col("a").alias("node"))
    return there.union(back).distinct().join(seeds, "node", "left_anti")


def co_mentioned(mentions: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Memories that share an entity with a seed, most shared first, seeds left out."""
    entities = mentions.join(seeds.select(F.col("node").alias("memory")), "memory", "left_semi").select("entity").distinct()
    found = mentions.join(entities, "entity").groupBy("memory").agg(F.countDistinct("entity").alias("shared"))
    rest = found.join(seeds.select(F.col("node").alias("memory")), "memory", "left_anti")
    return rest.orderBy(F.desc("shared"), "memory").limit(limit)


def most_shared(lists: DataFrame, named: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """query, memory, shared: for each query the ``limit`` memories that share most of its entities, ties to the smaller one, without its ``seeds``
    (query, memory). ``lists`` has memory and entities (an array), ``named`` the entities of each query (query, entity). All memories are compared:
    each meets the entities of the queries in the task that has it, so an entity of many memories is not one task."""
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lists.count() // SHARE))
    own = lists.repartition(tasks, "memory").groupBy("memory").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("entities"))
    named = stored(named.select("query", "entity").distinct())
    few = named.count() <= MAX_NAMED
    met = own.select("memory", F.explode("entities").alias("entity")).join(F.broadcast(named) if few else named, "entity")
    found = met.groupBy("query", "memory").agg(F.count(F.lit(1)).alias("shared"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), "memory"))
    return found.join(seeds, ["query", "memory"], "left_anti").withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def personal_pagerank(
    mentions: DataFrame, edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED
) -> DataFrame:
    """query, node, score of every query's graph at once, seeds left out: memories that share an entity (query, entity, memory; 1 for
    each) and undirected edges (query, a, b, weight; both ends are among the query's memories or seeds), from the seeds (query, node).

    Power iteration over tables: a round sends each memory's flow to its entities, the entities' sums back to their memories, less
    what came from the memory itself, and the flow along the edges to their other ends. So no pair of memories that share an entity is
    made, and no query, entity or memory is one task: sums are added up before they are shuffled. What flows is what a memory
    has by its links, so memories without any have no share; the start is even over the seeds that have links, or over all such memories
    where no seed has. It ends after ``rounds``, or once no share changes by more than ``settled``.

    Queries of at most ``GROUPED`` rows are ranked in a group each, with the same result; the rounds are for those that are larger."""
    m = mentions.select("query", "entity", "memory").dropna().distinct()
    e = edges.where("a <> b and a is not null and b is not null").select("query", "a", "b", F.col("weight").cast("double").alias("weight"))
    s = seeds.select("query", "node").dropna().distinct()
    m, e = stored(m), stored(e)
    sizes = m.select("query").unionByName(e.select("query")).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > GROUPED).select("query"))
    if large.isEmpty():
        return _grouped_pagerank(m, e, s, damping, rounds, settled)
    small = _grouped_pagerank(*(t.join(large, "query", "left_anti") for t in (m, e, s)), damping, rounds, settled)
    return small.unionByName(_spread_pagerank(*(t.join(large, "query", "left_semi") for t in (m, e, s)), damping, rounds, settled))


def _grouped_pagerank(m: DataFrame, e: DataFrame, s: DataFrame, damping: float, rounds: int, settled: float) -> DataFrame:
    kinds = dict(m.dtypes)
    codes = m.select("query", F.xxhash64("entity").alias("entity"), "memory")  # an entity stands for itself only
    every = codes.select("query", F.lit(0).alias("kind"), F.col("entity").alias("x"), F.col("memory").cast("long").alias("y"), F.lit(1.0).alias("w"))
    every = every.unionByName(e.select("query", F.lit(1).alias("kind"), F.col("a").cast("long").alias("x"), F.col("b").cast("long").alias("y"), F.col("weight").alias("w")))
    every = every.unionByName(s.select("query", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("x"), F.col("node").cast("long").alias("y"), F.lit(0.0).alias("w")))

    def rank(group):
        import numpy as np
        import pyarrow as pa

        kind, x, y, w = (group[c].to_numpy() for c in ("kind", "x", "y", "w"))
        query = group["query"][0].as_py()
        _, entity, size = np.unique(x[kind == 0], return_inverse=True, return_counts=True)
        met = size[entity] > 1
        entity, memory = entity[met], y[kind == 0][met]
        a, b, w = x[kind == 1], y[kind == 1], w[kind == 1]
        nodes = np.unique(np.concatenate([memory, a, b]))
        n, k = len(nodes), max(len(size), 1)
        memory, a, b = (np.searchsorted(nodes, v) for v in (memory, a, b))
        seed = np.isin(nodes, y[kind == 2])
        out = np.bincount(memory, (size[entity] - 1).astype(float), n) + np.bincount(a, w, n) + np.bincount(b, w, n)
        has = out > 0
        start = (seed & has).astype(float) if (seed & has).any() else has.astype(float)
        start /= max(start.sum(), 1)
        share = start.copy()
        for _ in range(rounds if n else 0):
            flow = np.where(has, share / np.where(has, out, 1), 0)
            own = np.bincount(entity, flow[memory], k)[entity] - flow[memory]
            given = np.bincount(memory, np.maximum(own, 0), n) + np.bincount(b, w * flow[a], n) + np.bincount(a, w * flow[b], n)
            after = (1 - damping) * start + damping * given
            moved = np.abs(after - share).max()
            share = after
            if moved <= settled:
                break
        kept = ~seed & has & (share > 0)
        return pa.table([pa.array([query] * int(kept.sum()), kind_of), pa.array(nodes[kept]), pa.array(share[kept])], ["query", "node", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = to_arrow_type(m.schema["query"].dataType)
    return every.groupBy("query").applyInArrow(rank, f"query {kinds['query']}, node long, score double")


def _spread_pagerank(m: DataFrame, e: DataFrame, s: DataFrame, damping: float, rounds: int, settled: float) -> DataFrame:
    m = m.select("query", "entity", F.col("memory").cast("long").alias("memory"))
    sizes = m.groupBy("query", "entity").agg((F.count(F.lit(1)) - 1).alias("others")).where("others > 0")
    m = stored(m.join(sizes, ["query", "entity"]))
    one = e.select("query", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").alias("w"))
    e = stored(one.unionByName(one.select("query", F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("query", "a", "b").agg(F.sum("w").alias("w")))
    by_mentions = m.groupBy("query", F.col("memory").alias("node")).agg(F.sum("others").cast("double").alias("out"), F.count(F.lit(1)).alias("k"))
    by_edges = e.groupBy("query", F.col("a").alias("node")).agg(F.sum("w").alias("out"), F.lit(0).cast("long").alias("k"))
    linked = by_mentions.unionByName(by_edges).groupBy("query", "node").agg(F.sum("out").alias("out"), F.sum("k").alias("k")).where("out > 0")
    first = s.select("query", F.col("node").cast("long").alias("node")).withColumn("is_seed", F.lit(True))
    nodes = linked.join(first, ["query", "node"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    counts = nodes.groupBy("query").agg(F.count_if("is_seed").alias("n_seeds"), F.count(F.lit(1)).alias("n"))
    start = F.when(F.col("n_seeds") == 0, 1.0 / F.col("n")).when(F.col("is_seed"), 1.0 / F.col("n_seeds")).otherwise(0.0)
    nodes = stored(nodes.join(counts, "query").select("query", "node", "out", "k", "is_seed", start.alias("start")))
    share = nodes.select("query", "node", "out", "k", "is_seed", "start", F.col("start").alias("share"))
    for _ in range(rounds):
        flow = share.where("share > 0").select("query", "node", (F.col("share") / F.col("out")).alias("flow"))
        said = m.join(flow.withColumnRenamed("node", "memory"), ["query", "memory"]).groupBy("query", "entity").agg(F.sum("flow").alias("s"))
        back = m.join(said, ["query", "entity"]).select("query", F.col("memory").alias("node"), F.col("s").alias("given"))
        along = e.join(flow.withColumnRenamed("node", "a"), ["query", "a"]).select("query", F.col("b").alias("node"), (F.col("w") * F.col("flow")).alias("given"))
        given = back.unionByName(along).groupBy("query", "node").agg(F.sum("given").alias("given"))
        own = F.col("k") * F.col("share") / F.col("out")
        after = (1 - damping) * F.col("start") + damping * F.greatest(F.coalesce("given", F.lit(0.0)) - own, F.lit(0.0))
        next_ = share.join(given, ["query", "node"], "left").withColumn("after", after).withColumn("moved", F.abs(F.col("after") - F.col("share")))
        next_ = stored(next_.select("query", "node", "out", "k", "is_seed", "start", F.col("after").alias("share"), "moved"))
        most = next_.agg(F.max("moved")).first()[0]
        share = next_.drop("moved")
        if most is None or most <= settled:
            break
    return share.where("not is_seed and share > 0").select("query", "node", F.col("share").alias("score"))


def mention_pagerank(mentions: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``personal_pagerank`` over all co-mentions of (query, entity, memory), none left out.

    No edge is made: a memory gets from each of its entities the sum of all its memories' flow but its own.
    A query is one Arrow group, of the size of its mentions; queries run in parallel."""

    def rank(key, rows, starts):
        import numpy as np
        import pandas as pd

        entity = pd.factorize(rows["entity"])[0]
        memory, nodes = pd.factorize(pd.concat([rows["memory"], starts["node"]]), sort=True)
        memory, first = memory[: len(rows)], memory[len(rows) :]
        start = np.zeros(len(nodes))
        start[first] = 1
        start /= max(start.sum(), 1)
        degree = np.bincount(entity) - 1
        out = np.bincount(memory, degree[entity], len(nodes))
        share = start.copy()
        for _ in range(rounds):
            flow = np.where(out > 0, share / np.where(out > 0, out, 1), 0)
            own = np.where(degree[entity] > 0, np.bincount(entity, flow[memory])[entity] - flow[memory], 0)
            share = (1 - damping) * start + damping * np.bincount(memory, np.maximum(own, 0), len(nodes))
        return pd.DataFrame({"query": key[0], "node": nodes, "score": share})[start == 0]

    kinds = dict(mentions.dtypes)
    rows = mentions.select("query", "entity", "memory").dropna().distinct()
    starts = seeds.select(F.col("query").alias("of"), F.col("node").alias("node"))
    ranked = rows.groupBy("query").cogroup(starts.groupBy("of")).applyInPandas(
        rank, f"query {kinds['query']}, node {kinds['memory']}, score double"
    )
    return ranked.where("score > 0")
