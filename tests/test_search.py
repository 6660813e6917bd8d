"""The stored indexes: postings after changes, substrings, neighbours, graphs and clusters, against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import fts, grams, inverted
from lorekeep.operators.inverted import InvertedIndex


def brute_bm25(docs: dict, queries: dict, k: int) -> dict:
    """The best documents of each query; a document is its fields' texts with their weights."""
    bags = {}
    for d, fields in docs.items():
        bag = Counter()
        for t, w in fields:
            for token in re.findall(r"[^\W_]+", (t or "").lower()):
                bag[token] += w
        bags[d] = bag
    length = {d: sum(b.values()) for d, b in bags.items()}
    mean = sum(length.values()) / max(1, len(docs))
    out = {}
    for q, terms in queries.items():
        scores = Counter()
        for t in terms:
            df = sum(t in b for b in bags.values())
            for d, b in bags.items():
                if t in b:
                    scores[d] += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * length[d] / mean))
        out[q] = [(d, round(s, 6)) for d, s in sorted(((d, s) for d, s in scores.items()), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
    return out


def test_index_follows_its_changes(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "über", "e1"]
    text = lambda: " ".join(rng.choice(words, rng.integers(0, 9)))
    docs = {int(i): [(text(), 1.0), (text(), 3.0)] for i in rng.choice(9000, 60, replace=False) - 100}
    frame = lambda rows: spark.createDataFrame([(d, f[0][0], f[1][0]) for d, f in rows.items()], "doc long, a string, b string")
    index = InvertedIndex(spark, str(tmp_path / "ix"), "doc", {"a": 1.0, "b": 3.0}, width=64, folders=4)
    assert index.search(spark.createDataFrame([("q", "alpha")], "query string, term string"), 3).count() == 0
    index.create(frame(docs))
    queries = {"p": ["alpha", "über"], "q": ["e1", "none"], "r": ["beta", "gamma", "delta"], "s": ["none"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query string, term string")

    def check():
        found = {q: [] for q in queries}
        for r in sorted(index.search(asked, 7).collect(), key=lambda r: (r.query, r["rank"])):
            found[r.query].append((r.doc, r.score))
        assert found == brute_bm25(docs, queries, 7)
        assert index.statistics()[0] == len(docs)
        assert index.drift(frame(docs)).count() == 0

    check()
    new = {d: [(text(), 1.0), (None, 3.0)] for d in [*list(docs)[:20], 10_001, 10_002, -5000]}
    for _ in range(2):  # a batch that is sent again changes nothing
        index.upsert(frame(new), 1)
    docs |= new
    check()
    gone = list(docs)[5:15]
    index.delete(spark.createDataFrame([(d,) for d in [*gone, 77_777]], "doc long"), 2)
    docs = {d: f for d, f in docs.items() if d not in gone}
    check()
    again = {gone[0]: [("alpha alpha", 1.0), ("beta", 3.0)]}
    index.upsert(frame(again), 3)
    docs |= again
    check()
    index.compact(4)
    check()
    assert len(index.totals()) == 1
    kept = list(docs)[::3]
    found = index.search(asked, 500, among=spark.createDataFrame([(d,) for d in kept], "doc long")).collect()
    every = index.search(asked, 500).collect()
    assert sorted((r.query, r.doc, r.score) for r in found) == sorted((r.query, r.doc, r.score) for r in every if r.doc in kept)
    odd = frame({1: docs[list(docs)[0]]}).withColumn("a", F.lit("alpha only"))
    assert {r.drift for r in index.drift(odd).collect()} <= {"missing", "left", "stale"} and index.drift(odd).count() >= len(docs)


def test_search_in_several_passes_and_slices_is_the_same(spark, tmp_path, monkeypatch):
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(200)] + [(None, "w1"), (3, "w9 w9")]
    index = InvertedIndex(spark, str(tmp_path / "ix"), "doc", {"t": 1.0}, width=32).create(spark.createDataFrame(rows, "doc long, t string"))
    asked = spark.createDataFrame([(q, f"w{t}") for q in range(30) for t in (q % 10, q % 4)], "query long, term string")
    once = sorted(map(tuple, index.search(asked, 5).collect()))
    monkeypatch.setattr(inverted, "MAX_PAIRS", 9)
    monkeypatch.setattr(inverted, "TOGETHER", 2)
    assert sorted(map(tuple, index.search(asked, 5).collect())) == once


def test_index_reads_only_folders_and_rows_of_its_terms(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "ix"), "doc", {"t": 1.0}).create(spark.createDataFrame([(i, f"w{i}") for i in range(300)], "doc long, t string"))
    plan = index._standing(index.totals(), lambda r: r.where(F.col("folder").isin([3]) & F.col("term").isin(["w1"])))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(term,w1)" in plan


@pytest.mark.parametrize("granule", [32, 3])
def test_substrings_equal_contains(spark, tmp_path, monkeypatch, granule):
    monkeypatch.setattr(grams, "GRANULE", granule)
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("abcÄß%_ "), rng.integers(0, 30)))) for i in range(120)] + [(200, None), (None, "abc"), (201, "")]
    df = spark.createDataFrame(rows, "doc long, text string")
    index = grams.GramIndex(spark, str(tmp_path / "g")).create(df)
    strings = ["a", "ab", "abc", "bca", "c%_", "äß", "zzz", " ab", "%", ""]
    found = {(r.string, r.doc) for r in index.find(df, spark.createDataFrame([(s,) for s in strings], "string string")).collect()}
    assert found == {(s, d) for s in strings if s for d, t in rows if d is not None and t and s in t.lower()}
    asked = spark.createDataFrame([(1, s) for s in strings[:5]] + [(2, "abc")], "query long, term string")
    got = {(r.query, r.doc) for r in grams.held(df.where("doc is not null"), asked).collect()}
    assert got == {(q, d) for q, terms in ((1, strings[:5]), (2, ["abc"])) for d, t in rows if d is not None and t and any(s in t.lower() for s in terms)}
    scores = {(r.query, r.doc): r.score for r in grams.matches(index, df, asked).collect()}
    assert scores == {(q, d): sum(s in t.lower() for s in terms) / len(terms) for q, terms in ((1, strings[:5]), (2, ["abc"])) for d, t in rows if d is not None and t and any(s in t.lower() for s in terms)}


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_pruned_neighbours_equal_brute_force(spark, tmp_path, spread):
    from lorekeep.operators.ann import Int8Index

    rng = np.random.default_rng(8)
    heads = rng.normal(0, 0.5, (8, 12))
    v = np.clip(heads[rng.integers(0, 8, 400)] + rng.normal(0, 0.5 * spread, (400, 12)), -1.2, 1.2)
    v[50:60] = v[49]  # ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, []), (902, [float("nan")] * 12), (903, [0.1] * 3), (904, [None] * 12)]
    df = spark.createDataFrame(rows, "doc long, v array<double>")
    index = Int8Index(spark, str(tmp_path / "ann"), centres=9, block=16).create(df)
    asked = df.where("doc % 20 = 0 or doc > 890").select(F.col("doc").alias("query"), F.col("v").alias("q"))
    b = np.clip(np.rint(v * 127), -127, 127).astype(int)
    want = {}
    for q in range(0, 400, 20):
        dist = ((b - b[q]) ** 2).sum(axis=1)
        best = sorted((int(d), i) for i, d in enumerate(dist) if i != q)[:7]
        want |= {(q, n): (i, d) for n, (d, i) in enumerate(best, 1)}
    assert {(r.query, r["rank"]): (r.doc, r.dist) for r in index.nearest(asked, 7).collect()} == want
    share = index.share_read(asked, 7).first()
    assert share.pairs == 20 * 400 and 0 < share.read <= share.pairs
    if spread < 0.1:
        assert share.read < 0.5 * share.pairs
    assert Int8Index(spark, str(tmp_path / "none")).create(df.where("false")).nearest(asked, 3).count() == 0


def test_neighbours_meet_in_tiles_of_bounded_size(spark, tmp_path, monkeypatch):
    from lorekeep.operators import ann

    for name, n in {"VALUES": 12 * 40, "GROUP": 7, "CHUNK": 5, "SLICE": 3, "STEP": 50}.items():
        monkeypatch.setattr(ann, name, n)
    rng = np.random.default_rng(11)
    v = np.clip(rng.normal(0, 0.4, (300, 12)), -1.2, 1.2)
    v[100:220] = v[100]  # a cluster of more vectors than a tile has
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc long, v array<double>")
    index = ann.Int8Index(spark, str(tmp_path / "ann"), centres=9, block=16).create(df)
    clusters, tiles = index._tiles(12)
    sizes = {c: -(-n // own) for c, _, _, n, _, own in clusters}
    assert all(sum(sizes[c] for c in tile) <= 40 for tile in tiles) and any(own > 2 for *_, own in clusters)
    b = np.clip(np.rint(v * 127), -127, 127).astype(int)
    want = set()
    for q in range(0, 300, 10):
        dist = ((b - b[q]) ** 2).sum(axis=1)
        want |= {(q, n, i, d) for n, (d, i) in enumerate(sorted((int(d), i) for i, d in enumerate(dist) if i != q)[:6], 1)}
    near = index.nearest(df.where("doc % 10 = 0").select(F.col("doc").alias("query"), F.col("v").alias("q")), 6)
    assert {(r.query, r["rank"], r.doc, r.dist) for r in near.collect()} == want


def brute_clusters(rows, threshold, k, least, successes=0, barred=()):
    """One pass over the seeds in order of their ids; ``rows``: id, scope, vector, success."""
    cos = lambda a, b: float(a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)))
    v, won = {i: np.array(x) for i, _, x, _ in rows}, {i: w for i, _, _, w in rows}
    taken, out = set(), set()
    for i, scope, _, _ in sorted(rows, key=lambda r: r[0]):
        if i in taken or i in barred:
            continue
        near = sorted((-round(cos(v[i], v[j]), 12), j) for j, s, _, _ in rows if j != i and s == scope)[:k]
        members = [i]
        for c, j in near:
            if -c >= threshold - 1e-9 and j not in taken and all(cos(v[j], v[m]) >= threshold - 1e-12 for m in members):
                members.append(j)
        if len(members) >= least and sum(won[m] for m in members) >= successes:
            taken |= set(members)
            out |= {(scope, i, m) for m in members}
    return out


@pytest.mark.parametrize("threshold,finish", [(0.6, 0), (0.9, 0), (0.6, 300), (0.9, 100_000)])
@pytest.mark.parametrize("successes", [0, 2])
def test_greedy_clusters_equal_the_pass_in_order(spark, monkeypatch, threshold, finish, successes):
    from lorekeep.operators import clusters
    from lorekeep.operators.clusters import greedy_clusters

    monkeypatch.setattr(clusters, "FINISH", finish)
    rng = np.random.default_rng(11)
    heads = rng.normal(size=(6, 5))
    rows = [(int(i), ["a", "b", None][i % 3], (heads[rng.integers(0, 6)] + rng.normal(0, 0.4, 5)).tolist(), bool(rng.random() < 0.4)) for i in rng.permutation(150)]
    df = spark.createDataFrame(rows, "id long, scope string, v array<double>, success boolean")
    barred = list(range(0, 150, 11)) if successes else []
    bars = spark.createDataFrame([(i,) for i in barred], "id long") if barred else None
    got = greedy_clusters(df, threshold, neighbours=8, successes=successes, barred=bars).collect()
    want = brute_clusters(rows, threshold, 8, 3, successes, barred)
    assert want and {(r.scope, r.seed, r.member) for r in got} == want and len(got) == len(want)
    assert greedy_clusters(df.where("false"), threshold).count() == 0


def test_rounds_of_clusters_send_no_table_through_the_driver(spark, monkeypatch):
    from lorekeep.operators import clusters

    plans, real = [], clusters.stored
    monkeypatch.setattr(clusters, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    monkeypatch.setattr(clusters, "FINISH", 0)
    rng = np.random.default_rng(5)
    rows = [(i, "a", rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, scope string, v array<double>")
    last = clusters.greedy_clusters(df, 0.3)
    plans = [*plans[1:], last._jdf.queryExecution().executedPlan().toString()]  # the first one deals blocks, by a row for each scope
    assert len(plans) > 3 and last.count() and not any("Broadcast" in p for p in plans)


def brute_pagerank(mentions, edges, seeds, rounds=25, damping=0.5):
    out = {}
    for q in {m[0] for m in mentions} | {e[0] for e in edges}:
        w = Counter()
        by = {}
        for _, entity, memory in {m for m in mentions if m[0] == q}:
            by.setdefault(entity, []).append(memory)
        for group in by.values():
            for a in group:
                for b in group:
                    if a != b:
                        w[a, b] += 1.0
        for _, a, b, x in (e for e in edges if e[0] == q and e[1] != e[2]):
            w[a, b] += x
            w[b, a] += x
        total = Counter()
        for (a, _), x in w.items():
            total[a] += x
        first = {s for p, s in seeds if p == q}
        base = (first & set(total)) or set(total)
        start = {n: (1 / len(base) if n in base else 0.0) for n in total}
        share = dict(start)
        for _ in range(rounds):
            after = {n: (1 - damping) * start[n] for n in total}
            for (a, b), x in w.items():
                after[b] += damping * share[a] * x / total[a]
            share = after
        out |= {(q, n): x for n, x in share.items() if n not in first and x > 0}
    return out


@pytest.mark.parametrize("grouped", [200_000, 60, 0])
def test_pagerank_of_mentions_and_edges_equals_brute_force(spark, monkeypatch, grouped):
    from lorekeep.operators import graph

    monkeypatch.setattr(graph, "GROUPED", grouped)
    rng = np.random.default_rng(12)
    mentions = [(int(q), f"e{rng.integers(0, 9)}", int(rng.integers(0, 25))) for q in range(4) for _ in range(20 + 30 * q)] + [(9, "alone", 1)]
    edges = [(int(q), int(rng.integers(0, 30)), int(rng.integers(0, 30)), float(rng.random())) for q in range(5) for _ in range(6)]
    seeds = [(q, n) for q in range(3) for n in (1, 5, 77)] + [(3, 99), (4, int(edges[-1][1])), (9, 1)]
    got = graph.personal_pagerank(
        spark.createDataFrame(mentions, "query long, entity string, memory long"), spark.createDataFrame(edges, "query long, a long, b long, weight double"), spark.createDataFrame(seeds, "query long, node long")
    ).collect()
    want = brute_pagerank(mentions, edges, seeds)
    assert {(r.query, r.node) for r in got} == set(want) and all(abs(r.score - want[r.query, r.node]) < 1e-12 for r in got)


def test_index_is_dealt_to_more_tasks_as_it_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "SHARE", 16)
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 5}", None if i % 3 else "w1") for i in range(200)] + [(3, "w9 w9", "z"), (None, "w1", "w1")]
    df = spark.createDataFrame(rows, "doc long, a string, b string")
    index = InvertedIndex(spark, str(tmp_path / "ix"), "doc", {"a": 1.0, "b": 3.0}, width=8)
    dealt, tasks = index._one_each(df)
    assert tasks == 13 and dealt.rdd.getNumPartitions() == 13  # 201 rows, 16 a task
    index.create(df)
    docs = {i: [(a, 1.0), (b, 3.0)] for i, a, b in rows if i is not None}
    found = [(r.doc, r.score) for r in sorted(index.search(spark.createDataFrame([(1, "w1"), (1, "w9")], "query long, term string"), 20).collect(), key=lambda r: r["rank"])]
    assert found == brute_bm25(docs, {1: ["w1", "w9"]}, 20)[1]


def test_grams_are_one_row_for_each_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grams, "GRANULE", 2)
    rows = [(i, "Abcd" if i % 64 else "x\U0001f600yzabc") for i in range(256)] + [(300, "ab"), (301, "")]
    df = spark.createDataFrame(rows, "doc long, text string")
    index = grams.GramIndex(spark, str(tmp_path / "g")).create(df)
    own = {(r.gram, r.block): r.bits & (2**64 - 1) for r in index.read().collect()}
    assert own[("bcd", 0)] == 2**64 - 1 and own[("\U0001f600yz", 1)] == 1 | 1 << 32 and len(own) == 12
    strings = spark.createDataFrame([("\U0001f600yza",), ("bcd",), ("ab",)], "string string")
    assert {(r.string, r.granule) for r in index.candidates(strings.where("string <> 'bcd'")).collect()} == {("\U0001f600yza", g) for g in (0, 32, 64, 96)}
    found = {(r.string, r.doc) for r in index.find(df, strings).collect()}
    assert found == {(s, d) for s in ("\U0001f600yza", "bcd", "ab") for d, t in rows if s in t.lower()}


def test_documents_among_the_best_for_their_own_terms_are_those_of_the_search(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.geometric(0.15, n))
    rows = [(int(i), text(rng.integers(0, 30)), text(4) if i % 3 else None) for i in range(-40, 260)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(30)] + [(2000 + i, "w1 w2", None) for i in range(12)] + [(3000 + i, "all", None) for i in range(4)] + [(None, "w1", None)]
    df = spark.createDataFrame(rows, "doc long, a string, b string")
    index = InvertedIndex(spark, str(tmp_path / "ix"), "doc", {"a": 1.0, "b": 2.0}, width=32, folders=4)
    own = df.select(F.col("doc").alias("query"), F.explode(F.array_distinct(F.split(F.concat_ws(" ", F.substring("a", 1, 12), "b"), " "))).alias("term")).union(spark.createDataFrame([(9999, "w1"), (2, "none"), (5, None)], "query long, term string"))
    assert index.recalled(own, 3).count() == 0
    index.create(df)

    def check():
        want = sorted(r.query for r in index.search(own.where("query is not null"), 3).where("doc = query").collect())
        assert sorted(r.query for r in index.recalled(own, 3).collect()) == want
        return want

    found = check()
    assert 0 < len(found) < 300 and [q for q in found if 2000 <= q < 2012] == [q for q in found if 2000 <= q < 2003]
    monkeypatch.setattr(inverted, "MAX_OWN", 100)
    monkeypatch.setattr(inverted, "MAX_TERMS", 7)
    assert check() == found
    index.upsert(spark.createDataFrame([(7, "w1 w90 w91", "w90"), (4000, "w3", None)], "doc long, a string, b string"), 1)
    index.delete(spark.createDataFrame([(2000,), (3001,)], "doc long"), 2)
    assert check() != found


def test_self_retrieval_moves_postings_once_for_any_number_of_queries(spark, tmp_path, monkeypatch):
    from lorekeep.plans import registry, seams  # noqa: F401

    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.geometric(0.01, 60)), "en", "s") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: sorted(map(tuple, registry.queries()["v32_self_retrieval"](spark, str(tmp_path)).collect()))

    def shuffled():
        gateway, seen = spark.sparkContext._gateway, spark._jsc.sc().statusStore()
        stages = seen.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    once = run()  # with the building of the index
    sizes = [shuffled()]
    for bound in (10**6, 300):  # pairs of query and term a pass: one pass, or several
        for name in ("MAX_PAIRS", "MAX_OWN"):
            monkeypatch.setattr(inverted, name, bound, raising=False)
        assert run() == once
        sizes.append(shuffled())
    assert len(once) > 50 and sizes[2] - sizes[1] < 1.5 * (sizes[1] - sizes[0])


@pytest.mark.parametrize("bound", [100, 0])
def test_most_shared_compares_all_memories(spark, monkeypatch, bound):
    from lorekeep.operators import graph

    monkeypatch.setattr(graph, "MAX_NAMED", bound)
    monkeypatch.setattr(graph, "SHARE", 16)
    held = {m: {"common"} | {f"e{x}" for x in range(1, 9) if m % x == 0} for m in range(200)}
    rows = [(m, sorted(e)) for m, e in held.items()] + [(8, ["common", "e2", "more"]), (500, []), (501, None)]  # 8 stands twice
    held[8].add("more")
    seeds = [(1, 199), (1, 8), (2, 193)]
    named = {1: held[199] | held[8], 2: {"common"}}
    lists = spark.createDataFrame(rows, "memory long, entities array<string>")
    asked = spark.createDataFrame([(q, e) for q, es in named.items() for e in [*es, "common"]], "query long, entity string")
    got = graph.most_shared(lists, asked, spark.createDataFrame(seeds, "query long, memory long"), 70)
    want = []
    for q, es in named.items():
        shared = [(-len(es & e), m) for m, e in held.items() if es & e and (q, m) not in seeds]
        want += [(q, m, -n) for n, m in sorted(shared)[:70]]
    assert sorted((r.query, r.memory, r.shared) for r in got.collect()) == sorted(want)


def test_deep_recall_finds_neighbours_beyond_sixty_memories_of_an_entity(spark, tmp_path):
    import duckdb

    from lorekeep.plans import registry, seams  # noqa: F401

    rows = [(i, f"Overland plain {i}", "en", "s") for i in range(300)] + [(i, "Overland Harbour Mountain question asked", "en", "s") for i in range(1001, 1004)]
    rows += [(i, "Overland Harbour note" if i > 500 else "Harbour plain", "en", "s") for i in (*range(301, 500), 502, 703, 801, 902)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, "a question asked")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = registry.queries()["r34_deep_recall"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(f"select query, doc, content, neighbour from ({registry.oracle_sql()['r34_deep_recall']})").fetchall()
    assert sorted((r.query, r.doc, r.content, r.neighbour) for r in got) == sorted(want)
    assert {r.doc for r in got if r.neighbour} & {502, 703, 801, 902}  # more than sixty memories before them name all that they name but one
