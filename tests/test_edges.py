"""Edge cases of the operators behind the queries: nulls, ties, cycles, lost keys and empty tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import chains, proposals, queues, recall, skills, sync, vectors
from lorekeep.operators.ranking import numbered


def test_nearest_equals_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "BATCH", 5)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), "xyn"[i % 3] if i % 3 < 2 else None) for i in range(60)]
    rows += [(100, None, "x"), (101, [1.0, None, 0.0, 0.0], "x"), (102, [1.0, 2.0], "x"), (103, [0.0] * 4, "x")]
    df = spark.createDataFrame(rows, "doc long, v array<double>, scope string")
    asked = df.withColumnsRenamed({"doc": "query", "v": "q"})
    got = {(r.query, r["rank"]): (r.doc, round(r.sim, 9)) for r in vectors.nearest(df, asked, 3, key="scope").collect()}
    fine = [(i, np.array(v), s) for i, v, s in rows if v and None not in v]
    cos = lambda a, b: a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1))
    want = {}
    for i, v, s in fine:
        best = sorted((-round(cos(v, w), 9), j) for j, w, t in fine if j != i and t == s and len(w) == len(v))[:3]
        want |= {(i, n): (j, -c) for n, (c, j) in enumerate(best, 1)}
    assert got == want
    assert vectors.nearest(df.where("false"), asked, 3).count() == 0 and vectors.nearest(df, asked.where("false"), 3).count() == 0
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(df.select("doc", "v"), 0.71).collect()}
    assert pairs == {(i, j) for (i, v, _), (j, w, _) in itertools.combinations(fine, 2) if len(v) == len(w) and cos(v, w) >= 0.71}


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 101 as x")
    got = {r.id: r.nth for r in numbered(df, F.desc("x"), "id").collect()}
    order = sorted(range(1000), key=lambda i: (-(i * 7919 % 101), i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert numbered(df.where("false"), "id").count() == 0


def test_roots_of_long_chains_cycles_and_lost_parents(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(900, 901), (901, 900), (902, 900), (903, 903), (904, 12345)]
    df = spark.createDataFrame(rows, "id long, parent long")
    got = {r.id: r.root for r in chains.roots(df).collect()}
    assert got == {i: 0 for i in range(300)} | {903: 903, 904: 904}
    walk = sorted((r.hop, r.ancestor) for r in chains.ancestors(df, 4).where("id = 900").collect())
    assert walk == [(1, 901)]  # the walk ends before a row that it has been at
    assert chains.roots(df.where("false")).count() == 0


def test_envelopes_open_only_with_their_key_and_namespace(spark):
    key, other = b"k" * 16, b"x" * 16
    df = spark.createDataFrame([("n", "secret"), ("n", None)], "namespace string, text string")
    rows = df.withColumn("blob", sync.sealed(F.col("text"), key, F.col("namespace")))
    out = rows.select(
        sync.opened(F.col("blob"), key, F.col("namespace")).alias("a"), sync.opened(F.col("blob"), other, F.col("namespace")).alias("b"), sync.opened(F.col("blob"), key, F.lit("m")).alias("c")
    ).collect()
    assert [tuple(r) for r in out] == [("secret", None, None), (None, None, None)]
    log = spark.createDataFrame([("n", 1, "a"), ("n", 2, "b"), ("m", 1, "c")], "namespace string, seq long, blob string")
    more = sync.appended(log, spark.createDataFrame([("n", "d"), ("o", "e")], "namespace string, blob string"), "blob")
    assert sorted((r.namespace, r.seq, r.blob) for r in more.collect())[1:] == [("n", 1, "a"), ("n", 2, "b"), ("n", 3, "d"), ("o", 1, "e")]
    assert [r.seq for r in sync.since(more, "n", 1, 1).collect()] == [2]
    long = spark.createDataFrame([("n", "z" * (sync.MAX_BLOB_CHARS + 1))], "namespace string, blob string")
    with pytest.raises(Exception, match="too long"):
        sync.appended(log, long, "blob").collect()


def test_all_pages_of_a_namespace_are_one_read(spark):
    rows = [("n" if i % 4 else "m", str(i), i) for i in range(200)] + [(None, "x", 1), (None, "y", 2)]
    new = spark.createDataFrame(rows, "namespace string, blob string, at long")
    log = sync.appended(spark.createDataFrame([("n", 3, "old")], "namespace string, seq long, blob string"), new, "at")
    got = {(r.namespace, r.blob): r.seq for r in log.collect()}
    of_n = sorted(i for i in range(200) if i % 4)
    assert {b: s for (n, b), s in got.items() if n == "n"} == {str(i): k + 4 for k, i in enumerate(of_n)} | {"old": 3}
    assert (got[None, "x"], got[None, "y"], got["m", "0"], got["m", "196"]) == (1, 2, 1, 50)
    pages = sync.paged(log, "n", 60)
    for page in range(3):
        assert {r.seq for r in pages.where(f"page = {page}").collect()} == {r.seq for r in sync.since(log, "n", 60 * page, 60).collect()}
    assert pages.count() == 151 and len(pages.inputFiles()) == len(set(pages.inputFiles()))


def test_cache_tiers_in_order(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [0.99, 0.05]]
    cached = spark.createDataFrame([(1, "Hello big world", v[0]), (2, " hello  BIG world ", v[1])], "entry long, text string, v array<double>")
    asked = [(10, "Hello big world", v[0]), (11, "HELLO big world", v[0]), (12, "world big hello", v[0]), (13, "nothing alike", v[2]), (14, "nothing else", [-1.0, -1.0]), (15, None, None)]
    out = recall.cache_tier(spark.createDataFrame(asked, "query long, text string, v array<double>"), cached).collect()
    assert {r.query: (r.entry, r.tier) for r in out} == {
        10: (1, "exact"), 11: (1, "normalised"), 12: (1, "jaccard"), 13: (1, "semantic"), 14: (None, None), 15: (None, None),
    }


def test_end_markers_wait_for_their_session(spark):
    rows = [("s", 1, "turn"), ("s", 2, "session_end_marker"), ("t", 3, "memory_write"), ("t", 4, "session_end_marker"), ("u", 5, "session_end_marker")]
    df = spark.createDataFrame(rows, "session string, id long, kind string")
    got = {r.id: r.promote for r in queues.partitioned(df, spark.createDataFrame([], "id long")).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_skills_are_promoted_once_their_file_is_there(spark, tmp_path):
    rows = [("My Skill!", "d", ["a", "b"]), ("my skill", "e", ["c"]), ("--", "x", ["a"]), ("none", "x", [])]
    made = skills.forged(spark.createDataFrame(rows, "name string, description string, steps array<string>"))
    assert [(r.name, r.document.split("\n")[-1]) for r in made.collect()] == [("my-skill", "- b")]
    assert [tuple(r) for r in skills.promoted(spark, made, str(tmp_path / "s")).collect()] == [("my-skill", "promoted")]


def test_words_of_a_lesson_end_where_ascii_words_do(spark):
    said = ["la queñcióncique was here", "óci el. It was", "Nascia was red", "ci\n was red", "ci\r was red", "the cI waſ red", "pr\x0b#1 is open"]
    made = spark.createDataFrame([(i, t, True, ["u"], "en") for i, t in enumerate(said)], "id long, content string, actionable boolean, cites array<string>, entity string")
    members = spark.createDataFrame([(i, "u", t) for i, t in enumerate(said)], "id long, uid string, content string")
    kept = {r.id for r in proposals.specific(made, members, spark.createDataFrame([("EN",)], "entity string")).collect()}
    import duckdb

    con = duckdb.connect()
    pattern = r"(?i)\b(?:created|made|pushed|amended|rebased|squashed)\s+(?:the\s+)?commit\b|\b(?:branch|deployment|pull request|pr\s*#?[0-9]+|ci)\b.{0,100}\b(?:is|was|are|were|waiting|blocked|open|closed|passed|failed|green|red)\b"
    assert kept == {i for i, t in enumerate(said) if not con.execute("select regexp_matches(?, ?)", [t, pattern]).fetchone()[0]}
    assert 0 not in kept and 2 in kept


def test_groups_of_blocks_are_bounded_and_copied_as_they_are(spark, monkeypatch):
    for name, n in (("BLOCK", 7), ("BATCH", 3), ("GROUP", 2), ("FEW", 2), ("SLICE", 2)):
        monkeypatch.setattr(vectors, name, n, raising=False)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "doc long, v array<float>")
    near = vectors.nearest(df, df.withColumnsRenamed({"doc": "query", "v": "q"}), 3)
    v = np.array([r[1] for r in rows])
    length = np.linalg.norm(v, axis=1)
    sims = v @ v.T / np.outer(np.where(length > 0, length, 1), np.where(length > 0, length, 1))
    want = {(i, n): j for i in range(80) for n, (_, j) in enumerate(sorted((-round(sims[i, j], 9), j) for j in range(80) if j != i)[:3], 1)}
    assert {(r.query, r["rank"]): r.doc for r in near.collect()} == want
    pairs = vectors.similar_pairs(df, 0.713)
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, j) for i in range(80) for j in range(i + 1, 80) if sims[i, j] >= 0.713}
    for made in (near, pairs):  # a group of blocks is one step of a task; rows that hold blocks are not joined, nor widened
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "array<double>" not in plan
