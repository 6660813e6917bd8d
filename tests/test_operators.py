"""Operators that SQL can't express, and edge cases, against small brute-force versions."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text
from lorekeep.operators import fusion, graph, predicates, sessions, temporal, vectors
from lorekeep.sources import readers, writers
from lorekeep.streaming import sessions as streams


def test_mmr_prefers_new_words_and_keeps_short_lists(spark):
    hits = [(1, 1, 1.0, ["a", "b"]), (1, 2, 0.99, ["a", "b"]), (1, 3, 0.9, ["c"]), (2, 4, 1.0, ["a"]), (2, 5, 0.5, ["b"])]
    df = spark.createDataFrame(hits, "query int, key int, score double, words array<string>")
    got = {(r.query, r.position): r.key for r in fusion.mmr(df, 3).collect()}
    assert [got[1, i] for i in (1, 2, 3)] == [1, 3, 2]
    assert [got[2, i] for i in (1, 2)] == [4, 5]


def test_chain_heads_survive_cycles(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, None), (7, 8), (8, 7)], "id long, next_id long")
    got = {r.id: r.head for r in temporal.chain_heads(links).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 7: None, 8: None}


def test_null_kind_survives_exclusion(spark):
    df = spark.createDataFrame([(1, None), (2, "case"), (3, "fact")], "id int, kind string")
    assert {r.id for r in df.where(predicates.kinds(exclude=["case"])).collect()} == {1, 3}


def test_unattributed_reader_sees_nothing(spark):
    df = spark.createDataFrame([("u", "a", "agent")], "principal_id string, source_author string, trust_tier string")
    assert df.where(predicates.episode_rls(None, None, "agent")).count() == 0


def test_quantise_rounds_half_even(spark):
    df = spark.createDataFrame([([0.5 / 127, 1.5 / 127, -2.0, 2.0],)], "v array<double>")
    assert list(df.select(vectors.quantised(F.col("v"))).first()[0]) == [0, 2, -127, 127]


def test_stub_embedding_has_length_one_or_zero(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "t string").select(vectors.stub_embedding(F.col("t"), 8).alias("v"))
    lengths = sorted(sum(x * x for x in r.v) for r in df.collect())
    assert lengths[0] == 0 and math.isclose(lengths[1], 1.0)


def test_turn_cap_restarts_after_a_break(spark):
    rows = [("s", i, i * 60, "verified" if i == 4 else "open") for i in range(30)]
    df = spark.createDataFrame(rows, "session_id string, turn_id long, at long, outcome string").withColumn("created_at", F.timestamp_seconds("at"))
    runs = {r.turn_id: r.run for r in sessions.task_runs(df).collect()}
    assert [runs[i] for i in (0, 4, 5, 24, 25, 29)] == [1, 1, 2, 2, 3, 3]


def test_text_functions(spark):
    df = spark.createDataFrame([("\x00json:" + json.dumps([{"type": "text", "text": "hi"}, {"type": "image"}]),), ("plain",)], "raw string")
    assert [r[0] for r in df.select(text.flattened_parts(F.col("raw"))).collect()] == ["hi\n[image]", "plain"]
    tags = spark.createDataFrame([('["a","b"]',), ("x, y",), ("[bad",), (None,)], "t string")
    assert [list(r[0]) for r in tags.select(text.tag_list(F.col("t"))).collect()] == [["a", "b"], ["x", "y"], ["[bad"], []]


def test_json_lines_and_delimited_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"text": "one", "tags": "a,b"}\nnot json\n{"memory": "two", "pinned": true}\n')
    rows = {r.content: r for r in readers.json_lines(spark, str(tmp_path / "m.jsonl")).collect()}
    assert set(rows) == {"one", "two", None} and rows[None].malformed and rows["two"].pinned and list(rows["one"].tags) == ["a", "b"]
    (tmp_path / "m.md").write_text("first\n§\n second \n§\nfirst\n§\n\n")
    got = sorted((r.position, r.entry) for r in readers.delimited_entries(spark, str(tmp_path / "m.md")).collect())
    assert got == [(0, "first"), (1, "second")]


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "id long, name string, xs array<int>")
    assert writers.write_snapshot(spark, {"t": df}, str(tmp_path)) == {"t": 2}
    assert sorted(map(tuple, readers.read_snapshot(spark, str(tmp_path))["t"].collect())) == sorted(map(tuple, df.collect()))


def test_import_is_idempotent_on_null_identities(spark):
    have = spark.createDataFrame([("h", None)], "content_hash string, scope string")
    new = spark.createDataFrame([("h", None), ("h", "u"), ("k", None)], "content_hash string, scope string")
    got = readers.import_new(have, new, ["content_hash", "scope"])
    assert sorted((r.content_hash, r.scope or "") for r in got.collect()) == [("h", "u"), ("k", "")]


def test_stream_closes_runs_by_gap_and_outcome(spark, tmp_path):
    rows = [("s", 1000, "open"), ("s", 1060, "open"), ("s", 21_000, "verified"), ("t", 1000, "failed"), ("z", 900_000, "verified")]
    df = spark.createDataFrame(rows, "session_id string, at long, outcome string").select("session_id", F.timestamp_seconds("at").alias("created_at"), "outcome")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.closed_runs(stream).writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination()
    got = sorted((r.session_id, r.n_turns, r.outcome) for r in spark.table("runs").collect())
    assert got == [("s", 1, "verified"), ("s", 2, "open"), ("t", 1, "failed"), ("z", 1, "verified")]


@pytest.mark.parametrize("at,expect", [("1997-01-01", [1]), ("1997-06-01", [2])])
def test_as_of_is_half_open(spark, at, expect):
    rows = [(1, "s", "p", "1997-01-01"), (2, "s", "p", "1997-06-01")]
    df = spark.createDataFrame(rows, "fact_id long, subject string, predicate string, d string")
    spans = temporal.fact_intervals(df.withColumn("valid_from", F.to_timestamp("d")))
    assert [r.fact_id for r in spans.where(predicates.as_of(F.to_timestamp(F.lit(at)))).collect()] == expect


def test_small_parsers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    a, b = (get(text.sortable_id(F.timestamp_seconds(lit(s)), lit("k"))) for s in (1_700_000_000, 1_700_000_001))
    assert len(a) == len(b) == 26 and a[:10] < b[:10] and a[10:] == b[10:]
    assert tuple(get(text.archive_ref(lit("202401.gz:M01")))) == ("202401.gz", "M01") and get(text.archive_ref(lit("../etc:M01"))) is None
    assert get(text.without_id_prefix(lit("[01ABCDEF] said"))) == "said"
    assert get(text.frontmatter(lit("---\nname: a b\nkind: x:y\n---\nbody"))) == {"name": "a b", "kind": "x:y"}
    assert get(text.frontmatter(lit("no head"))) == {}
    assert get(text.replaced_section(lit("## A\nold\n## B\nkeep\n"), "A", "new $1")) == "## A\nnew $1\n## B\nkeep\n"
    assert list(get(text.search_aids(F.array(*[lit(x) for x in ("One ", "one", "x", "two  words")]), lit("none")))) == ["One", "two words"]
    assert get(text.metadata(lit('{"a": "1"}'))) == {"a": "1"} and get(text.metadata(lit("[1]"))) == {} and get(text.metadata(lit("{junk"))) == {}
    assert get(text.billed_by(lit("GPT-4"))) == "openai" and get(text.billed_by(lit("x/gpt"))) is None
    assert get(text.json_span(lit('so:\n```json\n{"a": [1]}\n```'))) == '{"a": [1]}' and get(text.json_span(lit("none"))) is None


def test_pairs_outliers_and_merges_take_every_row(spark, tmp_path):
    from lorekeep.plans import insight, registry, retrieval  # noqa: F401

    rows = [(i, 0, [1.0 + i, float(i * i)]) for i in range(1, 41)]
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {n: registry.queries()[n](spark, str(tmp_path)).collect() for n in ("v10_all_neighbour_pairs", "g15_v7_all_density_outliers", "v2_j21_all_merge_candidates")}
    assert any(r.a % 20 and r.b % 20 for r in got["v10_all_neighbour_pairs"])
    assert [r.nth for r in got["g15_v7_all_density_outliers"]] == [1, 2, 3, 4]
    assert {r.new_id for r in got["v2_j21_all_merge_candidates"]} == set(range(1, 41))


def test_pagerank_over_mentions_equals_that_over_all_edges(spark):
    rows = [(1, e, 7 * e % 5 + 5 * m) for e in range(9) for m in range(0, 90, 1 + e)] + [(1, 99, m) for m in range(450)] + [(2, 1, 3), (2, 1, 4)]
    df = spark.createDataFrame(rows, "query int, entity int, memory long")
    seeds = spark.createDataFrame([(1, 0), (1, 7), (2, 3)], "query int, node long")
    by = F.struct("query", "entity").alias("entity")
    edges = graph.co_mentions(df.select(by, "memory"), per_entity=10**6, by=F.col("entity.query"))
    want = {(r.query, r.node): r.score for r in graph.personal_pagerank(df.where("false"), edges, seeds).collect()}
    got = {(r.query, r.node): r.score for r in graph.mention_pagerank(df, seeds).collect()}
    assert set(got) == set(want) and len(got) > 400
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_co_mentions_are_counted_in_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 50)
    rows = [(e, m) for e in range(20) for m in range(e % 3, 30, 1 + e % 4)] * 2 + [(None, 1), (None, 2), (5, None), (77, 1)]
    found = graph.co_mentions(spark.createDataFrame(rows, "entity int, memory long"), per_entity=9)
    want = {}
    for e in range(20):
        kept = sorted({m for x, m in rows if x == e and m is not None})[: 9 - (e == 5)]  # the null of entity 5 comes first
        for a in kept:
            for b in kept:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.weight for r in found.collect()} == want
    assert found.rdd.getNumPartitions() == -(-sum(want.values()) // 50) > 4


def test_registered_pagerank_takes_all_orders(spark, tmp_path):
    from lorekeep.plans import registry, retrieval  # noqa: F401

    rows = [(1, 1, m) for m in range(450)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.createDataFrame([(m, m % 7, "O") for m in range(450)], "o_orderkey long, o_custkey long, o_orderstatus string")
    orders.withColumn("o_orderdate", F.current_date()).write.parquet(f"{tmp_path}/orders.parquet")
    got = registry.queries()["r9_pagerank_leg"](spark, str(tmp_path)).collect()
    assert {r.node for r in got} == set(range(5, 450))
