"""Injected models and the retrieval log: encoders, metered calls, rounds of questions, stamps in batch and stream."""

import hashlib
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import encoders, gateway, injections
from lorekeep.streaming.injections import stamped_stream


def brute_vector(text, dim):
    total = [0] * dim
    tokens = [t.casefold() for t in re.findall(r"[^\W_]+", text or "")] or ["∅"]
    for token in tokens:
        seed, out = hashlib.sha256(token.encode()).digest(), b""
        while len(out) < dim:
            seed = hashlib.sha256(seed).digest()
            out += seed
        total = [s + 2 * b - 255 for s, b in zip(total, out)]
    size = math.sqrt(sum(x * x for x in total))
    return [x / size for x in total]


def test_hashed_vectors_equal_their_definition_in_any_batches(spark):
    rows = [(1, "Über die Straße, a_b"), (2, None), (3, ""), (4, "x " * 5000), (5, "die Über a b STRASSE")]
    df = spark.createDataFrame(rows, "id long, text string")
    for batch in (1, 32):
        got = {r.id: r.v for r in encoders.embedded(df, encoders.hash_model(70), batch).collect()}
        assert got == {i: brute_vector(t, 70) for i, t in rows}
    assert encoders.embedded(df.where("false"), encoders.hash_model()).count() == 0


def test_pooled_states_are_means_cut_and_scaled(spark):
    def load():
        return lambda texts: (np.array([[[len(t), 1.0, 2.0], [9.0, 9.0, 9.0]] for t in texts]), np.array([[1, 0] for _ in texts]))

    df = spark.createDataFrame([(1, "abc"), (2, "a")], "id long, text string")
    got = {r.id: r.v for r in encoders.embedded(df, encoders.pooled_model("p", load, 2)).collect()}
    assert all(np.allclose(got[i], np.array([n, 1.0]) / math.hypot(n, 1)) for i, n in ((1, 3), (2, 1)))


def test_backfill_writes_each_vector_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i}") for i in range(70)] + [(3, "again"), (None, "no id")], "id long, text string")
    table = encoders.VectorTable(spark, str(tmp_path / "v"), encoders.hash_model(16))
    assert [table.backfill(rows.where("id < 40")), table.backfill(rows), table.backfill(rows)] == [40, 30, 0]
    assert sorted(r.id for r in table.read().collect()) == list(range(70))
    other = encoders.VectorTable(spark, str(tmp_path / "v"), encoders.hash_model(8))  # another model begins anew
    assert other.backfill(rows) == 70 and {len(r.v) for r in other.read().collect()} == {8} and table.read().count() == 70


def test_calls_are_metered_retried_and_bounded(spark):
    def make():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if "raise" in prompt:
                raise ValueError(prompt)
            if "later" in prompt and seen[prompt] < 3:
                return " "
            return "" if "empty" in prompt else prompt.upper()

        return call

    rows = [(1, "good one"), (2, "raise"), (3, "later"), (4, "empty"), (5, None), (6, "past the budget")]
    df = spark.createDataFrame(rows, "id long, prompt string")
    out = {r.id: (r.answer, r.status, r.attempts) for r in gateway.called(df, make, budget=sum(max(1, len(p or "") // 4) + 1200 for _, p in rows[:5])).collect()}
    assert out == {1: ("GOOD ONE", "answered", 1), 2: (None, "failed", 3), 3: ("LATER", "answered", 3), 4: (None, "empty", 3), 5: (None, "empty", 3), 6: (None, "over budget", 0)}
    ledger = {(r.tier, r.status): (r.n, r.attempts, r.tokens_in) for r in gateway.spent(gateway.called(df, make)).collect()}
    assert ledger["ask", "failed"] == (1, 3, 3) and ledger["ask", "answered"] == (3, 5, 2 + 3 * 1 + 3)


def test_questions_cite_only_what_was_found(spark):
    store = {"m1": "alpha beta", "m2": "gamma", "m3": "alpha"}
    lines = spark.createDataFrame([(u, t) for u, t in store.items()], "uid string, line string")

    def search(terms):
        return terms.join(lines, F.array_contains(F.split("line", " "), F.col("term"))).select("query", F.upper("uid").alias("uid"), F.upper("uid").alias("line")).distinct()

    questions = spark.createDataFrame([(1, "Alpha gamma?"), (2, "nothing here"), (3, "gamma")], "query long, text string")
    answers, ledger = gateway.asked(questions, gateway.scripted(), search)
    got = {r.query: (r.answered, r.answer, r.citations) for r in answers.collect()}
    assert got == {1: (True, "See M1", ["M1"]), 2: (False, None, []), 3: (True, "See M2", ["M2"])}
    assert {r.tier: r.n for r in gateway.spent(ledger).collect()} == {"round 1": 3, "round 2": 3}

    def loops():
        return lambda prompt: json.dumps({"search": "alpha"})

    answers, _ = gateway.asked(questions, loops, search, rounds=2)
    assert {(r.query, r.answered) for r in answers.collect()} == {(1, False), (2, False), (3, False)}


def brute_stamps(rows, now, grace=48 * 3600):
    out = {}
    for s, at, i, kind, m in rows:
        if kind != "inject":
            continue
        later = sorted((a, j, k) for t, a, j, k, _ in rows if t == s and (a, j) > (at, i) and k in ("inject", "turn"))
        turn = next(((a, j) for a, j, k in later if k == "turn" and a <= at + grace), None)
        replaced = any(k == "inject" and a <= min(at + grace, now) and (turn is None or (a, j) < turn) for a, j, k in later)
        out[i] = (s, m, not replaced, turn and turn[1], "stamped" if turn else "expired" if at + grace < now else "pending")
    return out


def log_of(seed=3, n=300):
    rng = np.random.default_rng(seed)
    rows = [("hot" if rng.random() < 0.4 else f"s{rng.integers(0, 6)}", int(1_700_000_000 + rng.integers(0, 30 * 86400)), i, ["inject", "turn", "blank"][rng.choice(3, p=[0.6, 0.3, 0.1])], int(rng.integers(0, 9))) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "session string, at_s long, id long, kind string, memory long").withColumn("at", F.timestamp_seconds("at_s")).drop("at_s")


@pytest.mark.parametrize("now", [1_700_000_000 + 60 * 86400, 1_700_000_000 + 30 * 86400])
def test_stamps_equal_brute_force(spark, now):
    rows = log_of()
    got = {r.id: (r.session, r.memory, r.injected, r.turn, r.state) for r in injections.stamped(frame(spark, rows), F.timestamp_seconds(F.lit(now))).collect()}
    assert got == brute_stamps(rows, now)
    counts = {r.memory: r.recalls for r in injections.recalls(frame(spark, rows)).collect()}
    assert sum(counts.values()) == len(got)


def test_stream_of_stamps_equals_the_batch_and_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log_of(4, 120)
    end = max(r[1] for r in rows) + 90 * 86400
    parts = [rows[:40], rows[40:90], rows[90:], [("end", end, 10_000, "turn", None)]]

    def run():
        stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = stamped_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    try:
        for part in parts:  # each run goes on from the checkpoint of the one before
            frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run()
        run()
        found = spark.read.parquet(str(tmp_path / "out")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert len({r.id for r in found}) == len(found)  # nothing twice
    assert {r.id: (r.session, r.memory, r.injected, r.turn, r.state) for r in found} == brute_stamps(rows, end)
