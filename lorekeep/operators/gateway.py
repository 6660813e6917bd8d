"""Calls of an injected language model as a metered stage, and questions answered in rounds of calls and searches.

The model is a callable of the caller's, made once in each task from a factory: prompt in, text out. Every call leaves a ledger row beside its
answer, also one whose answer is of no use. Prompts are admitted in the order of their ids while the budget lasts, so what is
called does not depend on how rows are dealt. A stage is stored before it is read: nothing is called twice by a second reader."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import approx_tokens, tokens
from lorekeep.operators.recall import finalised
from lorekeep.session import stored

Factory = Callable[[], Callable[[str], str]]
RETRIES, MAX_TOKENS = 2, 1200


def admitted(prompts: DataFrame, budget: int, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``prompts`` (id, prompt) with ``fits``: whether a call and all calls of smaller ids stay within the budget of tokens.

    Sums run inside ranges of ids and are moved on by those of the ranges before, so no task has all prompts."""
    rows = prompts.withColumn("cost", approx_tokens(F.col("prompt")) + max_tokens)
    n = int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, "id").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = ranged.groupBy("_range").agg(F.sum("cost").alias("s"))
    sums = sums.select("_range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_before"))
    own = F.sum("cost").over(Window.partitionBy("_range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(F.broadcast(sums), "_range").withColumn("fits", F.col("_own") + F.col("_before") <= budget).drop("_range", "_own", "_before", "cost")


def called(prompts: DataFrame, model: Factory, *, budget: int | None = None, tier: str = "ask", retries: int = RETRIES) -> DataFrame:
    """id, answer, status (answered, empty, failed, over budget), attempts, tokens_in, tokens_out and tier of each prompt (id, prompt).

    A call that raises or returns nothing is tried again, ``retries`` times; each attempt is metered."""
    kind = dict(prompts.dtypes)["id"]
    rows = prompts.select("id", "prompt").withColumn("fits", F.lit(True)) if budget is None else admitted(prompts.select("id", "prompt"), budget)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = model()
        for batch in batches:
            out = []
            for prompt, fits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                answer, status, attempts, spent_in, spent_out = None, "over budget", 0, 0, 0
                while fits and attempts <= retries and not answer:
                    attempts += 1
                    spent_in += max(1, len(prompt or "") // 4)
                    try:
                        answer = call(prompt or "")
                        spent_out += max(1, len(answer or "") // 4)
                        answer, status = ((answer or "").strip() or None), "answered"
                        status = status if answer else "empty"
                    except Exception:  # noqa: BLE001 - a model may fail in any way; the row says so
                        status = "failed"
                out.append((answer, status, attempts, spent_in, spent_out))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "answer", "status", "attempts", "tokens_in", "tokens_out"])

    schema = f"id {kind}, answer string, status string, attempts int, tokens_in long, tokens_out long"
    return stored(rows.select("id", "prompt", "fits").mapInArrow(work, schema).withColumn("tier", F.lit(tier)))


def spent(ledger: DataFrame) -> DataFrame:
    """Calls and tokens of a ledger by tier and status."""
    return ledger.groupBy("tier", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("attempts").cast("long").alias("attempts"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out")
    )


def asked(questions: DataFrame, model: Factory, search: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Answers (query, answered, answer, citations) of questions (query, text), and the ledger of all calls.

    In each round the open questions are put to the model with what was found so far. It replies with JSON, {"search": text} or
    {"answer": text, "cites": [uid, ...]}; searches of all questions are one join: ``search`` takes (query, term) and returns
    (query, uid, line). Only uids that were found for a question can be cited. What is open after the last round has no answer."""
    state = stored(questions.select("query", "text", F.lit("").alias("found")))
    ledger = registry = answers = None
    reply = "search string, answer string, cites array<string>"
    for nth in range(rounds):
        prompt = F.to_json(F.struct(F.lit(nth + 1).alias("round"), F.lit(rounds).alias("of"), F.col("text").alias("question"), F.col("found")))
        done = called(state.select(F.col("query").alias("id"), prompt.alias("prompt")), model, tier=f"round {nth + 1}")
        ledger = done if ledger is None else ledger.unionByName(done)
        said = done.select(F.col("id").alias("query"), F.from_json("answer", reply).alias("r")).select("query", "r.*")
        final = said.where("search is null").select("query", F.col("answer").alias("said"), F.col("cites").alias("cited"))
        answers = final if answers is None else answers.unionByName(final)
        wants = said.where("search is not null").select("query", F.explode(F.array_distinct(tokens(F.col("search")))).alias("term"))
        hits = stored(search(wants))
        registry = hits.select("query", "uid") if registry is None else registry.unionByName(hits.select("query", "uid"))
        lines = hits.groupBy("query").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("new"))  # as few as a search returns
        left = state.join(said.where("search is not null").select("query"), "query", "left_semi").join(lines, "query", "left")
        state = stored(left.select("query", "text", F.concat_ws("\n", F.when(F.col("found") != "", F.col("found")), "new").alias("found")))
    open_ = state.select("query", F.lit(None).cast("string").alias("said"), F.lit(None).cast("array<string>").alias("cited"))
    return finalised(answers.unionByName(open_), registry), ledger


def scripted(retrieve_words: int = 3) -> Factory:
    """A model of fixed replies, for tests and trials: it searches for the first words of the question, then cites the first line that was
    found (and a uid that was not), or says that it found nothing."""

    def make() -> Callable[[str], str]:
        import re

        def reply(prompt: str) -> str:
            asked = json.loads(prompt)
            if asked["round"] == 1:
                words = list(dict.fromkeys(re.findall(r"[^\W_]+", asked["question"].lower())))
                return json.dumps({"search": " ".join(words[:retrieve_words])})
            lines = asked["found"].splitlines()
            if not lines:
                return json.dumps({"answer": "There is no record of that", "cites": []})
            return json.dumps({"answer": f"See {lines[0]}", "cites": [lines[0], "MADE-UP"]})

        return reply

    return make
