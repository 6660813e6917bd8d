"""The corpus pipeline: toxicity, near-dedup, decontamination, PII, byte-level BPE.

Each stage takes what the one before kept. All but the last return the columns of ``documents``; a stage
only reads the columns that it names, so others pass through. Rows whose text is null count as empty.
Empty tables give empty tables. Of documents that repeat id and text one stays after near-dedup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bagminhash, bpe, decontam, sanitise, toxicity
from lorekeep.llm.common import sha256, ship, text_of, written
from lorekeep.llm.queries import tokenizer_file, tokenizer_pattern

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most likely grade is 0, by a model of the labelled documents among them."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where(~F.col("is_toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    ship(spark)
    kept = bagminhash.near_duplicates(docs, count_links=False).where("is_kept").select(F.col("doc_id").alias("kept_id"), "text_hash").distinct()
    rows = docs.select(*COLUMNS).withColumn("own_hash", F.xxhash64(text_of()))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("own_hash") == F.col("text_hash"))
    return rows.join(kept, same).dropDuplicates(["doc_id", "own_hash"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def sanitise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that disclose it replaced."""
    ship(spark)
    clean = sanitise.sanitise(docs, keep=("lang", "source"))
    return clean.select(
        "doc_id", F.col("sanitised").alias("text"), "lang", "source", F.length("sanitised").cast("long").alias("n_chars")
    )


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and a digest of their decoding, which is that of the text."""
    ship(spark)
    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(docs, ranks, tokenizer_pattern(), decoded_col="decoded")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", sha256(F.col("decoded")).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", sanitise_texts),
    ("bpe", encode_texts),
]

#: SQL can't express the trained, hashed and tokenising stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are stored in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
