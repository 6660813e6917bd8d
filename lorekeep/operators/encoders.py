"""Texts to vectors by an injected model, made once in each task, in batches; and a stored table of vectors that is filled up.

A model is what a factory returns: it has a ``name``, a ``dim`` and ``encode(texts)``, which gives one row of numbers for
each text. The factory travels with the plan, so a large model is loaded where it runs and never sent."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, DIM = 32, 256


class Model(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> object: ...


Factory = Callable[[], Model]


def hash_model(dim: int = DIM) -> Factory:
    """The model of a store without one: each token's bytes of a chain of SHA-256 digests, added over the tokens and scaled to length 1.

    Bytes are added as whole numbers, so the vector does not depend on the order of the tokens. A text without tokens is one sign."""

    def make() -> Model:
        import hashlib
        import re

        import numpy as np

        word = re.compile(r"[^\W_]+")

        class Hashed:
            name = f"hash:{dim}"

            def __init__(self) -> None:
                self.dim, self.known = dim, {}

            def token(self, token: str) -> np.ndarray:
                if token not in self.known:
                    if len(self.known) > 50_000:  # a task may meet more words than it should keep
                        self.known.clear()
                    seed, out = hashlib.sha256(token.encode()).digest(), b""
                    while len(out) < dim:
                        seed = hashlib.sha256(seed).digest()
                        out += seed
                    self.known[token] = np.frombuffer(out[:dim], dtype=np.uint8).astype(np.int64)
                return self.known[token]

            def encode(self, texts: list[str]) -> np.ndarray:
                out = np.zeros((len(texts), dim))
                for i, text in enumerate(texts):
                    tokens = [t.casefold() for t in word.findall(text or "")] or ["∅"]
                    total = 2 * sum(self.token(t) for t in tokens) - 255 * len(tokens)
                    size = np.sqrt(float((total * total).sum()))
                    out[i] = total / (size or 1.0)
                return out

        return Hashed()

    return make


def pooled_model(name: str, load: Callable[[], Callable[[list[str]], tuple]], truncate: int | None = None) -> Factory:
    """A model over token states: ``load()`` gives a function that returns (states: texts x tokens x width, mask) for texts; their
    mean over the mask is scaled to length 1, cut to ``truncate`` numbers and scaled again."""

    def make() -> Model:
        import numpy as np

        states = load()

        class Pooled:
            def __init__(self) -> None:
                self.name, self.dim = name, truncate or 0

            def encode(self, texts: list[str]) -> np.ndarray:
                hidden, mask = (np.asarray(x, dtype=np.float64) for x in states(texts))
                mean = (hidden * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
                for width in (None, truncate):
                    mean = mean[:, :width]
                    mean = mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-9)
                return mean

        return Pooled()

    return make


def embedded(rows: DataFrame, model: Factory, batch: int = BATCH) -> DataFrame:
    """id and v of each row (id, text), encoded ``batch`` texts at a time; a null text counts as empty."""
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = model()
        for part in batches:
            for first in range(0, part.num_rows, batch):
                some = part.slice(first, batch)
                v = np.asarray(own.encode([t or "" for t in some.column(1).to_pylist()]), dtype=np.float64)
                ends = pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["id", "v"])

    return rows.select("id", F.col("text").cast("string").alias("text")).mapInArrow(work, f"id {kind}, v array<double>")


class VectorTable:
    """Vectors by id at ``path``, in a folder of their own for each model, so vectors of two models never mix."""

    def __init__(self, spark: SparkSession, path: str, model: Factory) -> None:
        self.spark, self.model, self.name = spark, model, model().name
        self.path = f"{path.rstrip('/')}/model={self.name.replace(':', '-')}"

    def read(self, kind: str = "long") -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        schema = f"id {kind}, v array<double>"
        if not at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows (id, text) that have no vector of this model; of rows that share an id one."""
        kind = dict(rows.dtypes)["id"]
        return rows.where("id is not null").dropDuplicates(["id"]).join(self.read(kind).select("id"), "id", "left_anti")

    def backfill(self, rows: DataFrame) -> int:
        """Encode and append what is missing; how many that were. A second run finds nothing to do."""
        todo = self.missing(rows)
        n = todo.count()
        if n:
            embedded(todo, self.model).write.mode("append").parquet(self.path)
        return n
