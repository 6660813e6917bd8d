"""What the operators of this subpackage share: tables in the shared folder and row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application.

    Where the session leaves the size of Arrow batches at its default, they are made smaller, as a row is
    a whole document and a worker holds a batch and what it makes of it."""
    if not spark.sparkContext.getConf().contains(BATCH_ROWS) and spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lorekeep-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset in a
    local session (as in tests) a temporary folder that is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lorekeep-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The table outlives a lost executor, and every reader sees the same rows even if the plan
    above it would deal rows otherwise when run again. ``discard`` removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lorekeep-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(work: Work) -> Work:
    """``work`` for ``mapInArrow``; after a task's last batch its worker, which Spark keeps for other tasks, gives the memory
    that it no longer uses back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory()

    return run


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only one C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_of(column: str = "text") -> Column:
    """A text column in which null stands for the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_hashes(text: Column) -> Column:
    """The hash of each word (letters and digits, lower case), in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def utf8(column: str | Column) -> Column:
    """The UTF-8 bytes of a string column."""
    return F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8")


def sha256(column: Column) -> Column:
    """Lowercase hex SHA-256 of a string or binary column."""
    return F.sha2(column, 256)


#: A key's rows are dealt over so many tasks where they meet the one row of their key.
SALTS = 16


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str | Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key``: the rows of a key are dealt by a hash of ``by`` over
    ``SALTS`` tasks, and its row is copied to each, so a key with very many rows is no single task."""
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [key, "salt"], how).drop("salt")


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
