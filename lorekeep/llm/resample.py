"""Importance resampling towards a target: hashed n-gram features, gains by bucket, a draw by perturbed weights.

Features are counted by DuckDB inside each Spark task: SQL unnests the words of a slice of texts, a window
reads the CRCs of the words that follow, where each word is hashed by a registered zlib CRC function and an n-gram by joining the CRCs
of its words, and the counts of each text and bucket go to a Parquet table in the shared folder. Spark merges that table: counts of the whole corpus
by bucket, gains against the target's, a sum of gains for each text, and one sort of the scores.

Texts are counted whole: long ones in pieces that end between words, where a piece also sees the words that
follow it, so every n-gram is counted once and a task holds ``SLICE_CHARS`` characters at a time.

Defined cases: null and empty texts, and texts without words, have no feature and weight 0. Rows that repeat an
id are rows of their own, with the same noise; rows without an id have the noise of an empty id and come after
others of their score. Empty tables give no rows; an empty target is a target without features. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release_memory, shuffles, written

BUCKETS = 10_000
MAX_RUN = 3
SCALE = 1000
#: A slice of texts that DuckDB counts at once; a longer text is cut into pieces of about so many characters.
SLICE_CHARS = 500_000
#: Rows of counts that a worker adds up at once.
ROWS = 256
#: Memory of the DuckDB of one task, several times what a slice takes; it has no folder to spill to.
MEMORY = "500MB"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_BREAK = re.compile(_GAP)
_FOLLOWING = re.compile(f"(?:{_GAP}*{_WORD}+){{0,{MAX_RUN - 1}}}")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_SQL = f"""
with texts as (
  select d, regexp_extract_all(own, '{_WORD}+') as own, regexp_extract_all(follows, '{_WORD}+') as follows from piece
), words as (
  select d, unnest(list_concat(own, follows)) as w1, generate_subscripts(list_concat(own, follows), 1) as i, len(own) as n_own, rid
  from (select *, row_number() over () as rid from texts)
), hashed as (
  select d, i, n_own, rid, crc(w1) as c1, strlen(w1) as n1 from words
), runs as (
  select d, i, n_own, c1, lead(c1, 1) over w as c2, lead(n1, 1) over w as n2, lead(c1, 2) over w as c3, lead(n1, 2) over w as n3 from hashed window w as (partition by rid order by i)
), pairs as (
  select d, c1, case when c2 is not null then crc_joined(c1, c2, n2) end as c12, c3, n3 from runs where i <= n_own
), features as (
  select d, unnest([c1, c12, case when c3 is not null then crc_joined(c12, c3, n3) end]) as f from pairs
)
select d, f % {BUCKETS} as b, count(*) as n from features where f is not null group by all
"""


def _crc(strings: pa.ChunkedArray) -> pa.Array:
    """zlib's CRC of the UTF-8 bytes of each string."""
    out = []
    for part in strings.chunks if isinstance(strings, pa.ChunkedArray) else [strings]:
        part = part.cast(pa.large_binary())
        data = memoryview(part.buffers()[2] or b"")
        ends = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1].tolist()
        crc = zlib.crc32
        out.extend([crc(data[a:b]) for a, b in zip(ends, ends[1:])])
    return pa.array(out, pa.int64())


#: CRCs are linear: that of two joined strings is that of the first, carried on over as many zero bytes as the second has, xor that of
#: the second. ``_carried(n)`` has what each value of each byte of a CRC becomes over ``n`` bytes.
_CARRIED: dict[int, np.ndarray] = {}
SHORT = 64


def _carried(n: int) -> np.ndarray:
    if n not in _CARRIED:
        if len(_CARRIED) > 4096:  # of 4 KB each
            _CARRIED.clear()
        zeros = bytes(n)
        bits = [zlib.crc32(zeros, 1 << k) ^ zlib.crc32(zeros, 0) for k in range(32)]
        tables = np.zeros((4, 256), dtype=np.int64)
        for byte in range(4):
            for k in range(8):
                tables[byte, 1 << k : 2 << k] = tables[byte, : 1 << k] ^ bits[8 * byte + k]
        _CARRIED[n] = tables
    return _CARRIED[n]


@functools.cache
def _short() -> np.ndarray:
    """``_carried`` of all sizes below ``SHORT``."""
    return np.stack([_carried(n) for n in range(SHORT)]).reshape(-1)


def _crc_joined(first: pa.ChunkedArray, second: pa.ChunkedArray, size: pa.ChunkedArray) -> pa.Array:
    """The CRC of two strings joined by one space, from their own CRCs and the bytes of the second; null where one is null."""
    a, b, n = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (first, second, size))
    valid = pc.and_(pc.and_(a.is_valid(), b.is_valid()), n.is_valid())
    a, b, n = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b, n))
    space, own = _carried(1), zlib.crc32(b" ")
    a = space[0][a & 255] ^ space[1][a >> 8 & 255] ^ space[2][a >> 16 & 255] ^ space[3][a >> 24] ^ own
    if n.max(initial=0) < SHORT:
        tables, which = _short(), n
    else:
        sizes, which = np.unique(n, return_inverse=True)
        tables = np.stack([_carried(int(k)) for k in sizes]).reshape(-1)
    at = which * 1024
    out = tables[at + (a & 255)] ^ tables[at + 256 + (a >> 8 & 255)] ^ tables[at + 512 + (a >> 16 & 255)] ^ tables[at + 768 + (a >> 24)] ^ b
    return pc.if_else(valid, pa.array(out, pa.int64()), pa.scalar(None, pa.int64()))


def pieces(text: str, chars: int) -> Iterator[tuple[str, str]]:
    """The text in pieces that end between words, each with the words that follow, as far as a run reaches."""
    first = 0
    while len(text) - first > chars:
        gap = _BREAK.search(text, first + chars)
        if not gap:
            break
        stop = gap.start()
        yield text[first:stop], _FOLLOWING.match(text, stop).group()
        first = stop
    yield text[first:], ""


class _Counter:
    """Counts of buckets by text, in slices of bounded size."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self.db.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        self.db.create_function("crc_joined", _crc_joined, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow", null_handling="special")

    def slice(self, rows: list[tuple[int, str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, bucket and count, in no order."""
        d, own, follows = (list(x) for x in zip(*rows))
        piece = pa.table([pa.array(d, pa.int32()), pa.array(own, pa.string()), pa.array(follows, pa.string())], ["d", "own", "follows"])
        self.db.register("piece", piece)
        found = self.db.execute(_SQL).fetchnumpy()
        self.db.unregister("piece")
        return tuple(np.asarray(found[x], dtype=np.int64) for x in ("d", "b", "n"))

    def whole(self, text: str, chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row (0), bucket and count of one text that is longer than a slice: those of its pieces, added up."""
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for own, follows in pieces(text, chars):
            _, b, n = self.slice([(0, own, follows)])
            np.add.at(sums, b, n)
        b = np.flatnonzero(sums)
        return np.zeros(len(b), dtype=np.int64), b, sums[b]

    def slices(self, texts: Iterable[str | None], chars: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of one slice of whole texts after the other: the first text and the one behind the last, then row (from the first), bucket and
        count, ordered. So no more than a slice's counts are held at a time, however many texts a batch has."""
        first, rows, held, at = 0, [], 0, -1
        for at, text in enumerate(texts):
            text = (text or "").encode().translate(_LOWER).decode()  # bytes of other characters are none of A-Z
            if rows and held + len(text) > chars:
                yield first, at, *_ordered(*self.slice(rows))
                first, rows, held = at, [], 0
            if len(text) > chars:
                yield at, at + 1, *self.whole(text, chars)
                first = at + 1
            else:
                rows.append((at - first, text, ""))
                held += len(text)
        if rows:
            yield first, at + 1, *_ordered(*self.slice(rows))


def _ordered(d: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(d * BUCKETS + b)
    return d[order], b[order], n[order]


def bucket_counts(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``buckets`` (those of the text's features, ascending), ``counts`` and ``n_features`` of each row."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), (F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    chars = SLICE_CHARS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or _Counter()
            for first, stop, d, b, n in counter.slices((text.as_py() for text in batch.column(0)), chars):
                ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=stop - first))])
                sums = np.bincount(d, weights=n, minlength=stop - first).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, stop - first),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(b, pa.int16())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n, pa.int32())),
                        pa.array(sums),
                    ],
                    ["id", "buckets", "counts", "n_features"],
                )
        del counter
        release_memory()

    return rows.mapInArrow(work, f"id {kind}, buckets array<smallint>, counts array<int>, n_features long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS`` rows, as a row has all counts of a text."""
    for batch in batches:
        yield from (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS))


def totals(counted: DataFrame) -> np.ndarray:
    """The features of all rows by bucket: one partial sum a task, ``BUCKETS`` numbers at the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for batch in _cut(batches):
            b, n = (batch.column(k).flatten().to_numpy() for k in (0, 1))
            sums += np.bincount(b, weights=n, minlength=BUCKETS).astype(np.int64)
        has = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(sums[has])], ["bucket", "n"])

    parts = counted.select("buckets", "counts").mapInArrow(work, "bucket long, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """What a feature of each bucket adds to a text's weight."""
    s, t = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return [math.floor(SCALE * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist())]


def noise(id_col: str | Column = "doc_id", seed: int = 42) -> Column:
    """Standard Gumbel noise of an id, in ``1 / SCALE``, rounded down."""
    key = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(rows: DataFrame, share: int, name: str) -> DataFrame:
    """The first ``share`` per cent of ``rows`` (id, score), numbered by score (highest first) and id: dealt by range, numbered inside it."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "key"]
    ranged = rows.repartitionByRange(shuffles(rows.sparkSession), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("nth", F.monotonically_increasing_id()), "ranked")
    sizes = ranged.groupBy(F.shiftright("nth", 33).alias("range")).count().orderBy("range").collect()  # a row for each range
    drawn = sum(r["count"] for r in sizes) * share // 100
    spark, before, starts = rows.sparkSession, 0, []
    for r in sizes:
        starts.append((r["range"], before - (r["range"] << 33) + 1))
        before += r["count"]
    moved = F.broadcast(spark.createDataFrame(starts, "range long, moved long"))
    out = ranged.withColumn("range", F.shiftright("nth", 33)).join(moved, "range").withColumn(name, F.col("nth") + F.col("moved"))
    return out.where(F.col(name) <= drawn).select("key", name)


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 5, least_words: int = 20, seed: int = 42
) -> DataFrame:
    """One row for each row of ``docs``: id, n_features, weight, score and ``rank`` in the draw (null: not drawn).

    Of the rows with at least ``least_words`` words, ``share`` per cent are drawn."""
    counted = written(bucket_counts(docs, id_col, text_col), "counts")
    goal = written(bucket_counts(target, None, text_col), "target")
    gain = np.array(gains(totals(counted), totals(goal)), dtype=np.int64)
    discard(goal)
    kind = counted.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            ends = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            each = gain[batch.column(1).flatten().to_numpy()] * batch.column(2).flatten().to_numpy().astype(np.int64)
            run = np.concatenate([[0], np.cumsum(each)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(run[ends[1:]] - run[ends[:-1]])], ["id", "n_features", "weight"])

    weighed = counted.mapInArrow(work, f"id {kind}, n_features long, weight long").withColumn("score", F.col("weight") + noise("id", seed))
    scored = written(weighed.withColumn("key", F.monotonically_increasing_id()), "scores")  # the key tells rows of one id apart
    discard(counted)
    enough = F.col("n_features") >= max(MAX_RUN * least_words - sum(range(MAX_RUN)), min(least_words, 1))  # those of so many words
    drawn = _ranked(scored.where(enough).select("id", "key", "score"), share, "rank")
    return scored.join(drawn, "key", "left").select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
