"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Integer vectors are dealt into blocks of about ``BLOCK`` vectors. A block's index holds one posting
(vector, dimension, value) for each component that is not 0, dealt into segments by quantised impact, the
power of two that bounds the value's size. Inside a segment postings lie in lists by dimension, or in a matrix
where they fill at least ``DENSE`` of its cells. A query processes
the segments by descending impact, and each adds what its postings give to the scores so far. After a
segment the rest of a score is at most the product of the lengths of the query and of the vector's unread
values (Cauchy-Schwarz), so every score has a lower and an upper bound. A query stops reading only when
the bounds prove that at most ``RESCORE`` vectors of the block may still belong to its k best, or when the
segments are used up; postings of vectors that the bounds have ruled out are passed over before that. The
possible members are then rescored in exact integers from their own components. The k best of each block
are merged by a window.

Rows are the unit: every row but the query's own is a candidate, and every query row has its own list,
so rows that repeat id and vector count as often as they stand. They are stored once, with their number.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows without an
id, take no part. Of vectors of different lengths the missing components count as 0. Equal scores go to
the smaller id. Only the named columns are read. Components of any size take part (those beyond 64 bits as the
nearest 64-bit number): where sums of a block may pass 2**53 its bounds allow for their rounding, and the rescoring
adds unbounded integers. Ranks follow the exact scores; ``score`` is the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
BATCH = 512
RESCORE = 256
#: From this share of filled cells on a segment is a matrix.
DENSE = 0.125
#: Queries that read a segment together.
TOGETHER = 64

PAIRS = "batch long, nth long, n long, query_id long, vec_id long, score long, high long, middle long, low long"
#: Sums of whole numbers below it are exact in 64-bit floats, and in 32-bit ones below the other.
EXACT, NARROW = 2.0**53, 2.0**24
_HALF = 48


def quantised(embedding: str, scale: int = 64):
    """``floor(scale * x)`` of every component, null where a vector takes no part."""
    e = F.col(embedding).cast("array<double>")
    fine = (F.size(e) > 0) & F.forall(e, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.when(fine, F.transform(e, lambda x: F.floor(x * scale).cast("long")))


class Lists:
    """A segment as posting lists, one for each dimension."""

    def __init__(self, vector: np.ndarray, dimension: np.ndarray, weight: np.ndarray):
        self.lists = [(int(dimension[x]), vector[x:y], weight[x:y, None]) for x, y in _runs(dimension)]
        self.narrow = [(d, v, w.astype(np.float32)) for d, v, w in self.lists]

    def add(self, scores: np.ndarray, by_dimension: np.ndarray, passed: np.ndarray | None) -> int:
        """Add what the postings give to the scores, but for vectors that are ``passed``; the number of postings read."""
        n_read = 0
        for dimension, vector, weight in self.narrow if scores.dtype == np.float32 else self.lists:
            row = by_dimension[dimension]
            if not row.any():
                continue
            if passed is not None:
                kept = np.flatnonzero(~passed[vector])
                vector, weight = vector[kept], weight[kept]
            scores[vector] += weight * row
            n_read += len(vector)
        return n_read


class Matrix:
    """A segment that fills much of its cells as a matrix of its postings, which costs less than lists then."""

    def __init__(self, vector: np.ndarray, dimension: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        self.table = np.zeros(shape)
        self.table[vector, dimension] = weight
        self.narrow = self.table.astype(np.float32)
        self.n = np.bincount(vector, minlength=shape[0])

    def add(self, scores: np.ndarray, by_dimension: np.ndarray, passed: np.ndarray | None) -> int:
        table = self.narrow if scores.dtype == np.float32 else self.table
        by_dimension = by_dimension[: table.shape[1]]
        if passed is None:
            scores += table @ by_dimension
            return int(self.n.sum())
        scores[~passed] += table[~passed] @ by_dimension
        return int(self.n[~passed].sum())


class ImpactIndex:
    """The posting segments of one block, by descending quantised impact.

    ``flat`` and ``ends`` are the components of all vectors and where each ends; ``ids`` and ``copies`` belong
    to the vectors."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, flat: np.ndarray, ends: np.ndarray):
        self.ids, self.copies = ids, copies
        self.n = len(ids)
        size = np.diff(ends)
        vector = np.repeat(np.arange(self.n), size)
        dimension = np.arange(len(flat)) - np.repeat(ends[:-1], size)
        has = np.flatnonzero(flat)
        self.vector, self.dimension, self.value = vector[has], dimension[has], flat[has]  # by vector, for rescoring
        self.starts = np.searchsorted(self.vector, np.arange(self.n + 1))
        weight = self.value.astype(np.float64)
        impact = np.frexp(np.abs(weight))[1]
        order = np.lexsort((self.dimension, -impact))
        self.top = float(np.abs(weight).max(initial=0))
        self.norm = np.sqrt(np.bincount(self.vector, weights=weight**2, minlength=self.n))
        width = int(self.dimension.max(initial=-1)) + 1
        self.segments, self.rest = [], []
        for a, b in _runs(impact[order]):
            own = order[a:b]
            if len(own) >= DENSE * self.n * width:
                self.segments.append(Matrix(self.vector[own], self.dimension[own], weight[own], (self.n, width)))
            else:
                self.segments.append(Lists(self.vector[own], self.dimension[own], weight[own]))
            unread = order[b:]
            squares = np.bincount(self.vector[unread], weights=weight[unread] ** 2, minlength=self.n)
            self.rest.append(np.sqrt(squares) * (1 + 1e-12))

    def candidates(self, queries: np.ndarray, k: int, own: list[int]) -> list[tuple[np.ndarray, int]]:
        """For each query (a row) the vectors that may be among its k best, and how many postings were read for it;
        ``own``: the vector of which one copy is the query itself, or -1."""
        every = np.arange(self.n)
        out = [(np.delete(every, at) if at >= 0 and self.copies[at] == 1 else every, 0) for at in own]
        if self.n <= max(k, RESCORE):
            return out
        going = np.arange(len(queries))
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        most = self._most(queries)
        kind = np.float32 if most < NARROW else np.float64
        # what rounding may have moved a score by: an ulp of the sum of sizes for each addition
        rounded = self.norm * (queries.shape[1] + 4) * 2.0**-52 if most >= EXACT else np.zeros(self.n)
        by_dimension = np.ascontiguousarray(queries.T.astype(kind))
        scores = np.zeros((self.n, len(queries)), dtype=kind)
        passed = np.zeros(self.n, dtype=bool)  # ruled out for all queries that go on
        for segment, rest in zip(self.segments, self.rest):
            n_read = segment.add(scores, by_dimension, passed if 4 * np.count_nonzero(passed) > 3 * self.n else None)
            for at in going:
                out[at] = out[at][0], out[at][1] + n_read
            last = segment is self.segments[-1]
            if not last and (2 * rest.min() * length >= np.ptp(scores, axis=0)).all():
                continue  # no bound can rule out any vector yet
            slack = (rest + rounded)[:, None] * length[None, :]
            low = scores - slack
            for column, at in enumerate(going):
                if own[at] >= 0 and self.copies[own[at]] == 1:
                    low[own[at], column] = -np.inf
            kth = np.partition(np.ascontiguousarray(low.T), self.n - k, axis=1)[:, self.n - k]
            possible = scores + slack >= kth[None, :]
            counts = possible.sum(axis=0)
            done = (counts <= RESCORE) | last
            for column in np.flatnonzero(done):
                at = going[column]
                members = np.flatnonzero(possible[:, column])
                out[at] = members[members != own[at]] if own[at] >= 0 and self.copies[own[at]] == 1 else members, out[at][1]
            if done.all():
                break
            left = ~done
            going, length = going[left], length[left]
            scores, by_dimension = np.ascontiguousarray(scores[:, left]), np.ascontiguousarray(by_dimension[:, left])
            passed = ~possible[:, left].any(axis=1)
        return out

    def _most(self, queries: np.ndarray) -> float:
        """No score or part of one is larger."""
        return queries.shape[-1] * float(np.abs(queries.astype(np.float64)).max(initial=0)) * self.top * (1 + 1e-9)

    def search_all(self, query_ids: np.ndarray, queries: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and exact scores of its k best rows, without one row that is the query itself."""
        width = max(int(self.dimension.max(initial=-1)) + 1, max(map(len, queries), default=0))
        for first in range(0, len(queries), TOGETHER):
            part = queries[first : first + TOGETHER]
            wide = np.zeros((len(part), width), dtype=np.int64)
            for row, query in zip(wide, part):
                row[: len(query)] = query
            own = [self._own(i, query) for i, query in zip(query_ids[first : first + TOGETHER], part)]
            for row, at, (members, _) in zip(wide, own, self.candidates(wide, k, own)):
                yield self._exact(row, members, at, k)

    def _exact(self, wide: np.ndarray, members: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the members by their exact scores."""
        size = self.starts[members + 1] - self.starts[members]
        stops = np.cumsum(size)
        at = np.repeat(self.starts[members] - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)
        kind = np.int64 if self._most(wide) < EXACT else object
        parts = self.value[at].astype(kind) * wide[self.dimension[at]].astype(kind)
        total = np.concatenate([np.zeros(1, dtype=kind), np.cumsum(parts)])
        exact = total[stops] - total[stops - size]
        if kind is object:
            best = np.array(sorted(range(len(members)), key=lambda i: (-exact[i], self.ids[members[i]])), dtype=np.int64)
        else:
            best = np.lexsort((self.ids[members], -exact))
        copies = self.copies[members[best]] - (members[best] == own)
        best = np.repeat(best, np.minimum(copies, k))[:k]
        return self.ids[members[best]], exact[best]

    def _own(self, query_id: int, query: np.ndarray) -> int:
        """The vector that has the query's id and components, or -1."""
        for at in np.flatnonzero(self.ids == query_id):
            mine = slice(self.starts[at], self.starts[at + 1])
            has = np.flatnonzero(query)
            if np.array_equal(self.dimension[mine], has) and np.array_equal(self.value[mine], query[has]):
                return int(at)
        return -1


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    cut = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return list(zip(cut, cut[1:])) if len(keys) else []


def _blocks(vectors: DataFrame, n: int, name: str) -> DataFrame:
    """About equal blocks, one row each: ids, copies and vectors in one order."""
    return (
        vectors.withColumn(name, F.pmod(F.xxhash64("id", "vector"), F.lit(n)))
        .groupBy(name)
        .agg(F.sort_array(F.collect_list(F.struct("id", "vector", "n"))).alias("rows"))
        .select(name, *[F.col(f"rows.{c}").alias(f"{name}_{c}") for c in ("id", "n", "vector")])
    )


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for every row of ``queries``: query_id, rank, vec_id, score.

    Both inputs have the columns ``id`` and ``vector`` (array of long, null: takes no part); of the rows with a
    query's own id and vector one is the query's own. Query batches are copied once for each block."""
    def clean(df: DataFrame) -> DataFrame:
        whole = F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())
        rows = df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<long>").alias("vector")).where(whole)
        return rows.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("n"))

    vectors, queries = clean(vectors), clean(queries)
    n_blocks, n_batches = (-(-max(df.count(), 1) // most) for df, most in ((vectors, BLOCK), (queries, BATCH)))
    blocks = _blocks(vectors, n_blocks, "block")
    batches = _blocks(queries, n_batches, "batch").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    pairs = batches.join(blocks.hint("shuffle_merge"), "block").select(
        "block_id", "block_n", "block_vector", "batch", "batch_id", "batch_n", "batch_vector"
    )

    def score(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, last = None, None
        for table in tables:
            for i in range(table.num_rows):
                ids, copies, rows, batch, query_ids, query_copies, query_rows = (c[i] for c in table.columns)
                if last is None or not ids.equals(last):
                    last = ids
                    index = ImpactIndex(ids.values.to_numpy(), copies.values.to_numpy(), *_flat(rows))
                flat, ends = _flat(query_rows)
                asked = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
                named = query_ids.values.to_numpy()
                out = [
                    (nth, int(n), int(query), *best)
                    for nth, (query, n, best) in enumerate(zip(named, query_copies.values.to_numpy(), index.search_all(named, asked, k)))
                ]
                found = [len(x[3]) for x in out]
                columns = [np.full(sum(found), batch.as_py()), *(np.repeat([x[c] for x in out], found) for c in range(3))]
                exact = np.concatenate([x[4] for x in out])
                columns += [np.concatenate([x[3] for x in out]), *_digits(exact)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = [c.split()[0] for c in PAIRS.split(", ")]
    best = Window.partitionBy("batch", "nth").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id")
    return (
        pairs.mapInArrow(score, PAIRS)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # query rows that are the same
        .select("query_id", "rank", "vec_id", "score")
    )


def _digits(exact: np.ndarray) -> list[np.ndarray]:
    """Whole numbers of any size as the nearest 64-bit one, and in three digits by which they are ordered."""
    if exact.dtype != object:
        return [exact, exact >> 63, exact >> _HALF & (1 << _HALF) - 1, exact & (1 << _HALF) - 1]
    near = [min(max(x, -(2**63)), 2**63 - 1) for x in exact]
    high, middle, low = ([x >> 2 * _HALF for x in exact], [x >> _HALF & (1 << _HALF) - 1 for x in exact], [x & (1 << _HALF) - 1 for x in exact])
    return [np.array(c, dtype=np.int64) for c in (near, high, middle, low)]


def _flat(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list of vectors, and where each vector ends."""
    ends = rows.values.offsets.to_numpy().astype(np.int64)
    return rows.values.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]
