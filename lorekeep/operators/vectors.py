"""Vector operators: quantised vectors, cosine, nearest neighbours and similarity joins.

Nearest neighbours meet in blocks: vectors are dealt into blocks of about ``BLOCK`` rows, queries into batches
of about ``BATCH``, and each batch meets every block of its key in matrix products that return at most k rows a query. A task
holds one block and ``GROUP`` batches at a time, whatever the tables' sizes. So nothing is broadcast, and neither side needs a bound."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, BATCH = 8192, 1024
#: Batches that meet a block, and blocks that meet another one, in one group; rows of a product that are made at a time.
GROUP, FEW, SLICE = 16, 4, 256
#: Vectors that are copied as they are; others as doubles.
NARROW = ("array<tinyint>", "array<smallint>", "array<int>", "array<float>")


def quantised(vector: Column) -> Column:
    """int8 values: clamp(round_half_even(127 x))."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x.cast("double") * 127).cast("int"))).cast("byte"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Length of a vector; 1 for the zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, n).otherwise(F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _dealt(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows (id, v, key) as one row for each block of a key, of about ``most`` rows; values keep their width, as they are copied."""
    clean = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    sizes = clean.groupBy("key", F.size("v").alias("width")).agg(F.ceil(F.count(F.lit(1)) / most).alias("blocks"))
    own = dict(rows.dtypes)["v"]
    kind = own if own in NARROW else "array<double>"
    return (
        clean.withColumn("width", F.size("v"))
        .join(sizes, ["key", "width"])
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .groupBy("key", "width", "block", "blocks")
        .agg(F.collect_list(F.struct("id", F.col("v").cast(kind).alias("v"))).alias("rows"))
        .select("key", "width", F.col("block").alias(name), F.col("blocks").alias(f"{name}s"), F.col("rows.id").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_v"))
    )


def _reader():
    """A function, sent with its plan, that makes of a block's vectors a matrix of doubles and their lengths (1 for the zero vector)."""

    def matrix(rows: pa.ListScalar):
        import numpy as np

        flat = rows.values.values.to_numpy(zero_copy_only=False)[rows.values.offsets[0].as_py() : rows.values.offsets[-1].as_py()]
        m = flat.reshape(len(rows.values), -1).astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", m, m))
        return m, np.where(length > 0, length, 1)

    return matrix


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, key: str | None = None) -> DataFrame:
    """query, doc, sim, rank: the k nearest vectors of each query by cosine, ties to the smaller id.

    ``vectors`` has (doc, v), ``queries`` (query, q), each id once; a query is not its own neighbour. With ``key`` both have
    that column, and a query meets the vectors of its key only (nulls are one key). Vectors that are null, empty or
    hold nulls, or have another length than the query, are no neighbours."""
    own = F.col(key).cast("string") if key else F.lit("")
    tagged = F.when(own.isNull(), "none").otherwise(F.concat(F.lit("key "), own))
    kinds = dict(vectors.dtypes)["doc"], dict(queries.dtypes)["query"]
    schema = f"query {kinds[1]}, doc {kinds[0]}, sim double"
    blocks = _dealt(vectors.select(F.col("doc").alias("id"), "v", tagged.alias("key")), BLOCK, "block")
    batches = _dealt(queries.select(F.col("query").alias("id"), F.col("q").alias("v"), tagged.alias("key")), BATCH, "batch")
    counts = blocks.groupBy("key", "width").agg(F.first("blocks").alias("blocks"))
    groups = batches.groupBy("key", "width").agg(F.ceil(F.first("batchs") / GROUP).alias("groups"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = batches.join(counts, ["key", "width"]).withColumn("block", each("blocks")).withColumn("group", F.floor(F.col("batch") / GROUP))
    held = blocks.join(groups, ["key", "width"]).withColumn("group", each("groups"))
    at = ["key", "width", "block", "group"]
    asked, held = asked.select(*at, "batch_ids", "batch_v"), held.select(*at, "block_ids", "block_v")

    matrix, slice_rows = _reader(), SLICE

    def best(block: pa.Table, batches: pa.Table) -> pa.Table:
        import numpy as np

        out = []
        if block.num_rows:
            (v, length), ids = matrix(block["block_v"][0]), np.asarray(block["block_ids"][0].values)
        for i in range(batches.num_rows if block.num_rows else 0):
            (q, query_length), query_ids = matrix(batches["batch_v"][i]), np.asarray(batches["batch_ids"][i].values)
            n = min(k, len(ids))
            for first in range(0, len(q), slice_rows):
                part = slice(first, first + slice_rows)
                sims = (q[part] @ v.T) / (query_length[part, None] * length[None, :])
                sims[query_ids[part, None] == ids[None, :]] = -np.inf
                least = np.partition(sims, len(ids) - n, axis=1)[:, len(ids) - n] - 1e-9
                for at in range(len(sims)):
                    near = np.flatnonzero((sims[at] >= least[at]) & np.isfinite(sims[at]))
                    # once more, in one order of summation, so that equal vectors are equally near
                    exact = np.einsum("ij,j->i", v[near], q[first + at]) / (query_length[first + at] * length[near])
                    order = np.lexsort((ids[near], -exact))[:k]
                    out.append((np.full(len(order), query_ids[first + at]), ids[near[order]], exact[order]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, named)], ["query", "doc", "sim"])

    from pyspark.sql.pandas.types import to_arrow_type

    named = [to_arrow_type(queries.schema["query"].dataType), to_arrow_type(vectors.schema["doc"].dataType), pa.float64()]
    scored = held.groupBy(*at).cogroup(asked.groupBy(*at)).applyInArrow(best, schema)
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """a < b, sim of all pairs of ``vectors`` (doc, v) whose cosine reaches the threshold: every two blocks meet in
    matrix products, and only pairs that reach it leave it. Vectors of other lengths are never similar.

    A block meets groups of the blocks behind it, so no task holds more than a group at a time."""
    kind = dict(vectors.dtypes)["doc"]
    blocks = _dealt(vectors.select(F.col("doc").alias("id"), "v", F.lit("").alias("key")), BLOCK, "block")
    at, behind = ["width", "far", "group"], F.sequence(F.floor(F.col("block") / FEW), F.floor((F.col("blocks") - 1) / FEW))
    own = blocks.withColumn("group", F.explode(behind)).select("width", F.col("block").alias("far"), "group", "block", "block_ids", "block_v")
    others = blocks.withColumn("of_far", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))))
    others = others.select(F.col("width").alias("of_width"), "of_far", F.floor(F.col("block") / FEW).alias("of_group"), F.col("block").alias("far_block"), F.col("block_ids").alias("far_ids"), F.col("block_v").alias("far_v"))

    matrix, slice_rows = _reader(), SLICE

    def close(mine: pa.Table, group: pa.Table) -> pa.Table:
        import numpy as np

        def unit(rows):
            m, length = matrix(rows)
            return m / length[:, None]

        out = []
        if mine.num_rows:
            ids, v = np.asarray(mine["block_ids"][0].values), unit(mine["block_v"][0])
        for i in range(group.num_rows if mine.num_rows else 0):
            far_ids, far, same = np.asarray(group["far_ids"][i].values), unit(group["far_v"][i]), group["far_block"][i] == mine["block"][0]
            for first in range(0, len(v), slice_rows):
                x, y = np.nonzero(v[first : first + slice_rows] @ far.T >= threshold)
                x = x + first
                sim = np.einsum("ij,ij->i", v[x], far[y])
                a, b = np.minimum(ids[x], far_ids[y]), np.maximum(ids[x], far_ids[y])
                one = (ids[x] < far_ids[y]) if same else (a < b)
                out.append((a[one], b[one], sim[one]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (named, named, pa.float64()))], ["a", "b", "sim"])

    from pyspark.sql.pandas.types import to_arrow_type

    named = to_arrow_type(vectors.schema["doc"].dataType)
    return own.groupBy(*at).cogroup(others.groupBy(*[f"of_{c}" for c in at])).applyInArrow(close, f"a {kind}, b {kind}, sim double")


def neighbour_pairs(knn: DataFrame, threshold: float) -> DataFrame:
    """Unordered pairs a < b of a neighbour table whose similarity reaches the threshold."""
    return (
        knn.where(F.col("sim") >= threshold)
        .select(F.least("query", "doc").alias("a"), F.greatest("query", "doc").alias("b"), "sim")
        .groupBy("a", "b")
        .agg(F.max("sim").alias("sim"))
    )


def density(knn: DataFrame) -> DataFrame:
    """Mean similarity to the neighbours: low for outliers."""
    return knn.groupBy("query").agg(F.avg("sim").alias("density"))


def stub_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic embedding without a model: hashed tokens, signed, summed and scaled to length 1."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")
    sign = lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    zero = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.lit(0.0))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.aggregate(F.filter(words, lambda w: slot(w) == i), F.lit(0.0), lambda s, w: s + sign(w)),
    )
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(raw, lambda x: x / length)).otherwise(zero)
