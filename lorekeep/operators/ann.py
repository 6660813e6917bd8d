"""Exact nearest int8 vectors from a stored index that is pruned by the triangle inequality.

Vectors are quantised to int8 and dealt to the nearest of a bounded sample of themselves, the centres. A cluster's vectors
lie in blocks by their distance from the centre, so a block is a ring (low, high) of at most ``BLOCK`` vectors. A query at a distance d
from the centre is at least max(low - d, d - high) from every vector of the ring. The kth best distance so
far is a bound that no ring beyond it can beat: it comes first from the centres, which are vectors themselves, then from the rings of the
query's nearest centres, and what it still lets pass is read. Distances are whole numbers (squares of L2), so equal ones
are told exactly, and go to the smaller id.

Queries and rings meet in tiles: a tile has the rings of whole clusters, or a part of those of one large cluster, and at most about
``VALUES`` values; queries go to a tile once, in chunks of ``CHUNK``, if one of its clusters may hold a neighbour, and a task holds one tile and a group of at most
about ``GROUP`` queries. What a task holds doesn't grow with the tables; the number of such meetings is quadratic where nothing is pruned.

The sample bounds what is broadcast (``CENTRES`` vectors and the size of each cluster), never what is found. Vectors that are null, empty, of another
length than most, or hold nulls or numbers that are not finite are not indexed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.operators.vectors import quantised

CENTRES, BLOCK, NEAR = 1024, 512, 2
#: Values of a tile; queries of a group, of a chunk on the way to its tiles and of one product; vectors that are compared with the centres at once.
VALUES, GROUP, CHUNK, SLICE, STEP = 1 << 21, 32_768, 512, 64, 512

_BLOCKS = "cluster int, block long, low double, high double, n int, ids array<long>, data binary"


def _bytes_of(rows: DataFrame, id_col: str, v_col: str) -> DataFrame:
    """id and the int8 values of each vector that takes part, as bytes (with an offset of 128)."""
    v = F.col(v_col)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    kept = rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), quantised(v).alias("q"))
    hexes = F.transform("q", lambda x: F.lpad(F.hex((x.cast("int") + 128).cast("long")), 2, "0"))
    return kept.select("id", F.unhex(F.array_join(hexes, "")).alias("b"))


class Int8Index:
    """An index at ``path``; ``create`` builds it from rows (doc, v)."""

    def __init__(self, spark: SparkSession, path: str, centres: int = CENTRES, block: int = BLOCK) -> None:
        self.spark, self.path, self.most, self.block = spark, path.rstrip("/"), centres, block

    def create(self, vectors: DataFrame) -> Int8Index:
        rows = _bytes_of(vectors, "doc", "v")
        rows.write.mode("overwrite").parquet(f"{self.path}/bytes")
        rows = self.spark.read.schema("id long, b binary").parquet(f"{self.path}/bytes")
        sizes = rows.groupBy(F.length("b").alias("width")).count().orderBy(F.desc("count"), "width").first()
        width, n = (sizes["width"], sizes["count"]) if sizes else (0, 0)
        own = rows.where(F.length("b") == width)
        chosen = own.orderBy(F.xxhash64("id"), "id").limit(max(1, min(self.most, int(n**0.5)))).collect()  # bounded by CENTRES
        self.spark.createDataFrame([(i, r.id, bytes(r.b)) for i, r in enumerate(chosen)], "cluster int, id long, b binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        ids, table = self._centres()
        block, step = self.block, STEP

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            square = (table * table).sum(axis=1)
            for whole in batches:
                for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                    x = np.array([np.frombuffer(b, dtype=np.uint8) for b in batch.column(1).to_pylist()], dtype=np.float64).reshape(batch.num_rows, width) - 128
                    apart = (x * x).sum(axis=1)[:, None] + square[None, :] - 2 * x @ table.T
                    best = apart.argmin(axis=1)
                    far = np.sqrt(np.maximum(apart[np.arange(len(x)), best], 0))
                    yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), pa.array(far), *batch.columns], ["cluster", "far", "id", "b"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sorted rows as blocks of one cluster each."""
            held: list[tuple] = []

            def done():
                columns = [[held[0][0]], [held[0][2]], [held[0][1]], [held[-1][1]], [len(held)], [[h[2] for h in held]], [b"".join(h[3] for h in held)]]
                kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cluster", "block", "low", "high", "n", "ids", "data"])

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and (row[0] != held[0][0] or len(held) >= block):
                        yield done()
                        held.clear()
                    held.append(row)
            if held:
                yield done()

        near = own.mapInArrow(assign, "cluster int, far double, id long, b binary") if width else rows.selectExpr("0 cluster", "0d far", "id", "b").where("false")
        n_parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = near.repartitionByRange(n_parts, "cluster", "far", "id").sortWithinPartitions("cluster", "far", "id")
        dealt.mapInArrow(cut, _BLOCKS).write.mode("overwrite").parquet(f"{self.path}/blocks")
        return self

    def _centres(self):
        import numpy as np

        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r.cluster)
        return [r.id for r in rows], np.array([np.frombuffer(bytes(r.b), dtype=np.uint8) for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0].b) if rows else 0) - 128

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks")

    def _tiles(self, width: int) -> tuple[list, list[list[int]]]:
        """The clusters (cluster, low, high, n, first tile, its tiles), a row for each, and the clusters of each tile."""
        found = self.blocks().groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("cluster").collect()
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        most = max(self.block, min(sum(r.n for r in found) // parts, VALUES // max(width, 1)))
        clusters, tiles, held = [], [], most
        for r in found:
            own = -(-r.n // most)
            if own > 1 or held + r.n > most:
                tiles += [[] for _ in range(own)]
                held = 0
            for tile in tiles[-own:]:
                tile.append(r.cluster)
            held = most if own > 1 else held + r.n
            clusters.append((r.cluster, r.low, r.high, r.n, len(tiles) - own, own))
        return clusters, tiles

    def _meet(self, asked: DataFrame, k: int, near: bool, bounds: DataFrame | None, tally: bool = False) -> DataFrame:
        """query, doc, dist: the best of each tile in the rings that the bounds let pass, of the nearest clusters of a query or of all others.

        With ``tally``, ``dist`` is how many vectors of a tile are compared, and ``doc`` is 0."""
        ids, table = self._centres()
        width, most, chunk, step = table.shape[1], NEAR, CHUNK, SLICE
        clusters, tiles = self._tiles(width)
        groups = max(1, -(-asked.count() // GROUP))
        rows = asked.withColumn("bound", F.lit(None).cast("double")) if bounds is None else asked.join(bounds, "query", "left")
        rows = rows.where(F.length("b") == width).withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The queries of a chunk that a tile's clusters may have neighbours of, a row for each tile and group."""
            import numpy as np

            named, own, at = np.array(ids), (table * table).sum(axis=1), np.array([c[0] for c in clusters], dtype=np.int64)
            low, high = (np.array([c[i] for c in clusters]) for i in (1, 2))
            places = [np.searchsorted(at, tile) for tile in tiles]
            for whole in batches:
                for batch in (whole.slice(i, chunk) for i in range(0, whole.num_rows if tiles else 0, chunk)):
                    query, group = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                    data = np.array([np.frombuffer(b, dtype=np.uint8) for b in batch.column(1).to_pylist()])
                    x = data.astype(np.float64) - 128
                    apart = np.maximum((x * x).sum(axis=1)[:, None] + own[None, :] - 2 * x @ table.T, 0)
                    nearest = np.array([np.lexsort((named, a))[:most] for a in apart], dtype=np.int32)
                    if near:
                        others = np.where(named[None, :] == query[:, None], np.inf, apart)
                        bound = np.sqrt(np.partition(others, k - 1, axis=1)[:, k - 1]) if len(named) >= k else np.full(len(query), np.inf)
                    else:
                        bound = np.array([np.inf if b is None else b for b in batch.column(2).to_pylist()])
                    far, slack = np.sqrt(apart)[:, at], bound[:, None] + 1e-6
                    passed = (low - far <= slack) & (far - high <= slack) & ((nearest[:, :, None] == at).any(axis=1) == near)
                    out = []
                    for tile, place in enumerate(places):
                        fits = passed[:, place].any(axis=1)
                        for g in np.unique(group[fits]):
                            take = fits & (group == g)
                            out.append((tile, int(g), query[take], data[take].tobytes(), bound[take], nearest[take].ravel()))
                    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int32())]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["to_tile", "to_group", "queries", "asked", "bounds", "near"])

        def best(held: pa.Table, asked: pa.Table) -> pa.Table:
            import numpy as np

            out = []
            if held.num_rows and asked.num_rows:
                doc = np.concatenate([np.asarray(i.values) for i in held["ids"]])
                x = np.concatenate([np.frombuffer(b.as_buffer(), dtype=np.uint8) for b in held["data"]]).reshape(len(doc), -1).astype(np.float64) - 128
                low, high, cluster, n = (held[c].to_numpy() for c in ("low", "high", "cluster", "n"))
                square, centres = (x * x).sum(axis=1), table[cluster]
                centred = (centres * centres).sum(axis=1)
            for i in range(asked.num_rows if held.num_rows else 0):
                query, bound, nearest = (np.asarray(asked[c][i].values) for c in ("queries", "bounds", "near"))
                nearest = nearest.reshape(len(query), -1)
                q = np.frombuffer(asked["asked"][i].as_buffer(), dtype=np.uint8).reshape(len(query), -1).astype(np.float64) - 128
                for part in (slice(a, a + step) for a in range(0, len(q), step)):
                    own, slack = (q[part] * q[part]).sum(axis=1)[:, None], bound[part, None] + 1e-6
                    far = np.sqrt(np.maximum(own + centred - 2 * q[part] @ centres.T, 0))
                    passed = (low - far <= slack) & (far - high <= slack) & ((nearest[part][:, :, None] == cluster).any(axis=1) == near)
                    if tally:
                        read = passed @ n.astype(np.int64)
                        out.append((query[part], np.zeros(len(read), dtype=np.int64), read))
                        continue
                    rings = passed.any(axis=0)
                    if not rings.any():
                        continue
                    some = slice(None) if rings.all() else np.flatnonzero(np.repeat(rings, n))
                    own_ids = doc[some]
                    dist = q[part] @ x[some].T
                    dist *= -2
                    dist += own
                    dist += square[some]
                    dist[query[part, None] == own_ids[None, :]] = np.inf
                    if not passed[:, rings].all():
                        dist[~np.repeat(passed[:, rings], n[rings], axis=1)] = np.inf
                    # no neighbour is beyond the kth that was found in the nearest clusters
                    limit = np.full(len(dist), np.inf) if near else bound[part] ** 2 + 0.5
                    for row, name, end in zip(dist, query[part], limit):
                        at = np.flatnonzero((row <= end) & (row < np.inf))
                        if len(at) > k:
                            close = row[at]
                            at = at[close <= np.partition(close, k - 1)[k - 1]]
                        at = at[np.lexsort((own_ids[at], row[at]))[:k]]
                        out.append((np.full(len(at), name), own_ids[at], row[at].astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
            return pa.table([pa.array(c, pa.int64()) for c in columns], ["query", "doc", "dist"])

        kinds = "to_tile int, to_group int, queries array<long>, asked binary, bounds array<double>, near array<int>"
        dealt = rows.select("query", "b", "bound", "group").mapInArrow(deal, kinds)
        layout = self.spark.createDataFrame([(c, first, own) for c, _, _, _, first, own in clusters], "cluster int, first int, own int")
        held = self.blocks().join(F.broadcast(layout), "cluster").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("block"), F.col("own"))).cast("int"))
        held = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("tile", "group", "cluster", "low", "high", "n", "ids", "data")
        return held.groupBy("tile", "group").cogroup(dealt.groupBy("to_tile", "to_group")).applyInArrow(best, "query long, doc long, dist long")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """query, doc, dist (squared), rank: the ``k`` nearest indexed vectors of each query (query, q), without the query's own id."""
        asked, first, kth = self._first(queries, k)
        rest = self._meet(asked, k, False, kth)
        order = Window.partitionBy("query").orderBy("dist", "doc")
        return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _first(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The queries as bytes, what the nearest clusters of each have, and the bound that these set."""
        from lorekeep.session import stored

        asked = stored(_bytes_of(queries, "query", "q").withColumnRenamed("id", "query"))
        first = stored(self._meet(asked, k, True, None))
        order = Window.partitionBy("query").orderBy("dist", "doc")
        kth = first.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query", F.sqrt("dist").alias("bound"))
        return asked, first, kth

    def share_read(self, queries: DataFrame, k: int) -> DataFrame:
        """One row: how many of all pairs of query and indexed vector ``nearest`` compares (read) of how many there are (pairs)."""
        asked, _, kth = self._first(queries, k)
        read = self._meet(asked, k, True, None, tally=True).unionByName(self._meet(asked, k, False, kth, tally=True)).agg(F.coalesce(F.sum("dist"), F.lit(0)).alias("read"))
        fitting = asked.where(F.length("b") == self._centres()[1].shape[1]).agg(F.count(F.lit(1)).alias("queries"))
        there = self.blocks().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return read.crossJoin(fitting).crossJoin(there).select("read", (F.col("queries") * F.col("n")).alias("pairs"))
