"""Substrings by a stored index of n-grams: which granules of rows may hold a string, then which rows do.

A granule is ``GRANULE`` consecutive ids, a block ``BITS`` consecutive granules. The index has a row for each gram of ``SIZE`` characters
and block that has it, with a bit for each of the block's granules, in folders by the gram's hash. A string can only stand in a granule
that has all its grams, so a search reads the folders of its grams, intersects their bits and verifies the rows of the granules that are
left. Strings of fewer characters have no gram: they are looked for in every row. Letters are compared in lower case.

A build deals the rows to tasks by block, about ``SHARE`` rows each, and finds the grams of a granule at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, GRANULE, BITS, FOLDERS, SHARE = 3, 32, 64, 16, 8192


def grams(text: Column, size: int = SIZE) -> Column:
    """The distinct runs of ``size`` characters of a text, found in one pass over it; none if it is shorter."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _codes(texts: list[str], size: int):
    """The distinct grams of some texts as whole numbers, 21 bits a character."""
    import numpy as np

    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    whose = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inside = whose[:n] == whose[size - 1 :]  # a gram does not go on into the next text
    codes = np.sort(sum(points[i : n + i] << 21 * i for i in range(size))[inside])
    return codes[np.diff(codes, prepend=-1) != 0]


def _text_of(code: int, size: int) -> str:
    return "".join(chr(code >> 21 * i & 0x1FFFFF) for i in range(size))


def _granule(doc: str) -> Column:
    return F.floor(F.col(doc) / GRANULE).cast("long")


def _block(doc: str) -> Column:
    return F.floor(F.col(doc) / (GRANULE * BITS)).cast("long")


def _folder(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _grams_of(strings: DataFrame) -> DataFrame:
    """string and gram of the distinct strings, as a build finds them."""
    size = SIZE

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(s, _text_of(c, size)) for s in batch.column(0).to_pylist() for c in _codes([s], size).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["string", "gram"])

    return strings.select("string").distinct().mapInArrow(work, "string string, gram string")


class GramIndex:
    """An index at ``path`` over the texts of rows (doc, text)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def create(self, rows: DataFrame) -> GramIndex:
        """Index the rows; those without an id or text are not found."""
        rows, tasks = rows.where("doc is not null and text is not null"), self._tasks(rows)
        low = rows.select(_block("doc").alias("block"), _granule("doc").alias("granule"), "text").repartition(tasks, "block")
        low = low.sortWithinPartitions("block", "granule").select("block", (F.col("granule") - F.col("block") * BITS).cast("int").alias("place"), F.lower("text").alias("low"))
        size = SIZE

        def post(group):
            import numpy as np

            place, texts = group["place"].to_numpy(), group["low"]
            first = np.flatnonzero(np.diff(place, prepend=-1))
            found, bits = [], []
            for a, b in zip(first, np.append(first[1:], len(place))):
                found.append(_codes(texts[a:b].to_pylist(), size))
                bits.append(np.full(len(found[-1]), np.uint64(1) << np.uint64(place[a]), dtype=np.uint64))
            found, bits = np.concatenate(found), np.concatenate(bits)
            order = np.argsort(found, kind="stable")
            found, bits = found[order], bits[order]
            first = np.flatnonzero(np.diff(found, prepend=-1))
            every = np.bitwise_or.reduceat(bits, first) if len(first) else bits
            named = pa.array([_text_of(c, size) for c in found[first].tolist()], pa.string())
            return pa.table([named, pa.array(np.full(len(first), group["block"][0].as_py()), pa.int64()), pa.array(every.view(np.int64))], ["gram", "block", "bits"])

        each = low.groupBy("block").applyInArrow(post, "gram string, block long, bits long")
        dealt = each.withColumn("folder", _folder("gram")).repartition("folder").sortWithinPartitions("folder", "gram", "block")
        dealt.write.mode("overwrite").partitionBy("folder").parquet(self.path)
        return self

    def _tasks(self, rows: DataFrame) -> int:
        """In how many tasks the rows are handled: more with more rows, so that none gets larger."""
        n = rows.count()
        return max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (GRANULE * BITS))), -(-n // SHARE))

    def read(self) -> DataFrame:
        return self.spark.read.schema("gram string, block long, bits long, folder int").parquet(self.path)

    def _met(self, strings: DataFrame) -> DataFrame:
        """string, block and the bits of its granules where each of ``strings`` may be."""
        asked = _grams_of(strings).withColumn("folder", _folder("gram"))
        sizes = asked.groupBy("string").agg(F.count(F.lit(1)).alias("n"))
        met = self.read().join(asked, ["folder", "gram"]).groupBy("string", "block").agg(F.count(F.lit(1)).alias("has"), F.bit_and("bits").alias("bits"))
        return met.join(sizes, "string").where((F.col("has") == F.col("n")) & (F.col("bits") != 0)).select("string", "block", "bits")

    def candidates(self, strings: DataFrame) -> DataFrame:
        """string and granule: where each of ``strings`` (string, of ``SIZE`` characters or more) may be."""
        each = self._met(strings).select("string", "block", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("place"))
        return each.where(F.getbit("bits", F.col("place")) == 1).select("string", (F.col("block") * BITS + F.col("place")).alias("granule"))

    def find(self, rows: DataFrame, strings: DataFrame) -> DataFrame:
        """string and doc of each of ``strings`` (string, lower case) and each of the indexed rows (doc, text) that holds it.

        The strings of a block meet its rows in one group, so a text is read once for all of them."""
        long, short = strings.where(F.length("string") >= SIZE), strings.where((F.length("string") > 0) & (F.length("string") < SIZE))
        low = rows.where("doc is not null and text is not null").select("doc", F.lower("text").alias("low"), _block("doc").alias("block"))
        every = short.select("string").distinct().crossJoin(low.select("block").distinct()).select("string", "block", F.lit(-1).cast("long").alias("bits"))
        low, tasks = low.withColumn("place", (_granule("doc") - F.col("block") * BITS).cast("int")), self._tasks(rows)
        asked, granules = self._met(long).unionByName(every).withColumnRenamed("block", "of"), BITS

        def verify(group, asked):
            import numpy as np

            strings, bits, doc = asked["string"].combine_chunks(), asked["bits"].to_numpy().view(np.uint64), group["doc"].to_numpy()
            if not len(strings) or not len(doc):
                return pa.table([pa.array([], pa.string()), pa.array([], pa.int64())], ["string", "doc"])
            may = [np.flatnonzero(bits >> np.uint64(i) & np.uint64(1)).tolist() for i in range(granules)]
            said, n, hits = strings.to_pylist(), [], []
            for place, text in zip(group["place"].to_pylist(), group["low"].to_pylist()):
                own = [i for i in may[place] if said[i] in text]
                n.append(len(own))
                hits.extend(own)
            return pa.table([strings.take(pa.array(hits, pa.int64())), pa.array(np.repeat(doc, n), pa.int64())], ["string", "doc"])

        met = low.repartition(tasks, "block").groupBy("block").cogroup(asked.repartition(tasks, "of").groupBy("of"))
        return met.applyInArrow(verify, "string string, doc long")


def matches(index: GramIndex, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query, doc and score: the share of a query's distinct words (query, term) that a row (doc, text) holds as substrings; rows with none are left out."""
    sizes = queries.groupBy("query").agg(F.countDistinct("term").alias("n"))
    found = index.find(rows, queries.select(F.col("term").alias("string")).distinct())
    hits = queries.distinct().join(found, queries.term == found.string).groupBy("query", "doc").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(sizes, "query").select("query", "doc", (F.col("hits") / F.col("n")).alias("score"))


def held(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query and doc of the rows (doc, text: short ones) that hold a term of the query (query, term), without an index: text and term
    meet in the first ``SIZE`` characters of the term (or all of them), then it is verified."""
    asked = queries.where("term <> ''").withColumn("gram", F.substring("term", 1, SIZE))
    low = rows.select("doc", F.lower("text").alias("low"))
    every = F.array_distinct(F.concat(*[grams(F.col("low"), n) for n in range(1, SIZE + 1)]))
    met = low.withColumn("gram", F.explode(every)).join(asked, "gram").where(F.contains(F.col("low"), F.col("term")))
    return met.select("query", "doc").distinct()
