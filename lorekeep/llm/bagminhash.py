"""Near-duplicates by BagMinHash signatures of shingle multisets, bands, and verified multiset overlap.

A text is the multiset of its shingles of ``SHINGLE`` words. A shingle's weight axis is cut into dyadic
strata [0,1), [1,2), [2,4), ...; each has a Poisson process of its own, whose points have a time, a
register and a cell of the stratum. A shingle of weight w takes the points in cells below w, so two texts
share exactly the points below their smaller weight, and a register's earliest point agrees with the
probability of the weighted Jaccard similarity. A process is followed only while its times are before the
last time that the text's registers still need.

Texts with equal multisets are one node. Signatures are cut into ``BANDS`` bands of ``ROWS`` registers;
nodes that agree in a band meet in a bucket. Two nodes are linked if the exact overlap of their multisets is at
least the threshold; there is no other rule. In buckets of at most ``SMALL`` nodes all pairs are counted. Larger
ones are dealt into blocks of bounded size: every block is first counted against the bucket's leader (its
smallest node), and in buckets that still hold several components every two blocks are counted. A block
counts all overlaps at once and returns only links that join components, so no group emits its pairs. When
the components, the classes, are known, the links of each node are counted over all pairs of its class, in
blocks again, which sum up links and emit none. So nothing that a bucket holds is left uncounted, and a pair
that no bucket holds is still counted if its nodes are of one class.
A pair at the threshold misses all bands with a probability of 3e-5, less for more similar ones.

Defined cases: texts of 1 to 4 words are one shingle; null texts and texts without words resemble
nothing and are their own class. Words are runs of letters and digits, lower-cased. A class is named by
its smallest id; rows without an id join classes (null where no row of a class has one). Rows that repeat
id and text are kept, one result for each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, text_of, tidy, word_hashes, written
from .components import components

SHINGLE = 5
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
SLICE_WORDS = 400_000
SMALL = 8
#: A block has about so many nodes at most, and about so many elements (8 bytes each) unless one node has more.
BLOCK, BLOCK_ELEMENTS = 384, 1_000_000
#: Elements of at least so many sets of a block are counted by a matrix product.
COMMON = 8

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EDGES = "a binary, b binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash and weight of each distinct shingle of the texts ``words[ends[i]:ends[i+1]]``."""
    n = len(words)
    size = np.diff(ends)
    text = np.repeat(np.arange(len(size)), size)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, n)):
        rolled[: n - k] = _mix(rolled[: n - k] * _GOLD + words[k:])
    place = np.arange(n) - ends[:-1][text]
    whole = place + SHINGLE <= size[text]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    extra = [_short(words[ends[i] : ends[i + 1]]) for i in short]
    text, hashes = np.concatenate([text[whole], short]), np.concatenate([rolled[whole], np.array(extra, dtype=np.uint64)])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return text[first], hashes[first], np.diff(np.append(first, len(text)))


def _short(words: np.ndarray) -> np.uint64:
    out = np.full(1, len(words), dtype=np.uint64)
    for w in words:
        out = _mix(out * _GOLD + w)
    return out[0]


def occurrences(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multiset as a set: one element for each occurrence of a shingle, and its text number."""
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(text, weight), _mix(np.repeat(hashes, weight) + nth.astype(np.uint64) * _GOLD)


def signatures(text: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """The BagMinHash signature (earliest time of each register) of each text; ``inf`` without shingles."""
    out = np.full(n_texts * registers, np.inf)
    strata = np.ceil(np.log2(weight)).astype(np.int64) + 1  # those that begin below the weight
    process = np.repeat(np.arange(len(text)), strata)
    stratum = np.arange(len(process)) - np.repeat(np.cumsum(strata) - strata, strata)
    start = np.where(stratum > 0, 1 << np.maximum(stratum - 1, 0), 0)
    length = np.maximum(start, 1).astype(np.float64)
    below = weight[process] - start
    of = text[process]
    seed = _mix(hashes[process] + (stratum.astype(np.uint64) + np.uint64(1)) * _GOLD)
    time = np.zeros(len(process))
    step = np.zeros(1, dtype=np.uint64)
    while len(of):
        step = step + np.uint64(1)
        a, b = _mix(seed + step * _GOLD), _mix(~seed + step * _GOLD)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        cell = np.floor((b >> np.uint64(32)).astype(np.float64) * 2.0**-32 * length)
        register = ((b & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)
        taken = cell < below
        np.minimum.at(out, of[taken] * registers + register[taken].astype(np.int64), time[taken])
        texts, where = np.unique(of, return_inverse=True)
        need = out.reshape(n_texts, registers)[texts].max(axis=1)
        alive = time < need[where]
        of, seed, time, length, below = (x[alive] for x in (of, seed, time, length, below))
    return out.reshape(n_texts, registers)


def _digests(text: np.ndarray, elements: np.ndarray, n_texts: int) -> list[bytes | None]:
    """128 bits of each text's multiset that do not depend on its order; None without shingles."""
    out = np.zeros((n_texts, 2), dtype=np.uint64)
    if len(text):
        first = np.flatnonzero(np.diff(text, prepend=-1))
        for k in (0, 1):
            out[text[first], k] = np.add.reduceat(_mix(elements + np.array([k + 1], dtype=np.uint64) * _GOLD), first)
    has = np.zeros(n_texts, dtype=bool)
    has[text] = True
    return [row.tobytes() if h else None for row, h in zip(out, has)]


def _slices(words: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text, words and ends of slices of about ``SLICE_WORDS`` words."""
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.to_numpy().view(np.uint64)
    first = 0
    while first < len(words):
        stop = int(np.searchsorted(ends, ends[first] + SLICE_WORDS, side="right")) - 1
        stop = min(max(stop, first + 1), len(words))
        yield first, stop, flat[ends[first] : ends[stop]], ends[first : stop + 1] - ends[first]
        first = stop


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, node (digest of the multiset), bands and n_elements (the multiset's size) of each row."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_of(text_col)).alias("text_hash"),
        word_hashes(text_of(text_col)).alias("words"),
    )
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, words, ends in _slices(batch.column(2)):
                n = stop - first
                text, hashes, weight = shingles(words, ends)
                nodes = _digests(*occurrences(text, hashes, weight), n)
                bits = signatures(text, hashes, weight, n).view(np.uint64)
                keys = np.zeros((n, BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    keys = _mix(keys * _GOLD + bits[:, r::ROWS])
                size = np.bincount(text, weights=weight, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        batch.column(1).slice(first, n),
                        pa.array(nodes, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.view(np.int64).ravel())
                        ),
                        pa.array(size),
                    ],
                    ["id", "text_hash", "node", "bands", "n_elements"],
                )

    return rows.mapInArrow(tidy(work), f"id {kind}, text_hash long, node binary, bands array<long>, n_elements long")


def _elements(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and sorted ``elements`` (its multiset as a set) of the documents named in ``wanted``."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    named = wanted.select(F.col("id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    found = rows.join(named, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, words, ends in _slices(batch.column(0)):
                text, elements = occurrences(*shingles(words, ends))
                nodes = _digests(text, elements, stop - first)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=stop - first))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(elements.view(np.int64))),
                    ],
                    ["node", "elements"],
                )

    return found.select(word_hashes(F.col("text")).alias("words")).mapInArrow(tidy(work), "node binary, elements array<long>")


def _pair_links(rows: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Links inside small buckets; ``rows`` has (bucket, node). A node has few partners here, so it is no hot key."""
    one, two = (rows.select("bucket", F.col("node").alias(x)) for x in "ab")
    pairs = written(one.join(two, "bucket").where("a < b").select("a", "b").distinct(), "pairs")
    both = pairs.join(elements.toDF("a", "elements_a"), "a").join(elements.toDF("b", "elements_b"), "b")
    shared = F.size(F.array_intersect("elements_a", "elements_b"))
    union = F.size("elements_a") + F.size("elements_b") - F.col("shared")
    kept = both.withColumn("shared", shared).where(F.col("shared") >= union * similarity - 1e-9)
    links = written(kept.select("a", "b"), "links")
    discard(pairs)
    return links


def overlaps(sets: list[np.ndarray], split: int | None = None) -> np.ndarray:
    """The number of shared elements of every two sets, or of those before ``split`` with the others: elements
    of many sets by a matrix product, those of few sets by their own pairs."""
    n = len(sets)
    rows, columns = (n, 0) if split is None else (split, split)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, element, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((rows, n - columns), dtype=np.float32)
    common = np.flatnonzero(seen >= COMMON)
    place = np.full(len(seen), -1)
    for first in range(0, len(common), 4096):
        part = common[first : first + 4096]
        place[:] = -1
        place[part] = np.arange(len(part))
        has = place[element] >= 0
        table = np.zeros((n, len(part)), dtype=np.float32)
        table[owner[has], place[element[has]]] = 1
        out += table[:rows] @ table[columns:].T
    order = np.argsort(element, kind="stable")
    starts = np.cumsum(seen) - seen
    for count in range(2, COMMON):
        own = starts[seen == count]
        members = owner[order[own[:, None] + np.arange(count)]]
        for i in range(count):
            for j in range(count):
                if i != j:
                    x, y = members[:, i], members[:, j]
                    fits = (x < rows) & (y >= columns)
                    np.add.at(out, (x[fits], y[fits] - columns), 1)
    if split is None:
        np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.float64)


def linked(sets: list[np.ndarray], similarity: float, split: int | None = None) -> np.ndarray:
    """Which two sets overlap by at least ``similarity``, as in ``overlaps``; a set is not linked with itself."""
    shared = overlaps(sets, split)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    one, two = (size, size) if split is None else (size[:split], size[split:])
    out = shared >= (one[:, None] + two[None, :] - shared) * similarity - 1e-9
    if split is None:
        np.fill_diagonal(out, False)
    return out


def forest(linked: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the matrix ``linked`` joins and the labels don't yet, a few for each node."""
    out = []
    label = label.copy()
    while True:
        best = np.where(linked, label[None, :], np.iinfo(np.int64).max)
        least = best.argmin(axis=1)
        better = np.flatnonzero(best[np.arange(len(label)), least] < label)
        if not len(better):
            return out
        out += [(int(i), int(least[i])) for i in better]
        for i in better:  # a whole label follows its smallest link
            old, new = label[i], label[least[i]]
            if new < old:
                label[label == old] = new


def _blocks(n, elements):
    """Into how many blocks a group of so many nodes and elements is dealt."""
    return F.ceil(F.greatest(n / BLOCK, elements / BLOCK_ELEMENTS)).cast("long")


def _sets(group: pa.Table) -> list[np.ndarray]:
    return [np.asarray(x.values) for x in group["elements"]]


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])


def _leader_links(rows: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Links of large buckets with their leaders; ``rows`` has (bucket, node, leader, blocks)."""
    dealt = rows.where("node <> leader").select("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("i"), "node", F.lit(False).alias("leads"))
    leaders = rows.where("node = leader").select(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), "node", F.lit(True).alias("leads")
    )
    full = dealt.unionByName(leaders).join(elements, "node")

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("leads", "descending")])
        names = group["node"].to_pylist()
        if len(names) < 2:
            return _edges([])
        return _edges([(names[0], names[1 + i]) for i in np.flatnonzero(linked(_sets(group), similarity, 1)[0])])

    return written(full.groupBy("bucket", "i").applyInArrow(work, _EDGES), "links")


def _met(rows: DataFrame, key: str) -> DataFrame:
    """Every two blocks of a group (``key``, ``blocks``) as one group (``key``, i, j), each node with its own block."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")


def _block_links(rows: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """Links inside large buckets that hold several components; ``rows`` has (bucket, node, root, blocks).

    Every two blocks meet once in a group, which counts all overlaps and returns only the links that join components."""
    full = _met(rows, "bucket").join(elements, "node")

    def work(group: pa.Table) -> pa.Table:
        names = group["node"].to_pylist()
        roots = {r: k for k, r in enumerate(sorted(set(group["root"].to_pylist())))}
        label = np.array([roots[r] for r in group["root"].to_pylist()], dtype=np.int64)
        if len(roots) < 2:
            return _edges([])
        return _edges([(names[i], names[j]) for i, j in forest(linked(_sets(group), similarity), label)])

    return written(full.groupBy("bucket", "i", "j").applyInArrow(work, _EDGES), "links")


def _link_counts(rows: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """node and n_links, over all pairs of a class; ``rows`` has (node, root, n_elements) of every node that has a link.

    Classes that fit a block are packed, some to a group; of larger ones every two blocks meet once."""
    classes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n_elements").alias("total"))
    classes = classes.withColumn("blocks", _blocks(F.col("m"), F.col("total")))
    packs = classes.where("blocks = 1").agg(_blocks(F.sum("m"), F.sum("total"))).first()[0] or 1
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs)).cast("string")).otherwise(F.concat(F.lit("root "), F.hex("root")))
    named = salted_join(rows.drop("n_elements"), classes.where("m > 2"), "root", "node").withColumn("pack", pack)
    full = _met(named, "pack").join(elements, "node")

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("root", "ascending"), ("own", "ascending")])
        names, sets = group["node"].to_pylist(), _sets(group)
        root, own = group["root"].to_pylist(), group["own"].to_numpy()
        cut = [0, *(k for k in range(1, len(root)) if root[k] != root[k - 1]), len(root)]
        n = np.zeros(len(names), dtype=np.int64)
        for a, b in zip(cut, cut[1:]):
            split = int((own[a:b] == own[a]).sum())
            if group["i"][0] == group["j"][0]:
                n[a:b] = linked(sets[a:b], similarity).sum(axis=1)
            elif split < b - a:
                both = linked(sets[a:b], similarity, split)
                n[a:b] = np.concatenate([both.sum(axis=1), both.sum(axis=0)])
        return pa.table([pa.array(names, pa.binary()), pa.array(n)], ["node", "n_links"])

    counted = full.groupBy("pack", "i", "j").applyInArrow(work, "node binary, n_links long")
    pairs = rows.join(classes.where("m = 2"), "root").select("node", F.lit(1).cast("long").alias("n_links"))
    return counted.groupBy("node").agg(F.sum("n_links").alias("n_links")).unionByName(pairs)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, count_links: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: id, ``class_id``, ``is_kept`` (the class's first document) and
    ``n_links``, with how many other multisets of its class the document's own overlaps by ``similarity`` (null without ``count_links``,
    which spares the counts over all pairs of a class).

    ``text_hash`` (xxhash64 of the text) tells rows apart that share an id."""
    signed = written(sign(docs, id_col, text_col), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    nodes = written(
        signed.where("node is not null")
        .groupBy("node")
        .agg(first.alias("first"), F.first("bands").alias("bands"), F.first("n_elements").alias("n_elements"))
        .select("node", "first.id", "first.text_hash", "bands", "n_elements"),
        "nodes",
    )
    banded = nodes.select("node", "n_elements", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.sum("n_elements").alias("total"))
    shared = shared.where("n > 1").select("bucket", "n", "leader", _blocks(F.col("n"), F.col("total")).alias("blocks"))
    buckets = written(salted_join(banded.drop("n_elements"), shared, "bucket", "node"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "id", "text_hash"), "node")
    elements = written(_elements(docs, wanted, id_col, text_col).dropDuplicates(["node"]), "elements")
    large = buckets.where(F.col("n") > SMALL)
    of_pairs = _pair_links(buckets.where(F.col("n") <= SMALL), elements, similarity)
    of_leaders = _leader_links(large, elements, similarity)
    found = of_pairs.unionByName(of_leaders)
    roots = components(found)
    named = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = named.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    of_blocks = _block_links(salted_join(named, split.select("bucket"), "bucket", "node"), elements, similarity)
    discard(roots, buckets)
    roots = components(found.unionByName(of_blocks))
    discard(of_pairs, of_leaders, of_blocks)
    named = nodes.select("node", "id", "text_hash").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named_class = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("head"))
    classes = salted_join(named, named_class, "root", "node").select("node", "head")
    if count_links:
        members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        counts = _link_counts(members.join(nodes.select("node", "n_elements"), "node"), elements, similarity)
        classes = classes.join(counts, "node", "left").na.fill(0, ["n_links"])
    else:
        classes = classes.withColumn("n_links", F.lit(None).cast("long"))
    classes = written(classes, "classes")
    discard(roots, nodes, elements)
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    return (
        signed.select("id", "text_hash", "node")
        .join(classes, "node", "left")
        .withColumn("head", F.coalesce("head", own))
        .select(
            F.col("id").alias(id_col),
            F.col("head.id").alias("class_id"),
            (F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_hash") == F.col("head.text_hash"))).alias("is_kept"),
            (F.coalesce("n_links", F.lit(0)) if count_links else F.col("n_links")).cast("long").alias("n_links"),
            "text_hash",
        )
    )
