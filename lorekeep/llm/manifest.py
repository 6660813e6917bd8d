"""A Merkle manifest of a dataset: leaves by row, a tree of each source, one tree over the sources.

Rows are dealt by range of (source, id) and numbered inside each range, so no source is one task. A block
is ``ARITY ** LEVELS`` consecutive leaves of a source, held as one ordered array, which ``slice``, ``transform``
and ``aggregate`` collapse by ``LEVELS`` levels (or, where it holds all of its source, until one node is left).
The block roots are the leaves of the next round, so the rounds grow with the logarithm of the largest source. The
subroots of the sources are the leaves of one more tree, built the same way. The proofs come back down: each
round adds the siblings inside its blocks to those of the block's root.

Defined cases: an absent value is written ``-``, so null and empty differ. Rows without an id come first in their
source, rows that repeat an id follow by their leaf, so equal rows are interchangeable. A null source is a source
of its own and comes first. An empty table gives no rows (and has no root). Only the named columns are read, so
others may have any name. A text is hashed whole. ``altered`` leaves only stand for the leaf when roots are recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, sha256, shuffles, written

ARITY = 3
LEVELS = 6
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<left:string,right:string>>"


def leaf_of(**replaced: Column) -> Column:
    """The digest of a row's ``FIELDS``, each with its length in bytes; ``replaced`` gives a field another value."""

    def framed(name: str) -> Column:
        value = replaced.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return sha256(F.concat(*map(framed, FIELDS)))


def _positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``position`` (from 0) in their ``group`` by ``order`` and ``total``, the group's number of rows.

    The rows are stored as they were dealt by range; a group has one small row for each range that holds rows of it."""
    ranged = rows.repartitionByRange(shuffles(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    ranged = written(ranged.withColumn("nth", F.monotonically_increasing_id()).withColumn("range", F.shiftright("nth", 33)), "ranged")
    pieces = ranged.groupBy(F.col(group).alias("of"), F.col("range").alias("in")).agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("of")))
    met = ranged.join(pieces, F.col(group).eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    placed = met.withColumn("position", F.col("nth") - F.col("first") + F.col("before")).drop("nth", "range", "of", "in", "first", "n", "before")
    placed.stored_at = ranged.stored_at
    return placed


def _up(level: Column) -> Column:
    """One level up: the digest of each run of ``ARITY`` nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda run: sha256(F.array_join(F.slice(level, run * ARITY + 1, F.lit(ARITY)), "")))


def _depth(total: Column) -> Column:
    """How many levels a block collapses: all of ``LEVELS``, or as many as leave one node of a group that is one block."""
    depth = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        depth = F.when(total <= ARITY**k, k).otherwise(depth)
    return depth


def _collapse(nodes: DataFrame, label: str, *keep: str) -> DataFrame:
    """The blocks of one round: ``group``, ``block``, ``total``, ``nodes`` (its entries in order) and ``levels``, the lowest first.

    ``nodes`` has ``group``, ``total``, ``position``, ``digest`` and the columns of ``keep``."""
    blocks = (
        nodes.withColumn("block", F.floor(F.col("position") / BLOCK).cast("long"))
        .groupBy("group", "block")
        .agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("position", "digest", *keep))).alias("nodes"))
    )
    climb = F.aggregate(
        F.when(_depth(F.col("total")) > 0, F.sequence(F.lit(1), _depth(F.col("total")))).otherwise(F.array().cast("array<int>")),
        F.array(F.transform("nodes", lambda n: n["digest"])),
        lambda levels, _: F.concat(levels, F.array(_up(F.element_at(levels, -1)))),
    )
    return written(blocks.withColumn("levels", climb), label)


def _roots(blocks: DataFrame) -> DataFrame:
    """The root of each block, as a node of the next round."""
    return blocks.select(
        "group",
        F.ceil(F.col("total") / BLOCK).cast("long").alias("total"),
        F.col("block").alias("position"),
        F.element_at(F.element_at("levels", -1), 1).alias("digest"),
    )


def _path(nth: Column) -> Column:
    """The siblings to the left and right of a block's entry ``nth`` (from 0), for each level but the root's."""
    below = F.slice("levels", F.lit(1), F.size("levels") - 1)

    def step(level: Column, k: Column) -> Column:
        own = F.floor(nth / F.pow(F.lit(ARITY), k)).cast("int")
        run, place = own - own % ARITY, own % ARITY
        left = F.slice(level, run + 1, place)
        right = F.slice(level, own + 2, F.lit(ARITY - 1) - place)
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(below, step)


def _tree(nodes: DataFrame, label: str, *keep: str) -> list[DataFrame]:
    """The stored blocks of every round over ``nodes``, until each group has one node."""
    rounds = [_collapse(nodes, label, *keep)]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        rounds.append(_collapse(_roots(rounds[-1]), label))
    return rounds


def _entries(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Each entry of the blocks with its ``path`` to the end of ``above``, which has ``group``, ``position``, ``path`` of block roots."""
    upper = above.select(F.col("group").alias("of"), F.col("position").alias("as"), F.col("path").alias("upper"), "subroot", "root")
    met = blocks.join(upper, F.col("group").eqNullSafe(F.col("of")) & (F.col("block") == F.col("as")))
    nth = lambda n: (n["position"] - F.col("block") * BLOCK).cast("int")
    entry = F.transform("nodes", lambda n: F.struct(n.alias("node"), F.concat(_path(nth(n)), F.col("upper")).alias("path")))
    return met.select("group", F.explode(entry).alias("e"), "subroot", "root").select("group", "e.node.*", "e.path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: sha256(F.concat(s["left"], node, s["right"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return sha256(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, leaf, ``path`` (its siblings up to the root), subroot and root.

    ``altered`` is a column over ``docs``, the digest of the row as it is found later; ``folded_root`` is recomputed from it and
    the path, and ``verified`` tells whether that is the root. Without it the leaf itself is folded."""
    leaves = docs.select("doc_id", "source", leaf_of().alias("leaf"), (leaf_of() if altered is None else altered).alias("altered"))
    hashed = written(leaves, "leaves")  # sorting samples its input, which should not hash all texts again
    placed = _positions(hashed, "source", "doc_id", "leaf")
    nodes = placed.select(F.col("source").alias("group"), "total", "position", F.col("leaf").alias("digest"), "doc_id", "altered")
    rounds = _tree(nodes, "blocks", "doc_id", "altered")
    discard(hashed, placed)
    tops = _roots(rounds[-1]).select(F.lit(0).alias("all"), F.col("group").alias("source"), "digest")
    sources = _positions(tops, "all", "source")
    over = sources.select(F.col("all").alias("group"), "total", "position", "digest", "source")
    union = _tree(over, "sources", "source")
    discard(sources)
    root = _roots(union[-1]).select("group", "position", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(union):
        root = _entries(blocks, root)
    found = root.select(F.col("source").alias("group"), F.lit(0).cast("long").alias("position"), "path", F.col("digest").alias("subroot"), "root")
    for blocks in reversed(rounds):
        found = _entries(blocks, found)
    found = found.select("doc_id", F.col("group").alias("source"), F.col("digest").alias("leaf"), "path", "subroot", "root", fold(F.col("altered"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
