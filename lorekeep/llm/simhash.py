"""Near-duplicates by SimHash, joined by the generalised pigeonhole principle.

A bit of a text's fingerprint is set if it is set in over half of the hashes of its shingles. Rows of one
fingerprint are one node. To link nodes that differ in at most ``DISTANCE`` bits, the bits are cut into parts, bits that are
set together into the same part, as the join gains nothing from seeing the same evidence in several parts. Every node
gives each part i a threshold t(i) >= -1 with a sum of ``DISTANCE - parts + 1``. Then any node within ``DISTANCE`` of it
differs by at most t(i) in some part i: otherwise the differences sum up to at least sum(t(i) + 1) = ``DISTANCE + 1``. The
node probes part i with every value within t(i) of its own, and not at all where t(i) is -1. Thresholds are allocated for each
node by dynamic programming on its estimated cost: probes, and candidates from histograms of byte-sized pieces of each part.
The number of parts is the one of least estimated cost over all nodes. Estimates decide the cost only, never the links.

Nodes meet in buckets (part, value) and are verified by the count of differing bits. Buckets of over ``LARGE``
nodes emit no pairs: their nodes go to groups of those that have a common centre, a value that differs from each
in at most one bit (for a distance of 2; those share one exactly if they differ in two bits at most), which is linear in
their number. So no node, bucket or link is left out, and no group is counted in pairs beyond ``LARGE``.

Defined cases: null and empty texts, and texts without words, have fingerprint zero, which is linked like any other;
texts of fewer than ``SHINGLE`` words are one shingle. Rows without an id take part in links and never name a
component that has ids. Rows that repeat an id or a text are kept, one result for each. Empty tables give no rows. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_join, text_of, tidy, written
from .components import components

SHINGLE = 3
DISTANCE = 2
BITS = 64
#: Numbers of parts to choose from; with more than ``DISTANCE + 1`` some part is always left out, with fewer some part is probed by neighbours.
PARTS = (2, 3, 4)
#: Nodes of a bucket whose pairs are counted.
LARGE = 1024
#: Bits that deal common centres over groups, see ``_centre_links``.
DEALT_BITS = 7
#: The estimated cost of a probe, in candidates.
PROBE = 20.0

_SPACE = "[ \\t-\\r]+"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: Column) -> Column:
    """XXH64 (seed 42) of each run of ``SHINGLE`` words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = F.filter(F.split(F.translate(text, *_LOWER), _SPACE), lambda w: w != "")

    def runs(w: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(SHINGLE)])))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= SHINGLE, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<long>"))

    return F.element_at(F.transform(F.array(words), runs), 1)  # the words are split once


def fingerprints(hashes: np.ndarray, ends: np.ndarray, slice_size: int = 1 << 16) -> np.ndarray:
    """The fingerprint of each text whose hashes are ``hashes[ends[i]:ends[i + 1]]``."""
    n = len(ends) - 1
    votes = np.zeros((n, BITS), dtype=np.int64)
    size = np.diff(ends)
    owner = np.repeat(np.arange(n), size)
    for first in range(0, len(hashes), slice_size):
        own = owner[first : first + slice_size]
        bits = np.unpackbits(hashes[first : first + slice_size].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        votes[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    over = votes * 2 > size[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``node`` (the fingerprint, as a signed number) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), shingle_hashes(text_of(text_col)).alias("hashes"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(1)
            ends = hashes.offsets.to_numpy().astype(np.int64)
            prints = fingerprints(hashes.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64), ends - ends[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "node"])

    return rows.mapInArrow(tidy(work), f"id {kind}, node long")


def _bits(nodes: np.ndarray) -> np.ndarray:
    return np.unpackbits(nodes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _sums(nodes: DataFrame, partial) -> dict[int, int]:
    """Sums by key over all nodes: ``partial`` gives the keys and numbers of an array of nodes, added up in each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = partial(batch.column(0).to_numpy().view(np.uint64))
            total = own if total is None else total + own
        if total is not None:
            has = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["key", "n"])

    parts = nodes.select("node").mapInArrow(tidy(work), "key long, n double")
    return {r.key: r.n for r in parts.groupBy("key").agg(F.sum("n").alias("n")).collect()}  # as many as there are keys, a fixed number


def group_bits(both: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of about one size, each grown from its most correlated bits; ``both`` counts where two bits are set."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, out = list(range(len(both))), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (related[b][free].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in free if b not in group), key=lambda b: (related[b][group].sum(), -b)))
        out.append(sorted(group))
        free = [b for b in free if b not in group]
    return out


def take(nodes: np.ndarray, bits: list[int]) -> np.ndarray:
    """The value of each node in a part: its bits next to one another."""
    out = np.zeros(len(nodes), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((nodes >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _bytes_of(part: list[int]) -> list[list[int]]:
    return [part[k : k + 8] for k in range(0, len(part), 8)]


def _near(counts: np.ndarray, n: float) -> np.ndarray:
    """For each value of a byte, the share of nodes that differ from it in 0, 1, ... ``DISTANCE`` bits."""
    apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
    return np.stack([(counts[None, :] * (apart == t)).sum(axis=1) for t in range(DISTANCE + 1)], axis=1) / max(n, 1)


class Plan:
    """A cut into parts and what is needed to allocate thresholds: for each byte of a part, shares by distance."""

    def __init__(self, parts: list[list[int]], counts: list[list[np.ndarray]], ones: np.ndarray, n: float) -> None:
        self.parts, self.ones, self.n = parts, ones, n
        self.near = [[_near(c, n) for c in own] for own in counts]

    def costs(self, nodes: np.ndarray) -> np.ndarray:
        """Estimated cost of each node (first axis) in each part by threshold + 1: 0 for a part that is left out."""
        out = np.zeros((len(nodes), len(self.parts), DISTANCE + 2))
        for i, part in enumerate(self.parts):
            share = np.zeros((len(nodes), DISTANCE + 1))
            share[:, 0] = 1
            for own, near in zip(_bytes_of(part), self.near[i]):
                step = near[take(nodes, own).astype(np.int64)]
                share = np.stack([sum(share[:, a] * step[:, t - a] for a in range(t + 1)) for t in range(DISTANCE + 1)], axis=1)
            probes = np.cumsum([len(list(combinations(part, t))) for t in range(DISTANCE + 1)])
            out[:, i, 1:] = np.cumsum(share, axis=1) * self.n + probes * PROBE
        return out

    def allocate(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The thresholds of each node and part, -1 for none, of least estimated cost; and that cost."""
        cost = self.costs(nodes)
        units = DISTANCE + 1  # a part of threshold t takes t + 1 of them
        best = np.full((len(nodes), units + 1), np.inf)
        best[:, 0] = 0
        chosen = []
        for i in range(len(self.parts)):
            options = np.full((len(nodes), units + 1, units + 1), np.inf)
            for u in range(units + 1):
                options[:, u:, u] = best[:, : units + 1 - u] + cost[:, i, u][:, None]
            chosen.append(options.argmin(axis=2))
            best = options.min(axis=2)
        left = np.full(len(nodes), units)
        out = np.zeros((len(nodes), len(self.parts)), dtype=np.int64)
        for i in reversed(range(len(self.parts))):
            out[:, i] = chosen[i][np.arange(len(nodes)), left]
            left = left - out[:, i]
        return out - 1, best[:, units]


def make_plan(nodes: DataFrame, parts: tuple[int, ...] = PARTS) -> Plan:
    """The cut of least estimated cost over all nodes, from counts of bits, pairs of bits and bytes of every node."""

    def pairs(x: np.ndarray) -> np.ndarray:
        bits = _bits(x).astype(np.float64)
        return np.append((bits.T @ bits).ravel(), len(x))

    found = _sums(nodes, pairs)
    n = found.get(BITS * BITS, 0)
    both = np.zeros(BITS * BITS)
    for k, v in found.items():
        if k < BITS * BITS:
            both[k] = v
    cuts = [group_bits(both.reshape(BITS, BITS), n, m) for m in parts]
    flat = [own for cut in cuts for part in cut for own in _bytes_of(part)]

    def histograms(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(take(x, own).astype(np.int64), minlength=256) for own in flat]).astype(np.float64)

    table = np.zeros(256 * len(flat))
    for k, v in _sums(nodes, histograms).items():
        table[k] = v
    rows = iter(table.reshape(-1, 256))
    plans = [Plan(cut, [[next(rows) for _ in _bytes_of(part)] for part in cut], np.diag(both.reshape(BITS, BITS)), n) for cut in cuts]
    if len(plans) == 1:
        return plans[0]
    costs = _sums(nodes, lambda x: np.array([p.allocate(x)[1].sum() for p in plans]))
    return plans[min(range(len(plans)), key=lambda k: (costs.get(k, 0), k))]


def _keys(nodes: DataFrame, plan: Plan) -> DataFrame:
    """``part``, ``value``, ``node`` and ``probes`` (whether the node is here as a probe): every node under its own values, and where its thresholds say so under their neighbours."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            t, _ = plan.allocate(x)
            for i, part in enumerate(plan.parts):
                own = take(x, part)
                yield _rows(i, own, x, t[:, i] >= 0)
                for d in range(1, DISTANCE + 1):
                    some = t[:, i] >= d
                    if some.any():
                        for flips in combinations(range(len(part)), d):
                            mask = np.uint64(sum(1 << k for k in flips))
                            yield _rows(i, own[some] ^ mask, x[some], np.ones(some.sum(), dtype=bool), False)

    return nodes.select("node").mapInArrow(tidy(work), "part int, value long, node long, probes boolean, stored boolean")


def _rows(part: int, value: np.ndarray, node: np.ndarray, probes: np.ndarray, stored: bool = True) -> pa.RecordBatch:
    n = len(node)
    columns = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(value.view(np.int64)), pa.array(node.view(np.int64)), pa.array(probes), pa.array(np.full(n, stored))]
    return pa.RecordBatch.from_arrays(columns, ["part", "value", "node", "probes", "stored"])


def verified(key: np.ndarray, node: np.ndarray, probes: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two nodes of one bucket within ``DISTANCE``, one stored there and the other probing it; ``key`` is sorted."""
    a, b, shift = [], [], 1
    at = np.arange(len(key))
    while len(at := at[(at + shift < len(key))]) and len(at := at[key[at] == key[at + shift]]):
        x, y = node[at], node[at + shift]
        asked = (probes[at] & stored[at + shift]) | (stored[at] & probes[at + shift])
        near = at[asked & (x != y) & (np.bitwise_count(x ^ y) <= DISTANCE)]
        a.append(node[near])
        b.append(node[near + shift])
        shift += 1
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _bucket_links(rows: DataFrame) -> DataFrame:
    """Links inside buckets of at most ``LARGE`` rows: many buckets to a task, sorted, each compared by shifts of the whole run."""
    dealt = rows.repartition("part", "value").sortWithinPartitions("part", "value").select("part", "value", "node", "probes", "stored")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part, value, node, probes, stored = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            own = (part, value, node.view(np.uint64), probes.astype(bool), stored.astype(bool))
            rest = own if rest is None else tuple(np.concatenate(x) for x in zip(rest, own))
            same = (rest[0] == rest[0][-1]) & (rest[1] == rest[1][-1])
            whole = len(same) - int(same.sum())  # the last bucket may go on in the next batch
            if whole:
                yield _links(*_runs(*(x[:whole] for x in rest)))
            rest = tuple(x[whole:] for x in rest)
        if rest is not None and len(rest[0]):
            yield _links(*_runs(*rest))

    return dealt.mapInArrow(tidy(work), "a long, b long")


def _runs(part, value, node, probes, stored):
    key = np.cumsum(np.append(0, (np.diff(part) != 0) | (np.diff(value) != 0)))
    return verified(key, node, probes, stored)


def _joined(centre: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all nodes with a common centre: each of them with the smallest node that it reaches here."""
    _, c = np.unique(centre, return_inverse=True)
    names, m = np.unique(node, return_inverse=True)
    order = np.argsort(c, kind="stable")
    c, m = c[order], m[order]
    starts = np.flatnonzero(np.diff(c, prepend=-1))
    label = np.arange(len(names))
    while True:
        least = np.minimum.reduceat(label[m], starts)
        after = label.copy()
        np.minimum.at(after, m, least[c])
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _centre_links(nodes: DataFrame, deal: list[int]) -> DataFrame:
    """Links between nodes that have a common centre, which are those that differ in two bits at most.

    Centres are dealt by their bits ``deal``: a node sends one row for itself and all centres that agree with it there, and one for
    each of the few that differ from it there in one bit, so it is copied ``len(deal) + 1`` times and not once for each bit."""
    if DISTANCE != 2:
        raise ValueError("common centres are those of a distance of 2")
    rest = [b for b in range(BITS) if b not in deal]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            own = take(x, deal).view(np.int64)
            for k in range(-1, len(deal)):
                place = own if k < 0 else own ^ (1 << k)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.full(len(x), k, dtype=np.int32)), batch.column(0)], ["place", "flip", "node"])

    def work(group: pa.Table) -> pa.Table:
        x, flip = group["node"].to_numpy().view(np.uint64), group["flip"].to_numpy()
        own = x[flip < 0]
        moved = x[flip >= 0] ^ (np.uint64(1) << np.array(deal, dtype=np.uint64)[flip[flip >= 0]])
        centre = [own, moved, *[own ^ (np.uint64(1) << np.uint64(b)) for b in rest]]
        node = [own, x[flip >= 0], *[own for _ in rest]]
        a, b = _joined(np.concatenate(centre), np.concatenate(node))
        return pa.Table.from_batches([_links(a, b)])

    dealt = nodes.select("node").mapInArrow(tidy(spread), "place long, flip int, node long")
    return dealt.groupBy("place").applyInArrow(work, "a long, b long")


def links(nodes: DataFrame, plan: Plan, large: int | None = None) -> DataFrame:
    """Links (``a``, ``b``) that join all nodes within ``DISTANCE`` of one another."""
    large = LARGE if large is None else large
    keys = written(_keys(nodes, plan), "keys")
    crowded = keys.groupBy("part", "value").count().where(F.col("count") > large).select("part", "value")
    crowded = written(crowded, "crowded")
    few = _bucket_links(keys.join(crowded, ["part", "value"], "left_anti"))
    many = written(keys.join(crowded, ["part", "value"]).select("node").distinct(), "many")
    even = sorted(range(BITS), key=lambda b: (abs(plan.ones[b] / max(plan.n, 1) - 0.5), b))[:DEALT_BITS]
    out = written(few.unionByName(_centre_links(many, even)).distinct(), "links")
    discard(keys, crowded, many)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", parts: tuple[int, ...] = PARTS, large: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links reach."""
    signed = written(sign(docs, id_col, text_col), "signed")
    nodes = written(signed.groupBy("node").agg(F.min("id").alias("id")), "nodes")
    found = links(nodes, make_plan(nodes, parts), large)
    roots = components(found)
    discard(found)
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = written(salted_join(named, first, "root", "node").select("node", "component_id"), "classes")
    discard(roots, nodes)
    print_hex = F.lower(F.lpad(F.hex("node"), 16, "0"))
    met = salted_join(signed, classes, "node", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return met.select(F.col("id").alias(id_col), print_hex.alias("fingerprint"), "component_id")
