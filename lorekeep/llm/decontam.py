"""Benchmark decontamination by spaced-seed hashing.

Words are hashed; a mask selects some positions of a short window and ignores the others, and the hash of
what it selects is a seed, so a substituted word spoils only the seeds that select it. The seeds of the
benchmark are joined with those of every position of the documents; a hit gives a document, an item and
their offset. Around each hit the words are compared along the whole overlap at that offset: a leak is a
window of ``WINDOW`` words of the item (of all its words, if it has fewer) of which at least
``SIMILARITY`` stand in the document at the same offset. ``MASKS`` has, for each number of substitutions
that a window may hold, masks that hit every such window, wherever they are (a test tries all).

A hit that follows another one at the same offset is left out before hits are listed, so a stretch of
repeated words gives as many hits as it has words, not their square. Of an item's leaks in a document that
overlap, the one with the most equal words is reported.

The benchmark is dealt into blocks whose seeds and words fit ``BLOCK_WORDS``, so what is broadcast is
bounded whatever the benchmark's size; the documents are read once for each block, mostly once.

Defined cases: null and empty texts have no words and never leak; items without words match nothing.
Words are runs of letters and digits, lower-cased. Rows are independent: null or repeated document ids
stay, one result for each row. Of repeated items every id is reported; null item ids are reported as
null. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import text_of, tidy, word_hashes

#: Fixed masks by the substitutions that a window may hold: 3 in 15 words, 2 in 10 to 14, 1 in 5 to 9. An item
#: of fewer words has none to spare, and its mask is as long as itself.
MASKS = {
    1: ("1111", "11101", "11011", "10111"),
    2: ("111011", "11010011", "11111"),
    3: ("1111011", "11001000111", "11010110001"),
}
WINDOW = 15
SIMILARITY = 0.8
BLOCK_WORDS = 200_000
SLICE_WORDS = 500_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)

LEAKS = "array<struct<item_id:{kind},first_word:int,n_words:int,n_same:int>>"


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed at each position where the mask fits."""
    offsets = _offsets(mask)
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, len(mask), dtype=np.uint64)
    for at in offsets:
        out = (out + words[at : at + n]) * _GOLD
        out ^= out >> np.uint64(29)
    return out


def needed(n_words: int) -> tuple[int, int]:
    """The window of an item of so many words, and how many of its words must be the same."""
    width = min(WINDOW, n_words)
    return width, math.ceil(SIMILARITY * width - 1e-9)


def masks_of(n_words: int) -> tuple[str, ...]:
    width, need = needed(n_words)
    return MASKS[width - need] if width > need else ("1" * width,)


def _followed(seeds: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A key of each seed and the one before it."""
    out = (seeds + before * _GOLD) * _GOLD
    return out ^ (out >> np.uint64(31))


class SeedIndex:
    """The seeds of some benchmark items, by mask, and the items' words."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        by_mask: dict[str, list[int]] = {}
        for i, words in enumerate(items):
            for mask in masks_of(len(words)) if len(words) else ():
                by_mask.setdefault(mask, []).append(i)
        self.masks = []
        for mask, members in by_mask.items():
            own = [_seeds(items[i], mask) for i in members]
            size = np.array([len(s) for s in own])
            seeds = np.concatenate(own)
            before = np.concatenate([np.zeros(1, dtype=np.uint64), seeds[:-1]])
            before[np.cumsum(size) - size] = 1  # nothing comes before an item's first seed
            pair = _followed(seeds, before)
            item, at = np.repeat(members, size), np.arange(len(seeds)) - np.repeat(np.cumsum(size) - size, size)
            order = np.lexsort((pair, seeds))
            seeds, pair = seeds[order], pair[order]
            first = np.flatnonzero((seeds != np.roll(seeds, 1)) | (pair != np.roll(pair, 1)) | (np.arange(len(seeds)) == 0))
            by_pair = np.argsort(pair[first], kind="stable")
            runs = (pair[first][by_pair], first[by_pair], np.append(first, len(seeds))[1:][by_pair])
            bits = max(16, int(len(seeds) * 64).bit_length())
            seen = np.zeros(1 << bits, dtype=bool)
            shift = np.uint64(64 - bits)
            seen[(seeds >> shift).astype(np.int64)] = True
            self.masks.append((mask, seeds, item[order], at[order], runs, seen, shift))

    def hits(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (document, item, offset of the item in it) of all seeds that meet; the documents' words lie in
        ``words`` from ``starts`` on. Where the seeds before also meet, a hit is left to them."""
        found = []
        for mask, seeds, item, place, (pair, run_low, run_high), seen, shift in self.masks:
            own = _seeds(words, mask)
            at = np.flatnonzero(seen[(own >> shift).astype(np.int64)])
            low, high = (np.searchsorted(seeds, own[at], side=side) for side in ("left", "right"))
            at, low, high = (x[high > low] for x in (at, low, high))
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, side="right") - 1
            before = own[np.maximum(at - 1, 0)]
            before[at == starts[doc]] = 2  # nothing comes before a document's first seed
            keys = _followed(own[at], before)
            run = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
            same = (pair[run] == keys) & (run_low[run] >= low) & (run_high[run] <= high)
            same_low, same_high = np.where(same, run_low[run], low), np.where(same, run_high[run], low)
            for a, b in ((low, same_low), (same_high, high)):
                n = b - a
                stop = np.cumsum(n)
                which = np.repeat(a - (stop - n), n) + np.arange(stop[-1])
                offset = np.repeat(at - starts[doc], n) - place[which]
                found.append(np.stack([np.repeat(doc, n), item[which], offset], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)

    def leak(self, item: int, offset: int, text: np.ndarray) -> tuple[int, int, int] | None:
        """First word, number of words and matches of what the item shares with a text at an offset."""
        words = self.items[item]
        first, last = max(0, -offset), min(len(words), len(text) - offset)
        width, need = needed(len(words))
        if last - first < width:
            return None
        same = np.concatenate([[0], np.cumsum(words[first:last] == text[offset + first : offset + last])])
        good = np.flatnonzero(same[width:] - same[:-width] >= need)
        if not len(good):
            return None
        start, stop = int(good[0]), int(good[-1]) + width
        return offset + first + start, stop - start, int(same[stop] - same[start])

    def leaks(self, item: int, offsets: list[int], text: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The leaks of an item at some offsets in a text; of those that overlap only the best."""
        found = (self.leak(item, offset, text) for offset in offsets)
        taken = np.zeros(len(text), dtype=bool) if len(offsets) > 1 else None
        for first, n, same in sorted(filter(None, found), key=lambda x: (-x[2], x[0], x[1])):
            if taken is None or not taken[first : first + n].any():
                yield first, n, same
                if taken is not None:
                    taken[first : first + n] = True


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each row of ``docs``: its id, ``contaminated`` and ``leaks`` (sorted), and the columns ``keep``."""
    items = benchmark.select(F.col(item_col).alias("item"), word_hashes(text_of(item_text_col)).alias("words")).distinct()
    item_kind = items.schema["item"].dataType
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // BLOCK_WORDS))
    leaks_kind = LEAKS.format(kind=item_kind.simpleString())
    rows = docs.select(
        F.col(id_col).alias("id"),
        word_hashes(text_of(text_col)).alias("words"),
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("kept"),
        F.array().cast(leaks_kind).alias("leaks"),
    )
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == block).collect()  # about BLOCK_WORDS
        found = [(r.item, np.array(r.words, dtype=np.int64).view(np.uint64)) for r in part]
        rows = _find(rows, found, last=block == n_blocks - 1)
    return rows.select(
        F.col("id").alias(id_col),
        (F.size("leaks") > 0).alias("contaminated"),
        F.array_sort("leaks").alias("leaks"),
        *[F.col("kept")[c].alias(c) for c in keep],
    )


def _find(rows: DataFrame, items: list[tuple], last: bool) -> DataFrame:
    """``rows`` with the leaks of some items added to ``leaks``; the last time without ``words``."""
    sent = rows.sparkSession.sparkContext.broadcast(items)
    schema = rows.schema
    names = [n for n in schema.names if not (last and n == "words")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids = [i for i, _ in sent.value]
        index = SeedIndex([w for _, w in sent.value])
        kind = to_arrow_type(schema["leaks"].dataType)
        for batch in batches:
            words = batch.column(1)
            ends = words.offsets.to_numpy().astype(np.int64)
            flat = words.values.to_numpy().view(np.uint64)
            leaks: dict[int, list[dict]] = {}
            first = 0
            while first < batch.num_rows:
                stop = int(np.searchsorted(ends, ends[first] + SLICE_WORDS, side="right")) - 1
                stop = min(max(stop, first + 1), batch.num_rows)
                part, starts = flat[ends[first] : ends[stop]], ends[first : stop + 1] - ends[first]
                hits = index.hits(part, starts[:-1])
                new = np.flatnonzero((np.diff(hits[:, :2], axis=0, prepend=-1) != 0).any(axis=1))
                for a, b in zip(new, [*new[1:], len(hits)]):  # sorted: one run for each document and item
                    doc, item = hits[a, :2].tolist()
                    for leak in index.leaks(item, hits[a:b, 2].tolist(), part[starts[doc] : starts[doc + 1]]):
                        leaks.setdefault(first + doc, []).append(
                            {"item_id": ids[item], "first_word": leak[0], "n_words": leak[1], "n_same": leak[2]}
                        )
                first = stop
            out = batch.column(3).to_pylist()
            for i, more in leaks.items():
                out[i] += more
            columns = [batch.column(n) for n in names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names)

    return rows.mapInArrow(tidy(find), StructType([schema[n] for n in names]))
