"""Byte-level BPE over a global distinct-word shuffle, and its decoding.

Pre-tokens are exploded with their positions, blockwise: a block of texts lists its distinct words (the
matches of the pattern) and each text becomes the sequence of its words' places in that list. One pass
over the texts makes both, and one shuffle deals the lists by a hash of the word, in ``PARTS`` parts, and the
sequences by block. In a part each distinct word is encoded once, and its ids go back to the block and
place of every listing. A block's sequences and ids then meet, and the ids are laid out by position. So a
word crosses the network once for each block that has it, however often it is in its texts, and texts
cross it only as compressed sequences. Decoding joins the ids with the token-byte table, by position in
the table, which has at most ``MAX_VOCAB`` rows.

A block ends after ``block_bytes`` bytes of text or ``BLOCK_DISTINCT`` distinct words, which bounds what is
held of it; a single longer text is one block. A part holds the ids of its words of all blocks, and forgets
them beyond ``KNOWN`` (they are then encoded again). A block's key is a digest of its list, so if a lost task's input comes
in another order when it is read again, sequences find no list, and the job fails instead of mixing ids.

Defined cases: null and empty texts have no ids. Rows are independent: null or repeated ids stay, one
result for each row. Only the named columns are read. In decoding null lists, null ids and ids that are
not in the table give no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import release_memory, shuffles, text_of, tidy

MAX_VOCAB = 1_000_000
BLOCK_BYTES = 16_000_000
BLOCK_DISTINCT = 500_000
SLICE_BYTES = 1_000_000
CUTS = 300_000
CHUNK = 256
PARTS = 2048
KNOWN = 1_000_000

# A space that may not begin a match: it stands before white space (as widely as any of the libraries counts it) or at the end.
_LOOSE = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
_PASS = "key long, block long, first int, n int, sizes binary, data binary, n_data long"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    if len(ranks) > MAX_VOCAB:
        raise ValueError(f"{len(ranks)} tokens are more than {MAX_VOCAB}")
    return ranks


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``pool[start : start + size]`` of all, in order."""
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    return pool[np.repeat(starts - (stops - sizes), sizes) + np.arange(total)]


class Splitter:
    """Words of texts by the pattern, as places in the block's list of distinct words.

    A space before a character that is no white space always begins a match, so a text is cut there, and
    what a cut holds is looked up if the block has seen it before."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.starts = regex.compile(r" (?=\S)")
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        """Known cuts as a start and a size in the pool of places; opening cuts have no space before them."""
        self.pool, self.begins, self.sizes = array("i"), array("i"), array("i")
        self.known: dict[str, int] = {}
        self.opening: dict[str, int] = {}

    def _cut(self, cut: str, known: dict[str, int], space: str) -> int:
        at = known.get(cut)
        if at is None:
            places = self.places
            words = self.find(space + cut)
            self.begins.append(len(self.pool))
            self.sizes.append(len(words))
            self.pool.extend([places.setdefault(w, len(places)) for w in words])
            at = known[cut] = len(self.begins) - 1
        return at

    def sequences(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of words of each text, and the places of all words in order."""
        if len(self.begins) > CUTS:
            self._forget()
        loose = pc.match_substring_regex(texts, _LOOSE)
        cuts = pc.split_pattern(texts.filter(pc.invert(loose)), " ")
        tight_ends = cuts.offsets.to_numpy().astype(np.int64)
        coded = cuts.flatten().dictionary_encode()
        tight = coded.indices.to_numpy().astype(np.int64)
        named = coded.dictionary.to_pylist()
        first = np.zeros(len(tight), dtype=bool)
        first[tight_ends[:-1]] = True
        ids = np.zeros(len(named), dtype=np.int64)
        for i in np.unique(tight[~first]).tolist():
            ids[i] = self._cut(named[i], self.known, " ")
        opening = [self._cut(named[i], self.opening, "") for i in tight[first].tolist()]
        tight = ids[tight]
        tight[first] = opening
        is_loose = loose.to_numpy(zero_copy_only=False).astype(bool)
        rows = [self._loose(t) for t in texts.filter(loose).to_pylist()]
        n_cuts = np.zeros(len(texts), dtype=np.int64)
        n_cuts[~is_loose], n_cuts[is_loose] = np.diff(tight_ends), [len(r) for r in rows]
        of = np.repeat(is_loose, n_cuts)
        all_cuts = np.zeros(len(of), dtype=np.int64)
        all_cuts[~of], all_cuts[of] = tight, np.fromiter(chain.from_iterable(rows), dtype=np.int64)
        sizes = np.array(self.sizes, dtype=np.int64)[all_cuts]
        places = _gathered(np.array(self.pool, dtype=np.int32), np.array(self.begins, dtype=np.int64)[all_cuts], sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(n_cuts)])
        return np.diff(total[ends]), places

    def _loose(self, text: str) -> list[int]:
        """The cuts of a text with spaces that may not begin a match."""
        at = [m.start() for m in self.starts.finditer(text)]
        out = [self._cut(text[: at[0]] if at else text, self.opening, "")]
        for a, b in zip(at, [*at[1:], len(text)]):
            out.append(self._cut(text[a + 1 : b], self.known, " "))
        return out


def _packed(numbers) -> bytes:
    """Numbers below 2**32, compressed by byte planes."""
    if not len(numbers):
        return b""
    planes = np.asarray(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int32)


def _slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First and last row of slices of at most ``most`` bytes, or of one text."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    first = 0
    while first < len(texts):
        stop = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        stop = min(max(stop, first + 1), len(texts))
        yield first, stop
        first = stop


class Block:
    """The distinct words and the sequences of some texts, until they are sent."""

    def __init__(self, pattern: str, place: int, most: int):
        self.splitter, self.place, self.most, self.nth = Splitter(pattern), place, most, 0
        self.chunks: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: pa.StringArray) -> None:
        lengths, places = self.splitter.sequences(texts)
        self.chunks.append((ids, lengths, places))
        self.size += int(pc.sum(pc.binary_length(texts)).as_py() or 0)

    def full(self) -> bool:
        return self.size >= self.most or len(self.splitter.places) >= BLOCK_DISTINCT

    def close(self, kind: pa.DataType) -> pa.RecordBatch:
        """Rows of the lists by part (key: the part), then those of the sequences (key: the block)."""
        words = list(self.splitter.places)
        part = np.fromiter((zlib.crc32(w.encode()) % PARTS for w in words), dtype=np.int64, count=len(words))
        order = np.argsort(part, kind="stable")
        new = np.empty(len(words), dtype=np.int32)
        new[order] = np.arange(len(words), dtype=np.int32)
        listed = [words[i].encode() for i in order.tolist()]
        sizes = np.fromiter(map(len, listed), dtype=np.int64, count=len(listed))
        digest = hashlib.blake2b(sizes.tobytes() + b"".join(listed) + repr((self.place, self.nth)).encode(), digest_size=8)
        block = int.from_bytes(digest.digest(), "big") >> 1 | PARTS  # no key of a block is one of a part
        cut = np.flatnonzero(np.diff(part[order], prepend=-1, append=PARTS))
        rows = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            data = b"".join(listed[a:b])
            packed = pa.compress(data, codec="zstd", asbytes=True) if data else b""
            rows.append((int(part[order[a]]), block, a, b - a, _packed(sizes[a:b]), packed, len(data), None))
        for ids, lengths, places in self.chunks:
            moved = new[places] if len(places) else places
            rows.append((block, block, 0, len(lengths), _packed(lengths), _packed(moved), len(places), ids.to_pylist()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(kind)]
        names = ["key", "block", "first", "n", "sizes", "data", "n_data", "row_ids"]
        self.splitter.reset()
        self.chunks, self.size, self.nth = [], 0, self.nth + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, kind: pa.DataType, place: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all blocks of the texts of one task."""
    block = Block(pattern, place, most)
    for batch in batches:
        texts = batch.column(1).cast(pa.string())
        for first, stop in _slices(texts, min(most, SLICE_BYTES)):
            block.add(batch.column(0).slice(first, stop - first), texts.slice(first, stop - first))
            if block.full():
                yield block.close(kind)
    if block.chunks:
        yield block.close(kind)


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    decoded_col: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: its id and ``ids``, the token ids of its whole text. With ``decoded_col`` the ids
    are decoded where they are laid out, which spares a second Python worker a task; it is what ``decode`` gives. The
    result does not depend on ``block_bytes``, after which a block of texts ends."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    vocabulary = docs.sparkSession.sparkContext.broadcast(ranks)  # at most MAX_VOCAB tokens
    tokens = docs.sparkSession.sparkContext.broadcast(token_table(ranks)) if decoded_col else None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _blocks(batches, pattern, to_arrow_type(kind), TaskContext.get().partitionId(), block_bytes)

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        # a pattern that takes a word whole: what is left to the library are the merges by rank
        merge = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=vocabulary.value, special_tokens={}).encode_ordinary
        part, known = None, {}

        def coded(row: dict) -> tuple:
            nonlocal part, known
            if row["key"] != part or len(known) > KNOWN:
                part, known = row["key"], {}
            sizes, n = _unpacked(row["sizes"], row["n"]), row["n_data"]
            data = pa.decompress(row["data"], n, codec="zstd", asbytes=True) if n else b""
            stops = np.cumsum(sizes).tolist()
            ids = []
            for a, b in zip([0, *stops], stops):
                word = data[a:b]
                found = known.get(word)
                if found is None:
                    found = known[word] = merge(word.decode())
                ids.append(found)
            size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(size.sum()))
            return row["block"], row["first"], row["n"], _packed(size), _packed(flat), len(flat)

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
        for batch in batches:  # sorted by part
            done = zip(*(coded(row) for row in batch.to_pylist()))
            columns = [pa.array(c, t) for c, t in zip(done, kinds)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["block", "first", "n", "sizes", "ids", "n_ids"])

    def lay_out(sequences: pa.Table, words: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        rows = sorted(words.to_pylist(), key=lambda r: r["first"])
        none = [np.zeros(0, dtype=np.int32)]
        sizes = np.concatenate([_unpacked(r["sizes"], r["n"]) for r in rows] or none).astype(np.int64)
        flat = np.concatenate([_unpacked(r["ids"], r["n_ids"]) for r in rows] or none)
        begins = np.cumsum(sizes) - sizes
        whole = [r["first"] for r in rows] == np.cumsum([0, *(r["n"] for r in rows)]).tolist()[:-1]
        out_ids, out = [], []
        for chunk in sequences.to_pylist():
            lengths, places = _unpacked(chunk["sizes"], chunk["n"]), _unpacked(chunk["data"], chunk["n_data"])
            out_ids += chunk["row_ids"]
            if len(places) and (not whole or places.max() >= len(sizes)):
                raise RuntimeError("the input's rows changed between two reads: encode a stored table")
            size = sizes[places]
            taken = _gathered(flat, begins[places], size)
            stops = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(lengths)])]
            out.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(taken, pa.int32())))
        columns = [pa.array(out_ids, to_arrow_type(kind)), pa.chunked_array(out, pa.list_(pa.int32()))]
        if tokens is not None:
            token_bytes = pa.array(tokens.value, pa.large_binary())
            parts = [bytes_of(x.slice(at, CHUNK), token_bytes) for x in out for at in range(0, len(x), CHUNK)]
            columns.append(pa.chunked_array(parts, pa.binary()))
        done = pa.table(columns, ["id", "ids", "decoded"][: len(columns)])
        del out, columns, rows, flat, sizes, begins
        release_memory()
        return done

    n = shuffles(docs.sparkSession)
    dealt = rows.mapInArrow(tidy(split), f"{_PASS}, row_ids array<{kind.simpleString()}>").repartition(n, "key")

    def of(condition) -> DataFrame:
        """Some of the dealt rows. The condition counts as not deterministic, so it stays above the shuffle, which both uses share."""
        return dealt.where(F.when(F.spark_partition_id() >= 0, condition))

    encoded = (
        of(F.col("key").between(0, PARTS - 1))
        .sortWithinPartitions("key")
        .mapInArrow(tidy(encode_words), "block long, first int, n int, sizes binary, ids binary, n_ids long")
    )
    laid = (
        of(~F.col("key").between(0, PARTS - 1))
        .groupBy("key")
        .cogroup(encoded.groupBy("block"))
        .applyInArrow(lay_out, f"id {kind.simpleString()}, ids array<int>" + ", decoded binary" * bool(decoded_col))
    )
    return laid.toDF(id_col, "ids", *[decoded_col] * bool(decoded_col))


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id, and none at the end for ids outside the table."""
    table = [b""] * (max(ranks.values(), default=-1) + 2)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def bytes_of(lists: pa.ListArray, token_bytes: pa.LargeBinaryArray) -> pa.BinaryArray:
    """Lists of ids joined with the token-byte table (see ``token_table``), as the bytes of each list."""
    outside = len(token_bytes) - 1
    flat = np.asarray(lists.flatten().fill_null(outside), dtype=np.int64)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    joined = token_bytes.take(pa.array(np.where((flat < 0) | (flat > outside), outside, flat)))
    stops = np.concatenate([[0], np.cumsum(pc.binary_length(joined).to_numpy())])[np.concatenate([[0], ends])]
    data = joined.buffers()[2].to_pybytes() if stops[-1] else b""  # the bytes of all tokens, in order
    return pa.array([data[a:b] for a, b in zip(stops[:-1], stops[1:])], pa.binary())


def decode(encoded: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    tokens = encoded.sparkSession.sparkContext.broadcast(token_table(ranks))
    fields = [f for f in encoded.schema.fields if f.name != out_col]
    names = [f.name for f in fields]
    at = names.index(ids_col)

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = pa.array(tokens.value, pa.large_binary())
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(first, CHUNK)
                yield pa.RecordBatch.from_arrays([*batch.columns, bytes_of(batch.column(at), token_bytes)], [*names, out_col])

    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(
        tidy(join_bytes), StructType([*fields, StructField(out_col, BinaryType())])
    )
