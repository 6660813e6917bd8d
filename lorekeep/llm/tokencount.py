"""Token counts of a unigram vocabulary: count-only Viterbi over Aho-Corasick matches.

The automaton enumerates the vocabulary's matches in a unit of text; dynamic programming carries the best
score and its number of pieces to each position. Ties follow the tokenizer: a later candidate must be
better, and candidates come by start, so the earliest start (the longest last piece) stands; a character
that is no piece of its own may be unknown at ``min(score) - 10``. Unknown characters count their UTF-8
bytes where the vocabulary has byte pieces, else each run of them counts once. Spaces become the space
mark and one is put in front. No piece crosses from another character to the space mark, and none holds
a line break (both are checked on loading), so the best path of a text is those of its units, joined, and
a unit's count is looked up if the worker has seen the unit before. Scores add in double precision.

Defined cases: null and empty texts have 0 tokens. Rows are independent: null or repeated ids stay, and
only the named columns are read. A text is taken whole; the table of units is emptied at ``UNITS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy

SPACE = "▁"
UNITS = 300_000
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Unigram:
    """Pieces with scores. ``byte_pieces``: unknown characters fall back to their bytes."""

    pieces: tuple[tuple[str, float], ...]
    byte_pieces: bool

    def __post_init__(self):
        texts = [p for p, _ in self.pieces]
        if SPACE not in texts:
            raise ValueError("the vocabulary has no space mark")
        for p in texts:
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} crosses a unit of text")


def load(path: str) -> Unigram:
    """The pieces of a sentencepiece model file, read as a unigram vocabulary."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    pieces = tuple((p.piece, float(p.score)) for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED))
    return Unigram(pieces, any(p.type == kinds.BYTE for p in model.pieces))


class Counter(dict):
    """Counts by word, for the unit that is the space mark and the word."""

    def __init__(self, model: Unigram):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in model.pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in model.pieces) - UNKNOWN_PENALTY
        self.byte_pieces = model.byte_pieces
        self.line_break = self.unit("\n")

    def __missing__(self, word: str) -> int:
        if len(self) >= UNITS:
            self.clear()
        self[word] = n = self.unit(SPACE + word)
        return n

    def unit(self, text: str) -> int:
        """The number of pieces on the best path of one unit."""
        ending: list[list[tuple[int, float]]] = [[] for _ in text]
        for end, match in self.matches.iter(text):
            ending[end].append(match)
        best, pieces, in_unknown = [0.0], [0], [False]
        for end, found in enumerate(ending):
            top, n, unknown, single = float("-inf"), 0, False, False
            for length, score in sorted(found, reverse=True):
                start = end + 1 - length
                single = single or length == 1
                if best[start] + score > top:
                    top, n = best[start] + score, pieces[start] + 1
            if not single and best[end] + self.unknown > top:
                more = len(text[end].encode("utf-8", "surrogatepass")) if self.byte_pieces else int(not in_unknown[end])
                top, n, unknown = best[end] + self.unknown, pieces[end] + more, True
            best.append(top)
            pieces.append(n)
            in_unknown.append(unknown)
        return pieces[-1]

    def line(self, line: str, first: bool) -> int:
        words = line.split(" ")
        if "" not in words and (first or len(words) > 1):
            if first:
                return sum(map(self.__getitem__, words))
            return self.unit(words[0]) + sum(map(self.__getitem__, words[1:]))
        marks, n = int(first), 0
        for i, word in enumerate(words):
            marks += i > 0
            if word:
                n += self[word] if marks == 1 else self.unit(SPACE * marks + word)
                marks = 0
        return n + (self.unit(SPACE * marks) if marks else 0)

    def text(self, text: str) -> int:
        if not text:
            return 0
        lines = text.replace(SPACE, " ").split("\n")
        return sum(self.line(line, i == 0) for i, line in enumerate(lines)) + self.line_break * (len(lines) - 1)


_COUNTERS: dict[Unigram, Counter] = {}


def count_tokens(docs: DataFrame, model: Unigram, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and ``n_tokens``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[model] = Counter(model)
        counter = _COUNTERS[model]
        for batch in batches:
            n = pa.array([counter.text(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["id", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(count), f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)
