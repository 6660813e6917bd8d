"""Quality by positive-unlabelled learning.

A logistic model over shape features of a text (classes of characters, repetition of words and lines,
lengths) is fitted by minimising the non-negative unbiased risk of trusted positives P against unlabelled
texts U with the class prior pi: pi E_P[loss(+)] + max(0, E_U[loss(-)] - pi E_P[loss(-)]). Where the second
term falls below zero its gradient is reversed, so the fit does not chase it. The prior is estimated as
the share of positives among the labelled rows. P is at most ``MAX_ROWS`` labelled rows by the hash of the id (of texts that
share an id one). U is every given text: its features are stored once, and each of ``PASSES`` passes over them adds
up the loss and gradient of E_U in the tasks. Between passes the steps are those of a fixed sample of U of at most ``SAMPLE`` rows,
corrected by what the sample's gradient differs from that of U at the last pass (a control variate), so the sample
saves passes and the steps settle where the gradient over all of U does. The score is shifted so that the share of all
training texts above ``CUT`` is the prior (a mergeable quantile, within a ``RANKS``-th of the texts), which makes ``CUT`` the
decision that the prior implies.

Defined cases: null and empty texts have all counts 0 and are scored as such. Rows are independent: null
or repeated ids stay, one result for each row. Labels without an id or value, or without a document, are
not learned from; without positives every score is the prior (0.5 without any label). Only the named
columns are read, and of these only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, text_of, tidy, written

MAX_ROWS = 10_000
#: Unlabelled rows of the control variate; passes over all of them correct it.
SAMPLE = 10_000
CUT = 0.7
#: Passes over the features of all texts, and steps between two of them.
PASSES, STEPS = 12, 150
RANKS = 1_000_000
RIDGE = 1e-3
SLICE_BYTES = 4_000_000


def _table() -> np.ndarray:
    """The class of each byte of UTF-8: 0 lower or other letter, 1 upper, 2 digit, 3 space, 4 line break,
    5 sentence mark, 6 exclamation, 7 other mark, 8 continuation byte."""
    out = np.zeros(256, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        if "A" <= c <= "Z":
            out[i] = 1
        elif c.isdigit():
            out[i] = 2
        elif c == "\n":
            out[i] = 4
        elif c <= " ":
            out[i] = 3
        elif c in ".,;:'\"-()":
            out[i] = 5
        elif c in "!?":
            out[i] = 6
        elif not c.isalpha():
            out[i] = 7
    out[0x80:0xC0] = 8
    return out


CLASSES = _table()


def shape(texts: list[str]) -> np.ndarray:
    """One row of features for each text; every entry is finite and does not grow without bound."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.zeros((len(texts), 9))
    size = np.array([len(d) for d in data], dtype=np.int64)
    first = 0
    while first < len(texts):  # slices bound the memory; a single longer text is one slice
        last, total = first + 1, size[first]
        while last < len(texts) and total + size[last] <= SLICE_BYTES:
            total += size[last]
            last += 1
        kinds = CLASSES[np.frombuffer(b"".join(data[first:last]), dtype=np.uint8)]
        doc = np.repeat(np.arange(last - first, dtype=np.int32) * 9, size[first:last])
        counts[first:last] = np.bincount(doc + kinds, minlength=9 * (last - first)).reshape(-1, 9)
        first = last
    chars = np.maximum(counts[:, :8].sum(axis=1), 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    words = [t.split() for t in texts]
    n_words = np.array([len(w) for w in words], dtype=np.float64)
    distinct = np.array([len(set(w)) for w in words])
    repeated = np.array([sum(map(str.__eq__, w, w[1:])) for w in words])
    lines = [[x for x in t.split("\n") if x] for t in texts]
    n_lines = np.array([len(x) for x in lines], dtype=np.float64)
    lines_distinct = np.array([len(set(x)) for x in lines])
    some = np.maximum(n_words, 1)
    return np.column_stack(
        [
            counts[:, 1] / letters,
            letters / chars,
            counts[:, 2] / chars,
            np.sqrt(counts[:, 5] / some),
            np.sqrt(np.minimum(counts[:, 6] / some, 4)),
            np.sqrt(np.minimum(counts[:, 7] / some, 4)),
            np.log1p(n_words),
            np.log1p(counts[:, :8].sum(axis=1) / some),
            distinct / some,
            distinct / np.maximum(some**0.85, 1),
            np.sqrt(repeated / some),
            np.sqrt(1 - lines_distinct / np.maximum(n_lines, 1)),
            np.log1p(n_words / np.maximum(n_lines, 1)),
            (n_words == 0).astype(np.float64),
        ]
    )


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return _expand(x, self.mean, self.scale) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margins(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features and their distances from the mean on either side, all within +-6."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])


def risk(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float]:
    """The positive part of the risk, pi E_P[loss(+)], and the other, E_U[loss(-)] - pi E_P[loss(-)]; the loss is logistic."""
    fp, fu = p @ w + b, u @ w + b
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def descent(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float, moved: np.ndarray | None = None) -> np.ndarray:
    """The direction to step against, by the weights and the bias: the gradient of both parts of the risk, or
    where the second is below zero its own gradient reversed. ``moved`` is added to the gradient and loss of E_U."""
    sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
    moved = np.zeros(len(w) + 2) if moved is None else moved
    by_rest = np.append(u.T @ su, su.sum()) / len(u) + moved[:-1] - prior * (np.append(p.T @ sp, sp.sum()) / len(p))
    by_plus = prior * np.append(p.T @ (sp - 1), (sp - 1).sum()) / len(p)
    return by_plus + by_rest if risk(p, u, prior, w, b)[1] + moved[-1] >= 0 else -by_rest


def unlabelled_sums(u: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over unlabelled rows: the gradient of loss(-) by weights and bias, the loss, and the number of rows."""
    f = u @ w + b
    s = _sigmoid(f)
    return np.concatenate([u.T @ s, [s.sum(), np.logaddexp(0, f).sum(), len(u)]])


Sums = Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def fit(positive: np.ndarray, sample: np.ndarray, prior: float, sums: Sums | None = None) -> QualityModel:
    """Minimise the non-negative unbiased risk by gradient descent with moments.

    ``sums(mean, scale, w, b)`` gives ``unlabelled_sums`` over all unlabelled rows, which ``sample`` is a part of (all, without it)."""
    width = shape([""]).shape[1] if not len(sample) else sample.shape[1]
    if not len(positive) or not len(sample) or not 0 < prior < 1:
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(3 * width), float(np.log(prior / (1 - prior))))
    mean, scale = positive.mean(axis=0), np.maximum(positive.std(axis=0), 1e-2)
    p, u = _expand(positive, mean, scale), _expand(sample, mean, scale)
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    for _ in range(PASSES):
        whole = unlabelled_sums(u, w, b) if sums is None else sums(mean, scale, w, b)
        own = unlabelled_sums(u, w, b)
        moved = whole[:-1] / whole[-1] - own[:-1] / own[-1]  # of gradient and loss, from the sample's to those of all rows
        for _ in range(STEPS):
            step += 1
            grad = descent(p, u, prior, w, b, moved) + RIDGE * np.append(w, 0)
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    cut = np.quantile(u @ w, 1 - prior)
    return QualityModel(mean, scale, w, float(np.log(CUT / (1 - CUT)) - cut))


_ROW = "array<double>"


def _shape_rows(texts: DataFrame) -> DataFrame:
    """key (the hash of the id, null without one) and x, the features, of every text (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                x = shape(part.column(1).to_pylist())
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), rows], ["key", "x"])

    key = F.when(F.col("id").isNotNull(), F.xxhash64("id"))
    return texts.select(key.alias("key"), "text").mapInArrow(tidy(work), f"key long, x {_ROW}")


def _matrix(column: pa.ListArray) -> np.ndarray:
    width = shape([""]).shape[1]
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]].reshape(-1, width)


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded set of rows (key, label, x), in one order; of rows of one key and label one."""
    one = rows.groupBy("key", "label").agg(F.min("x").alias("x"))
    table = one.toArrow().sort_by([("key", "ascending"), ("label", "ascending")])
    x = np.array(table["x"].to_pylist(), dtype=np.float64).reshape(table.num_rows, shape([""]).shape[1])
    return x, table["label"].to_numpy().astype(np.int64)


def _sums_over(shapes: DataFrame) -> Sums:
    """``unlabelled_sums`` over all stored rows, added up in each task before they meet."""
    def sums(mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 3)
            for batch in batches:
                total += unlabelled_sums(_expand(_matrix(batch.column(0)), mean, scale), w, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

        parts = shapes.select("x").mapInArrow(work, "k long, n double")
        out = np.zeros(len(w) + 3)
        for row in parts.groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row for each weight
            out[row.k] = row.n
        return out

    return sums


def train(
    docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text"
) -> QualityModel:
    """Learn from all given labels; leave held-out rows out of ``labels`` and ``docs`` beforehand."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    shapes = written(_shape_rows(texts), "shapes")
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().distinct()
    chosen = named.select(F.xxhash64("id").alias("key"), "label").orderBy("key", "label").limit(MAX_ROWS)
    web = shapes.select("key").where("key is not null").distinct().orderBy("key").limit(SAMPLE).withColumn("label", F.lit(-1))
    # at most MAX_ROWS and SAMPLE rows, so the features are read where they lie
    x, y = _collected(shapes.join(F.broadcast(chosen.unionByName(web)), "key"))
    labelled = y >= 0
    prior = float(y[labelled].mean()) if labelled.any() else 0.5
    model = _shifted(fit(x[y == 1], x[y == -1], prior, _sums_over(shapes)), shapes, prior)
    discard(shapes)
    return model


def _shifted(model: QualityModel, shapes: DataFrame, prior: float) -> QualityModel:
    """The model whose share of all texts above ``CUT`` is the prior."""
    if not model.weights.any():
        return model
    sent = shapes.sparkSession.sparkContext.broadcast(replace(model, bias=0.0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.margins(_matrix(batch.column(0))))], ["margin"])

    margins = shapes.select("x").mapInArrow(tidy(work), "margin double")
    cut = margins.agg(F.percentile_approx("margin", 1 - prior, RANKS)).first()[0]
    return model if cut is None else replace(model, bias=float(np.log(CUT / (1 - CUT)) - cut))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, ``score`` and ``predicted`` (1 from ``CUT`` on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for first in range(0, batch.num_rows, 512):
                out.append(sent.value.scores(shape(batch.column(1).slice(first, 512).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["id", "score"])

    scored = rows.mapInArrow(tidy(work), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )
