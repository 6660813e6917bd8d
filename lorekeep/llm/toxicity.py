"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades 0..K-1 are ordered. One weight vector is shared by all thresholds: P(grade <= k) =
sigmoid(threshold_k - weights . x), with rising thresholds, so the expected severity is the sum over k of
P(grade > k). Features are the presence of a text's words and of their first letters, as many as ``PREFIXES`` says, known by
64-bit hashes, so that no two share a weight. Features of the training rows that are seen in at least
``MIN_TEXTS`` of them and stand out between grades are kept, and an L1 penalty empties most weights
(accelerated proximal gradient on the driver). The training rows are a bounded sample: of each label value at
most ``MAX_ROWS`` labelled rows, by the hash of their id, and only so many of them that their features, those seen in at
least ``MIN_TEXTS`` of all these rows, are at most ``MAX_ENTRIES`` (8 bytes each) over all values. A row is taken with its
whole text or not at all. Only nonzero weights are sent to the executors.

Defined cases: null and empty texts have no features and get the severity of an empty text. Rows are
independent: null or repeated ids stay, one result for each row. Labels without a grade or id, or without
a document, are not learned from; without any label, or with one grade only, every text has severity 0.
Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release_memory, text_of, tidy, written

PREFIXES = (4, 5, 7)
MIN_TEXTS = 5
MAX_ROWS = 3000
MAX_ENTRIES = 40_000_000
MAX_GRADES = 16
#: Entries that are coded at a time.
PART = 1 << 20
STANDS_OUT = 4.0
L1 = 0.0001


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature hashes with their weights, and the rising thresholds between grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def features(text: Column) -> Column:
    """The distinct feature hashes of a text: its words and their first letters."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""))
    starts = [
        F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.xxhash64(F.substring(w, 1, n), F.lit(n)))
        for n in PREFIXES
    ]
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), *[F.array_distinct(s) for s in starts])


def _csr(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _coded(lists: pa.ListArray, least: int = MIN_TEXTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number and place among the sorted ``names`` of all entries but those whose feature surely has fewer than ``least`` of them,
    told by how many entries share the feature's leading bits; made in parts, as the driver holds little beside them."""
    flat, ends = _csr(lists)
    lead = np.zeros(1 << 22, dtype=np.int32)
    parts = range(0, len(flat), PART)
    for at in parts:
        np.add.at(lead, _lead(flat[at : at + PART]), 1)
    kept = np.concatenate([lead[_lead(flat[at : at + PART])] >= least for at in parts]) if len(flat) else np.zeros(0, dtype=bool)
    names = flat[kept]
    names.sort()
    names = names[np.flatnonzero(np.r_[True, names[1:] != names[:-1]])] if len(names) else names
    row, column, done = np.empty(int(kept.sum()), dtype=np.int32), np.empty(int(kept.sum()), dtype=np.int32), 0
    for at in parts:
        own = np.flatnonzero(kept[at : at + PART]) + at
        row[done : done + len(own)] = np.searchsorted(ends, own, side="right") - 1
        column[done : done + len(own)] = np.searchsorted(names, flat[own])
        done += len(own)
    return row, column, names


def _added(column: np.ndarray, n: int, weights: np.ndarray | None = None, row: np.ndarray | None = None) -> np.ndarray:
    """The entries of each of ``n`` features, or the sum of the ``weights`` of their rows, added in order and in parts."""
    out = np.zeros(n, dtype=np.int64 if weights is None else np.float64)
    for at in range(0, len(column), PART):
        np.add.at(out, column[at : at + PART], 1 if weights is None else weights[row[at : at + PART]])
    return out


def _lead(flat: np.ndarray) -> np.ndarray:
    return (flat.view(np.uint64) >> np.uint64(42)).astype(np.int32)


def loss(row: np.ndarray, column: np.ndarray, grades: np.ndarray, weight: np.ndarray, w: np.ndarray, theta: np.ndarray) -> float:
    """-sum of weight * log P(grade), where row i has the features ``column[row == i]``."""
    a, b = _edges(row, column, grades, w, theta)
    return float(-(weight * np.log(np.maximum(a - b, 1e-12))).sum())


def _edges(row, column, grades, w, theta) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= own) and P(grade < own) of each row."""
    s, top = np.bincount(row, weights=w[column], minlength=len(grades)), len(theta)
    lower, upper = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    a = np.where(grades == top, 1.0, 1 / (1 + np.exp(np.clip(s - theta[upper], -60, 60))))
    b = np.where(grades == 0, 0.0, 1 / (1 + np.exp(np.clip(s - theta[lower], -60, 60))))
    return a, b


def slopes(row, column, grades, weight, w, theta) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of ``loss`` by the weights and by the thresholds."""
    a, b = _edges(row, column, grades, w, theta)
    p, top = np.maximum(a - b, 1e-12), len(theta)
    by_score = weight * (1 - a - b)
    by_theta = np.zeros(top)
    np.add.at(by_theta, np.minimum(grades, top - 1), np.where(grades < top, -weight * a * (1 - a) / p, 0))
    np.add.at(by_theta, np.maximum(grades - 1, 0), np.where(grades > 0, weight * b * (1 - b) / p, 0))
    return np.bincount(column, weights=by_score[row], minlength=len(w)), by_theta


def fit(lists: pa.ListArray, grades: np.ndarray, weight: np.ndarray | None = None, rounds: int = 400) -> OrdinalModel:
    """Fit on one feature list and grade for each training row; ``weight``: how many rows a row stands for."""
    empty = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    levels = int(grades.max()) + 1 if len(grades) else 0
    if levels < 2:
        return empty
    n = len(grades)
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    row, column, names = _coded(lists)
    seen = _added(column, len(names))
    base = (grades - grades.mean()) / max(grades.std(), 1e-9)
    tilt = _added(column, len(names), base, row) / np.sqrt(seen)  # a z-score, were the feature no sign of a grade
    kept = np.flatnonzero((seen >= MIN_TEXTS) & (np.abs(tilt) >= STANDS_OUT) & (seen < 0.9 * n))
    place = np.full(len(names), -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    column = place[column]
    own = column >= 0
    row, column = row[own], column[own]
    share = np.array([weight[grades <= k].sum() for k in range(levels - 1)]).clip(1e-6, 1 - 1e-6)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(levels - 1))
    w = np.zeros(len(kept))
    rows_of = np.maximum(np.bincount(row, minlength=n), 1)
    # a bound of the curvature along each weight and of all thresholds gives each its own step
    step = 4.0 / np.maximum(1e-9, np.bincount(column, weights=(weight * (rows_of + 1))[row], minlength=len(kept)))
    look_w, look_t, momentum = w, theta, 1.0
    for _ in range(rounds):
        by_w, by_t = slopes(row, column, grades, weight, look_w, look_t)
        new_w = look_w - step * by_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * L1, 0)
        new_t = np.maximum.accumulate(look_t - by_t + 1e-6 * np.arange(levels - 1))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look_w, look_t = (new + (momentum - 1) / faster * (new - old) for new, old in ((new_w, w), (new_t, theta)))
        look_t = np.maximum.accumulate(look_t)
        w, theta, momentum = new_w, new_t, faster
    used = np.flatnonzero(w)
    return OrdinalModel(names[kept][used], w[used], theta)


def severity_grades(lists: pa.ListArray, toxic: np.ndarray) -> np.ndarray:
    """Grades from labels that only say toxic or not: 0 not, 1 toxic, 2 toxic with more signs than the
    median of the toxic rows, where a sign is a feature that toxic rows have at least 20 times as often."""
    if not toxic.any():
        return toxic.astype(np.int64)
    row, column, names = _coded(lists)
    bad = _added(column, len(names), toxic, row) / toxic.sum()
    good = _added(column, len(names), 1 - toxic, row) / max(1, (1 - toxic).sum())
    sign = (bad > 20 * (good + 1e-4)) & (_added(column, len(names)) >= MIN_TEXTS)
    signs = _added(row, len(toxic), sign, column)
    return np.where(toxic == 1, 1 + (signs > np.median(signs[toxic == 1])), 0)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> pa.Table:
    """features, label and weight of at most ``MAX_ROWS`` labelled documents of each label value, by the hash of their id.

    Of documents that share an id one is learned from. Features of fewer than ``MIN_TEXTS`` rows are left out where they lie, as no
    model keeps them; rows that would bring a value's features above its part of ``MAX_ENTRIES`` are not learned from."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().distinct()
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(MAX_GRADES + 1).collect()
    if len(sizes) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} values of {label_col}")
    chosen = named.select("id", "label").where("false")
    for size in sizes:
        chosen = chosen.unionByName(named.where(F.col("label") == size.label).orderBy(F.xxhash64("id"), "id").limit(MAX_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    one = (
        texts.join(F.broadcast(chosen), "id")  # at most MAX_ROWS for each value
        .groupBy("id", "label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    )
    rows = written(one.select("id", "label", features(F.col("first.text")).alias("features")), "training")
    each = rows.select("id", "label", F.explode("features").alias("feature"))
    common = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TEXTS).select("feature")
    few = each.join(common, "feature").groupBy("id", "label").agg(F.collect_list("feature").alias("features"))
    none = F.array().cast("array<bigint>")
    kept = written(rows.select("id", "label").join(few, ["id", "label"], "left").withColumn("features", F.coalesce("features", none)), "common")
    discard(rows)
    of = {s.label: s.n for s in sizes}
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")  # at most MAX_ROWS narrow rows of a value
    share = MAX_ENTRIES // max(1, len(sizes))
    held = kept.select("id", "label", F.size("features").alias("n")).withColumn("nth", F.row_number().over(order)).withColumn("held", F.sum("n").over(order))
    fits = held.where((F.col("held") <= share) | (F.col("nth") == 1)).select("id", "label")
    table = kept.join(F.broadcast(fits), ["id", "label"]).toArrow().combine_chunks().sort_by([("label", "ascending"), ("id", "ascending")])
    discard(kept)
    seen = {v: n for v, n in zip(*np.unique(table["label"].to_numpy(), return_counts=True))}
    weight = pa.array([of[v] / min(of[v], seen[v]) for v in table["label"].to_pylist()], pa.float64())
    return table.append_column("weight", weight)


def train(docs: DataFrame, labels: DataFrame, *, toxic_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on documents labelled toxic or not; the grades are those of ``severity_grades``."""
    rows = training_rows(docs, labels, toxic_col, id_col, text_col)
    if not rows.num_rows:
        return fit(pa.array([], pa.list_(pa.int64())), np.zeros(0, np.int64))
    lists = rows["features"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.cast(pa.list_(pa.int64()))
    toxic = (rows["label"].to_numpy() > 0).astype(np.int64)
    weight = rows["weight"].to_numpy().astype(np.float64)
    del rows
    release_memory()  # the driver's memory is shared with its JVM
    model = fit(lists, severity_grades(lists, toxic), weight)
    del lists
    release_memory()
    return model


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, ``severity`` (expected grade), ``grade`` (most thresholds that
    are more likely passed than not) and ``is_toxic`` (grade above 0), and the columns ``keep``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("kept"),
        features(text_of(text_col)).alias("features"),
    )
    schema = rows.drop("features").schema.add("severity", "double").add("grade", "integer")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        seen = np.zeros(1 << 20, dtype=bool)
        short = lambda x: (x.view(np.uint64) >> np.uint64(44)).astype(np.int64)
        seen[short(model.features)] = True
        for batch in batches:
            flat, ends = _csr(batch.column(2))
            at = np.flatnonzero(seen[short(flat)])
            where = np.searchsorted(model.features, flat[at])
            found = where < len(model.features)
            at, where = at[found], where[found]
            same = model.features[where] == flat[at]
            doc = np.searchsorted(ends, at[same], side="right") - 1
            scores = np.bincount(doc, weights=model.weights[where[same]], minlength=batch.num_rows)
            above = model.above(scores)
            columns = [pa.array(above.sum(axis=1)), pa.array((above > 0.5).sum(axis=1), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["id", "kept", "severity", "grade"])

    return rows.mapInArrow(tidy(work), schema).select(
        F.col("id").alias(id_col),
        "severity",
        "grade",
        (F.col("grade") > 0).alias("is_toxic"),
        *[F.col("kept")[c].alias(c) for c in keep if c != id_col],
    )
