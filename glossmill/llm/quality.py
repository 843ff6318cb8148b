"""Document quality by ordinal regression on graded ratings.

A document's score is one weighted sum over hashed features of its whole text: its distinct
words, their beginnings and ends, its runs of punctuation, and binned shares (distinct words,
capitals, digits, punctuation, length). Ordered thresholds cut the score into grades (the
cumulative-link model with logistic link): P(grade <= j) = logistic(t_j - score). The weights are
shared by all grades. The expected grade and the chance of at least ``least_grade`` follow.

Weights and thresholds are fitted on the driver to at most ``sample_rows`` rated documents, those
with the least hashes, in ``epochs`` passes, whatever their number; all documents are graded by all
of their text.

Defined cases: a null or empty text has only the features of an empty text; rows without a
rating, or with an id that is null, teach nothing; of several ratings of an id the least counts;
without any rating the grade is null and every row is kept; a grade outside 0 to ``n_grades`` - 1 is
an error. Repeated rows are graded alike. Only the id and the text are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, LOWER, Words, mix, span_hashes, words_of

BITS = 20
_WORD = ALNUM.copy()
_WORD[0x41:0x5B] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK &= ~_WORD


def _binned(part: np.ndarray, whole: np.ndarray, kind: int) -> np.ndarray:
    """A feature for each row: in which tenth its share lies."""
    share = np.where(whole > 0, part / np.maximum(whole, 1), 0)
    return (mix(np.full(len(part), 1000 + kind, np.uint64)) + np.floor(share * 10).astype(np.uint64)) % np.uint64(1 << BITS)


def _features(words: Words, marks: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row in a row, and where each row's begin."""
    low = LOWER[words.buf]
    rows = words.rows
    n = np.diff(words.bounds)
    hashes = span_hashes(low, words.starts, words.ends)
    keys, first = np.unique(mix(hashes ^ words.owners().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    s, e, owner = words.starts[first], words.ends[first], words.owners()[first]
    by = np.argsort(s)
    s, e, owner, own = s[by], e[by], owner[by], hashes[first][by]
    parts = [(owner, own)]
    for k, (a, b) in enumerate(((s, np.minimum(e, s + 4)), (s, np.minimum(e, s + 5)), (s, np.minimum(e, s + 6)), (np.maximum(s, e - 3), e)), 1):
        parts.append((owner, mix(span_hashes(low, a, b) + np.uint64(k))))
    parts.append((marks.owners(), mix(span_hashes(marks.buf, marks.starts, np.minimum(marks.ends, marks.starts + 4)) + np.uint64(9))))

    def count(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[words.offsets])

    buf, size = words.buf, np.diff(words.offsets)
    capital, digit, mark = (buf >= 0x41) & (buf <= 0x5A), (buf >= 0x30) & (buf <= 0x39), _MARK[buf]
    every = np.arange(rows)
    for k, (a, b) in enumerate(((np.bincount(owner, minlength=rows), n), (count(capital), size), (count(digit), size), (count(mark), size), (np.minimum(np.log2(n + 1), 19), np.full(rows, 20.0)))):
        parts.append((every, _binned(a, b, k)))
    owner = np.concatenate([o for o, _ in parts]).astype(np.uint64)
    index = np.concatenate([f for _, f in parts]) % np.uint64(1 << BITS)
    keys = np.unique(owner << np.uint64(32) | index)
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(keys >> np.uint64(32), np.arange(rows + 1))


def _all_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for words, marks in zip(words_of(column, _WORD, False), words_of(column, _MARK, False), strict=True):
        yield words.first, *_features(words, marks)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Shared weights and ascending thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each row and j = 1, 2, ..."""
        score = np.zeros(len(bounds) - 1)
        full = np.diff(bounds) > 0
        if full.any():
            score[full] = np.add.reduceat(self.weights[features], bounds[:-1][full])
        return _sigmoid(score[:, None] - self.thresholds)


def fit_ordinal(
    features: np.ndarray, bounds: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 40, rate: float = 0.1, decay: float = 1e-5, batch: int = 64, seed: int = 3
) -> OrdinalModel:
    """Likelihood by AdaGrad on mini-batches; rare grades count more, by a power of 0.75.

    Row i has features[bounds[i]:bounds[i + 1]].
    """
    rng = np.random.default_rng(seed)
    used, features = np.unique(features, return_inverse=True)
    features = features.astype(np.int32)
    n = np.diff(bounds)
    share = np.bincount(grades, minlength=n_grades)
    weight = (len(grades) / np.maximum(share, 1) / max(1, (share > 0).sum())) ** 0.75
    w, squares = np.zeros(len(used)), np.full(len(used), 1e-6)
    start = np.cumsum(share)[:-1] / len(grades)
    raw = np.log(np.clip(start, 0.02, 0.98) / (1 - np.clip(start, 0.02, 0.98)))
    t = np.maximum.accumulate(raw + 1e-3 * np.arange(n_grades - 1))
    t_squares = np.full(n_grades - 1, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(grades))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            index, owner = np.concatenate([features[bounds[r] : bounds[r + 1]] for r in rows]), np.repeat(np.arange(len(rows)), n[rows])
            score = np.bincount(owner, w[index], len(rows))
            y, edges = grades[rows], np.concatenate([[-np.inf], t, [np.inf]])
            upper, lower = _sigmoid(edges[y + 1] - score), _sigmoid(edges[y] - score)
            chance = np.maximum(upper - lower, 1e-9)
            up, down = upper * (1 - upper) / chance, lower * (1 - lower) / chance
            slope = weight[y] * (up - down)  # of the loss, by the score
            g = np.bincount(index, slope[owner], len(used)) / len(rows)
            g += decay * w * (g != 0)
            squares += g * g
            w -= rate * g / np.sqrt(squares)
            g = np.array([np.sum(weight[y] * ((y == j + 1) * down - (y == j) * up)) for j in range(n_grades - 1)]) / len(rows)
            t_squares += g * g
            t = np.maximum.accumulate(t - rate * g / np.sqrt(t_squares))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, t)


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int, epochs: int) -> OrdinalModel | None:
    """A model of at most ``sample_rows`` rows of (doc_id, text) that (doc_id, grade) rates."""
    known = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_rows)
    rows = docs.join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))  # at most sample_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, index, bounds in _all_features(batch.column("text")):
                part = batch.slice(first, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("grade"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(index, pa.int32()))], ["h", "grade", "features"])

    table = rows.select("h", "grade", "text").mapInArrow(run, "h long, grade int, features array<int>").orderBy("h", "grade").limit(sample_rows).toArrow()
    if not table.num_rows:
        return None
    grades = table.column("grade").to_numpy().astype(np.int64)
    if grades.min() < 0 or grades.max() >= n_grades:
        raise ValueError(f"grades must lie between 0 and {n_grades - 1}")
    lists = table.column("features").combine_chunks()
    bounds = np.cumsum(np.append(0, np.diff(lists.offsets.to_numpy())))
    return fit_ordinal(lists.flatten().to_numpy(), bounds, grades, n_grades, epochs)


def grade_documents(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, least_grade: int | None = None, chance: float = 0.5, sample_rows: int = 8000, epochs: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, expected_grade, at_least (P(grade >= j) for j from 1), tail_probability
    (P(grade >= least_grade), by default the highest) and kept: whether it reaches ``chance``."""
    least = n_grades - 1 if least_grade is None else least_grade
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(texts, ratings, n_grades, sample_rows, epochs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, index, bounds in _all_features(batch.column("text")):
                n = len(bounds) - 1
                ids = batch.column("doc_id").slice(first, n)
                if model.value is None:
                    none = pa.nulls(n, pa.float64())
                    columns = [ids, none, pa.nulls(n, pa.list_(pa.float64())), none, pa.array([True] * n)]
                else:
                    p = model.value.at_least(index, bounds)
                    tail = p[:, least - 1] if least else np.ones(n)
                    columns = [ids, pa.array(p.sum(axis=1)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (n_grades - 1), pa.int32()), pa.array(p.ravel())), pa.array(tail), pa.array(tail >= chance)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "at_least", "tail_probability", "kept"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, expected_grade double, at_least array<double>, tail_probability double, kept boolean")
