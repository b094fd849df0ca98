"""Text quality by support vectors on naive-Bayes features.

Indicators of word and word-shape n-grams are scaled by the logarithm of how
much likelier they are in good than in bad texts (counted over all labelled training rows); a
linear hinge-loss model is fitted on a bounded sample of them by dual
coordinate descent and interpolated with its mean weight, as Wang and Manning (2012) do.
A logistic curve, fitted on a part of the sample that the model has not seen, turns margins into scores.

Features see the text only. A shape is a word's letter case, digits, last
character and length class, and whether the pair it ends has occurred before in the text.

Defined cases: an empty or null text has no features and gets the score of the
free term. Without labels of both classes every score is the smoothed share of
good labels. Repeated labels of a document count once, the smallest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella.llm.common import SPACED, _stream, arrow_map, importable, mix, row_groups, utf8
from parcella.llm.learn import corpus_counts, distinct_pairs, labelled, logistic, sample, sigmoid

SIZE = 1 << 17
#: Rows that the support vectors are chosen from.
SAMPLE_ROWS = 12_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
#: Weight of the model against its mean weight.
INTERPOLATION = 0.25

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_F = _stream(21, 6) | np.uint64(1)


def _bucket(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(47)).astype(np.int64)


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A number for the look of every word."""
    at = starts - starts[0]
    own = data[starts[0] : ends[-1]]
    upper = np.add.reduceat(_UPPER[own].astype(np.int64), at)
    letters = np.add.reduceat(_LETTER[own].astype(np.int64), at)
    digits = np.add.reduceat(_DIGIT[own].astype(np.int64), at)
    length = ends - starts
    last = data[ends - 1].astype(np.int64)
    last = np.where(_LETTER[last] | _DIGIT[last], 0, last)
    case = np.where(upper == 0, 0, np.where((upper > 1) & (2 * upper >= letters), 2, 1))
    kind = case + 3 * (digits > 0) + 6 * np.minimum(length // 5, 3) + 24 * (letters == 0) + 48 * seen
    return (kind * 256 + last).astype(np.uint64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of one- and two-word and one- to three-shape n-grams."""
    hashes, bounds, starts, ends = SPACED.words(data, offsets)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    pair = np.zeros(n, np.uint64)
    pair[1:] = mix(hashes[:-1] * _F[0] + hashes[1:] * _F[1])
    inner = np.ones(n, bool)
    inner[bounds[:-1][bounds[:-1] < n]] = False
    _, first = np.unique(pair + row.astype(np.uint64) * _F[2], return_index=True)
    seen = inner.copy()
    seen[first] = False
    shape = shapes(data, starts, ends, seen)
    third = inner.copy()
    third[1:] &= inner[:-1]
    two, three = np.flatnonzero(inner), np.flatnonzero(third)
    rows = [row, row[two], row, row[two], row[three]]
    keys = [
        hashes,
        pair[two],
        shape * _F[3] + np.uint64(1),
        shape[two] * _F[3] + shape[two - 1] * _F[4] + np.uint64(2),
        shape[three] * _F[3] + shape[three - 1] * _F[4] + shape[three - 2] * _F[5] + np.uint64(3),
    ]
    return distinct_pairs(np.concatenate(rows), _bucket(np.concatenate(keys)), SIZE)


def dual_descent(values: np.ndarray, columns: np.ndarray, ends: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int):
    """Weights of a hinge-loss model without a separate free term (Hsieh et al., 2008)."""
    w, alpha, draw = np.zeros(size), np.zeros(len(y)), np.random.Generator(np.random.PCG64(5))
    rows = [(columns[a:b], values[a:b], float(values[a:b] @ values[a:b])) for a, b in zip(ends[:-1], ends[1:])]
    for _ in range(EPOCHS):
        for i in draw.permutation(len(y)):
            column, value, norm = rows[i]
            if norm:
                slope = y[i] * (w[column] @ value) - 1
                new = min(max(alpha[i] - slope / norm, 0.0), cost[i])
                if new != alpha[i]:
                    w[column] += (new - alpha[i]) * y[i] * value
                    alpha[i] = new
    return w


@dataclass
class Model:
    weights: np.ndarray
    free: float
    slope: float
    shift: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, column = features(data, offsets)
        n = len(offsets) - 1
        length = np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
        margin = np.bincount(row, self.weights[column], minlength=n) / length + self.free
        return sigmoid(self.slope * margin + self.shift)


def fit(rows: DataFrame) -> Model:
    """A model from (doc_id, text, label); label is 0 or 1."""
    rows = rows.withColumn("label", (F.col("label") == 1).cast("int"))
    counts, totals = corpus_counts(rows, ["label"], features, SIZE)
    good, total = totals
    if good == 0 or good == total:
        share = (good + 1) / (total + 2)
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    p, q = counts[0] + SMOOTHING, counts[1] - counts[0] + SMOOTHING
    ratio = np.log(p / (good + 2 * SMOOTHING)) - np.log(q / (total - good + 2 * SMOOTHING))
    marks, columns, ends = sample(rows, total, SAMPLE_ROWS, ["label"], features)
    y = np.where(marks[0] == 1, 1.0, -1.0)
    length = np.sqrt(np.maximum(1, np.diff(ends)))
    values = ratio[columns] / np.repeat(length, np.diff(ends))
    # The free term is one more feature.
    at = ends[1:]
    columns, values, ends = np.insert(columns, at, SIZE), np.insert(values, at, 1.0), ends + np.arange(len(ends))
    balance = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    cut = int(ends[int(len(y) * 0.8)])
    part = int(len(y) * 0.8)
    w = dual_descent(values[:cut], columns[:cut], ends[: part + 1], y[:part], COST * balance[:part], SIZE + 1)
    # With the mean weight alone, margins would be those of naive Bayes.
    own = INTERPOLATION * w + (1 - INTERPOLATION) * np.abs(w[:-1]).mean()
    own[-1] = INTERPOLATION * w[-1]
    held = np.add.reduceat(own[columns] * values, ends[:-1])[part:]
    curve = logistic(held[:, None] / max(1e-9, held.std()), (y[part:] > 0).astype(float), 1e-3, 400)
    return Model(own[:-1] * ratio, float(own[-1]), float(curve[0] / max(1e-9, held.std())), float(curve[1]))


def held_out() -> Column:
    """Rows kept out of training: a quarter, by a checksum of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and score (0 to 1) of every row."""
    spark = importable(documents.sparkSession)
    training = labelled(documents, labels.where(~held_out()), "quality")
    model = spark.sparkContext.broadcast(fit(training))

    def run(batch):
        data, offsets = utf8(batch.column(2))
        scores = [model.value.score(data, offsets[i : j + 1]) for i, j in row_groups(offsets)]
        scores = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], ["doc_id", "held_out", "score"])

    own = documents.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return arrow_map(own, "doc_id long, held_out boolean, score double", run)
