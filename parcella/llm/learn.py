"""Shared parts of the learned operators: labelled rows, corpus counts, a bounded sample.

A feature function takes the bytes and row offsets of some texts and returns
two arrays: row numbers and feature numbers, each pair once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcella.llm.common import Bitmap, arrow_map, lists, row_groups, utf8

Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def labelled(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of the labelled documents; the smallest of a document's labels counts.

    A bitmap of fixed size keeps most other texts out of the shuffle. The join is a
    shuffled one at every size.
    """
    one = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    known = Bitmap(one.select(F.xxhash64(F.col("doc_id").cast("long")).alias("key")), "key")

    def maybe(batch):
        yield batch.filter(pa.array(known.maybe(batch.column(2).to_numpy())))

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = arrow_map(texts.withColumn("key", F.xxhash64("doc_id")), "doc_id long, text string, key long", maybe)
    return texts.select("doc_id", "text").join(one.hint("merge"), "doc_id")


def distinct_pairs(rows: np.ndarray, features: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, ordered."""
    keys = np.unique(rows.astype(np.int64) * size + features)
    return keys // size, keys % size


def corpus_counts(rows: DataFrame, classes: list[str], features: Features, size: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of each 0/1 column, and of all rows, each feature occurs.

    Every task adds its rows up first and gives at most ``size`` sums, so what is
    shuffled and collected is bounded by the feature space.
    """
    schema = "feature int, " + ", ".join(f"n{k} long" for k in range(len(classes) + 1))

    def run(batches):
        total, n = np.zeros((len(classes) + 1, size), np.int64), np.zeros(len(classes) + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            marks = [batch.column(1 + k).to_numpy(zero_copy_only=False) == 1 for k in range(len(classes))]
            marks.append(np.ones(batch.num_rows, bool))
            n += [m.sum() for m in marks]
            for i, j in row_groups(offsets):
                row, feature = features(data, offsets[i : j + 1])
                for k, m in enumerate(marks):
                    total[k] += np.bincount(feature[m[i:j][row]], minlength=size)
        used = np.flatnonzero(total[-1])
        columns = [pa.array(np.append(used, -1), pa.int32()), *(pa.array(np.append(t[used], c)) for t, c in zip(total, n))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", *(f"n{k}" for k in range(len(classes) + 1))])

    sums = rows.select("text", *classes).mapInArrow(run, schema).groupBy("feature")
    found = sums.agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(len(classes) + 1))).toArrow()
    feature, counts = found.column("feature").to_numpy(), np.zeros((len(classes) + 1, size))
    totals = np.zeros(len(classes) + 1)
    for k in range(len(classes) + 1):
        n = found.column(f"n{k}").to_numpy()
        counts[k, feature[feature >= 0]] = n[feature >= 0]
        totals[k] = n[feature < 0].sum()
    return counts, totals


def share(key: str) -> Column:
    """A fixed number from 0 to 1 for a key."""
    return F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1_000_003)) / 1_000_003


def feature_rows(rows: DataFrame, classes: list[str], features: Features) -> DataFrame:
    """doc_id, the 0/1 columns and the features of every row."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in row_groups(offsets):
                row, feature = features(data, offsets[i : j + 1])
                ends = np.searchsorted(row, np.arange(j - i + 1))
                own = [batch.column(k).slice(i, j - i) for k in (0, *range(2, 2 + len(classes)))]
                names = ["doc_id", *classes, "features"]
                yield pa.RecordBatch.from_arrays([*own, lists(feature, ends, pa.int32())], names)

    schema = "doc_id long, " + "".join(f"{c} int, " for c in classes) + "features array<int>"
    own = rows.select("doc_id", "text", *(F.col(c).cast("int").alias(c) for c in classes))
    return own.mapInArrow(run, schema)


def sample(rows: DataFrame, total: float, bound: int, classes: list[str], features: Features):
    """Labels and features of about ``bound`` rows chosen by a hash of their id, in its order."""
    chosen = rows.where(share("doc_id") < (bound / total if total > bound else 2.0))
    found = feature_rows(chosen, classes, features).toArrow().sort_by("doc_id")
    marks = np.stack([found.column(c).to_numpy() for c in classes]) if found.num_rows else np.zeros((len(classes), 0))
    column = found.column("features").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = np.append(0, np.cumsum(np.asarray(column.value_lengths(), np.int64)))
    return marks, np.asarray(column.flatten(), np.int64), ends


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights of a regularised logistic regression (the last is the free term), by accelerated gradients."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1, dtype=np.float32)
    y, v = y.astype(np.float32), np.ones(x.shape[1], np.float32)
    for _ in range(12):  # the largest singular value bounds the slope's change
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    rate = np.float32(1 / (0.3 * np.linalg.norm(v) + penalty))
    pull = np.full(x.shape[1], penalty, np.float32)
    pull[-1] = 0
    w = before = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        ahead = w + np.float32(t / (t + 3)) * (w - before)
        before, w = w, ahead - rate * (x.T @ (sigmoid(x @ ahead) - y) + pull * ahead)
    return w.astype(float)
